"""DuckDB SQL for the queries. Rules and patterns come from the fixed values; the statements are written on their own."""

from __future__ import annotations

from gristmill.functions import fixed as X
from gristmill.items import CLEAN_SQL, ITEMS_SQL, RESPONSES_SQL, sql_of

ITEMS, RESP, CLEAN = (sql_of(s, "duckdb") for s in (ITEMS_SQL, RESPONSES_SQL, CLEAN_SQL))


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(x: str, pattern: str, ignore_case: bool = False) -> str:
    p = pattern.replace(r"[^\x00-\x7F]", r"[^\x00-\x7F]").replace(r"\w", r"[\p{L}\p{N}\p{M}_]").replace("[[\\p{L}", "[\\p{L}")
    return f"regexp_matches({x}, {q(p)}{', ' + q('i') if ignore_case else ''})"


def strip(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g')"


def words(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '[\p{{L}}\p{{N}}\p{{M}}_]+'))"


def held(x: str, keywords: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(k.lower())})" for k in keywords) + ")"


def first_of(x: str, table, default: str | None) -> str:
    whens = " ".join(f"WHEN {held(f'lower({x})', ks)} THEN {q(n)}" for n, ks in table)
    return f"CASE {whens} ELSE {q(default) if default is not None else 'NULL'} END"


def ranked(x: str, ranks: dict[str, int], default: int) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in ranks.items()) + f" ELSE {default} END"


def first_cat(x: str) -> str:
    return strip(f"split_part({x}, ',', 1)")


GLOSSARY = "(contains(upper(notes), 'GLOSSARY') OR contains(upper(notes), 'DEFINITION'))"
BUCKET = f"CASE lower({first_cat('category')}) " + " ".join(f"WHEN {q(k)} THEN {q(n)}" for n, ks in X.BUCKETS for k in ks) + " ELSE 'Others' END"
T = strip("requirement")
VERB = rx(T, X.REQUIREMENT_VERB, True)
SHORT = f"({words(T)} < 3 AND NOT {VERB})"
PART = f"({T} <> '' AND ({rx(T, X.BARE_NUMBER, True)} OR {rx(T, X.PART_NUMBER)}))"


def noise(t: str, notes: str = "''") -> str:
    whole = " OR ".join([rx(t, X.PURE_DATE, True), rx(t, X.EMAIL_ONLY), rx(t, X.CONTACT), rx(t, X.TICK_OR_LABEL, True), rx(t, X.UPPER_ABBREVIATION), rx(t, X.COUNTRY_MARK, True), f"({words(t)} <= 7 AND {rx(t, X.REVISION_LOG, True)})", f"({rx(t, X.SINGLE_NAME)} AND NOT {rx(t, X.REQUIREMENT_VERB, True)})"])
    exempt = f"(contains(upper({notes}), 'GLOSSARY') OR contains(upper({notes}), 'DEFINITION') OR contains(upper({notes}), 'RFP_PROCESS'))"
    return f"(NOT {exempt} AND ({t} = '' OR {whole}))"


TYPE = f"""CASE WHEN {GLOSSARY} THEN 'glossary' WHEN {rx(T, X.DEFINITION_START)} THEN 'glossary' WHEN contains(upper(notes), 'RFP_PROCESS') THEN 'note'
  WHEN {T} = '' OR {PART} OR {SHORT} THEN 'junk' WHEN {words(T)} < 4 THEN 'note' WHEN {rx(T, X.MODAL_VERB, True)} OR {words(T)} >= 8 THEN 'requirement' ELSE 'note' END"""
LEVEL = first_of("requirement", X.MUST_LEVELS, "INFO")
TABLE_LEVEL = f"CASE WHEN {LEVEL} = 'INFO' AND (regexp_matches(upper(req_id), '^(HOST-|BIOS-|BMC-)') OR regexp_matches(upper(coalesce(row_name, '')), '^(HOST|BIOS|BMC)') OR contains(lower(coalesce(table_name, '')), 'requirements')) THEN 'MUST' ELSE {LEVEL} END"
CATEGORY = f"CASE WHEN {held('lower(notes)', X.GLOSSARY_NOTES)} THEN 'Glossary' " + " ".join(f"WHEN starts_with(req_id, {q(p)}) THEN {q(c[0])}" for p, c in X.CATEGORY_PREFIXES) + f" ELSE {first_of('requirement', X.CATEGORY_KEYWORDS, 'General')} END"
BY_CATEGORY = "CASE {c} " + " ".join(f"WHEN {q(n)} THEN {q(o[0])}" for n, o in X.CATEGORY_OWNERS) + " ELSE 'TBD' END"
OWNER = f"CASE WHEN {BY_CATEGORY} = 'TBD' THEN coalesce({first_of('requirement', X.OWNER_KEYWORDS, None)}, 'TBD') ELSE {BY_CATEGORY} END"
HITS = [f"({held('lower(requirement)', r[1])} OR {held('lower(notes)', r[1])})" for r in X.REDFLAGS]
FLAG_ROWS = " UNION ALL ".join(f"SELECT i.*, {k} AS ord, {q(r[6])} AS message, {q(r[2])} AS st, {q(r[3]) if r[3] else 'NULL'} AS cat, {r[4] or 'NULL'}::BOOLEAN AS ev, {r[5] or 'NULL'}::BOOLEAN AS num FROM items i WHERE {h}" for k, (r, h) in enumerate(zip(X.REDFLAGS, HITS, strict=True)))
FLAGS = f"""flagged AS (SELECT pos, list(message ORDER BY ord) AS messages, arg_max(st, ord) AS status, arg_min(cat, ord) FILTER (WHERE cat IS NOT NULL) AS force_category,
  arg_min(ev, ord) FILTER (WHERE ev IS NOT NULL) AS require_evidence, arg_min(num, ord) FILTER (WHERE num IS NOT NULL) AS forbid_llm_numbers FROM ({FLAG_ROWS}) GROUP BY pos)"""


def tag_of(x: str) -> str:
    t = strip(x)
    parts = [f"WHEN {t} = {q(k)} THEN {q(v)}" for k, v in X.RISK_TAGS.items()]
    parts += [f"WHEN starts_with({t}, {q(p)}) THEN {q(v)}" for p, v in X.MESSAGE_PREFIXES]
    parts += [f"WHEN upper(regexp_extract({t}, 'RF_(CERT|RELIABILITY|PRICE|SCHEDULE|IP|ROADMAP|GLOSSARY)', 1, 'i')) = {q(k[3:])} THEN {q(v)}" for k, v in X.RISK_TAGS.items() if k.startswith("RF_")]
    parts += [f"WHEN {rx(t, p, True)} THEN {q(v)}" for p, v in X.TAG_PATTERNS]
    return f"CASE {' '.join(parts)} ELSE {t} END"


NOTES_OF = "CASE {t} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in X.RISK_NOTES.items()) + " END"
MERGED = f"""c AS ({CLEAN}), r AS ({RESP}), m AS (SELECT c.* EXCLUDE (status), coalesce(nullif(r.status, ''), c.status) AS status, nullif(r.vendor_comment, '') AS vendor_comment,
  nullif(r.gap, '') AS gap0, nullif(r.final_requirement, '') AS final_requirement, coalesce(r.exclude_from_matrix, false) AS excluded, coalesce(r.exclude_reason, '') AS reason
  FROM c LEFT JOIN r USING (case_id, req_id)),
w AS (SELECT *, CASE WHEN excluded THEN concat(CASE WHEN trim(reason) <> '' THEN '[EXCLUDED: ' || trim(reason) || ']' ELSE '[EXCLUDED]' END, CASE WHEN trim(coalesce(gap0, '')) <> '' THEN ' ' || trim(gap0) ELSE '' END) ELSE gap0 END AS gap,
  CASE WHEN excluded THEN 'Excluded' WHEN lower(type) = 'glossary' OR list_contains(risk_tags, 'GLOSSARY') THEN 'Glossary' WHEN type = 'note' THEN 'Notes'
    WHEN type = 'junk' OR upper(coalesce(status, '')) = 'AUTO_SKIP' THEN 'Skipped' ELSE 'Main' END AS sheet FROM m)"""
COUNTS = "count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE upper(coalesce(must_level, '')) = '{v}') AS {v.lower()}" for v in ("MUST", "SHOULD", "MAY", "INFO")) + ", " + ", ".join(f"count(*) FILTER (WHERE upper(coalesce(status, '')) = '{v}') AS {n}" for v, n in (("NEED_REVIEW", "need_review"), ("COMPLIANT", "compliant"), ("PARTIAL", "partial"), ("NON-COMPLIANT", "non_compliant")))
ORDER = f"{ranked('status', X.STATUS_RANK, 9)}, CASE WHEN len(risk_tags) > 0 THEN 0 ELSE 1 END, {ranked('must_level', X.MUST_RANK, 9)}"
LINES = "SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"
PROGRESS = ", ".join(f"count(*) FILTER (WHERE s = '{s}') AS {s.lower().replace('-', '_')}" for s in X.PROGRESS_STATUSES)
STATUSES = ", ".join(map(q, X.PROGRESS_STATUSES))
FILES = "SELECT concat('case', s_suppkey % 3) AS case_id, s_suppkey AS ord, concat(s_name, '.', ['docx','xlsx','pdf','zip'][(s_suppkey % 4 + 1)::INT]) AS name, s_suppkey * 10 AS size FROM supplier"
SELECTION = f"SELECT case_id, name, CASE WHEN ord % 3 = 0 THEN false WHEN ord % 2 = 0 THEN true END AS include FROM ({FILES}) WHERE ord % 3 <> 1"
LOG = "SELECT concat('case', o_custkey % 3) AS case_id, concat('f', o_custkey % 11) AS file, (o_orderkey % 60)::INT AS chunk, o_orderkey % 5 = 0 AS failed_chunk FROM orders"
HALF = "CASE WHEN abs(s - floor(s) - 0.5) < 1e-9 THEN CASE WHEN floor(s)::BIGINT % 2 = 0 THEN floor(s) ELSE floor(s) + 1 END ELSE round(s) END::BIGINT"
LINE = """CASE event_id % 6 WHEN 0 THEN ['chunk', 'a.docx', (event_id % 50)::VARCHAR, '50', NULL] WHEN 1 THEN ['item', NULL, (event_id % 90)::VARCHAR, '90', NULL] WHEN 2 THEN ['chunks_total', 'b.xlsx', NULL, (event_id % 70)::VARCHAR, NULL]
  WHEN 3 THEN ['retry', NULL, NULL, '3', (event_id % 3 + 1)::VARCHAR] WHEN 4 THEN ['item', NULL, (event_id % 20)::VARCHAR, '20', NULL] END"""
STATE = f"""WITH e AS (SELECT concat('run', user_id % 20) AS run, event_id AS seq, {LINE} AS v FROM events),
p AS (SELECT run, seq, v[1] AS kind, v[2] AS file, v[3]::BIGINT AS done, v[4]::BIGINT AS total, v[5]::BIGINT AS attempt FROM e)
SELECT run, arg_max(file, seq) FILTER (WHERE file IS NOT NULL) AS file_current, arg_max(done, seq) FILTER (WHERE kind = 'chunk') AS chunk_done, arg_max(total, seq) FILTER (WHERE kind IN ('chunk', 'chunks_total')) AS chunk_total,
  arg_max(done, seq) FILTER (WHERE kind = 'item') AS item_done, arg_max(total, seq) FILTER (WHERE kind = 'item') AS item_total, arg_max(attempt, seq) FILTER (WHERE kind = 'retry') AS retry_attempt, count(kind) AS events, count(*) AS lines FROM p GROUP BY run"""


def _changed(sha: str) -> str:
    text = strip("coalesce(nullif(normalized_requirement, ''), requirement)")
    return f"SELECT case_id, pos, req_id, sha256({text}) AS th, coalesce({sha}, '') AS fh FROM c WHERE type = 'requirement' AND req_id <> ''"


CACHE = f"""WITH c0 AS ({CLEAN}),
cur AS (WITH c AS (SELECT * FROM c0) {_changed("CASE split_part(source, ' —', 1) WHEN 'spec_0' THEN 'h' WHEN 'spec_1' THEN 'hh' WHEN 'spec_2' THEN 'hhh' END")}),
old AS (WITH c AS (SELECT * REPLACE (CASE WHEN pos % 10 = 0 THEN requirement || '!' ELSE requirement END AS requirement) FROM c0 WHERE pos % 50 <> 7) {_changed("CASE split_part(source, ' —', 1) WHEN 'spec_0' THEN 'h' WHEN 'spec_1' THEN 'hh' WHEN 'spec_2' THEN 'hhhx' END")}),
o AS (SELECT case_id, req_id, arg_max(th, pos) AS oth, arg_max(fh, pos) AS ofh FROM old GROUP BY ALL),
d AS (SELECT cur.case_id, cur.req_id, pos, CASE WHEN oth IS NULL THEN 'no_cache' WHEN th = oth AND fh = ofh THEN 'unchanged' ELSE 'changed' END AS reason,
  CASE WHEN oth IS NULL THEN '' ELSE array_to_string(list_filter([CASE WHEN fh <> ofh THEN 'file_hash' END, CASE WHEN th <> oth THEN 'requirement_text_hash' END], lambda x: x IS NOT NULL), ',') END AS changed_fields
  FROM cur LEFT JOIN o USING (case_id, req_id))"""
SUMMARY = CACHE + """, s AS (SELECT case_id, count(DISTINCT req_id) AS total, count(*) FILTER (WHERE reason = 'unchanged') AS reused, 2::BIGINT AS skipped_files FROM d GROUP BY case_id),
t AS (SELECT *, greatest(total - reused, 0) AS reprocessed, reused * 1.5 AS saved_seconds, reused * 1.5 AS s FROM s),
u AS (SELECT * EXCLUDE (s), """ + HALF + """ AS n FROM t),
z AS (SELECT * EXCLUDE (n), CASE WHEN n < 60 THEN n || 's' ELSE (n // 60) || 'm ' || (n % 60) || 's' END AS saved FROM u)"""

IDS = f"""WITH items AS ({ITEMS}), r AS (SELECT *, CASE file WHEN 'AUTO-spec_1.xlsx' THEN true WHEN 'AUTO-spec_4.docx' THEN true ELSE false END AS ok, regexp_extract_all(requirement || ' ' || notes, '\\[ROW_ID\\s*=\\s*([A-Za-z0-9_\\-]+)\\]', 1) AS ev FROM items),
v AS (SELECT *, CASE
  WHEN regexp_matches(req_id, '^(HOST|BMC|BIOS|PCIe|STORAGE|PWR)-\\d+$') THEN CASE WHEN ok OR len(list_filter(ev, lambda x: contains(upper(x), split_part(req_id, '-', 1)))) > 0 THEN 'RFQ-' || split_part(req_id, '-', 1) || '-' || printf('%03d', split_part(req_id, '-', 2)::INT) END
  WHEN regexp_matches(req_id, '^ROW_ID=\\d+$') THEN CASE WHEN ok OR len(ev) > 0 THEN 'RFQ-TBL-' || printf('%03d', split_part(req_id, '=', 2)::INT) END
  WHEN regexp_matches(req_id, '^RFQ-[A-Za-z_]+-\\d+$') THEN CASE WHEN ok OR len(list_filter(ev, lambda x: contains(upper(x), split_part(req_id, '-', 2)))) > 0 THEN req_id END
  WHEN regexp_matches(req_id, '^RFQ-\\d+$') THEN CASE WHEN ok THEN req_id END
  WHEN regexp_matches(req_id, '^AI-\\d+$') THEN req_id WHEN regexp_matches(req_id, '^\\d+$') AND ok THEN 'RFQ-' || printf('%03d', req_id::INT) END AS known FROM r)
SELECT case_id, pos, coalesce(known, 'AI-' || printf('%03d', (count(*) FILTER (WHERE known IS NULL) OVER (PARTITION BY case_id ORDER BY pos ROWS UNBOUNDED PRECEDING))::INT)) AS id,
  CASE WHEN known IS NULL OR starts_with(known, 'AI-') THEN 'generated' ELSE 'original' END AS id_source, req_id AS original_id FROM v"""

I = f"WITH items AS ({ITEMS})"  # noqa: E741
ENRICHED = f"""{I}, {FLAGS}, b AS (SELECT i.*, {rx(T, X.DEFINITION_LINE)} OR {GLOSSARY} AS g, {CATEGORY} AS cat, coalesce(f.status, 'PENDING') AS st, f.force_category AS fc, coalesce(len(f.messages), 0) AS n,
  CASE WHEN upper(coalesce(must_level, '')) IN ('MUST', 'SHOULD', 'MAY') THEN upper(must_level) ELSE {TABLE_LEVEL} END AS lv FROM items i LEFT JOIN flagged f USING (pos))
SELECT pos, CASE WHEN g THEN 'INFO' ELSE lv END AS must_level, CASE WHEN g THEN 'Glossary' ELSE coalesce(fc, cat) END AS category, CASE WHEN g THEN 'TBD' ELSE {OWNER.format(c='cat')} END AS owner,
  CASE WHEN g THEN 'AUTO_SKIP' ELSE st END AS status, CASE WHEN g THEN 1 ELSE n END::INT AS n_messages, CASE WHEN g THEN true END AS auto_skip FROM b"""

# --- folds over one text: chunks of sentences and of blocks


def sentences_packed(t: str, most: int) -> str:
    """Pieces of the text t, a column of stripped texts."""
    cut = rf"regexp_replace({t}, '([.!?；。])\s+', '\1' || chr(1), 'g')"
    each = f"list_filter(list_transform(string_split({cut}, chr(1)), lambda x: {strip('x')}), lambda x: x <> '')"
    kept = "CASE WHEN a.buf <> '' THEN list_append(a.out, a.buf) ELSE a.out END"
    cuts = f"list_filter(list_transform(range(0, length(s), {most}), lambda i: {strip(f'substr(s, i + 1, {most})')}), lambda x: x <> '')"
    step = f"CASE WHEN length(a.buf) + length(s) + 1 <= {most} THEN {{'out': a.out, 'buf': {strip("a.buf || ' ' || s")}}} WHEN length(s) > {most} THEN {{'out': list_concat({kept}, {cuts}), 'buf': ''}} ELSE {{'out': {kept}, 'buf': s}} END"
    folded = f"list_reduce({each}, lambda a, s: {step}, {{'out': CAST([] AS VARCHAR[]), 'buf': ''}})"
    last = f"list_transform([{folded}], lambda z: CASE WHEN z.buf <> '' THEN list_append(z.out, z.buf) ELSE z.out END)[1]"
    return f"CASE WHEN {t} = '' THEN CAST([] AS VARCHAR[]) WHEN length({t}) <= {most} THEN [{t}] ELSE {last} END"


def paragraphs(text: str, most: int) -> str:
    blocks = rf"list_filter(list_transform(regexp_split_to_array(replace(coalesce({text}, ''), chr(13) || chr(10), chr(10)), '\n\s*\n'), lambda b: {strip('b')}), lambda b: b <> '')"
    return f"flatten(list_transform({blocks}, lambda b: {sentences_packed('b', most)}))"


def blocks_packed(blocks: str, most: int, group: int) -> str:
    done = rf"list_append(a.out, {strip('array_to_string(a.buf, chr(10))')})"
    long, full = f"length(b) > {most}", f"(len(a.buf) > 0 AND (len(a.buf) >= {group} OR a.n + length(b) + 2 > {most}))"
    out = f"CASE WHEN ({long} OR {full}) AND len(a.buf) > 0 THEN {done} ELSE a.out END"
    whole = f"CASE WHEN contains(b, '[ROW_ID=') THEN [b] ELSE {sentences_packed(strip('b'), most)} END"
    step = f"CASE WHEN {long} THEN {{'out': list_concat({out}, {whole}), 'buf': CAST([] AS VARCHAR[]), 'n': 0::BIGINT}} WHEN {full} THEN {{'out': {out}, 'buf': [b], 'n': length(b) + 2}} ELSE {{'out': {out}, 'buf': list_append(a.buf, b), 'n': a.n + length(b) + 2}} END"
    folded = f"list_reduce({blocks}, lambda a, b: {step}, {{'out': CAST([] AS VARCHAR[]), 'buf': CAST([] AS VARCHAR[]), 'n': 0::BIGINT}})"
    return f"list_transform([{folded}], lambda a: CASE WHEN len(a.buf) > 0 THEN {done} ELSE a.out END)[1]"


def pieces(chunks: str) -> str:
    return f"SELECT doc_id, unnest(range(len(c)))::INT AS chunk, unnest(c) AS text FROM (SELECT doc_id, {chunks} AS c FROM documents)"


# --- whole stages

PRIMARY = "n AS (SELECT case_id, file, count(*) AS n, min(pos) AS first FROM items WHERE file <> '<file>' GROUP BY ALL), prim AS (SELECT case_id, file AS primary_file FROM n QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY file LIKE '%.docx' DESC, n DESC, first) = 1)"
SHOWN = strip(r"regexp_replace(regexp_replace(f, '\.(docx|doc|xlsx|xls|pdf|txt|md)$', '', 'i'), '^AUTO[-_]?', '', 'i')")
SHOWN = f"left({strip(f"regexp_replace({SHOWN}, '^(UNKNOWN|UnknownFile)$', '', 'i')")}, 40)"
PLACE = """CASE WHEN nm = '' THEN '' WHEN coalesce(sheet, '') <> '' AND row IS NOT NULL THEN nm || ' — Sheet: ' || sheet || ', 第 ' || row || ' 行' WHEN coalesce(sheet, '') <> '' THEN nm || ' — Sheet: ' || sheet
  WHEN "table" IS NOT NULL AND table_row IS NOT NULL THEN nm || ' — Table ' || "table" || ', Row ' || table_row WHEN page IS NOT NULL THEN nm || ' — 第 ' || page || ' 頁' WHEN chunk_no >= 0 THEN nm || ' — 第 ' || chunk_no || ' 段' ELSE nm END"""
SOURCED = f"sourced AS (SELECT i.* EXCLUDE (file), CASE WHEN file = '<file>' THEN coalesce(primary_file, 'UNKNOWN_SOURCE') ELSE {strip('file')} END AS f, coalesce(try_cast(chunk AS INT), -1) AS chunk_no FROM {{src}} i LEFT JOIN prim USING (case_id))"
TRIAGE = r"""CASE WHEN type <> 'requirement' THEN 0 WHEN regexp_matches(t, '\b(tpm|trusted computing|tcg)\b') THEN 1
  WHEN regexp_matches(t, '\b(bezel|lcd|keypad|button|led|front bezel|rear bezel|console port)\b') AND (regexp_matches(t, '\b(look and feel|common)\b') OR contains(t, 'required')) THEN 2
  WHEN regexp_matches(t, '\b(bezel|lcd|keypad|button|led|front bezel|rear bezel|console port)\b') THEN 3 WHEN regexp_matches(t, '\b(fru|cru|replaceable|can be replaced)\b') THEN 4 ELSE 0 END"""
PLAIN_LEVEL = "CASE WHEN type = 'glossary' THEN 'INFO' WHEN contains({t}, 'must') OR contains({t}, 'shall') THEN 'MUST' WHEN contains({t}, 'can be replaced') THEN 'MAY' ELSE 'INFO' END"


def one_of(k: str, *values: str) -> str:
    return f"[{', '.join(map(q, values))}][{k} + 1]"


PLAIN = f"""{I}, a AS (SELECT pos, requirement, lower(requirement) AS t, {TYPE} AS type FROM items), b AS (SELECT *, {PLAIN_LEVEL.format(t='t')} AS must_level, {TRIAGE} AS k FROM a), c AS (SELECT *, {one_of('k', 'General', 'Security', 'Mechanical', 'Mechanical', 'Serviceability')} AS own FROM b)
SELECT pos, type, must_level, CASE WHEN own <> 'General' THEN own ELSE {first_of('requirement', X.CATEGORY_CORRECTIONS, 'General')} END AS category, {one_of('k', 'TBD', 'BIOS/Security', 'ME/ID', 'ME/ID', 'QA/Service')} AS owner, {one_of('k', '', 'CERT', 'ACCEPTANCE', '', 'SERVICEABILITY')} AS risk_tags,
  {one_of('k', '', 'TPM implementation (dTPM/fTPM), part datasheet, certification scope', 'Customer acceptance criteria / reference product / mechanical spec', 'Mechanical spec / ID drawing / BOM impact', 'Service policy / replacement procedure / responsibility boundary')} AS evidence_needed,
  {one_of('k', '', 'Confirm TPM implementation and compliance scope', 'Clarify acceptance criteria with customer', 'Assess feasibility & cost impact', 'Confirm replacement policy (customer vs certified technician)')} AS next_action,
  CASE WHEN type <> 'requirement' THEN 'AUTO_SKIP' WHEN must_level IN ('MUST', 'MAY') OR k IN (1, 2, 4) THEN 'NEED_REVIEW' ELSE 'NEW' END AS status FROM c"""

#: Enriched, cleaned, numbered, split and classified rows.
FORMATTED = f"""{I}, {PRIMARY}, {FLAGS},
b AS (SELECT i.* EXCLUDE (must_level), {rx(T, X.DEFINITION_LINE)} OR {GLOSSARY} AS g, {CATEGORY} AS cat, coalesce(f.status, 'PENDING') AS st, f.force_category AS fc, coalesce(f.messages, CAST([] AS VARCHAR[])) AS messages, coalesce(f.require_evidence, false) AS ev,
  CASE WHEN upper(coalesce(must_level, '')) IN ('MUST', 'SHOULD', 'MAY') THEN upper(must_level) ELSE {TABLE_LEVEL} END AS lv FROM items i LEFT JOIN flagged f USING (pos)),
enriched AS (SELECT * EXCLUDE (g, cat, st, fc, messages, ev, lv), CASE WHEN g THEN 'INFO' ELSE lv END AS must_level, CASE WHEN g THEN 'Glossary' ELSE coalesce(fc, cat) END AS category, CASE WHEN g THEN 'TBD' ELSE {OWNER.format(c='cat')} END AS owner,
  CASE WHEN g THEN 'AUTO_SKIP' ELSE st END AS status, CASE WHEN g THEN [{q(X.GLOSSARY_MESSAGE)}] ELSE messages END AS messages, NOT g AND ev AS ev FROM b),
{SOURCED.format(src='enriched')},
lagged AS (SELECT *, {T} AS t0, coalesce(lag({T}) OVER (PARTITION BY case_id, f, chunk_no ORDER BY pos), '') AS prev FROM sourced),
glue AS (SELECT *, upper(regexp_extract(prev, '^(CRU|FRU)\\s*:\\s*', 1, 'i')) AS x FROM lagged),
glued AS (SELECT * EXCLUDE (t0, prev, x, requirement, notes), CASE WHEN x <> '' AND regexp_matches(t0, '\\bcan be replaced by\\b', 'i') AND NOT regexp_matches(t0, '^(CRU|FRU)\\b', 'i') THEN x || ' ' || t0 ELSE requirement END AS requirement,
  CASE WHEN x <> '' AND regexp_matches(t0, '\\bcan be replaced by\\b', 'i') AND NOT regexp_matches(t0, '^(CRU|FRU)\\b', 'i') THEN trim(notes || ' | SERVICEABILITY_GLUE', ' |') ELSE notes END AS notes FROM glue),
first AS (SELECT * FROM glued QUALIFY {T} = '' OR row_number() OVER (PARTITION BY lower({T}) ORDER BY pos) = 1),
clean AS (SELECT * FROM first WHERE derived OR NOT ((upper(status) <> 'AUTO_SKIP' AND {noise(T, 'notes')}) OR {SHORT} OR {PART})),
ev AS (SELECT *, f IN ('AUTO-spec_1.xlsx', 'AUTO-spec_4.docx') AS ok, regexp_extract_all(requirement || ' ' || notes, '\\[ROW_ID\\s*=\\s*([A-Za-z0-9_\\-]+)\\]', 1) AS marks FROM clean),
v AS (SELECT *, CASE
  WHEN regexp_matches(req_id, '^(HOST|BMC|BIOS|PCIe|STORAGE|PWR)-\\d+$') THEN CASE WHEN ok OR len(list_filter(marks, lambda x: contains(upper(x), split_part(req_id, '-', 1)))) > 0 THEN 'RFQ-' || split_part(req_id, '-', 1) || '-' || printf('%03d', split_part(req_id, '-', 2)::INT) END
  WHEN regexp_matches(req_id, '^ROW_ID=\\d+$') THEN CASE WHEN ok OR len(marks) > 0 THEN 'RFQ-TBL-' || printf('%03d', split_part(req_id, '=', 2)::INT) END
  WHEN regexp_matches(req_id, '^RFQ-[A-Za-z_]+-\\d+$') THEN CASE WHEN ok OR len(list_filter(marks, lambda x: contains(upper(x), split_part(req_id, '-', 2)))) > 0 THEN req_id END
  WHEN regexp_matches(req_id, '^RFQ-\\d+$') THEN CASE WHEN ok THEN req_id END
  WHEN regexp_matches(req_id, '^AI-\\d+$') THEN req_id WHEN regexp_matches(req_id, '^\\d+$') AND ok THEN 'RFQ-' || printf('%03d', req_id::INT) END AS known FROM ev),
ids AS (SELECT *, coalesce(known, 'AI-' || printf('%03d', (count(*) FILTER (WHERE known IS NULL) OVER (PARTITION BY case_id ORDER BY pos ROWS UNBOUNDED PRECEDING))::INT)) AS id, CASE WHEN known IS NULL OR starts_with(known, 'AI-') THEN 'generated' ELSE 'original' END AS id_source FROM v),
listed AS (SELECT *, list_filter(list_transform(string_split(requirement, '|'), lambda x: {strip('x')}), lambda x: x <> '') AS l FROM ids),
parts AS (SELECT * EXCLUDE (requirement, notes, id, req_id, l), len(l) > 1 AS split, k AS part, CASE WHEN len(l) > 1 THEN l[k + 1] ELSE {T} END AS requirement, CASE WHEN len(l) > 1 THEN trim({strip('notes')} || ' | SPLIT_FROM_PIPE', ' |') ELSE notes END AS notes,
  CASE WHEN len(l) > 1 THEN id || '-' || chr(97 + k) ELSE id END AS id, CASE WHEN len(l) > 1 THEN CASE WHEN req_id <> '' THEN req_id ELSE id END || '-' || chr(97 + k) ELSE req_id END AS original_id FROM (SELECT *, unnest(range(greatest(len(l), 1)))::INT AS k FROM listed)),
typed AS (SELECT *, {TYPE} AS kind, {noise(T, 'notes')} AS bad FROM parts),
told AS (SELECT *, CASE WHEN derived THEN 'requirement' WHEN kind NOT IN ('note', 'junk') THEN kind WHEN bad THEN 'junk' WHEN upper(coalesce(must_level, '')) IN ('MUST', 'SHOULD', 'MAY') THEN 'requirement' WHEN status = 'NEED_REVIEW' OR len(messages) > 0 THEN 'requirement' WHEN status = 'AUTO_SKIP' THEN 'glossary' ELSE kind END AS type FROM typed),
orphans AS (SELECT *, NOT derived AND type = 'requirement' AND {rx(T, X.ORPHAN_MARKER, True)} AND NOT {VERB} AND {words(T)} <= 8 AS orphan FROM told),
flagged_raw AS (SELECT *, list_concat(CASE WHEN derived THEN CAST([] AS VARCHAR[]) ELSE messages END, CASE WHEN orphan THEN ['ORPHAN_SUBITEM'] ELSE CAST([] AS VARCHAR[]) END) AS raw, row_number() OVER () AS rid FROM orphans),
tags AS (SELECT rid, string_agg(tag, ',' ORDER BY k) AS risk_tags, coalesce(string_agg({NOTES_OF.format(t='tag')}, '; ' ORDER BY k), '') AS risk_note FROM (SELECT rid, {tag_of('x')} AS tag, min(k) AS k FROM (SELECT rid, unnest(range(len(raw))) AS k, unnest(raw) AS x FROM flagged_raw) GROUP BY ALL) WHERE tag <> '' GROUP BY rid),
named AS (SELECT *, {SHOWN} AS nm, CASE WHEN derived THEN 'INFO' ELSE coalesce(nullif(must_level, ''), {PLAIN_LEVEL.format(t='lower(requirement)')}) END AS lv, CASE WHEN derived THEN coalesce(nullif(spec_category, ''), 'General') ELSE category END AS own FROM flagged_raw LEFT JOIN tags USING (rid)),
formatted AS (SELECT case_id, pos, part, id AS req_id, original_id, id_source, type, lv AS must_level, CASE WHEN own <> 'General' THEN own ELSE {first_of('requirement', X.CATEGORY_CORRECTIONS, 'General')} END AS category, CASE WHEN derived THEN 'TBD' ELSE owner END AS owner,
  CASE WHEN type IN ('glossary', 'note', 'junk') THEN 'AUTO_SKIP' WHEN derived OR orphan THEN 'NEED_REVIEW' WHEN upper(status) IN ('PENDING', 'AUTO_OK', '') THEN 'NEW' ELSE upper(status) END AS status, {T} AS requirement, coalesce(risk_tags, '') AS risk_tags, coalesce(risk_note, '') AS risk_note,
  CASE WHEN ev AND NOT derived THEN 'Provide datasheet/report/certification as applicable' ELSE '' END AS evidence_needed,
  CASE WHEN derived THEN 'Confirm spec against design. Derived from spec table, not explicit requirement' WHEN ev THEN 'Collect evidence and confirm with owner' WHEN orphan THEN 'Verify parent context — read source document' ELSE '' END AS next_action, {PLACE} AS source FROM named)"""
CASE_MERGED = f"""{FORMATTED}, r AS ({RESP}), m AS (SELECT c.* EXCLUDE (status), coalesce(nullif(r.status, ''), c.status) AS status, coalesce(r.exclude_from_matrix, false) AS excluded FROM formatted c LEFT JOIN r USING (case_id, req_id)),
w AS (SELECT *, CASE WHEN excluded THEN 'Excluded' WHEN lower(type) = 'glossary' OR list_contains(string_split(risk_tags, ','), 'GLOSSARY') THEN 'Glossary' WHEN type = 'note' THEN 'Notes' WHEN type = 'junk' OR upper(coalesce(status, '')) = 'AUTO_SKIP' THEN 'Skipped' ELSE 'Main' END AS sheet FROM m)"""


def summarised(merged: str) -> str:
    """The category summary of the main rows of w and its total."""
    owners = "coalesce(array_to_string(list_transform(list_sort(list(DISTINCT lower(trim(owner)) || chr(1) || trim(owner)) FILTER (WHERE trim(owner) <> '')), lambda x: split_part(x, chr(1), 2)), ', '), '')"
    return f"{merged}, s AS (SELECT *, {BUCKET} AS grp, CASE WHEN {first_cat('category')} = '' THEN '(blank)' ELSE {first_cat('category')} END AS small FROM w WHERE sheet = 'Main') SELECT grp AS \"group\", small AS category, {COUNTS}, {owners} AS owners FROM s GROUP BY ALL UNION ALL SELECT 'Total', '', {COUNTS}, '' FROM s"


METRICS = ["total_items", "requirements", "glossary", "notes", "duplicate_ids", "empty_requirement", "empty_category", "empty_owner"]
SIDE = "SELECT count(*) AS total_items, count(*) FILTER (WHERE type = 'requirement') AS requirements, count(*) FILTER (WHERE type = 'glossary') AS glossary, count(*) FILTER (WHERE type IN ('note', 'junk')) AS notes, (SELECT count(*) FROM (SELECT case_id, req_id FROM c WHERE pos % 2 = {k} AND req_id <> '' GROUP BY ALL HAVING count(*) > 1)) AS duplicate_ids, count(*) FILTER (WHERE type = 'requirement' AND trim(requirement) = '') AS empty_requirement, count(*) FILTER (WHERE type = 'requirement' AND trim(category) = '') AS empty_category, count(*) FILTER (WHERE type = 'requirement' AND trim(owner) = '') AS empty_owner FROM c WHERE pos % 2 = {k}"
RUNS = "strftime(o_orderdate::TIMESTAMP + to_seconds({s}), '%Y-%m-%dT%H:%M:%S')"
BEST = r"""{I}, a AS (SELECT pos, lower(requirement) AS t, [{'file': 'a b.xlsx', 'sheet': 'One', 'row': 3, 'x': 'alpha power supply unit'}, {'file': 'a b.xlsx', 'sheet': 'Two', 'row': 9, 'x': 'vibration and shock test'}, {'file': 'a b.xlsx', 'sheet': 'Two', 'row': 10, 'x': lower(trim(notes || 'NVMe storage with RAID'))}] AS l FROM items),
b AS (SELECT pos, l, list_filter(l, lambda r: contains(r.x, t) OR contains(t, r.x)) AS inside, list_transform(l, lambda r: len(list_intersect(list_distinct(string_split_regex(trim(t), '\s+')), list_distinct(string_split_regex(r.x, '\s+'))))) AS n FROM a),
c AS (SELECT pos, CASE WHEN len(inside) > 0 THEN inside[1] ELSE l[list_position(n, list_max(n))] END AS r FROM b) SELECT pos, r.file AS file, r.sheet AS sheet, r.row AS row FROM c""".replace("{I}", I)
CHUNK = "'[TABLE 2 ROW 4][ROW_ID=HOST 36] text [TABLE 3 ROW 7] more [ROW_ID=BIOS-' || (pos % 50) || '] end [PDF PAGE 12] [FILE:x.xlsx SHEET:S ROW 5]'"
MARKED = r"\[TABLE\s+(\d+)\s+ROW\s+(\d+)\][^\[]*\[ROW_ID=([^\]]+)\]"
POSITIONS = rf"""{I}, a AS (SELECT pos, req_id, {CHUNK} AS x, regexp_extract(req_id, '^RFQ-([A-Z]+)-(\d+)$', 1) AS p, regexp_extract(req_id, '^RFQ-([A-Z]+)-0*(\d+)$', 2) AS n FROM items),
b AS (SELECT *, regexp_extract_all(x, '{MARKED}', 1) AS t, regexp_extract_all(x, '{MARKED}', 2) AS r, list_transform(regexp_extract_all(x, '{MARKED}', 3), lambda v: trim(v)) AS i, [p || ' ' || n, p || '-' || n, p || n] AS wanted, list_filter(list_transform(regexp_extract_all(x, '\[ROW_ID=([^\]]+)\]', 1), lambda v: trim(v)), lambda v: regexp_matches(v, '^(HOST|BIOS|BMC|MECH|ENV|SER|AIC|MB|SYS)[\s\-](\d+)$', 'i')) AS usable FROM a),
c AS (SELECT *, list_filter(list_transform(wanted, lambda w: list_filter(range(1, len(i) + 1), lambda k: p <> '' AND (i[k] = w OR replace(i[k], ' ', '-') = w))[1]), lambda k: k IS NOT NULL)[1] AS k FROM b)
SELECT pos, t[coalesce(k, 1)]::INT AS "table", r[coalesce(k, 1)]::INT AS table_row, CASE WHEN starts_with(req_id, 'RFQ-') THEN req_id ELSE 'RFQ-' || upper(split_part(replace(usable[1], '-', ' '), ' ', 1)) || '-' || printf('%03d', split_part(replace(usable[1], '-', ' '), ' ', 2)::INT) END AS matrix_id, 12 AS page, 'S' AS sheet, 5 AS row,
  CASE WHEN req_id = '' THEN 'AUTO-f.docx-3-' || printf('%03d', (pos % 1200)::INT) ELSE req_id END AS repaired FROM c"""

REPORT = f"""WITH c AS ({CLEAN}), l AS ({SIDE.format(k=0)}), r AS ({SIDE.format(k=1)}), m AS (SELECT unnest(range(1, {len(METRICS) + 1}))::INT AS ord, unnest([{', '.join(map(q, METRICS))}]) AS key, unnest([{', '.join('l.' + m for m in METRICS)}]) AS a, unnest([{', '.join('r.' + m for m in METRICS)}]) AS b FROM l, r),
t AS (SELECT case_id, pos % 2 AS side, req_id FROM c WHERE req_id <> '' GROUP BY ALL HAVING count(*) > 1), u AS (SELECT case_id, side, count(*) AS n, array_to_string(list_sort(list(req_id))[:10], ', ') AS ids FROM t GROUP BY ALL),
k AS (SELECT pos, unnest([3, 4, 5])::INT AS section, unnest([coalesce(nullif({first_cat('category')}, ''), '(none)'), coalesce(must_level, '(none)'), coalesce(nullif(status, ''), '(none)')]) AS key FROM c WHERE type = 'requirement'),
d AS (SELECT section, key, count(*) FILTER (WHERE pos % 2 = 0) AS a, count(*) FILTER (WHERE pos % 2 = 1) AS b FROM k GROUP BY ALL)
SELECT 1 AS section, ord, key, concat('| ', key, ' | ', a, ' | ', b, ' |') AS line FROM m
UNION ALL SELECT 2, (side + 1)::INT, case_id, concat('- ', CASE side WHEN 0 THEN 'left' ELSE 'right' END, ', ', case_id, ': ', n, ' (', ids, ')') FROM u
UNION ALL SELECT section, 1, key, concat('| ', key, ' | ', a, ' | ', b, ' |') FROM d
UNION ALL SELECT section, 0, '', CASE section WHEN 2 THEN '## ' || t ELSE concat('## ', t, chr(10), chr(10), '| ', h, ' | left | right |', chr(10), '|---|---|---|') END FROM (VALUES (1, 'Counts', 'metric'), (2, 'Ids that occur twice', ''), (3, 'Categories', 'key'), (4, 'Levels', 'key'), (5, 'Status', 'key')) AS v(section, t, h)"""
BLOCKS = "WITH b AS (SELECT *, string_split(t, ' ') AS c FROM (SELECT doc_id, doc_id % 4 AS m, doc_id || ['.docx', '.doc', '.xlsx', '.pdf'][doc_id % 4 + 1] AS file, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents))"


ORACLE_SQL: dict[str, str] = {
    "summary_matrix": summarised(f"WITH {MERGED}"),
    "response_merge": f"WITH {MERGED} SELECT case_id, pos, req_id, status, vendor_comment, gap, final_requirement, excluded FROM w",
    "progress_counts": f"WITH c AS ({CLEAN}), r AS ({RESP}), a AS (SELECT c.case_id, CASE WHEN r.status IN ('COMPLIANT', 'PARTIAL', 'NON-COMPLIANT') THEN r.status WHEN upper(coalesce(nullif(c.status, ''), 'NEW')) IN ({STATUSES}) THEN upper(coalesce(nullif(c.status, ''), 'NEW')) ELSE 'NEW' END AS s FROM c LEFT JOIN r USING (case_id, req_id) WHERE upper(coalesce(c.status, '')) <> 'AUTO_SKIP') SELECT case_id, {PROGRESS}, count(*) AS total FROM a GROUP BY case_id",
    "review_counts": f"WITH c AS ({CLEAN}), r AS ({RESP}), a AS (SELECT c.case_id, CASE WHEN coalesce(nullif(r.status, ''), c.status, 'NEW') IN ({STATUSES}) THEN coalesce(nullif(r.status, ''), c.status, 'NEW') ELSE 'NEW' END AS s FROM c LEFT JOIN r USING (case_id, req_id) WHERE coalesce(c.status, '') <> 'AUTO_SKIP') SELECT case_id, {PROGRESS}, count(*) AS total FROM a GROUP BY case_id",
    "sheet_routing": f"WITH {MERGED} SELECT case_id, pos, sheet FROM w",
    "bucket_counts": f"WITH c AS ({CLEAN}), n AS (SELECT {BUCKET} AS bucket, count(*) AS n FROM c GROUP BY 1), b AS (SELECT * FROM (VALUES {', '.join(f'({q(n)}, {i})' for i, (n, _) in enumerate(X.BUCKETS))}) AS v(bucket, rank)) SELECT bucket, rank, coalesce(n, 0) AS n FROM b LEFT JOIN n USING (bucket)",
    "pm_sort_topk": f"WITH c AS ({CLEAN}) SELECT case_id, pos, status, must_level, category FROM c ORDER BY {ORDER}, {ranked(first_cat('category'), X.CATEGORY_RANK, 50)}, case_id, pos LIMIT 200",
    "pm_sort_full_category": f"WITH c AS ({CLEAN}) SELECT case_id, pos, category FROM c ORDER BY {ORDER}, {ranked('category', X.CATEGORY_RANK, 50)}, case_id, pos LIMIT 200",
    "pm_sort": f"WITH c AS ({CLEAN}) SELECT row_number() OVER (ORDER BY {ORDER}, {ranked(first_cat('category'), X.CATEGORY_RANK, 50)}, case_id, pos) AS rank, case_id, pos, status, must_level, category FROM c",
    "pm_sort_category": f"WITH c AS ({CLEAN}) SELECT row_number() OVER (ORDER BY {ORDER}, {ranked('category', X.CATEGORY_RANK, 50)}, case_id, pos) AS rank, case_id, pos, category FROM c",
    "matrix_projection": f"WITH {MERGED} SELECT case_id, pos, CASE WHEN trim(coalesce(final_requirement, '')) <> '' THEN trim(final_requirement) WHEN trim(normalized_requirement) <> '' THEN trim(normalized_requirement) ELSE requirement END AS final_requirement, array_to_string(risk_tags, ', ') AS risk, CASE WHEN rewrite_reason <> '' THEN printf('%.2f', rewrite_confidence) ELSE '' END AS confidence, CASE WHEN needs_rewrite_review THEN 'REVIEW' ELSE '' END AS review, coalesce(gap, '') AS gap FROM w",
    "export_sheets": f"WITH {MERGED}, s AS (SELECT case_id, unnest(CASE WHEN sheet = 'Main' THEN ['Compliance Matrix', CASE {BUCKET} {' '.join(f'WHEN {q(n)} THEN {q(f"{i}. {n}")}' for i, (n, _) in enumerate(X.BUCKETS, 3))} END] ELSE [sheet] END) AS sheet FROM w) SELECT case_id, sheet, count(*) AS n FROM s GROUP BY ALL",
    "review_filter": f"WITH c AS ({CLEAN}), r AS ({RESP}) SELECT c.case_id, c.pos, c.req_id FROM c LEFT JOIN r USING (case_id, req_id) WHERE coalesce(c.status, '') <> 'AUTO_SKIP' AND coalesce(nullif(r.status, ''), c.status, 'NEW') = 'PARTIAL' AND owner = 'QA'",
    "compare_runs": f"WITH c AS ({CLEAN}), l AS ({SIDE.format(k=0)}), r AS ({SIDE.format(k=1)}) SELECT unnest([{', '.join(map(q, METRICS))}]) AS metric, unnest([{', '.join('l.' + m for m in METRICS)}]) AS \"left\", unnest([{', '.join('r.' + m for m in METRICS)}]) AS \"right\" FROM l, r",
    "compare_report": REPORT,
    "head_samples": f"{BLOCKS}, s AS (SELECT file, ord, CASE m WHEN 0 THEN CASE WHEN ord < 40 THEN t END WHEN 3 THEN CASE WHEN ord < 5 THEN 'Page ' || (ord + 1) || ': ' || left(t, 500) END WHEN 1 THEN CASE WHEN ord >= 50 THEN NULL WHEN ord % 5 < 2 THEN 'Table ' || (ord // 5 + 1) || ' row ' || (ord % 5 + 1) || ': ' || array_to_string(list_filter(c, lambda x: x <> ''), ' | ') WHEN ord % 5 < 4 AND c[1] <> '' THEN 'Table ' || (ord // 5 + 1) || ' id: ' || c[1] END ELSE CASE WHEN ord < 24 AND ord % 6 < 4 THEN 'Sheet S' || (ord // 6) || ' row ' || (ord % 6 + 1) || ': ' || array_to_string(list_filter(c, lambda x: x <> '')[:8], ' | ') END END AS line FROM b) SELECT '/in/' || file AS path, 'File: ' || file || chr(10) || string_agg(line, chr(10) ORDER BY ord) AS sample FROM s GROUP BY file",
    "sheet_samples": f"{BLOCKS} SELECT '/in/' || file AS path, 'S' || (ord // 6) AS sheet, string_agg('Row ' || (ord % 6 + 1) || ': ' || array_to_string(c, ' | '), chr(10) ORDER BY ord) AS sample FROM b WHERE m = 2 GROUP BY 1, 2",
    "case_schemas": f"{BLOCKS}, f AS (SELECT DISTINCT doc_id // 10 AS case_id, file, m FROM b) SELECT case_id, CASE WHEN count(*) FILTER (WHERE m = 2) > 0 THEN 'matrix' ELSE 'unknown' END AS rfq_format, 'B' AS requirement_col, coalesce(string_agg(file, ',' ORDER BY file) FILTER (WHERE m = 2), '') AS main_files, (count(*) FILTER (WHERE m = 3))::INT AS n_appendix FROM f GROUP BY case_id",
    "plain_triage": PLAIN,
    "source_ref": f"{I}, {PRIMARY}, {SOURCED.format(src='items')}, z AS (SELECT *, {SHOWN} AS nm FROM sourced) SELECT pos, f AS file, {PLACE} AS source FROM z",
    "text_clean": f"{I}, a AS (SELECT pos, requirement, {strip(f"regexp_replace(' Falls under RF_CERT  per redflag: ' || requirement || '  ., ', {q(X.PROMPT_TRACES)}, '', 'gi')")} AS c FROM items) SELECT pos, trim(regexp_replace(c, '\\s{{2,}}', ' ', 'g'), ' .,;') AS cleaned, CASE WHEN length(requirement) > 30 THEN left(requirement, 30) || ' ...' ELSE requirement END AS excerpt, left({strip(f"""regexp_replace(regexp_replace({strip("'a/b:  ' || requirement")}, '[\\\\/:*?"<>|]+', '_', 'g'), '\\s+', ' ', 'g')""")}, 80) AS safe_key, {strip("split_part(requirement || ' , x', ',', 1)")} AS first, regexp_replace(left('é中' || requirement, 20), '[^\\x00-\\x7F]', '?', 'g') AS preview FROM items JOIN a USING (pos, requirement)",
    "paragraph_chunks": pieces(paragraphs("replace(text, chr(10), chr(10) || chr(10))", 600)),
    "greedy_pack": pieces(blocks_packed("list_filter(string_split(text, chr(10)), lambda x: x <> '')", 1200, 4)),
    "best_row_match": BEST,
    "chunk_positions": POSITIONS,
    "formatted_items": f"{FORMATTED} SELECT * FROM formatted",
    "case_to_matrix": summarised(CASE_MERGED),
    "file_roles": f"WITH a AS (SELECT name, CASE WHEN name = 'Supplier#000000004.docx' OR name = 'Supplier#3.zip' THEN CASE name WHEN 'Supplier#3.zip' THEN 'main_requirement' ELSE 'appendix' END END AS own, starts_with(name, left('Supplier#000000005.xl', 20)) OR starts_with(name, left('Supplier#00000007', 20)) AS app, starts_with(name, left('Supplier#00000008', 20)) AS main FROM ({FILES})) SELECT name, coalesce(own, CASE WHEN app THEN 'appendix' WHEN main THEN 'main_requirement' ELSE '?' END) AS role, CASE WHEN own IS NOT NULL THEN CASE name WHEN 'Supplier#3.zip' THEN '87%' ELSE '—' END WHEN app OR main THEN '50%' ELSE '—' END AS confidence FROM a",
    "lock_staleness": "SELECT event_id, event_id % 9 = 0 OR date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-01-15 00:00:00') > 7200 AS stale FROM events",
    "run_history": f"WITH a AS (SELECT o_orderkey AS k, '/runs/' || o_orderkey AS run_dir, {RUNS.format(s='o_custkey % 86400')} AS started_at, CASE WHEN o_orderkey % 4 > 0 THEN {RUNS.format(s='o_custkey % 86400 + o_orderkey % 9000')} ELSE '' END AS ended_at, (o_orderkey % 9000)::BIGINT AS s FROM orders) SELECT run_dir, started_at, ended_at, CASE WHEN ended_at = '' THEN '-' WHEN s >= 3600 THEN (s // 3600) || 'h' || (s % 3600 // 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm' || (s % 60) || 's' ELSE s || 's' END AS duration, CASE WHEN k % 2 = 0 THEN '1/4' ELSE '0/4' END AS outputs FROM a ORDER BY coalesce(nullif(ended_at, ''), started_at) DESC, run_dir LIMIT 20",
    "runtime_estimate": f"WITH a AS (SELECT source AS case_id, length(coalesce(text, '')) AS chars, len({paragraphs('text', 600)}) AS chunks FROM documents), b AS (SELECT case_id, count(*) AS file_count, sum(chars)::BIGINT AS total_chars, sum(chunks)::BIGINT AS chunks, sum(chunks) * 0.6::DOUBLE AS s FROM a GROUP BY case_id), n AS (SELECT *, {HALF} AS n FROM b) SELECT case_id, file_count, total_chars, chunks, s AS est_runtime_sec, CASE WHEN n >= 3600 THEN (n // 3600) || 'h ' || (n % 3600 // 60) || 'm' WHEN n >= 60 THEN (n // 60) || 'm ' || (n % 60) || 's' ELSE n || 's' END AS est_runtime_human, CASE WHEN s >= 14400 THEN 'high' WHEN s >= 3600 THEN 'warning' ELSE 'ok' END AS risk FROM n",
    "review_rows": f"WITH c AS ({CLEAN}) SELECT req_id AS id, {first_cat('category')} AS category, requirement, coalesce(must_level, '') AS must_level, owner FROM c",
    "source_priority": f"WITH c AS ({CLEAN}) SELECT case_id, pos, req_id, CASE case_id WHEN 'case0' THEN 'reviewed' WHEN 'case1' THEN 'clean' ELSE 'raw' END AS src FROM c WHERE case_id <> 'case0' OR pos % 4 = 0",
    "reviewed_load": f"WITH c AS ({CLEAN}) SELECT case_id, pos, req_id, requirement, category, must_level, owner FROM c WHERE pos % 6 <> 0",
    "run_stats": f"WITH c AS ({CLEAN}), d AS (SELECT case_id, count(*) AS duplicate_ids, min(req_id) AS first_duplicate FROM (SELECT case_id, req_id FROM c GROUP BY ALL HAVING count(*) > 1) GROUP BY case_id) SELECT case_id, count(*) AS total_items, count(*) FILTER (WHERE type = 'requirement') AS requirements, count(*) FILTER (WHERE type = 'glossary') AS glossary, count(*) FILTER (WHERE type IN ('note', 'junk')) AS notes, count(*) FILTER (WHERE type = 'requirement' AND trim(requirement) = '') AS empty_requirement, count(*) FILTER (WHERE type = 'requirement' AND trim(category) = '') AS empty_category, count(*) FILTER (WHERE type = 'requirement' AND trim(owner) = '') AS empty_owner, count(*) FILTER (WHERE type = 'requirement' AND must_level IS NULL) AS missing_must_level, coalesce(any_value(d.duplicate_ids), 0) AS duplicate_ids, coalesce(any_value(d.first_duplicate), '') AS first_duplicate FROM c LEFT JOIN d USING (case_id) GROUP BY case_id",
    "duplicate_ids": f"WITH c AS ({CLEAN}), d AS (SELECT case_id, req_id FROM c WHERE req_id <> '' GROUP BY ALL HAVING count(*) > 1) SELECT case_id, count(*) AS n, array_to_string(list(req_id ORDER BY req_id)[:10], ',') AS first_ids FROM d GROUP BY case_id",
    "normalization_state": f"WITH c AS ({CLEAN}) SELECT case_id, count(*) AS items, count(*) FILTER (WHERE trim(normalized_requirement) <> '') AS rewritten, count(*) FILTER (WHERE needs_rewrite_review) AS to_review, count(*) FILTER (WHERE type = 'requirement') AS eligible, count(*) FILTER (WHERE type = 'requirement' AND (trim(rewrite_reason) NOT IN ('', 'not_attempted') OR trim(normalized_requirement) <> '')) AS done, eligible - done AS \"left\" FROM c GROUP BY case_id",
    "rewrite_reasons": f"WITH c AS ({CLEAN}) SELECT case_id, trim(rewrite_reason) AS reason, count(*) AS n FROM c WHERE trim(rewrite_reason) <> '' GROUP BY ALL",
    "least_confidence": f"SELECT case_id, min(CASE WHEN ord % 50 > 0 THEN 0.5::DOUBLE + ord / 1000 ELSE 0.0 END) AS confidence FROM ({FILES}) GROUP BY case_id",
    "first_changed": CACHE + " SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS nth, req_id, pos, changed_fields FROM d WHERE reason = 'changed' QUALIFY nth <= 5",
    "dist_compare": f"WITH c AS (SELECT pos, CASE WHEN {first_cat('category')} = '' THEN '(none)' ELSE {first_cat('category')} END AS key, category FROM ({CLEAN}) WHERE type = 'requirement') SELECT key, count(*) FILTER (WHERE pos % 2 = 0) AS left_n, count(*) FILTER (WHERE pos % 3 = 0 AND category <> 'Thermal') AS right_n FROM c GROUP BY key HAVING left_n + right_n > 0",
    "distinct_domains": f"WITH c AS ({CLEAN}) SELECT 'category' AS domain, category AS value FROM c UNION SELECT 'owner', owner FROM c",
    "norm_stats": f"WITH c AS ({CLEAN}) SELECT coalesce(nullif(trim(rewrite_reason), ''), 'not_attempted') AS reason, count(*) AS n, count(*) FILTER (WHERE needs_rewrite_review) AS to_review, count(*) FILTER (WHERE rewrite_confidence > 0 AND rewrite_confidence < 0.6) AS low_confidence FROM c WHERE type = 'requirement' GROUP BY 1",
    "stage_counts": f"WITH c AS ({CLEAN}) SELECT case_id, count(*) FILTER (WHERE type = 'requirement') AS requirements, count(*) FILTER (WHERE type = 'glossary') AS glossary, count(*) FILTER (WHERE type IN ('note', 'junk')) AS notes, count(*) FILTER (WHERE type IN ('requirement', 'glossary')) = 0 AS empty FROM c GROUP BY case_id",
    "normalize_selection": f"WITH c AS ({CLEAN}) SELECT case_id, pos, trim(rewrite_reason) NOT IN ('', 'not_attempted') OR trim(normalized_requirement) <> '' AS skipped FROM c WHERE type = 'requirement' ORDER BY case_id, pos LIMIT 50",
    "normalize_selection_by_case": f"WITH c AS ({CLEAN}) SELECT case_id, pos, trim(rewrite_reason) NOT IN ('', 'not_attempted') OR trim(normalized_requirement) <> '' AS skipped FROM c WHERE type = 'requirement' QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY pos) <= 50",
    "must_level": f"{I} SELECT pos, {LEVEL} AS detected, {TABLE_LEVEL} AS must_level FROM items",
    "category_first_match": f"{I} SELECT pos, {CATEGORY} AS category FROM items",
    "owner_lookup": f"{I}, c AS (SELECT *, {CATEGORY} AS cat FROM items) SELECT pos, {BY_CATEGORY.format(c='cat')} AS by_category, {OWNER.format(c='cat')} AS owner FROM c",
    "redflag_all_match": f"{I}, {FLAGS} SELECT i.pos, coalesce(array_to_string(messages, '~'), '') AS messages, coalesce(status, 'AUTO_OK') AS status, force_category, require_evidence, forbid_llm_numbers FROM items i LEFT JOIN flagged USING (pos)",
    "spec_category": f"{I} SELECT pos, {first_of('requirement', X.SPEC_CATEGORIES, 'General')} AS spec_category FROM items",
    "category_correction": f"{I} SELECT pos, CASE WHEN pos % 3 = 0 THEN 'BIOS' ELSE {first_of('requirement', X.CATEGORY_CORRECTIONS, 'General')} END AS category FROM items",
    "risk_tags": f"{I}, {FLAGS}, raw AS (SELECT i.pos, list_concat(coalesce(messages, CAST([] AS VARCHAR[])), [requirement], CASE WHEN i.pos % 2 = 0 THEN ['RF_IP', 'own tag'] ELSE CAST([] AS VARCHAR[]) END) AS l FROM items i LEFT JOIN flagged USING (pos)), u AS (SELECT pos, unnest(range(len(l))) AS k, unnest(l) AS x FROM raw), t AS (SELECT pos, {tag_of('x')} AS tag, min(k) AS k FROM u GROUP BY ALL) SELECT pos, string_agg(tag, '~' ORDER BY k) AS tags, coalesce(string_agg({NOTES_OF.format(t='tag')}, '; ' ORDER BY k), '') AS note FROM t WHERE tag <> '' GROUP BY pos",
    "big_category": f"WITH c AS ({CLEAN}) SELECT pos, {BUCKET} AS bucket FROM c",
    "priority_map": "SELECT o_orderkey AS pos, CASE split_part(o_orderpriority, '-', 2) WHEN 'HIGH' THEN 'MUST' WHEN 'MEDIUM' THEN 'SHOULD' WHEN 'LOW' THEN 'MAY' ELSE 'INFO' END AS must_level FROM orders",
    "enriched_items": ENRICHED,
    "item_predicates": f"{I} SELECT pos, {GLOSSARY} OR {rx(T, X.DEFINITION_LINE)} AS definition, {TYPE} AS type, {noise(T, 'notes')} AS noise, {SHORT} AS short, {PART} AS part_number, {rx('req_id', X.TABLE_ID, True)} OR regexp_matches(req_id, '^ROW_ID=\\d+$') AS table_id, length({T}) >= 8 AND ({rx(T, X.MOCK_KEYWORD, True)} OR ({rx(T, X.LIST_LINE)} AND len(regexp_extract_all({T}, '\\S+')) >= 4)) AS candidate, NOT derived AND {rx(T, X.ORPHAN_MARKER, True)} AND NOT {VERB} AND {words(T)} <= 8 AS orphan FROM items",
    "junk_attribution": f"{I}, r AS (SELECT CASE WHEN derived THEN 'kept' WHEN {noise(T, 'notes')} THEN 'noise' WHEN {SHORT} THEN 'short' WHEN {PART} THEN 'part_number' ELSE 'kept' END AS reason FROM items) SELECT reason, count(*) AS n FROM r GROUP BY reason",
    "line_noise": f"WITH l AS (SELECT {strip('text')} AS requirement FROM ({LINES})) SELECT {noise('requirement')} AS noise, {SHORT} AS short, {PART} AS part_number, count(*) AS n, sum({words('requirement')})::BIGINT AS words FROM l GROUP BY ALL",
    "promoted_types": f"{I}, k AS (SELECT *, {TYPE} AS kind, {noise(T, 'notes')} AS bad FROM items) SELECT pos, CASE WHEN derived THEN 'requirement' WHEN kind NOT IN ('note', 'junk') THEN kind WHEN bad THEN 'junk' WHEN upper(coalesce(must_level, '')) IN ('MUST', 'SHOULD', 'MAY') THEN 'requirement' WHEN pos % 5 = 0 OR pos % 7 = 0 THEN 'requirement' WHEN pos % 5 = 1 THEN 'glossary' ELSE kind END AS type FROM k",
    "row_id_detect": "SELECT o_orderkey AS pos, ['HOST-36', 'BIOS-4', 'REQ-123', 'SR-4.3.21', 'R-1.2.3', 'SEC-07', 'ITEM-12', ''][(o_orderkey % 8 + 1)::INT] AS row_id FROM orders",
    "duration_format": f"WITH a AS (SELECT o_orderkey AS pos, (o_custkey % 20000) / 2.0 AS s FROM orders), b AS (SELECT *, {HALF} AS n FROM a) SELECT pos, CASE WHEN n >= 3600 THEN (n // 3600) || 'h ' || (n % 3600 // 60) || 'm' WHEN n >= 60 THEN (n // 60) || 'm ' || (n % 60) || 's' ELSE n || 's' END AS long, CASE WHEN n < 60 THEN n || 's' ELSE (n // 60) || 'm ' || (n % 60) || 's' END AS short, CASE WHEN s >= 14400 THEN 'high' WHEN s >= 3600 THEN 'warning' ELSE 'ok' END AS risk, s * CASE pos % 3 WHEN 0 THEN 0.6 WHEN 1 THEN 20.0 ELSE 5.0 END AS cost FROM b",
    "content_hash": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, sha256('file_hash=' || sha256(coalesce(text, '')) || '|requirement_text_hash=' || coalesce(nullif(lang, ''), '-') || '|parser_version=1.0.0|prompt_version=1.0.0|model_name=' || coalesce(source, '') || '|extraction_config={}') AS signature FROM documents",
    "token_audit": f"{I}, a AS (SELECT pos, [requirement, '2.5 kg 60 Hz TPM 2.0 ' || req_id || ' ' || notes] AS t FROM items), g AS (SELECT pos, list_transform(t, lambda x: list_distinct(list_transform(list_concat({', '.join(f'regexp_extract_all(x, {q(p)}, 0{", " + q("i") if i else ""})' for p, i in zip(X.TOKENS, X.TOKENS_IGNORE_CASE, strict=True))}), lambda y: lower(regexp_replace(y, '\\s+', '', 'g'))))) AS s FROM a) SELECT pos, array_to_string(list_sort(list_filter(s[1], lambda y: NOT list_contains(s[2], y))), '~') AS new_tokens FROM g",
    "dedup_text": f"{I} SELECT min(pos) AS pos FROM items GROUP BY lower({T})",
    "dedup_lines": f"WITH l AS ({LINES}), n AS (SELECT *, {strip('text')} AS t, row_number() OVER (PARTITION BY lower({strip('text')}) ORDER BY doc_id, line) AS k FROM l) SELECT doc_id, line FROM n WHERE t = '' OR k = 1",
    "dedup_place": f"{I} SELECT min(pos) AS pos FROM items GROUP BY pos % 2 = 0, file, chunk::INT, {T}",
    "mock_extract": f"{I}, c AS (SELECT pos, {T} AS t FROM items WHERE length('- ' || {T}) >= 8 AND ({rx(T, X.MOCK_KEYWORD, True)} OR len(regexp_extract_all('- ' || {T}, '\\S+')) >= 4)), f AS (SELECT min(pos) AS pos, arg_min(t, pos) AS requirement FROM c GROUP BY lower(t)) SELECT 'MOCK-' || printf('%03d', (row_number() OVER (ORDER BY pos))::INT) AS req_id, requirement, pos AS line_no FROM f",
    "glue_lag": f"{I}, l AS (SELECT case_id, pos, requirement, notes, {T} AS t, coalesce(lag({T}) OVER (PARTITION BY case_id, pos // 64 ORDER BY pos), '') AS p FROM items), g AS (SELECT *, upper(regexp_extract(p, '^(CRU|FRU)\\s*:\\s*', 1, 'i')) AS x FROM l) SELECT pos, CASE WHEN x <> '' AND regexp_matches(t, '\\bcan be replaced by\\b', 'i') THEN x || ' ' || t ELSE requirement END AS requirement, CASE WHEN x <> '' AND regexp_matches(t, '\\bcan be replaced by\\b', 'i') THEN trim(notes || ' | SERVICEABILITY_GLUE', ' |') ELSE notes END AS notes FROM g",
    "ai_ids": IDS,
    "pipe_explode": f"{I}, p AS (SELECT pos, notes, list_filter(list_transform(string_split(requirement, '|'), lambda x: {strip('x')}), lambda x: x <> '') AS l FROM items) SELECT pos, k AS part, l[k + 1] AS requirement, CASE WHEN len(l) > 1 THEN trim(trim(notes) || ' | SPLIT_FROM_PIPE', ' |') ELSE notes END AS notes, chr(97 + k) AS suffix FROM (SELECT *, unnest(range(len(l)))::INT AS k FROM p)",
    "failure_gate": "WITH a AS (SELECT concat('case', o_custkey % 40) AS case_id, o_orderkey AS pos, o_orderkey % 11 = 0 AS failed FROM orders), b AS (SELECT *, (count(*) FILTER (WHERE failed) OVER w)::BIGINT AS failed_so_far, count(*) OVER w AS attempted_so_far FROM a WINDOW w AS (PARTITION BY case_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) SELECT *, failed AND (failed_so_far > 20 OR (attempted_so_far >= 10 AND 100.0 * failed_so_far / attempted_so_far > 10)) AS abort FROM b",
    "latest_status": "SELECT user_id AS job, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
    "modal_file": f"{I}, n AS (SELECT case_id, file, count(*) AS n, min(pos) AS first FROM items WHERE file <> '<file>' GROUP BY ALL) SELECT case_id, file AS primary_file FROM n QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY file LIKE '%.docx' DESC, n DESC, first) = 1",
    "chunk_estimate": f"SELECT case_id, sum(top)::BIGINT AS chunks FROM (SELECT case_id, file, max(chunk) AS top FROM ({LOG}) WHERE chunk > 0 GROUP BY ALL) GROUP BY case_id",
    "resume_anti_join": f"SELECT DISTINCT concat('f', o_orderkey % 13) AS file, (o_custkey % 80)::INT AS chunk FROM orders WHERE (concat('f', o_orderkey % 13), (o_custkey % 80)::INT) NOT IN (SELECT (file, chunk) FROM ({LOG}) WHERE case_id = 'case0' AND NOT failed_chunk)",
    "selection_counts": f"SELECT f.case_id, count(*) AS total, count(*) FILTER (WHERE include IS DISTINCT FROM false) AS included, count(*) FILTER (WHERE include = false) AS excluded, count(*) FILTER (WHERE f.name LIKE '%.zip') AS unsupported FROM ({FILES}) f LEFT JOIN ({SELECTION}) s USING (case_id, name) GROUP BY f.case_id",
    "excluded_files": f"SELECT case_id, name, size FROM ({FILES}) WHERE (case_id, name) NOT IN (SELECT (case_id, name) FROM ({SELECTION}) WHERE include = false)",
    "response_upsert": "SELECT o_custkey % 500 AS req_id, arg_max(o_orderstatus, o_orderkey) FILTER (WHERE o_orderkey % 3 = 0) AS status, arg_max(o_orderpriority, o_orderkey) FILTER (WHERE o_orderkey % 4 = 0) AS comment, max(o_orderkey) AS seq FROM orders GROUP BY 1",
    "cache_diff": CACHE + " SELECT case_id, req_id, pos, reason = 'unchanged' AS skip, reason, changed_fields FROM d",
    "cache_summary": SUMMARY + " SELECT * FROM z",
    "cache_metrics": SUMMARY + " SELECT case_id, unnest(['Total requirements', 'Reused from cache', 'Reprocessed', 'Skipped unchanged', 'Est. runtime saved']) AS label, unnest([total::VARCHAR, reused::VARCHAR, reprocessed::VARCHAR, skipped_files::VARCHAR, saved]) AS value FROM z",
    "model_answers": "SELECT o_orderkey AS pos, 1 AS k, concat('R', o_orderkey) AS req_id, 'must' AS requirement, 0.5::DOUBLE AS confidence FROM orders WHERE o_orderkey % 5 < 4",
    "progress_state": STATE,
    "progress_stream": STATE,
    "confidence_guard": "WITH a AS (SELECT o_orderkey AS pos, least(greatest(o_custkey / 300.0 - 1, 0.0), CASE WHEN o_orderkey % 2 = 0 THEN 0.5 ELSE 1.0 END) AS c FROM orders) SELECT pos, round_even(c, 2) AS confidence FROM a",
    "field_guide": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {q(n)}, {q(t)}, {q(e)}, {q(o)}, {q(X.GUIDE_NOTES['internal' if o == 'Yes' else 'editable' if e == 'Yes' else 'fixed'])})" for i, (n, t, e, o) in enumerate(X.GUIDE)) + ") AS v(ord, column_name, explanation, editable, internal_only, note)",
    "answer_errors": "SELECT o_orderkey AS pos, CASE o_orderkey % 6 WHEN 5 THEN 'call' WHEN 3 THEN 'shape' ELSE 'answer' END AS kind, CASE o_orderkey % 6 WHEN 5 THEN 'TimeoutError: busy' WHEN 3 THEN 'no list of requirements' ELSE 'no JSON in the answer' END AS error, CASE o_orderkey % 6 WHEN 2 THEN 'no answer to ' || o_orderkey WHEN 3 THEN '{\"note\": 1}' WHEN 4 THEN '' END AS excerpt FROM orders WHERE o_orderkey % 6 > 1",
    "answer_requirements": "SELECT o_orderkey AS pos, 1 AS k, concat('R', o_orderkey) AS req_id, 'must' AS requirement, '' AS notes, 0.5::DOUBLE AS confidence FROM orders WHERE o_orderkey % 6 < 2",
    "log_lines_apart": "WITH e AS (SELECT user_id, event_id, event_id % 7 AS k, CASE event_id % 7 WHEN 1 THEN '{\"chunk\": ' || event_id WHEN 3 THEN '{\"chunk\": \"x\"}' END AS bad FROM events WHERE event_id % 7 <> 2) SELECT user_id, count(*) FILTER (WHERE bad IS NULL) AS good, sum(event_id) FILTER (WHERE bad IS NULL)::BIGINT AS chunks, count(bad) AS bad, max(bad) AS last_bad FROM e GROUP BY user_id",
    "cached_answers": "WITH n AS (SELECT count(*) AS n, count(DISTINCT o_custkey % 300) AS d, count(DISTINCT CASE WHEN o_custkey % 300 < 7 THEN o_custkey % 300 END) AS c FROM orders) SELECT run, CASE run[1] WHEN '1' THEN d WHEN '2' THEN 0 WHEN '3' THEN c ELSE d END AS asked, n AS rows_answered, n AS rows_right FROM n, (VALUES ('1 first'), ('2 same'), ('3 changed'), ('4 other model')) AS r(run)",
    "progress_live": f"WITH s AS ({STATE}), t AS (SELECT concat('run', user_id % 20) AS run, min(date_trunc('second', ts)) AS started, max(date_trunc('second', ts)) AS latest FROM events GROUP BY 1), u AS (SELECT *, date_diff('second', started, latest) AS elapsed_s, CASE WHEN coalesce(chunk_total, 0) > 0 THEN chunk_done ELSE item_done END AS d, CASE WHEN coalesce(chunk_total, 0) > 0 THEN chunk_total ELSE item_total END AS n FROM s JOIN t USING (run)) SELECT * EXCLUDE (d, n), CASE WHEN d >= 2 AND n > 0 AND d < n THEN floor(elapsed_s * (n - d) / d)::BIGINT END AS eta_s FROM u",
    "lock_periods": "WITH e AS (SELECT concat('case', user_id % 40) AS case_id, date_trunc('second', ts) AS ts FROM events), f AS (SELECT *, (ts - lag(ts) OVER w <= INTERVAL 2 HOUR) IS NOT TRUE AS new FROM e WINDOW w AS (PARTITION BY case_id ORDER BY ts)), g AS (SELECT *, sum(new::INT) OVER (PARTITION BY case_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT case_id, min(ts) AS acquired, max(ts) + INTERVAL 2 HOUR AS expires, count(*) AS renewals FROM g GROUP BY case_id, k",
    "error_windows": "SELECT concat('case', user_id % 5) AS case_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS start, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'view') AS retries FROM events WHERE event_type IN ('error', 'view') GROUP BY 1, 2",
    "resume_stream": "SELECT DISTINCT concat('f', o_orderkey % 13) AS file, (o_custkey % 80)::INT AS chunk, concat('f', o_orderkey % 13, '-', o_custkey % 80) AS done FROM orders",
    "best_row_join": "WITH d AS (SELECT source, doc_id, string_split(text, chr(10)) AS l FROM documents), r AS (SELECT source, doc_id, k - 1 AS line, lower(l[k]) AS x, list_distinct(list_filter(string_split_regex(lower(l[k]), '\\s+'), lambda w: w <> '')) AS y FROM d, range(1, 100000) AS n(k) WHERE k <= len(l)), i AS (SELECT source, doc_id AS pos, lower(CASE length(l[1]) % 3 WHEN 0 THEN l[1] WHEN 1 THEN substr(l[1], 5, 40) ELSE 'Added ' || l[1] || ' added words' END) AS t FROM d), j AS (SELECT *, list_distinct(list_filter(string_split_regex(t, '\\s+'), lambda w: w <> '')) AS u FROM i), m AS (SELECT pos, doc_id, line, contains(x, t) OR contains(t, x) AS inside, CASE WHEN contains(x, t) OR contains(t, x) THEN 0 ELSE len(list_intersect(u, y)) END AS n FROM j JOIN r USING (source)) SELECT pos, doc_id AS sheet, line::INT AS row FROM m QUALIFY row_number() OVER (PARTITION BY pos ORDER BY inside DESC, n DESC, doc_id, line) = 1",
    "enriched_rows": f"{I} SELECT pos, must_level IS NOT NULL OR pos % 7 = 0 OR pos % 11 = 0 AS enriched FROM items",
    "model_overrides": f"{I} SELECT pos, pos % 4 < 2 AS llm_enriched, CASE pos % 4 WHEN 0 THEN 'SHOULD' END AS must_level, CASE pos % 4 WHEN 1 THEN 'BIOS' END AS category, CASE pos % 4 WHEN 0 THEN 'keys' WHEN 1 THEN '' END AS messages, CASE pos % 4 WHEN 0 THEN 'PM,QA' WHEN 1 THEN 'PM' ELSE '' END AS stakeholder, CASE pos % 4 WHEN 0 THEN true END AS require_evidence FROM items",
}
