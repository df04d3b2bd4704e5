"""Scalar functions: ids, names, positions, tokens, formats, JSON, hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from .text import UI, U, group, matches, strip


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1)


def display_name(name: Column) -> Column:
    """A file's name as it is shown: no extension, no AUTO mark, unknown ones empty, 40 characters at most."""
    s = F.regexp_replace(file_name(name), "(?i)" + X.FILE_EXTENSION, "")
    s = strip(F.regexp_replace(s, r"(?i)^AUTO[-_]?", ""))
    return F.left(strip(F.regexp_replace(s, r"(?i)^(UNKNOWN|UnknownFile)$", "")), F.lit(40))


def source_ref(name: Column, sheet: Column, row: Column, table: Column, table_row: Column, page: Column, chunk: Column) -> Column:
    """Where a requirement is from: sheet and row before sheet, table and row, page, chunk, file."""
    at = lambda *parts: F.concat(name, F.lit(" — "), *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    s = F.coalesce(sheet, F.lit(""))
    return (
        F.when(name == "", "").when((s != "") & row.isNotNull(), at("Sheet: ", s, ", 第 ", row.cast("string"), " 行")).when(s != "", at("Sheet: ", s))
        .when(table.isNotNull() & table_row.isNotNull(), at("Table ", table.cast("string"), ", Row ", table_row.cast("string")))
        .when(page.isNotNull(), at("第 ", page.cast("string"), " 頁")).when(F.coalesce(chunk >= 0, F.lit(False)), at("第 ", chunk.cast("string"), " 段")).otherwise(name)
    )


def source_ref_of_text(s: Column) -> Column:
    """The same for a source that is already text, `name#chunk5` included."""
    part = display_name(F.substring_index(s, "#", 1))
    after = F.regexp_replace(s, r"(?s)^[^#]*#", "")
    number = F.coalesce(group(after, r"(\d+)"), after)
    return F.when(F.contains(s, F.lit(" — ")), F.left(s, F.lit(80))).when(F.contains(s, F.lit("#")), F.when(part == "", "").otherwise(F.concat(part, F.lit(" — 第 "), number, F.lit(" 段")))).otherwise(display_name(s))


def first_category(x: Column) -> Column:
    return strip(F.substring_index(F.coalesce(x, F.lit("")), ",", 1))


def chunk_number(x: Column) -> Column:
    """The first run of digits, else 0."""
    return F.coalesce(F.try_to_number(group(x.cast("string"), r"(\d+)"), F.lit("9999999999")).cast("long"), F.lit(0))


def row_id(text: Column) -> Column:
    """HOST-36, REQ-12, SR-4.3.21 ...: the first of six patterns that is there, else empty."""
    t, found = strip(text), []
    for pattern, name in X.ROW_IDS:
        if name:
            found.append(F.when(matches(t, pattern, True), F.concat(F.lit(f"{name}-"), F.regexp_extract(t, UI + pattern, 1))))
        else:
            found.append(F.when(matches(t, pattern, True), F.concat_ws("-", F.upper(F.regexp_extract(t, UI + pattern, 1)), F.regexp_extract(t, UI + pattern, 2))))
    return F.coalesce(*found, F.lit(""))


def repaired_id(req_id: Column, file: Column, chunk: Column, k: Column) -> Column:
    """An id that is blank or a template left as it was becomes AUTO-file-chunk-nnn."""
    r = strip(req_id)
    bad = (r == "") | F.contains(r, F.lit("<file>")) | F.contains(r, F.lit("<chunk>")) | F.startswith(r, F.lit("AUTO-<"))
    return F.when(bad, F.concat(F.lit("AUTO-"), file, F.lit("-"), chunk.cast("string"), F.format_string("-%03d", k.cast("long")))).otherwise(r)


def matrix_id(req_id: Column, chunk_text: Column) -> Column:
    """The id forced by a chunk's first usable [ROW_ID=HOST 3] marker, or an `Item:` in it, unless it is an RFQ id."""
    marks = F.regexp_extract_all(chunk_text, F.lit(r"\[ROW_ID=([^\]]+)\]"), 1)
    own = r"^(HOST|BIOS|BMC|MECH|ENV|SER|AIC|MB|SYS)[\s\-](\d+)$"
    usable = F.get(F.filter(F.transform(marks, strip), lambda m: matches(m, own, True)), F.lit(0))
    item = r"Item:\s*(HOST|BIOS|BMC)\s+(\d+)"
    made = lambda x, p: F.format_string("RFQ-%s-%03d", F.upper(F.regexp_extract(x, UI + p, 1)), F.regexp_extract(x, UI + p, 2).cast("long"))
    r = strip(req_id)
    return F.when(F.startswith(r, F.lit("RFQ-")) | ~F.contains(chunk_text, F.lit("[ROW_ID=")), r).when(usable.isNotNull(), made(usable, own)).when(matches(chunk_text, item, True), made(chunk_text, item)).otherwise(r)


def table_position(req_id: Column, chunk_text: Column) -> Column:
    """(table, row) of a requirement by its id's marker in the chunk, else of the first marker, else of the first table row."""
    marked = r"\[TABLE\s+(\d+)\s+ROW\s+(\d+)\][^\[]*\[ROW_ID=([^\]]+)\]"
    all_of = lambda k: F.regexp_extract_all(chunk_text, F.lit(U + marked), k)
    rows = F.arrays_zip(all_of(1).alias("t"), all_of(2).alias("r"), F.transform(all_of(3), strip).alias("i"))
    prefix, number = F.regexp_extract(req_id, r"^RFQ-([A-Z]+)-(\d+)$", 1), F.regexp_extract(req_id, r"^RFQ-([A-Z]+)-(\d+)$", 2)
    n = F.regexp_replace(number, "^0+(?=.)", "")
    wanted = [F.concat(prefix, F.lit(s), n) for s in (" ", "-", "")]
    named = [F.get(F.filter(rows, (lambda w: lambda x: (prefix != "") & ((x["i"] == w) | (F.replace(x["i"], F.lit(" "), F.lit("-")) == w)))(w)), F.lit(0)) for w in wanted]
    first = F.get(rows, F.lit(0))
    cast = lambda x: F.when(x.isNotNull(), F.struct(x["t"].cast("int").alias("table"), x["r"].cast("int").alias("table_row")))
    plain = r"\[TABLE\s+(\d+)\s+ROW\s+(\d+)\]"
    bare = F.when(matches(chunk_text, plain), F.struct(F.regexp_extract(chunk_text, U + plain, 1).cast("int").alias("table"), F.regexp_extract(chunk_text, U + plain, 2).cast("int").alias("table_row")))
    return F.coalesce(*[cast(x) for x in named], cast(first), bare)


def sheet_position(chunk_text: Column) -> Column:
    p = r"\[FILE:[^\]]*\s+SHEET:([^\s\]]+)\s+ROW\s+(\d+)\]"
    return F.when(matches(chunk_text, p), F.struct(F.regexp_extract(chunk_text, U + p, 1).alias("sheet"), F.regexp_extract(chunk_text, U + p, 2).cast("int").alias("row")))


def page_position(chunk_text: Column) -> Column:
    return group(chunk_text, r"\[PDF PAGE\s+(\d+)\]").cast("int")


def cleaned(text: Column) -> Column:
    """Generated text without traces of its prompt."""
    t = strip(F.regexp_replace(F.coalesce(text, F.lit("")), UI + X.PROMPT_TRACES, ""))
    return F.btrim(F.regexp_replace(t, r"(?U)\s{2,}", " "), F.lit(" .,;"))


def cleaned_line(line: Column) -> Column:
    return strip(F.regexp_replace(strip(F.regexp_replace(line, r"(?U)\s+", " ")), r"(?U)^[\s>*-]+", ""))


def excerpt(text: Column, n: int = 400) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(" ..."))).otherwise(text)


def short_source(file: Column, chunk: Column) -> Column:
    return F.concat(file, F.lit("#chunk"), chunk.cast("string"))


def safe_key(s: Column) -> Column:
    return F.left(strip(F.regexp_replace(F.regexp_replace(strip(s), r'[\\/:*?"<>|]+', "_"), r"(?U)\s+", " ")), F.lit(80))


def significant_tokens(text: Column) -> Column:
    """Numbers with units, numbers, versions and models, standards: lower case, no white space, each once."""
    found = [F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit((UI if i else U) + p), 0) for p, i in zip(X.TOKENS, X.TOKENS_IGNORE_CASE, strict=True)]
    return F.array_distinct(F.transform(F.concat(*found), lambda t: F.lower(F.regexp_replace(t, r"(?U)\s+", ""))))


def new_tokens(normalized: Column, *sources: Column) -> Column:
    """Significant tokens of a rewriting that none of its sources has, sorted."""
    allowed = significant_tokens(F.concat_ws(" ", *[F.coalesce(s, F.lit("")) for s in sources]))
    return F.array_sort(F.array_except(significant_tokens(normalized), allowed))


def masked(text: Column, secrets: list[str]) -> Column:
    return reduce(lambda t, s: F.replace(t, F.lit(s), F.lit("***")), sorted([s for s in secrets if s], key=len, reverse=True), text)


def ascii_preview(text: Column, n: int = 800) -> Column:
    return F.regexp_replace(F.left(text, F.lit(n)), r"[^\x00-\x7F]", "?")


def duration(seconds: Column, hours: bool = True) -> Column:
    """7s, 1m 12s, 2h 5m; ties round to even. Without hours minutes go on counting."""
    s = F.bround(seconds.cast("double"), 0).cast("long")
    part = lambda d, r: F.concat(F.floor(s / d).cast("string"), F.lit("h " if d == 3600 else "m "), F.floor(F.pmod(s, F.lit(d)) / r).cast("string"), F.lit("m" if d == 3600 else "s"))
    out = F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
    return (out.when(s >= 3600, part(3600, 60)) if hours else out).otherwise(part(60, 1))


def elapsed(started: Column, ended: Column) -> Column:
    """1h5m, 3m7s or 9s between two ISO times; `-` if either is missing, unreadable or they are reversed."""
    s = F.timestamp_diff("SECOND", F.try_to_timestamp(started), F.try_to_timestamp(ended))
    h, m = F.floor(s / 3600).cast("string"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("string")
    rest = F.concat(F.pmod(s, F.lit(60)).cast("string"), F.lit("s"))
    out = F.when(s >= 3600, F.concat(h, F.lit("h"), m, F.lit("m"))).when(s >= 60, F.concat(m, F.lit("m"), rest)).otherwise(rest)
    return F.when((strip(started) == "") | (strip(ended) == "") | s.isNull() | (s < 0), "-").otherwise(out)


def eta(elapsed_s: Column, done: Column, total: Column) -> Column:
    """Seconds left, once two are done and some are not."""
    return F.when((done >= 2) & (total > 0) & (done < total), F.floor(elapsed_s * (total - done) / done).cast("long"))


def confidence_shown(reason: Column, confidence: Column) -> Column:
    """Two decimals, ties to even, where a rewriting was tried; else empty."""
    return F.when(strip(reason) != "", F.format_string("%.2f", F.bround(F.coalesce(confidence, F.lit(0.0)), 2))).otherwise("")


def guarded_confidence(confidence: Column, fresh: Column) -> Column:
    """Within 0 and 1; at most 0.5 if the rewriting brought tokens of its own; two decimals."""
    c = F.least(F.greatest(F.coalesce(confidence, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.bround(F.when(F.size(fresh) > 0, F.least(c, F.lit(0.5))).otherwise(c), 2)


def canonical_config(config: Column) -> Column:
    """A map as JSON with sorted keys; null and empty are {}."""
    return F.when(F.coalesce(F.size(config), F.lit(0)) == 0, "{}").otherwise(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(config)))))


def text_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def item_text(normalized: Column, original: Column) -> Column:
    return strip(F.coalesce(F.nullif(normalized, F.lit("")), original))


def cache_signature(file_hash: Column, requirement_hash: Column, parser: Column, prompt: Column, model: Column | None = None, config: Column | None = None) -> Column:
    named = [("file_hash", F.coalesce(file_hash, F.lit(""))), ("requirement_text_hash", F.coalesce(F.nullif(requirement_hash, F.lit("")), F.lit("-"))), ("parser_version", parser), ("prompt_version", prompt)]
    if model is not None:
        named += [("model_name", F.coalesce(model, F.lit(""))), ("extraction_config", config if config is not None else F.lit("{}"))]
    return text_hash(F.concat_ws("|", *[F.concat(F.lit(f"{n}="), c) for n, c in named]))


def parsed_json(text: Column) -> Column:
    """Model output before parsing: no thinking, no fences, no template words where values belong."""
    s = strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
    s = F.coalesce(group(s, r"(?s)^```(?:json|JSON)?\s*\n?(.*?)```\s*$"), s)
    return F.regexp_replace(F.regexp_replace(strip(s), r":\s*<chunk>", ": 0"), r"(?U):\s*CHUNK\b", ": 0")


def summary_counts(output: Column) -> Column:
    """The counters of a `=== Summary ===` block as a map."""
    block = group(output, r"(?s)===\s*Summary\s*===(.*?)(?:\n\n===|\z)")
    line = r"(?m)^\s+(\w+)[ \t]*:[ \t]*(\d+)[ \t]*$"
    return F.map_from_arrays(F.regexp_extract_all(block, F.lit(line), 1), F.transform(F.regexp_extract_all(block, F.lit(line), 2), lambda x: x.cast("long")))


def suffix(i: Column) -> Column:
    """a to z, then the number."""
    return F.when(i < 26, F.char(i + 97)).otherwise((i + 1).cast("string"))


