"""DuckDB SQL for the operators that SQL can express, over the tables as they stand."""

from .clustering import CENTROIDS, DIMENSIONS, ROUNDS, SCALE
from .licenses import template_grams

WORDS = r"list_filter(regexp_split_to_array(coalesce({t}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s),
r AS (SELECT *, 3.0 * source_size / weight AS ratio, sum(source_size) OVER ()::DOUBLE AS all_size, sum(weight) OVER () AS all_weight FROM w),
c AS (SELECT *, coalesce(sum(3.0 * source_size) OVER b, 0) AS spent, coalesce(sum(weight) OVER b, 0) AS gone FROM r
  WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (all_size - spent) / (all_weight - gone) AS level FROM c),
g AS (SELECT source, source_size, CASE WHEN level >= ratio THEN 3.0 * source_size
    ELSE weight * (SELECT min_by(level, ratio) FROM l WHERE level < ratio) END::DOUBLE AS target FROM l),
p AS (SELECT source, place, sum(size) AS size FROM d GROUP BY source, place),
m AS (SELECT source, place, sum(size) OVER (PARTITION BY source ORDER BY place ROWS UNBOUNDED PRECEDING) - size / 2.0 AS middle FROM p),
j AS (SELECT d.*, g.source_size, g.target, m.middle, floor(g.target / nullif(g.source_size, 0) + 1e-12) AS whole
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source JOIN m ON d.source IS NOT DISTINCT FROM m.source AND d.place = m.place)
SELECT doc_id, size, source_size, target,
  (size * CASE WHEN source_size = 0 THEN 0 ELSE least(3, whole + (middle <= target - whole * source_size)::INT) END)::BIGINT AS taken FROM j
"""

QUALITY = rf"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS.format(t="text")} AS w FROM documents),
b AS (SELECT *, list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i+1], w[i+2]]) AS g,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM a),
u AS (SELECT row_number() OVER () AS k, * FROM b),
e AS (SELECT k, unnest(g) AS gram, unnest(range(1, len(g) + 1)) AS i FROM u),
f AS (SELECT k, i FROM e QUALIFY count(*) OVER (PARTITION BY k, gram) > 1),
h AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM f) GROUP BY k),
s AS (SELECT doc_id, text, w, lines, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words FROM u LEFT JOIN h USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols > 0.1 * n_words OR word_chars > 12 * n_words
    OR word_chars < 2 * n_words OR n_dup_lines > 0.3 * len(string_split(text, chr(10)))
    OR len(regexp_extract_all(text, '!')) > 0.3 * n_words OR len(regexp_extract_all(text, '\p{{L}}')) < 0.6 * word_chars
    OR len(regexp_extract_all(text, '\p{{Lu}}')) > 0.5 * word_chars OR len(list_distinct(w)) < 0.05 * n_words) AS kept FROM s
"""

_GUARDED = ["<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<<ROLE>>", "<<TEXT>>", "<</ROLE>>", "<|endoftext|>", "<|im_start|>", "<|im_end|>"]
_HELD = " + ".join(f"2 * ((length(text) - length(replace(text, '{g}', ''))) / {len(g)})" for g in _GUARDED)

CHAT = rf"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
l AS (SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + {_HELD}
  + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7
    ELSE 25 + length(coalesce(role, '0')) END AS n FROM t),
c AS (SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role NULLS FIRST, text)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY turn, role NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '') AS learned,
  sum(n)::BIGINT AS formatted_chars,
  string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role NULLS FIRST, text) AS roles
  FROM l GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars,
  regexp_full_match(roles, 's?(ua)+') AS valid FROM c
"""


def clustering() -> str:
    """Lloyd's rounds, one after the other, every vector against every centroid."""
    to = lambda k: f"""
a{k} AS (SELECT vec_id, row_id, arg_min(c, struct_pack(d := list_sum(list_transform(list_zip(p, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c := c)) AS c,
  min(list_sum(list_transform(list_zip(p, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))::BIGINT AS d FROM v, c{k} GROUP BY vec_id, row_id)"""  # noqa: E731
    moved = lambda k: f"""
s{k} AS (SELECT c, i, sum(p[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{k} JOIN v USING (row_id), range(1, {DIMENSIONS + 1}) AS r(i) GROUP BY c, i),
m{k} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM s{k} GROUP BY c),
c{k + 1} AS (SELECT c{k}.c, coalesce(m{k}.m, c{k}.m) AS m FROM c{k} LEFT JOIN m{k} ON c{k}.c = m{k}.c)"""  # noqa: E731
    rounds = ",".join(f"{to(k)},{moved(k)}" for k in range(ROUNDS))
    return f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings WHERE len(embedding) = {DIMENSIONS}),
v AS (SELECT vec_id, row_number() OVER () AS row_id, list_transform(x, lambda y: floor({SCALE} * y)::BIGINT) AS p FROM e
  WHERE len(list_filter(x, lambda y: y IS NOT NULL AND isfinite(y))) = {DIMENSIONS}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, p AS m FROM v ORDER BY sha256('2:' || vec_id) LIMIT {CENTROIDS}),{rounds},{to(ROUNDS)}
SELECT vec_id, a{ROUNDS}.c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY a{ROUNDS}.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} ON a{ROUNDS}.c = c{ROUNDS}.c
"""


def licenses() -> str:
    """Diagonal voting by words instead of hashes."""
    grams = ", ".join(f"({t}, '{label}', {base}, {n}, {k}, {slack}, {share}, {j}, '{' '.join(g)}')" for t, label, base, n, k, slack, share, j, g in template_grams())
    return rf"""
WITH g(t, label, base, n, k, slack, share, j, gram) AS (VALUES {grams}),
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT r, w, unnest(range(len(w))) AS i FROM d),
f AS (SELECT r, i, k, array_to_string(w[i + 1 : i + k], ' ') AS gram FROM e, (VALUES (2), (4)) AS x(k) WHERE i + k <= len(w)),
l AS (SELECT r, t, label, base, n, g.k, slack, share, i - j AS diagonal, min(i) AS lo, bit_or(CASE g.k WHEN 2 THEN 3 ELSE 15 END::HUGEINT << j) AS covered
  FROM f JOIN g ON f.k = g.k AND f.gram = g.gram GROUP BY ALL),
m AS (SELECT *, coalesce((diagonal - lag(diagonal) OVER (PARTITION BY r, t ORDER BY diagonal) > slack)::INT, 0) AS new FROM l),
o AS (SELECT *, sum(new) OVER (PARTITION BY r, t ORDER BY diagonal) AS island FROM m),
s AS (SELECT r, label, base, min(lo) AS lo, bit_count(bit_or(covered)) / n AS part FROM o GROUP BY r, t, label, base, n, share, island HAVING bit_count(bit_or(covered)) / n >= share),
h AS (SELECT r, count(*) FILTER (WHERE base) AS n_base, min(lo) FILTER (WHERE base) AS first_word, max(lo) FILTER (WHERE base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(part) AS score FROM s GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN h USING (r)
"""
