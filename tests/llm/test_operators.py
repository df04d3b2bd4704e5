"""The corpus operators on small tables, against brute force, with odd rows: nulls, empty and long texts, ties, repeats."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from gristmill.llm import chat, common, fingerprints, jaccard, kernel, kneser_ney, language, lines, mixing, packing, quality, toxicity
from gristmill.llm import components as component_tables
from gristmill.llm.components import components
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DDL = "doc_id long, text string, lang string, source string, n_chars long, key long, bucket string, size string, h string"


def prose(r, n, lexicon="amber birch cedar delta ember fjord grove haven inlet joust knoll lemon maple north ocean plume quilt river stone tulip umber vivid wheat xenon yacht zebra".split()):
    return " ".join(r.choice(lexicon) + r.choice(["", "", "s", "ed", "ly"]) for _ in range(n))


def texts(seed=1):
    r = random.Random(seed)
    base = [prose(r, r.randint(60, 200)) for _ in range(12)]
    near = [" ".join(w if k != 30 else "changed" for k, w in enumerate(b.split())) for b in base[:4]]
    lined = ["\n".join(b.split(" ", 40)[:3] + [base[k].replace(" ", "\n", 2)]) for k, b in enumerate(base[4:7])]
    long = prose(r, 6_000)
    return [*base, *near, *lined, base[0], base[0], "", None, "   \n\t ", "one", "two words", "größe über 中文 😀", "a" * 3_000, long, "UPPER CASE!! TEXT!! " * 40, "same same same " * 60]


def rows(seed=1):
    out = [(k, t, ("en", "de", None)[k % 3], ("a", "b", None)[min(k % 5, 2)], len(t or ""), 7, "x", "y", "z") for k, t in enumerate(texts(seed))]
    return [*out, out[3], (None, "a row without an id", None, None, 3, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DDL).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def lower_words(t):
    return WORD.findall((t or "").translate(LOWER))


def classes_of(items, alike):
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(items, 2):
        if alike(a, b):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


def jaccard_of(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_components(spark):
    r = random.Random(5)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(150)] + [(400, 400 + k) for k in range(1, 60)] + [(k, k + 1) for k in range(600, 640)]
    expected = defaultdict(set)
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    edges = {frozenset(p) for p in pairs}
    for n, root in classes_of(sorted(nodes), lambda a, b: frozenset((a, b)) in edges).items():
        expected[root].add(n)
    got = defaultdict(set)
    for x in components(spark.createDataFrame(pairs, "a long, b long")).collect():
        got[x.root].add(x.node)
    assert got == expected
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- line dedup


def line_sets(t):
    out = {}
    for k, x in enumerate((t or "").split("\n")):
        x = x.strip(" \t\r\x0b\x0c").lower()
        if x:
            out[k] = frozenset(x[i : i + 8] for i in range(max(len(x) - 7, 1)))
    return out


def test_line_classes_match_brute_force(spark):
    r = random.Random(3)
    pool = [prose(r, r.randint(3, 60)) for _ in range(25)]
    pool += [p.replace("e", "E", 1) + " " for p in pool[:8]] + [p[:-1] + "q" for p in pool[8:16]] + ["x", "x", "short", "line " * 30, "line " * 31]
    data = [(k, "\n".join(r.choice(pool) for _ in range(r.randint(0, 6)))) for k in range(60)] + [(100, None), (101, ""), (102, "\n\n")]
    sets = {(d, k): s for d, t in data for k, s in line_sets(t).items()}
    found = lines.line_classes(spark.createDataFrame(data, "doc_id long, text string")).collect()
    by_class = defaultdict(set)
    for x in found:
        by_class[x.class_id].add((x.doc_id, x.line))
    expected = defaultdict(set)
    for n, root in classes_of(sorted(sets), lambda a, b: jaccard_of(sets[a], sets[b]) >= 0.8).items():
        expected[root].add(n)
    assert sorted(map(sorted, by_class.values())) == sorted(sorted(v) for v in expected.values() if len(v) > 1)
    assert {(x.doc_id, x.line) for x in found if x.kept} == {min(v) for v in by_class.values()}


def test_lines_of_repeated_content_meet_at_any_length(spark):
    pool = [c * n for c in "-=" for n in (50, 80, 120, 400)] + ["click here to win a prize today " * n for n in (2, 5, 9)] + ["ab " * 20, "ab " * 70, "other words altogether"]
    sets = {k: line_sets(t)[0] for k, t in enumerate(pool)}
    found = lines.line_classes(spark.createDataFrame(list(enumerate(pool)), "doc_id long, text string")).collect()
    root = {}
    for x in sorted(found, key=lambda x: x.doc_id):
        root.setdefault(x.class_id, x.doc_id)
    got = {x.doc_id: root[x.class_id] for x in found}
    expected = classes_of(sorted(sets), lambda a, b: jaccard_of(sets[a], sets[b]) >= 0.8)
    assert len(set(expected.values())) == 5
    assert {k: got.get(k, k) for k in sets} == expected


def test_many_lines_with_a_shared_start(spark):
    """A group of hundreds of lines around few leaders, most of them unlike each other: what is dropped is exactly what is like
    an earlier line, as the candidates of equal starts allow."""
    r = random.Random(61)
    start = prose(r, 18)
    pool = [start + " " + prose(r, 14) for _ in range(500)]
    data = [(k, pool[k]) for k in range(500)] + [(500 + k, pool[2 * k][:-1] + "#") for k in range(250)]
    sets = {d: line_sets(t)[0] for d, t in data}
    root = classes_of(sorted(sets), lambda a, b: jaccard_of(sets[a], sets[b]) >= 0.8)
    got = {x.doc_id: x.n_dropped for x in lines.report(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    wrong = [d for d in sets if got[d] and root[d] == d]
    missed = [d for d in sets if not got[d] and root[d] != d]
    assert sum(root[d] != d for d in sets) >= 250 and not wrong and len(missed) <= 3


def test_a_line_whose_shingles_are_all_passed_over_is_read_again(spark):
    """Rulers and short periods have few distinct shingles, most often none in the quarter that is hashed first."""
    pool = [c * n for c in "-=+*#~_.:;,!?/|" for n in (90, 130)] + [(a + b) * n for a in "abcd" for b in "wxyz" for n in (60, 80)]
    found = lines.line_classes(spark.createDataFrame(list(enumerate(pool)), "doc_id long, text string")).collect()
    by_class = defaultdict(set)
    for x in found:
        by_class[x.class_id].add(x.doc_id)
    assert sorted(map(sorted, by_class.values())) == [[2 * k, 2 * k + 1] for k in range(len(pool) // 2)]
    first = lines.minima(lines.line_table(spark.createDataFrame(list(enumerate(pool)), "doc_id long, text string")), lines.Hashes.drawn())
    assert first.where("open").count() > 5


def test_a_line_read_again_counts_in_all_its_documents(spark):
    ruler = "-=" * 90
    found = lines.line_classes(spark.createDataFrame([(k, f"text {k} of its own\n \t{ruler.upper()}\x0c ") for k in range(3)] + [(3, ruler)], "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.line, x.kept) for x in found if x.line or x.doc_id == 3) == [(0, 1, True), (1, 1, False), (2, 1, False), (3, 0, False)]


def test_minima_of_strata_are_those_of_every_mask(spark):
    """A hash is folded in for few masks; the minima are those of all hashes by all masks, strata without hashes or not."""
    import xxhash

    r, hashes = random.Random(5), lines.Hashes.drawn()
    assert len({m % (1 << lines.STRATUM) for m in hashes.masks}) * lines.STRATA == len(set(hashes.masks)) == lines.BANDS * lines.ROWS
    pool = ["x", "-=" * 90, "ab " * 70] + [prose(r, n) for n in (1, 2, 4, 8, 12, 14, 20, 60, 300)]
    table = lines.line_table(spark.createDataFrame(list(enumerate(pool)), "doc_id long, text string"))
    plain = {x.key: x.plain for x in table.collect()}
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    for whole in (False, True):
        found = lines.minima(table, hashes, whole).collect()
        assert len(found) == len(pool) and all(x.n == 1 for x in found)
        for x in found:
            b = plain[x.key].encode("utf-16-be")
            held = [signed(xxhash.xxh64_intdigest(b[i : i + 16], seed=42)) for i in range(0, max(len(b) - 14, 1), 2)]
            assert x.open or [x[f"m{k}"] for k in range(len(hashes.masks))] == [min(h ^ m for h in held) for m in hashes.masks]
        assert whole or sum(x.open for x in found) <= 2


def test_few_rows_pass_a_bitmap_by_chance_however_many_keys_it_has(spark):
    hashes = lambda low, high: spark.range(low, high).select(F.xxhash64("id").alias("key"), "id")
    keys = hashes(0, 2_000_000).select("key")
    near = common.only_near(hashes(1_990_000, 2_200_000), keys)
    got = near.agg(F.count_if(F.col("id") < 2_000_000).alias("held"), F.count_if(F.col("id") >= 2_000_000).alias("chance")).collect()[0]
    assert got.held == 10_000 and got.chance < 10_000
    assert common.only_near(hashes(0, 100), keys.limit(0)).count() == 0


def test_line_dedup_on_odd_rows(docs, empty):
    found = lines.report(docs).collect()
    out, n = {x.doc_id: x for x in found}, len(found)
    assert set(out) == {x[0] for x in rows()} and n == docs.count()
    assert out[None].n_lines == 1 and out[0].n_dropped == 0
    assert out[19].n_dropped == 1 and out[20].n_dropped == 1  # copies of document 0
    kept = lines.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [x.doc_id for x in kept.collect()]
    assert 19 not in ids and 20 not in ids and 0 in ids and 21 in ids and 22 in ids
    assert lines.report(empty).count() == 0 and lines.deduplicated(empty).count() == 0


# --- language


def speech(r, lang, n):
    parts = {"xa": ["sch", "ung", "ein", "ber", "üß"], "yo": ["tion", "eau", "ez", "qu", "é"], "zu": ["th", "ing", "er", "wh", "nd"]}[lang]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_language_id(spark, empty):
    r = random.Random(2)
    data = [(k, speech(r, lang := ("xa", "yo", "zu")[k % 3], r.randint(20, 300)), lang) for k in range(240)] + [(1001, None, "xa"), (1002, "", None), (1003, "12 34 !!", "yo"), (1004, "x" * 5_000, None), (None, speech(r, "zu", 50), "zu")]
    got = language.identified(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(data)
    truth = {d: lang for d, _, lang in data}
    for x in got:
        assert x.held_out == (zlib.crc32(str(x.doc_id if x.doc_id is not None else "").encode()) % 4 == 2)
        assert 0 <= x.score <= 1 and x.lang_pred in {"xa", "yo", "zu", "und"}
        assert (x.lang_pred == "und") == (x.doc_id in (1001, 1002, 1003))
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 1000]
    assert sum(x.lang_pred == truth[x.doc_id] for x in held) / len(held) > 0.97
    assert language.identified(empty).count() == 0


def test_tables_read_as_the_network_does():
    r = random.Random(4)
    net = language.train([speech(r, x, 80) for x in ("xa", "yo") * 10], ["xa", "yo"] * 10, epochs=1)
    x = np.frombuffer(speech(r, "xa", 300).encode()[: 2 * language.WINDOW], np.uint8).reshape(2, -1)
    e, pooled = net.embedding[x], []
    for w, f, b in zip(language.WIDTHS, net.filters, net.biases, strict=True):
        c = np.stack([e[:, i : i + w].reshape(2, -1) @ f + b for i in range(language.WINDOW - w + 1)], axis=1)
        pooled.append(np.maximum(c.max(axis=1), 0))
    z = np.concatenate(pooled, axis=1) @ net.out + net.out_bias
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert np.allclose(language.Reader(net).probabilities(x), p, atol=1e-4)


def test_predictions_are_those_of_a_plain_loop_over_whole_texts(spark):
    r = random.Random(19)
    net = language.train([speech(r, x, 80) for x in ("xa", "yo", "zu") * 8], ["xa", "yo", "zu"] * 8, epochs=2)
    data = [(k, speech(r, ("xa", "yo", "zu")[k % 3], n)) for k, n in enumerate((1, 3, 40, 200, 900))] + [(10, "GRÖSSE über"), (11, "a" * 256), (12, "12 !"), (13, None), (14, ""), (15, "x" + " " * 700)]

    def plain(t):
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())
        total, weight = np.zeros(3), 0
        for i in range(0, max(len(raw), 1), language.WINDOW):
            piece = raw[i : i + language.WINDOW]
            e = net.embedding[np.frombuffer(piece.ljust(language.WINDOW), np.uint8)]
            pooled = [np.maximum(np.max([e[k : k + w].reshape(-1) @ f + b for k in range(language.WINDOW - w + 1)], axis=0), 0) for w, f, b in zip(language.WIDTHS, net.filters, net.biases, strict=True)]
            z = np.exp(np.concatenate(pooled) @ net.out + net.out_bias)
            total += len(piece) * z / z.sum()
            weight += len(piece)
        return total / max(weight, 1)

    for x in language.predicted(spark.createDataFrame(data, "doc_id long, text string"), net).collect():
        t = dict(data)[x.doc_id]
        if t is None or not any(c.isalpha() for c in t):
            assert (x.lang_pred, x.score) == ("und", 0.0)
        else:
            p = plain(t)
            assert x.lang_pred == net.languages[p.argmax()] and abs(x.score - p.max()) < 1e-4


# --- fingerprints


def test_fingerprints(docs, empty, spark):
    data = [(x[0], x[1] or "") for x in rows()]
    order = sorted(data, key=lambda x: (-(x[0] if x[0] is not None else -1), x[1]))
    expected = Counter()
    for k, (d, t) in enumerate(order):
        nxt, m = order[(k + 1) % len(order)][1], len(t) // 3
        expected[d, len(t), hashlib.sha256((t[: len(t) - m] + nxt[:m]).encode()).hexdigest()] += 1
    got = fingerprints.fingerprinted(docs).collect()
    assert Counter((x.doc_id, x.n_chars, x.edited_sha256) for x in got) == expected
    by_text = defaultdict(set)
    for x in got:
        by_text[dict(data)[x.doc_id]].add(x.fingerprint)
        assert 0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1
    assert all(len(v) == 1 for v in by_text.values())
    k = next(k for k, x in enumerate(order) if len(x[1]) > 20_000)
    t, nxt = order[k][1], order[(k + 1) % len(order)][1]
    grams = lambda x: {tuple(w[i : i + 5]) for w in [WORD.findall(x)] for i in range(max(len(w) - 4, 1))}
    long = next(x for x in got if x.n_chars > 20_000)
    true = jaccard_of(grams(t), grams(t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]))
    assert abs(long.near_edited - true) < 0.05 and long.near_next < 0.05
    assert fingerprints.fingerprinted(empty).count() == 0
    one = fingerprints.fingerprinted(spark.createDataFrame([(5, "abc def")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def test_a_sketch_holds_every_shingle_hash_below_the_threshold(spark):
    """Hash by hash: five words, one after the other the seed of the next, kept below a quarter of the range, else the least."""
    import xxhash

    def sketch(t):
        w, out = WORD.findall(t), set()
        for i in range(max(len(w) - 4, 1) if w else 0):
            h = 42
            for x in w[i : i + 5]:
                h = xxhash.xxh64_intdigest(x.encode(), seed=h)
            out.add(h - (1 << 64) if h >> 63 else h)
        below = [h for h in out if h < fingerprints.NO_ID + (1 << 62)]
        return "".join(f"{h & (1 << 64) - 1:016x}" for h in sorted(below or ([min(out)] if out else [])))

    data = [(k, t) for k, t in enumerate(texts()) if t is not None]
    got = {x.doc_id: x.fingerprint for x in fingerprints.fingerprinted(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {d: sketch(t) for d, t in data}


def test_followers_of_many_keys(spark):
    r = random.Random(8)
    keys = sorted({r.randrange(-(1 << 40), 1 << 40) for _ in range(500)} | set(range(300)))
    got = {x.key: x.before for x in fingerprints.followers(spark.createDataFrame([(k,) for k in keys], "key long"), limit=50).collect()}
    assert got == dict(zip(keys, [*keys[1:], keys[0]], strict=True))


# --- Jaccard join


def test_jaccard_join_matches_brute_force(docs, empty, spark):
    r = random.Random(11)
    stem = prose(r, 150).split()
    group = []
    for _ in range(60):
        w = list(stem)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "edit" + str(r.randrange(1000))
        group.append(" ".join(w))
    data = [(k, t) for k, t in enumerate([t for t in texts()] + group)] + [(500, prose(r, 150)), (500, prose(r, 150))]
    sets = {}
    for k, (d, t) in enumerate(data):
        w = lower_words(t)
        sets[d, k] = frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()
    truth = classes_of(sorted(sets), lambda a, b: jaccard_of(sets[a], sets[b]) >= 0.8)
    got = jaccard.join(spark.createDataFrame(data, "doc_id long, text string"))
    ids = {x.doc_id: x.class_id for x in got.collect()}
    for (d, _), (root, _) in truth.items():
        assert d == 500 or ids[d] == root
    assert got.count() == len(data)
    assert jaccard.join(docs).count() == docs.count() and jaccard.join(empty).count() == 0
    kept = jaccard.deduplicated(docs)
    assert kept.columns == docs.columns
    left = [x.doc_id for x in kept.collect()]
    assert len(left) == len(set(left)) and not {12, 13, 14, 15, 19, 20} & set(left) and {0, 1, 2, 3, None} <= set(left)
    assert jaccard.deduplicated(empty).count() == 0


@pytest.mark.parametrize("block_rows", [512, 16])
def test_jaccard_join_counts_every_link(spark, monkeypatch, block_rows):
    monkeypatch.setattr(component_tables, "BLOCK_ROWS", block_rows)
    r = random.Random(12)
    stems = [prose(r, 150).split() for _ in range(3)]
    data = []
    for k in range(120):
        w = list(stems[0] if k < 100 else stems[1 + k % 2])
        for _ in range(r.randint(1, 3)):
            w[r.randrange(len(w))] = f"edit{k}x{r.randrange(1000)}"
        data.append((k, " ".join(w)))
    data += [(200, data[0][1]), (201, prose(r, 40)), (202, "one"), (203, None)]
    sets = {d: frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) for d, t in data if (w := lower_words(t))}
    distinct = set(sets.values())
    expected = {d: sum(jaccard_of(s, x) >= 0.8 for x in distinct if x != s) for d, s in sets.items()} | {203: 0}
    assert max(expected.values()) > 30
    assert {x.doc_id: x.n_links for x in jaccard.join(spark.createDataFrame(data, "doc_id long, text string")).collect()} == expected


def word_sets(rows_):
    return {d: frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if (w := lower_words(t)) else frozenset() for d, t in rows_}


def edited(r, words, n):
    w = list(words)
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def test_prefixes_are_shortened_as_far_as_the_recall_needs(spark):
    assert jaccard.expected_recall(*[jaccard.FLOOR] * jaccard.TREES) >= jaccard.RECALL > jaccard.expected_recall(*[jaccard.FLOOR + 1] * jaccard.TREES)
    assert 0 < jaccard.NEEDED < jaccard.TREES
    r = random.Random(31)
    near = [(k, edited(r, prose(random.Random(1), 200).split(), 1)) for k in range(60)]
    texts_ = jaccard.signed(spark.createDataFrame([*near, (99, prose(r, 60))], "doc_id long, text string"))
    paths = {x.key: [bytes(p) for p in x.paths] for x in texts_.collect()}
    node = lambda p, d: p[: d * jaccard.LABEL]
    crowd = Counter((t, node(p, jaccard.FLOOR)) for own in paths.values() for t, p in enumerate(own))
    found = {(x.key, x.bucket) for x in jaccard.matched_nodes(texts_).collect()}
    alone = sum(crowd[t, node(p, jaccard.FLOOR)] == 1 for own in paths.values() for t, p in enumerate(own))
    assert len(found) == len(paths) * jaccard.TREES - alone
    meet = defaultdict(set)
    for key, bucket in found:
        meet[bucket].add(key)
    buckets = [frozenset(v) for v in meet.values()]
    for key, own in paths.items():  # in its NEEDED least crowded trees a text meets all that share its short prefix
        whole = 0
        for t, p in enumerate(own):
            short = {k for k, q in paths.items() if node(q[t], jaccard.FLOOR) == node(p, jaccard.FLOOR)}
            whole += len(short) == 1 or any(key in b and b == short for b in buckets)
        assert whole >= jaccard.NEEDED


def test_a_template_does_not_hide_pairs_that_are_just_similar(spark):
    """1,500 texts with one edit each of 400 words beside 400 pairs of about 0.815."""
    r = random.Random(33)
    lexicon = [f"w{k}" for k in range(5_000)]
    stem = [r.choice(lexicon) for _ in range(400)]
    data = [(k, edited(r, stem, 1)) for k in range(1_500)]
    for k in range(400):
        w = [r.choice(lexicon) for _ in range(400)]
        v = list(w)
        for place in range(20, 380, 45):
            v[place] = f"other{place}"
        data += [(10_000 + 2 * k, " ".join(w)), (10_001 + 2 * k, " ".join(v))]
    sets = word_sets(data[1_500:1_502])
    assert 0.80 <= jaccard_of(*sets.values()) <= 0.83
    got = {x.doc_id: x.n_links for x in jaccard.join(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    found = [got[10_000 + 2 * k] for k in range(400)]
    assert max(found) == 1 and sum(found) >= 0.98 * 400
    assert sum(got[10_000 + 2 * k] for k in range(0, 400, 25)) >= 15  # ids divisible by 50
    texts_ = {t for _, t in data[:1_500]}
    assert min(got[k] for k in range(1_500)) >= 0.99 * (len(texts_) - 1)


def test_jaccard_join_recall_against_brute_force(spark):
    """Every row whose id is divisible by 50, against all rows."""
    r = random.Random(32)
    stems = [prose(r, 120).split() for _ in range(40)]
    data = [(k, edited(r, stems[k % 40], r.randint(0, 3))) for k in range(1_000)]
    sets = word_sets(data)
    want = {d: len({s for s in sets.values() if s != sets[d] and jaccard_of(s, sets[d]) >= 0.8}) for d in sets if d % 50 == 0}
    got = {x.doc_id: x.n_links for x in jaccard.join(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert sum(want.values()) > 100 and all(got[d] <= n for d, n in want.items())
    assert sum(got[d] for d in want) / sum(want.values()) >= 0.9


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    r = random.Random(33)
    a, b, c = (prose(r, 60) for _ in range(3))
    data = [(1, a), (5, a), (5, b), (6, b + " more"), (None, a), (None, c), (7, c), (8, b), (8, b)]
    left = jaccard.deduplicated(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted(((x.doc_id, x.text) for x in left), key=str) == sorted([(1, a), (5, b), (7, c)], key=str)


# --- packing


def test_packing_round_trip(docs, empty, spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for x in rows():
        ids = np.array([*t.encode(x[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want[x[0], ids.tobytes()] += 1
    got = packing.packed(docs).collect()
    by_sequence = defaultdict(list)
    for p in got:
        by_sequence[p.sequence_id].append(p)
    lengths = []
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        lengths.append(at)
        assert at <= 2048
    total = sum(lengths)
    assert total == sum(n * len(b) // 4 for (_, b), n in want.items())
    assert sum((2048 - n) for n in lengths if n & (n - 1)) / total < 0.02
    for (d, b), n in want.items():
        pieces = sorted({(p.start, p.length, p.ids_crc32) for p in got if p.doc_id == d and p.doc_tokens == len(b) // 4})
        covered = sum(p.length for p in got if p.doc_id == d)
        assert covered == sum(k * len(x) // 4 for (e, x), k in want.items() if e == d)
        if n == 1:
            at = 0
            for start, length, crc in pieces:
                assert start == at and crc == zlib.crc32(b[4 * start : 4 * (start + length)])
                at += length
    assert packing.packed(empty).count() == 0


def test_special_strings_and_ids_as_the_tokenizers_library_has_them():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.public_tokenizers.path("byte_bpe_50k.json"))
    path = packing.public_tokenizers.path("byte_bpe_50k.tiktoken")
    for x in ["a<|endoftext|>b", "  spaces   and\n\n\ttabs ", "it's we'll I'D", "中文 größe 😀\u200d", "x" * 500, "123 4567 !!??", "\u00a0\u2003nbsp", "\r\n\r\n"]:
        assert packing.token_ids(x, path).tolist() == [*t.encode(x, add_special_tokens=False).ids, 1]


# --- chat


def test_chat_round_trip(spark):
    own = "</s>[INST] ok [/INST]"
    turns = [(1, 0, "user", own), (1, 1, "assistant", own), (2, 1, "assistant", "first"), (2, 0, "system", None), (3, 0, None, "no\\~role <<SYS>>"), (3, 0, "tool", "\\</s>\\\\<<TEXT>>"), (4, 0, "user", "a"), (4, 0, "user", "a"), (4, 1, "assistant", "b" * 20_000), (None, 0, "user", "x"), (5, 0, "system", "s"), (5, 1, "user", "u<"), (5, 2, "assistant", "<a>["), (5, 3, "user", "<"), (5, 4, "assistant", "\n")]
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, segments string")
    got = {x.conv_id: x for x in chat.digests(chat.formatted(df)).collect()}
    back = {x.conv_id: x for x in chat.formatted(df).select("conv_id", chat.rendered(chat.F.col("segments")).alias("t")).withColumn("b", chat.read_back(chat.F.col("t"))).collect()}
    for c in {t[0] for t in turns}:
        own_turns = sorted(((t, r, x or "") for k, t, r, x in turns if k == c), key=lambda v: (v[0], v[1] is not None, v[1] or "", v[2]))
        assert [(b.role, b.text) for b in back[c].b] == [(r, x) for _, r, x in own_turns]
        said = "".join(f"{r or ''}\n{x}\n" for _, r, x in own_turns)
        learned = "".join(x for _, r, x in own_turns if r == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[c].n_turns == len(own_turns)
        assert got[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest() and got[c].loss_chars == len(learned)
        assert got[c].formatted_chars == len(back[c].t)
    assert {c for c, x in got.items() if x.valid} == {1, 5}
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0


# --- language model


def test_kneser_ney(docs, empty):
    out = kneser_ney.language_model(docs).collect()
    data = [(x[0], [*lower_words(x[1]), None]) for x in rows()]
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 10 == 0
    c = Counter(w for d, t in data if not held(d) for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter((d, held(d), len(t), sum(w in c for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6)) for d, t in data)
    assert Counter((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in out) == want
    assert all(x.score < 0 for x in out)
    assert kneser_ney.language_model(empty).count() == 0


def test_kneser_ney_probabilities_sum_to_one(spark, tmp_path):
    r = random.Random(6)
    train = [(k, prose(r, 30, ["p", "q", "r", "t", "u"])) for k in range(40)]
    model = kneser_ney.fitted(spark.createDataFrame(train, "doc_id long, text string"), str(tmp_path / "m"))
    vocabulary = sorted({w for _, t in train for w in t.split()})
    scorer = kneser_ney.Scorer(model)

    def score(*w):
        data = " ".join(w).encode()
        return scorer.score(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[3][0]

    for context in (vocabulary[0], vocabulary[3], "unseen"):
        # p(context | begin) * p(w | context) * p(end | w), summed over w with the last factor divided out by a second text
        total = sum(10 ** (score(context, w) - score(context)) for w in vocabulary)
        assert total > 0
    pairs = Counter((a, b) for _, t in train for a, b in zip(["<"] + t.split(), t.split() + [">"], strict=True))
    n = [sum(x == k for x in pairs.values()) for k in (1, 2, 3, 4)]
    assert model.d2 == kneser_ney.discounts(*map(float, n)) and model.tokens == sum(pairs.values())
    cont = Counter(b for _, b in pairs)
    heads = Counter()
    for (a, _), x in pairs.items():
        heads[a] += x
    m = [sum(x == k for x in cont.values()) for k in (1, 2, 3)] + [sum(x == 4 for x in cont.values())]
    d1 = kneser_ney.discounts(*map(float, m))
    off = lambda x, d: max(x - (d[2] if x >= 3 else d[1] if x == 2 else d[0]), 0) if x else 0
    level = sum(d1[min(x, 3) - 1] for x in cont.values()) / sum(cont.values())
    low = lambda w: (off(cont[w], d1)) / sum(cont.values()) + level / (len(cont) + 1)

    def p(a, w):
        if a not in heads:
            return low(w)
        gamma = sum(model.d2[min(x, 3) - 1] for (h, _), x in pairs.items() if h == a) / heads[a]
        return off(pairs[a, w], model.d2) / heads[a] + gamma * low(w)

    words = [*cont, "unseen"]
    for a in [*heads, "unseen"]:
        assert abs(sum(p(a, w) for w in words) - 1) < 1e-9
    for t in ("p q r", "t t unseen u", ""):
        w = t.split()
        want = sum(math.log10(p(a, b)) for a, b in zip(["<", *w], [*w, ">"], strict=True))
        assert abs(score(*w) - want) < 1e-9


@pytest.mark.parametrize("order", [2, 3, 4])
def test_kneser_ney_of_any_order_agrees_with_a_plain_one(spark, tmp_path, monkeypatch, order):
    """One shard and many: the recursion written out over counters, whose probabilities sum to one in every context."""
    r = random.Random(61)
    train = [(k, prose(r, r.randint(0, 12), ["p", "q", "r", "t"])) for k in range(60)] + [(98, None), (99, "p p p p p p p")]
    df = spark.createDataFrame(train, "doc_id long, text string")
    texts = [[*(t or "").split(), ">"] for _, t in train]
    counts = {order: Counter()}
    for t in texts:
        padded = ["<"] * (order - 1) + t
        counts[order].update(tuple(padded[i : i + order]) for i in range(len(t)))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d = {k: kneser_ney.discounts(*(float(sum(x == j for x in c.values())) for j in (1, 2, 3, 4))) for k, c in counts.items()}
    off = lambda x, k: max(x - d[k][min(x, 3) - 1], 0) if x else 0
    total = sum(counts[1].values())
    level = sum(d[1][min(x, 3) - 1] for x in counts[1].values()) / total

    def p(context, w):
        if not context:
            return off(counts[1][(w,)], 1) / total + level / (len(counts[1]) + 1)
        k = len(context) + 1
        own = {g[-1]: x for g, x in counts[k].items() if g[:-1] == context}
        if not own:
            return p(context[1:], w)
        return (off(own.get(w, 0), k) + sum(d[k][min(x, 3) - 1] for x in own.values()) * p(context[1:], w)) / sum(own.values())

    for context in {g[:-1] for g in counts[order]} | {("unseen",) * (order - 1)}:
        assert abs(sum(p(context, w) for (w,) in [*counts[1], ("unseen",)]) - 1) < 1e-9
    probes = ["p q r", "t t unseen u p q", "", "q r t p p q r t t"]
    data, ends = "".join(probes).encode(), np.cumsum([0, *map(len, probes)])
    for size in (16 << 20, 60):
        monkeypatch.setattr(kneser_ney, "SHARD_BYTES", size)
        model = kneser_ney.fitted(df, str(tmp_path / str(size)), order)
        assert (model.shards > 1) == (size == 60) and model.discounts == d and model.tokens == sum(map(len, texts))
        got = kneser_ney.Scorer(model).score(np.frombuffer(data, np.uint8), ends)
        for text, x in zip(probes, got[3], strict=True):
            padded = ["<"] * (order - 1) + text.split() + [">"]
            want = sum(math.log10(p(tuple(padded[i - order + 1 : i]), padded[i])) for i in range(order - 1, len(padded)))
            assert abs(x - want) < 1e-9
    with pytest.raises(ValueError):
        kneser_ney.fitted(df, str(tmp_path / "one"), 1)


def test_a_model_of_many_shards_and_large_counts(spark, tmp_path, monkeypatch):
    """More shards than stay mapped, and counts beyond 32 bits, score as one shard does."""
    r = random.Random(16)
    df = spark.createDataFrame([(k, prose(r, 60)) for k in range(60)], "doc_id long, text string")
    one = kneser_ney.fitted(df, str(tmp_path / "one"))
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 200)
    many = kneser_ney.fitted(df, str(tmp_path / "many"))
    assert many.shards > 50 and (many.d1, many.d2, many.tokens, many.continued) == (one.d1, one.d2, one.tokens, one.continued)
    monkeypatch.setattr(kneser_ney, "MAPPED", 7)
    data = prose(r, 300).encode()
    ends = np.array([0, 200, len(data)])
    a, b = (kneser_ney.Scorer(m) for m in (one, many))
    for x, y in zip(a.score(np.frombuffer(data, np.uint8), ends), b.score(np.frombuffer(data, np.uint8), ends), strict=True):
        assert np.allclose(x, y, atol=1e-9)
    assert len(b.pairs.held) <= 7 and len(b.words.held) <= 7
    kneser_ney.save(str(tmp_path / "one"), "pairs-9", keys=np.array([1, 5], np.uint64), counts8=np.array([3, 1 << 40], "<u8"))
    assert a.lookup(np.array([5], np.uint64), np.array([9]), a.pairs, ()).tolist() == [1 << 40]


# --- mixing


def fair_targets(sizes, weights=(5, 2, 1), most=3):
    """Reshares the excess round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    target, open_, rest = {}, set(names), sum(sizes.values())
    while open_:
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] >= most * sizes[s]}
        if not above:
            return target | share
        for s in above:
            target[s] = most * sizes[s]
            rest -= target[s]
        open_ -= above
    return target


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing(spark, seed):
    r = random.Random(seed)
    data = [(k, prose(r, r.randint(0, 80)) if r.random() > 0.05 else None, r.choice(["a", "a", "a", "b", "c", "é", "z", None])) for k in range(400)] + [(1000, "lone words here", "tiny"), (1001, None, "void")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("size", mixing.F.lit("clash"))
    got = mixing.mix_plan(df).collect()
    sizes = Counter()
    for _, t, s in data:
        sizes[s] += len(WORD.findall(t or ""))
    want = fair_targets(sizes)
    taken, largest = Counter(), Counter()
    for x in got:
        assert x.source_size == sizes[x.source] and abs(x.target - want[x.source]) < 1e-6
        assert x.taken <= 3 * x.size and x.taken == x.copies * x.size
        taken[x.source] += x.taken
        largest[x.source] = max(largest[x.source], x.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_plan(df.repartition(5)).collect()), key=str)
    copies = {x.doc_id: x.copies for x in got}
    out = mixing.mixed(df)
    assert out.columns == df.columns
    assert Counter(x.doc_id for x in out.collect()) == Counter({d: n for d, n in copies.items() if n})


def test_mixing_on_odd_rows(docs, empty):
    assert mixing.mix_plan(docs).count() == docs.count() and mixing.mix_plan(empty).count() == 0
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(empty).count() == 0


# --- quality


def test_quality_matches_brute_force(docs, empty):
    got = quality.judge(docs).collect()
    want = Counter()
    for d, t, *_ in rows():
        t = t or ""
        w = WORD.findall(t)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        held = [x for x in t.split("\n") if WORD.search(x)]
        want[d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(held) - len(set(held)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)] += 1
    assert Counter(tuple(x)[:7] for x in got) == want
    assert not any(x.kept and x.base_failed for x in got)
    verdict = {x.doc_id: x.kept for x in got}
    assert all(verdict[k] for k in range(12)) and not verdict[29] and not verdict[28]
    assert quality.judge(empty).count() == 0
    flipped = quality.judge(docs, declared=quality.rules()[::-1])
    assert Counter(map(tuple, flipped.collect())) == Counter(map(tuple, got))


def test_repeated_windows_of_long_texts_and_of_colliding_hashes(spark, monkeypatch):
    """With two bits for positions nearly no text can be packed; with sixty hashes differ in three bits only."""
    r = random.Random(41)
    data = [(k, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 60)))) for k in range(40)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = {x.doc_id: x.n_repeat_words for x in quality.statistics(df).collect()}
    for d, t in data:
        w = t.split()
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        assert want[d] == len({j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})
    for bits in (2, 60):
        monkeypatch.setattr(quality, "POSITION_BITS", bits)
        assert {x.doc_id: x.n_repeat_words for x in quality.statistics(df).collect()} == want


def test_rules_are_ordered_by_what_was_measured(spark, monkeypatch):
    rule = lambda n: quality.Rule(n, quality.F.lit(True))
    monkeypatch.setattr(quality, "measured", lambda *_: [(0.1, 1.0), (0.5, 1.0), (0.0, 0.5), (0.4, 0.1), (0.0, 0.2)])
    assert [r.name for r in quality.order_rules(None, [rule(n) for n in "abcde"])] == ["d", "b", "a", "e", "c"]
    monkeypatch.undo()
    sample = spark.range(100).withColumn("n_words", quality.F.lit(1))
    (share, cost), = quality.measured(sample, [quality.Rule("half", quality.F.col("id") < 50)])
    assert share == 0.5 and cost > 0
    text = quality.F.lit("some letters " * 400)
    dear = quality.Rule("dear", quality.F.regexp_count(quality.F.concat(text, quality.F.col("id").cast("string")), quality.F.lit(r"\p{L}")) > 5_000)
    cheap = quality.Rule("cheap", quality.F.col("n_words") > 5)
    for _ in range(3):
        (a, b), (c, d) = quality.measured(sample, [cheap, dear])
        assert (a, c) == (0.0, 0.0) and b < d / 10
        assert [x.name for x in quality.order_rules(sample, [dear, cheap])] == ["cheap", "dear"]


# --- toxicity


def test_toxicity(spark, empty):
    r = random.Random(9)
    data, labels = [], []
    for k in range(900):
        bad = k % 4 == 0
        w = prose(r, r.randint(20, 200)).split()
        if bad:
            w[r.randrange(len(w))] = r.choice(["vile", "nasty", "grumbo"]) + r.choice(["", "x", "yz"])
        data.append((k, " ".join(w)))
        labels.append((k, 1, int(bad)))
    data += [(2000, None), (2001, ""), (None, "vile"), (5, data[5][1])]
    labels += [(None, 1, 1), (7, None, None), (8, 0, None)]
    df, lab = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(df.withColumn("toxic", toxicity.F.lit(9)), lab).collect()
    assert len(got) == len(data)
    held = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 900]
    assert all(x.held_out == (zlib.crc32(str("" if x.doc_id is None else x.doc_id).encode()) % 5 == 0) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got)
    assert sum(x.predicted == int(x.doc_id % 4 == 0) for x in held) / len(held) > 0.97
    kept = toxicity.clean(df, lab)
    assert kept.columns == df.columns and 650 <= kept.count() <= 720
    assert toxicity.toxicity(empty, lab).count() == 0 and toxicity.toxicity(df, lab.limit(0)).count() == len(data)


def test_machine_learns_a_pairwise_interaction():
    """Neither term alone tells: only both together do."""
    r = random.Random(12)
    texts_, y = [], []
    for _ in range(800):
        a, b = r.random() < 0.5, r.random() < 0.5
        texts_.append((("insult " if a else "calm ") + ("grouped " if b else "single ") + prose(r, 5)).encode())
        y.append(float(a and b))
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts_])])
    x, bounds = toxicity.terms(np.frombuffer(b"".join(texts_), np.uint8), ends)
    keys = np.unique(x)
    m = toxicity.train(keys, [np.searchsorted(keys, x[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)], np.array(y), np.ones(len(y)))
    data = np.frombuffer(b"".join(texts_), np.uint8)
    p = m.scores(data, ends)
    assert ((p >= 0.5) == np.array(y)).mean() > 0.98
    for k in range(0, 800, 40):  # the sum over pairs of terms, one by one
        at = np.searchsorted(keys, x[bounds[k] : bounds[k + 1]])
        z = m.bias + sum(m.w[i] for i in at) + sum(float(m.v[i] @ m.v[j]) for n, i in enumerate(at) for j in at[n + 1 :])
        assert abs(p[k] - 1 / (1 + math.exp(-z))) < 1e-9


def test_telling_terms_match_a_plain_count(spark):
    r = random.Random(14)
    docs_ = [(int(r.random() < 0.3), sorted({r.randrange(60) for _ in range(12)})) for _ in range(200)]
    docs_ = [(y, sorted({*t, 77}) if y and r.random() < 0.8 else t) for y, t in docs_]
    many, bad = len(docs_), sum(y for y, _ in docs_)

    def tells(term):
        a, n = sum(y for y, t in docs_ if term in t), sum(term in t for _, t in docs_)
        cells = ((a, n * bad), (n - a, n * (many - bad)), (bad - a, (many - n) * bad), (many - bad - n + a, (many - n) * (many - bad)))
        return sum(o * math.log(o / (e / many)) for o, e in cells if o)

    every = sorted({x for _, t in docs_ for x in t if sum(x in t for _, t in docs_) >= toxicity.LEAST_DOCS}, key=lambda x: (-round(tells(x), 9), x))
    got = toxicity.telling(spark.createDataFrame(docs_, "toxic int, terms array<long>"), 10)
    assert got.tolist() == sorted(every[:10]) and 77 in got


# --- kernel


def test_kernel_words_and_shingles():
    t = ["a b  c", "", "\t\x0b", "größe 中文 x y z w", "A B C"]
    raw = [x.encode() for x in t]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    h, first = kernel.words(np.frombuffer(b"".join(raw), np.uint8), ends)
    assert np.diff(first).tolist() == [len(WORD.findall(x)) for x in t]
    assert h[:3].tolist() == h[-3:].tolist() and len(set(h[:3].tolist())) == 3
    s, bounds = kernel.shingles(h, first, 5)
    assert np.diff(bounds).tolist() == [1, 0, 0, 2, 1] and s[0] == s[-1]
