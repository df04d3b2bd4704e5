"""Centroid clustering, token alignment and license scans against plain versions, with odd rows."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from gristmill.llm import alignment, clustering, licenses
from gristmill.llm import queries as corpus_queries

FOLDER = "/root/testdata/sf0.001"

# --- clustering


def plain_lloyd(rows, k=40, rounds=5, dimensions=64):
    kept = [(i, tuple(max(min(math.floor(max(min(256 * float(x), 2.0**60), -(2.0**60))), 2**27), -(2**27)) for x in v)) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    points = np.array([p for _, p in kept], object)
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    at = [list(p) for _, p in order[:k]]
    nearest = lambda: np.stack([((points - np.array(c, object)) ** 2).sum(1) for c in at], 1)
    for _ in range(rounds):
        to = nearest().argmin(1)
        for c in set(to.tolist()):
            at[c] = [int(s) // int((to == c).sum()) for s in points[to == c].sum(0)]
    d = nearest()
    to = d.argmin(1)
    spent = Counter()
    for row, c in enumerate(to.tolist()):
        spent[c] += int(d[row, c])
    fits = lambda v: v if v < 1 << 63 else None
    return [(kept[row][0], c, int(d[row, c]), fits(spent[c]), fits(sum(spent.values())), hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()) for row, c in enumerate(to.tolist())]


def canon(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


def spread_vectors(seed, n, centres, width):
    r = np.random.default_rng(seed)
    near = r.normal(size=(centres, 64))
    return [(k, (near[r.integers(centres)] + width * r.normal(size=64)).tolist()) for k in range(n)]


@pytest.mark.parametrize("case", ["tight", "flat", "odd", "few", "huge"])
def test_clustering_matches_plain_lloyd(spark, case):
    rows = {"tight": lambda: spread_vectors(1, 900, 30, 0.01), "flat": lambda: spread_vectors(2, 300, 300, 1.0), "few": lambda: spread_vectors(3, 7, 3, 0.1)}.get(case, lambda: spread_vectors(4, 120, 9, 0.05))()
    if case == "odd":
        v = rows[0][1]
        rows += [(500 + k, v) for k in range(90)] + [rows[1], rows[1], (None, v), (None, rows[2][1])]
        rows += [(900, None), (901, []), (902, v[:-1]), (903, [*v, 1.0]), (904, [None, *v[1:]]), (905, [float("nan"), *v[1:]]), (906, [float("inf"), *v[1:]]), (907, [float("-inf"), *v[1:]]), (908, [-0.0] * 64), (909, [0.0] * 64)]
    if case == "huge":
        rows += [(700 + k, [(-1.0) ** k * 1e300 / (k + 1)] + [1e5 * k] * 63) for k in range(50)]
    df = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, point int, cell string").repartition(3)
    assert canon(clustering.clustered(df).collect()) == canon(plain_lloyd(rows))


def test_clustering_of_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    assert clustering.clustered(df).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert clustering.clustered(df).count() == clustering.clustered(df.limit(0)).count() == 0


def test_cover_tree_holds_its_bounds_and_prunes():
    r = np.random.default_rng(5)
    x = np.floor(256 * np.array([v for _, v in spread_vectors(6, 1500, 20, 0.01)])).astype(np.int64)
    x[100:140] = x[99]
    t = clustering.cover_tree(x, clustering.BUCKET)
    assert sorted(t.order.tolist()) == list(range(len(x))) and (t.points == x[t.order]).all()
    assert len(t.lo) > 20 and t.hi[0] - t.lo[0] == len(x)
    for node in range(len(t.lo)):
        far = lambda rows, node=node: np.sqrt(((t.points[rows] - t.points[t.centre[node]]) ** 2).sum(1))
        assert far(slice(t.lo[node], t.hi[node])).max() <= t.radius[node] + 1e-9
        children = t.children(node)
        assert [t.own[node], *[t.hi[c] for c in children]] == [*[t.lo[c] for c in children], t.hi[node]]
        centres = t.points[t.centre[children]]
        assert all(np.sqrt(((a - b) ** 2).sum()) > t.radius[node] / 2 for a, b in itertools.combinations(centres, 2))
    centroids = x[r.choice(len(x), 60, replace=False)]
    tree, numbers = clustering.centroid_tree(centroids)
    compared = []
    plain = clustering.squared
    clustering.squared = lambda a, b: (compared.append(len(a) * len(b)), plain(a, b))[1]
    try:
        found = clustering.nearest(t, tree, numbers)
    finally:
        clustering.squared = plain
    assert (found == plain(t.points, centroids).argmin(1)).all()
    assert sum(compared) < len(x) * len(centroids) / 4  # most pairs are pruned


# --- alignment


def plain_tokens(text):
    from tokenizers import Tokenizer

    if not hasattr(plain_tokens, "own"):
        import sentencepiece

        t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        t.encode_special_tokens = True
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {b: chr(b) for b in keep} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in keep)}
        plain_tokens.own = t, {c: b for b, c in chars.items()}, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    t, back, sp = plain_tokens.own
    if not text:
        return None
    a, b = t.encode(f" {text}", add_special_tokens=False).ids, sp.encode(text)
    of_a = [bytes(back[c] for c in t.id_to_token(k)) for k in a]
    of_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(sp.id_to_piece, b)]
    if b"".join(of_a) != f" {text}".encode() or b"".join(of_b) != f" {text}".encode():
        return None
    spans = lambda ids, pieces: [(k, e - len(p), e) for k, p, e in zip(ids, pieces, itertools.accumulate(map(len, pieces)), strict=True)]
    return spans(a, of_a), spans(b, of_b)


def plain_alignment(docs):
    found, count = [], Counter()
    for doc_id, text in docs:
        tokens = plain_tokens(text)
        links = [(x[0], y[0]) for x in tokens[0] for y in tokens[1] if x[1] < y[2] and y[1] < x[2]] if tokens else []
        count.update(links)
        found.append((doc_id, tokens, links))
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for doc_id, tokens, links in found:
        if not tokens:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b = tokens
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = [",".join(str(k) for k, s, e in a if low <= s < high) + "|" + ",".join(str(k) for k, s, e in b if low <= s < high) for low, high in itertools.pairwise([0, *cuts])]
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def odd_texts(seed=3):
    r = random.Random(seed)
    lexicon = "the of and 2024 größe naïve <s> </s> <unk> <0x41> <|endoftext|> 中文 😀 don't it's x=1; foo_bar http://a.b/c?d  \n \t \n\n ... été Łódź".split(" ")
    made = [" ".join(r.choice(lexicon) for _ in range(r.randint(1, 60))) for _ in range(30)]
    return [*made, made[0], made[0], "", None, " ", "  leading", "trailing  ", "▁ is a piece's mark", "▁", "a", "\n", "é decomposed", "ﬁ ligature", "\x00null\x00", "a" * 3_000, "word " * 2_000]


@pytest.mark.parametrize("frequent", [1 << 17, 20])
def test_alignment_matches_a_plain_version(spark, monkeypatch, frequent):
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    docs = [*enumerate(odd_texts()), (3, "another text of one id"), (None, "a text without an id"), (None, None)]
    df = spark.createDataFrame([(i, t, 1, 2, "x", 0) for i, t in docs], "doc_id long, text string, pair int, n int, best string, row int").repartition(3)
    found = alignment.alignment(df)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert canon(found.collect()) == canon(plain_alignment(docs))
    assert alignment.alignment(df.limit(0)).count() == 0


def test_alignment_query_over_the_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    short = {i for i, t in docs if len(t or "") < 1_500}  # the plain version compares all tokens with all
    found = {r.doc_id: r for r in corpus_queries.op12_token_alignment(spark, FOLDER).collect()}
    assert len(found) == len(docs)
    for i, n_a, n_b, n_groups, n_links, _, _, sha in plain_alignment([d for d in docs if d[0] in short]):
        assert (found[i].n_a, found[i].n_b, found[i].n_groups, found[i].n_links, found[i].groups_sha256) == (n_a, n_b, n_groups, n_links, sha)


def test_labels_groups_and_links_of_a_small_case():
    a, b = np.array([3, 1, 2]), np.array([2, 2, 2])  # token lengths
    label = alignment.byte_labels(a, b)
    assert alignment.LABELS[label].tobytes() == b".b" + b"a" + b"*" + b".*"
    assert [x.tolist() for x in alignment.token_groups(label)] == [[2, 1], [2, 1]]
    assert [(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in alignment.linked_pairs(label, np.array([7, 8, 9]), np.array([4, 5, 6]))] == [(7, 4), (7, 5), (8, 5), (9, 6)]


# --- licenses

PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(licenses.UPPER, licenses.LOWER)


def plain_licenses(text):
    w = PLAIN_WORD.findall((text or "").translate(LOWER))
    base, labels, score = [], set(), 0.0
    for t in licenses.templates():
        grams = {}
        for j in range(len(t["words"]) - t["k"] + 1):
            grams.setdefault(tuple(t["words"][j : j + t["k"]]), []).append(j)
        diagonals = {}
        for i in range(len(w) - t["k"] + 1):
            for j in grams.get(tuple(w[i : i + t["k"]]), ()):
                diagonals.setdefault(i - j, []).append((i, j))
        islands, last = [], None
        for d in sorted(diagonals):
            if last is None or d - last > t["slack"]:
                islands.append([])
            islands[-1] += diagonals[d]
            last = d
        for hits in islands:
            part = len({j + x for _, j in hits for x in range(t["k"])}) / len(t["words"])
            if part >= t["share"]:
                score = max(score, part)
                labels.add(t["label"])
                if t["base"]:
                    base.append((min(i for i, _ in hits), t["label"]))
    return len(w), len(base), min(base)[0] if base else None, max(base)[0] if base else None, ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score


def license_texts():
    r = random.Random(8)
    prose = lambda n: " ".join(r.choice(["the", "of", "license", "public", "rights", "software", "cc", "by", "all", "granted"]) for _ in range(n))
    notices = [" ".join(t["words"]) for t in licenses.templates()]
    edited = []
    for x in notices:
        w = x.split()
        for change in (lambda w: w[:-1], lambda w: w[:3] + ["inserted", "here"] + w[3:], lambda w: w[: len(w) // 2], lambda w: w[:4] + w[6:], lambda w: [*w[:2], "changed", *w[3:]]):
            edited.append(f"{prose(r.randint(0, 9))}. {', '.join(change(w)).title()}; {prose(r.randint(0, 9))}")
    phrases = ["CC BY", "cc-by CC/BY cc by", "all rights reserved " * 40, "General\nPublic\tLicense", "all rights all rights reserved reserved", "cc", "by cc", "xcc by", "cc byé", "ALL RİGHTS RESERVED", "All_Rights_Reserved", "general public", "cc by" * 30]
    odd = ["", None, "  ...  ", "中文 cc by 中文", "é all rights reserved", " ".join(notices * 3), prose(4_000), "cc\x00by", "😀 cc by 😀", "cc by " * 3_000]
    return [*notices, *edited, *phrases, *odd, *[prose(r.randint(1, 80)) for _ in range(40)]]


def test_licenses_match_a_plain_version(spark):
    docs = [*enumerate(license_texts()), (2, "cc by: another text of one id"), (2, "cc by: another text of one id"), (None, "no id, all rights reserved"), (None, None)]
    df = spark.createDataFrame([(i, t, "x", 1, False, 2) for i, t in docs], "doc_id long, text string, label string, w int, base boolean, n int").repartition(3)
    found = licenses.licenses(df)
    assert found.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert canon(found.collect()) == canon((i, *plain_licenses(t)) for i, t in docs)
    assert licenses.licenses(df.limit(0)).count() == 0


def test_license_spans_name_places(spark):
    df = spark.createDataFrame([(1, 5, "some words. Released under the MIT License. All rights reserved.")], "doc_id long, text_hash long, text string")
    assert sorted((r.label, r.start, r.stop, r.part) for r in licenses.spans(df).collect()) == [("mit", 2, 7, 1.0), ("reserved", 7, 10, 1.0)]
