"""The pipeline's stages on a small corpus: what each is for happens, and clean documents come through."""

import random

import pytest
from gristmill.llm.common import table

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    from tests.llm.test_operators import prose

    r = random.Random(21)
    clean = [prose(r, 120) for _ in range(120)]
    bad = [prose(r, 100) + " vilestuff " + prose(r, 20) for _ in range(60)]
    near = [c.replace(" ", " extra ", 1) for c in clean[:5]]
    data = [(k, t, "en", "s" + str(k % 3), len(t or "")) for k, t in enumerate([*clean, *bad, *near, clean[0], "", None])]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, int(120 <= k < 180)) for k in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, folder):
    docs = table(spark, folder, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = docs
    ids = {n: {x.doc_id for x in seen[n].collect()} for n in seen}
    assert set(range(120)) <= ids["toxicity"] and not ids["toxicity"] & set(range(120, 180))
    assert 185 not in ids["line_dedup"] and set(range(120)) <= ids["jaccard_join"]
    assert not ids["jaccard_join"] & set(range(180, 186))
    assert ids["packing"] == ids["mixing"] <= ids["jaccard_join"]


def test_run_is_the_stages_in_order(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "mixing", "packing"]
    assert corpus_pipeline.run(spark, folder).count() > 0


CLASHES = ["place", "whole", "last", "_copy", "copy", "row", "_id", "id", "hash", "_gone", "gone", "_text", "_alike", "class", "key", "bucket", "_word", "own", "of", "a.b"]


def brute_lines(docs):
    """(id, text) of documents without the lines that an earlier one is like, or that is like one that is, and so on."""
    from tests.llm.test_operators import classes_of, jaccard_of, line_sets

    sets = {(d, k): s for d, t in docs for k, s in line_sets(t).items()}
    root = classes_of(sorted(sets), lambda a, b: jaccard_of(sets[a], sets[b]) >= 0.8)
    out = []
    for d, t in docs:
        gone = {k for (e, k) in sets if e == d and root[e, k] != (e, k)}
        left = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone)
        if not gone or left.strip(" \t\n\x0b\f\r"):
            out.append((d, left if gone else t))
    return out


def brute_classes(docs):
    from tests.llm.test_operators import classes_of, jaccard_of, word_sets

    sets = word_sets(docs)
    root = classes_of(sorted(sets), lambda a, b: jaccard_of(sets[a], sets[b]) >= 0.8)
    return [(d, t) for d, t in docs if root[d] == d]


def test_stages_match_brute_force_and_keep_clashing_columns(spark):
    from collections import Counter

    from gristmill.llm import mixing
    from pyspark.sql import functions as F
    from tests.llm.test_operators import WORD, edited, fair_targets, prose

    r = random.Random(51)
    pool = [prose(r, r.randint(8, 40)) for _ in range(20)]
    data = [(k, "\n".join([prose(r, 12), *(r.choice(pool) for _ in range(r.randint(0, 3)))]) if k % 7 else edited(r, pool[k % 20].split(), 1)) for k in range(70)] + [(100, None), (101, "")]
    df = spark.createDataFrame([(d, t, "s" + str(d % 3), len(t or "")) for d, t in data], "doc_id long, text string, source string, n_chars long")
    df = df.withColumns({c: F.concat(F.lit(c + " "), F.col("doc_id").cast("string")) for c in CLASHES})
    kept = lambda out: sorted(((x.doc_id, x.text) for x in out.collect()), key=str)

    def untouched(out):
        assert out.columns == df.columns
        assert all(x[c] == f"{c} {x.doc_id}" for x in out.collect() for c in CLASHES)

    lines_ = corpus_pipeline.drop_repeated_lines(spark, df, "").cache()
    assert kept(lines_) == sorted(brute_lines(data), key=str) and all(x.n_chars == len(x.text or "") for x in lines_.collect())
    untouched(lines_)
    docs_ = corpus_pipeline.keep_one_of_each_class(spark, df, "").cache()
    assert kept(docs_) == sorted(brute_classes(data), key=str)
    untouched(docs_)
    mix = corpus_pipeline.mix_sources(spark, df, "").cache()
    untouched(mix)
    size = {d: len(WORD.findall(t or "")) for d, t in data}
    totals, taken = Counter(), Counter()
    for d in size:
        totals[f"s{d % 3}"] += size[d]
    for x in mix.collect():
        taken[x.source] += size[x.doc_id]
    for s, goal in fair_targets(totals).items():
        assert abs(taken[s] - goal) <= max(size.values()) / 2
    copies = {x.doc_id: x.copies for x in mixing.mix_plan(df).collect()}
    assert Counter(x.doc_id for x in mix.collect()) == Counter({d: n for d, n in copies.items() if n})
