"""What failed and what is kept between runs: side tables, cached answers, streams that are started again."""

import json

import pytest
from gristmill.functions import answers as K
from gristmill.operators import quarantine as Q
from gristmill.sources import files, sinks
from pyspark.sql import functions as F

from .test_engine import made_pdf


def broken_folder(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    good = made_pdf([["page one"], ["page two"]])
    (d / "good.pdf").write_bytes(good)
    (d / "locked.pdf").write_bytes(good.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R"))
    (d / "no.pdf").write_bytes(b"this is no pdf")
    (d / "cut.docx").write_bytes(b"PK\x03\x04 cut off")
    (d / "cut.xlsx").write_bytes(b"PK cut off too")
    (d / "empty.xlsx").write_bytes(b"")  # Spark passes over files without a byte
    (d / "old.doc").write_bytes(b"plain words in a .doc")
    (d / "note.txt").write_text("a note")
    sinks.write_workbook({"S": spark.createDataFrame([("a", 1)], "x string, y int")}, str(d / "good.xlsx"))
    return str(d)


def test_broken_files_do_not_stop_good_ones(spark, tmp_path):
    folder = broken_folder(spark, tmp_path)
    good, bad = Q.set_apart(files.tried_rows(spark, folder), str(tmp_path / "apart"), "path")
    name = lambda p: p.rsplit("/", 1)[-1]
    assert sorted((name(r.path), r.kind, r.cells[0]) for r in good.collect()) == [("good.pdf", "page", "page one"), ("good.pdf", "page", "page two"), ("good.xlsx", "row", "a"), ("good.xlsx", "row", "x"), ("note.txt", "text", "a note"), ("old.doc", "text", "plain words in a .doc")]
    told = {name(r.path): r for r in bad.collect()}
    assert sorted(told) == ["cut.docx", "cut.xlsx", "locked.pdf", "no.pdf"]
    assert told["cut.docx"].kind == "docx" and told["cut.docx"].error.startswith("BadZipFile") and told["no.pdf"].excerpt == "this is no pdf"
    assert "crypt" in told["locked.pdf"].error
    assert sorted(map(tuple, files.read_rows(spark, folder).collect())) == sorted(map(tuple, good.select(*files.read_rows(spark, folder).columns).collect()))
    Q.log_bad(bad, str(tmp_path / "errors"), "r1")
    Q.log_bad(bad, str(tmp_path / "errors"), "r1")  # done again
    Q.log_bad(bad.limit(1), str(tmp_path / "errors"), "r2")
    assert {r.run: r["count"] for r in spark.read.json(str(tmp_path / "errors")).groupBy("run").count().collect()} == {"r1": 4, "r2": 1}


def test_set_apart_of_all_good_all_bad_and_none(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, f"is_bad int, problem {Q.PROBLEM}")
    for k, (data, n_good, n_bad) in enumerate([((), 0, 0), (((1, None), (2, None)), 2, 0), (((1, ("k", "e", "x")),), 0, 1)]):
        good, bad = Q.set_apart(rows(*data), str(tmp_path / f"f{k}"), "is_bad")
        assert (good.count(), bad.count()) == (n_good, n_bad)
        assert good.columns == ["is_bad"] and bad.columns == ["is_bad", "kind", "error", "excerpt"]


def test_log_lines_that_do_not_parse_are_told(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"file": "a", "chunk": 1}\n\nbröken {"\n  \n{"file": "b"}\n[1]\n{"chunk": "x"}\n')
    tried = files.tried_log(spark, str(path), "file string, chunk int")
    assert sorted(((r.file, r.chunk) for r in Q.good_rows(tried).collect()), key=str) == [("a", 1), ("b", None)]
    bad = Q.bad_rows(tried, "path").collect()
    assert sorted(r.excerpt for r in bad) == sorted(['br?ken {"', '[1]', '{"chunk": "x"}'])
    assert all(r.path.endswith("log.jsonl") and r.kind == "json" for r in bad)


def calls_of(log):
    def factory():
        def client(prompt):
            with open(log, "a") as f:
                f.write(prompt + "\n")
            if "busy" in prompt:
                raise RuntimeError("busy")
            return json.dumps({"requirements": [{"req_id": prompt, "requirement": "must"}]}) if "odd" not in prompt else "odd"

        return client

    return factory


def test_a_second_run_asks_nothing_and_a_changed_row_once(spark, tmp_path):
    log, cache = str(tmp_path / "calls"), str(tmp_path / "cache")
    prompts = lambda *texts: spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "pos long, prompt string").withColumn("signature", F.sha2("prompt", 256))

    def run(name, *texts, **how):
        before = len(open(log).read().split("\n")) - 1 if (tmp_path / "calls").exists() else 0
        K.ask_new(prompts(*texts), cache, name, calls_of(log), retries=1, wait=lambda s: None, **how)
        return open(log).read().split("\n")[before:-1] if (tmp_path / "calls").exists() else []

    assert run("none") == []
    texts = ["a", "b", "c", "a", "odd", None]
    assert sorted(run("one", *texts)) == ["a", "b", "c", "odd"]  # each once
    assert run("two", *texts) == []
    assert run("three", *texts[:2], "c changed", *texts[3:]) == ["c changed"]
    assert run("four", *texts, "busy") == ["busy"] and run("five", *texts, "busy") == ["busy"]  # what failed is tried again
    assert sorted(run("waves", *[f"p{k}" for k in range(20)], waves=3, calls=2)) == sorted(f"p{k}" for k in range(20))
    assert {r.run: (r.asked, r.answered) for r in K.asked_counts(spark, cache).collect()} == {"one": (4, 4), "three": (1, 1), "four": (1, 0), "five": (1, 0), "waves": (20, 20)}
    told = {r.prompt: r for r in K.with_answers(prompts(*texts, "busy", "never"), cache).collect()}
    assert json.loads(told["a"].answer)["requirements"][0]["req_id"] == "a" and told["a"].error is None
    assert (told["busy"].answer, told["busy"].error, told["never"].error) == (None, "RuntimeError: busy", "not asked")
    good, bad = K.requirements_apart(K.with_answers(prompts(*texts, "busy"), cache), str(tmp_path / "apart"), "pos")
    assert sorted((r.pos, r.req_id) for r in good.collect()) == [(0, "a"), (1, "b"), (2, "c"), (3, "a")]
    assert sorted((r.pos, r.kind, r.error) for r in bad.collect()) == [(4, "answer", "no JSON in the answer"), (5, "call", "not asked"), (6, "call", "RuntimeError: busy")]


def test_a_run_that_broke_off_goes_on_behind_its_finished_waves(spark, tmp_path):
    log, cache = str(tmp_path / "calls"), str(tmp_path / "cache")
    prompts = spark.createDataFrame([(f"p{k}",) for k in range(12)], "prompt string").withColumn("signature", F.sha2("prompt", 256))

    class Stopped(Exception):
        pass

    real, waves = K.cached, []

    def stops(spark_, path):
        waves.append(path)
        if len(waves) == 3:
            raise Stopped
        return real(spark_, path)

    K.cached = stops
    try:
        with pytest.raises(Stopped):
            K.ask_new(prompts, cache, "run", calls_of(log), waves=4)
    finally:
        K.cached = real
    first = open(log).read().split()
    assert 0 < len(first) < 12
    K.ask_new(prompts, cache, "again", calls_of(log), waves=4)
    assert sorted(open(log).read().split()) == sorted(f"p{k}" for k in range(12))  # none twice
    assert K.with_answers(prompts, cache).where("answer is not null").count() == 12


