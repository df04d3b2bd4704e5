"""The requirement engine: literal rows for each rule, round trips for each source, invariants of whole stages."""

import json
import zipfile

import pytest
from gristmill.functions import model as M
from gristmill.functions import predicates as P
from gristmill.functions import rules as R
from gristmill.functions import scalars as S
from gristmill.functions.text import casefold, strip, word_count
from gristmill.operators import ordered as O
from gristmill.operators import tables as T
from gristmill.plans import analyses as A
from gristmill.plans import stages as G
from gristmill.sources import files, sinks
from gristmill.streaming.progress import progress_event, run_progress
from pyspark.sql import functions as F


def values(spark, column, *rows):
    """The column over rows of (a, b)."""
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a string, b string")
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]



@pytest.fixture(autouse=True, scope="module")
def columns(spark):
    """Columns need a session."""
    globals().update(A_=F.col("a"), B_=F.col("b"))


def test_text_is_unicode_aware(spark):
    rows = [("größe über x", ""), ("\t a ", ""), ("Straße", ""), (None, "")]
    assert values(spark, word_count(strip(A_)), *rows) == [3, 1, 1, 0]
    assert values(spark, strip(A_), *rows)[1] == "a"
    assert values(spark, casefold(A_), *rows)[2] == "strasse"


def test_types_and_noise(spark):
    rows = [("CRU: Customer Replaceable Unit", ""), ("anything", "GLOSSARY"), ("text here", "RFP_PROCESS"), ("", ""), ("8GB", ""), ("ABC-12", ""), ("two words", ""), ("must comply", ""), ("three small words", ""), ("It should work", ""), ("It should really work", ""), ("a b c d e f g h", ""), ("four words are here", "")]
    assert values(spark, P.item_type(A_, B_), *rows) == ["glossary", "glossary", "note", "junk", "junk", "junk", "junk", "note", "note", "note", "requirement", "requirement", "note"]
    rows = [("5/5/26", ""), ("12 Jan 2026", ""), ("a@b.cd", ""), ("Doe, Jane <jd@x.com>", ""), ("✓", ""), ("n/a", ""), ("BIOS", ""), ("Argentina S-Mark", ""), ("Spec updated by all", ""), ("Nora Field", ""), ("CPU shall be fast", ""), ("", ""), ("5/5/26", "GLOSSARY"), ("中must中", "")]
    assert values(spark, P.is_noise(A_, B_), *rows) == [True] * 10 + [False, True, False, False]
    rows = [("a) two ports", ""), ("1. Memory shall be 8GB", ""), ("- one two three four five six seven eight nine", ""), ("plain", "")]
    assert values(spark, P.is_orphan(A_, F.lit("requirement"), F.lit(False)), *rows) == [True, False, False, False]


def test_rules_match_substrings_in_order(spark):
    book = R.RuleBook()
    rows = [("It should do", ""), ("must or should", ""), ("for REFERENCE", ""), ("nothing", ""), ("description of the device", "")]
    assert values(spark, R.must_level(A_, book), *rows) == ["SHOULD", "MUST", "INFO", "INFO", "INFO"]
    assert values(spark, R.category(F.lit("X"), A_, B_, book), *rows) == ["Compliance", "Compliance", "General", "General", "Legal"]
    assert values(spark, R.category(A_, F.lit(""), B_, book), ("BIOS-4", ""), ("bios-4", ""), ("HOST-1", "definition")) == ["BIOS", "General", "Glossary"]
    assert values(spark, R.spec_category(A_), ("UL listed", ""), ("ACME", ""), ("fUL", "")) == ["Certification", "Power", "General"]
    f = R.redflags(A_, B_, book)
    got = values(spark, f, ("high definition price", ""), ("FCC price", ""), ("x", "escrow"), ("x", ""))
    assert [g.status for g in got] == ["NEED_REVIEW", "NEED_REVIEW", "NEED_REVIEW", "AUTO_OK"]
    assert got[0].force_category == "Glossary" and got[1].force_category is None and len(got[1].messages) == 2 and got[1].forbid_llm_numbers and got[1].require_evidence
    assert values(spark, R.risk_tag(A_), ("RF_IP", ""), ("認證/法規：x", ""), ("see rf_price", ""), ("thermal-cycling", ""), ("other", "")) == ["IP/LEGAL", "CERT", "PRICING", "RELIABILITY", None]
    assert values(spark, R.owner(F.array(A_), B_, book), ("Storage", "RAID set"), ("Power", ""), ("Storage", "none")) == ["EE/Storage", "Power", "TBD"]


def test_rule_book_from_yaml(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "must_level_map.yaml").write_text("patterns:\n  MUST:\n    any: [zwingend]\n")
    (tmp_path / "redflags.yaml").write_text("rules:\n- id: R1\n  match: {any_keywords: [x]}\n  action: {force_status: NEW, force_category: [A]}\n")
    book = R.RuleBook.from_yaml(str(tmp_path))
    assert book.must[0] == ("MUST", ["zwingend"]) and book.categories == [] and book.redflags[0][:4] == ("R1", ["x"], "NEW", "A")


def test_scalars(spark):
    assert values(spark, S.row_id(A_), ("see HOST 36", ""), ("req_12", ""), ("SR-4.3.21", ""), ("R 1.2", ""), ("item 7", ""), ("x", "")) == ["HOST-36", "REQ-12", "SR-4.3.21", "R-1.2", "ITEM-7", ""]
    assert values(spark, S.duration(A_.cast("double")), ("59.5", ""), ("72", ""), ("7500", ""), ("2.5", "")) == ["1m 0s", "1m 12s", "2h 5m", "2s"]
    assert values(spark, S.elapsed(A_, B_), ("2026-01-01T00:00:00", "2026-01-01T01:05:09"), ("2026-01-01T00:00:10", "2026-01-01T00:00:00"), ("x", "y"), ("2026-01-01T00:00:00", "2026-01-01T00:03:07")) == ["1h5m", "-", "-", "3m7s"]
    assert values(spark, S.significant_tokens(A_), ("64 GB DDR5 at 2.0 GHz, FIPS 140", ""))[0] == ["64gb", "2.0ghz", "64", "2.0", "140", "ddr5", "fips140"]
    assert values(spark, S.new_tokens(A_, B_), ("needs 16 GB", "has 8 GB")) == [["16", "16gb"]]
    assert values(spark, S.source_ref_of_text(A_), ("a.docx#chunk5", ""), ("AUTO-b.xlsx", ""), ("c — Table 2, Row 4", "")) == ["a — 第 5 段", "b", "c — Table 2, Row 4"]
    assert values(spark, S.parsed_json(A_), ("<think>x</think>```json\n{\"chunk\": <chunk>}\n```", "")) == ['{"chunk": 0}']
    assert values(spark, S.summary_counts(A_), ("x\n=== Summary ===\n  processed : 3\n  skipped: 1\n", "")) == [{"processed": 3, "skipped": 1}]
    assert values(spark, S.masked(A_, ["key", "longkey"]), ("a longkey b key", "")) == ["a *** b ***"]
    assert values(spark, S.canonical_config(F.create_map(F.lit("b"), A_, F.lit("a"), B_)), ("1", "2")) == ['{"a":"2","b":"1"}']
    assert values(spark, S.suffix(A_.cast("int")), ("0", ""), ("25", ""), ("26", "")) == ["a", "z", "27"]


def test_ids(spark):
    rows = [("HOST-30", "x", ""), ("HOST-30", "[ROW_ID=HOST-30] x", ""), ("host-5", "x", "rule"), ("ROW_ID=2", "[row_id = 7]", ""), ("RFQ-HOST-001", "x", ""), ("RFQ-HOST-001-a", "x", "rule"), ("RFQ-12", "x", ""), ("RFQ-x y", "x", ""), ("AI-12", "x", ""), ("7", "x", "rule"), ("7", "x", "AI auto"), ("BIOS-BMC-5", "x", "rule"), ("1234", "x", "rule"), (None, "x", "")]
    df = spark.createDataFrame([("c", i, *r, None) for i, r in enumerate(rows)], "case_id string, pos long, req_id string, requirement string, rule string, notes string")
    got = [(r.id, r.id_source) for r in O.resolve_ids(df, F.col("rule")).orderBy("pos").collect()]
    assert [g[0] for g in got] == ["AI-001", "RFQ-HOST-030", "RFQ-HOST-005", "RFQ-TBL-002", "AI-002", "RFQ-HOST-001-a", "AI-003", "RFQ-x y", "AI-12", "RFQ-007", "AI-004", "RFQ-BIOS-BMC-5", "RFQ-1234", "AI-005"]
    assert [g[1][0] for g in got] == ["g", "o", "o", "o", "g", "o", "g", "o", "g", "o", "g", "o", "o", "g"]


def test_running_count_over_many_blocks(spark):
    df = spark.range(20_000).select((F.col("id") % 2).alias("case_id"), F.col("id").alias("pos"))
    got = O.running_count(df, F.col("pos") % 3 == 0, ["case_id"], "n", bits=6)
    assert got.where("case_id = 1").agg(F.max("n")).first()[0] == sum(k % 3 == 0 for k in range(1, 20_000, 2))
    assert got.where("pos = 9").first().n == 2


def test_keep_first_and_glue(spark):
    df = spark.createDataFrame([("c", 0, "CRU: fan"), ("c", 1, "It can be replaced by hand"), ("c", 2, "IT CAN BE REPLACED BY HAND"), ("c", 3, ""), ("c", 4, " ")], "case_id string, pos long, requirement string").withColumns({"file": F.lit("f"), "chunk": F.lit(1), "notes": F.lit("")})
    glued = O.glue_replaceable(df).orderBy("pos").collect()
    assert glued[1].requirement == "CRU It can be replaced by hand" and glued[1].notes == "SERVICEABILITY_GLUE" and glued[2].requirement == "IT CAN BE REPLACED BY HAND"
    assert [r.pos for r in O.dedup_by_text(df).orderBy("pos").collect()] == [0, 1, 3, 4]


def reference_split(t, most):
    """A plain loop with the same contract as packed_sentences."""
    import re

    t = t.strip()
    if not t:
        return []
    if len(t) <= most:
        return [t]
    out, buf = [], ""
    for s in (x.strip() for x in re.split(r"(?<=[.!?；。])\s+", t)):
        if not s:
            continue
        if len(buf) + len(s) + 1 <= most:
            buf = f"{buf} {s}".strip()
            continue
        if buf:
            out.append(buf)
        buf = s
        if len(s) > most:
            out += [p for p in (s[i : i + most].strip() for i in range(0, len(s), most)) if p]
            buf = ""
    return out + [buf] * bool(buf)


def test_chunking_against_a_loop(spark):
    import random

    r = random.Random(4)
    texts = [" ".join("".join(r.choice("abc") for _ in range(r.randint(1, 30))) + r.choice(["", ".", "!", "。"]) for _ in range(r.randint(0, 60))) for _ in range(40)]
    got = values(spark, O.packed_sentences(A_, 50), *[(t, "") for t in texts])
    assert got == [reference_split(t, 50) for t in texts]
    chunks = values(spark, O.packed_blocks(F.split(A_, r"\|"), 20, 2), ("aaa|bbb|ccc", ""), ("x" * 30 + "|y", ""), ("[ROW_ID=1] " + "z" * 40, ""))
    assert chunks == [["aaa\nbbb", "ccc"], ["x" * 20, "x" * 10, "y"], ["[ROW_ID=1] " + "z" * 40]]
    assert values(spark, O.paragraph_chunks(A_, 100), ("a\r\n\r\nb\n \nc", "")) == [["a", "b", "c"]]


def plain_pack(blocks, most, group_size):
    """A plain loop with the same contract as packed_blocks."""
    out, buf, n = [], [], 0
    flush = lambda: out.append("\n".join(buf).strip()) if buf else None
    for b in blocks:
        if len(b) > most:
            flush()
            out += [b] if "[ROW_ID=" in b else reference_split(b, most)
            buf, n = [], 0
            continue
        if buf and (len(buf) >= group_size or n + len(b) + 2 > most):
            flush()
            buf, n = [], 0
        buf.append(b)
        n += len(b) + 2
    flush()
    return out


def test_packed_blocks_against_a_loop(spark):
    import random

    r = random.Random(6)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 12))) + r.choice(["", "", ".", "!"])
    block = lambda: r.choice(["", "[ROW_ID=1] ", " "]) + " ".join(word() for _ in range(r.choice([0, 1, 2, 4, 30])))
    rows = [[block() for _ in range(r.randint(0, 25))] for _ in range(60)] + [[" " * 90, "a", " " * 90, "b", "c"], [], ["x" * 200]]
    df = spark.createDataFrame([(k, b) for k, b in enumerate(rows)] + [(999, None)], "i int, b array<string>").repartition(3)
    got = {x.i: x.c for x in df.select("i", O.packed_blocks(F.col("b"), 60, 4).alias("c")).collect()}
    assert not got.pop(999)
    assert got == {k: plain_pack(b, 60, 4) for k, b in enumerate(rows)}
    texts = [r.choice(["\n\n", "\r\n \r\n", "\n"]).join(" ".join(word() for _ in range(r.randint(0, 40))) for _ in range(r.randint(0, 8))) for _ in range(40)]
    import re

    paragraphs = lambda t: [p for b in re.split(r"\n\s*\n", t.replace("\r\n", "\n")) if b.strip() for p in reference_split(b.strip(), 50)]
    assert values(spark, O.paragraph_chunks(A_, 50), *[(t, "") for t in texts]) == [paragraphs(t) for t in texts]


def test_a_long_text_is_packed_in_linear_time(spark):
    import time

    def seconds(n):
        df = spark.range(1).select(F.repeat(F.lit("A sentence of some words. "), n).alias("t")).select(O.sentence_elements(F.col("t"), 600).alias("e"))
        began = time.time()
        assert df.select(F.size(O.packed(F.col("e"), 600)).alias("n")).first().n == -(-n // 23)
        return time.time() - began

    seconds(100)
    small, large = seconds(25_000), seconds(800_000)  # 20 MB
    assert large < 40 and large < 40 * max(small, 1)


def test_sheet_rows_and_best_row(spark):
    rows = O.sheet_rows(A_)
    got = values(spark, rows, ("[FILE:a b.xlsx SHEET:S 1 ROW 3] alpha beta [FILE:a b.xlsx SHEET:S 1 ROW 4] gamma", ""), ("[SHEET:T ROW 9] delta", ""), ("none", ""))
    assert [tuple(x) for x in got[0]] == [("a b.xlsx", "S 1", 3, "alpha beta"), ("a b.xlsx", "S 1", 4, "gamma")] and [tuple(x) for x in got[1]] == [("", "T", 9, "delta")] and got[2] == []
    assert values(spark, O.best_row(B_, rows)["row"], ("[SHEET:T ROW 1] one two [SHEET:T ROW 2] two three", "three two x"), ("[SHEET:T ROW 1] q [SHEET:T ROW 2] Whole", "whole"), ("", "x")) == [2, 2, None]


def test_best_rows_against_all_pairs(spark):
    import random

    from gristmill.operators.matching import best_rows

    r = random.Random(9)
    words = ["fan", "tray", "power", "supply", "unit", "must", "shall", "be", "hot", "hotswap", "a", "b12", "größe", "模組"]
    prose = lambda most: r.choice(["", " "]) + r.choice([" ", "  "]).join(r.choice(words) for _ in range(r.randint(0, most))) + r.choice(["", ".", " "])
    rows = [(r.choice(["f", "g"]), k, f"s{k % 3}", k % 7, r.choice([str.upper, str])(prose(8)) or "x") for k in range(90)]
    rows += [("g", 200, "s", 1, ""), ("h", 300, "s", 2, "only words that nothing shares"), ("h", 301, "s", 3, "zzz"), (None, 400, "s", 4, "no file")]
    items = [(r.choice(["f", "f", "g", "h", "none"]), k, prose(6)) for k in range(120)]
    items += [("f", 500 + k, x[4][1:9]) for k, x in enumerate(rows[:40])] + [("f", 600, None), ("f", 601, ""), ("f", 602, "  "), (None, 603, "file"), ("f", 604, "ower sup"), ("f", 605, "o"), ("h", 606, "zzzz zz")]
    split = lambda x: [w for w in re.split(r"\s+", x) if w]

    def plain(file, text):
        own = sorted((x for x in rows if (x[0] or "") == (file or "")), key=lambda x: x[1])
        t = (text or "").lower()
        inside = [x for x in own if t in x[4].lower() or x[4].lower() in t]
        best = inside[0] if inside else max(own, key=lambda x: len(set(split(x[4].lower())) & set(split(t))), default=None)
        return best and (best[2], best[3])

    import re

    df = best_rows(spark.createDataFrame(items, "file string, pos long, text string").repartition(3), spark.createDataFrame(rows, "file string, ord int, sheet string, row int, text string").repartition(3))
    got = {x.pos: x.sheet and (x.sheet, x.row) for x in df.collect()}
    assert got == {pos: plain(file, text) for file, pos, text in items}
    assert df.limit(0).columns == ["file", "pos", "text", "sheet", "row"]
    none = spark.createDataFrame([], "file string, ord int, sheet string, row int, text string")
    assert best_rows(spark.createDataFrame(items[:3], "file string, pos long, text string"), none).where("sheet is null").count() == 3


def test_best_rows_of_every_part(spark):
    from gristmill.operators.matching import best_rows

    rows = ["Alpha beta is  a gamma of delta", "beta is a gamma", "模組電源供應單元規格 is x", "a\tb c", "of delta and so on to the end", "unbroken-very-long-token"]
    items = sorted({x[i : i + n] for x in rows for i in range(len(x)) for n in (1, 2, 3, 7, 9, 12, 16, 21, 40)} | {f"so {x} it is" for x in rows})
    got = best_rows(spark.createDataFrame([("f", k, x) for k, x in enumerate(items)], "file string, pos long, text string"), spark.createDataFrame([("f", k, "s", k, x) for k, x in enumerate(rows)], "file string, ord int, sheet string, row int, text string"))
    want = {k: next(i for i, x in enumerate(rows) if t.lower() in x.lower() or x.lower() in t.lower()) for k, t in enumerate(items)}
    assert {x.pos: x.row for x in got.select("pos", "row").collect()} == want


def test_best_rows_keep_less_than_the_text(spark):
    import random
    from pathlib import Path

    from gristmill.operators.matching import best_rows
    from gristmill.operators.settle import shared_folder

    r = random.Random(3)
    texts = [" ".join(f"word{r.randrange(9000)}" for _ in range(60)) for _ in range(6000)]
    rows = spark.createDataFrame([("f", k, "s", k, x) for k, x in enumerate(texts)], "file string, ord int, sheet string, row int, text string")
    items = spark.createDataFrame([("f", k, x[20:300] if k % 20 else f"added {x}") for k, x in enumerate(texts) if k % 10 == 0], "file string, pos long, text string")
    folder = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    used = lambda: sum(p.stat().st_size for p in Path(folder).rglob("part-*"))
    before = used()
    assert best_rows(items, rows).where("pos = row").count() == 600
    assert used() - before < sum(map(len, texts))


def test_failure_gate(spark):
    df = spark.createDataFrame([("c", i, i in (3, 5, 11)) for i in range(20)], "case_id string, pos long, failed boolean")
    assert [r.pos for r in O.failure_gate(df, most=2, least_attempts=10, most_percent=50).where("abort").collect()] == [11]


ITEM = "case_id string, pos long, req_id string, requirement string, notes string, file string, chunk string, sheet string, row int, table int, table_row int, page int, derived boolean, spec_category string, must_level string, row_name string, table_name string"


def items(spark, *rows):
    return spark.createDataFrame([("c", i, *r, "a.docx", "1", None, None, None, None, None, False, None, None, None, None) for i, r in enumerate(rows)], ITEM)


def test_stages_end_to_end(spark):
    raw = items(spark, ("HOST-1", "The unit must have TPM and FCC certification for all ports", ""), ("", "RAM: Random Access Memory", ""), ("x", "part one must hold | part two shall be priced in USD", ""), ("", "5/5/2026", ""), ("", "", ""))
    out = G.format_items(G.enrich(raw)).orderBy("pos", "part").collect()
    assert [(r.req_id, r.type, r.must_level, r.status) for r in out] == [("AI-001", "requirement", "MUST", "NEED_REVIEW"), ("AI-002", "glossary", "INFO", "AUTO_SKIP"), ("AI-003-a", "requirement", "MUST", "NEED_REVIEW"), ("AI-003-b", "requirement", "MUST", "NEED_REVIEW")]
    assert out[0].risk_tags == ["CERT"] and out[0].source == "a — 第 1 段" and out[3].original_id == "x-b"
    clean = spark.createDataFrame(out, G.format_items(G.enrich(raw)).schema)
    answers = spark.createDataFrame([("c", "AI-001", "COMPLIANT", "yes", None, None, "Final", False, None), ("c", "AI-003-a", None, None, "gap", None, None, True, "later")], "case_id string, req_id string, status string, vendor_comment string, gap string, ai_draft string, final_requirement string, exclude_from_matrix boolean, exclude_reason string")
    sheets = {(r.sheet, r["Req ID"]): r for r in G.export(clean, answers).collect()}
    assert set(sheets) == {("Compliance Matrix", "AI-001"), ("3. Hardware", "AI-001"), ("Glossary", "AI-002"), ("Excluded", "AI-003-a"), ("Compliance Matrix", "AI-003-b"), ("8. Others", "AI-003-b")}
    assert sheets["Excluded", "AI-003-a"]["Gap / Notes"] == "[EXCLUDED: later] gap" and sheets["Compliance Matrix", "AI-001"]["PM Reviewed Requirement"] == "Final"
    merged = T.merge_responses(clean, answers)
    total = {r.group: r.total for r in T.category_summary(merged.where(T.sheet(merged) == "Main")).collect()}
    assert total == {"Hardware": 1, "Others": 1, "Total": 2}
    assert G.format_items(G.enrich(raw.limit(0))).count() == 0


def test_workbook_round_trip(spark, tmp_path):
    path = str(tmp_path / "in" / "out.xlsx")
    (tmp_path / "in").mkdir()
    sinks.write_workbook({"Compliance Matrix": spark.createDataFrame([("R1", "x < y & z", 2)], "id string, t string, n int"), "Other": spark.range(2)}, path)
    rows = files.read_rows(spark, str(tmp_path / "in")).collect()
    assert [(r.sheet, r.row, r.cells) for r in rows] == [("Compliance Matrix", 1, ["id", "t", "n"]), ("Compliance Matrix", 2, ["R1", "x < y & z", "2"]), ("Other", 1, ["id"]), ("Other", 2, ["0"]), ("Other", 3, ["1"])]
    assert files.row_counts(files.read_rows(spark, str(tmp_path / "in"))).first().data_rows == 1


def sheet_frame(spark, name, rows):
    return spark.createDataFrame([(f"/x/{name}", i, "row", "S", None, i + 1, list(map(str, r))) for i, r in enumerate(rows)], files.BLOCK)


def test_sheet_readers(spark):
    df = sheet_frame(spark, "q.xlsx", [["ID", "Question", "Answer"], ["1", "Need A", "yes"], ["", "Need B", ""], ["3", "", "x"]])
    assert [(r.req_id, r.requirement, r.notes, r.row) for r in files.simple_list(df).orderBy("row").collect()] == [("1", "Need A", "yes", 2), ("AUTO-q.xlsx-2", "Need B", "", 3)]
    df = sheet_frame(spark, "s.xlsx", [["", "M1", "", "M2"], ["CPU", "4", "", "8"], ["Note", "", "", ""]])
    assert [(r.req_id, r.requirement, r.spec_category) for r in files.spec_reference(df).orderBy("row").collect()] == [("AUTO-s.xlsx-1", "CPU: M1: 4, 8", "CPU"), ("AUTO-s.xlsx-2", "Note", "General")]
    df = sheet_frame(spark, "c.xlsx", [["title", "", "", "", ""], ["Ref", "Requirement", "Priority", "Comply", "Comment"], ["1.1", "Must boot", "M", "Y", "ok"], ["2", "Section", "", "", ""], ["", "A longer text of words", "", "N", ""]])
    h = files.checklist_headers(df).first()
    assert (h.header_row, h.ref, h.label, h.priority, h.comply, h.note) == (2, 0, 1, 2, 3, 4)
    assert [(r.req_id, r.must_level, r.notes) for r in files.checklist(df).orderBy("row").collect()] == [("1.1", "MUST", "Comply: Y | ok"), ("AUTO-c.xlsx-S-5", "INFO", "Comply: N")]
    assert files.sheet_blocks(df).where("row = 3").first().block == "[FILE:c.xlsx SHEET:S ROW 3] 1.1 | Must boot | M | Y | ok"


def test_docx_reader(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    row = lambda *cs: "<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cs) + "</w:tr>"
    body = p("Hello  there") + p(" ") + f"<w:tbl>{row('Item', 'Requirement', 'Comment')}{row('HOST 3', 'Must run', 'soon')}{row('', 'BIOS 4 boots', '')}</w:tbl><w:tbl>{row('a', 'b')}{row('x', 'REQ-7')}</w:tbl>"
    d = tmp_path / "docs"
    d.mkdir()
    with zipfile.ZipFile(d / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    (d / "old.doc").write_bytes("plain \xff text".encode("latin-1"))
    got = [r.block for r in files.docx_blocks(files.read_rows(spark, str(d))).orderBy("path", "ord").collect()]
    assert got == ["Hello there", "[TABLE 1 ROW 2][ROW_ID=HOST 3] Must run [IBM_COMMENT: soon]", "[TABLE 1 ROW 3][ROW_ID=BIOS-4] BIOS 4 boots", "[TABLE 2 ROW 2] [ROW_ID=REQ-7] x | REQ-7", "plain  text"]
    m = files.manifest(spark, str(d), spark.createDataFrame([("old.doc",)], "name string")).collect()
    assert [x.name for x in m] == ["a.docx"] and len(m[0].sha256) == 64


def test_text_sources_and_logs(spark, tmp_path):
    (tmp_path / "c1").mkdir()
    (tmp_path / "c1" / "a.txt").write_bytes(b"\xef\xbb\xbfThe unit shall work\r\n- two words only")
    (tmp_path / "c1" / "b.md").write_bytes("規格".encode("cp950"))
    rows = {(S_.path[-5:], S_.line_no): S_.line for S_ in files.text_lines(spark, str(tmp_path)).collect()}
    assert rows["a.txt", 1] == "The unit shall work" and rows["/b.md", 1] == "規格"
    assert [r.case_id for r in files.cases(spark, str(tmp_path)).collect()] == ["c1"]
    log = tmp_path / "log.jsonl"
    log.write_text('{"file": "a", "chunk": 1}\nbroken\n{"file": "a", "chunk": 2, "failed_chunk": true}\n')
    done = files.json_log(spark, str(log), "file string, chunk int, failed_chunk boolean")
    chunks = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3)], "file string, chunk int")
    assert [r.chunk for r in T.todo_chunks(chunks, done).collect()] == [3]
    assert sorted(r.chunk for r in T.todo_chunks(chunks, done, retry_failed=True).collect()) == [2, 3]
    sel = spark.createDataFrame([("c", json.dumps({"a.txt": {"include": False, "reason": "x"}, "b.txt": {"include": None, "reason": ""}}))], "case_id string, j string")
    assert {r.key: r.include for r in files.json_map(sel, "j", "struct<include:boolean,reason:string>").collect()} == {"a.txt": False, "b.txt": None}
    sinks.append_log(chunks, str(tmp_path / "out"))
    sinks.append_log(chunks, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 6
    assert sinks.write_once(chunks, str(tmp_path / "once")).count() == sinks.write_once(chunks.limit(0), str(tmp_path / "once")).count() == 3


def test_cache_over_three_runs(spark):
    files_ = spark.createDataFrame([("c", 0, "spec.docx", "/spec.docx", 10, "t", "h1")], "case_id string, ord int, name string, path string, size long, mtime string, sha256 string")
    its = spark.createDataFrame([("c", 0, "R1", "requirement", "one", "", "spec — x"), ("c", 1, "R2", "requirement", "two", "", ""), ("c", 2, "N1", "note", "n", "", "")], "case_id string, pos long, req_id string, type string, requirement string, normalized_requirement string, source string")
    cur, fcur = A.item_metas(its, files_, "m"), A.file_metas(files_, "m")

    def summary(prev, fprev, c=cur, f=fcur):
        r = A.cache_summary(A.decisions(c, A.kept_metas(prev)), A.decisions(f, A.kept_metas(fprev))).first()
        return r.total, r.reused, r.skipped_files, r.saved

    assert summary(cur.limit(0), fcur.limit(0)) == (2, 0, 0, "0s")
    assert summary(cur, fcur) == (2, 2, 1, "3s")
    moved = files_.withColumn("sha256", F.lit("h2"))
    assert summary(cur, fcur, A.item_metas(its, moved, "m"), A.file_metas(moved, "m")) == (2, 0, 0, "0s")
    assert A.decisions(A.item_metas(its, files_, "other"), A.kept_metas(cur)).first().changed_fields == "model_name"


def test_upsert_and_progress(spark, tmp_path):
    log = spark.createDataFrame([("r", 1, "NEW", None), ("r", 2, None, "c"), ("r", 3, "DONE", None)], "req_id string, seq int, status string, comment string")
    r = T.upserted(log, ["req_id"], "seq").first()
    assert (r.status, r.comment, r.seq) == ("DONE", "c", 3)
    lines = ["[PROGRESS] a.docx chunk 3/9", "[PROGRESS] enrich item 4/8 req_id=R1", "[INFO] a.docx: 9 chunks", "[WARN] LLM call failed (attempt 1/3): boom -> sleep 2.5s", " [2/5] Q7", "hello"]
    got = values(spark, progress_event(A_), *[(x, "") for x in lines])
    assert [g and g.kind for g in got] == ["chunk", "item", "chunks_total", "retry", "item", None] and got[3].sleep_s == 2.5 and got[1].req_id == "R1"
    folder = str(tmp_path / "log")
    spark.createDataFrame([("run", i, x) for i, x in enumerate(lines)], "run string, seq long, line string").write.json(folder)
    state = run_progress(spark, folder, str(tmp_path / "o"), str(tmp_path / "c")).first()
    assert (state.chunk_done, state.chunk_total, state.item_done, state.events, state.lines) == (3, 9, 2, 5, 6)


def test_model_interface(spark):
    assert M.repaired('{"a": 1} {"b"') == {"a": 1}
    assert M.repaired('x {"requirements": [{"a": 1}, {"b": 2') == {"requirements": [{"a": 1}]}
    assert M.repaired('{"requirements": [{"b": 2') == {"requirements": []}
    with pytest.raises(ValueError):
        M.repaired("nothing")
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise RuntimeError("busy")
        return "ok"

    waits = []
    assert M.answered(flaky, "p", wait=waits.append) == ("ok", None) and waits == [1, 2]
    df = spark.createDataFrame([("c", 1, "p1")], "case_id string, pos long, prompt string")
    out = M.asked(df, "prompt", lambda: lambda p: '{"requirements": [{"req_id": "R", "requirement": "must ' + p + '"}, {"req_id": "cut')
    assert [(r.k, r.requirement) for r in M.extracted(M.parsed_answers(out)).collect()] == [(1, "must p1")]
    its = spark.createDataFrame([("c", 1, "has 8 GB", "", "s")], "case_id string, pos long, requirement string, notes string, source string")
    said = spark.createDataFrame([("c", 1, json.dumps({"normalized_requirement": "shall have 16 GB", "rewrite_reason": "fragment_to_standalone", "rewrite_confidence": 0.9}))], "case_id string, pos long, json string")
    r = M.normalized(its, said).first()
    assert (r.rewrite_reason, r.rewrite_confidence, r.needs_rewrite_review, r.audit_new_tokens) == ("ambiguous_needs_review", 0.5, True, ["16", "16gb"])
    assert M.front_matter("---\nname: x\n---\nbody {payload_json}") == ({"name": "x"}, "body {payload_json}")
    assert M.rendered("<{payload_json}>", its.select("pos")).first().prompt == '<{"pos":1}>'


def test_whole_sorts_and_first_rows_of_each_case(spark):
    df = spark.createDataFrame([("c%d" % (k % 3), k, "requirement", k * 7919 % 1000) for k in range(1000)], "case_id string, pos long, type string, x long")
    assert [(r.rank, r.x) for r in T.ranked_rows(df, [F.col("x")]).orderBy("rank").collect()] == [(k + 1, k) for k in range(1000)]
    first = T.items_to_normalize(df, sample=5).collect()
    assert {(r.case_id, r.pos) for r in first} == {("c%d" % (k % 3), k) for k in range(15)}


def test_rows_beyond_a_sheet_go_on_in_further_ones(spark, tmp_path):
    path = str(tmp_path / "book.xlsx")
    sinks.write_workbook({"Main": spark.range(7).orderBy("id"), "Full": spark.range(3).orderBy("id"), "None": spark.range(0)}, path, most_rows=3)
    with zipfile.ZipFile(path) as z:
        book = z.read("xl/workbook.xml").decode()
        counts = [z.read(f"xl/worksheets/sheet{n}.xml").decode().count("<row ") - 1 for n in range(1, 6)]
    assert counts == [3, 3, 1, 3, 0]
    assert [x.split('"')[0] for x in book.split('<sheet name="')[1:]] == ["Main", "Main (2)", "Main (3)", "Full", "None"]


def made_pdf(pages, compress=True, wide=False):
    """A PDF file of one font whose pages show the given lines."""
    import zlib

    head = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", head]
    if wide:
        objects[2] = b"<< /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >>"
        objects.append(b"<< /Length 60 >>\nstream\n1 beginbfrange\n<0001> <005F> <0020>\nendbfrange\n1 beginbfchar\n<00FF> <4E2D>\nendbfchar\nendstream")
    kids = []
    for lines in pages:
        shown = lambda t: b"<" + b"".join(b"%04X" % (0xFF if c == "中" else ord(c) - 31) for c in t) + b">" if wide else b"(" + t.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode("cp1252") + b")"
        body = b"BT /F1 12 Tf " + b" ".join(b"0 -14 Td " + shown(t) + b" Tj" for t in lines) + b" ET"
        data, kind = (zlib.compress(body), b"/Filter /FlateDecode ") if compress else (body, b"")
        objects.append(b"<< " + kind + b"/Length %d >>\nstream\n" % len(data) + data + b"\nendstream")
        objects.append(b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % len(objects))
        kids.append(len(objects))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n" % k + o + b"\nendobj" for k, o in enumerate(objects, 1)) + b"\ntrailer << /Root 1 0 R >>\n%%EOF"


def test_pdf_pages(spark, tmp_path):
    from gristmill.sources.pdf import page_texts

    pages = [["The system (all of it) shall boot", "back\\slash"], [], ["third page"]]
    want = [(1, "The system (all of it) shall boot back\\slash"), (3, "third page")]
    assert list(page_texts(made_pdf(pages))) == want == list(page_texts(made_pdf(pages, compress=False)))
    assert list(page_texts(made_pdf([["wide 中 text"]], wide=True))) == [(1, "wide 中 text")]
    assert list(page_texts(b"%PDF-1.4 nothing here")) == []
    with pytest.raises(ValueError):
        list(page_texts(b"no pdf"))
    (tmp_path / "a.pdf").write_bytes(made_pdf(pages))
    got = files.page_blocks(files.read_rows(spark, str(tmp_path))).orderBy("page").collect()
    assert [(x.page, x.block) for x in got] == [(n, f"[PDF PAGE {n}] {t}") for n, t in want]


def block(path, at, cells, kind="row", sheet=None, table=None, row=None):
    return (path, at, kind, sheet, table, row, cells)


def sample_rows(spark):
    rows = [block("/d/a.docx", k, [f"paragraph {k}"], "paragraph") for k in range(100)]
    rows += [block("/d/a.docx", 100 + 10 * t + r, [f"id{t}.{r}", "", f"text {r}"], table=t, row=r) for t in range(1, 13) for r in range(1, 8)]
    rows += [block("/d/b.xlsx", 10 * s + r, [str(k) for k in range(12)], sheet=f"S{s}", row=r) for s in range(6) for r in range(1, 10)]
    rows += [block("/d/c.pdf", p, ["x" * 900], "page", row=p) for p in range(1, 9)]
    return spark.createDataFrame(rows, files.BLOCK)


def test_head_samples_are_bounded(spark):
    from gristmill.plans import inference

    got = {x.path: x.sample.split("\n") for x in inference.head_samples(sample_rows(spark)).collect()}
    a, b, c = (got[f"/d/{n}"] for n in ("a.docx", "b.xlsx", "c.pdf"))
    assert a[:3] == ["File: a.docx", "paragraph 0", "paragraph 1"] and sum(x.startswith("paragraph") for x in a) == 40
    assert "Table 1 row 2: id1.2 | text 2" in a and "Table 1 id: id1.4" in a and "Table 1 id: id1.5" not in a and not any(x.startswith("Table 11") for x in a)
    assert sum(" row " in x for x in b) == 16 and b[1] == "Sheet S0 row 1: 0 | 1 | 2 | 3 | 4 | 5 | 6 | 7"
    assert len(c) == 6 and c[1] == "Page 1: " + "x" * 500


def test_head_samples_show_wide_table_rows_whole(spark):
    from gristmill.plans import inference

    cells = [f"c{k}" for k in range(1_500)]
    rows = [block("/d/a.docx", 0, cells, "paragraph"), block("/d/a.docx", 1, [*cells, ""], table=1, row=1), block("/d/b.xlsx", 0, cells, sheet="S", row=1)]
    got = {x.path: x.sample.split("\n")[1:] for x in inference.head_samples(spark.createDataFrame(rows, files.BLOCK)).collect()}
    assert got == {"/d/a.docx": [" | ".join(cells), "Table 1 row 1: " + " | ".join(cells)], "/d/b.xlsx": ["Sheet S row 1: " + " | ".join(cells[:8])]}


def test_schemas_are_inferred_by_file_and_case(spark):
    from gristmill.plans import inference

    def factory():
        def client(prompt):
            if "one document" in prompt:
                if "b.xlsx" in prompt:
                    return "no json"
                name = "a.docx" if "a.docx" in prompt else "c.pdf"
                return json.dumps({"file": name, "format": "matrix", "is_main_requirement": name == "a.docx", "confidence": 0.8})
            if "first rows of the sheet" in prompt:
                return '{"header_row": 1, "req_id_col": 0, "requirement_col": 2}' if "S1" in prompt else "{}"
            files_ = json.loads(next(x for x in prompt.split("\n") if x.startswith("[")))
            return json.dumps({"rfq_format": "matrix", "main_files": [f["file"] for f in files_ if f["is_main_requirement"]]})

        return client

    samples = inference.head_samples(sample_rows(spark)).withColumn("case_id", F.lit("k"))
    found = inference.file_schemas(samples, factory).cache()
    assert {x.file: (x.format, x.is_main_requirement, x.confidence) for x in found.collect()} == {"a.docx": ("matrix", True, 0.8), "b.xlsx": ("unknown", False, 0.0), "c.pdf": ("matrix", False, 0.8)}
    case = inference.case_schema(found, factory).collect()
    assert len(case) == 1 and (case[0].case_id, case[0].main_files) == ("k", ["a.docx"]) and inference.case_schema(found.limit(0), factory).count() == 0
    columns_ = {x.sheet: x.requirement_col for x in inference.sheet_columns(sample_rows(spark), factory).collect()}
    assert columns_["S1"] == 2 and columns_["S0"] is None


def test_schemas_are_inferred_once_a_case(spark, tmp_path):
    """Each prompt is one line of a log: a case that is kept costs none, one without a readable answer is asked again."""
    from gristmill.plans import inference

    log = tmp_path / "asked"

    def factory():
        def client(prompt):
            with open(log, "a") as f:
                f.write(prompt.split("\n")[0][:20] + "\n")
            if "one document" in prompt:
                return "{'file': 'x.docx', 'table_cols': 'id, text',}" if "new" in prompt else '{"file": "y.docx", "is_main_requirement": true}'
            return "none" if "x.docx" in prompt else '{"main_files": ["y.docx"], "table_structure": {"id_col": "Ref"}}'

        return client

    sample = lambda *rows: spark.createDataFrame(list(rows), "case_id string, path string, sample string")
    asked = lambda: len(log.read_text().split("\n")) - 1 if log.exists() else 0
    path, first, second = str(tmp_path / "kept"), ("a", "/a/y.docx", "old"), ("b", "/b/x.docx", "new")
    got = inference.case_schemas_once(sample(first), path, factory).collect()
    assert [(x.case_id, x.main_files, x.table_structure.id_col) for x in got] == [("a", ["y.docx"], "Ref")] and asked() == 2
    assert inference.case_schemas_once(sample(first), path, factory).count() == 1 and asked() == 2
    got = inference.case_schemas_once(sample(first, second), path, factory).collect()
    assert [x.case_id for x in got] == ["a"] and asked() == 4
    assert inference.case_schemas_once(sample(second), path, factory).count() == 0 and asked() == 6
    assert inference.case_schemas_once(sample(first).limit(0), path, factory).count() == 0 and asked() == 6


def test_a_comparison_reads_as_a_text(spark, tmp_path):
    items = "case_id string, pos long, req_id string, type string, requirement string, category string, owner string, must_level string, status string"
    left = spark.createDataFrame([("c", 1, "R1", "requirement", "x", "BIOS, Fan", "QA", "MUST", "NEW"), ("c", 2, "R1", "requirement", "", None, None, None, "")], items)
    right = spark.createDataFrame([("c", 1, "R1", "note", None, "BIOS", "QA", "MUST", "NEW")], items)
    sinks.write_report(T.compare_report(left, right), str(tmp_path / "report"))
    text = spark.read.text(str(tmp_path / "report"), wholetext=True).first().value
    assert text.startswith("## Counts\n\n| metric | left | right |\n|---|---|---|\n| total_items | 2 | 1 |\n| requirements | 2 | 0 |\n")
    assert "## Ids that occur twice\n- left, c: 1 (R1)\n## Categories" in text
    assert "|---|---|---|\n| (none) | 1 | 0 |\n| BIOS | 1 | 0 |\n## Levels" in text and text.endswith("| (none) | 1 | 0 |\n| NEW | 1 | 0 |\n")
    assert T.compare_report(left.limit(0), right.limit(0)).where("ord = 0").count() == 5


def test_model_enrichment_overrides_by_field(spark):
    from gristmill.plans import inference

    items = spark.createDataFrame([("c", 1, "Fans {notes}", "quiet", "INFO", ["General"], "TBD", "PENDING", ["old"]), ("c", 2, "Bad answer", None, "MAY", ["BIOS"], "BIOS", "PENDING", [])], "case_id string, pos long, requirement string, notes string, must_level string, category array<string>, owner string, status string, redflag_messages array<string>")
    prompts = [x.prompt for x in inference.enrich_prompts(items).orderBy("pos").collect()]
    assert "Requirement: Fans {notes}" in prompts[0] and "Notes: quiet" in prompts[0] and "RF_CERT: FIPS" in prompts[0]

    def factory():
        return lambda p: '{"must_level": "MUST", "owner": "", "redflag_message": "loud", "stakeholder": ["PM"]}' if "Fans" in p else "broken"

    got = {x.pos: x for x in inference.model_enriched(items, factory).collect()}
    assert (got[1].must_level, got[1].owner, got[1].redflag_messages, got[1].stakeholder, got[1].llm_enriched) == ("MUST", "TBD", ["loud"], ["PM"], True)
    assert (got[2].must_level, got[2].owner, got[2].redflag_messages, got[2].llm_enriched) == ("MAY", "BIOS", [], False)
    flagged = items.withColumn("redflag_overrides", F.struct(F.lit("Thermal").alias("force_category"), F.lit(None).cast("boolean").alias("require_evidence")))
    said = spark.createDataFrame([("c", 1, '{"redflag": ["RF_IP"], "stakeholder": "PM", "type": "note"}'), ("c", 2, "{}")], "case_id string, pos long, json string")
    got = {x.pos: x for x in M.enriched(flagged, said).collect()}
    assert (got[1].redflag_overrides.require_evidence, got[1].redflag_overrides.force_category, got[1].redflag_messages, got[1].stakeholder) == (True, None, [], ["PM"])
    assert (got[2].redflag_overrides.force_category, got[2].llm_enriched, got[2].stakeholder) == ("Thermal", False, [])
    rows = spark.createDataFrame([(1, None, None), (2, "", None), (3, None, [])], "i int, owner string, category array<string>")
    assert [x.e for x in rows.orderBy("i").select(P.is_enriched(rows.columns).alias("e")).collect()] == [False, True, True]
    assert [x.e for x in rows.select(P.is_enriched(["i"]).alias("e")).collect()] == [False] * 3
    assert [x.req_id for x in inference.mock_items(spark).collect()] == ["BIOS-4", "HOST-36", "AUTO-mock-1-001"]


def test_settings_and_models():
    from gristmill.functions import settings

    got = settings.parsed_settings("# c\n\nexport a=1\nb = 'two words'\n=x\nnothing\nc=\"q\nd=e=f\n")
    assert got == {"a": "1", "b": "two words", "c": '"q', "d": "e=f"}
    assert settings.merged_settings({"a": "own"}, got)["a"] == "own" and settings.merged_settings({"a": "own"}, got, override=True)["a"] == "1"
    m = settings.resolved_model({"openai.api_key": "secret", "timeout_seconds": "x"}, "small")
    assert m.ready and m.model == "small" and m.timeout == 60 and "secret" not in str(m.shown())
    m = settings.resolved_model({"provider": " Own ", "own.api_key": "k"}, "small")
    assert not m.ready and m.missing == ("own.base_url", "own.model") and m.model == ""


def test_positions_and_uncalled_helpers(spark, tmp_path):
    chunk = "[TABLE 2 ROW 4][ROW_ID=HOST 36] a [TABLE 3 ROW 7] b [ROW_ID=BIOS-4] c [TABLE 5 ROW 1][ROW_ID=MB12]"
    got = values(spark, S.table_position(A_, B_), ("RFQ-HOST-036", chunk), ("RFQ-BIOS-004", chunk), ("RFQ-MB-012", chunk), ("RFQ-X-1", chunk), ("x", "[TABLE 9 ROW 8] no id"), ("x", "nothing"))
    assert [tuple(x) if x else None for x in got] == [(2, 4), (3, 7), (5, 1), (2, 4), (9, 8), None]
    assert values(spark, S.short_source(A_, F.lit(3)), ("f.docx", "")) == ["f.docx#chunk3"]
    assert values(spark, P.may_normalize(A_), ("Requirement", ""), ("note", ""), (None, "")) == [True, False, False]
    assert values(spark, P.is_active(A_), ("auto_skip", ""), ("NEW", ""), (None, "")) == [False, True, True]
    df = spark.createDataFrame([(1, [], ["x"], 10.0, 5, 20), (2, None, [], 10.0, 1, 20), (3, ["y"], None, 10.0, 20, 20)], "i int, a array<string>, b array<string>, s double, done long, total long")
    assert [tuple(x) for x in df.select(P.has_flag(F.col("a"), F.col("b")).alias("f"), S.eta(F.col("s"), F.col("done"), F.col("total")).alias("e")).collect()] == [(True, 30), (False, None), (True, None)]
    listed = spark.createDataFrame([("/a/z.pdf", "t1"), ("/a/b.docx", "t2"), ("/a/c.zip", "t3"), ("/a/a.txt", "t9"), ("/old/b.docx", "t1")], "path string, mtime string")
    assert [x.path for x in T.by_extension(listed).collect()] == ["/a/b.docx", "/old/b.docx", "/a/z.pdf", "/a/a.txt"]
    assert files.newest(listed, "none.json", "b.docx", "z.pdf").first().path == "/a/b.docx"
    for name, text in (("one.jsonl", '{"a": 1}\n\n{"a": 2}\n'), ("two.jsonl", "\n \n"), ("three.txt", "x\n\ny\n")):
        (tmp_path / name).write_text(text)
    assert sorted((x.path.rsplit("/", 1)[1], x.n_lines) for x in files.line_counts(spark, str(tmp_path)).collect()) == [("one.jsonl", 2), ("two.jsonl", 0)]
    assert [x.text for x in files.text_files(spark, str(tmp_path), "*.txt").collect()] == ["x\n\ny\n"]
    (tmp_path / "d.json").write_text('{"a": 3}')
    (tmp_path / "bad.json").write_text('{"a": ')
    assert [x.a for x in files.json_documents(spark, str(tmp_path), "a long").collect()] == [3]
    rows = spark.createDataFrame([("c1", 2, "b"), ("c1", 1, "a"), ("c2", 1, "z")], "case_id string, pos long, t string")
    sinks.write_table(rows, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 3
    sinks.write_documents(rows, str(tmp_path / "docs"))
    assert {x.case_id: [i.t for i in x["items"]] for x in spark.read.json(str(tmp_path / "docs")).collect()} == {"c1": ["a", "b"], "c2": ["z"]}
    head = files.has_checklist(spark.createDataFrame([block("/x.xlsx", 0, ["Requirement", "Comply"], sheet="S", row=1)], files.BLOCK))
    assert [x.path for x in head.collect()] == ["/x.xlsx"]
