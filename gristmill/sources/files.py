"""File sources: text, JSON, office documents. All bytes are read by Spark's own sources, so any file system will do."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import fixed as X
from gristmill.functions import scalars as S
from gristmill.functions.text import strip
from gristmill.operators.quarantine import EXCERPT, PROBLEM, good_rows, parsed_lines
from gristmill.sources.pdf import page_texts

BLOCK = "path string, ord int, kind string, sheet string, table int, row int, cells array<string>"


def manifest(spark: SparkSession, folder: str, excluded: DataFrame | None = None) -> DataFrame:
    """path, name, size, mtime and sha256 of every file below a folder, without those whose name is in `excluded`."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    df = df.select("path", S.file_name(F.col("path")).alias("name"), F.col("length").alias("size"), F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("mtime"), F.sha2("content", 256).alias("sha256"))
    return df if excluded is None else df.join(excluded.select("name").distinct(), "name", "left_anti").select("path", "name", "size", "mtime", "sha256")


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """The folder's sub-folders that hold files, by name."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    below = F.substring_index(F.col("path"), folder.rstrip("/").removeprefix("file:") + "/", -1)
    return df.where(F.contains(below, F.lit("/"))).select(F.substring_index(below, "/", 1).alias("case_id")).distinct().orderBy("case_id")


def text_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path and whole text; bytes that are no UTF-8 are left out."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.replace("value", F.lit("�"), F.lit("")).alias("text"))


def text_lines(spark: SparkSession, folder: str) -> DataFrame:
    """path, line_no and line of the text files of a folder, in UTF-8 with or without a mark, else cp950, else Latin-1."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ext = F.element_at(F.split(F.lower(S.file_name(F.col("path"))), r"\."), -1)
    skip = F.rlike("path", F.lit("/(" + "|".join(re.escape(d) for d in X.SKIPPED_FOLDERS) + ")/"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for raw in b.column(1).to_pylist():
                for enc in ("utf-8-sig", "utf-8", "cp950", "latin-1"):
                    try:
                        texts.append(raw.decode(enc))
                        break
                    except UnicodeDecodeError:
                        continue
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["path", "text"])

    text = df.where(ext.isin(*X.TEXT_EXTENSIONS) & ~skip).select("path", "content").mapInArrow(decode, "path string, text string")
    rows = text.select("path", F.posexplode(F.split("text", "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")).alias("line_no", "line"))
    return rows.withColumn("line_no", F.col("line_no") + 1)


def json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines; lines that don't parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def tried_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines as tried rows with the path they are from; lines that don't parse have a problem."""
    return parsed_lines(spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value"), "value", schema)


def json_documents(spark: SparkSession, folder: str, schema: str, glob: str = "*.json") -> DataFrame:
    """One JSON document a file, with its path; unreadable ones give no row."""
    df = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).json(folder)
    return df.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime")).where("_bad is null").drop("_bad")


def json_map(documents: DataFrame, column: str, value: str) -> DataFrame:
    """Rows (key, value.*) of a column that holds a JSON object: responses by id, file selections by name."""
    parsed = F.from_json(column, f"map<string,{value}>")
    rest = [c for c in documents.columns if c != column]
    return documents.select(*rest, F.explode(parsed).alias("key", "_value")).select(*rest, "key", "_value.*")


def line_counts(spark: SparkSession, folder: str, glob: str = "*.jsonl") -> DataFrame:
    """path and the number of lines that are not blank: how many errors, or parts, a log holds. A file
    of blank lines counts 0; one without a byte gives no row, as Spark passes it over."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path")
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder).where(strip(F.col("value")) != "")
    found = rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    name = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return df.withColumn("_p", name(F.col("path"))).join(found.select(name(F.col("path")).alias("_p"), "n"), "_p", "left").select("path", F.coalesce("n", F.lit(0)).alias("n_lines"))


def newest(files: DataFrame, *names: str) -> DataFrame:
    """The newest file of the first of the names that there is. files: path, mtime."""
    rank = F.array_position(F.array(*map(F.lit, names)), S.file_name(F.col("path")))
    return files.withColumn("_rank", rank).where("_rank > 0").groupBy("_rank").agg(F.max_by("path", F.struct("mtime", "path")).alias("path")).orderBy("_rank").limit(1).select("path")


# --- office documents: zipped XML, read with the standard library ---

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _paragraph(p: ElementTree.Element) -> str:
    out = []
    for e in p.iter():
        if e.tag == f"{W}t":
            out.append(e.text or "")
        elif e.tag in (f"{W}tab", f"{W}br", f"{W}cr"):
            out.append("\t" if e.tag == f"{W}tab" else "\n")
    return "".join(out)


def _squeezed(s: str) -> str:
    return " ".join(s.split())


def docx_rows(content: bytes) -> Iterator[tuple]:
    """Paragraphs, then the tables' rows: (kind, sheet, table, row, cells)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    for p in body.findall(f"{W}p"):
        if t := _squeezed(_paragraph(p)):
            yield "paragraph", None, None, None, [t]
    for k, table in enumerate(body.findall(f"{W}tbl"), 1):
        for n, row in enumerate(table.findall(f"{W}tr"), 1):
            yield "row", None, k, n, [_squeezed("\n".join(_paragraph(p) for p in cell.findall(f"{W}p"))) for cell in row.findall(f"{W}tc")]


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def xlsx_rows(content: bytes) -> Iterator[tuple]:
    """The rows of all sheets in their order, with empty cells as empty texts: (kind, sheet, table, row, cells)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{M}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{M}si")]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for s in ElementTree.fromstring(z.read("xl/workbook.xml")).find(f"{M}sheets"):
            target = links[s.get(f"{R}id")].lstrip("/")
            root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
            at = 0
            for row in root.iter(f"{M}row"):
                at = int(row.get("r") or at + 1)
                cells: list[str] = []
                for c in row.findall(f"{M}c"):
                    k = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (k - len(cells) + 1)
                    v = c.find(f"{M}v")
                    if c.get("t") == "inlineStr":
                        cells[k] = "".join(t.text or "" for t in c.iter(f"{M}t"))
                    elif v is not None:
                        cells[k] = shared[int(v.text)] if c.get("t") == "s" else {"1": "True", "0": "False"}.get(v.text, "") if c.get("t") == "b" else v.text or ""
                yield "row", s.get("name"), None, at, [x.strip() for x in cells]


def plain_rows(content: bytes) -> Iterator[tuple]:
    yield "text", None, None, None, [content.decode("utf-8", "ignore")]


def pdf_rows(content: bytes) -> Iterator[tuple]:
    """A row for each page that shows text."""
    for page, text in page_texts(content):
        yield "page", None, None, page, [text]


#: How a file is read, by its extension; a .doc is tried as a document, else taken as text. Others may be registered.
READERS = {"docx": docx_rows, "doc": docx_rows, "xlsx": xlsx_rows, "xls": xlsx_rows, "txt": plain_rows, "md": plain_rows, "pdf": pdf_rows}


def tried_rows(spark: SparkSession, folder: str, kinds: tuple[str, ...] = tuple(READERS)) -> DataFrame:
    """Typed rows of all documents below a folder: path, ord, kind, sheet, table, row, cells, and problem. A file that its reader can't read,
    because it is broken, encrypted or no such file, gives one row with its path and problem, and no others; one without a
    byte gives none, as Spark passes it over."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ext = F.element_at(F.split(F.lower(S.file_name(F.col("path"))), r"\."), -1)
    readers = dict(READERS)
    types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.struct([("kind", pa.string()), ("error", pa.string()), ("excerpt", pa.string())])]

    def rows_of(path: str, content: bytes) -> list[tuple]:
        kind = path.rsplit(".", 1)[-1].lower()
        try:
            rows = list(readers[kind](content))
        except MemoryError:
            raise
        except Exception as e:  # noqa: BLE001 - whatever a broken file makes a parser raise is recorded with the file
            if kind != "doc":
                seen = content[:EXCERPT].decode("ascii", "replace").replace("\N{REPLACEMENT CHARACTER}", "?")
                return [(path, None, None, None, None, None, None, {"kind": kind, "error": f"{type(e).__name__}: {e}", "excerpt": seen})]
            rows = list(plain_rows(content))
        return [(path, k, *r, None) for k, r in enumerate(rows)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cols = list(zip(*rows_of(path, content), strict=True)) or [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["path", "ord", "kind", "sheet", "table", "row", "cells", "problem"])

    return df.where(ext.isin(*kinds)).select("path", "content").mapInArrow(read, f"{BLOCK}, problem {PROBLEM}")


def read_rows(spark: SparkSession, folder: str, kinds: tuple[str, ...] = tuple(READERS)) -> DataFrame:
    """The rows of all documents that can be read; quarantine.set_apart(tried_rows(...)) also tells of the others."""
    return good_rows(tried_rows(spark, folder, kinds))


def docx_blocks(rows: DataFrame) -> DataFrame:
    """Blocks (path, ord, table, row, row_id, text, comment, block) of documents. A table whose header names a requirement
    column gives that column, its item number and its comment; any other table gives all cells of each row below the first."""
    heads = rows.where((F.col("kind") == "row") & F.col("table").isNotNull() & (F.col("row") == 1)).select("path", "table", F.transform("cells", F.lower).alias("head"))
    at = lambda pred: F.array_max(F.transform("head", lambda h, i: F.when(pred(h), i)))
    item = lambda h: F.contains(h, F.lit("item")) | h.isin("no", "no.", "#", "id")
    req = lambda h: ~item(h) & (F.contains(h, F.lit("ibm requirement")) | (h == "requirement"))
    comment = lambda h: ~item(h) & ~req(h) & (F.contains(h, F.lit("ibm comment")) | (F.contains(h, F.lit("comment")) & ~F.contains(h, F.lit("vendor"))))
    named = F.exists("head", lambda h: F.contains(h, F.lit("requirement")))
    heads = heads.select("path", "table", at(item).alias("item_at"), F.when(named, at(req)).alias("req_at"), at(comment).alias("comment_at"))
    body = rows.where((F.col("kind") != "row") | F.col("table").isNull() | (F.col("row") > 1)).join(heads, ["path", "table"], "left")
    cell = lambda c: F.coalesce(F.get("cells", F.col(c)), F.lit(""))
    matrix = F.col("req_at").isNotNull()
    text = F.when(matrix, cell("req_at")).otherwise(F.array_join(F.filter("cells", lambda c: c != ""), " | "))
    body = body.withColumns({"text": text, "comment": F.when(matrix, cell("comment_at")).otherwise("")}).where("text <> ''")
    body = body.withColumn("row_id", F.when(F.col("table").isNull(), "").otherwise(F.coalesce(F.when(matrix, F.nullif(cell("item_at"), F.lit(""))), S.row_id(F.col("text")))))
    mark = F.when(F.col("row_id") != "", F.concat(F.when(matrix, "").otherwise(" "), F.lit("[ROW_ID="), "row_id", F.lit("]"))).otherwise("")
    note = F.when(F.col("comment") != "", F.concat(F.lit(" [IBM_COMMENT: "), "comment", F.lit("]"))).otherwise("")
    block = F.when(F.col("table").isNull(), F.col("text")).otherwise(F.concat(F.lit("[TABLE "), F.col("table").cast("string"), F.lit(" ROW "), F.col("row").cast("string"), F.lit("]"), mark, F.lit(" "), "text", note))
    return body.select("path", "ord", "table", "row", "row_id", "text", "comment", block.alias("block"))


def sheet_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of workbooks: every row that has a cell, its cells between bars, and where it is from."""
    text = F.array_join(F.filter("cells", lambda c: c != ""), " | ")
    body = rows.where("sheet is not null").withColumn("text", text).where("text <> ''").withColumn("row_id", S.row_id(F.col("text")))
    mark = F.when(F.col("row_id") != "", F.concat(F.lit(" [ROW_ID="), "row_id", F.lit("]"))).otherwise("")
    block = F.concat(F.lit("[FILE:"), S.file_name(F.col("path")), F.lit(" SHEET:"), "sheet", F.lit(" ROW "), F.col("row").cast("string"), F.lit("]"), mark, F.lit(" "), "text")
    return body.select("path", "ord", "sheet", "row", "row_id", "text", block.alias("block"))


def page_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of PDF files: path, ord, page, text, block, one for each page that shows text."""
    text = F.get("cells", F.lit(0))
    block = F.concat(F.lit("[PDF PAGE "), F.col("row").cast("string"), F.lit("] "), text)
    return rows.where("kind = 'page'").select("path", "ord", F.col("row").alias("page"), text.alias("text"), block.alias("block"))


def _with_header(rows: DataFrame) -> DataFrame:
    head = rows.where("row = 1").select("path", "sheet", F.col("cells").alias("head"))
    return rows.where("row > 1").join(head, ["path", "sheet"])


def simple_list(rows: DataFrame, id_col: str = "ID", requirement_col: str = "Question", answer_col: str = "Answer") -> DataFrame:
    """Requirements of sheets that name their columns in row 1; a sheet without the requirement column gives none."""
    at = lambda name: F.get("cells", (F.array_position("head", F.lit(name)) - 1).cast("int"))
    cell = lambda name: F.when(F.array_contains("head", name), strip(at(name))).otherwise("")
    df = _with_header(rows).where(F.array_contains("head", requirement_col)).withColumns({"requirement": cell(requirement_col), "_id": cell(id_col), "notes": cell(answer_col)}).where("requirement <> ''")
    name = S.file_name(F.col("path"))
    made = F.concat(F.lit("AUTO-"), name, F.lit("-"), (F.col("row") - 1).cast("string"))
    return df.select(F.coalesce(F.nullif("_id", F.lit("")), made).alias("req_id"), "requirement", "notes", F.lit(1.0).alias("confidence"), name.alias("file"), "sheet", "row")


def spec_reference(rows: DataFrame) -> DataFrame:
    """Requirements derived from sheets of labels and a column for each model: `label: model: value, ...`.

    Names of models close up over empty headers while values keep their places; without any header row 1 is data and the row
    number is one more than the sheet's."""
    from gristmill.functions.rules import spec_category

    head = rows.where("row = 1").select("path", "sheet", F.filter(F.slice("cells", 2, 100_000), lambda h: h != "").alias("models"))
    df = rows.join(head, ["path", "sheet"]).where((F.size("models") == 0) | (F.col("row") > 1))
    values = F.slice("cells", 2, 100_000)
    label = F.coalesce(F.get("cells", F.lit(0)), F.lit(""))
    df = df.withColumns({"_label": label, "_values": values}).where("_label <> ''").where((F.size("cells") > 1) | F.exists("_values", lambda v: v != ""))
    pairs = F.filter(F.transform("_values", lambda v, j: F.when(v != "", F.when(j < F.size("models"), F.concat(F.get("models", j), F.lit(": "), v)).otherwise(v))), lambda x: x.isNotNull())
    text = F.when(F.size(pairs) > 0, F.concat(F.col("_label"), F.lit(": "), F.array_join(pairs, ", "))).otherwise(F.col("_label"))
    name, k = S.file_name(F.col("path")), F.when(F.size("models") > 0, F.col("row") - 1).otherwise(F.col("row"))
    return df.select(F.concat(F.lit("AUTO-"), name, F.lit("-"), k.cast("string")).alias("req_id"), text.alias("requirement"), F.lit(X.DERIVED_NOTE).alias("notes"), F.lit(0.5).alias("confidence"), F.lit(True).alias("derived"), spec_category(F.col("_label")).alias("spec_category"), name.alias("file"), "sheet", (k + 1).alias("row"))


def checklist_headers(rows: DataFrame, most: int = 10) -> DataFrame:
    """path, sheet, header_row and the columns of each role, for sheets whose first rows have a checklist's header.

    A column takes one role, the first still free of ref, requirement, priority, comply: a fold over the row's cells."""
    lower = F.transform("cells", F.lower)
    joined = F.array_join(lower, " ")
    has = lambda x, k: F.rlike(x, F.lit(X.CHECKLIST[k]))
    free = F.struct(*[F.lit(-1).alias(k) for k in ("ref", "label", "priority", "comply")])

    def step(acc, cell):
        take, out = F.lit(True), []
        for k in ("ref", "label", "priority", "comply"):
            hit = take & (acc[k] < 0) & has(cell["text"], k)
            out.append(F.when(hit, cell["at"]).otherwise(acc[k]).alias(k))
            take = take & ~hit
        return F.struct(*out)

    cells = F.transform(lower, lambda c, i: F.struct(c.alias("text"), i.alias("at")))
    df = rows.where((F.col("sheet").isNotNull()) & (F.col("row") <= most)).where(has(joined, "label") & has(joined, "comply"))
    df = df.withColumn("_roles", F.aggregate(cells, free, step)).where("_roles.label >= 0")
    note = F.array_min(F.transform(lower, lambda c, i: F.when(has(c, "note") & (i != F.col("_roles.comply")), i)))
    df = df.withColumn("_note", note)
    pick = F.min_by(F.struct(F.col("row").alias("header_row"), "_roles.ref", "_roles.label", "_roles.priority", "_roles.comply", F.col("_note").alias("note")), "row")
    return df.groupBy("path", "sheet").agg(pick.alias("_h")).select("path", "sheet", "_h.*")


def has_checklist(rows: DataFrame) -> DataFrame:
    return checklist_headers(rows).select("path").distinct()


def checklist(rows: DataFrame) -> DataFrame:
    """Requirements of checklist sheets: section rows dropped, priority mapped, compliance and comment in the notes."""
    from gristmill.functions.predicates import is_section_header
    from gristmill.functions.rules import priority

    df = rows.join(checklist_headers(rows), ["path", "sheet"]).where("row > header_row")
    cell = lambda c: F.when(F.col(c) >= 0, F.coalesce(F.get("cells", F.col(c)), F.lit(""))).otherwise("")
    df = df.withColumns({"requirement": cell("label"), "_ref": cell("ref"), "_priority": cell("priority"), "_comply": cell("comply"), "_said": cell("note")}).where("requirement <> ''")
    df = df.where(~is_section_header(F.col("requirement"), F.col("_priority")))
    notes = F.array_join(F.filter(F.array(F.when(F.col("_comply") != "", F.concat(F.lit("Comply: "), "_comply")), F.nullif("_said", F.lit(""))), lambda x: x.isNotNull()), " | ")
    name = S.file_name(F.col("path"))
    made = F.concat_ws("-", F.lit("AUTO"), name, "sheet", F.col("row").cast("string"))
    return df.select(F.coalesce(F.nullif("_ref", F.lit("")), made).alias("req_id"), "requirement", notes.alias("notes"), F.lit(1.0).alias("confidence"), F.lit(False).alias("derived"), priority(F.col("_priority")).alias("must_level"), name.alias("file"), "sheet", "row")


def row_counts(rows: DataFrame, sheet: str = "Compliance Matrix") -> DataFrame:
    """Data rows of each workbook's matrix sheet, else of its first."""
    n = rows.where("sheet is not null").groupBy("path", "sheet").agg(F.max("row").alias("n"), F.min("ord").alias("at"))
    best = n.groupBy("path").agg(F.min_by("n", F.struct((F.col("sheet") != sheet).alias("other"), "at")).alias("n"))
    return best.select("path", F.greatest(F.col("n") - 1, F.lit(0)).alias("data_rows"))
