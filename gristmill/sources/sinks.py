"""Sinks: tables by sheet, JSON documents, append-only logs, and a plain workbook for readers of spreadsheets."""

from __future__ import annotations

import itertools
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import fixed as X


def write_table(df: DataFrame, path: str, by: str = "case_id") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON object a case, its rows nested in `items` in the order of pos."""
    rest = [c for c in df.columns if c != "case_id"]
    df.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("pos", *[c for c in rest if c != "pos"]))).alias("items")).write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def kept(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, None if nothing is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.parquet(path) if there else None


def write_once(df: DataFrame, path: str) -> DataFrame:
    """Reads what is at the path; if nothing is, writes df there first."""
    if kept(df.sparkSession, path) is None:
        df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """The lines of a report (section, ord, key, line) as one text file in a folder; a report has as many rows as keys."""
    report.orderBy("section", "ord", "key").coalesce(1).select("line").write.mode("overwrite").text(path)


def _cell(k: int, row: int, v) -> str:
    name, k = "", k + 1
    while k:
        k, r = divmod(k - 1, 26)
        name = chr(65 + r) + name
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f'<c r="{name}{row}"><v>{v}</v></c>'
    return f'<c r="{name}{row}" t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>'


def write_workbook(sheets: dict[str, DataFrame], path: str, most_rows: int = 1_048_575) -> None:
    """A workbook with a sheet for each table, made on the driver, row by row. Rows beyond what a sheet can hold go on in
    further sheets of the same name with a number."""
    kinds, links, names, n = [], [], [], 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in sheets.items():
            rows = (list(r) for r in df.toLocalIterator())
            for part in itertools.count(1):
                first = list(itertools.islice(rows, 1))
                if part > 1 and not first:
                    break
                n += 1
                with z.open(f"xl/worksheets/sheet{n}.xml", "w") as f:
                    f.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')
                    for k, values in enumerate(itertools.chain([df.columns], first, itertools.islice(rows, most_rows - 1)), 1):
                        f.write(f'<row r="{k}">{"".join(_cell(i, k, v) for i, v in enumerate(values))}</row>'.encode())
                    f.write(b"</sheetData></worksheet>")
                own = name if part == 1 else f"{name[: 31 - len(f' ({part})')]} ({part})"
                kinds.append(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>')
                links.append(f'<Relationship Id="rId{n}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{n}.xml"/>')
                names.append(f'<sheet name="{escape(own)}" sheetId="{n}" r:id="rId{n}"/>')
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{"".join(kinds)}</Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(links)}</Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{"".join(names)}</sheets></workbook>')


def compliance_workbook(exported: DataFrame, summary: DataFrame, guide: DataFrame, path: str) -> None:
    """The thirteen sheets of a case, empty ones too."""
    columns = [name for name, *_ in X.GUIDE]
    order = [c for c in ("pos", "part") if c in exported.columns]
    out = {}
    for s in X.SHEETS:
        if s == "By_Category_Summary":
            out[s] = summary.orderBy("rank", F.lower("category")).drop("rank")
        elif s == "Field Guide":
            out[s] = guide.orderBy("ord").drop("ord")
        else:
            out[s] = exported.where(F.col("sheet") == s).orderBy(*order).select(*columns)
    write_workbook(out, path)
