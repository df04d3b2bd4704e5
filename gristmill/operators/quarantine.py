"""Rows that failed beside those that did not: a row that was tried carries `problem`, null where it went well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from gristmill.functions.scalars import ascii_preview

PROBLEM = "struct<kind:string,error:string,excerpt:string>"
#: Characters of the raw value that a side table keeps.
EXCERPT = 200


def problem(kind: str, error: Column | str, raw: Column) -> Column:
    """What went wrong with a raw value, of which the beginning is kept as plain ASCII."""
    return F.struct(F.lit(kind).alias("kind"), (F.lit(error) if isinstance(error, str) else error).alias("error"), ascii_preview(raw, EXCERPT).alias("excerpt")).cast(PROBLEM)


def good_rows(tried: DataFrame) -> DataFrame:
    return tried.where("problem is null").drop("problem")


def bad_rows(tried: DataFrame, *keys: str) -> DataFrame:
    """The side table: keys, kind, error, excerpt."""
    return tried.where("problem is not null").select(*keys, "problem.*")


def set_apart(tried: DataFrame, folder: str, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, side table of the bad ones), from one pass: tried is written once, in two partitions of the folder, so
    that what it costs to try a row, a model's call or the parsing of a file, is not paid for each of the two."""
    flag = "is_bad"
    while flag in tried.columns:
        flag += "_"
    tried.withColumn(flag, F.col("problem").isNotNull()).write.mode("overwrite").partitionBy(flag).parquet(folder)
    both = tried.sparkSession.read.schema(StructType([*tried.schema.fields, StructField(flag, BooleanType())])).parquet(folder)
    return both.where(~F.col(flag)).drop(flag, "problem"), both.where(F.col(flag)).select(*keys, "problem.*")


def log_bad(bad: DataFrame, path: str, run: str) -> None:
    """Adds a run's side table to a log of all runs. A run that is done again replaces its own rows and no others."""
    bad.withColumn("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).write.mode("overwrite").json(f"{path.rstrip('/')}/run={run}")


def parsed_lines(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Tried rows: the column's JSON objects as columns of the schema, instead of the column. Blank and null lines are left out; a line that
    is no JSON object, or does not fit the schema, has a problem, and null in the schema's columns."""
    bad = "_bad"
    parsed = F.from_json(F.col(column), f"{schema}, {bad} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    rest = [c for c in df.columns if c != column]
    rows = df.where(F.rlike(F.coalesce(F.col(column), F.lit("")), F.lit(r"\S"))).withColumn("_line", parsed)
    broken = F.col(f"_line.{bad}").isNotNull()
    names = [c for c in rows.schema["_line"].dataType.names if c != bad]
    values = [F.when(~broken, F.col(f"_line.{c}")).alias(c) for c in names]
    return rows.select(*rest, *values, F.when(broken, problem("json", "no JSON of the schema", F.col(column))).alias("problem"))
