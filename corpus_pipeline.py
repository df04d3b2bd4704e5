"""The corpus pipeline: toxic documents go, lines and then documents that repeat go, sources are mixed, and the rest packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import jaccard, lines, mixing, packing, toxicity
from gristmill.llm.common import Workspace, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that are not predicted toxic. Null and empty texts are judged by the bias alone, repeated rows alike; an empty
    table, or no labels, drops nothing."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows without lines that an earlier line (by doc_id, null first, then position) is like; rows of which no line is left
    go. Null, empty and blank texts stay; rows that repeat in id and text are treated alike; an empty table stays empty."""
    return lines.deduplicated(docs)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar texts the row with the least id (null last); of rows that repeat in id and text one. Texts
    without words, null ones too, are one class; an empty table stays empty."""
    return jaccard.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes. Texts without words have size 0 and go with their place in the draw; rows of one
    id stand or fall together; a null source is one of its own; an empty table stays empty."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences (doc_id, start, length, ...), not documents. A null or empty text is its end alone; repeated rows
    are packed each; an empty table gives no pieces."""
    return packing.packed(docs)


#: Each stage's rows are written as Parquet and read again as the next one's docs.
STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_each_class),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL: learned scores, MinHash and tokenizers are beyond it. tests/llm/test_pipeline.py holds each stage's rows against a
#: brute-force version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents of sf_dir."""
    ws = Workspace(spark, "corpus-pipeline")
    docs, before = table(spark, sf_dir, "documents"), ""
    for name, stage in STAGES[:-1]:
        docs = ws.write(stage(spark, docs, sf_dir), name)
        if before:
            ws.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
