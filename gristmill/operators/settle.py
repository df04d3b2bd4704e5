"""Tables cut off from their lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of the bitmap of only_near: bits for each key, and words of 64 bits in a row.
KEY_BITS, ROW_WORDS = 16, 1024


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not where:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="gristmill-")
        sc.setCheckpointDir(where)
    return (where or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there, so that what several later steps need is made once."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def only_near(rows: DataFrame, keys: DataFrame, column: str = "key") -> DataFrame:
    """The rows whose `column`, a long hash, may be among those of `keys`, about one in fifty others passing by chance, so that the
    others stay out of the shuffle of a join that follows. keys is read twice. What goes to all tasks is a bitmap of KEY_BITS bits a
    key, in which a key sets two bits of one word."""
    n = max(keys.count() * KEY_BITS // 64 + 1, ROW_WORDS)
    at, one = F.pmod(F.col(column), F.lit(n)), F.lit(1).cast("long")
    bit = lambda shift: F.call_function("shiftleft", one, F.shiftrightunsigned(F.col(column), shift).bitwiseAND(63).cast("int"))
    both = bit(58).bitwiseOR(bit(52))
    of = keys.where(F.col(column).isNotNull()).select(at.alias("_at"), both.alias("_bits"))
    of = of.union(rows.sparkSession.range(n).select("id", F.lit(0).cast("long"))).groupBy("_at").agg(F.bit_or("_bits").alias("_bits"))
    words = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_bits"))), lambda x: x["_bits"])
    bitmap = of.groupBy(F.floor(F.col("_at") / ROW_WORDS).alias("_row")).agg(words.alias("_words"))
    rows = rows.withColumn("_row", F.floor(at / ROW_WORDS)).join(F.broadcast(settled(bitmap)), "_row")
    held = F.get("_words", F.pmod(at, F.lit(ROW_WORDS)).cast("int"))
    return rows.where(held.bitwiseAND(both) == both).drop("_row", "_words")


@contextmanager
def scratch(spark: SparkSession, label: str) -> Iterator[str]:
    """A new folder under the shared one, gone afterwards: settle what is to outlast it."""
    folder = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
