"""Shared helpers of the corpus operators: native text expressions, and where intermediate tables go."""

from __future__ import annotations

import atexit
import gc
import itertools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows up to which a table made of per-source or per-rule figures may be broadcast.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WORD_GAP))


def n_words(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Read from the session; set here only where it is unset, as in tests."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not where:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = tempfile.mkdtemp(prefix="gristmill-")
        sc.setCheckpointDir(where)
    return where or sc._jsc.sc().getCheckpointDir().get()


_settled = itertools.count(1)


def reclaim(spark: SparkSession) -> None:
    """Lets go of tables that nothing refers to. Spark removes their shuffle and checkpoint files once the driver's JVM has
    collected them, which by itself it does rarely, as a driver's heap fills slowly."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settled(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, lineage cut; Spark removes the files once nothing refers to them."""
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    if not next(_settled) % 2:
        reclaim(df.sparkSession)
    return out


#: Rows up to which a settled table is kept in one partition.
NARROW_ROWS = 400_000


def narrow(df: DataFrame) -> DataFrame:
    """The rows settled, and in one partition if they are few, so that joins and aggregates between such tables need no
    shuffle. A table with more rows stays spread; what is computed is the same either way."""
    out = settled(df)
    return out.coalesce(1) if out.limit(NARROW_ROWS + 1).count() <= NARROW_ROWS else out


class Workspace:
    """A folder for Parquet tables under the shared folder, removed at exit or by close()."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.path = spark, f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended before the interpreter
            if self.spark.sparkContext._jsc is not None:
                raise

    def close(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                self.drop()
            except Exception as e:  # noqa: BLE001 - at exit the gateway may be gone already
                if "Py4J" not in type(e).__name__ and "Connection" not in type(e).__name__:
                    raise
        atexit.unregister(self.close)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcasts a settled table only after counting that it has few rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


#: Of the bitmap of only_near: bits for each key, and words of 64 bits in a row.
KEY_BITS, ROW_WORDS = 16, 1024


def only_near(rows: DataFrame, keys: DataFrame, column: str = "key") -> DataFrame:
    """The rows whose `column`, a long hash, may be among those of `keys`, about one in fifty others passing by chance, however many
    keys there are: it keeps rows that an exact join would drop out of that join's shuffle. keys is read twice. What goes to all tasks is
    a bitmap of KEY_BITS bits a key, in which a key sets two bits of one word."""
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


def unused(name: str, *tables: DataFrame) -> str:
    """The name, with underscores before it until no column of the tables has it."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
