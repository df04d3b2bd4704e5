"""Progress of runs from their log lines, as a stream: parse, reduce to the latest state, write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import fixed as X
from gristmill.functions.text import U, matches

EVENT = ("kind", "file", "done", "total", "req_id", "attempt", "sleep_s")


def progress_event(line: Column) -> Column:
    """What a line says, by the first of five shapes that it has; null for others."""

    def event(kind: str, **values) -> Column:
        p = X.PROGRESS[kind]
        at = lambda k: F.regexp_extract(line, U + p, k)
        types = {"done": "long", "total": "long", "attempt": "long", "sleep_s": "double"}
        cells = [F.lit("item" if kind == "enrich" else kind).alias("kind")]
        for name in EVENT[1:]:
            t = types.get(name, "string")
            cells.append((at(values[name]).cast(t) if name in values else F.lit(None).cast(t)).alias(name))
        return F.when(matches(line, p), F.struct(*cells))

    return F.coalesce(event("chunk", file=1, done=2, total=3), event("enrich", done=1, total=2, req_id=3), event("chunks_total", file=1, total=2), event("retry", attempt=1, total=2, sleep_s=3), event("item", done=1, total=2, req_id=3))


def log_lines(spark: SparkSession, folder: str, stream: bool = True) -> DataFrame:
    """run, seq, line of log files with such columns as JSON lines."""
    schema = "run string, seq long, line string"
    return (spark.readStream if stream else spark.read).schema(schema).json(folder)


def progress_state(lines: DataFrame) -> DataFrame:
    """Per run the latest file, counts and retry, and how many lines said anything. Stateful where lines are a stream: the
    state is one row for each run, whatever the number of lines."""
    e = lines.select("run", "seq", progress_event(F.col("line")).alias("e"))
    last = lambda c, *kinds: F.max_by(F.col(f"e.{c}"), F.when(F.col("e.kind").isin(*kinds) & F.col(f"e.{c}").isNotNull(), F.col("seq")))
    return e.groupBy("run").agg(
        last("file", "chunk", "chunks_total").alias("file_current"), last("done", "chunk").alias("chunk_done"), last("total", "chunk", "chunks_total").alias("chunk_total"), last("done", "item").alias("item_done"), last("total", "item").alias("item_total"),
        last("attempt", "retry").alias("retry_attempt"), F.count(F.col("e.kind")).alias("events"), F.count(F.lit(1)).alias("lines"),
    )


def run_progress(spark: SparkSession, folder: str, out: str, checkpoint: str) -> DataFrame:
    """Reduces all that is there and writes the state with each batch; the last batch's table is the current state."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = progress_state(log_lines(spark, folder)).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)
