"""A model's answers as a table function over a content-addressed cache: what was answered once is not asked again."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.model import ClientFactory, answered, parsed_answers
from gristmill.operators.quarantine import PROBLEM, problem, set_apart

#: What the cache keeps of a call. It is partitioned by run.
CALL = "signature string, answer string, error string, asked_at timestamp"


def asker(factory: ClientFactory, retries: int = 3, wait: Callable[[float], None] = time.sleep):
    """A table function of (signature, prompt) rows: their answers and errors. It has one client for each partition of its
    table. Table functions are not deterministic unless they say so, so no plan calls it twice to save something else."""

    class Ask:
        def __init__(self):
            self.client = None

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            self.client = self.client or factory()
            got = [answered(self.client, p, retries, wait) for p in batch.column("prompt").to_pylist()]
            yield pa.table({"signature": batch.column("signature").cast(pa.string()), "answer": pa.array([a for a, _ in got], pa.string()), "error": pa.array([e for _, e in got], pa.string())})

    return F.arrow_udtf(Ask, returnType="signature string, answer string, error string")


def cached(spark: SparkSession, cache: str) -> DataFrame:
    """All calls that a cache has, by run; a cache that is not there yet has none."""
    schema = f"{CALL}, run string"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(cache) if there else spark.createDataFrame([], schema)


def ask_new(prompts: DataFrame, cache: str, run: str, factory: ClientFactory, calls: int = 8, waves: int = 1, retries: int = 3, wait: Callable[[float], None] = time.sleep) -> None:
    """Asks those of the prompts (signature, prompt) that the cache has no answer to, each signature once, with at most
    `calls` calls at a time, and adds answers and errors to the cache. Prompts are dealt to waves by signature; what a wave
    brought is kept whatever happens to the next, and a run that is started again goes on behind it. Calls that failed are
    tried again by the next run. Null signatures and prompts are not asked."""
    spark = prompts.sparkSession
    ask = asker(factory, retries, wait)
    for wave in range(waves):
        own = prompts.where("signature is not null and prompt is not null").where(F.pmod(F.xxhash64("signature"), F.lit(waves)) == wave)
        new = own.join(cached(spark, cache).where("answer is not null").select("signature"), "signature", "left_anti").groupBy("signature").agg(F.min("prompt").alias("prompt"))
        dealt = new.withColumn("part", F.pmod(F.xxhash64("signature", F.lit(1)), F.lit(calls)))
        said = ask(dealt.select("signature", "prompt", "part").repartition(calls, "part").asTable().partitionBy("part"))
        said.withColumn("asked_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{cache.rstrip('/')}/run={run}-{wave}")


def with_answers(prompts: DataFrame, cache: str) -> DataFrame:
    """The prompts with answer and error as the cache has them: a signature's newest answer, else its newest error, else
    that it was not asked."""
    calls = cached(prompts.sparkSession, cache)
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("asked_at")))
    known = calls.groupBy("signature").agg(newest("answer").alias("answer"), newest("error").alias("error"))
    rows = prompts.join(known, "signature", "left")
    return rows.withColumn("error", F.when(F.col("answer").isNull(), F.coalesce("error", F.lit("not asked"))))


def asked_counts(spark: SparkSession, cache: str) -> DataFrame:
    """run, asked, answered: the calls of each run, without its waves."""
    return cached(spark, cache).groupBy(F.regexp_replace("run", r"-\d+$", "").alias("run")).agg(F.count(F.lit(1)).alias("asked"), F.count("answer").alias("answered"))


def tried_answers(answers: DataFrame) -> DataFrame:
    """Tried rows of answers (answer, error): json in place of both, and a problem where the call failed, no JSON can be
    made of the answer, or it holds no list of requirements."""
    rows = parsed_answers(answers)
    listed = F.from_json("json", "struct<requirements:array<string>>")["requirements"]
    failed = (
        F.when(F.col("error").isNotNull(), problem("call", F.col("error"), F.col("answer")))
        .when(F.col("json").isNull(), problem("answer", "no JSON in the answer", F.col("answer")))
        .when(listed.isNull(), problem("shape", "no list of requirements", F.col("answer")))
        .otherwise(F.lit(None).cast(PROBLEM))
    )
    return rows.withColumn("problem", failed).drop("answer", "error")


def requirements_apart(answers: DataFrame, folder: str, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(requirement rows of the good answers, side table of the bad ones), from one pass over the answers."""
    from gristmill.functions.model import extracted

    good, bad = set_apart(tried_answers(answers), folder, *keys)
    return extracted(good), bad
