"""Side analyses: incremental cache, runtime estimate, run history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import fixed as X
from gristmill.functions import rules as R
from gristmill.functions import scalars as S
from gristmill.functions.predicates import risk_of
from gristmill.functions.text import strip
from gristmill.operators import ordered as O
from gristmill.operators import tables as T

IDENTITY = ["file_hash", "requirement_text_hash", "parser_version", "prompt_version", "model_name", "extraction_config"]


def item_files(items: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each item's manifest entry: by the shown name before the dash in its source, the last entry of equal names; else the
    case's only file. manifest: case_id, ord, name, path, size, mtime, sha256."""
    entry = F.struct("sha256", "mtime", F.col("size").cast("long").alias("size"), "path")
    named = manifest.where("name <> ''").groupBy("case_id", S.display_name(F.col("name")).alias("_prefix")).agg(F.max_by(entry, "ord").alias("_named"))
    sole = manifest.groupBy("case_id").agg(F.count(F.lit(1)).alias("_files"), F.max_by(entry, "ord").alias("_sole"))
    rows = items.withColumn("_prefix", strip(F.substring_index(F.coalesce("source", F.lit("")), "—", 1)))
    rows = rows.join(T.small(named), ["case_id", "_prefix"], "left").join(T.small(sole), "case_id", "left")
    return rows.withColumn("entry", F.coalesce("_named", F.when(F.col("_files") == 1, F.col("_sole")))).drop("_prefix", "_named", "_files", "_sole")


def item_metas(items: DataFrame, manifest: DataFrame, model: str = "", config: str = "{}") -> DataFrame:
    rows = item_files(items.where((F.col("type") == "requirement") & (F.coalesce("req_id", F.lit("")) != "")), manifest)
    text = S.item_text(F.col("normalized_requirement"), F.col("requirement"))
    return rows.select(
        "case_id", "pos", "req_id", F.coalesce("entry.sha256", F.lit("")).alias("file_hash"), F.coalesce("entry.mtime", F.lit("")).alias("file_mtime"), F.coalesce("entry.size", F.lit(0)).alias("file_size"),
        F.coalesce("entry.path", F.lit("")).alias("source_file_path"), S.text_hash(text).alias("requirement_text_hash"), F.lit(X.PARSER_VERSION).alias("parser_version"), F.lit(X.PROMPT_VERSION).alias("prompt_version"),
        F.lit(model).alias("model_name"), F.lit(config).alias("extraction_config"),
    )


def file_metas(manifest: DataFrame, model: str = "", config: str = "{}") -> DataFrame:
    return manifest.where("name <> ''").select(
        "case_id", F.col("ord").alias("pos"), F.col("name").alias("req_id"), F.coalesce("sha256", F.lit("")).alias("file_hash"), F.coalesce("mtime", F.lit("")).alias("file_mtime"), F.col("size").cast("long").alias("file_size"), F.col("path").alias("source_file_path"),
        F.lit(None).cast("string").alias("requirement_text_hash"), F.lit(X.PARSER_VERSION).alias("parser_version"), F.lit(X.PROMPT_VERSION).alias("prompt_version"), F.lit(model).alias("model_name"), F.lit(config).alias("extraction_config"),
    )


def kept_metas(metas: DataFrame) -> DataFrame:
    """What a cache stores: of equal ids the last."""
    return O.latest(metas, ["case_id", "req_id"], [F.col("pos")])


def decisions(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Each current row against what the last cache has under its id: no_cache, unchanged or changed, and the changed fields."""
    p = previous.select("case_id", "req_id", *[F.col(c).alias(f"_{c}") for c in IDENTITY], F.lit(True).alias("_known"))
    rows = current.join(p, ["case_id", "req_id"], "left")
    none = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    changed = F.filter(F.array(*[F.when(none(F.col(c)) != none(F.col(f"_{c}")), F.lit(c)) for c in IDENTITY]), lambda c: c.isNotNull())
    rows = rows.withColumn("_changed", F.when(F.col("_known").isNotNull(), changed).otherwise(F.array().cast("array<string>")))
    reason = F.when(F.col("_known").isNull(), "no_cache").when(F.size("_changed") == 0, "unchanged").otherwise("changed")
    return rows.select("case_id", "req_id", "pos", (reason == "unchanged").alias("skip"), reason.alias("reason"), F.array_join("_changed", ",").alias("changed_fields"))


def cache_summary(item_decisions: DataFrame, file_decisions: DataFrame) -> DataFrame:
    """Totals of each case; ids that repeat count once in the total and each time in what is reused."""
    i = item_decisions.groupBy("case_id").agg(F.count_distinct("req_id").alias("total"), F.count_if("skip").alias("reused"))
    f = file_decisions.groupBy("case_id").agg(F.count_if("skip").alias("skipped_files"))
    rows = i.join(f, "case_id", "full_outer").select("case_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "reused", "skipped_files")])
    rows = rows.withColumns({"reprocessed": F.greatest(F.col("total") - F.col("reused"), F.lit(0)), "saved_seconds": F.bround(F.col("reused") * F.lit(X.SAVED_SECONDS), 1)})
    return rows.withColumn("saved", S.duration(F.col("saved_seconds"), hours=False))


def metrics(summary: DataFrame) -> DataFrame:
    """The summary as label and value."""
    pairs = {"Total requirements": "total", "Reused from cache": "reused", "Reprocessed": "reprocessed", "Skipped unchanged": "skipped_files", "Est. runtime saved": "saved"}
    rows = F.array(*[F.struct(F.lit(k).alias("label"), F.col(c).cast("string").alias("value")) for k, c in pairs.items()])
    return summary.select("case_id", F.inline(rows))


def estimate(documents: DataFrame, provider: str, most: int = 600) -> DataFrame:
    """What extraction would cost by file: chunks and seconds. documents: case_id, name, text."""
    rows = documents.select("case_id", "name", F.length(F.coalesce("text", F.lit(""))).alias("chars"), O.paragraph_elements(F.col("text"), most).alias("e"))
    rows = rows.select("case_id", "name", "chars", F.size(O.packed(F.col("e"), most)).alias("chunks"))
    total = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("file_count"), F.sum("chars").alias("total_chars"), F.sum("chunks").alias("chunks"))
    seconds = F.col("chunks") * R.seconds_per_call(F.lit(provider))
    return total.withColumn("est_runtime_sec", seconds).withColumns({"est_runtime_human": S.duration(F.col("est_runtime_sec")), "risk": risk_of(F.col("est_runtime_sec"))})


def run_history(runs: DataFrame, files: DataFrame, limit: int = 20) -> DataFrame:
    """The newest runs: run_dir, job fields, how long they took, how many of the outputs there are. files: run_dir, name."""
    there = files.where(F.col("name").isin(*X.RUN_OUTPUTS)).groupBy("run_dir").agg(F.count_distinct("name").alias("_n"))
    rows = runs.join(there, "run_dir", "left").withColumns({"duration": S.elapsed(F.col("started_at"), F.col("ended_at")), "outputs": F.concat(F.coalesce("_n", F.lit(0)).cast("string"), F.lit(f"/{len(X.RUN_OUTPUTS)}"))}).drop("_n")
    return rows.orderBy(F.coalesce(F.nullif("ended_at", F.lit("")), F.col("started_at")).desc(), "run_dir").limit(limit)
