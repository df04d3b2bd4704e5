"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: A document's place in its source's draw: 60 bits of an md5.
HASH_BITS = 60


def place(doc_id: Column) -> Column:
    """A number below 2**60 drawn from the document's id, the same on every run."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(totals: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """Adds each source's `target` to a table (source, source_size): its weight's share of all sizes, stopped at `most` times
    its size, with the excess shared again by weight until no source is above. One row per source, so one window holds it.

    Sources are stopped in the order of source_size / weight; the first that its share no longer exceeds sets the level."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = ranked.withColumn("limit_", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("limit_") / F.col("weight"))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({"all_size": F.sum("source_size").over(everything), "all_weight": F.sum("weight").over(everything), "spent": F.coalesce(F.sum("limit_").over(before), F.lit(0.0)), "gone": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    rows = rows.withColumn("level", (F.col("all_size") - F.col("spent")) / (F.col("all_weight") - F.col("gone")))
    rows = rows.withColumn("stopped", F.col("level") >= F.col("ratio"))
    level = F.max(F.when(~F.col("stopped"), F.struct(-F.col("ratio"), F.col("level")))).over(everything)["level"]
    return rows.select("source", "source_size", F.when(F.col("stopped"), F.col("limit_")).otherwise(level * F.col("weight")).alias("target"))


def thresholds(sized: DataFrame, weights: tuple[float, ...], most: float, bits: int) -> DataFrame:
    """One row per source of a settled table (source, size, place): source_size, target, whole, last. Every document of the
    source is taken `whole` times, and once more if its place is not above `last`.

    A histogram of sizes by (source, upper hash bits) tells in which bucket the remaining budget ends. That bucket alone is
    split by its next bits, and so on, until it holds one place: thresholds nest, and no document is sorted."""
    histogram = common.settled(sized.groupBy("source", F.shiftright("place", HASH_BITS - bits).alias("bucket")).agg(F.sum("size").alias("size"), F.min("place").alias("least"), F.max("place").alias("greatest")))
    goal = targets(histogram.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    goal = common.settled(goal)
    open_ = goal.select(F.col("source").alias("of"), F.lit(0).cast("long").alias("spent"), "rest")
    cuts, used = None, bits
    while True:
        upto = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
        running = histogram.withColumn("upto", F.sum("size").over(upto)).join(common.broadcast_if_small(open_), F.col("source").eqNullSafe(F.col("of")))
        running = running.withColumn("before", F.col("spent") + F.col("upto") - F.col("size"))
        edge = common.settled(running.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("spent") + F.col("upto"))).select("source", "bucket", "before", "rest", "size", "least", "greatest"))
        # of the one place in which the budget ends, what comes nearer
        last = F.when(F.col("before") + F.col("size") / 2 <= F.col("rest"), F.col("least")).otherwise(F.col("least") - 1)
        found = edge.where("least = greatest").select(F.col("source").alias("of"), last.alias("last"))
        cuts = found if cuts is None else cuts.union(found)
        more = edge.where("least < greatest").select(F.col("source").alias("of"), F.col("bucket").alias("within"), F.col("before").alias("spent"), "rest")
        if used >= HASH_BITS or more.isEmpty():
            break
        inside = sized.join(common.broadcast_if_small(more), F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("place", HASH_BITS - used) == F.col("within")))
        used = min(used + bits, HASH_BITS)
        histogram = common.settled(inside.groupBy("source", F.shiftright("place", HASH_BITS - used).alias("bucket")).agg(F.sum("size").alias("size"), F.min("place").alias("least"), F.max("place").alias("greatest")))
        open_ = more.select("of", "spent", "rest")
    # without an edge the budget's rest is all of the source or nothing
    out = goal.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left")
    last = F.when(F.col("source_size") <= 0, F.lit(-1)).otherwise(F.coalesce("last", F.when(F.col("rest") >= F.col("source_size"), F.lit((1 << HASH_BITS) - 1)).otherwise(F.lit(-1))))
    return common.settled(out.select("source", "source_size", "target", "whole", last.cast("long").alias("last")))


def draw(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, bits: int = 14) -> tuple[DataFrame, DataFrame]:
    """The settled table (doc_id, source, size, place) of docs and the thresholds of their sources."""
    sized = common.settled(docs.select("doc_id", "source", common.n_words(F.col("text")).alias("size"), place(F.col("doc_id")).alias("place")))
    return sized, thresholds(sized, weights, most, bits)


def copies(most: float = 3.0):
    return F.least(F.col("whole") + (F.col("place") <= F.col("last")).cast("long"), F.lit(int(most)))


def mix_plan(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    Null texts have size 0, a null source is a source of its own and comes last. Documents with one id (repeated rows) stand
    or fall together. Where the last document straddles the budget, it is taken if that comes nearer. An empty table gives no
    rows; columns of docs other than doc_id, text and source play no part."""
    sized, limits = draw(docs, **options)
    out = sized.alias("d").join(common.broadcast_if_small(limits).alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
    out = out.withColumn("copies", copies(options.get("most", 3.0)))
    return out.select("doc_id", F.col("d.source").alias("source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with docs' own columns, whatever their names, a row for each copy taken. Texts are not
    shuffled: a document's place is drawn again from its id and held against its source's threshold. Null texts have no words;
    rows of one id stand or fall together; an empty table gives no rows."""
    _, limits = draw(docs.select("doc_id", "source", "text"), **options)
    limits = common.broadcast_if_small(limits.select(F.col("source").alias("of"), "whole", "last"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").alias("own"), place(F.col("doc_id")).alias("place"))
    n = copies(options.get("most", 3.0)).cast("int")
    rows = rows.join(limits, F.col("own").eqNullSafe(F.col("of"))).where(n > 0)
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), n)).alias("copy")).select("row.*")
