"""Document fingerprints: threshold-scaled sketches of five-word shingles. Native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
#: One hash in so many is retained.
SCALE = 4
#: Ids to a bucket, as a power of two: neighbours in id order meet in their bucket.
BUCKET_BITS = 8
NO_ID = -(1 << 63)


def shingle_hashes(w: Column, k: int = SHINGLE) -> Column:
    """64-bit hashes of a word array's k-word shingles; fewer words than k are one shingle, none have none."""
    n = F.size(w)
    of = lambda i: F.xxhash64(*[F.get(w, i - (k - j)) for j in range(k)])
    return F.when(n >= k, F.transform(F.sequence(F.lit(k), n), of)).when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(*[F.get(w, F.lit(j)) for j in range(k)])))


def add_sketch(df: DataFrame, text: str, out: str, scale: int = SCALE) -> DataFrame:
    """Adds the sketch of a text column: its distinct shingle hashes below 1/scale of the hash range, sorted; if there are
    none, the least hash. Sketches of two parts merge by array_union, and the overlap of two sketches estimates containment
    however unequal the documents are. Each step is a column, so that none is computed twice."""
    kept = df.columns
    df = df.withColumn("_words", common.words(F.col(text))).select(*kept, shingle_hashes(F.col("_words")).alias("_all"))
    df = df.withColumn("_below", F.filter("_all", lambda h: h < NO_ID + (1 << 64) // scale))
    least = F.when((F.size("_below") == 0) & (F.size("_all") > 0), F.array(F.array_min("_all"))).otherwise(F.array_distinct("_below"))
    return df.select(*kept, F.sort_array(least).alias(out))


def as_text(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity: 1 for two empty sketches."""
    common_ = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(common_ / (F.size(a) + F.size(b) - common_))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def followers(keys: DataFrame, limit: int = 20_000) -> DataFrame:
    """(key, before): for each distinct long key the next higher one, and for the highest the lowest. While there are many
    keys, they are bucketed by their high bits, and only the buckets' edges are looked up, by the same means."""
    lowest = keys.agg(F.min("key")).first()[0]
    if keys.limit(limit + 1).count() <= limit:
        lead = F.lead("key").over(W.orderBy("key"))
    else:
        up = keys.withColumn("bucket", F.shiftright("key", BUCKET_BITS))
        firsts = common.settled(up.groupBy(F.col("bucket").alias("key")).agg(F.min("key").alias("first")))
        nexts = followers(firsts.select("key"), limit).join(firsts.select(F.col("key").alias("before"), "first"), "before").select(F.col("key").alias("bucket"), F.col("first").alias("edge"))
        keys = up.join(nexts, "bucket")
        lead = F.coalesce(F.lead("key").over(W.partitionBy("bucket").orderBy("key")), F.when(F.col("edge") > F.col("key"), F.col("edge")))
    return common.settled(keys.select("key", lead.alias("before")).withColumn("before", F.coalesce("before", F.lit(lowest))))


def with_next(docs: DataFrame, more, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the columns that `more` adds, and the same of the next document as next_*: descending id, after the
    last the first. Rows with one id follow each other by text; a null id is the lowest; null texts are empty.

    Rows meet in buckets of neighbouring ids. The first row of each bucket is also sent, as a guest, to the bucket before."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), key.alias("key"))
    base = base.withColumn("bucket", F.shiftright("key", BUCKET_BITS))
    heads = common.settled(base.groupBy("bucket").agg(F.max("key").alias("head")))
    before = followers(heads.select(F.col("bucket").alias("key")))
    heads = heads.join(before.withColumnRenamed("key", "bucket"), "bucket").select("bucket", "head", "before")
    rows = base.join(common.broadcast_if_small(common.settled(heads)), "bucket")
    to = F.when(F.col("key") == F.col("head"), F.array(F.struct(F.col("bucket").alias("to"), F.lit(False).alias("guest")), F.struct(F.col("before").alias("to"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.col("bucket").alias("to"), F.lit(False).alias("guest"))))
    rows = rows.select("doc_id", "text", "key", F.inline(to)).repartition("to")
    rows = more(rows)
    order = W.partitionBy("to").orderBy("guest", F.col("key").desc(), "text")
    added = [c for c in rows.columns if c not in ("doc_id", "key", "to", "guest")]
    return rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in added}).where(~F.col("guest"))


def fingerprinted(docs: DataFrame, scale: int = SCALE, **columns) -> DataFrame:
    """op3's contract, with the containments besides. An empty table gives no rows; other columns of docs play no part."""
    rows = with_next(docs, lambda d: add_sketch(d, "text", "fp", scale), **columns)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third)))
    rows = add_sketch(rows, "edited", "efp", scale)
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        containment(F.col("efp"), F.col("fp")).alias("edited_in_text"),
    )
