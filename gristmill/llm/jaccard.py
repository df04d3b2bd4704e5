"""N-gram Jaccard join by a MinHash LSH forest: paths of minima in tries, matched prefixes shortened until each text has its
recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .components import linked_members, shared_buckets
from .kernel import U64, mix, shingles, slices, words

#: Words of a shingle, similarity, trees of the forest, depth of a tree (labels of a path), bytes of a label, and the recall
#: of two texts that are just similar enough.
SHINGLE, SIMILAR, TREES, DEPTH, LABEL, RECALL = 5, 0.8, 16, 10, 4, 0.999


def expected_recall(*depths: int, similar: float = SIMILAR) -> float:
    """Chance that two texts share a prefix in some tree; depths: the prefix's depth in each."""
    missed = 1.0
    for d in depths:
        missed *= 1 - similar**d
    return 1 - missed


#: The depth to which prefixes are shortened at most, and in how many of its trees a text needs that; the others may stay at
#: DEPTH.
FLOOR = max(d for d in range(1, DEPTH + 1) if expected_recall(*[d] * TREES) >= RECALL)
NEEDED = min(n for n in range(TREES + 1) if expected_recall(*[FLOOR] * n, *[DEPTH] * (TREES - n)) >= RECALL)


def text_sets(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, sorted within the text, and bounds."""
    h, bounds = shingles(*words(data, ends), SHINGLE)
    of = np.repeat(np.arange(len(ends) - 1), np.diff(bounds))
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.searchsorted(of[new], np.arange(len(ends)))


def set_keys(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit key for each set; equal sets have equal keys, and all empty ones 0."""
    out = np.zeros(len(bounds) - 1, U64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = mix(np.add.reduceat(mix(h + U64(1)), bounds[:-1][full])) | U64(1)
    return out.view(np.int64)


def tree_paths(h: np.ndarray, bounds: np.ndarray, seed: int = 5) -> np.ndarray:
    """For each set, in each tree, its path: DEPTH minima as LABEL bytes each, so that paths sort as the trie does and the
    prefix of depth d is the first d * LABEL bytes."""
    odd = np.random.default_rng(seed).integers(1, 1 << 62, (TREES, DEPTH), dtype=np.uint64) * U64(2) + U64(1)
    out = np.zeros((len(bounds) - 1, TREES, DEPTH), ">u4")
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for t in range(TREES):
            for d in range(DEPTH):
                x = h * odd[t, d]
                x ^= x >> U64(32)
                out[full, t, d] = mix(np.minimum.reduceat(x * odd[t, (d + 1) % DEPTH], bounds[:-1][full])) >> U64(32)
    return out


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, key, paths of every document's whole text. text_hash tells rows with one id apart."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, ends in slices(b, "text"):
                h, bounds = text_sets(data, ends)
                flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(DEPTH * LABEL), part.num_rows * TREES, [None, pa.py_buffer(tree_paths(h, bounds).tobytes())])
                paths = pa.ListArray.from_arrays(pa.array(np.arange(0, part.num_rows * TREES + 1, TREES, dtype=np.int32)), flat.cast(pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(set_keys(h, bounds)), paths], ["doc_id", "text_hash", "key", "paths"])

    return identified(docs).mapInArrow(sign, "doc_id long, text_hash long, key long, paths array<binary>")


def identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text", F.lit(1)).alias("text_hash"), "text")


def matched_nodes(texts: DataFrame) -> DataFrame:
    """key, bucket: the tries' nodes in which texts are compared. texts: key, paths.

    Every text begins with its whole paths and has them shortened, the least crowded tree first, to FLOOR, until two texts
    that are just similar enough are found with RECALL; that leaves the paths of its most crowded trees long. A node in which one
    text needs the short prefix is short for all in it, so that what a text needs doesn't hang on the others. Nodes that one
    text has alone are left out."""
    node = lambda d: F.xxhash64("tree", F.substring("path", 1, d * LABEL))
    each = texts.select("key", F.posexplode("paths").alias("tree", "path")).select("key", node(FLOOR).alias("bucket"), node(DEPTH).alias("deep"))
    each = common.settled(each.distinct())
    crowd = common.settled(each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = common.only_near(each, crowd, "bucket").join(crowd, "bucket")
    crowded = F.row_number().over(W.partitionBy("key").orderBy(F.desc("n"), "bucket"))
    met = common.settled(met.select("key", "bucket", "deep", (crowded > TREES - NEEDED).alias("short")))
    long = met.groupBy("bucket").agg(F.max("short").alias("needed")).where("not needed")
    return met.join(long, "bucket", "left").select("key", F.when(F.col("needed").isNull(), F.col("bucket")).otherwise(F.col("deep")).alias("bucket"))


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, set: the shingle sets of the wanted (key, text_hash), one text for each key."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, data, ends in slices(b, "text"):
                h, bounds = text_sets(data, ends)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(set_keys(h, bounds)), lists], ["key", "set"])

    near = common.only_near(identified(docs), wanted, "text_hash")
    near = near.join(wanted.select("text_hash").distinct(), "text_hash")  # a semi join would be pushed below the bitmap
    found = near.select("text").mapInArrow(gather, "key long, set array<long>").join(wanted.select("key"), "key", "left_semi")
    return found.groupBy("key").agg(F.first("set").alias("set"))


def one_text_each(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """key, text_hash: one text of each of the keys."""
    return common.settled(rows.join(keys, "key", "left_semi").groupBy("key").agg(F.min("text_hash").alias("text_hash")))


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (doc_id, text_hash, key), classes (node, root) of keys, and (key, n_links): with how many others a key has Jaccard
    similarity SIMILAR or more.

    Equal shingle sets share a key and are joined once. A matched trie node that several keys share is a bucket;
    linked_members compares them all, by their exact sets, without a row for a pair."""
    rows = common.settled(signed(docs))
    members = common.settled(shared_buckets(common.settled(matched_nodes(rows.where("key <> 0")))))
    common.reclaim(docs.sparkSession)
    sets = common.settled(sets_of(docs, one_text_each(rows, members.select("key").distinct())))
    common.reclaim(docs.sparkSession)
    return rows.select("doc_id", "text_hash", "key"), *linked_members(members, lambda t: t.join(sets, "key"), SIMILAR)


def classed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, class_id, text_id, n_links, class (a number that only tells classes apart) of every row."""
    rows, roots, degree = linked(docs)
    roots = roots.withColumnRenamed("node", "key")
    texts = rows.groupBy("key").agg(F.min("doc_id").alias("text_id"))
    texts = common.settled(texts.join(roots, "key", "left").join(degree, "key", "left").select("key", "text_id", F.coalesce("root", "key").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    classes = texts.groupBy("root").agg(F.min("text_id").alias("class_id"))
    texts = texts.join(classes, "root").select("key", "text_id", "class_id", "n_links", F.col("root").alias("class"))
    return rows.join(texts, "key").select("doc_id", "text_hash", "class_id", "text_id", "n_links", "class")


def join(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, text_id, n_links.

    class_id is the least doc_id of all documents that links connect, text_id that of the documents with the same shingle set
    (words in lower case A-Z; fewer than five words are one shingle). n_links counts the other
    texts that its text is linked to, of which each is found with a chance of RECALL or more; copies are not expanded. Texts without words are one class without links. A
    null id is left out of the ids. Rows repeat as they come; an empty table gives no rows; other columns of docs play no part."""
    return classed(docs).select("doc_id", "class_id", "text_id", "n_links")


def deduplicated(docs: DataFrame) -> DataFrame:
    """Of each class the row with the least id, with docs' own columns, whatever their names; a null id comes last, and of
    rows that repeat in id and text one stays. Rows of one id with other texts are judged by their own text; texts without
    words are one class. An empty table gives no rows."""
    found = common.settled(classed(docs.select("doc_id", "text")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = found.groupBy("class").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = found.join(first, "class")
    again = rows.select("doc_id", "text_hash", "first").distinct()
    gone = again.where(~order.eqNullSafe(F.col("first"))).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text", F.lit(1)).alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    out = whole.join(gone, same, "left_anti")
    repeated = common.settled(rows.where(order.eqNullSafe(F.col("first"))).groupBy("doc_id", "text_hash").count().where("count > 1").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")))
    if not repeated.isEmpty():
        once = out.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
        out = out.join(repeated, same, "left_anti").unionByName(once)
    return out.select("row.*")
