"""Fuzzy line deduplication: MinHash of character shingles, banding, exact Jaccard verification, union-find. Native only."""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import bucket_classes, shared_buckets

#: Characters of a shingle; similarity of lines that count as one; bands and minima in a band.
SHINGLE, SIMILAR, BANDS, ROWS = 8, 0.8, 8, 4
#: The masks are below 2**62, so that XOR keeps a hash's two upper bits: of any line with hashes below QUARTER the least by any
#: mask is one of those. Lines of up to SHORT shingles often have none.
QUARTER, SHORT = -(1 << 62), 64
#: Strata of hashes, by the bits below those two, and their first bit: masks that differ in these bits only share their minima
#: within strata, so that a hash is folded in for one mask in STRATA.
STRATA, STRATUM = 8, 59


@dataclass(frozen=True)
class Hashes:
    """XOR masks: the least value of hash XOR mask over a line's shingles is one minimum. Each lower part drawn comes with
    every stratum once, in random order: bands that meet the strata in turn would find fewer of the short lines."""

    masks: tuple[int, ...]

    @classmethod
    def drawn(cls, n: int = BANDS * ROWS, seed: int = 17) -> Hashes:
        r = random.Random(seed)
        low = [r.getrandbits(STRATUM) for _ in range(-(-n // STRATA))]
        return cls(tuple(r.sample([s << STRATUM | x for x in low for s in range(STRATA)], n)))


def units(line: Column) -> Column:
    """Two bytes for each character (UTF-16 unit), so that a shingle is a slice."""
    return F.encode(line, "UTF-16BE")


def n_shingles(b: Column) -> Column:
    return F.greatest((F.length(b) / 2).cast("int") - SHINGLE + 1, F.lit(1))


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line (position), plain, key: the non-blank lines. key is the 64-bit hash
    that a line is known by; plain is what lines are compared by: lower case, no blanks at either end. Texts are put in lower
    case whole, and blanks other than spaces are cut off only where a line has any at its ends."""
    low = F.lower(F.coalesce("text", F.lit("")))
    base = docs.select("doc_id", F.xxhash64("text", F.lit(1)).alias("text_hash"), F.posexplode(F.split(low, "\n", -1)).alias("line", "raw"))
    base = base.withColumn("plain", F.trim("raw"))
    odd = reduce(or_, [at("plain", F.lit(c)) for c in common.BLANKS if c not in " \n" for at in (F.startswith, F.endswith)])
    plain = F.when(odd, F.btrim("raw", F.lit(common.BLANKS))).otherwise(F.col("plain"))
    return base.select("doc_id", "text_hash", "line", plain.alias("plain")).where("plain <> ''").withColumn("key", F.xxhash64("plain"))


def minima(lines: DataFrame, hashes: Hashes, all_shingles: bool = False) -> DataFrame:
    """key, n (rows of the line), home, m0, m1, ... for the rows (key, text_hash, plain) of lines: the minima of the hashes of each line's
    shingles. A shingle is a row only inside one generated stage: it is sliced, hashed and folded into its line's minima where
    the text was read. Without all_shingles, those that cannot be a minimum are passed over, but for a line whose every shingle
    was passed over, which is `open`: it has to be read again, from the text with the hash home.

    A row is folded in for each distinct lower part of the masks, within its hash's stratum. XOR with a mask's stratum bits
    leaves the order within a stratum as it is, so the least of a lower part's minima XOR those bits is the mask's minimum."""
    rows = lines.select("key", "text_hash", units(F.col("plain")).alias("b"))
    rows = rows.select("key", "text_hash", "b", F.explode(F.sequence(F.lit(1), 2 * n_shingles(F.col("b")) - 1, F.lit(2))).alias("i"))
    long = F.length("b") > 2 * (SHORT + SHINGLE - 1)
    rows = rows.select("key", "text_hash", "i", long.alias("long"), F.xxhash64(F.substring(F.col("b"), F.col("i"), F.lit(2 * SHINGLE))).alias("h"))
    if not all_shingles:
        rows = rows.where((F.col("h") < QUARTER) | ~F.col("long") | (F.col("i") == 1))
    rows = rows.withColumn("s", F.shiftright("h", STRATUM).bitwiseAND(STRATA - 1).cast("int"))
    parts = [divmod(m, 1 << STRATUM) for m in hashes.masks]
    low = {x: j for j, x in enumerate(dict.fromkeys(x for _, x in parts))}
    first = {"n": "count(1) FILTER (WHERE i = 1)", "long": "max(long) FILTER (WHERE i = 1)", "home": "max(text_hash) FILTER (WHERE i = 1 AND long)"}
    own = {f"l{j}_{s}": f"min(h ^ {x}L) FILTER (WHERE s = {s})" for s in range(STRATA) for x, j in low.items()}
    rows = rows.groupBy("key").agg(*[F.expr(x).alias(c) for c, x in (first | own).items()])
    # where every stratum holds hashes of the first quarter, a mask's own stratum has its minimum
    full = reduce(and_, [F.coalesce(F.col(f"l0_{s}") < QUARTER, F.lit(False)) for s in range(STRATA)])
    rows = rows.select("*", full.alias("full"))
    merged = lambda to, j: F.least(*[F.col(f"l{j}_{s}").bitwiseXOR(F.lit(to << STRATUM)) for s in range(STRATA)])
    found = [F.when(F.col("full"), F.col(f"l{low[x]}_{to}").bitwiseXOR(F.lit(to << STRATUM))).otherwise(merged(to, low[x])).alias(f"m{k}") for k, (to, x) in enumerate(parts)]
    # a lambda in the projection keeps it out of the aggregate's generated method, which would be too long for the JVM to compile
    rows = rows.select("key", "n", "long", F.get(F.transform(F.array("home"), lambda x: x), F.lit(0)).alias("home"), *found)
    return rows.withColumn("open", F.lit(False) if all_shingles else F.col("long") & (F.col("m0") >= QUARTER)).drop("long")


def banded(found: DataFrame) -> DataFrame:
    """key, n, open, home of open ones, bands: the band keys of minima."""
    bands = F.array(*[F.xxhash64(F.lit(b), *[f"m{b * ROWS + r}" for r in range(ROWS)]) for b in range(BANDS)])
    return found.select("key", "n", "open", F.when(F.col("open"), F.col("home")).alias("home"), bands.alias("bands"))


def hashed(rows: DataFrame, line: str, out: str) -> DataFrame:
    """Replaces a text column by its shingles' hashes, repeats included. The units are a column of their own, made once a row,
    and a parameter of the outer function: read as a column, they would be copied for each shingle."""
    others = [c for c in rows.columns if c != line]
    rows = rows.select(*others, units(F.col(line)).alias("_b"))
    of = lambda b: F.transform(F.sequence(F.lit(1), 2 * n_shingles(b) - 1, F.lit(2)), lambda i: F.xxhash64(F.substring(b, i, F.lit(2 * SHINGLE))))
    return rows.select(*others, F.get(F.transform(F.array("_b"), of), F.lit(0)).alias(out))


def line_classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line, class_id, kept for the lines that have another like them; others are in a class of their own.

    Lines are alike if the Jaccard similarity of their 8-character shingle sets (in lower case, blanks at the ends off) is 0.8
    or more, or through others that are; a line of fewer than 8 characters is one shingle. Of each class the line that comes
    first, by doc_id (null first) and position, is kept."""
    spark, hashes = docs.sparkSession, Hashes.drawn()
    ws = common.Workspace(spark, "lines")
    found = ws.write(banded(minima(line_table(docs), hashes)), "bands")
    again = common.settled(found.where("open").select("key", "n", "home"))
    if not again.isEmpty():
        homes = common.only_near(docs.select("doc_id", "text", F.xxhash64("text", F.lit(1)).alias("home")), again, "home")
        rest = common.only_near(line_table(homes), again).join(again.select("key"), "key")  # a semi join would be pushed below the bitmap
        whole = banded(minima(rest, hashes, True)).select("key", "bands").join(again, "key")
        found = found.where("not open").unionByName(common.settled(whole.select("key", "n", F.lit(False).alias("open"), "home", "bands")))
    common.reclaim(spark)
    members = common.settled(shared_buckets(found.select("key", F.explode("bands").alias("bucket"))))
    several = common.settled(found.where("n > 1").select(F.col("key").alias("node")))
    ws.close()
    common.reclaim(spark)
    keys = members.select("key").distinct().withColumn("near", F.lit(True)).join(several.select(F.col("node").alias("key")), "key", "full_outer")
    keys = common.settled(keys.select("key", F.coalesce("near", F.lit(False)).alias("near")))
    found = common.only_near(line_table(docs), keys).join(keys, "key").withColumn("plain", F.when(F.col("near"), F.col("plain"))).drop("near")
    found = common.settled(found)
    texts = common.settled(found.where("plain is not null").groupBy("key").agg(F.first("plain").alias("plain")))
    roots = bucket_classes(members, texts, hashed, SIMILAR)
    classes = common.settled(roots.join(several, "node", "full_outer").select(F.col("node").alias("key"), F.coalesce("root", "node").alias("class_id")))
    alike = found.join(classes, "key").select("doc_id", "text_hash", "line", "class_id")
    first = alike.groupBy("class_id").agg(F.min(F.struct("doc_id", "text_hash", "line")).alias("first"))
    first = first.select(F.col("class_id").alias("of"), F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash"), F.col("first.line").alias("at"))
    # by class and place together, so that no class, however large, meets in one task
    same = (F.col("class_id") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")) & (F.col("line") == F.col("at"))
    return alike.join(first, same, "left").select("doc_id", "text_hash", "line", "class_id", F.col("of").isNotNull().alias("kept"))


def by_document(docs: DataFrame) -> DataFrame:
    """One row per distinct (doc_id, text): its lines that have others like them, as an array of (line, class_id, kept)."""
    found = line_classes(docs)
    return found.distinct().groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("line", "class_id", "kept"))).alias("alike"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, alike (line, class_id, kept). Null and blank texts have no lines to
    drop; blank lines stay; an empty table gives no rows; other columns of docs play no part."""
    narrow = docs.select("doc_id", "text")
    found = by_document(narrow).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "alike")
    text = F.coalesce("text", F.lit(""))
    counted = narrow.select("doc_id", F.xxhash64("text", F.lit(1)).alias("text_hash"), (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    rows = counted.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    alike = F.coalesce("alike", F.array().cast("array<struct<line:int,class_id:bigint,kept:boolean>>"))
    rows = rows.select("doc_id", "n_lines", alike.alias("alike"))
    return rows.select("doc_id", "n_lines", F.size(F.filter("alike", lambda x: ~x["kept"])).cast("long").alias("n_dropped"), "alike")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without their dropped lines, with docs' own columns, whatever their names; n_chars, if there is such a
    column, follows the text. A document whose non-blank lines are all dropped goes; one without lines (null, empty, blank)
    stays. Rows that repeat in id and text count as one document and are treated the same. An empty table gives no rows."""
    found = by_document(docs.select("doc_id", "text"))
    gone = F.transform(F.filter("alike", lambda x: ~x["kept"]), lambda x: x["line"])
    found = found.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), gone.alias("gone")).where(F.size("gone") > 0)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text", F.lit(1)).alias("text_hash"))
    rows = whole.join(found, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    kept = F.filter(F.split("row.text", "\n", -1), lambda x, i: ~F.array_contains("gone", i))
    rows = rows.select("row", F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n")).alias("text"), F.col("gone").isNotNull().alias("cut"))
    rows = rows.where(~F.col("cut") | (F.btrim("text", F.lit(common.BLANKS)) != ""))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("cut"), F.length("text")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("text")}
    return rows.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
