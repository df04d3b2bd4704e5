"""Connected components of a link table by distributed union-find, classes of similar keys, and their links counted. Native
expressions only, but for the counting of links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, only_near, reclaim, settled


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that links (a, b) of longs name; root is the least node of the component.

    Rounds of large star and small star: each node's greater, then lesser neighbours are tied to its least one, until every
    component is a star. Every round is a few aggregates and equi-joins on node ids, settled to the shared folder."""
    edges = narrow(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = narrow(small.select("e.*").where("a <> b").distinct())
        # stars: a node is tied to one other only, and that one to none
        roles = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("tied")), F.struct(F.col("b").alias("node"), F.lit(0).alias("tied")))).alias("e")).select("e.*")
        bad = roles.groupBy("node").agg(F.sum("tied").alias("tied"), F.min("tied").alias("least")).where("tied > 1 or (tied = 1 and least = 0)")
        if bad.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


#: Unlinked members that meet one part of their group at once, rows of such a part, and the most classes that a row names at once.
BLOCK, PART_ROWS, NAMED = 256, 1_024, 8


def shared_buckets(placed: DataFrame) -> DataFrame:
    """bucket, key, weight of the rows of placed (bucket, key), distinct, whose bucket holds several keys; of buckets with the
    same keys one. weight, the bucket's size, is what the bucket adds to how central its keys are."""
    held = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("key")).alias("x")).where("n > 1")
    once = settled(held.groupBy("n", "x").agg(F.min("bucket").alias("bucket"), (F.col("n") * F.count(F.lit(1))).alias("weight")).select("bucket", "weight"))
    return only_near(placed, once, "bucket").join(once, "bucket").select("bucket", "key", "weight")


def leaders(members: DataFrame) -> DataFrame:
    """lead, key: each bucket of members (bucket, key, weight) has one leader, the key that shares buckets with most others,
    which in a group of edited copies is the one nearest to their common original. key is another member of such a bucket."""
    central = members.groupBy("key").agg(F.sum("weight").alias("central"))
    first = members.join(central, "key").groupBy("bucket").agg(F.max_by("key", F.struct("central", "key")).alias("lead"))
    return settled(members.join(first, "bucket").where("key <> lead").select("lead", "key").distinct())


def led_members(members: DataFrame, with_sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """lead, key, distance of the leaders of members: the Jaccard distance of each key to its leaders. with_sets adds the
    array `set` of each `key` to a table."""
    distance = lambda s, t, n: 1 - n / (F.size(s) + F.size(t) - n)
    met = leaders(members)
    lead_sets = with_sets(met.select(F.col("lead").alias("key")).distinct()).select(F.col("key").alias("lead"), F.col("set").alias("lead_set"))
    led_by = with_sets(met.groupBy("key").agg(F.collect_set("lead").alias("leads"))).select("key", "set", F.explode("leads").alias("lead"))
    both = led_by.join(lead_sets, "lead").withColumn("n", F.size(F.array_intersect("set", "lead_set")))
    return settled(both.select("lead", "key", distance(F.col("set"), F.col("lead_set"), F.col("n")).alias("distance")))


def differences(met: DataFrame, texts: DataFrame, elements: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """lead, key, n, missing, extra, diff for each row of met (lead, key): the size of the leader's set, how many of its
    elements the key's set lacks, how many others that one has, and, where the leader has several members, those elements.

    texts (key, plain) are what elements(rows, column, out) makes arrays of elements from; they are made where leader and
    member have met, so that texts are shuffled and not sets. A leader's members are spread over parts of PART_ROWS."""
    n = met.groupBy("lead").agg(F.count(F.lit(1)).alias("members")).withColumn("parts", F.ceil(F.col("members") / PART_ROWS))
    leads = n.join(texts.withColumnRenamed("key", "lead"), "lead").select("lead", "plain", F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("part"))
    leads = elements(leads.repartition("lead", "part"), "plain", "raw").select("lead", "part", F.array_distinct("raw").alias("of_lead"))
    rows = met.join(n, "lead").join(texts, "key").select("lead", "key", "plain", "members", (F.pmod(F.xxhash64("key"), F.col("parts")) + 1).alias("part"))
    rows = elements(rows.repartition("lead", "part"), "plain", "raw").join(leads, ["lead", "part"])
    rows = rows.select("lead", "key", "members", F.size("of_lead").alias("n"), F.array_except("of_lead", "raw").alias("gone"), F.array_except("raw", "of_lead").alias("new"))
    diff = F.when(F.col("members") > 1, F.concat("gone", "new")).otherwise(F.array().cast("array<bigint>"))
    return settled(rows.select("lead", "key", "n", F.size("gone").alias("missing"), F.size("new").alias("extra"), diff.alias("diff")))


def relabelled(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after links (a, b) between roots, or nodes that have none yet, are joined too."""
    new = components(links).withColumnRenamed("root", "now")
    moved = roots.join(new.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("now", "root").alias("root"))
    alone = new.join(roots.select("node"), "node", "left_anti").select("node", F.col("now").alias("root"))
    return narrow(moved.union(alone))


def bucket_classes(members: DataFrame, texts: DataFrame, elements: Callable[[DataFrame, str, str], DataFrame], similar: float) -> DataFrame:
    """The classes (node, root) of keys that are similar within the buckets of one leader of members (bucket, key, weight),
    without a row for every pair. texts and elements are those of differences().

    First each member is compared with its leader. Members linked to it are in one class; the others still have to meet all
    members. Both are known by what they differ from their leader in: two of them have n - missing - missing' + x elements in
    common, where x counts the differences that they share. As x is at most the lesser of the missing plus the lesser of the
    extra elements, most pairs are settled by their counts, and the others by an intersection of the short differences.

    A group's unlinked members are dealt in blocks of about BLOCK, each sent as one array to the parts of the group's rows; a
    row gives the classes that it is linked to, and not pairs: at most NAMED, and those that have more come again when these
    are joined, until none is left. So no two members of a group that are similar stay apart."""
    share = similar / (1 + similar)
    known = differences(leaders(members), texts, elements).withColumn("size", F.col("n") - F.col("missing") + F.col("extra"))
    known = known.withColumn("linked", F.col("n") - F.col("missing") >= share * (F.col("n") + F.col("size")) - 1e-9)
    known = known.withColumn("distance", 1 - (F.col("n") - F.col("missing")) / (F.col("n") + F.col("extra")))
    roots = narrow(components(known.where("linked").select(F.col("lead").alias("a"), F.col("key").alias("b"))))
    reclaim(members.sparkSession)
    # by the triangle inequality a linked member can only be similar to an unlinked one whose distance is that near
    far = known.where(~F.col("linked")).groupBy("lead").agg(F.min("distance").alias("nearest"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    left = known.join(far, "lead").where(F.col("distance") + (1 - similar) + 1e-9 >= F.col("nearest"))
    left = left.select(F.col("lead").alias("group"), "key", "n", "missing", "extra", "diff", "linked", "blocks", (share * F.col("size") + F.col("missing")).alias("weight"))
    held = left.columns
    while True:
        left = left.join(roots.withColumnRenamed("node", "key"), "key", "left").select(*held, F.coalesce("root", "key").alias("root"))
        open_ = left.groupBy("group").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("parts")).where("x <> y")
        left = settled(left.join(open_.select("group", "parts"), "group"))
        block = F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")) + 1
        met = F.struct("key", "root", "missing", "extra", "weight", "diff")
        led = left.where(~F.col("linked")).groupBy("group", block.alias("block")).agg(F.collect_list(met).alias("led"), F.max("parts").alias("parts"))
        led = led.select("group", "block", "led", F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("part"))
        rows = left.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")) + 1).withColumn("block", F.explode(F.sequence(F.lit(1), F.col("blocks"))))
        rows = rows.join(led, ["group", "block", "part"])
        wanted = lambda x: F.col("weight") + x["weight"] - F.col("n") - 1e-6
        alike = lambda x: (
            (x["root"] != F.col("root"))
            & (F.col("linked") | (x["key"] < F.col("key")))
            & (F.least("missing", x["missing"]) + F.least("extra", x["extra"]) >= wanted(x))
            & (F.size(F.array_intersect("diff", x["diff"])) >= wanted(x))
        )
        hits = F.array_distinct(F.transform(F.filter("led", alike), lambda x: x["root"]))
        found = rows.select("group", "root", F.posexplode(F.slice(hits, 1, NAMED + 1)).alias("i", "to"))
        found = settled(found.groupBy("group", "root", "to").agg(F.max("i").alias("i")))
        if found.isEmpty():
            return roots
        roots = relabelled(roots, found.select(F.col("root").alias("a"), F.col("to").alias("b")))
        reclaim(members.sparkSession)
        again = found.where(F.col("i") == NAMED).select("group").distinct()
        if again.isEmpty():
            return roots
        left = left.join(again, "group").select(*held)


#: Members of a group that one side of a block of pairs has at most, about.
BLOCK_ROWS = 512
#: Distinct elements that a block's tables have as columns at once.
BLOCK_COLUMNS = 8_192


def shared_counts(values: np.ndarray, of: np.ndarray, n: int, split: int) -> np.ndarray:
    """How many values rows i < split and j >= split have in common, or, with split 0, all rows i and j. values holds the sets
    of n rows one after the other, of the row of each."""
    _, at, times = np.unique(values, return_inverse=True, return_counts=True)
    common = times[at] > 1
    columns = np.cumsum(times > 1) - 1
    at, of = columns[at[common]], of[common]
    out = np.zeros((split or n, n - split), np.float32)
    order = np.argsort(at, kind="stable")
    at, of = at[order], of[order]
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, BLOCK_COLUMNS):
        here = slice(*np.searchsorted(at, [low, low + BLOCK_COLUMNS]))
        table = np.zeros((n, min(BLOCK_COLUMNS, int(at[-1]) + 1 - low)), np.float32)
        table[of[here], at[here] - low] = 1
        out += table[: split or n] @ table[split:].T
    return out


def block_links(group: int, keys: np.ndarray, split: int, distances: np.ndarray, leads: list[np.ndarray], sets: list[np.ndarray], similar: float) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a block the number of its links in the block, without the pairs that a group of a lesser leader has
    too, and the least key that its links in the block connect it to. Rows before split meet those from split on; with split
    0 all meet all."""
    n, spread = len(keys), lambda x: np.repeat(np.arange(len(x)), [len(y) for y in x])
    reach = 1 - similar + 1e-9
    near = np.abs(distances[: split or n, None] - distances[None, split:]) <= reach
    if not split:
        near &= np.arange(n)[:, None] < np.arange(n)[None, :]
    counts, least = np.zeros(n, np.int64), keys.copy()
    if not near.any():
        return counts, least
    size = np.array([len(x) for x in sets], np.float64)
    same = shared_counts(np.concatenate(sets), spread(sets), n, split)
    alike = near & ((2 - reach) * same >= (1 - reach) * (size[: split or n, None] + size[None, split:]))
    a, b = np.nonzero(alike)
    while len(a):
        before = least.copy()
        np.minimum.at(least, a, least[b + split])
        np.minimum.at(least, b + split, least[a])
        if (before == least).all():
            break
    lesser = [x[x < group] for x in leads]
    if len(a) and any(len(x) for x in lesser):
        alike &= shared_counts(np.concatenate(lesser), spread(lesser), n, split) == 0
    counts[: split or n] += alike.sum(1)
    counts[split:] += alike.sum(0)
    return counts, least


def linked_members(members: DataFrame, with_sets: Callable[[DataFrame], DataFrame], similar: float) -> tuple[DataFrame, DataFrame]:
    """The classes (node, root) of keys that are similar within some bucket of members (bucket, key, weight), and (key,
    n_links): with how many keys that share a bucket's leader with it, or are that leader, each key is similar.

    Buckets with one leader are one group, and all members of a group meet, in blocks of up to about BLOCK_ROWS by
    BLOCK_ROWS. By the triangle inequality, members can only be similar if their distances to the leader differ by 1 -
    similar at most: a group of several blocks is parted in bands of distance so wide, and only a band's members and those of
    neighbouring bands meet. A pair counts in the group of the least leader that both have. What leaves a task is a row for
    each member of a block, not its pairs."""
    reach, bands = 1 - similar + 1e-9, int(1 / (1 - similar)) + 2
    known = led_members(members, with_sets)
    own = known.select("lead", F.col("lead").alias("key"), F.lit(0.0).alias("distance")).distinct()
    led = known.union(own)
    sizes = led.groupBy("lead").agg(F.count(F.lit(1)).alias("n"))
    led = led.join(sizes, "lead").withColumn("band", F.when(F.col("n") <= BLOCK_ROWS, 0).otherwise(F.floor(F.col("distance") / reach)).cast("int"))
    parts = led.groupBy("lead").agg(F.array(*[F.ceil(F.count_if(F.col("band") == b) / BLOCK_ROWS).cast("int") for b in range(bands)]).alias("parts"))
    led = led.join(parts, "lead").withColumn("part", F.pmod(F.xxhash64("key"), F.get("parts", F.col("band"))).cast("int"))
    band, part = F.col("band"), F.col("part")
    block = lambda b, p, c, q: F.struct(b.alias("b"), p.alias("p"), c.alias("c"), q.alias("q"))
    count = lambda b: F.coalesce(F.when(b >= 0, F.get("parts", b)), F.lit(0))
    each = lambda n, f: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda q: q < n), f)
    blocks = F.concat(
        each(count(band), lambda q: block(band, F.least(part, q), band, F.greatest(part, q))),
        each(count(band + 1), lambda q: block(band, part, band + 1, q)),
        each(count(band - 1), lambda q: block(band - 1, q, band, part)),
    )
    leads = led.groupBy("key").agg(F.collect_set("lead").alias("leads"))
    rows = led.select("lead", "key", "distance", (band * (1 << 20) + part).alias("side"), blocks.alias("blocks"))
    rows = with_sets(rows.join(leads, "key")).select("lead", "key", "distance", "side", "leads", "set", F.explode("blocks").alias("block"))
    rows = rows.select("lead", "key", "distance", "side", "leads", "set", F.xxhash64("lead", "block").alias("block"), ((F.col("block.b") == F.col("block.c")) & (F.col("block.p") == F.col("block.q"))).alias("whole"))

    def count_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            lead, key, distance, side, block, whole = (t.column(c).to_numpy() for c in ("lead", "key", "distance", "side", "block", "whole"))
            held = {c: (t.column(c).chunk(0).offsets.to_numpy(), t.column(c).chunk(0).values.to_numpy()) for c in ("leads", "set")}
            n, least = np.zeros(len(key), np.int64), key.copy()
            edges = np.flatnonzero(np.r_[True, (lead[1:] != lead[:-1]) | (block[1:] != block[:-1]), True])
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                of = lambda c, low=low, high=high: [held[c][1][held[c][0][i] : held[c][0][i + 1]] for i in range(low, high)]
                split = 0 if whole[low] else int((side[low:high] == side[low]).sum())
                if high - low > max(split, 1):
                    n[low:high], least[low:high] = block_links(int(lead[low]), key[low:high], split, distance[low:high], of("leads"), of("set"), similar)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(least)], ["key", "n", "least"])

        kept: list[pa.Table] = []
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            lead, block = t.column("lead").to_numpy(), t.column("block").to_numpy()
            last = int(np.flatnonzero(np.r_[True, (lead[1:] != lead[:-1]) | (block[1:] != block[:-1])])[-1])
            if kept and (kept[-1].column("lead")[-1].as_py(), kept[-1].column("block")[-1].as_py()) != (lead[0], block[0]):
                yield counted(pa.concat_tables(kept))
                kept = []
            if last:
                yield counted(pa.concat_tables([*kept, t.slice(0, last)]))
                kept = []
            kept.append(t.slice(last))
        if kept:
            yield counted(pa.concat_tables(kept))

    rows = rows.repartition("lead", "block").sortWithinPartitions("lead", "block", "side")
    found = rows.mapInArrow(count_links, "key long, n long, least long")
    found = settled(found.groupBy("key").agg(F.sum("n").alias("n_links"), F.collect_set(F.when(F.col("least") < F.col("key"), F.col("least"))).alias("least")))
    links = found.select(F.explode("least").alias("a"), F.col("key").alias("b"))
    return narrow(components(links)), found.select("key", "n_links")
