"""The sheet row that a text is from, as a join: texts are looked up by few of their words in place of all pairs of texts and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gristmill.operators.settle import only_near, settled

#: Characters on either side of a gap; characters of a window; how many of a text's rarest tokens are looked up first; each
#: further round takes four times as many.
SIDE, WINDOW, RAREST = 3, 8, 2


def listed(x: Column) -> Column:
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def tokens(x: Column) -> Column:
    """What spaces part, for keys alone: any way to part serves as long as parts and wholes are parted alike."""
    return F.filter(F.split(x, " "), lambda w: w != "")


def runs(df: DataFrame) -> DataFrame:
    """file, id, n and a row for each token of l as a, with the next two as b and c."""
    l = F.col("l")  # noqa: E741
    return df.select("file", "id", "n", F.inline(F.arrays_zip(l.alias("a"), F.slice(l, F.lit(2), F.size(l)).alias("b"), F.slice(l, F.lit(3), F.size(l)).alias("c"))).alias("a", "b", "c"))


TRIPLE, PAIR = F.when(F.col("c").isNotNull(), F.xxhash64("file", "a", "b", "c")), F.when(F.col("b").isNotNull(), F.xxhash64("file", "a", "b"))


def gap(left: int, right: int) -> Column:
    """The last characters of a token with the first ones of the next."""
    return F.when(F.col("b").isNotNull(), F.xxhash64("file", F.right("a", F.lit(left)), F.lit(" "), F.left("b", F.lit(right))))


def part_keys(df: DataFrame) -> DataFrame:
    """id, kind, key: for each text (file, id, x) keys that every text has that holds it. All tokens of a part but its first and last
    are whole tokens of the other, so the keys are runs of three of these, or the only two ("3", "2"). Parts of two or three tokens have the
    gaps between them (how many characters on either side), and those without a gap their beginning ("w" and its characters)."""
    d = df.withColumn("l", tokens(F.col("x"))).withColumn("n", F.size("l"))
    whole = runs(d.where("n > 3").withColumn("l", F.slice("l", F.lit(2), F.col("n") - 2))).where("c is not null or n = 4 and b is not null")
    whole = whole.select("id", F.when(F.col("n") > 4, F.lit("3")).otherwise(F.lit("2")).alias("kind"), F.coalesce(TRIPLE, PAIR).alias("key"))
    sides = F.concat_ws(" ", F.least(F.length("a"), F.lit(SIDE)), F.least(F.length("b"), F.lit(SIDE)))
    gaps = runs(d.where("n between 2 and 3")).where("b is not null").select("id", sides.alias("kind"), gap(SIDE, SIDE).alias("key"))
    start = F.left("x", F.lit(WINDOW))
    one = d.where("n < 2").select("id", F.concat(F.lit("w"), F.length(start)).alias("kind"), F.xxhash64("file", start).alias("key"))
    return whole.unionByName(gaps).unionByName(one).distinct()


def whole_keys(df: DataFrame, rare: DataFrame) -> DataFrame:
    """id, key: for each text (file, id, x) its keys of the kinds in rare (file, kind)."""
    kinds = sorted(x.kind for x in rare.select("kind").distinct().collect())  # 2 + SIDE ** 2 + WINDOW at most
    made = [TRIPLE if k == "3" else PAIR if k == "2" else gap(*map(int, k.split())) for k in kinds if k[0] != "w"]
    out = df.select("id", F.lit(0).cast("long").alias("key")).limit(0)
    if made:
        of = runs(df.withColumn("l", tokens(F.col("x"))).withColumn("n", F.lit(0)))
        out = of.select("id", (F.explode(F.array(*made)) if made[1:] else made[0]).alias("key"))
    for k in kinds:
        if k[0] == "w":  # all windows of so many characters, in files that have such parts
            files = rare.where(F.col("kind") == k).select(F.xxhash64("file").alias("key")).distinct()
            of = only_near(df.withColumn("key", F.xxhash64("file")), files)
            of = of.select("file", "id", F.explode(F.regexp_extract_all("x", F.lit(f"(?s)(?=(.{{{k[1:]}}}))"), F.lit(1))).alias("w"))
            of = of.select("id", F.xxhash64("file", "w").alias("key"))
            out = out.unionByName(of) if made or k != kinds[0] else of
    return out


def contained(small: DataFrame, large: DataFrame) -> DataFrame:
    """small, large, at: the ids of texts (file, id, x; one of both tables with at) of one file of which the first is a part of the
    second, character by character; at is the least of its text. A part is looked up by that of its keys which fewest parts have. Of the wholes
    only keys that may be looked up are kept, and only texts that were met are read again: so large is read twice, and must be the same then."""
    keys = part_keys(small)
    rare = keys.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("key"))).groupBy("id").agg(F.min(F.struct("n", "key", "kind")).alias("k"))
    rare = settled(rare.join(small.select("id", "file"), "id").select("file", F.col("id").alias("small"), "k.key", "k.kind"))
    met = only_near(whole_keys(large, rare), rare).join(rare, "key").select("small", F.col("id").alias("large"))
    met = settled(met.distinct())

    def texts(df: DataFrame, name: str) -> DataFrame:
        ids = met.select(F.col(name).alias("id")).distinct()
        least = [F.min("at").alias("at")] if "at" in df.columns else []
        return only_near(df.select("id", *(["at"] if least else []), "x"), ids, "id").groupBy(F.col("id").alias(name)).agg(F.any_value("x").alias(f"{name}_x"), *least)

    both = met.join(texts(small, "small"), "small").join(texts(large, "large"), "large")
    return both.where(F.contains("large_x", F.col("small_x"))).select("small", "large", "at")


def maybe_parts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Of rows (file, id, x, at), each once with its least at, those that may be parts of a text: the middle and the last one of the runs of
    three tokens that a text with them would have are in texts, or they are too short to have any."""
    l, n = F.col("l"), F.size("l")  # noqa: E741
    run = lambda i: F.when(n > 4, F.xxhash64("file", *(F.get(l, i + k) for k in range(3)))).otherwise(0)
    held = rows.withColumn("l", tokens(F.col("x"))).select("id", run(F.floor(n / 2).cast("int") - 1).alias("middle"), run(n - 4).alias("last"))
    held = held.groupBy("id").agg(F.min("middle").alias("middle"), F.min("last").alias("last"))
    known = runs(texts.withColumn("l", tokens(F.col("x"))).withColumn("n", F.lit(0))).select(TRIPLE.alias("g")).where("g is not null").distinct()
    known = settled(known.unionByName(rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("g"))))  # 0: too short
    for k in ("middle", "last"):
        held = held.join(known.withColumnRenamed("g", k), k, "left_semi")
    ids = settled(held.select("id"))
    again = only_near(rows, ids, "id").groupBy("id").agg(F.any_value("file").alias("file"), F.any_value("x").alias("x"), F.min("at").alias("at"))
    return settled(again.join(ids, "id"))


def most_shared(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """id, best: for each text (file, id, x) the row (file, id, x, at), least at first, that shares most distinct tokens with it.

    A text looks its rarest tokens up. Rows that have none of them can only share the others, so a text is done once its best row
    shares more than that; the others come again with more tokens. Texts that share nothing are left out. The rows are read
    in each round, and only tokens that are looked up are kept of them."""
    none = texts.select("id", F.lit(None).cast(rows.schema["at"].dataType).alias("best")).limit(0)
    if texts.isEmpty():
        return none
    hashed = lambda x: F.array_distinct(F.transform(listed(x), lambda w: F.xxhash64("file", w)))
    own = settled(texts.select("id", hashed(F.col("x")).alias("own")))
    of_rows = rows.select("id", F.explode(hashed(F.col("x"))).alias("key"))
    words = own.select("id", F.size("own").alias("all"), F.explode("own").alias("key"))
    wanted = settled(words.select("key").distinct())
    often = only_near(of_rows, wanted).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    known = words.join(often, "key")
    ranked = known.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy("n", "key"))).drop("all")
    open_, done, taken = settled(ranked.join(known.groupBy("id").agg(F.count(F.lit(1)).alias("all")), "id")), none, RAREST
    while not open_.isEmpty():
        now = open_.where(F.col("rank") <= taken).select("key", F.col("id").alias("text"), "all")
        met = settled(only_near(of_rows, now).join(now, "key").select("text", "id", "all").distinct())
        other = only_near(rows, met.select("id").distinct(), "id").groupBy("id").agg(F.any_value(hashed(F.col("x"))).alias("other"), F.min("at").alias("at"))
        shared = met.join(own.withColumnRenamed("id", "text"), "text").join(other, "id").select("text", "all", "at", F.size(F.array_intersect("own", "other")).alias("n"))
        best = settled(shared.groupBy(F.col("text").alias("id"), "all").agg(F.max("n").alias("n"), F.min_by("at", F.struct(-F.col("n"), "at")).alias("best")))
        final = best.where((F.col("n") > F.col("all") - taken) | (F.col("all") <= taken)).select("id", "best")
        done = done.unionByName(final)
        open_ = settled(open_.join(final, "id", "left_anti"))
        taken *= 4
    return done


def best_rows(items: DataFrame, rows: DataFrame) -> DataFrame:
    """The items (file, pos, text) with sheet and row of the row (file, ord, sheet, row, text) of their file that they are from: the
    first by ord that holds the text or is held by it, in lower case; else the first that shares most words; else the file's
    first row; null where the file has no rows. Null texts are empty ones, and those are held by every row.

    Texts, and keys within a file, are known by 64 bits of hash. Equal texts of a file are matched once. The rows are read several times
    and must be the same each time: in place of their texts, keys and ids are shuffled."""
    low, file = F.lower(F.coalesce("text", F.lit(""))), F.coalesce("file", F.lit(""))
    ids = lambda df: df.withColumn("id", F.xxhash64("file", "x"))
    named = ids(items.withColumns({"file": file, "x": low}))
    lines = ids(rows.select(file.alias("file"), low.alias("x"), F.struct("ord", "sheet", "row").alias("at")))
    blank = F.when(F.col("x") == "", F.col("at"))
    first = settled(lines.select("file", "at", blank.alias("blank")).groupBy("file").agg(F.min("at").alias("first"), F.min("blank").alias("blank")))
    texts = settled(named.where("x <> ''").select("file", "id", "x").distinct().join(first.select("file"), "file", "left_semi"))
    lines = lines.where("x <> ''")
    held = contained(texts, lines).select(F.col("small").alias("id"), "at")
    holds = contained(maybe_parts(lines, texts), texts).select(F.col("large").alias("id"), "at")
    near = settled(held.unionByName(holds).groupBy("id").agg(F.min("at").alias("inside")))
    # a blank row is a part of every text
    rest = settled(texts.join(near, "id", "left_anti").join(first.where("blank is null").select("file"), "file", "left_semi"))
    shared = most_shared(rest, lines)
    all_ = named.select(*items.columns, "id", (F.col("x") == "").alias("bare")).join(near, "id", "left").join(shared, "id", "left").join(first, "file", "left")
    at = F.when(F.col("bare"), F.col("first")).otherwise(F.coalesce(F.least("inside", "blank"), F.col("best"), F.col("first")))
    return all_.withColumn("at", at).select(*items.columns, "at.sheet", "at.row")
