"""Operators in which order matters: keep-first, lag, running numbers, splitting and packing. Every table carries `pos`."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import fixed as X
from gristmill.functions.predicates import has_row_evidence, is_structured_rule, is_table_id
from gristmill.functions.scalars import chunk_number, suffix
from gristmill.functions.text import U, casefold, matches, note_added, strip


def keep_first(df: DataFrame, key: dict[str, Column], pos: str = "pos", free: Column | None = None) -> DataFrame:
    """Of the rows with equal keys the one with the least pos, which is unique. Rows for which `free` holds all stay.

    The least position comes from a partial aggregate, and joins back on key and position together, so that no key, however
    common, gathers in one task."""
    names = [f"_k{i}" for i in range(len(key))]
    keyed = df.withColumns(dict(zip(names, key.values(), strict=True)))
    held = keyed if free is None else keyed.where(~free)
    first = held.groupBy(*names).agg(F.min(pos).alias(pos))
    kept = held.join(first, [*names, pos], "left_semi").select(*df.columns)
    return kept if free is None else kept.unionByName(df.where(free))


def dedup_by_text(df: DataFrame) -> DataFrame:
    key = F.lower(strip(F.col("requirement")))
    return keep_first(df, {"text": key}, free=key == "")


def dedup_by_place(df: DataFrame) -> DataFrame:
    return keep_first(df, {"id": strip(F.col("req_id")), "file": strip(F.col("file")), "chunk": chunk_number(F.col("chunk")), "text": strip(F.col("requirement"))})


def latest(df: DataFrame, key: list[str], by: list[Column]) -> DataFrame:
    """The row of each key that is greatest by `by`, by a max of structs: partial, and no group is sorted."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_row"))
    return picked.select(*key, "_row.*")


def running_counts(df: DataFrame, flags: dict[str, Column], within: list[str], pos: str = "pos", bits: int = 12) -> DataFrame:
    """For each flag a column: how many rows up to this one have it, in the order of pos inside each group.

    Positions are cut into blocks of 2**bits, and blocks into runs of as many blocks. A block counts by itself and adds what the
    blocks of its run and the runs before hold, so a group of any size is spread over tasks; only the runs' totals are put in
    one order."""
    names = list(flags)
    df = df.withColumn("_block", F.shiftright(F.col(pos).cast("long"), bits)).withColumns({f"_flag_{n}": c.cast("long") for n, c in flags.items()})
    totals = df.groupBy(*within, "_block").agg(*[F.sum(f"_flag_{n}").alias(f"_n_{n}") for n in names]).withColumn("_run", F.shiftright("_block", bits))
    runs = totals.groupBy(*within, "_run").agg(*[F.sum(f"_n_{n}").alias(f"_r_{n}") for n in names])
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*[F.col(c).alias(f"_v{i}") for i, c in enumerate(within)], F.col("_run").alias("_q"), *[F.coalesce(F.sum(f"_r_{n}").over(earlier(*within, "_run")), F.lit(0)).alias(f"_s_{n}") for n in names])
    totals = totals.withColumns({f"_n_{n}": F.coalesce(F.sum(f"_n_{n}").over(earlier(*within, "_run", "_block")), F.lit(0)) for n in names})

    def same(right: str, *pairs: tuple[str, str]) -> Column:
        on = F.lit(True)
        for i, c in enumerate(within):
            on = on & F.col(c).eqNullSafe(F.col(f"{right}{i}"))
        for x, y in pairs:
            on = on & (F.col(x) == F.col(y))
        return on

    totals = totals.join(runs, same("_v", ("_run", "_q")))
    totals = totals.select(*[F.col(c).alias(f"_w{i}") for i, c in enumerate(within)], F.col("_block").alias("_b"), *[(F.col(f"_n_{n}") + F.col(f"_s_{n}")).alias(f"_before_{n}") for n in names])
    own = Window.partitionBy(*within, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumns({f"_own_{n}": F.sum(f"_flag_{n}").over(own) for n in names}).join(totals, same("_w", ("_block", "_b")))
    rows = rows.withColumns({n: F.col(f"_own_{n}") + F.col(f"_before_{n}") for n in names})
    return rows.drop("_block", "_b", *[f"_w{i}" for i in range(len(within))], *[f"_{k}_{n}" for n in names for k in ("flag", "own", "before")])


def running_count(df: DataFrame, flag: Column, within: list[str], out: str, pos: str = "pos", bits: int = 12) -> DataFrame:
    return running_counts(df, {out: flag}, within, pos, bits)


def glue_replaceable(df: DataFrame) -> DataFrame:
    """A row that `can be replaced by` something takes over the CRU or FRU that the row before it, in its chunk, begins with."""
    own = Window.partitionBy("case_id", "file", "chunk").orderBy("pos")
    t = strip(F.col("requirement"))
    before = F.coalesce(F.lag(t).over(own), F.lit(""))
    prefix = F.upper(F.regexp_extract(before, r"(?i)^(CRU|FRU)\s*:\s*", 1))
    glued = matches(t, r"\bcan be replaced by\b", True) & (prefix != "") & ~matches(t, r"^(CRU|FRU)\b", True)
    df = df.withColumns({"_glued": glued, "_prefix": prefix})
    return df.withColumns({"requirement": F.when(F.col("_glued"), F.concat_ws(" ", "_prefix", t)).otherwise(F.col("requirement")), "notes": F.when(F.col("_glued"), note_added(F.col("notes"), "SERVICEABILITY_GLUE")).otherwise(F.col("notes"))}).drop("_glued", "_prefix")


def id_outcome(req_id: Column, text: Column, notes: Column, rule: Column) -> Column:
    """(id, id_source): an id that its file's rule or a row marker vouches for is original; a null id is to be generated."""
    r, structured = strip(req_id), is_structured_rule(rule)
    original = lambda x: F.struct(x.alias("id"), F.lit("original").alias("id_source"))
    generated = lambda x=None: F.struct((F.lit(None).cast("string") if x is None else x).alias("id"), F.lit("generated").alias("id_source"))
    part = lambda p, k: F.regexp_extract(r, p, k)
    named, rowed, lettered, numbered = r"^([A-Za-z_]+)-(\d+)$", r"^ROW_ID=(\d+)$", r"^RFQ-([A-Za-z_]+)-\d+(?:-[a-z0-9]+)?$", r"^RFQ-\d+(?:-[a-z0-9]+)?$"
    shown = lambda x: has_row_evidence(text, notes, x)
    number = lambda x: F.format_string("%03d", F.try_to_number(x, F.lit("9" * 18)).cast("long"))
    table = (
        F.when(matches(r, named), F.when(structured | shown(part(named, 1)), original(F.concat(F.lit("RFQ-"), F.upper(part(named, 1)), F.lit("-"), number(part(named, 2))))).otherwise(generated()))
        .when(matches(r, rowed), F.when(structured | shown(F.lit("")), original(F.concat(F.lit("RFQ-TBL-"), number(part(rowed, 1))))).otherwise(generated()))
        .when(structured, original(F.concat(F.lit("RFQ-"), r))).otherwise(generated())
    )
    ready = (
        F.when(matches(r, lettered), F.when(structured | shown(part(lettered, 1)), original(r)).otherwise(generated()))
        .when(matches(r, numbered), F.when(structured, original(r)).otherwise(generated())).otherwise(original(r))
    )
    return (
        F.when((r != "") & is_table_id(r), table).when(F.startswith(r, F.lit("RFQ-")), ready).when(matches(r, r"^AI-\d+(?:-[a-z0-9]+)?$"), generated(r))
        .when((r != "") & structured & matches(r, r"^\d+$"), original(F.concat(F.lit("RFQ-"), number(r)))).otherwise(generated())
    )


def resolve_ids(df: DataFrame, rule: Column) -> DataFrame:
    """Adds id, id_source and original_id. Rows without a trusted id draw AI-001, AI-002, ... in the order of pos, by case."""
    df = df.withColumn("_id", id_outcome(F.col("req_id"), F.col("requirement"), F.col("notes"), rule))
    df = running_count(df, F.col("_id.id").isNull(), ["case_id"], "_n")
    return df.withColumns({"id": F.coalesce("_id.id", F.format_string("AI-%03d", F.col("_n"))), "id_source": F.col("_id.id_source"), "original_id": strip(F.col("req_id"))}).drop("_id", "_n")


def pipe_parts(text: Column) -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\|"), strip), lambda p: p != "")
    return F.when(F.size(parts) > 1, parts).otherwise(F.array(strip(text)))


def explode_pipes(df: DataFrame) -> DataFrame:
    """A requirement of several parts between bars becomes a row for each, with the parent's id and a letter."""
    df = df.withColumn("_parts", pipe_parts(F.col("requirement")))
    df = df.select(*df.columns, F.posexplode("_parts").alias("part", "_part")).withColumn("_split", F.size("_parts") > 1)
    dash = F.concat(F.lit("-"), suffix(F.col("part")))
    made = {"requirement": F.col("_part"), "notes": F.when(F.col("_split"), note_added(strip(F.col("notes")), "SPLIT_FROM_PIPE")).otherwise(F.col("notes"))}
    if "id" in df.columns:
        new = F.concat(F.col("id"), dash)
        made |= {"id": F.when(F.col("_split"), new).otherwise(F.col("id")), "original_id": F.when(F.col("_split"), F.when(F.col("original_id") != "", F.concat(F.col("original_id"), dash)).otherwise(new)).otherwise(F.col("original_id")), "req_id": F.when(F.col("_split"), new).otherwise(F.col("req_id"))}
    return df.withColumns(made).drop("_parts", "_part", "_split")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(strip(text), U + r"(?<=[.!?；。])\s+"), strip), lambda s: s != "")


#: What an element of a text to be packed is: a block, a sentence, or what stays alone.
BLOCK, SENTENCE, ALONE = 0, 1, 2


def _bounds(most: int, group_size: int):
    """The groups that elements of given lengths are packed in, first come first packed: (at, n) of each.

    Prefix sums of the lengths tell for each element where the group that began with it would end, all at once by binary
    search; the groups are found by going from end to end. So a text of n elements takes n log n steps, where a fold with a
    growing array, all that the built-in array functions offer, takes n squared. Only lengths go to Python and only places come back."""

    @F.arrow_udf("array<struct<at:int,n:int>>")
    def bounds(length: pa.Array, kind: pa.Array, first: pa.Array) -> pa.Array:
        flat = lambda x: x.flatten().to_numpy(zero_copy_only=False)
        size, what = flat(length).astype(np.int64), flat(kind)
        n = length.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(n)])
        here = np.arange(len(size))
        cut = flat(first).astype(bool)
        cut[1:] |= what[1:] != what[:-1]
        cuts = np.union1d(np.flatnonzero(cut), starts)
        end = lambda gap, room: np.searchsorted(c := np.concatenate([[0], np.cumsum(size + gap)]), c[:-1] + room, "right") - 1
        to = np.select([what == SENTENCE, what == BLOCK], [end(1, most + 1), np.minimum(end(2, most), here + group_size)], here + 1)
        to = np.minimum(np.maximum(to, here + 1), cuts[np.searchsorted(cuts, here, "right")] if len(here) else here).tolist()
        at, k = [], 0
        while k < len(to):
            at.append(k)
            k = to[k]
        at = np.array(at, np.int64)
        of = np.searchsorted(at, starts)
        found = pa.StructArray.from_arrays([pa.array((at - np.repeat(starts[:-1], np.diff(of))).astype(np.int32)), pa.array(np.diff(np.append(at, len(to))).astype(np.int32))], ["at", "n"])
        return pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), found)

    return bounds


def packed(elements: Column, most: int, group_size: int = 4) -> Column:
    """The pieces that elements (x, kind, first) are packed in. Sentences are joined by blanks up to `most` characters, blocks
    by line feeds up to group_size and about `most` characters; a sentence that is longer is cut. Where `first` holds, or the
    kind changes, a new piece begins. Elements should be a column of the table: they are read twice."""
    of = lambda name: F.transform(elements, lambda e: e[name])
    groups = _bounds(most, group_size)(F.transform(elements, lambda e: F.length(e["x"])), of("kind"), of("first"))

    def piece(g: Column) -> Column:
        x = F.get(g, F.lit(0))
        text = x["x"]
        cuts = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(text) - 1) / most), F.lit(0)).cast("int")), lambda i: strip(text.substr(i * most + 1, F.lit(most)))), lambda c: c != "")
        joined = lambda by: F.array_join(F.transform(g, lambda e: e["x"]), by)
        return (
            F.when(x["kind"] == BLOCK, F.array(strip(joined("\n")))).when(x["kind"] == ALONE, F.filter(F.array(text), lambda t: t != ""))
            .when(F.length(text) > most, cuts).otherwise(F.array(joined(" ")))
        )

    whole = F.transform(F.array(F.struct(elements.alias("e"), groups.alias("g"))), lambda t: F.flatten(F.transform(t["g"], lambda g: piece(F.slice(t["e"], g["at"] + 1, g["n"])))))
    return F.get(whole, F.lit(0))


def _element(x: Column, kind: int, first: Column) -> Column:
    return F.struct(x.alias("x"), F.lit(kind).alias("kind"), first.alias("first"))


def sentence_elements(text: Column, most: int) -> Column:
    """A text's sentences, or the text as one if it is short enough, for packed()."""
    t = strip(text)
    parts = F.when(t == "", F.array().cast("array<string>")).when(F.length(t) <= most, F.array(t)).otherwise(sentences(t))
    return F.transform(parts, lambda s, i: _element(s, SENTENCE, i == 0))


def paragraph_elements(text: Column, most: int = 3500) -> Column:
    """The sentences of a text's paragraphs, which blank lines part, for packed()."""
    blocks = F.filter(F.transform(F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), U + r"\n\s*\n"), strip), lambda b: b != "")
    parts = lambda b: F.when(F.length(b) <= most, F.array(b)).otherwise(sentences(b))
    return F.flatten(F.transform(F.transform(blocks, parts), lambda p: F.transform(p, lambda s, i: _element(s, SENTENCE, i == 0))))


def block_elements(blocks: Column, most: int = 1200) -> Column:
    """Blocks for packed(): a longer one as its sentences, but one that carries a row id stays whole."""
    one = lambda b: F.when(F.length(b) <= most, F.array(_element(b, BLOCK, F.lit(False)))).when(F.contains(b, F.lit("[ROW_ID=")), F.array(_element(b, ALONE, F.lit(True)))).otherwise(long(b))
    long = lambda b: F.when(strip(b) == "", F.array(_element(F.lit(""), ALONE, F.lit(True)))).otherwise(sentence_elements(b, most))
    return F.flatten(F.transform(blocks, one))


def packed_sentences(text: Column, most: int) -> Column:
    """Pieces of at most `most` characters, filled sentence by sentence; a longer sentence is cut."""
    return packed(sentence_elements(text, most), most)


def paragraph_chunks(text: Column, most: int = 3500) -> Column:
    return packed(paragraph_elements(text, most), most)


def packed_blocks(blocks: Column, most: int = 1200, group_size: int = 4) -> Column:
    """Blocks joined to chunks of at most group_size blocks and about `most` characters. A longer block is split by its
    sentences, but one that carries a row id stays whole."""
    return packed(block_elements(blocks, most), most, group_size)


def sheet_rows(chunk: Column) -> Column:
    """(file, sheet, row, text) of each marker in a chunk; without a file in any of them those that only name a sheet."""

    def of(pattern: str, file: Column | None) -> Column:
        heads = lambda k: F.regexp_extract_all(chunk, F.lit(U + pattern), k)
        parts = F.split(chunk, U + pattern)
        texts = F.slice(parts, F.lit(2), F.size(parts))
        names = heads(1) if file is None else F.transform(heads(1), lambda _: file)
        k = 2 if file is None else 1
        return F.transform(F.arrays_zip(names.alias("f"), heads(k).alias("s"), heads(k + 1).alias("r"), texts.alias("t")), lambda x: F.struct(x["f"].alias("file"), x["s"].alias("sheet"), x["r"].cast("int").alias("row"), strip(x["t"]).alias("text")))

    full, plain = r"\[FILE:(.+?)\s+SHEET:(.+?)\s+ROW\s+(\d+)\]", r"\[SHEET:(.+?)\s+ROW\s+(\d+)\]"
    return F.when(matches(chunk, full), of(full, None)).otherwise(of(plain, F.lit("")))


def best_row(text: Column, rows: Column) -> Column:
    """The row that holds the text or is held by it, the first such; else the one that shares most words; else the first."""
    t = F.lower(text)
    tokens = lambda x: F.array_distinct(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != ""))
    mine = tokens(t)
    inside = F.filter(rows, lambda r: F.contains(F.lower(r["text"]), t) | F.contains(t, F.lower(r["text"])))
    shared = F.transform(rows, lambda r: F.size(F.array_intersect(mine, tokens(F.lower(r["text"])))))
    most = F.get(rows, (F.array_position(shared, F.array_max(shared)) - 1).cast("int"))
    return F.when(F.size(inside) > 0, F.get(inside, F.lit(0))).when(F.size(rows) > 0, most)


def failure_gate(attempts: DataFrame, most: int = 20, least_attempts: int = 10, most_percent: float = 10.0) -> DataFrame:
    """Adds failed_so_far, attempted_so_far and abort to (case_id, pos, failed): whether a run stops at this attempt."""
    df = running_counts(attempts, {"failed_so_far": F.col("failed"), "attempted_so_far": F.lit(True)}, ["case_id"])
    percent = 100.0 * F.col("failed_so_far") / F.greatest("attempted_so_far", F.lit(1))
    return df.withColumn("abort", F.col("failed") & ((F.col("failed_so_far") > most) | ((F.col("attempted_so_far") >= least_attempts) & (percent > most_percent))))


def mock_extract(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """(pos, file, line_no, line) to requirements without any model: candidate lines, the first of equal ones, MOCK-001 ..."""
    from gristmill.functions.predicates import is_candidate
    from gristmill.functions.scalars import cleaned_line

    found = lines.where(is_candidate(F.col("line"))).withColumn("requirement", cleaned_line(F.col("line"))).where("requirement <> ''")
    found = keep_first(found, {"text": casefold(F.col("requirement"))})
    if limit is not None:
        found = found.orderBy("pos").limit(limit)
    found = running_count(found.withColumn("_all", F.lit(0)), F.lit(True), ["_all"], "n").drop("_all")
    return found.select(F.format_string("MOCK-%03d", F.col("n")).alias("req_id"), "requirement", "file", "line_no", F.lit("General").alias("category"), F.lit("NEED_REVIEW").alias("must_level"), F.lit("NEED_REVIEW").alias("status"), F.lit(X.MOCK_NOTE).alias("notes"), F.lit(0.0).alias("confidence"))
