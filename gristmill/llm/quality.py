"""Quality rules as a short-circuit cascade, ordered by rejection per cost on a sample. Native expressions only."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Documents that the sample aims at; it only sets the rules' order, never a verdict. A rule is run so often over each of them
#: that this takes ABOVE times as long as a job without a rule, or MOST times.
SAMPLE_ROWS, ABOVE, MOST = 2_000, 4, 1 << 14
#: Bits of a packed window that hold its position; longer texts are not packed.
POSITION_BITS = 24


@dataclass(frozen=True)
class Rule:
    """`rejects` reads the statistics columns or the text."""

    name: str
    rejects: Column


def window_hashes(w: Column) -> Column:
    """64-bit hashes of the 3-word windows of a word array, in order."""
    hashed = lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))
    return F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - 2), hashed))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; a null text is an empty one.

    n_repeat_words counts the words in 3-word windows found twice or more, the first occurrence included. Only a text with
    equal window hashes goes on: there the upper bits of the hash and the position share one long, one sort of longs brings
    equal windows together, and the positions so found cover position to position + 2. Where other windows have the same
    upper bits, or positions don't fit, hashes and positions are sorted as pairs."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    base = base.withColumn("words", common.words(F.col("text")))
    base = base.withColumn("grams", window_hashes(F.col("words")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(common.BLANKS)) != "")
    low = (1 << POSITION_BITS) - 1
    base = base.select(
        "doc_id", "text", "grams",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.when(F.instr("text", "\n") == 0, F.lit(0)).otherwise(F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    )
    packed = F.sort_array(F.transform("grams", lambda h, i: h.bitwiseAND(F.lit(-low - 1)).bitwiseOR(i.cast("long"))))
    again = F.size(F.array_distinct("grams")) < F.size("grams")
    fits = F.size("grams") <= low
    base = base.withColumns({"again": again, "packed": F.when(again & fits, packed)})
    at = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    gram = lambda x: F.get(F.col("grams"), at(x))
    upper = lambda x: x.bitwiseAND(F.lit(-low - 1))
    near = lambda i: F.get(F.col("packed"), i)
    mixed = F.size(F.filter("packed", lambda x, i: (upper(x) == upper(near(i - 1))) & (gram(x) != gram(near(i - 1))))) > 0
    base = base.withColumn("pairs", F.when(F.col("again") & (~fits | mixed), F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    other = lambda i: F.get(F.col("pairs"), i)["h"]
    by_pair = F.transform(F.filter("pairs", lambda x, i: (x["h"] == other(i - 1)) | (x["h"] == other(i + 1))), lambda x: x["i"])
    by_long = F.transform(F.filter("packed", lambda x, i: (gram(x) == gram(near(i - 1))) | (gram(x) == gram(near(i + 1)))), at)
    hits = F.when(F.col("pairs").isNotNull(), by_pair).when(F.col("again"), by_long)
    base = base.withColumn("hits", F.sort_array(hits))
    gaps = F.transform("hits", lambda p, i: F.least(F.coalesce(F.get(F.col("hits"), i + 1) - p, F.lit(3)), F.lit(3)))
    repeated = F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, b: a + b), F.lit(0))
    return base.select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeated.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> list[Rule]:
    """The declared rules. Thresholds are those of well-known web-text heuristics, loose enough to leave plain prose alone."""
    words = F.col("n_words").cast("double")
    return [
        Rule("symbols", F.col("n_symbols") > 0.1 * words),
        Rule("word_length", (F.col("word_chars") > 12 * words) | (F.col("word_chars") < 2 * words)),
        Rule("same_lines", F.col("n_dup_lines") > 0.3 * F.size(F.split("text", "\n", -1))),
        Rule("shouting", F.regexp_count("text", F.lit("!")) > 0.3 * words),
        Rule("letters", F.regexp_count("text", F.lit(r"\p{L}")) < 0.6 * F.col("word_chars")),
        Rule("capitals", F.regexp_count("text", F.lit(r"\p{Lu}")) > 0.5 * F.col("word_chars")),
        Rule("few_words", F.size(F.array_distinct(common.words(F.col("text")))) < 0.05 * words),
    ]


def measured(sample: DataFrame, declared: list[Rule]) -> list[tuple[float, float]]:
    """(share of rejections, seconds for the sample once) of each rule on a sample with its statistics. One job evaluates the
    rule many times on each row of the settled sample, so that the job's own time, which is taken off, is a small part. How
    often follows from a first try, as rules differ in cost by some thousand times."""
    held = common.settled(sample)
    again = F.explode(F.sequence(F.lit(1), F.col("_times")))

    def run(what: Column, times: int) -> tuple[float, float]:
        rows = held.withColumn("_times", F.lit(times) + F.col("n_words").cast("int") * 0).withColumn("_again", again)
        began = time.perf_counter()
        found = rows.agg(what.alias("x")).first()["x"]
        return float(found or 0.0), time.perf_counter() - began

    idle = min(run(F.count(F.lit(1)), 1)[1] for _ in range(3))
    out = []
    for r in declared:
        share = F.avg(F.coalesce(r.rejects, F.lit(False)).cast("int"))
        times = 1
        found, took = run(share, times)
        while took < ABOVE * idle and times < MOST:
            once = max(took - idle, idle / 10) / times
            times = min(MOST, max(4 * times, int(1.2 * ABOVE * idle / once)))
            found, took = run(share, times)
        out.append((found, max(took - idle, 1e-6) / times))
    return out


def order_rules(sample: DataFrame, declared: list[Rule]) -> list[Rule]:
    """Most rejections per second first; of rules that reject nothing the cheapest first."""
    rank = [(-share / cost, cost, i) for i, (share, cost) in enumerate(measured(sample, declared))]
    return [declared[i] for *_, i in sorted(rank)]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: list[Rule] | None = None) -> DataFrame:
    """One row per document: its statistics, base_failed, and kept. The verdict is one nested CASE, so a rule is only evaluated
    where all before it let the document pass. The order changes the work, not the verdict. The contract's base columns are
    made for every row; a caller that selects kept alone has those made that its rules read. Null or blank texts have no words
    and fail; rows repeat as they come; an empty table gives no rows; other columns of docs play no part."""
    declared = rules() if declared is None else declared
    n = docs.count()
    part = min(1.0, SAMPLE_ROWS / max(n, 1))
    drawn = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 20)) < int(part * (1 << 20))) if part < 1 else docs
    ordered = order_rules(statistics(drawn, id_col, text_col), declared) if n else declared
    verdict = F.when(base_failed(), F.lit(False))
    for r in ordered:
        verdict = verdict.when(F.coalesce(r.rejects, F.lit(False)), F.lit(False))
    out = statistics(docs, id_col, text_col).withColumn("base_failed", base_failed())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict.otherwise(F.lit(True)).alias("kept"))
