"""Joins, unions and aggregates over requirement tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import fixed as X
from gristmill.functions.predicates import is_normalized
from gristmill.functions.rules import bucket
from gristmill.functions.scalars import file_name, first_category
from gristmill.functions.text import either, given, strip
from gristmill.operators.settle import settled

#: Rows up to which a side may be broadcast; beyond, the join shuffles on its keys.
SMALL_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """Marks a side for broadcast, but only once it has been counted and has few rows."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def rank_of(x: Column, ranks: dict[str, int], default: int) -> Column:
    found = F.when(F.lit(False), F.lit(default))
    for name, r in ranks.items():
        found = found.when(x == name, r)
    return found.otherwise(default)


def merge_responses(items: DataFrame, responses: DataFrame) -> DataFrame:
    """Left join on (case_id, req_id). What a response leaves blank stays; exclusion always counts and marks the gap note."""
    take = ("status", "vendor_comment", "gap", "ai_draft", "final_requirement")
    r = responses.select("case_id", "req_id", *[F.col(c).alias(f"_{c}") for c in take], F.coalesce("exclude_from_matrix", F.lit(False)).alias("exclude_from_matrix"), F.coalesce("exclude_reason", F.lit("")).alias("exclude_reason"))
    has = lambda c: F.col(c) if c in items.columns else F.lit(None).cast("string")
    out = items.drop("exclude_from_matrix", "exclude_reason").join(r, ["case_id", "req_id"], "left")
    out = out.withColumns({c: F.coalesce(F.nullif(F.col(f"_{c}"), F.lit("")), has(c)) for c in take}).drop(*[f"_{c}" for c in take])
    reason, gap = strip(F.col("exclude_reason")), strip(F.col("gap"))
    tag = F.when(reason != "", F.concat(F.lit("[EXCLUDED: "), reason, F.lit("]"))).otherwise("[EXCLUDED]")
    return out.withColumn("gap", F.when(F.coalesce("exclude_from_matrix", F.lit(False)), F.when(gap != "", F.concat_ws(" ", tag, gap)).otherwise(tag)).otherwise(F.col("gap")))


def sheet(df: DataFrame) -> Column:
    """Where a row goes: excluded before glossary, note, skipped and main."""
    kind = F.lower(F.coalesce(F.col("type"), F.lit("")))
    tags = F.transform(F.coalesce("risk_tags", F.array().cast("array<string>")), F.upper)
    return (
        F.when(F.coalesce("exclude_from_matrix", F.lit(False)), "Excluded").when((kind == "glossary") | F.array_contains(tags, "GLOSSARY"), "Glossary")
        .when(kind == "note", "Notes").when((kind == "junk") | (F.upper(F.coalesce("status", F.lit(""))) == "AUTO_SKIP"), "Skipped").otherwise("Main")
    )


def review_order(category: Column | None = None, flagged: Column | None = None) -> list[Column]:
    """Reviews first, then flagged, then by level and category; pos makes the order total."""
    cat = first_category(F.col("category")) if category is None else category
    flag = F.size(F.coalesce("risk_tags", F.array().cast("array<string>"))) > 0 if flagged is None else flagged
    return [rank_of(F.coalesce("status", F.lit("")), X.STATUS_RANK, 9), F.when(flag, 0).otherwise(1), rank_of(F.coalesce("must_level", F.lit("")), X.MUST_RANK, 9), rank_of(cat, X.CATEGORY_RANK, 50), F.col("case_id"), F.col("pos")]


def ranked_rows(rows: DataFrame, order: list[Column]) -> DataFrame:
    """All rows with their rank in a total order. Rows are sorted over ranges and numbered within each; only the ranges'
    counts are added up in one place."""
    rows = settled(rows.orderBy(*order).withColumns({"_range": F.spark_partition_id(), "_in": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), "_range").withColumn("rank", F.col("_before") + F.col("_in") + 1).drop("_range", "_in", "_before")


def category_summary(items: DataFrame) -> DataFrame:
    """Counts by big and small category, then a Total row, from one grouping-sets aggregate. n orders the rows."""
    level = lambda v: F.count_if(F.upper(F.coalesce("must_level", F.lit(""))) == v)
    status = lambda v: F.count_if(F.upper(F.coalesce("status", F.lit(""))) == v)
    rows = items.withColumns({"group": bucket(first_category(F.col("category"))), "small": either(first_category(F.col("category")), "(blank)"), "_owner": given(F.col("owner"))})
    owners = F.array_sort(F.collect_set("_owner"), lambda a, b: F.when(F.lower(a) < F.lower(b), -1).when(F.lower(a) > F.lower(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    g = rows.groupingSets([["group", "small"], []], "group", "small").agg(
        F.grouping("group").alias("is_total"), F.count(F.lit(1)).alias("total"), level("MUST").alias("must"), level("SHOULD").alias("should"), level("MAY").alias("may"), level("INFO").alias("info"),
        status("NEED_REVIEW").alias("need_review"), status("COMPLIANT").alias("compliant"), status("PARTIAL").alias("partial"), status("NON-COMPLIANT").alias("non_compliant"), F.array_join(owners, ", ").alias("owners"),
    )
    total = F.col("is_total") == 1
    order = {name: i for i, (name, _) in enumerate(X.BUCKETS)}
    return g.select(
        F.when(total, "Total").otherwise(F.col("group")).alias("group"), F.when(total, "").otherwise(F.col("small")).alias("category"), "total", "must", "should", "may", "info",
        "need_review", "compliant", "partial", "non_compliant", F.when(total, "").otherwise(F.col("owners")).alias("owners"), F.when(total, len(order)).otherwise(rank_of(F.col("group"), order, len(order))).alias("rank"),
    )


def bucket_counts(items: DataFrame) -> DataFrame:
    """Rows of each of the six buckets, empty ones too."""
    six = items.sparkSession.createDataFrame([(n, i) for i, (n, _) in enumerate(X.BUCKETS)], "bucket string, rank int")
    own = items.groupBy(bucket(first_category(F.col("category"))).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(six).join(own, "bucket", "left").select("bucket", "rank", F.coalesce("n", F.lit(0)).alias("n"))


def progress_counts(items: DataFrame, responses: DataFrame, any_response: bool = False) -> DataFrame:
    """Statuses of the active rows of each case. By default a response's status counts if it is one of the three answers;
    with any_response any that is not blank does."""
    upper = F.upper if not any_response else (lambda x: x)
    active = items.where(upper(F.coalesce("status", F.lit(""))) != "AUTO_SKIP")
    r = responses.select("case_id", "req_id", F.col("status").alias("_answer"))
    rows = active.join(r, ["case_id", "req_id"], "left")
    own = upper(F.coalesce(F.nullif("status", F.lit("")), F.lit("NEW"))) if not any_response else F.coalesce("status", F.lit("NEW"))
    answer = F.when(F.col("_answer").isin(*X.RESPONSE_STATUSES), F.col("_answer")) if not any_response else F.nullif("_answer", F.lit(""))
    known = F.coalesce(answer, own)
    rows = rows.withColumn("_s", F.when(known.isin(*X.PROGRESS_STATUSES), known).otherwise("NEW"))
    return rows.groupBy("case_id").agg(*[F.count_if(F.col("_s") == s).alias(s.lower().replace("-", "_")) for s in X.PROGRESS_STATUSES], F.count(F.lit(1)).alias("total"))


def review_filter(items: DataFrame, responses: DataFrame, status: str = "All", category: str = "All", owner: str = "All") -> DataFrame:
    rows = items.where(F.coalesce("status", F.lit("")) != "AUTO_SKIP").join(responses.select("case_id", "req_id", F.col("status").alias("_answer"), F.col("exclude_from_matrix").alias("_out")), ["case_id", "req_id"], "left")
    now = F.coalesce(F.nullif("_answer", F.lit("")), F.col("status"), F.lit("NEW"))
    if status == "Excluded":
        rows = rows.where(F.coalesce("_out", F.lit(False)))
    elif status != "All":
        rows = rows.where(now == status)
    for c, v in (("category", category), ("owner", owner)):
        if v != "All":
            rows = rows.where(F.coalesce(c, F.lit("")) == v)
    return rows.select(*items.columns)


def run_stats(items: DataFrame) -> DataFrame:
    """One row for each case: totals by type, the number of duplicate ids and the least one (duplicate_ids() lists more), empty
    fields, missing (null) keys."""
    req = F.col("type") == "requirement"
    empty = lambda c: strip(F.col(c)) == ""
    stats = items.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("total_items"), F.count_if(req).alias("requirements"), F.count_if(F.col("type") == "glossary").alias("glossary"), F.count_if(F.col("type").isin("note", "junk")).alias("notes"),
        F.count_if(req & empty("requirement")).alias("empty_requirement"), F.count_if(req & empty("category")).alias("empty_category"), F.count_if(req & empty("owner")).alias("empty_owner"), F.count_if(req & F.col("must_level").isNull()).alias("missing_must_level"),
    )
    twice = items.where(F.coalesce("req_id", F.lit("")) != "").groupBy("case_id", "req_id").count().where("count > 1")
    ids = twice.groupBy("case_id").agg(F.count(F.lit(1)).alias("duplicate_ids"), F.min("req_id").alias("first_duplicate"))
    return stats.join(ids, "case_id", "left").withColumns({"duplicate_ids": F.coalesce("duplicate_ids", F.lit(0)), "first_duplicate": F.coalesce("first_duplicate", F.lit(""))})


def duplicate_ids(items: DataFrame, most: int = 10) -> DataFrame:
    """case_id, n, first_ids: how many ids a case has twice and more, and the first of them, by id."""
    twice = items.where(F.coalesce("req_id", F.lit("")) != "").groupBy("case_id", "req_id").count().where("count > 1")
    ranked = twice.withColumn("_k", F.row_number().over(Window.partitionBy("case_id").orderBy("req_id")))
    return ranked.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("_k") <= most, F.col("req_id")))).alias("first_ids"))


def first_changed(decisions: DataFrame, most: int = 5) -> DataFrame:
    """The first changed items of each case in the order of pos, with what changed."""
    rows = decisions.where("reason = 'changed'").withColumn("_k", F.row_number().over(Window.partitionBy("case_id").orderBy("pos")))
    return rows.where(F.col("_k") <= most).select("case_id", F.col("_k").alias("nth"), "req_id", "pos", "changed_fields")


def least_confidence(schema_files: DataFrame) -> DataFrame:
    """The least confidence over the files of each case's schema; one that is not given counts 0."""
    return schema_files.groupBy("case_id").agg(F.min(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))


def normalization_state(items: DataFrame) -> DataFrame:
    """What all runs so far have made of a case: rewritten and flagged rows, eligible ones, those done and left."""
    eligible = F.lower(F.coalesce("type", F.lit(""))) == "requirement"
    done = is_normalized(F.col("rewrite_reason"), F.col("normalized_requirement"))
    out = items.groupBy("case_id").agg(F.count(F.lit(1)).alias("items"), F.count_if(strip(F.col("normalized_requirement")) != "").alias("rewritten"), F.count_if(F.coalesce("needs_rewrite_review", F.lit(False))).alias("to_review"), F.count_if(eligible).alias("eligible"), F.count_if(eligible & done).alias("done"))
    return out.withColumn("left", F.col("eligible") - F.col("done"))


def rewrite_reasons(items: DataFrame) -> DataFrame:
    """Rows of each case by the reason of their rewriting, where there is one."""
    reason = strip(F.col("rewrite_reason"))
    return items.where(reason != "").groupBy("case_id", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def distribution(items: DataFrame, column: str, out: str = "n") -> DataFrame:
    key = first_category(F.col(column)) if column == "category" else F.col(column)
    return items.groupBy(either(key, "(none)").alias("key")).agg(F.count(F.lit(1)).alias(out))


def compare_distributions(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Full outer join of two runs' counts; a key that one lacks is 0 there."""
    both = distribution(left, column, "left_n").join(distribution(right, column, "right_n"), "key", "full_outer")
    return both.select("key", F.coalesce("left_n", F.lit(0)).alias("left_n"), F.coalesce("right_n", F.lit(0)).alias("right_n"))


#: What two runs are compared by, in the order of a report.
RUN_METRICS = ["total_items", "requirements", "glossary", "notes", "duplicate_ids", "empty_requirement", "empty_category", "empty_owner"]


def compare_runs(left: DataFrame, right: DataFrame) -> DataFrame:
    """The same metrics of two runs side by side."""
    names = RUN_METRICS

    def long(df: DataFrame, side: str) -> DataFrame:
        return run_stats(df).agg(*[F.sum(n).alias(n) for n in names]).unpivot([], names, "metric", "value").withColumn("side", F.lit(side))

    return long(left, "left").unionByName(long(right, "right")).groupBy("metric").pivot("side", ["left", "right"]).agg(F.sum("value"))


def compare_report(left: DataFrame, right: DataFrame) -> DataFrame:
    """section, ord, key, line: the comparison of two runs as the lines of a Markdown text, in this order: metrics, the first
    ids that a case has twice, requirements by category, level and status. A section's title and table head come at ord 0."""
    spark = left.sparkSession
    row = lambda key, a, b: F.concat(F.lit("| "), key, F.lit(" | "), a.cast("string"), F.lit(" | "), b.cast("string"), F.lit(" |"))
    entry = lambda section, order, key, line: [F.lit(section).alias("section"), order.alias("ord"), key.alias("key"), line.alias("line")]
    head = lambda title, key: f"## {title}\n\n| {key} | left | right |\n|---|---|---|"
    titles = [(1, head("Counts", "metric")), (2, "## Ids that occur twice"), (3, head("Categories", "key")), (4, head("Levels", "key")), (5, head("Status", "key"))]
    out = spark.createDataFrame([(s, 0, "", t) for s, t in titles], "section int, ord int, key string, line string")
    metric = F.array_position(F.array(*map(F.lit, RUN_METRICS)), F.col("metric")).cast("int")
    out = out.unionByName(compare_runs(left, right).select(*entry(1, metric, F.col("metric"), row(F.col("metric"), F.col("left"), F.col("right")))))
    for order, (side, items) in enumerate((("left", left), ("right", right)), 1):
        line = F.concat(F.lit(f"- {side}, "), "case_id", F.lit(": "), F.col("n").cast("string"), F.lit(" ("), F.array_join("first_ids", ", "), F.lit(")"))
        out = out.unionByName(duplicate_ids(items).select(*entry(2, F.lit(order), F.col("case_id"), line)))
    asked = [df.where("type = 'requirement'") for df in (left, right)]
    for section, column in enumerate(("category", "must_level", "status"), 3):
        out = out.unionByName(compare_distributions(*asked, column).select(*entry(section, F.lit(1), F.col("key"), row(F.col("key"), F.col("left_n"), F.col("right_n")))))
    return out


def modal_file(items: DataFrame) -> DataFrame:
    """Each case's most common file: .docx ones if there are any, ties to the first met; numbers and placeholders don't count."""
    f = strip(F.col("file"))
    named = items.where(~f.isin("<file>", "<chunk>", "") & ~F.rlike(f, F.lit(r"^\d+$"))).groupBy("case_id", f.alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    best = named.groupBy("case_id").agg(F.max_by("file", F.struct(F.endswith(F.lower("file"), F.lit(".docx")).alias("d"), F.col("n"), (-F.col("first")).alias("f"))).alias("primary_file"))
    return items.select("case_id").distinct().join(best, "case_id", "left").select("case_id", F.coalesce("primary_file", F.lit("UNKNOWN_SOURCE")).alias("primary_file"))


def review_rows(items: DataFrame) -> DataFrame:
    has = lambda c: F.col(c) if c in items.columns else F.lit(None).cast("string")
    first = lambda *xs: F.coalesce(*[F.nullif(x.cast("string"), F.lit("")) for x in xs], F.lit(""))
    return items.select(first(has("id"), has("req_id")).alias("id"), first_category(has("category")).alias("category"), first(has("requirement"), has("text")).alias("requirement"), first(has("must_level")).alias("must_level"), first(has("owner")).alias("owner"), first(has("pm_comment")).alias("pm_comment"), F.coalesce(has("deleted").cast("boolean"), F.lit(False)).alias("deleted"))


def by_priority(sources: list[DataFrame]) -> DataFrame:
    """Of several sources of a case's items the first that has the case. Each source is read for its cases and for its rows:
    one least rank by case decides for all."""
    has = [s.select("case_id", F.lit(k).alias("_rank")) for k, s in enumerate(sources)]
    rows = [s.withColumn("_rank", F.lit(k)) for k, s in enumerate(sources)]
    first, out = has[0], rows[0]
    for h, r in zip(has[1:], rows[1:], strict=True):
        first, out = first.union(h), out.unionByName(r, allowMissingColumns=True)
    first = first.groupBy("case_id").agg(F.min("_rank").alias("_rank"))
    return out.join(first, ["case_id", "_rank"]).drop("_rank")


def reviewed_as_items(reviewed: DataFrame) -> DataFrame:
    """Reviewed rows in the shape of items; deleted ones go, comments stay internal."""
    return reviewed.where(~F.coalesce("deleted", F.lit(False))).select("case_id", "pos", F.col("id").alias("req_id"), "requirement", "category", "must_level", "owner", F.array().cast("array<string>").alias("risk_tags"))


def todo_chunks(chunks: DataFrame, partial_log: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Chunks that no earlier run has done; failed ones count as done unless they are to be retried."""
    done = partial_log.where(F.col("file").isNotNull() & F.col("chunk").isNotNull())
    if retry_failed:
        done = done.where(~F.coalesce("failed_chunk", F.lit(False)))
    return chunks.join(done.select("file", "chunk").distinct(), ["file", "chunk"], "left_anti")


def without_excluded(files: DataFrame, selection: DataFrame) -> DataFrame:
    """Only a literal false excludes a file."""
    return files.join(small(selection.where("include = false").select("case_id", "name")), ["case_id", "name"], "left_anti")


def chunk_estimate(partial_log: DataFrame) -> DataFrame:
    """The greatest chunk of each file, summed by case."""
    top = partial_log.where("chunk > 0").groupBy("case_id", "file").agg(F.max("chunk").alias("top"))
    return top.groupBy("case_id").agg(F.sum("top").alias("chunks"))


def file_rules(items: DataFrame, rules: DataFrame, default_rule: str = "") -> DataFrame:
    """Adds the id rule of each row's file: its own if the schema names the file, else the schema's."""
    own = rules.groupBy("file").agg(F.first("req_id_rule").alias("_rule"))
    return items.join(small(own), "file", "left").withColumn("req_id_rule", F.coalesce("_rule", F.lit(default_rule))).drop("_rule")


def file_roles(files: DataFrame, schema_files: DataFrame, appendix: list[str], main: list[str], overall: float | None = None) -> DataFrame:
    """Role and confidence: the schema's entry for the name, else the appendix and main lists by name or 20-character start."""
    shown = lambda c: F.when(c.isNotNull(), F.concat((c * 100).cast("int").cast("string"), F.lit("%"))).otherwise("—")
    listed = lambda xs: F.exists(F.array(*map(F.lit, xs)).cast("array<string>"), lambda a: (F.col("name") == a) | ((a != "") & F.startswith(F.col("name"), F.left(a, F.lit(20)))))
    own = schema_files.groupBy(F.col("file").alias("name")).agg(F.first(F.struct("role", "confidence")).alias("_own"))
    old = F.when(listed(appendix), "appendix").when(listed(main), "main_requirement").otherwise("?")
    out = files.join(small(own), "name", "left")
    return out.withColumns({"role": F.when(F.col("_own").isNotNull(), F.coalesce("_own.role", F.lit("?"))).otherwise(old), "confidence": F.when(F.col("_own").isNotNull(), shown(F.col("_own.confidence"))).when(old != "?", shown(F.lit(overall).cast("double"))).otherwise("—")}).drop("_own")


def selection_counts(files: DataFrame, selection: DataFrame) -> DataFrame:
    known = F.element_at(F.split(F.lower("name"), r"\."), -1).isin(*X.EXTENSION_ORDER)
    rows = files.join(selection.select("case_id", "name", "include"), ["case_id", "name"], "left")
    out = F.coalesce(~F.col("include"), F.lit(False))
    return rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(~out).alias("included"), F.count_if(out).alias("excluded"), F.count_if(~known).alias("unsupported"))


def upserted(changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """The state after a log of partial updates: each column's last value that was given."""
    columns = [c for c in changes.columns if c not in (*key, order)]
    return changes.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns], F.max(order).alias(order))


def norm_stats(items: DataFrame) -> DataFrame:
    """How rewriting went: rows by reason, rows to review, low confidence."""
    req = items.where(F.lower("type") == "requirement")
    reason = either(F.col("rewrite_reason"), "not_attempted")
    return req.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("needs_rewrite_review", F.lit(False))).alias("to_review"), F.count_if((F.col("rewrite_confidence") > 0) & (F.col("rewrite_confidence") < 0.6)).alias("low_confidence"))


def stage_counts(items: DataFrame) -> DataFrame:
    """Counts by type of a formatted case, and a note where nothing came out."""
    of = lambda *ks: F.count_if(F.col("type").isin(*ks))
    g = items.groupBy("case_id").agg(of("requirement").alias("requirements"), of("glossary").alias("glossary"), of("note", "junk").alias("notes"))
    return g.withColumn("empty", (F.col("requirements") == 0) & (F.col("glossary") == 0))


def items_to_normalize(items: DataFrame, ids: list[str] | None = None, everything: bool = False, sample: int = 10) -> DataFrame:
    """Eligible rows: those named, all, or the first few of each case."""
    rows = items.where(F.lower(F.coalesce("type", F.lit(""))) == "requirement")
    if ids:
        return rows.where(F.col("req_id").isin(*ids))
    if everything:
        return rows
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy("pos"))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= max(1, sample)).drop("_rank")


def by_extension(files: DataFrame) -> DataFrame:
    """Files in reading order: by kind of file, then by name."""
    ext = F.element_at(F.split(F.lower(file_name(F.col("path"))), r"\."), -1)
    return files.withColumn("kind", rank_of(ext, {e: i for i, e in enumerate(X.EXTENSION_ORDER)}, 99)).where("kind < 99").orderBy("kind", "path")


