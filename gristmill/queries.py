"""One query for each operator group, over the driver's tables."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import model as M
from gristmill.functions import predicates as P
from gristmill.functions import rules as R
from gristmill.functions import scalars as S
from gristmill.functions.text import strip, word_count
from gristmill.items import clean_items, raw_items, responses
from gristmill.operators import ordered as O
from gristmill.operators import tables as T
from gristmill.operators.settle import scratch, settled
from gristmill.plans import analyses as A
from gristmill.plans import stages as G

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
BOOK = R.RuleBook()


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    return d.withColumn("pos", F.struct("doc_id", "line"))


# --- export: entry point of a finished case


@query
def summary_matrix(spark, sf_dir):
    merged = T.merge_responses(clean_items(spark, sf_dir), responses(spark, sf_dir))
    main = merged.withColumn("_to", T.sheet(merged)).where("_to = 'Main'")
    return T.category_summary(main).drop("rank")


@query
def response_merge(spark, sf_dir):
    out = T.merge_responses(clean_items(spark, sf_dir), responses(spark, sf_dir))
    return out.select("case_id", "pos", "req_id", "status", "vendor_comment", "gap", "final_requirement", F.coalesce("exclude_from_matrix", F.lit(False)).alias("excluded"))


@query
def progress_counts(spark, sf_dir):
    return T.progress_counts(clean_items(spark, sf_dir), responses(spark, sf_dir))


@query
def review_counts(spark, sf_dir):
    return T.progress_counts(clean_items(spark, sf_dir), responses(spark, sf_dir), any_response=True)


@query
def sheet_routing(spark, sf_dir):
    merged = T.merge_responses(clean_items(spark, sf_dir), responses(spark, sf_dir))
    return merged.select("case_id", "pos", T.sheet(merged).alias("sheet"))


@query
def bucket_counts(spark, sf_dir):
    return T.bucket_counts(clean_items(spark, sf_dir))


@query
def pm_sort_topk(spark, sf_dir):
    """The first 200 of the review order: a top-k report."""
    return clean_items(spark, sf_dir).orderBy(*T.review_order()).limit(200).select("case_id", "pos", "status", "must_level", "category")


@query
def pm_sort_full_category(spark, sf_dir):
    """The same with the whole category text as key, as the review workbook sorts."""
    return clean_items(spark, sf_dir).orderBy(*T.review_order(F.col("category"))).limit(200).select("case_id", "pos", "category")


@query
def pm_sort(spark, sf_dir):
    """All rows in the review order, with their rank."""
    return T.ranked_rows(clean_items(spark, sf_dir), T.review_order()).select("rank", "case_id", "pos", "status", "must_level", "category")


@query
def pm_sort_category(spark, sf_dir):
    """All rows as the review workbook sorts them, with their rank."""
    return T.ranked_rows(clean_items(spark, sf_dir), T.review_order(F.col("category"))).select("rank", "case_id", "pos", "category")


@query
def matrix_projection(spark, sf_dir):
    merged = T.merge_responses(clean_items(spark, sf_dir), responses(spark, sf_dir))
    out = G.matrix(merged)
    return out.select("case_id", "pos", F.col("PM Reviewed Requirement").alias("final_requirement"), F.col("Risk Tags").alias("risk"), F.col("AI Confidence").alias("confidence"), F.col("PM AI Review Status").alias("review"), F.col("Gap / Notes").alias("gap"))


@query
def export_sheets(spark, sf_dir):
    return G.export(clean_items(spark, sf_dir), responses(spark, sf_dir)).groupBy("case_id", "sheet").agg(F.count(F.lit(1)).alias("n"))


@query
def field_guide(spark, sf_dir):
    return G.field_guide(spark)


@query
def review_filter(spark, sf_dir):
    return T.review_filter(clean_items(spark, sf_dir), responses(spark, sf_dir), status="PARTIAL", owner="QA").select("case_id", "pos", "req_id")


@query
def review_rows(spark, sf_dir):
    return T.review_rows(clean_items(spark, sf_dir)).drop("deleted", "pm_comment")


@query
def source_priority(spark, sf_dir):
    items = clean_items(spark, sf_dir).select("case_id", "pos", "req_id")
    a = items.where("case_id = 'case0' and pos % 4 = 0").withColumn("src", F.lit("reviewed"))
    b = items.where("case_id in ('case0', 'case1')").withColumn("src", F.lit("clean"))
    return T.by_priority([a, b, items.withColumn("src", F.lit("raw"))])


@query
def reviewed_load(spark, sf_dir):
    df = clean_items(spark, sf_dir).select("case_id", "pos", F.col("req_id").alias("id"), "requirement", "category", "must_level", "owner", (F.col("pos") % 6 == 0).alias("deleted"))
    return T.reviewed_as_items(df).drop("risk_tags")


@query
def run_stats(spark, sf_dir):
    return T.run_stats(clean_items(spark, sf_dir))


@query
def duplicate_ids(spark, sf_dir):
    out = T.duplicate_ids(clean_items(spark, sf_dir))
    return out.select("case_id", "n", F.array_join("first_ids", ",").alias("first_ids"))


@query
def normalization_state(spark, sf_dir):
    return T.normalization_state(clean_items(spark, sf_dir))


@query
def rewrite_reasons(spark, sf_dir):
    return T.rewrite_reasons(clean_items(spark, sf_dir))


@query
def least_confidence(spark, sf_dir):
    files = _files(spark, sf_dir).select("case_id", F.when(F.col("ord") % 50 > 0, 0.5 + F.col("ord") / 1000).alias("confidence"))
    return T.least_confidence(files)


@query
def dist_compare(spark, sf_dir):
    req = clean_items(spark, sf_dir).where("type = 'requirement'")
    return T.compare_distributions(req.where("pos % 2 = 0"), req.where("pos % 3 = 0 and category <> 'Thermal'"), "category")


@query
def compare_runs(spark, sf_dir):
    df = clean_items(spark, sf_dir)
    return T.compare_runs(df.where("pos % 2 = 0"), df.where("pos % 2 = 1"))


@query
def compare_report(spark, sf_dir):
    """The same two runs as the lines of a report."""
    df = clean_items(spark, sf_dir)
    return T.compare_report(df.where("pos % 2 = 0"), df.where("pos % 2 = 1"))


@query
def distinct_domains(spark, sf_dir):
    df = clean_items(spark, sf_dir)
    return df.select(F.lit("category").alias("domain"), F.col("category").alias("value")).union(df.select(F.lit("owner"), "owner")).distinct()


@query
def norm_stats(spark, sf_dir):
    return T.norm_stats(clean_items(spark, sf_dir))


@query
def stage_counts(spark, sf_dir):
    return T.stage_counts(clean_items(spark, sf_dir))


@query
def normalize_selection(spark, sf_dir):
    """The first 50 eligible rows of all cases together: a sample."""
    return T.items_to_normalize(clean_items(spark, sf_dir), sample=50).orderBy("case_id", "pos").limit(50).select("case_id", "pos", P.is_normalized(F.col("rewrite_reason"), F.col("normalized_requirement")).alias("skipped"))


@query
def normalize_selection_by_case(spark, sf_dir):
    """The first 50 eligible rows of each case."""
    return T.items_to_normalize(clean_items(spark, sf_dir), sample=50).select("case_id", "pos", P.is_normalized(F.col("rewrite_reason"), F.col("normalized_requirement")).alias("skipped"))


# --- rules


@query
def must_level(spark, sf_dir):
    level = R.must_level(F.col("requirement"), BOOK)
    return raw_items(spark, sf_dir).select("pos", level.alias("detected"), R.must_of_table_row(level, F.col("req_id"), F.col("row_name"), F.col("table_name")).alias("must_level"))


@query
def category_first_match(spark, sf_dir):
    return raw_items(spark, sf_dir).select("pos", R.category(F.col("req_id"), F.col("requirement"), F.col("notes"), BOOK).alias("category"))


@query
def owner_lookup(spark, sf_dir):
    df = raw_items(spark, sf_dir).withColumn("c", F.array(R.category(F.col("req_id"), F.col("requirement"), F.col("notes"), BOOK)))
    return df.select("pos", R.owner_of_category(F.col("c"), BOOK).alias("by_category"), R.owner(F.col("c"), F.col("requirement"), BOOK).alias("owner"))


@query
def redflag_all_match(spark, sf_dir):
    f = R.redflags(F.col("requirement"), F.col("notes"), BOOK)
    return raw_items(spark, sf_dir).select("pos", f.alias("f")).select("pos", F.array_join("f.messages", "~").alias("messages"), "f.status", "f.force_category", "f.require_evidence", "f.forbid_llm_numbers")


@query
def spec_category(spark, sf_dir):
    return raw_items(spark, sf_dir).select("pos", R.spec_category(F.col("requirement")).alias("spec_category"))


@query
def category_correction(spark, sf_dir):
    return raw_items(spark, sf_dir).select("pos", R.corrected_category(F.when(F.col("pos") % 3 == 0, "BIOS").when(F.col("pos") % 3 == 1, "General"), F.col("requirement")).alias("category"))


@query
def risk_tags(spark, sf_dir):
    f = R.redflags(F.col("requirement"), F.col("notes"), BOOK)
    raw = F.concat(f["messages"], F.array(F.col("requirement")), F.when(F.col("pos") % 2 == 0, F.array(F.lit("RF_IP"), F.lit("own tag"))).otherwise(F.array().cast("array<string>")))
    df = raw_items(spark, sf_dir).select("pos", R.risk_tags(raw).alias("tags"))
    return df.select("pos", F.array_join("tags", "~").alias("tags"), R.risk_note(F.col("tags")).alias("note"))


@query
def big_category(spark, sf_dir):
    return clean_items(spark, sf_dir).select("pos", R.bucket(S.first_category(F.col("category"))).alias("bucket"))


@query
def priority_map(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), R.priority(F.split("o_orderpriority", "-")[1]).alias("must_level"))


@query
def enriched_items(spark, sf_dir):
    df = G.enrich(raw_items(spark, sf_dir))
    return df.select("pos", "must_level", F.array_join("category", ",").alias("category"), "owner", "status", F.size("redflag_messages").alias("n_messages"), F.col("redflag_overrides.auto_skip").alias("auto_skip"))


@query
def plain_triage(spark, sf_dir):
    df = G.plain_rows(raw_items(spark, sf_dir).select("pos", "requirement", "notes"))
    return df.select("pos", "type", "must_level", "category", "owner", F.array_join("risk_tags", ",").alias("risk_tags"), "evidence_needed", "next_action", "status")


@query
def enriched_rows(spark, sf_dir):
    """Rows that an earlier stage has judged, by any of its fields."""
    df = raw_items(spark, sf_dir).withColumns({"owner": F.when(F.col("pos") % 7 == 0, "QA"), "redflag_messages": F.when(F.col("pos") % 11 == 0, F.array().cast("array<string>"))})
    return df.select("pos", P.is_enriched(df.columns).alias("enriched"))


@query
def model_overrides(spark, sf_dir):
    """Enriched items after a model's answers, of which some are empty or say little."""
    df = G.enrich(raw_items(spark, sf_dir))
    k = F.col("pos") % 4
    said = F.when(k == 0, '{"must_level": "SHOULD", "owner": "", "redflag": ["RF_IP"], "redflag_message": "keys", "stakeholder": ["PM", "QA"]}').when(k == 1, '{"category": "BIOS", "redflag": [], "stakeholder": "PM"}').when(k == 2, "{}")
    out = M.enriched(df, df.select("case_id", "pos", said.alias("json")).where("json is not null"))
    return out.where(k < 2).select("pos", "llm_enriched", F.when(k == 0, F.col("must_level")).alias("must_level"), F.when(k == 1, F.array_join("category", ",")).alias("category"), F.array_join("redflag_messages", "~").alias("messages"), F.array_join("stakeholder", ",").alias("stakeholder"), F.col("redflag_overrides.require_evidence").alias("require_evidence")).unionByName(
        out.where(k >= 2).select("pos", "llm_enriched", F.lit(None).cast("string").alias("must_level"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("messages"), F.array_join("stakeholder", ",").alias("stakeholder"), F.lit(None).cast("boolean").alias("require_evidence"))
    )


# --- predicates and scalars


@query
def item_predicates(spark, sf_dir):
    t, n = F.col("requirement"), F.col("notes")
    kind = P.item_type(t, n)
    return raw_items(spark, sf_dir).select("pos", P.is_definition(t, n).alias("definition"), kind.alias("type"), P.is_noise(t, n).alias("noise"), P.is_short_junk(t).alias("short"), P.is_part_number(t).alias("part_number"), P.is_table_id(F.col("req_id")).alias("table_id"), P.is_candidate(t).alias("candidate"), P.is_orphan(t, F.lit("requirement"), F.col("derived")).alias("orphan"))


@query
def junk_attribution(spark, sf_dir):
    why = P.drop_reason(F.col("requirement"), F.col("notes"), F.lit(""), F.col("derived"))
    return raw_items(spark, sf_dir).groupBy(F.coalesce(why, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query
def line_noise(spark, sf_dir):
    """Noise and word counts of every line of every document."""
    df = lines(spark, sf_dir)
    return df.groupBy(P.is_noise(F.col("text"), F.lit("")).alias("noise"), P.is_short_junk(F.col("text")).alias("short"), P.is_part_number(F.col("text")).alias("part_number")).agg(F.count(F.lit(1)).alias("n"), F.sum(word_count(F.col("text"))).alias("words"))


@query
def promoted_types(spark, sf_dir):
    t, n = F.col("requirement"), F.col("notes")
    status = F.when(F.col("pos") % 5 == 0, "NEED_REVIEW").when(F.col("pos") % 5 == 1, "AUTO_SKIP").otherwise("")
    return raw_items(spark, sf_dir).select("pos", P.promoted_type(P.item_type(t, n), t, n, F.col("must_level"), status, F.col("pos") % 7 == 0, F.col("derived")).alias("type"))


@query
def row_id_detect(spark, sf_dir):
    text = F.concat(F.lit("see "), F.element_at(F.array(*map(F.lit, ["HOST 36", "bios4", "REQ-123", "SR-4.3.21", "R 1.2.3", "SEC_07", "Item 12", "none"])), (F.col("o_orderkey") % 8 + 1).cast("int")), F.lit(" of "), F.col("o_orderpriority"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), S.row_id(text).alias("row_id"))


@query
def source_ref(spark, sf_dir):
    c = F.col
    df = G.normal_source(raw_items(spark, sf_dir))
    return df.select("pos", "file", S.source_ref(S.display_name(c("file")), c("sheet"), c("row"), c("table"), c("table_row"), c("page"), c("chunk")).alias("source"))


@query
def text_clean(spark, sf_dir):
    raw = F.concat(F.lit(" Falls under RF_CERT  per redflag: "), F.col("requirement"), F.lit("  ., "))
    return raw_items(spark, sf_dir).select("pos", S.cleaned(raw).alias("cleaned"), S.excerpt(F.col("requirement"), 30).alias("excerpt"), S.safe_key(F.concat(F.lit("a/b:  "), F.col("requirement"))).alias("safe_key"), S.first_category(F.concat("requirement", F.lit(" , x"))).alias("first"), S.ascii_preview(F.concat(F.lit("é中"), F.col("requirement")), 20).alias("preview"))


@query
def token_audit(spark, sf_dir):
    new = S.new_tokens(F.col("requirement"), F.concat(F.lit("2.5 kg 60 Hz TPM 2.0 "), F.col("req_id")), F.col("notes"))
    return raw_items(spark, sf_dir).select("pos", F.array_join(new, "~").alias("new_tokens"))


@query
def duration_format(spark, sf_dir):
    s = (F.col("o_custkey") % 20000).cast("double") / 2
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), S.duration(s).alias("long"), S.duration(s, hours=False).alias("short"), P.risk_of(s).alias("risk"), (s * R.seconds_per_call(F.when(F.col("o_orderkey") % 3 == 0, " OpenAI ").when(F.col("o_orderkey") % 3 == 1, "internal"))).alias("cost"))


@query
def confidence_guard(spark, sf_dir):
    c = F.col("o_custkey").cast("double") / 300 - 1
    fresh = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), S.guarded_confidence(c, fresh).alias("confidence"))


@query
def content_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", S.text_hash(F.col("text")).alias("sha256"), S.cache_signature(S.text_hash(F.col("text")), F.col("lang"), F.lit("1.0.0"), F.lit("1.0.0"), F.col("source")).alias("signature"))


# --- order


@query
def dedup_text(spark, sf_dir):
    return O.dedup_by_text(raw_items(spark, sf_dir).select("pos", "requirement")).select("pos")


@query
def dedup_lines(spark, sf_dir):
    """The first of equal lines over all documents."""
    return O.keep_first(lines(spark, sf_dir), {"text": F.lower(strip(F.col("text")))}, free=strip(F.col("text")) == "").select("doc_id", "line")


@query
def dedup_place(spark, sf_dir):
    df = raw_items(spark, sf_dir).withColumn("req_id", F.when(F.col("pos") % 2 == 0, "").otherwise("X"))
    return O.dedup_by_place(df).select("pos")


@query
def mock_extract(spark, sf_dir):
    df = raw_items(spark, sf_dir).select("pos", "file", F.col("pos").alias("line_no"), F.concat(F.lit("  - "), F.col("requirement")).alias("line"))
    return O.mock_extract(df).select("req_id", "requirement", "line_no")


@query
def glue_lag(spark, sf_dir):
    df = raw_items(spark, sf_dir).withColumn("chunk", (F.col("pos") / 64).cast("int").cast("string")).withColumn("file", F.lit("one.docx"))
    return O.glue_replaceable(df).select("pos", "requirement", "notes")


def _rules(spark):
    return spark.createDataFrame([("AUTO-spec_1.xlsx", "HOST N -> RFQ-HOST-N"), ("AUTO-spec_2.docx", "AI auto"), ("AUTO-spec_4.docx", "N -> RFQ-N")], "file string, req_id_rule string")


@query
def ai_ids(spark, sf_dir):
    df = T.file_rules(raw_items(spark, sf_dir), _rules(spark))
    return O.resolve_ids(df, F.col("req_id_rule")).select("case_id", "pos", "id", "id_source", "original_id")


@query
def pipe_explode(spark, sf_dir):
    return O.explode_pipes(raw_items(spark, sf_dir).select("pos", "requirement", "notes")).select("pos", "part", "requirement", "notes", S.suffix(F.col("part")).alias("suffix"))


@query
def failure_gate(spark, sf_dir):
    df = read(spark, sf_dir, "orders").select(F.concat(F.lit("case"), (F.col("o_custkey") % 40).cast("string")).alias("case_id"), F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % 11 == 0).alias("failed"))
    return O.failure_gate(df)


@query
def latest_status(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("job"), "event_id", "event_type", F.col("ts").alias("updated_at"))
    return O.latest(e, ["job"], [F.col("updated_at"), F.col("event_id")]).select("job", "event_id", "event_type")


@query
def paragraph_chunks(spark, sf_dir):
    """Every document in chunks of at most 600 characters."""
    d = read(spark, sf_dir, "documents").select("doc_id", O.paragraph_elements(F.replace("text", F.lit("\n"), F.lit("\n\n")), 600).alias("e")).select("doc_id", O.packed(F.col("e"), 600).alias("c"))
    return d.select("doc_id", F.posexplode("c").alias("chunk", "text"))


@query
def greedy_pack(spark, sf_dir):
    """Lines of every document packed to chunks."""
    d = read(spark, sf_dir, "documents").select("doc_id", O.block_elements(F.filter(F.split("text", "\n"), lambda x: x != ""), 1200).alias("e")).select("doc_id", O.packed(F.col("e"), 1200, 4).alias("c"))
    return d.select("doc_id", F.posexplode("c").alias("chunk", "text"))


@query
def best_row_match(spark, sf_dir):
    chunk = F.concat(F.lit("[FILE:a b.xlsx SHEET:One ROW 3] Alpha power supply unit [FILE:a b.xlsx SHEET:Two ROW 9] vibration and shock test [FILE:a b.xlsx SHEET:Two ROW 10] "), F.col("notes"), F.lit("NVMe storage with RAID"))
    df = raw_items(spark, sf_dir).withColumn("rows", O.sheet_rows(chunk))
    return df.select("pos", O.best_row(F.col("requirement"), F.col("rows")).alias("r")).select("pos", "r.file", "r.sheet", "r.row")


@query
def best_row_join(spark, sf_dir):
    """Of the lines of a source the one that a document's first line, cut or with words added, is from."""
    from gristmill.operators.matching import best_rows

    d = read(spark, sf_dir, "documents").select(F.col("source").alias("file"), "doc_id", F.split("text", "\n", -1).alias("l"))
    rows = d.select("file", "doc_id", F.posexplode("l").alias("line", "text")).select("file", F.struct("doc_id", "line").alias("ord"), F.col("doc_id").alias("sheet"), F.col("line").alias("row"), "text")
    head = F.get("l", F.lit(0))
    text = F.when(F.length(head) % 3 == 0, head).when(F.length(head) % 3 == 1, head.substr(5, 40)).otherwise(F.concat(F.lit("Added "), head, F.lit(" added words")))
    return best_rows(d.select("file", F.col("doc_id").alias("pos"), text.alias("text")), rows).select("pos", "sheet", "row")


@query
def chunk_positions(spark, sf_dir):
    chunk = F.concat(F.lit("[TABLE 2 ROW 4][ROW_ID=HOST 36] text [TABLE 3 ROW 7] more [ROW_ID=BIOS-"), (F.col("pos") % 50).cast("string"), F.lit("] end [PDF PAGE 12] [FILE:x.xlsx SHEET:S ROW 5]"))
    df = raw_items(spark, sf_dir).select("pos", S.table_position(F.col("req_id"), chunk).alias("t"), S.matrix_id(F.col("req_id"), chunk).alias("matrix_id"), S.page_position(chunk).alias("page"), S.sheet_position(chunk).alias("s"), S.repaired_id(F.col("req_id"), F.lit("f.docx"), F.lit(3), F.col("pos") % 1200).alias("repaired"))
    return df.select("pos", "t.table", "t.table_row", "matrix_id", "page", F.col("s.sheet").alias("sheet"), F.col("s.row").alias("row"), "repaired")


# --- whole stages


@query
def formatted_items(spark, sf_dir):
    out = G.format_items(G.enrich(raw_items(spark, sf_dir)), _rules(spark))
    return out.select("case_id", "pos", "part", "req_id", "original_id", "id_source", "type", "must_level", "category", "owner", "status", "requirement", F.array_join("risk_tags", ",").alias("risk_tags"), "risk_note", "evidence_needed", "next_action", "source")


@query
def modal_file(spark, sf_dir):
    return T.modal_file(raw_items(spark, sf_dir))


@query
def case_to_matrix(spark, sf_dir):
    """All stages in one plan: enrich, format, merge, route, summarise."""
    items = G.format_items(G.enrich(raw_items(spark, sf_dir)), _rules(spark))
    merged = T.merge_responses(items, responses(spark, sf_dir))
    return T.category_summary(merged.withColumn("_to", T.sheet(merged)).where("_to = 'Main'")).drop("rank")


# --- logs, selections, caches


def _log(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.concat(F.lit("case"), (F.col("o_custkey") % 3).cast("string")).alias("case_id"), F.concat(F.lit("f"), (F.col("o_custkey") % 11).cast("string")).alias("file"), (F.col("o_orderkey") % 60).cast("int").alias("chunk"), (F.col("o_orderkey") % 5 == 0).alias("failed_chunk"))


@query
def chunk_estimate(spark, sf_dir):
    return T.chunk_estimate(_log(spark, sf_dir))


@query
def resume_anti_join(spark, sf_dir):
    chunks = read(spark, sf_dir, "orders").select(F.concat(F.lit("f"), (F.col("o_orderkey") % 13).cast("string")).alias("file"), (F.col("o_custkey") % 80).cast("int").alias("chunk")).distinct()
    return T.todo_chunks(chunks, _log(spark, sf_dir).where("case_id = 'case0'"), retry_failed=True)


def _files(spark, sf_dir):
    ext = F.element_at(F.array(*map(F.lit, ["docx", "xlsx", "pdf", "zip"])), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "supplier").select(F.concat(F.lit("case"), (F.col("s_suppkey") % 3).cast("string")).alias("case_id"), F.col("s_suppkey").alias("ord"), F.concat_ws(".", "s_name", ext).alias("name"), F.concat_ws(".", F.concat(F.lit("/in/"), F.col("s_name")), ext).alias("path"), (F.col("s_suppkey") * 10).alias("size"), F.lit("2026-01-01T00:00:00").alias("mtime"), F.sha2("s_name", 256).alias("sha256"))


def _selection(spark, sf_dir):
    return _files(spark, sf_dir).where("ord % 3 <> 1").select("case_id", "name", F.when(F.col("ord") % 3 == 0, False).otherwise(F.when(F.col("ord") % 2 == 0, True)).alias("include"))


@query
def selection_counts(spark, sf_dir):
    return T.selection_counts(_files(spark, sf_dir), _selection(spark, sf_dir))


@query
def excluded_files(spark, sf_dir):
    return T.without_excluded(_files(spark, sf_dir), _selection(spark, sf_dir)).select("case_id", "name", "size")


@query
def file_roles(spark, sf_dir):
    known = spark.createDataFrame([("Supplier#3.zip", "main_requirement", 0.876), ("Supplier#000000004.docx", "appendix", None)], "file string, role string, confidence double")
    return T.file_roles(_files(spark, sf_dir).select("name"), known, ["Supplier#000000005.xl", "Supplier#00000007"], ["Supplier#00000008"], 0.5)


@query
def response_upsert(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    log = o.select((F.col("o_custkey") % 500).alias("req_id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("status"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")).alias("comment"))
    return T.upserted(log, ["req_id"], "seq")


def _cached(spark, sf_dir, change: bool):
    items = clean_items(spark, sf_dir)
    if change:
        items = items.withColumn("requirement", F.when(F.col("pos") % 10 == 0, F.concat("requirement", F.lit("!"))).otherwise(F.col("requirement"))).where("pos % 50 <> 7")
    names = spark.createDataFrame([(f"case{c}", k, f"spec_{k}.docx", f"/in/spec_{k}.docx", 100, "t", "h" * (k + 1) + ("x" if change and k == 2 else "")) for c in range(3) for k in range(3)], "case_id string, ord int, name string, path string, size long, mtime string, sha256 string")
    return items, names


@query
def cache_diff(spark, sf_dir):
    old = A.kept_metas(A.item_metas(*_cached(spark, sf_dir, True), "m1"))
    return A.decisions(A.item_metas(*_cached(spark, sf_dir, False), "m1"), old)


@query
def first_changed(spark, sf_dir):
    """The first five changed items of each case."""
    return T.first_changed(cache_diff(spark, sf_dir))


@query
def cache_summary(spark, sf_dir):
    (items, files), (old_items, old_files) = _cached(spark, sf_dir, False), _cached(spark, sf_dir, True)
    i = A.decisions(A.item_metas(items, files, "m1"), A.kept_metas(A.item_metas(old_items, old_files, "m1")))
    f = A.decisions(A.file_metas(files, "m1"), A.kept_metas(A.file_metas(old_files, "m1")))
    return A.cache_summary(i, f)


@query
def cache_metrics(spark, sf_dir):
    return A.metrics(cache_summary(spark, sf_dir))


@query
def runtime_estimate(spark, sf_dir):
    return A.estimate(read(spark, sf_dir, "documents").select(F.col("source").alias("case_id"), F.col("doc_id").cast("string").alias("name"), "text"), "openai")


@query
def run_history(spark, sf_dir):
    """The newest 20 runs: a top-k report."""
    o = read(spark, sf_dir, "orders")
    at = lambda s: F.date_format(F.col("o_orderdate") + F.make_dt_interval(secs=s.cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss")
    runs = o.select(F.concat(F.lit("/runs/"), F.col("o_orderkey").cast("string")).alias("run_dir"), at(F.col("o_custkey") % 86400).alias("started_at"), F.when(F.col("o_orderkey") % 4 > 0, at(F.col("o_custkey") % 86400 + F.col("o_orderkey") % 9000)).otherwise("").alias("ended_at"))
    files = o.where("o_orderkey % 2 = 0").select(F.concat(F.lit("/runs/"), F.col("o_orderkey").cast("string")).alias("run_dir"), F.lit("requirements.json").alias("name"))
    return A.run_history(runs, files)


@query
def lock_staleness(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    started = F.when(F.col("event_id") % 9 == 0, "unreadable").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return e.select("event_id", P.is_stale(started, F.lit("2024-01-15 00:00:00").cast("timestamp")).alias("stale"))


# --- models and logs of runs


@query
def model_answers(spark, sf_dir):
    """Answers as models give them, cleaned, repaired and turned to rows."""
    k = F.col("o_orderkey") % 5
    item = F.concat(F.lit('{"req_id": "R'), F.col("o_orderkey").cast("string"), F.lit('", "requirement": "must", "notes": "", "confidence": 0.5}'))
    whole = F.concat(F.lit('{"requirements": ['), item, F.lit("]}"))
    answer = F.when(k == 0, whole).when(k == 1, F.concat(F.lit("<think>hm</think>```json\n"), whole, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Sure: "), whole, F.lit(" done"))).when(k == 3, F.concat(F.lit('{"requirements": ['), item, F.lit(', {"req_id": "cut'))).otherwise("no json")
    df = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), answer.alias("answer"))
    return M.extracted(M.parsed_answers(df)).select("pos", "k", "req_id", "requirement", "confidence")


def _progress_line():
    o, c = F.col("event_id"), F.col("user_id")
    s = lambda x: x.cast("string")
    return (
        F.when(o % 6 == 0, F.concat(F.lit("[PROGRESS] a.docx chunk "), s(o % 50), F.lit("/50"))).when(o % 6 == 1, F.concat(F.lit("[PROGRESS] enrich item "), s(o % 90), F.lit("/90 req_id=R"), s(c)))
        .when(o % 6 == 2, F.concat(F.lit("[INFO] b.xlsx: "), s(o % 70), F.lit(" chunks"))).when(o % 6 == 3, F.concat(F.lit("[WARN] LLM call failed (attempt "), s(o % 3 + 1), F.lit("/3): x -> sleep 2.5s"))).when(o % 6 == 4, F.concat(F.lit("  ["), s(o % 20), F.lit("/20] Q1"))).otherwise("nothing")
    )


@query
def progress_state(spark, sf_dir):
    from gristmill.streaming.progress import progress_state as state

    df = read(spark, sf_dir, "events").select(F.concat(F.lit("run"), (F.col("user_id") % 20).cast("string")).alias("run"), F.col("event_id").alias("seq"), _progress_line().alias("line"))
    return state(df)


@query
def progress_stream(spark, sf_dir):
    """The same as a stream over log files, run to its end."""
    from gristmill.streaming.progress import run_progress

    with scratch(spark, "progress") as folder:
        df = read(spark, sf_dir, "events").select(F.concat(F.lit("run"), (F.col("user_id") % 20).cast("string")).alias("run"), F.col("event_id").alias("seq"), _progress_line().alias("line"))
        df.write.json(f"{folder}/log")
        return settled(run_progress(spark, f"{folder}/log", f"{folder}/out", f"{folder}/state"))


# --- what failed, kept apart; answers that are kept


def _model_calls(spark, sf_dir):
    """Calls of a model by order: whole answers, answers with talk around them, no JSON, no list, and calls that failed."""
    k = F.col("o_orderkey") % 6
    whole = F.concat(F.lit('{"requirements": [{"req_id": "R'), F.col("o_orderkey").cast("string"), F.lit('", "requirement": "must", "notes": "", "confidence": 0.5}]}'))
    answer = F.when(k == 0, whole).when(k == 1, F.concat(F.lit("Sure: "), whole)).when(k == 2, F.concat(F.lit("no answer to "), F.col("o_orderkey").cast("string"))).when(k == 3, '{"note": 1}').when(k == 4, "")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), answer.alias("answer"), F.when(k == 5, "TimeoutError: busy").alias("error"))


@query
def answer_errors(spark, sf_dir):
    """The side table of calls that gave no requirements."""
    from gristmill.functions.answers import requirements_apart

    with scratch(spark, "answers") as folder:
        return settled(requirements_apart(_model_calls(spark, sf_dir), folder, "pos")[1])


@query
def answer_requirements(spark, sf_dir):
    """What goes on of the same calls."""
    from gristmill.functions.answers import requirements_apart

    with scratch(spark, "answers") as folder:
        return settled(requirements_apart(_model_calls(spark, sf_dir), folder, "pos")[0].drop("problem"))


@query
def log_lines_apart(spark, sf_dir):
    """Lines of a log, good ones and broken ones told apart, counted by user."""
    from gristmill.operators.quarantine import parsed_lines, set_apart

    o = F.col("event_id")
    line = F.when(o % 7 == 1, F.concat(F.lit('{"chunk": '), o.cast("string"))).when(o % 7 == 2, " ").when(o % 7 == 3, '{"chunk": "x"}').otherwise(F.concat(F.lit('{"file": "a", "chunk": '), o.cast("string"), F.lit("}")))
    tried = parsed_lines(read(spark, sf_dir, "events").select("user_id", line.alias("line")), "line", "file string, chunk long")
    with scratch(spark, "log") as folder:
        good, bad = set_apart(tried, folder, "user_id")
        good = good.groupBy("user_id").agg(F.count(F.lit(1)).alias("good"), F.sum("chunk").alias("chunks"))
        bad = bad.groupBy("user_id").agg(F.count(F.lit(1)).alias("bad"), F.max("excerpt").alias("last_bad"))
        return settled(good.join(bad, "user_id", "full_outer").select("user_id", F.coalesce("good", F.lit(0)).alias("good"), "chunks", F.coalesce("bad", F.lit(0)).alias("bad"), "last_bad"))


@query
def cached_answers(spark, sf_dir):
    """What four runs ask: all prompts, the same again, some changed, and the same with another model."""
    from gristmill.functions.answers import ask_new, asked_counts, with_answers

    def prompts(changed: bool, model: str):
        text = F.concat(F.lit("Requirement "), (F.col("o_custkey") % 300).cast("string"), F.when(F.lit(changed) & (F.col("o_custkey") % 300 < 7), "!").otherwise(""))
        rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), text.alias("prompt"))
        return rows.withColumn("signature", S.cache_signature(F.lit("h"), S.text_hash(F.col("prompt")), F.lit("1"), F.lit("1"), F.lit(model)))

    def client():
        return lambda prompt: f"answer to {prompt}"

    runs = {"1 first": (False, "m"), "2 same": (False, "m"), "3 changed": (True, "m"), "4 other model": (False, "n")}
    with scratch(spark, "cache") as folder:
        out = spark.createDataFrame([(r,) for r in runs], "run string")
        rows = []
        for run, how in runs.items():
            ask_new(prompts(*how), folder, run, client)
            told = with_answers(prompts(*how), folder)
            told = told.agg(F.lit(run).alias("run"), F.count("answer").alias("rows_answered"), F.count_if(F.col("answer") == F.concat(F.lit("answer to "), "prompt")).alias("rows_right"))
            rows.append(settled(told))  # one plan over several states of the folder would take them for one table
        told = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
        return settled(out.join(asked_counts(spark, folder), "run", "left").join(told, "run").select("run", F.coalesce("asked", F.lit(0)).alias("asked"), "rows_answered", "rows_right"))


# --- what a model infers of files and cases


def _blocks(spark, sf_dir):
    """The documents as rows of files: paragraphs, tables of five rows, sheets of six rows, or pages, by id."""
    m, ord_ = F.pmod("doc_id", F.lit(4)), F.col("line")
    cells = F.split("text", " ")
    return lines(spark, sf_dir).select(
        F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, (".docx", ".doc", ".xlsx", ".pdf"))), (m + 1).cast("int"))).alias("path"), ord_.alias("ord"),
        F.when(m == 3, "page").otherwise("row").alias("kind"), F.when(m == 2, F.concat(F.lit("S"), F.floor(ord_ / 6).cast("string"))).alias("sheet"), F.when(m == 1, (F.floor(ord_ / 5) + 1).cast("int")).alias("table"),
        F.when(m == 1, ord_ % 5 + 1).when(m == 2, ord_ % 6 + 1).otherwise(ord_ + 1).alias("row"), F.when(m.isin(1, 2), cells).otherwise(F.array("text")).alias("cells"),
    )


@query
def head_samples(spark, sf_dir):
    from gristmill.plans.inference import head_samples as samples

    return samples(_blocks(spark, sf_dir))


@query
def sheet_samples(spark, sf_dir):
    from gristmill.plans.inference import sheet_samples as samples

    return samples(_blocks(spark, sf_dir))


def _schema_client():
    """Stands for a model: a file's kind by its name, and a case's main files by what was said of each."""

    def client(prompt: str) -> str:
        if "one document" in prompt:
            name = re.search(r"^File: (.*)$", prompt, re.M)[1]
            if name.endswith(".pdf"):
                return "can't tell"
            return json.dumps({"file": name, "format": "matrix" if name.endswith(".xlsx") else "plain_text", "is_main_requirement": name.endswith(".xlsx"), "table_cols": "A, B", "confidence": 0.5})
        told = json.loads(next(x for x in prompt.split("\n") if x.startswith("[")))
        main = [f["file"] for f in told if f["is_main_requirement"]]
        return json.dumps({"rfq_format": "matrix" if main else "unknown", "table_structure": {"id_col": "A", "requirement_col": "B"}, "main_files": main, "appendix_files": [f["file"] for f in told if f["format"] == "unknown"], "confidence": 0.5})

    return client


@query
def case_schemas(spark, sf_dir):
    """The schema of each case of about ten files, inferred in two rounds: half of the cases first, then all."""
    from gristmill.plans.inference import case_schemas_once
    from gristmill.plans.inference import head_samples as samples

    found = samples(_blocks(spark, sf_dir)).withColumn("case_id", F.floor(F.regexp_extract("path", r"(\d+)", 1).cast("long") / 10))
    with scratch(spark, "schemas") as folder:
        case_schemas_once(found.where("case_id % 2 = 0"), f"{folder}/kept", _schema_client)
        told = case_schemas_once(found, f"{folder}/kept", _schema_client)
        return settled(told.select("case_id", "rfq_format", F.col("table_structure.requirement_col").alias("requirement_col"), F.array_join(F.array_sort("main_files"), ",").alias("main_files"), F.size("appendix_files").alias("n_appendix")))


# --- live state of runs


def _stream_of(rows: DataFrame, folder: str, files: int, *order: str) -> DataFrame:
    """The rows as a stream over JSON files, one file a batch."""
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.json(folder)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).json(folder)


@query
def progress_live(spark, sf_dir):
    """The state of each run with elapsed seconds, seconds left, and whether it fell silent."""
    from gristmill.streaming.runs import run_live_progress

    with scratch(spark, "live") as folder:
        ts = F.date_trunc("second", "ts").alias("ts")
        df = read(spark, sf_dir, "events").select(F.concat(F.lit("run"), (F.col("user_id") % 20).cast("string")).alias("run"), F.col("event_id").alias("seq"), ts, _progress_line().alias("line"))
        lines = _stream_of(df, f"{folder}/log", 3, "ts")
        return settled(run_live_progress(lines, f"{folder}/out", f"{folder}/state", "2 hours", "60 days").drop("idle"))


@query
def lock_periods(spark, sf_dir):
    """When cases were locked, by the times of what their users did."""
    from gristmill.streaming.runs import lock_periods as periods

    e = read(spark, sf_dir, "events").select(F.concat(F.lit("case"), (F.col("user_id") % 40).cast("string")).alias("case_id"), F.date_trunc("second", "ts").alias("ts"))
    return periods(e)


def _run_events(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "retry").otherwise("ok")
    e = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("case"), (F.col("user_id") % 5).cast("string")).alias("case_id"), "ts", kind.alias("kind"))
    return e.unionByName(e.where("event_id % 4 = 0"))  # some come twice


@query
def error_windows(spark, sf_dir):
    from gristmill.streaming.runs import error_windows as windows

    return windows(_run_events(spark, sf_dir), "6 hours")


@query
def resume_stream(spark, sf_dir):
    """Chunks that come again and again, each done once by a stream that is run twice."""
    from gristmill.streaming.runs import committed, once_each

    o = read(spark, sf_dir, "orders").select(F.concat(F.lit("f"), (F.col("o_orderkey") % 13).cast("string")).alias("file"), (F.col("o_custkey") % 80).cast("int").alias("chunk"))
    with scratch(spark, "resume") as folder:
        chunks = _stream_of(o.withColumn("n", F.col("chunk") % 7), f"{folder}/in", 3, "n")
        work = lambda df: df.select("file", "chunk", F.concat_ws("-", "file", "chunk").alias("done"))
        for _ in range(2):
            once_each(chunks, work, f"{folder}/out", f"{folder}/state").awaitTermination()
        return settled(committed(spark, f"{folder}/out", f"{folder}/state", "file string, chunk int, done string").drop("batch"))
