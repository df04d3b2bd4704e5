"""The stages of a case as functions from tables to tables: enrich, format, export. Composed, they are one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import fixed as X
from gristmill.functions import predicates as P
from gristmill.functions import rules as R
from gristmill.functions import scalars as S
from gristmill.functions.text import either, strip
from gristmill.operators import ordered as O
from gristmill.operators import tables as T
from gristmill.operators.settle import settled

NONE = "array<string>"


def enrich(items: DataFrame, book: R.RuleBook | None = None) -> DataFrame:
    """Adds must_level, category, owner, status, redflag_messages and redflag_overrides to raw items.

    items: case_id, pos, req_id, requirement, notes, file, chunk, sheet, row, table, table_row, page, derived, spec_category,
    must_level (as read, or null), row_name and table_name where the source names them. Definitions bypass the rules."""
    book = book or R.RuleBook()
    text, notes = F.col("requirement"), F.col("notes")
    glossary = P.is_definition(text, notes)
    said = F.upper(F.coalesce("must_level", F.lit("")))
    level = F.when(said.isin("MUST", "SHOULD", "MAY"), said).otherwise(R.must_of_table_row(R.must_level(text, book), F.col("req_id"), F.col("row_name"), F.col("table_name")))
    df = items.withColumns({"_glossary": glossary, "_level": level, "_category": F.array(R.category(F.col("req_id"), text, notes, book)), "_flags": R.redflags(text, notes, book)})
    df = df.withColumn("_owner", R.owner(F.col("_category"), text, book))
    g, flags = F.col("_glossary"), F.col("_flags")
    category = F.when(flags["force_category"].isNotNull(), F.array(flags["force_category"])).otherwise(F.col("_category"))
    overrides = F.struct(flags["force_category"].alias("force_category"), flags["require_evidence"].alias("require_evidence"), flags["forbid_llm_numbers"].alias("forbid_llm_numbers"), F.lit(None).cast("boolean").alias("auto_skip"))
    skip = F.struct(F.lit(None).cast("string").alias("force_category"), F.lit(None).cast("boolean").alias("require_evidence"), F.lit(None).cast("boolean").alias("forbid_llm_numbers"), F.lit(True).alias("auto_skip"))
    return df.withColumns({
        "must_level": F.when(g, "INFO").otherwise(F.col("_level")), "category": F.when(g, F.array(F.lit("Glossary"))).otherwise(category), "owner": F.when(g, "TBD").otherwise(F.col("_owner")),
        "status": F.when(g, "AUTO_SKIP").when(flags["status"] == "AUTO_OK", "PENDING").otherwise(flags["status"]),
        "redflag_messages": F.when(g, F.array(F.lit(X.GLOSSARY_MESSAGE))).otherwise(flags["messages"]), "redflag_overrides": F.when(g, skip).otherwise(overrides),
    }).drop("_glossary", "_level", "_category", "_flags", "_owner")


def normal_source(items: DataFrame) -> DataFrame:
    """Placeholder files become the case's most common one; a chunk that is no number becomes -1."""
    primary = T.modal_file(items)
    df = items.join(T.small(primary), "case_id", "left")
    return df.withColumns({"file": F.when(P.is_placeholder(F.col("file")), F.col("primary_file")).otherwise(strip(F.col("file"))), "chunk": F.coalesce(F.expr("try_cast(trim(cast(chunk as string)) as int)"), F.lit(-1))}).drop("primary_file")


def clean(items: DataFrame) -> DataFrame:
    """Glue, keep the first of equal texts, drop what is no requirement."""
    df = O.dedup_by_text(O.glue_replaceable(items))
    return df.where(P.drop_reason(F.col("requirement"), F.col("notes"), F.col("status"), F.col("derived")).isNull())


def classified(parts: DataFrame) -> DataFrame:
    """type, flags, status, category and the rest of enriched rows, each part of a split row judged on its own."""
    text, notes, derived = F.col("requirement"), F.col("notes"), F.coalesce("derived", F.lit(False))
    flagged = F.size(F.coalesce("redflag_messages", F.array().cast(NONE))) > 0
    df = parts.withColumn("type", P.promoted_type(P.item_type(text, notes), text, notes, F.col("must_level"), F.coalesce("status", F.lit("")), flagged, derived))
    orphan = P.is_orphan(text, F.col("type"), derived)
    evidence = F.coalesce(F.col("redflag_overrides.require_evidence"), F.lit(False)) & ~derived
    raw = F.when(derived, F.array().cast(NONE)).otherwise(F.filter(F.transform(F.coalesce("redflag_messages", F.array().cast(NONE)), strip), lambda m: m != ""))
    df = df.withColumns({"_orphan": orphan, "_evidence": evidence, "_raw": raw})
    o = F.col("_orphan")
    flags = F.when(o & ~F.array_contains("_raw", "ORPHAN_SUBITEM"), F.concat("_raw", F.array(F.lit("ORPHAN_SUBITEM")))).otherwise(F.col("_raw"))
    level = F.when(derived, "INFO").otherwise(F.coalesce(F.nullif("must_level", F.lit("")), R.plain_must_level(text, F.col("type"))))
    status = F.when(derived | o, "NEED_REVIEW").otherwise(F.coalesce(F.nullif("status", F.lit("")), R.plain_status(F.col("type"), level, F.array().cast(NONE))))
    category = F.when(derived, F.coalesce(F.nullif("spec_category", F.lit("")), F.lit("General"))).otherwise(either(F.array_join(F.coalesce("category", F.array().cast(NONE)), ", "), "General"))
    following = F.when(derived, "Confirm spec against design. Derived from spec table, not explicit requirement.").when(F.col("_evidence"), "Collect evidence and confirm with owner.").when(o, "Verify parent context — read source document").otherwise("")
    df = df.withColumns({"_flags": R.risk_tags(flags), "_status": status, "must_level": level, "_category": category, "_next": following})
    return df.withColumns({
        "risk_tags": F.col("_flags"), "risk_note": R.risk_note(F.col("_flags")), "status": R.normal_status(F.col("_status"), F.col("type")), "category": R.corrected_category(F.col("_category"), text),
        "owner": F.when(derived, "TBD").otherwise(F.coalesce(F.nullif("owner", F.lit("")), F.lit("TBD"))), "evidence_needed": S.cleaned(F.when(F.col("_evidence"), "Provide datasheet/report/certification as applicable.").otherwise("")), "next_action": S.cleaned(F.col("_next")),
    }).drop("_orphan", "_evidence", "_raw", "_flags", "_status", "_category", "_next")


def format_items(enriched: DataFrame, rules: DataFrame | None = None, default_rule: str = "") -> DataFrame:
    """Enriched items to clean ones: sources, cleaning, ids, splitting, classification. `rules` is (file, req_id_rule).

    Cleaned rows are settled: the running ids need them twice, and the rules behind them are the dear part."""
    df = settled(clean(normal_source(enriched)))
    df = T.file_rules(df, rules, default_rule) if rules is not None else df.withColumn("req_id_rule", F.lit(default_rule))
    df = O.resolve_ids(df, F.col("req_id_rule"))
    df = classified(O.explode_pipes(df))
    name = S.display_name(F.col("file"))
    ref = S.source_ref(name, F.col("sheet"), F.col("row"), F.col("table"), F.col("table_row"), F.col("page"), F.col("chunk"))
    return df.select(
        "case_id", "pos", "part", F.col("id").alias("req_id"), F.coalesce("req_id", F.lit("")).alias("orig_req_id"), "original_id", "id_source", "type", "must_level", "category", "owner",
        F.coalesce("stakeholder", F.array().cast(NONE)).alias("stakeholder") if "stakeholder" in df.columns else F.array().cast(NONE).alias("stakeholder"), "status", strip(F.col("requirement")).alias("requirement"), "risk_tags", "risk_note", "evidence_needed", "next_action", ref.alias("source"),
        F.coalesce("derived", F.lit(False)).alias("derived"), F.lit("").alias("normalized_requirement"), F.lit("").alias("rewrite_reason"), F.lit(0.0).alias("rewrite_confidence"), F.lit(False).alias("needs_rewrite_review"),
    )


def plain_rows(items: DataFrame) -> DataFrame:
    """Items that nothing enriched: level, category, owner, flags and status by plain rules."""
    kind = P.item_type(F.col("requirement"), F.col("notes"))
    df = items.withColumn("type", kind)
    df = df.withColumns({"must_level": R.plain_must_level(F.col("requirement"), F.col("type")), "_t": R.plain_triage(F.col("requirement"), F.col("type"))})
    df = df.withColumns({"category": R.corrected_category(F.col("_t.category"), F.col("requirement")), "owner": F.col("_t.owner"), "risk_tags": R.risk_tags(F.col("_t.flags")), "evidence_needed": F.col("_t.evidence"), "next_action": F.col("_t.next_action")})
    return df.withColumn("status", R.normal_status(R.plain_status(F.col("type"), F.col("must_level"), F.col("_t.flags")), F.col("type"))).drop("_t")


def matrix(items: DataFrame) -> DataFrame:
    """The seventeen columns of the compliance matrix, by their display names."""
    c = lambda name, default="": F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in items.columns else F.lit(default)
    tags = F.array_join(F.coalesce("risk_tags", F.array().cast(NONE)), ", ")
    values = [
        c("req_id"), c("must_level"), c("category"), c("owner"), F.array_join(F.filter(F.transform("stakeholder", strip), lambda s: s != ""), ", ") if "stakeholder" in items.columns else F.lit(""), c("status"),
        either(c("final_requirement"), c("normalized_requirement"), F.col("requirement")), c("requirement"), c("vendor_comment"), c("gap"), c("evidence_needed"), tags, c("source"), strip(c("normalized_requirement")), strip(c("rewrite_reason")),
        S.confidence_shown(c("rewrite_reason"), F.col("rewrite_confidence") if "rewrite_confidence" in items.columns else F.lit(0.0)), F.when(F.coalesce("needs_rewrite_review", F.lit(False)), "REVIEW").otherwise("") if "needs_rewrite_review" in items.columns else F.lit(""),
    ]
    return items.select("case_id", "pos", *(["part"] if "part" in items.columns else []), *(["sheet"] if "sheet" in items.columns else []), *[v.alias(name) for v, (name, *_) in zip(values, X.GUIDE, strict=True)])


def export(items: DataFrame, responses: DataFrame) -> DataFrame:
    """Every row of the matrix sheets: main rows in the matrix and in their bucket's sheet, the others in their own."""
    merged = T.merge_responses(items, responses)
    routed = merged.withColumn("_to", T.sheet(merged))
    names = {n: f"{i}. {n}" for i, (n, _) in enumerate(X.BUCKETS, 3)}
    own = R.bucket(S.first_category(F.col("category")))
    named = F.when(F.lit(False), F.lit(""))
    for n, s in names.items():
        named = named.when(own == n, s)
    sheets = F.when(F.col("_to") == "Main", F.array(F.lit("Compliance Matrix"), named)).otherwise(F.array("_to"))
    return matrix(routed.withColumn("sheet", F.explode(sheets)))


def field_guide(spark) -> DataFrame:
    """The static sheet that explains the matrix columns."""
    rows = [(i, name, text, editable, internal, X.GUIDE_NOTES["internal" if internal == "Yes" else "editable" if editable == "Yes" else "fixed"]) for i, (name, text, editable, internal) in enumerate(X.GUIDE)]
    return spark.createDataFrame(rows, "ord int, column_name string, explanation string, editable string, internal_only string, note string")


