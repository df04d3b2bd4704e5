"""Row predicates and classifiers: pure functions from columns to a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from .text import matches, strip, word_count


def glossary_in_notes(notes: Column) -> Column:
    n = F.upper(F.coalesce(notes, F.lit("")))
    return F.contains(n, F.lit("GLOSSARY")) | F.contains(n, F.lit("DEFINITION"))


def is_definition(text: Column, notes: Column) -> Column:
    """Glossary as the enrichment sees it: by its notes, or a capital abbreviation before a colon."""
    return glossary_in_notes(notes) | matches(strip(text), X.DEFINITION_LINE)


def has_verb(t: Column) -> Column:
    return matches(t, X.REQUIREMENT_VERB, True)


def is_part_number(text: Column) -> Column:
    t = strip(text)
    return (t != "") & (matches(t, X.BARE_NUMBER, True) | (matches(t, X.PART_NUMBER) & ~matches(t, r"\p{Ll}")))


def is_short_junk(text: Column) -> Column:
    t = strip(text)
    return (word_count(t) < 3) & ~has_verb(t)


def item_type(text: Column, notes: Column) -> Column:
    """requirement, glossary, note or junk, by the first that applies."""
    t, n = strip(text), word_count(strip(text))
    return (
        F.when(glossary_in_notes(notes), "glossary")
        .when(matches(t, X.DEFINITION_START), "glossary")
        .when(F.contains(F.upper(F.coalesce(notes, F.lit(""))), F.lit("RFP_PROCESS")), "note")
        .when((t == "") | is_part_number(text) | is_short_junk(text), "junk")
        .when(n < 4, "note")
        .when(matches(t, X.MODAL_VERB, True) | (n >= 8), "requirement")
        .otherwise("note")
    )


def is_noise(text: Column, notes: Column) -> Column:
    """The whole text is a date, an address, a tick, an abbreviation, a mark, a revision note or a name."""
    t = strip(text)
    whole = (
        matches(t, X.PURE_DATE, True) | matches(t, X.EMAIL_ONLY) | matches(t, X.CONTACT) | matches(t, X.TICK_OR_LABEL, True)
        | matches(t, X.UPPER_ABBREVIATION) | matches(t, X.COUNTRY_MARK, True) | ((word_count(t) <= 7) & matches(t, X.REVISION_LOG, True))
        | (matches(t, X.SINGLE_NAME) & ~has_verb(t))
    )
    exempt = glossary_in_notes(notes) | F.contains(F.upper(F.coalesce(notes, F.lit(""))), F.lit("RFP_PROCESS"))
    return ~exempt & ((t == "") | whole)


def promoted_type(kind: Column, text: Column, notes: Column, must: Column, status: Column, has_flag: Column, derived: Column) -> Column:
    """The type after what was said upstream: noise stays out, and a level, a review or a flag makes a requirement."""
    told = (
        F.when(is_noise(text, notes), "junk").when(F.upper(F.coalesce(must, F.lit(""))).isin("MUST", "SHOULD", "MAY"), "requirement")
        .when((status == "NEED_REVIEW") | has_flag, "requirement").when(status == "AUTO_SKIP", "glossary").otherwise(kind)
    )
    return F.when(F.coalesce(derived, F.lit(False)), "requirement").when(kind.isin("note", "junk"), told).otherwise(kind)


def is_orphan(text: Column, kind: Column, derived: Column) -> Column:
    t = strip(text)
    return ~F.coalesce(derived, F.lit(False)) & (kind == "requirement") & matches(t, X.ORPHAN_MARKER, True) & ~has_verb(t) & (word_count(t) <= 8)


def drop_reason(text: Column, notes: Column, status: Column, derived: Column) -> Column:
    """Why cleaning drops a row, or null: noise before short before part_number; derived rows stay."""
    return (
        F.when(F.coalesce(derived, F.lit(False)), F.lit(None).cast("string"))
        .when((F.upper(F.coalesce(status, F.lit(""))) != "AUTO_SKIP") & is_noise(text, notes), "noise")
        .when(is_short_junk(text), "short").when(is_part_number(text), "part_number")
    )


def is_placeholder(x: Column) -> Column:
    return F.coalesce(strip(x).isin("<file>", "<chunk>", ""), F.lit(True))


def is_table_id(x: Column) -> Column:
    t = strip(x)
    return matches(t, X.TABLE_ID, True) | matches(t, r"^ROW_ID=\d+$")


def has_row_evidence(text: Column, notes: Column, prefix: Column) -> Column:
    both = F.concat_ws(" ", F.coalesce(text, F.lit("")), F.coalesce(notes, F.lit("")))
    found = F.regexp_extract_all(both, F.lit("(?iU)" + X.ROW_EVIDENCE), 1)
    return F.exists(found, lambda v: F.contains(F.upper(v), F.upper(prefix)))


def is_structured_rule(rule: Column) -> Column:
    r = F.lower(strip(rule))
    return (F.coalesce(rule, F.lit("")) != "") & ~r.isin("ai auto", "ai 自動編號", "ai 自动编号")


def is_section_header(text: Column, priority: Column) -> Column:
    return (strip(priority) == "") & (word_count(strip(text)) <= 2) & ~matches(strip(text), X.SECTION_VERB, True)


def is_candidate(line: Column) -> Column:
    """A line that the mock extractor takes: a keyword, or a list mark before four words and more."""
    t = strip(line)
    n_tokens = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: w != ""))
    return (F.length(t) >= 8) & (matches(t, X.MOCK_KEYWORD, True) | (matches(t, X.LIST_LINE) & (n_tokens >= 4)))


def may_normalize(kind: Column) -> Column:
    return F.lower(F.coalesce(kind, F.lit(""))) == "requirement"


def is_normalized(reason: Column, normalized: Column) -> Column:
    """A row that was rewritten before and is left alone on another run."""
    return ((strip(reason) != "") & (strip(reason) != "not_attempted")) | (strip(normalized) != "")


def is_active(status: Column, any_case: bool = True) -> Column:
    s = F.coalesce(status, F.lit(""))
    return (F.upper(s) if any_case else s) != "AUTO_SKIP"


def is_enriched(columns: list[str]) -> Column:
    """Whether an earlier stage has judged a row: it has any of six fields. columns: those of the table; a null counts as a
    field that the row lacks."""
    own = [F.col(f"`{c}`").isNotNull() for c in ("must_level", "owner", "status", "redflag_messages", "redflag_overrides", "category") if c in columns]
    return F.coalesce(*[F.when(x, True) for x in own], F.lit(False))


def has_flag(*tags: Column) -> Column:
    """Whether the first of the tag arrays that is given has any."""
    return F.coalesce(*[F.when(F.size(t) > 0, F.lit(True)) for t in tags], F.lit(False))


def is_stale(started_at: Column, now: Column, hours: int = 2) -> Column:
    """A lock without a readable start, or one older than the given hours."""
    age = F.timestamp_diff("SECOND", F.try_to_timestamp(started_at), now)
    return F.coalesce(age > hours * 3600, F.lit(True))


def risk_of(seconds: Column) -> Column:
    return F.when(seconds >= X.STRONG_SECONDS, "high").when(seconds >= X.WARN_SECONDS, "warning").otherwise("ok")
