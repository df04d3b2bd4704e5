"""Rule tables: first match by order, all matches, and literal lookups. A rule book comes from the fixed tables or from YAML."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X

from .text import matches, strip

Table = list[tuple[str, list[str]]]


@dataclass(frozen=True)
class RuleBook:
    must: Table = field(default_factory=lambda: X.MUST_LEVELS)
    prefixes: Table = field(default_factory=lambda: X.CATEGORY_PREFIXES)
    categories: Table = field(default_factory=lambda: X.CATEGORY_KEYWORDS)
    glossary_notes: list[str] = field(default_factory=lambda: X.GLOSSARY_NOTES)
    default_category: str = X.DEFAULT_CATEGORY
    category_owners: Table = field(default_factory=lambda: X.CATEGORY_OWNERS)
    owner_keywords: Table = field(default_factory=lambda: X.OWNER_KEYWORDS)
    redflags: list[tuple] = field(default_factory=lambda: X.REDFLAGS)

    @classmethod
    def from_yaml(cls, folder: str) -> RuleBook:
        """Reads must_level_map, category_map, owner_map and redflags; a file that is missing leaves its rules empty."""
        import os

        import yaml

        def read(name: str) -> dict:
            path = os.path.join(folder, f"{name}.yaml")
            if not os.path.exists(path):
                return {}
            with open(path, encoding="utf-8") as f:
                return yaml.safe_load(f) or {}

        must, cats, owners, flags = read("must_level_map"), read("category_map"), read("owner_map"), read("redflags")
        listed = lambda d: [(k, [str(x) for x in (v if isinstance(v, list) else [v])]) for k, v in (d or {}).items()]
        levels = must.get("patterns") or {}
        found = []
        for r in flags.get("rules") or []:
            a = r.get("action") or {}
            category = a.get("force_category")
            found.append((r.get("id", "UNKNOWN"), [str(k or "") for k in (r.get("match") or {}).get("any_keywords") or []], a.get("force_status"), category[0] if isinstance(category, list) else category, a.get("require_evidence"), a.get("forbid_llm_numbers"), a.get("message") or f"Redflag hit: {r.get('id', 'UNKNOWN')}"))
        default = cats.get("default_category") or [X.DEFAULT_CATEGORY]
        return cls(
            must=[(k, [str(x) for x in (levels.get(k) or {}).get("any") or []]) for k in ("MUST", "SHOULD", "MAY", "INFO")],
            prefixes=listed(cats.get("id_prefix_map")), categories=listed(cats.get("keyword_map")), glossary_notes=cats.get("glossary_notes_hit") or [],
            default_category=default[0] if isinstance(default, list) else default, category_owners=listed(owners.get("category_to_owner")),
            owner_keywords=listed(owners.get("keyword_to_owner")), redflags=found,
        )


def any_in(text: Column, keywords: list[str]) -> Column:
    """Whether a lower-case text holds any keyword, as a substring and whatever the case: one alternation, one pass."""
    if not keywords:
        return F.lit(False)
    return F.rlike(text, F.lit("|".join(re.sub(r"([^\w\s])", r"\\\1", k.lower()) for k in keywords)))


def first_of(text: Column, table: Table, default: str | None = None) -> Column:
    """The name of the first rule that has a keyword in the text."""
    t = F.lower(F.coalesce(text, F.lit("")))
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, keywords in table:
        found = found.when(any_in(t, keywords), name)
    return found.otherwise(F.lit(default).cast("string"))


def looked_up(x: Column, table: Table, default: str | None = None) -> Column:
    """The name of the rule that lists x itself."""
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, keys in table:
        found = found.when(x.isin(*keys), name)
    return found.otherwise(F.lit(default).cast("string"))


def must_level(text: Column, book: RuleBook) -> Column:
    return first_of(text, book.must, "INFO")


def must_of_table_row(level: Column, req_id: Column, row_name: Column, table_name: Column) -> Column:
    """INFO becomes MUST where the id, the row or the table's name says that it is a requirement's row."""
    rid, row = F.upper(strip(req_id)), F.upper(strip(row_name))
    starts = lambda x, *ps: F.rlike(x, F.lit("^(" + "|".join(ps) + ")"))
    told = starts(rid, "HOST-", "BIOS-", "BMC-") | starts(row, "HOST", "BIOS", "BMC") | F.contains(F.lower(strip(table_name)), F.lit("requirements"))
    return F.when((level == "INFO") & told, "MUST").otherwise(level)


def category(req_id: Column, text: Column, notes: Column, book: RuleBook) -> Column:
    rid = strip(req_id)
    found = F.when(any_in(F.lower(F.coalesce(notes, F.lit(""))), book.glossary_notes), "Glossary")
    for prefix, cats in book.prefixes:
        found = found.when(F.startswith(rid, F.lit(prefix)), cats[0])
    return found.otherwise(first_of(text, book.categories, book.default_category))


def owner_of_category(categories: Column, book: RuleBook) -> Column:
    """The owner of the first category that has one, else TBD."""
    known = F.create_map(*[F.lit(x) for name, (owner, *_) in book.category_owners for x in (name, owner)]) if book.category_owners else F.create_map().cast("map<string,string>")
    return F.coalesce(F.get(F.filter(F.transform(categories, lambda c: F.try_element_at(known, c)), lambda o: o.isNotNull()), F.lit(0)), F.lit("TBD"))


def owner(categories: Column, text: Column, book: RuleBook, existing: Column | None = None) -> Column:
    by_category = owner_of_category(categories, book) if existing is None else F.coalesce(F.nullif(existing, F.lit("")), owner_of_category(categories, book))
    return F.when(by_category.isin("TBD", ""), F.coalesce(first_of(text, book.owner_keywords), by_category)).otherwise(by_category)


def redflags(text: Column, notes: Column, book: RuleBook) -> Column:
    """A struct of what the rules say: every hit's message in order, the last hit's status, the first hit of each override."""
    t, n = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(notes, F.lit("")))
    hits = [any_in(t, r[1]) | any_in(n, r[1]) for r in book.redflags]
    first = lambda k, kind: F.coalesce(*[F.when(h, F.lit(r[k]).cast(kind)) for h, r in zip(hits, book.redflags, strict=True)], F.lit(None).cast(kind))
    status = F.coalesce(*[F.when(h, F.lit(r[2]).cast("string")) for h, r in list(zip(hits, book.redflags, strict=True))[::-1]], F.lit("AUTO_OK"))
    messages = F.filter(F.array(*[F.when(h, F.lit(r[6])) for h, r in zip(hits, book.redflags, strict=True)]), lambda m: m.isNotNull()) if hits else F.array().cast("array<string>")
    return F.struct(messages.alias("messages"), status.alias("status"), first(3, "string").alias("force_category"), first(4, "boolean").alias("require_evidence"), first(5, "boolean").alias("forbid_llm_numbers"))


def spec_category(label: Column) -> Column:
    return first_of(label, X.SPEC_CATEGORIES, "General")


def corrected_category(cat: Column, text: Column) -> Column:
    c = F.coalesce(cat, F.lit(""))
    return F.when((c != "") & (c != "General"), c).otherwise(F.coalesce(first_of(text, X.CATEGORY_CORRECTIONS), F.nullif(c, F.lit("")), F.lit("General")))


def priority(code: Column) -> Column:
    return looked_up(F.upper(strip(code)), X.PRIORITIES, "INFO")


def risk_tag(t: Column) -> Column:
    """The short tag of a stripped flag: by its name, by how the message starts, by an RF_ name in it, by a keyword; else null."""
    named = lambda tags: F.create_map(*[F.lit(x) for pair in tags.items() for x in pair])
    first = lambda rules, holds: F.coalesce(*[F.when(holds(x), tag) for x, tag in rules])
    within = F.upper(F.regexp_extract(t, r"(?i)RF_(CERT|RELIABILITY|PRICE|SCHEDULE|IP|ROADMAP|GLOSSARY)", 1))
    return F.coalesce(
        F.try_element_at(named(X.RISK_TAGS), t), first(X.MESSAGE_PREFIXES, lambda x: F.startswith(t, F.lit(x))),
        F.try_element_at(named({n[3:]: tag for n, tag in X.RISK_TAGS.items() if n.startswith("RF_")}), within), first(X.TAG_PATTERNS, lambda x: matches(t, x, True)),
    )


def risk_tags(raw: Column) -> Column:
    """Canonical tags in the order first seen, each once; what has no tag stays as it is."""
    flags = F.array_distinct(F.transform(F.coalesce(raw, F.array().cast("array<string>")), strip))
    tags = F.transform(F.filter(flags, lambda t: t != ""), lambda t: F.coalesce(risk_tag(t), t))
    return F.array_distinct(F.filter(tags, lambda x: x != ""))


def risk_note(tags: Column) -> Column:
    notes = F.create_map(*[F.lit(x) for kv in X.RISK_NOTES.items() for x in kv])
    return F.array_join(F.filter(F.transform(tags, lambda t: F.try_element_at(notes, t)), lambda n: n.isNotNull()), "; ")


def bucket(category_: Column) -> Column:
    return looked_up(F.lower(strip(category_)), X.BUCKETS, "Others")


def normal_status(status: Column, kind: Column) -> Column:
    s = F.upper(strip(status))
    return F.when(kind.isin("glossary", "note", "junk"), "AUTO_SKIP").when(s.isin("PENDING", "AUTO_OK", ""), "NEW").when(s.isin(*X.STATUSES), s).otherwise("NEW")


def plain_must_level(text: Column, kind: Column) -> Column:
    """For items that no rule enriched."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(kind == "glossary", "INFO").when(F.contains(t, F.lit("must")) | F.contains(t, F.lit("shall")), "MUST").when(F.contains(t, F.lit("can be replaced")), "MAY").otherwise("INFO")


def plain_triage(text: Column, kind: Column) -> Column:
    """Category, owner, flags, evidence and next action of items that no rule enriched."""
    t = F.lower(F.coalesce(text, F.lit("")))
    row = lambda c, o, flags, e, n: F.struct(F.lit(c).alias("category"), F.lit(o).alias("owner"), (F.array(*map(F.lit, flags)) if flags else F.array().cast("array<string>")).alias("flags"), F.lit(e).alias("evidence"), F.lit(n).alias("next_action"))
    subjective = matches(t, r"\b(look and feel|common)\b") | F.contains(t, F.lit("required"))
    return (
        F.when(kind != "requirement", row("General", "TBD", [], "", ""))
        .when(matches(t, r"\b(tpm|trusted computing|tcg)\b"), row("Security", "BIOS/Security", ["SECURITY_TPM_COMPLIANCE"], "TPM implementation (dTPM/fTPM), part datasheet, certification scope", "Confirm TPM implementation and compliance scope"))
        .when(matches(t, r"\b(bezel|lcd|keypad|button|led|front bezel|rear bezel|console port)\b") & subjective, row("Mechanical", "ME/ID", ["SUBJECTIVE_ACCEPTANCE"], "Customer acceptance criteria / reference product / mechanical spec", "Clarify acceptance criteria with customer"))
        .when(matches(t, r"\b(bezel|lcd|keypad|button|led|front bezel|rear bezel|console port)\b"), row("Mechanical", "ME/ID", [], "Mechanical spec / ID drawing / BOM impact", "Assess feasibility & cost impact"))
        .when(matches(t, r"\b(fru|cru|replaceable|can be replaced)\b"), row("Serviceability", "QA/Service", ["FIELD_SERVICE_IMPACT"], "Service policy / replacement procedure / responsibility boundary", "Confirm replacement policy (customer vs certified technician)"))
        .otherwise(row("General", "TBD", [], "", ""))
    )


def plain_status(kind: Column, level: Column, flags: Column) -> Column:
    return F.when(kind != "requirement", "AUTO_SKIP").when(level.isin("MUST", "SHALL", "MAY") | (F.size(flags) > 0), "NEED_REVIEW").otherwise("NEW")


def seconds_per_call(provider: Column) -> Column:
    p = F.lower(strip(provider))
    found = F.when(F.lit(False), F.lit(None).cast("double"))
    for name, s in X.PROVIDER_SECONDS.items():
        found = found.when(p == name, F.lit(s))
    return found.otherwise(F.lit(X.DEFAULT_SECONDS))


