"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_ROLE = "\x00"


@dataclass(frozen=True)
class Template:
    """How turns are marked. `turns` maps a role to its opening and closing marker and whether its text bears loss; any other
    role is written out between `other`'s three markers. `states` is the machine: state -> role -> next state."""

    turns: dict[str, tuple[str, str, bool]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>", False), "user": ("[INST] ", " [/INST]", False), "assistant": ("<s>", "</s>", True)})
    other: tuple[str, str, str] = ("<<ROLE>>", "<<TEXT>>", "<</ROLE>>")
    guarded: tuple[str, ...] = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "<<ROLE>>", "<<TEXT>>", "<</ROLE>>", "<|endoftext|>", "<|im_start|>", "<|im_end|>")
    states: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "briefed", "user": "asked"}, "briefed": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    final: tuple[str, ...] = ("answered",)


LLAMA = Template()


def escaped(text: Column, t: Template) -> Column:
    r"""Doubles backslashes, then puts \~ behind the first character of every control string, so that none is left."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(c[0] + "\\~" + c[1:])), sorted(t.guarded, key=len, reverse=True), text)


def unescaped(text: Column) -> Column:
    r"""Left to right: \~ goes, \\ becomes one backslash."""
    return F.regexp_replace(text, r"\\(?:~|(\\))", "$1")


def segment(text: Column, loss: Column | bool) -> Column:
    return F.struct(text.alias("text"), (loss if isinstance(loss, Column) else F.lit(loss)).alias("loss"))


def turn_segments(role: Column, text: Column, t: Template) -> Column:
    """Opening marker, escaped text, closing marker of one turn."""
    name = F.coalesce(role, F.lit(NULL_ROLE))
    opening = F.concat(F.lit(t.other[0]), escaped(name, t), F.lit(t.other[1]))
    closing, loss = F.lit(t.other[2]), F.lit(False)
    for r, (o, c, bears) in t.turns.items():
        opening, closing, loss = F.when(role == r, F.lit(o)).otherwise(opening), F.when(role == r, F.lit(c)).otherwise(closing), F.when(role == r, F.lit(bears)).otherwise(loss)
    return F.array(segment(opening, False), segment(escaped(text, t), loss), segment(closing, False))


def end_state(roles: Column, t: Template) -> Column:
    """The machine's state after all roles; null once a role had no transition."""

    def step(state: Column, role: Column) -> Column:
        out = F.lit(None).cast("string")
        for s, by_role in t.states.items():
            for r, to in by_role.items():
                out = F.when((state == s) & (role == r), F.lit(to)).otherwise(out)
        return out

    return F.aggregate(roles, F.lit("start").cast("string"), step)


def formatted(turns: DataFrame, t: Template = LLAMA) -> DataFrame:
    """One row per conv_id of a table (conv_id, turn, role, text): conv_id, segments (text, loss), n_turns, valid.

    Turns are ordered by turn, ties and repeated rows by role and text, nulls first. A null text is empty; a null or unknown
    role is written out with its name and makes the conversation invalid, as does any order that the machine has no
    transition for; invalid conversations are formatted all the same. Rows with a null conv_id form one conversation. An
    empty table gives no rows; other columns play no part."""
    rows = turns.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("row"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    segments = F.flatten(F.transform("rows", lambda r: turn_segments(r["role"], r["text"], t)))
    state = end_state(F.transform("rows", lambda r: F.coalesce(r["role"], F.lit(NULL_ROLE))), t)
    return whole.select("conv_id", segments.alias("segments"), F.size("rows").cast("long").alias("n_turns"), F.coalesce(state.isin(*t.final), F.lit(False)).alias("valid"))


def rendered(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_back(text: Column, t: Template = LLAMA) -> Column:
    """The turns (role, text) that a formatted text holds."""
    quote = lambda x: "".join("\\" + c if not c.isalnum() and c != " " else c for c in x)
    opens = "|".join([*(quote(o) for o, *_ in t.turns.values()), f"{quote(t.other[0])}.*?{quote(t.other[1])}"])
    closes = "|".join([*(quote(c) for _, c, _ in t.turns.values()), quote(t.other[2])])
    found = F.regexp_extract_all(text, F.lit(f"(?s)(?:{opens})(?:.*?)(?:{closes})"), 0)

    def turn(x: Column) -> Column:
        start = F.length(F.lit(t.other[0])) + 1
        role = F.substring_index(x.substr(start, F.length(x)), t.other[1], 1)
        o, c = F.length(role) + len(t.other[0]) + len(t.other[1]), F.lit(len(t.other[2]))
        role = F.when(role == NULL_ROLE, F.lit(None).cast("string")).otherwise(unescaped(role))
        for r, (a, b, _) in t.turns.items():
            here = x.startswith(F.lit(a))
            role, o, c = F.when(here, F.lit(r)).otherwise(role), F.when(here, F.lit(len(a))).otherwise(o), F.when(here, F.lit(len(b))).otherwise(c)
        return F.struct(role.alias("role"), unescaped(x.substr(o + 1, F.length(x) - o - c)).alias("text"))

    return F.transform(found, turn)


def digests(chats: DataFrame, t: Template = LLAMA) -> DataFrame:
    """Per conversation what its formatted text and loss flags give back: see op6's contract."""
    out = chats.select("conv_id", "n_turns", "valid", rendered(F.col("segments")).alias("formatted"), F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "").alias("learned"))
    out = out.withColumn("back", read_back(F.col("formatted"), t))
    said = F.array_join(F.transform("back", lambda b: F.concat(F.coalesce(b["role"], F.lit("")), F.lit("\n"), b["text"], F.lit("\n"))), "")
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return out.select("conv_id", F.size("back").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), sha(F.col("learned")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")
