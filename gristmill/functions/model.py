"""Text models as table functions: pluggable, off by default. Without a client the deterministic rules are all there is."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import fixed as X
from .scalars import guarded_confidence, new_tokens, parsed_json
from .text import strip

#: A client is made on the worker and answers a prompt with text.
ClientFactory = Callable[[], Callable[[str], str]]


def repaired(text: str):
    """Model output as JSON: whole, else the first value in it, else what is between the outer braces, else the complete
    objects of a `requirements` list that was cut off. Raises ValueError if none of it is there."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    start = re.search(r"[{\[]", text)
    if start:
        try:
            return json.JSONDecoder().raw_decode(text, start.start())[0]
        except ValueError:
            pass
    outer = re.search(r"\{.*\}", text, re.S)
    if outer:
        try:
            return json.loads(outer[0])
        except ValueError:
            pass
    listed = re.search(r'"requirements"\s*:\s*\[', text)
    if listed:
        depth, end, rest = 0, 0, text[listed.end() :]
        for m in re.finditer(r"[{}]", rest):
            depth += 1 if m[0] == "{" else -1
            if not depth and m[0] == "}":
                end = m.end()
        if not end:
            return {"requirements": []}
        return json.loads('{"requirements": [' + rest[:end] + "]}")
    raise ValueError("no JSON in the answer: " + text[:200].encode("ascii", "replace").decode())


def answered(client: Callable[[str], str], prompt: str, retries: int = 3, wait: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """The client's answer, or the last error after retries with doubling waits of 10 seconds at most."""
    error = "no attempt"
    for k in range(retries):
        try:
            return client(prompt), None
        except Exception as e:  # noqa: BLE001 - whatever a provider raises is recorded with the row
            error = f"{type(e).__name__}: {e}"
            if k + 1 < retries:
                wait(min(2**k, 10))
    return None, error


def asked(df: DataFrame, prompt: str, factory: ClientFactory, retries: int = 3, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Adds answer and error: one call a row, a client for each partition. Filter before: every row that comes is asked."""
    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for b in batches:
            got = [answered(client, p, retries, wait) for p in b[prompt]]
            yield b.assign(answer=[a for a, _ in got], error=[e for _, e in got])

    return df.mapInPandas(call, StructType([*df.schema.fields, StructField("answer", StringType()), StructField("error", StringType())]))


def parsed_answers(df: DataFrame) -> DataFrame:
    """Adds json: the answer cleaned by expressions, then repaired where it does not parse. df is read once, as its rows may be
    calls; Python gets the texts of broken rows, and nulls for the others."""

    @F.pandas_udf("string")
    def mend(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                return json.dumps(repaired(x), ensure_ascii=False)
            except ValueError:
                return None

        return s.map(one, na_action="ignore")

    df = df.withColumn("_clean", parsed_json(F.col("answer")))
    df = df.withColumn("_broken", F.when(F.expr("try_parse_json(_clean)").isNull(), F.col("_clean")))
    return df.withColumn("json", F.when(F.col("_broken").isNull(), F.col("_clean")).otherwise(mend("_broken"))).drop("_clean", "_broken")


def extracted(answers: DataFrame) -> DataFrame:
    """Rows of the answers' `requirements`: one answer, any number of rows."""
    item = "array<struct<req_id:string,requirement:string,notes:string,confidence:double>>"
    rest = [c for c in answers.columns if c not in ("json", "answer", "error")]
    listed = F.from_json("json", f"struct<requirements:{item}>")["requirements"]
    return answers.select(*rest, F.posexplode(listed).alias("k", "_r")).select(*rest, (F.col("k") + 1).alias("k"), "_r.*")


def enriched(items: DataFrame, answers: DataFrame) -> DataFrame:
    """What a model said of an item overrides the rules, field by field: level, category, owner, status and message. Flags
    that it names ask for evidence, and put the rules' overrides out of force; one stakeholder counts as a list of one. The type that it names has
    no effect, as items are typed by rule. answers: case_id, pos, json."""
    names = "must_level category owner status redflag redflag_message stakeholder"
    said = F.from_json("json", "struct<" + ",".join(f"{n}:string" for n in names.split()) + ">")
    df = items.join(answers.select("case_id", "pos", said.alias("_m"), F.json_object_keys("json").alias("_keys")), ["case_id", "pos"], "left")
    m = lambda c: F.nullif(F.col(f"_m.{c}"), F.lit(""))
    none = F.array().cast("array<string>")
    listed = lambda c: F.coalesce(F.from_json(F.when(F.startswith(m(c), F.lit("[")), m(c)), "array<string>"), F.when(m(c).isNotNull(), F.array(m(c))), none)
    has = F.coalesce(F.size("_keys") > 0, F.lit(False))
    made = {
        "must_level": F.coalesce(m("must_level"), F.col("must_level")), "category": F.when(m("category").isNotNull(), F.array(m("category"))).otherwise(F.col("category")), "owner": F.coalesce(m("owner"), F.col("owner")), "status": F.coalesce(m("status"), F.col("status")),
        "redflag_messages": F.when(has, F.filter(F.array(m("redflag_message")), lambda x: x.isNotNull())).otherwise(F.col("redflag_messages")), "stakeholder": listed("stakeholder"), "llm_enriched": has,
    }
    if "redflag_overrides" in items.columns:
        kind = items.schema["redflag_overrides"].dataType
        asks = F.struct(*[(F.when(F.size(listed("redflag")) > 0, True) if f.name == "require_evidence" else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])
        made["redflag_overrides"] = F.when(has, asks).otherwise(F.col("redflag_overrides"))
    return df.withColumns(made).drop("_m", "_keys")


def normalized(items: DataFrame, answers: DataFrame) -> DataFrame:
    """A model's rewriting under guard: known reasons only, confidence within 0 and 1, and no number, model or standard that
    the item itself does not have. answers: case_id, pos, json."""
    said = F.from_json("json", "struct<normalized_requirement:string,rewrite_reason:string,rewrite_confidence:double,needs_rewrite_review:boolean>")
    df = items.drop("normalized_requirement", "rewrite_reason", "rewrite_confidence", "needs_rewrite_review").join(answers.select("case_id", "pos", said.alias("_m")), ["case_id", "pos"])
    reason = F.when(strip(F.col("_m.rewrite_reason")).isin(*X.REWRITE_REASONS), strip(F.col("_m.rewrite_reason"))).otherwise("no_rewrite")
    df = df.withColumn("_reason", reason)
    df = df.withColumn("normalized_requirement", F.when(F.col("_reason") == "already_complete", "").otherwise(strip(F.col("_m.normalized_requirement"))))
    df = df.withColumn("audit_new_tokens", new_tokens(F.col("normalized_requirement"), F.col("requirement"), F.col("notes"), F.col("source")))
    fresh = F.size("audit_new_tokens") > 0
    return df.withColumns({
        "rewrite_reason": F.when(fresh & F.col("_reason").isin("fragment_to_standalone", "qa_answer_to_requirement"), "ambiguous_needs_review").otherwise(F.col("_reason")),
        "rewrite_confidence": guarded_confidence(F.col("_m.rewrite_confidence"), F.col("audit_new_tokens")), "needs_rewrite_review": F.coalesce("_m.needs_rewrite_review", F.lit(False)) | fresh,
    }).drop("_m", "_reason")


def rendered(template: str, payload: DataFrame, out: str = "prompt") -> DataFrame:
    """A prompt from a template with {payload_json} in it."""
    return payload.withColumn(out, F.replace(F.lit(template), F.lit("{payload_json}"), F.to_json(F.struct(*payload.columns))))


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """The `key: value` lines between --- marks at the head of a prompt file, and its body."""
    m = re.match(r"\A---\s*\n(.*?)\n---\s*\n?", text, re.S)
    if not m:
        return {}, text
    pairs = (line.partition(":") for line in m[1].splitlines() if ":" in line)
    return {k.strip(): v.strip().strip("'\"") for k, _, v in pairs}, text[m.end() :]
