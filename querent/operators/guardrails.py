"""Guardrails as columns: patterns, personal data, secrets, limits, chains, retrieval screens and tool provenance."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.sources.shared import cut

# The pattern families. All but PII and secrets are case-insensitive.
INJECTION = (
    r"\b(?:ignore|disregard|forget|override|bypass)\b[^.\n]{0,40}?\b(?:previous|prior|above|earlier|all|any|system|your)\b[^.\n]{0,20}?\b(?:instructions?|prompts?|rules|directions|guidelines|context)\b",
    r"\b(?:reveal|print|show|repeat|output|leak|dump)\b[^.\n]{0,30}?\b(?:system prompt|hidden prompt|initial instructions|your instructions|your prompt)\b",
    r"\b(?:developer mode|jailbreak(?:ed)?|do anything now)\b",
    r"<\|im_(?:start|end)\|>|\[/?INST\]|<\s*/?\s*(?:system|assistant)\s*>",
)
OVERRIDE = (
    r"\byou are (?:now|no longer)\b",
    r"\bfrom now on,? you\b",
    r"\bnew (?:system )?(?:instructions?|rules|role)\s*:",
    r"(?m)^\s*system\s*:",
    r"\bact as (?:an? )?(?:unrestricted|unfiltered|uncensored)\b",
)
EMAIL, SSN, CARD = r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b", r"\b\d{3}-\d{2}-\d{4}\b", r"\b(?:\d[ -]?){12,18}\d\b"
PHONE = r"(?<!\w)(?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}(?!\w)"
SECRETS = (
    ("aws_access_key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("slack_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b"),
    ("api_key", r"\b(?:sk|rk)[-_](?:live[-_]|test[-_]|proj[-_])?[A-Za-z0-9]{20,}\b"),
    ("bearer_token", r"\bBearer\s+[A-Za-z0-9\-._~+/]{20,}=*"),
    ("encoded_payload_url", r"https?://\S+?[?&][^=\s&]+=[A-Za-z0-9+/_-]{40,}={0,2}"),
)
BOILERPLATE = r"^\s*(page\s+\d+(\s+of\s+\d+)?|figure\s+\d+|table\s+\d+|\d+|[-_=*.|\s–—•·]+)\s*$"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
MAX_CHARS, SPAN = 8000, 200
#: Canaries, and their characters, that are broadcast at most; beyond that, the most characters of an anchor.
CANARY_ROWS, CANARY_CHARS, ANCHOR = 2000, 200_000, 16


def first_span(text: Column, patterns) -> Column:
    """The stretch that the first matching pattern of a family finds, cut to SPAN characters; null without one."""
    spans = [F.nullif(F.regexp_extract(text, f"(?i){p}", 0), F.lit("")) for p in patterns]
    return F.left(F.coalesce(*spans), F.lit(SPAN))


def luhn(number: Column) -> Column:
    """Whether the digits of a string pass the check-digit test."""
    digits = F.reverse(F.filter(F.split(number, ""), lambda c: c.rlike("[0-9]")))
    worth = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(worth, F.lit(0), lambda s, v: s + v) % 10 == 0


def pii_kinds(text: Column) -> Column:
    """Sorted kinds of personal data in a text."""
    cards = F.exists(F.regexp_extract_all(text, F.lit(CARD), F.lit(0)), luhn)
    kinds = F.array(F.when(cards, "CARD"), F.when(text.rlike(EMAIL), "EMAIL"), F.when(text.rlike(PHONE), "PHONE"), F.when(text.rlike(SSN), "SSN"))
    return F.array_compact(kinds)


def secret_kind(text: Column) -> Column:
    """The first kind of secret in the family's order; null without one."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(SECRETS):
        out = F.when(text.rlike(pattern), kind).otherwise(out)
    return out


def limit_violation(text: Column, most: int = MAX_CHARS) -> Column:
    return F.when(F.length(text) > most, "payload_too_large").when(text.rlike(CONTROL), "control_characters")


#: The reason of a check that failed itself: the row is blocked, as it has not been checked.
CHECK_ERROR = "guardrail_error"


def guarded(check):
    """A check written in Python (text -> reason or None) as a reason column of a text. Where it raises, the reason is
    CHECK_ERROR for that row alone; the job goes on. Null texts are not checked."""

    def one(text):
        try:
            return None if text is None else check(text)
        except Exception:  # noqa: BLE001  whatever it is, the row is not let through
            return CHECK_ERROR

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action=None)

    return run


def chain(rows: DataFrame, text_col: str, checks) -> DataFrame:
    """Runs checks in order: each is (name, reason column of a text, replacement column of a text or None). The first
    without a replacement that has a reason blocks, as does any whose reason is CHECK_ERROR, and later ones don't run;
    replacements feed forward."""
    rows = rows.withColumn("_now", F.col(text_col)).withColumn("verdict", F.lit("allow")).withColumn("reason", F.lit(None).cast("string")).withColumn("fired", F.array().cast("array<string>"))
    for name, reason, put in checks:
        found = F.when(F.col("verdict") != "block", reason(F.col("_now")))
        rows = rows.withColumn("_found", found)
        rows = rows.withColumn("fired", F.when(F.col("_found").isNotNull(), F.array_append("fired", F.lit(name))).otherwise(F.col("fired")))
        if put is not None:
            failed = F.coalesce(F.col("_found") == CHECK_ERROR, F.lit(False))
            rows = rows.withColumn("verdict", F.when(failed, "block").otherwise(F.col("verdict"))).withColumn("reason", F.when(failed, CHECK_ERROR).otherwise(F.col("reason")))
            rows = rows.withColumn("_found", F.when(~failed, F.col("_found")))
        if put is None:
            rows = rows.withColumn("verdict", F.when(F.col("_found").isNotNull(), "block").otherwise(F.col("verdict"))).withColumn("reason", F.coalesce("reason", "_found"))
        else:
            rows = rows.withColumn("_now", F.when(F.col("_found").isNotNull(), put(F.col("_now"))).otherwise(F.col("_now")))
            rows = rows.withColumn("verdict", F.when(F.col("_found").isNotNull() & (F.col("verdict") == "allow"), "modify").otherwise(F.col("verdict")))
    return rows.withColumnRenamed("_now", "checked_text").drop("_found")


def sightings(seen: DataFrame, canaries: DataFrame, rows: int = CANARY_ROWS, chars: int = CANARY_CHARS) -> DataFrame:
    """Queries (query_id, own_tenant, text) whose text holds a canary of another tenant. Null and empty canaries are ignored.

    A list of at most `rows` canaries and `chars` characters, both counted, is sent to the texts. A longer one is met by its
    anchors: the first characters of each canary, as many as the shortest has and ANCHOR at most, against the windows of that width of each
    text, by an equi-join that shuffles; what meets is compared in full, so both ways find the same."""
    listed = canaries.select(F.col("tenant_id").alias("canary_tenant"), "canary").where(F.length("canary") > 0).distinct()
    listed = cut(listed, "canaries")
    n, total, width = listed.agg(F.count("canary"), F.coalesce(F.sum(F.length("canary")), F.lit(0)), F.coalesce(F.min(F.length("canary")), F.lit(1))).first()
    foreign = (F.col("canary_tenant") != F.col("own_tenant")) & F.contains("text", "canary")
    if n <= rows and total <= chars:
        return seen.join(F.broadcast(listed), foreign).select("query_id").distinct()
    width = min(width, ANCHOR)
    windows = F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1)))  # in time linear in the text
    texts = seen.select("query_id", "own_tenant", "text").distinct()
    anchored = listed.withColumn("anchor", F.substring("canary", 1, width))
    return texts.withColumn("anchor", F.explode(windows)).join(anchored, "anchor").where(foreign).select("query_id").distinct()


def screen(groups: DataFrame, principals: DataFrame, canaries: DataFrame, quarantined: list[str]) -> tuple[DataFrame, DataFrame]:
    """Evidence groups that may be shown, and queries that fail as a whole because a foreign tenant's canary showed up.

    groups: query_id, group_id, text, tenant_id, acl_hash, source_id; principals: query_id, own_tenant, acl_hashes;
    canaries: tenant_id, canary."""
    seen = groups.join(principals, "query_id")
    failed = sightings(seen, canaries)
    visible = F.coalesce((F.col("tenant_id") == F.col("own_tenant")) & F.array_contains(F.array_append("acl_hashes", F.lit("public")), F.col("acl_hash")), F.lit(False))
    reason = F.when(~visible, "access").when(F.col("source_id").isin(quarantined), "quarantined").when(first_span(F.col("text"), INJECTION).isNotNull(), "injection")
    kept = seen.join(failed, "query_id", "left_anti").withColumn("dropped_for", reason)
    return kept.select(*groups.columns, "dropped_for"), failed


def tool_allowed(calls: DataFrame, regions: DataFrame, gated: list[str], known: list[str]) -> DataFrame:
    """A call is allowed if its tool is known and is ungated or comes from a rendered region that grants authority."""
    rows = calls.join(regions.select("request_id", F.col("region").alias("origin"), "grants_authority"), ["request_id", "origin"], "left")
    allowed = F.col("tool").isin(known) & (~F.col("tool").isin(gated) | F.coalesce("grants_authority", F.lit(False)))
    return rows.withColumn("allowed", allowed)


def redactor():
    """A vectorised function that masks personal data right to left; of overlapping spans the right-most reached stays."""
    kinds = [(k, re.compile(p)) for k, p in (("EMAIL", EMAIL), ("SSN", SSN), ("PHONE", PHONE), ("CARD", CARD))]

    def valid(number: str) -> bool:
        digits = [int(c) for c in reversed(number) if c.isdigit()]
        return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(digits)) % 10 == 0

    def mask(text):
        if text is None:
            return None
        spans = sorted((m.start(), m.end(), kind) for kind, p in kinds for m in p.finditer(text) if kind != "CARD" or valid(m[0]))
        edge = len(text) + 1
        for start, end, kind in reversed(spans):
            if end <= edge:
                text, edge = f"{text[:start]}[REDACTED:{kind}]{text[end:]}", start
        return text

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(mask)

    return run


def stripped_citations(text: Column, known: Column) -> Column:
    """Markers [E#] and [M#] that are not known go, with a space before them."""
    markers = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[([EM]\d+)\]"), F.lit(1)))
    return F.aggregate(F.array_except(markers, known), text, lambda s, m: F.replace(F.replace(s, F.concat(F.lit(" ["), m, F.lit("]")), F.lit("")), F.concat(F.lit("["), m, F.lit("]")), F.lit("")))
