"""Rule-based moderation: a policy's patterns over whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.functions.text import let

SEVERITIES = ("low", "medium", "high")
#: a policy is written by hand; its rules become expressions of the plan
MAX_RULES = 1_000


@dataclass(frozen=True)
class Rule:
    """One rule of a policy."""

    name: str
    patterns: tuple[str, ...]
    category: str = "custom"
    severity: str = "medium"

    def __post_init__(self) -> None:
        if not self.name or not self.patterns or self.severity not in SEVERITIES:
            raise ValueError(f"bad rule {self.name!r}")
        if not all(self.patterns):
            raise ValueError(f"rule {self.name!r} has an empty pattern")


# fixed values: the built-in policy, small and precise
BUILTIN = (
    Rule("self_harm_intent_en", (r"\b(?:kill|hurt|harm|cut)\s+myself\b", r"\bend\s+my\s+life\b", r"\bsuicide\s+(?:plan|note|method)\b"), "self_harm", "high"),
    Rule("violence_threat_en", (r"\b(?:kill|murder|stab|shoot)\s+(?:you|him|her|them)\b", r"\bI\s+will\s+(?:kill|murder|hurt)\s+\w+"), "violence", "high"),
    Rule("pii_email_residual", (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",), "pii_residual", "medium"),
    Rule("pii_phone_cn_residual", (r"(?<!\d)1[3-9]\d{9}(?!\d)",), "pii_residual", "medium"),
    Rule("profanity_basic_en", (r"\bfuck(?:ing|ed)?\b", r"\bshit\b", r"\bbitch\b"), "profanity", "low"),
)


@dataclass(frozen=True)
class Policy:
    """Named rules."""

    name: str
    version: str
    rules: tuple[Rule, ...]


def select_policy(*policies: Policy) -> Policy:
    """One policy as it is, or several as one: their rules in order, named ``name@version`` of each joined by ``+``."""
    if len(policies) == 1:
        return policies[0]
    return Policy("+".join(f"{p.name}@{p.version}" for p in policies), "merged", merge(*(p.rules for p in policies)))


def policy_from_table(rules: DataFrame) -> tuple[Rule, ...]:
    """The rules of a table (rule_name, category, severity, patterns), by name."""
    rows = rules.orderBy("rule_name").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError("too many rules")
    return tuple(Rule(r.rule_name, tuple(r.patterns), r.category or "custom", r.severity or "medium") for r in rows)


def merge(*policies: Sequence[Rule]) -> tuple[Rule, ...]:
    """All rules of several policies in order, duplicates kept."""
    if not policies:
        raise ValueError("no policy")
    return tuple(r for p in policies for r in p)


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end>> of the matches of one pattern, in code points."""
    java = f"(?iU){pattern}"
    lengths = F.transform(F.split(text, java, -1), lambda p: F.length(p))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(java), F.lit(0)), lambda m: F.length(m))

    def place(lengths: Column, sizes: Column, size: Column, i: Column) -> Column:
        start = F.aggregate(F.slice(lengths, F.lit(1), i + 1), F.lit(0), lambda a, n: a + n) + F.aggregate(
            F.slice(sizes, F.lit(1), i), F.lit(0), lambda a, n: a + n
        )
        return F.struct(start.alias("start"), (start + size).alias("end"))

    return let(lengths, lambda n: let(sizes, lambda m: F.transform(m, lambda x, i: place(n, m, x, i))))


def flags(df: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """All columns but the text, plus (rule, category, severity, start, end): one row per match of any pattern.

    Matches of one pattern do not overlap; those of different patterns may, and all are kept. Letter case is ignored. A
    test of every pattern by itself, as references to groups are by number, keeps texts without any match out of the rest.
    """
    body = F.col(text)
    any_pattern = F.lit(False)
    for p in (p for r in rules for p in r.patterns):
        any_pattern = any_pattern | body.rlike(f"(?iU){p}")

    def hits(rule: Rule, pattern: str) -> Column:
        return F.transform(
            _matches(body, pattern),
            lambda m: F.struct(
                m["start"].alias("start"),
                m["end"].alias("end"),
                F.lit(rule.name).alias("rule"),
                F.lit(rule.category).alias("category"),
                F.lit(rule.severity).alias("severity"),
            ),
        )

    found = F.concat(*[hits(r, p) for r in rules for p in r.patterns])
    kept = [c for c in df.columns if c != text]
    return (
        df.where(any_pattern)
        .select(*kept, F.explode_outer(F.array_sort(found)).alias("f"))
        .where("f is not null")
        .select(*kept, "f.rule", "f.category", "f.severity", "f.start", "f.end")
    )


def outcomes(df: DataFrame, flagged: DataFrame, key: str) -> DataFrame:
    """(key, outcome, n_flags): block if any flag is high, flag if any is medium, else pass, for every key of ``df``."""
    rank = F.when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 1).otherwise(0)
    worst = flagged.groupBy(key).agg(F.max(rank).alias("worst"), F.count(F.lit(1)).alias("n"))
    return df.select(key).distinct().join(worst, key, "left").select(
        key,
        F.when(F.col("worst") == 2, "block").when(F.col("worst") == 1, "flag").otherwise("pass").alias("outcome"),
        F.coalesce("n", F.lit(0)).alias("n_flags"),
    )


def judge(df: DataFrame, rules: Sequence[Rule], text: str = "text") -> DataFrame:
    """All columns but the text, plus (outcome, n_flags), row by row: what ``outcomes`` gives, from counts alone, in one scan
    without a shuffle. A null text passes."""
    counts = {r.severity: F.lit(0) for r in rules}
    for r in rules:
        for p in r.patterns:
            counts[r.severity] = counts[r.severity] + F.regexp_count(F.col(text), F.lit(f"(?iU){p}"))
    got = [F.coalesce(counts.get(s, F.lit(0)), F.lit(0)).alias(f"_{s}") for s in SEVERITIES]
    kept = [c for c in df.columns if c != text]
    return df.select(*kept, *got).select(
        *kept,
        F.when(F.col("_high") > 0, "block").when(F.col("_medium") > 0, "flag").otherwise("pass").alias("outcome"),
        (F.col("_low") + F.col("_medium") + F.col("_high")).cast("bigint").alias("n_flags"),
    )


def summary(flagged: DataFrame) -> DataFrame:
    """(severity, category, n): counts by severity, by category and in total; null stands for all."""
    return flagged.groupingSets([["severity"], ["category"], []], "severity", "category").agg(F.count(F.lit(1)).alias("n"))
