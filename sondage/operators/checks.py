"""Checks: thresholds to states, roll-ups of states, rules that give findings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("pass", "warning", "failure")
SEVERITIES = ("low", "medium", "high", "critical")


def state(value: Column, warn: float, fail: float, above: bool = True) -> Column:
    """pass, warning or failure against two thresholds; null is a failure to measure."""
    worse = (lambda limit: value >= limit) if above else (lambda limit: value <= limit)
    return F.when(value.isNull(), "warning").when(worse(fail), "failure").when(worse(warn), "warning").otherwise("pass")


def rank_of(c: Column, names: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in names]), c)


def worst(c: Column) -> Column:
    """The worst state of a group."""
    return F.element_at(F.array(*[F.lit(x) for x in STATES]), F.max(rank_of(c, STATES)).cast("int"))


def summary(df: DataFrame, by: list[str], c: str = "state") -> DataFrame:
    counts = [F.count_if(F.col(c) == s).alias(f"n_{s}") for s in STATES]
    return df.groupBy(*by).agg(*counts, worst(F.col(c)).alias("overall"))


def status_rollup(df: DataFrame, who: str, what: str) -> DataFrame:
    """Counts per actor and status, per actor, and overall."""
    return df.rollup(who, what).agg(F.count("*").alias("n"))


def expiry_state(days_left: Column, warn: int = 30, fail: int = 7) -> Column:
    return F.when(days_left < 0, "failure").when(days_left <= fail, "failure").when(days_left <= warn, "warning").otherwise("pass")


def host_matches(name: Column, pattern: Column) -> Column:
    """A certificate name matches exactly, or its one wildcard label stands for one label."""
    tail = F.expr("1=1") & (F.substring(pattern, 3, 1 << 20) == F.regexp_replace(name, r"^[^.]+\.", ""))
    return (F.lower(name) == F.lower(pattern)) | (pattern.startswith("*.") & tail & name.contains("."))


# --- rules -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """A predicate over rows of texts (or their lines) that gives findings."""

    code: str
    severity: str
    message: str
    test: Callable[[Column], Column]
    per_line: bool = True
    category: str = field(default="")
    targets: str | None = None  # pattern of file names
    high: Callable[[Column], Column] | None = None  # where the finding is of high severity


@dataclass
class Registry:
    rules: dict[str, Rule] = field(default_factory=dict)

    def add(self, rule: Rule) -> Rule:
        self.rules[rule.code] = rule
        return rule

    def chosen(self, select: str | None = None, ignore: str | None = None, least: str | None = None) -> list[Rule]:
        """Codes, code prefixes or categories to keep and to leave; a least severity."""

        def named(r: Rule, names: str) -> bool:
            return any(x and (r.code == x or r.code.startswith(x) or r.category == x) for x in (y.strip() for y in names.split(",")))

        out = [r for r in self.rules.values() if (not select or named(r, select)) and not (ignore and named(r, ignore))]
        if least:
            out = [r for r in out if SEVERITIES.index(r.severity) >= SEVERITIES.index(least)]
        return sorted(out, key=lambda r: r.code)


def run_rules(df: DataFrame, key: str, text: str, rules: list[Rule], path: str | None = None) -> DataFrame:
    """key, line, rule_code, severity, message, context of every finding; one pass over the lines for all line rules."""
    out: list[DataFrame] = []
    applies = lambda r: F.coalesce(F.col(path).rlike(r.targets), F.lit(False)) if r.targets and path else F.lit(True)
    severity = lambda r, c: F.when(F.coalesce(r.high(c), F.lit(False)), "high").otherwise(r.severity) if r.high else F.lit(r.severity)
    finding = lambda r, c: F.struct(F.lit(r.code).alias("rule_code"), severity(r, c).alias("severity"), F.lit(r.message).alias("message"))

    def hits(c: Column, chosen: list[Rule]) -> Column:
        return F.filter(F.array(*[F.when(applies(r) & F.coalesce(r.test(c), F.lit(False)), finding(r, c)) for r in chosen]), lambda x: x.isNotNull())

    keep = [key] + ([path] if path else [])
    if line_rules := [r for r in rules if r.per_line]:
        lines = df.select(*keep, F.posexplode(F.split(text, "\n")).alias("i", "_line"))
        out.append(lines.select(key, (F.col("i") + 1).alias("line"), F.explode(hits(F.col("_line"), line_rules)).alias("f"), F.substring("_line", 1, 100).alias("context")))
    if text_rules := [r for r in rules if not r.per_line]:
        out.append(df.select(key, F.lit(1).alias("line"), F.explode(hits(F.col(text), text_rules)).alias("f"), F.substring(text, 1, 100).alias("context")))
    both = reduce(lambda a, b: a.unionByName(b), out)
    return both.select(key, "line", "f.rule_code", "f.severity", "f.message", "context")
