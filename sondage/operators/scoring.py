"""Scores with fixed formulas: quality, hotspots, pressure, priority, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cap(c: Column, most: float) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(float(most)))


def quality(avg_cx: Column, avg_len: Column, long_n: Column, deep_n: Column, total: Column, issues: Column | None = None) -> Column:
    """100 less capped penalties for complexity, length, long and deep shares, and findings."""
    share = lambda n: F.when(total > 0, _cap(n / total * 50, 25)).otherwise(0.0)
    out = F.lit(100.0) - _cap((avg_cx - 10) * 3, 30) - _cap((avg_len - 50) / 2, 20) - share(long_n) - share(deep_n)
    if issues is not None:
        out = out - _cap(issues.cast("double"), 40)
    return F.greatest(out, F.lit(0.0))


def hotspot(quality_: Column, cx: Column, long_n: Column, deep_n: Column, commits: Column) -> Column:
    return (
        F.when(quality_ < 70, (70 - quality_) / 10).otherwise(0.0)
        + F.when(cx > 10, cx - 10).otherwise(0.0)
        + 5 * long_n
        + 3 * deep_n
        + F.when(commits > 20, 0.2 * (commits - 20)).otherwise(0.0)
    )


def pressure(n: Column, private: Column, most_per_test: Column) -> Column:
    return n + 0.5 * F.greatest(n - 10, F.lit(0)) + 0.5 * private + F.greatest(most_per_test - 3, F.lit(0))


def boundary(categories: Column, cx: Column, lines: Column, mutates: Column, patches: Column) -> Column:
    return (
        3 * categories
        + F.least(F.lit(10), F.greatest(cx - 10, F.lit(0)))
        + F.when(lines > 80, 4).when(lines > 50, 2).otherwise(0)
        + F.when(mutates, 2).otherwise(0)
        + F.least(F.lit(10.0), patches / 2)
    )


def fan_in_bonus(n: Column) -> Column:
    return F.when(n >= 15, 5).when(n >= 5, 3).when(n >= 1, 1).otherwise(0)


def parse_budget(text: str | None) -> tuple[str, int]:
    """``8000`` tokens, ``500-lines`` lines, otherwise 2000 tokens."""
    t = (text or "").strip().lower()
    if t.endswith("-lines") and t[:-6].isdigit():
        return "lines", int(t[:-6])
    t = t.removesuffix("-tokens")
    return "tokens", int(t) if t.isdigit() else 2000


def fit_budget(df: DataFrame, rank: str, cost: str, most: int) -> DataFrame:
    """Greedy: in order of rank, each row that still fits is kept, others are skipped. Adds ``used``, the running cost.

    No list is gathered: rows that alone exceed the budget are out; of the others a scan keeps those whose running cost fits,
    and where one was skipped the scan goes on behind it. Each round places at least one more row or ends, and whatever no
    longer fits is dropped before the next, so rounds are as many as gaps that smaller rows fill.
    """
    from ..plans.staging import stage
    from .ordered import scan

    left = df.where(F.col(cost) <= most)
    out, used = None, 0
    while True:
        run = stage(scan(left, [], [rank], sums={"used": F.col(cost)}), "budget")
        run = run.withColumn("used", F.col("used") + used)
        # the rows before the first that does not fit
        first = run.where(F.col("used") > most).agg(F.min(rank).alias("r")).first().r
        fits = run if first is None else run.where(F.col(rank) < first)
        out = fits if out is None else out.unionByName(fits)
        if first is None:
            return out
        used = fits.agg(F.max("used").alias("u")).first().u or used
        left = df.where((F.col(rank) > first) & (F.col(cost) <= most - used))
        if left.isEmpty():
            return out


def fit_budgets(df: DataFrame, by: list[str], order: list[str], cost: str, most: int) -> DataFrame:
    """The same for many small groups at once: one fold per group over (order, cost) pairs.

    For groups of bounded size only: a group's pairs are one array.
    """
    entries = F.array_sort(F.collect_list(F.struct(*order, F.col(cost).cast("bigint").alias("_cost"))))
    kind = "struct<used:bigint,kept:array<bigint>>"
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("kept")).cast(kind)
    folded = F.aggregate(
        entries,
        start,
        lambda a, x: F.when(
            a["used"] + x["_cost"] <= most, F.struct((a["used"] + x["_cost"]).alias("used"), F.concat(a["kept"], F.array(x[order[-1]].cast("bigint"))).alias("kept"))
        ).otherwise(a),
    )
    return df.groupBy(*by).agg(folded.alias("f")).select(*by, F.col("f.used").alias("used"), F.explode("f.kept").alias(order[-1]))
