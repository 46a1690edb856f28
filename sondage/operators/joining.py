"""Joins by key, by interval, by nearest preceding row and by absence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import scan

#: Columns of a presence matrix at most.
MOST_COLUMNS = 2000


def lookup(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left rows with what the right side knows; the optimiser picks the strategy by size."""
    return left.join(right, on, "left")


def unmatched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on), on, "left_anti")


def matched(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right.select(*on), on, "left_semi")


def tightest_interval(points: DataFrame, at: Column, intervals: DataFrame, key: str, width: int) -> DataFrame:
    """Each point with the shortest interval (lo, hi, name) that holds it; an equi-join on buckets of ``width``.

    Intervals are cut into the buckets they touch, so no side is compared in full with the other.
    """
    points = points.withColumn("_at", at).withColumn("_bucket", F.floor(F.col("_at") / width))
    cut = intervals.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    hit = points.join(cut, (points["_bucket"] == cut["_bucket"]) & F.col("_at").between(F.col("lo"), F.col("hi")), "left")
    rest = [c for c in points.columns if c not in (key, "_bucket", "_at")]
    # the points travel with the match itself: no second join
    return hit.groupBy(key).agg(*(F.any_value(points[c]).alias(c) for c in rest), F.min_by("name", F.struct(F.col("hi") - F.col("lo"), "name")).alias("name"))


def as_of(df: DataFrame, by: list[str], order: list[str], value: str, where: Column, name: str) -> DataFrame:
    """Each row with the latest earlier ``value`` among the rows that meet ``where``."""
    return scan(df, by, order, earlier={name: F.when(where, F.col(value))})


def presence_matrix(facts: DataFrame, row: str, column: str) -> DataFrame:
    """Which of all columns each row lacks: one line per row with present and missing names."""
    # the column set is the matrix's header: read on the driver only so far as a header goes
    header = [r[0] for r in facts.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_COLUMNS + 1).collect()]
    if len(header) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} columns for a matrix")
    names = F.array(*[F.lit(x) for x in sorted(header)]) if header else F.array().cast("array<string>")
    have = facts.groupBy(row).agg(F.sort_array(F.collect_set(column)).alias("present"))
    return have.select(row, "present", F.array_except(names, "present").alias("missing"))


def consistency(facts: DataFrame, site: str, part: str, least_share: float = 0.25) -> DataFrame:
    """Parts used by at least max(2, share) of the sites, with the number of sites that lack them."""
    sites = facts.select(site).distinct().agg(F.count("*").alias("n_sites"))
    used = facts.groupBy(part).agg(F.count_distinct(site).alias("n_with"))
    return used.join(F.broadcast(sites)).where(F.col("n_with") >= F.greatest(F.lit(2), F.col("n_sites") * least_share)).select(
        part, "n_with", (F.col("n_sites") - F.col("n_with")).alias("n_without")
    )


def suffix_match(left: DataFrame, name: str, right: DataFrame, target: str) -> DataFrame:
    """``a.b.c`` meets a target that equals it or one of its dotted suffixes: an equi-join on suffixes."""
    parts = F.split(F.col(name), r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return left.withColumn(target, F.explode(tails)).join(right, target)
