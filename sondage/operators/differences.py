"""Differences between two versions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(left: DataFrame, right: DataFrame, keys: list[str], modified: Column) -> DataFrame:
    """added, removed and modified rows by key; columns of the sides are ``l`` and ``r`` structs in ``modified``."""
    a = left.select(*keys, F.struct(*[c for c in left.columns if c not in keys]).alias("l"))
    b = right.select(*keys, F.struct(*[c for c in right.columns if c not in keys]).alias("r"))
    change = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").when(F.coalesce(modified, F.lit(False)), "modified")
    return a.join(b, keys, "full_outer").withColumn("change", change).where("change is not null")


def element_modified(left_lines: Column, right_lines: Column, left_cx: Column, right_cx: Column, left_sig: Column, right_sig: Column) -> Column:
    """A definition is modified if its signature differs, complexity moves by 2, or length by a tenth."""
    longer = (left_lines > 0) & (F.abs(right_lines - left_lines) / left_lines >= 0.10)
    return ~left_sig.eqNullSafe(right_sig) | (F.abs(right_cx - left_cx) >= 2) | longer


def last_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of repeated keys the last one counts."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_v")).select(*keys, "_v.*")


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, with the side."""
    return left.subtract(right).withColumn("side", F.lit("left")).unionByName(right.subtract(left).withColumn("side", F.lit("right")))


def count_delta(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Counts that differ; null where a side lacks the key."""
    a = left.groupBy(key).agg(F.count("*").alias("base_n"))
    b = right.groupBy(key).agg(F.count("*").alias("head_n"))
    return a.join(b, key, "full_outer").where("not (base_n <=> head_n)")
