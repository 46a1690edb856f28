"""Ordered rows: running sums, islands, changes, pairs, fill-forward, top rows of a group.

Groups may hold any share of the rows: all but the top rows come from scans over range-sorted partitions (``ordered``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import scan


def running_sum(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Running sums of whole numbers."""
    return scan(df, by, order, sums={name: value})


def islands(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal consecutive values: group, value, island number, length."""
    lagged = scan(df, by, order, number="_n", prevs={"_before": F.col(value)})
    new = (~F.col(value).eqNullSafe(F.col("_before"))) | (F.col("_n") == 0)
    return scan(lagged, by, order, sums={"island": new.cast("bigint")}).groupBy(*by, "island", value).agg(F.count("*").alias("run_length"))


def changes(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """The rows at which a value differs from the one before; the first row of a group counts if it has a value."""
    return scan(df, by, order, prevs={"previous": F.col(value)}).where(~F.col(value).eqNullSafe(F.col("previous")))


def pair_exchanges(df: DataFrame, by: list[str], order: list[str], is_prompt: Column, is_reply: Column, text: str) -> DataFrame:
    """Each prompt with the last reply before the next prompt."""
    turn = scan(df.withColumn("_prompt", is_prompt).withColumn("_reply", is_reply), by, order, sums={"exchange": F.coalesce(F.col("_prompt"), F.lit(False)).cast("bigint")})
    pos = F.struct(*order)
    return turn.where("exchange > 0").groupBy(*by, "exchange").agg(
        F.max(F.when(F.col("_prompt"), F.col(text))).alias("prompt"),
        F.max_by(F.when(F.col("_reply"), F.col(text)), F.when(F.col("_reply"), pos)).alias("reply"),
    )


def fill_forward(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    return scan(df, by, order, lasts={name: F.col(value)})


def within_previous(df: DataFrame, by: list[str], order: list[str], test: Column, rows: int, name: str) -> DataFrame:
    """Whether one of the given number of rows before meets the test."""
    counted = scan(df.withColumn("_hit", F.coalesce(test, F.lit(False))), by, order, number="_n")
    earlier = scan(counted, by, order, earlier={"_last": F.when(F.col("_hit"), F.col("_n"))})
    return earlier.withColumn(name, F.coalesce(F.col("_n") - F.col("_last") <= rows, F.lit(False))).drop("_hit", "_n", "_last")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first rows of each group; the optimiser limits groups before the exchange."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def numbered_range(df: DataFrame, by: list[str], order: list[str], first: int, last: int) -> DataFrame:
    """Rows first to last of each group, counting from 1."""
    return scan(df, by, order, number="row_no").withColumn("row_no", F.col("row_no") + 1).where(F.col("row_no").between(first, last))
