"""Version history: who touched what, how often, since when."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def owners(touches: DataFrame) -> DataFrame:
    """Per path: its main author (name, email), their share of commits, number of authors, last touch."""
    per = touches.groupBy("path", "author", "email").agg(F.count_distinct("hash").alias("n"), F.max("ts").alias("last"))
    w = Window.partitionBy("path")
    r = per.withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 4)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "author", "email")))
    return r.withColumn("authors", F.count("*").over(w)).withColumn("last_touch", F.max("last").over(w)).where("r = 1").select("path", "author", "email", "n", "share", "authors", "last_touch")


def churn(touches: DataFrame, since: str | None = None, merges: bool = False) -> DataFrame:
    """Commits and changed lines per path since a date; merges are left out unless wanted."""
    df = touches if merges else touches.where(F.size("parents") < 2)
    if since:
        df = df.where(F.col("ts") >= F.unix_timestamp(F.lit(since).cast("timestamp")))
    return df.groupBy("path").agg(F.count_distinct("hash").alias("commits"), F.sum(F.coalesce("added", F.lit(0)) + F.coalesce("removed", F.lit(0))).alias("lines"))


def without_ignored(hunks: DataFrame, ignored: DataFrame) -> DataFrame:
    """Blame hunks (hash, ...) less those of ignored commits."""
    return hunks.join(ignored.select("hash"), "hash", "left_anti")


def coupled(touches: DataFrame, most: int = 50) -> DataFrame:
    """Pairs of paths that change together; commits that touch more than ``most`` paths say nothing about pairs."""
    size = touches.groupBy("hash").agg(F.count_distinct("path").alias("n")).where((F.col("n") > 1) & (F.col("n") <= most))
    t = touches.select("hash", "path").distinct().join(size.select("hash"), "hash")
    return t.alias("a").join(t.alias("b"), "hash").where("a.path < b.path").groupBy(F.col("a.path").alias("path"), F.col("b.path").alias("with")).agg(F.count("*").alias("together"))
