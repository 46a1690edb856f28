"""Profiles and aggregates of tables: columns, values, shapes of JSON, buckets of time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..plans.qlang import NUMERIC


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def profile_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: missing (null or blank), share missing in percent, different values (blank is one)."""
    names = columns or df.columns
    one = df.agg(
        F.count("*").alias("n"),
        *(F.count_if(blank(F.col(c))).alias(f"m_{i}") for i, c in enumerate(names)),
        *(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"d_{i}") for i, c in enumerate(names)),
    )
    rows = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"m_{i}").alias("missing"), F.col(f"d_{i}").alias("distinct_count")) for i, c in enumerate(names)])
    )
    return one.select("n", rows.alias("r")).select(
        "r.column_name",
        "r.missing",
        F.when(F.col("n") == 0, 0.0).otherwise(F.floor(F.col("r.missing") * 1000 / F.col("n") + 0.5) / 10).alias("missing_pct"),
        "r.distinct_count",
    )


def infer_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """integer, float, boolean, string or unknown for text columns, from all values that are not blank."""
    fits = {
        "integer": lambda s: s.rlike(r"^\s*[+-]?\d+\s*$"),
        "float": lambda s: s.rlike(NUMERIC),
        "boolean": lambda s: F.lower(F.trim(s)).isin("true", "false", "yes", "no", "1", "0"),
    }
    agg = [F.count_if(~blank(F.col(c))).alias(f"n_{i}") for i, c in enumerate(columns)]
    agg += [F.count_if(~blank(F.col(c)) & ~f(F.col(c).cast("string"))).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in fits.items()]
    kind = lambda i: reduce(lambda w, k: w.when(F.col(f"{k}_{i}") == 0, k), list(fits)[0:], F.when(F.col(f"n_{i}") == 0, "unknown")).otherwise("string")
    return df.agg(*agg).select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), kind(i).alias("inferred_type")) for i, c in enumerate(columns)])).alias("r")
    ).select("r.*")


def value_frequency(df: DataFrame, field: str) -> DataFrame:
    """How often each value occurs; lists count element by element; null and '' count as missing (null value)."""
    c = F.col(field)
    listed = isinstance(df.schema[field].dataType, ArrayType)
    values = df.select(F.explode_outer(c).alias("value") if listed else c.alias("value"))
    text = F.col("value").cast("string")
    return values.select(F.when(text == "", None).otherwise(text).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def weighted_mean(df: DataFrame, value: str, weight: str, by: list[str] | None = None) -> DataFrame:
    total = F.sum(weight)
    out = F.when(total == 0, 0.0).otherwise(F.sum(F.col(value) * F.col(weight)) / total).alias("weighted_mean")
    return df.groupBy(*(by or [])).agg(out)


def line_types(df: DataFrame, key: str, text: str, comment: str = r"^\s*(#|//|--|/\*|\*)") -> DataFrame:
    """Per text: empty, comment and code lines."""
    lines = F.split(F.col(text), "\n")
    empty = F.size(F.filter(lines, lambda x: F.trim(x) == ""))
    comments = F.size(F.filter(lines, lambda x: x.rlike(comment)))
    return df.where(F.col(text).isNotNull()).select(
        key, F.size(lines).alias("total"), empty.alias("empty"), comments.alias("comments"), (F.size(lines) - empty - comments).alias("code")
    )


def json_keys(df: DataFrame, column: str) -> DataFrame:
    """Which keys the objects of a JSON column have, and how often."""
    return df.select(F.explode(F.json_object_keys(column)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def json_value(c: Column, path: str) -> Column:
    """The value at ``/a/0/b`` as text; a missing path gives null."""
    steps = [f"[{s}]" if s.isdigit() else f".{s}" for s in path.strip("/").split("/") if s]
    return F.get_json_object(c, "$" + "".join(steps))


def gron(df: DataFrame, key: str, column: str) -> DataFrame:
    """A JSON column as flat ``path = value`` lines, one level after the other in the JVM, to the depth of the data."""
    level = df.select(F.col(key), F.lit("json").alias("path"), F.col(column).alias("v")).where(F.col("v").isNotNull())
    level = level.select(key, "path", F.try_parse_json("v").alias("v"))
    kinds = F.schema_of_variant("v")
    out = None
    for _ in range(32):
        inner = kinds.rlike("^(OBJECT|ARRAY)") & ~kinds.isin("OBJECT<>", "ARRAY<VOID>")
        leaf = level.where(~inner).select(
            key, "path", F.when(kinds == "OBJECT<>", "{}").when(kinds == "ARRAY<VOID>", "[]").otherwise(F.to_json("v")).alias("value")
        )
        out = leaf if out is None else out.unionByName(leaf)
        level.createOrReplaceTempView("_gron_level")
        level = df.sparkSession.sql(
            f"select `{key}`, path, x.pos as p, x.key as k, x.value as v from _gron_level, lateral variant_explode(v) as x"
        ).select(
            key, F.when(F.col("k").isNotNull(), F.concat("path", F.lit("."), "k")).otherwise(F.concat("path", F.lit("["), F.col("p").cast("string"), F.lit("]"))).alias("path"), "v"
        )
        if level.isEmpty():
            break
    return out


def bucket(c: Column, unit: str) -> Column:
    """``2024-W01`` or ``2024-01``: ISO weeks and months."""
    if unit == "week":
        return F.format_string("%04d-W%02d", F.extract(F.lit("YEAROFWEEK"), c).cast("int"), F.weekofyear(c))
    return F.date_format(c, "yyyy-MM")


def timeline(df: DataFrame, ts: str, who: str, unit: str = "month") -> DataFrame:
    """Per bucket: rows and different actors; the grand total has a null bucket."""
    return df.withColumn("bucket", bucket(F.col(ts), unit)).rollup("bucket").agg(
        F.count("*").alias("n"), F.count_distinct(who).alias("actors")
    )


def ownership(df: DataFrame, group: str, who: str, ts: str) -> DataFrame:
    """Per group and actor: rows, share of the group and last touch."""
    per = df.groupBy(group, who).agg(F.count("*").alias("n"), F.max(ts).alias("last_touch"))
    w = Window.partitionBy(group)
    return per.withColumn("share", F.floor(F.col("n") / F.sum("n").over(w) * 10000 + 0.5) / 10000)


def primary_owner(df: DataFrame, group: str, who: str) -> DataFrame:
    """Per group: the actor with most rows (ties: the smallest) and the number of actors."""
    per = df.groupBy(group, who).agg(F.count("*").alias("n"))
    best = F.max_by(who, F.struct("n", (-F.col(who)).alias("first")))
    return per.groupBy(group).agg(best.alias("owner"), F.count("*").alias("actors"))


def pivot_counts(df: DataFrame, by: str, values: str, names: list[str]) -> DataFrame:
    """Counts of the named values as columns (a fixed list, so one pass)."""
    return df.groupBy(by).agg(*[F.count_if(F.col(values) == n).alias(f"n_{n.lower().replace(' ', '_').replace('-', '_')}") for n in names])
