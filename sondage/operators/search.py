"""Search in texts: terms, relevance, lines, links, headings, front matter."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import excerpt, occurrences, whole_word

HEADING_WEIGHT = 3


def contains_all(c: Column, terms: list[str]) -> Column:
    out = F.lit(True)
    for t in terms:
        out = out & F.coalesce(F.lower(c).contains(t.lower()), F.lit(False))
    return out


def relevance(c: Column, terms: list[str]) -> Column:
    """Occurrences of the terms, those in headings with extra weight."""
    headings = F.array_join(F.filter(F.split(c, "\n"), lambda x: x.rlike(r"^\s{0,3}#{1,6}\s")), "\n")
    total = F.lit(0).cast("bigint")
    for t in terms:
        total = total + occurrences(c, t) + HEADING_WEIGHT * occurrences(headings, t)
    return total


def search(df: DataFrame, column: str, terms: list[str], around: int = 40) -> DataFrame:
    """Rows that hold all terms, with a score and an excerpt at the first term."""
    c = F.col(column)
    return df.where(contains_all(c, terms)).withColumn("score", relevance(c, terms)).withColumn("excerpt", excerpt(c, terms[0], around))


def grep(df: DataFrame, key: str, column: str, pattern: str) -> DataFrame:
    """Matching lines with their numbers."""
    lines = df.select(key, F.posexplode(F.split(column, "\n")).alias("i", "line"))
    return lines.where(F.col("line").rlike(pattern)).select(key, (F.col("i") + 1).alias("line_no"), "line")


def nearest_heading(df: DataFrame, key: str, column: str, pattern: str) -> DataFrame:
    """Matching lines grouped under the nearest heading before them."""
    from pyspark.sql import Window

    lines = df.select(key, F.posexplode(F.split(column, "\n")).alias("i", "line"))
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    head = F.last(F.when(F.col("line").rlike(r"^#{1,6}\s"), F.regexp_replace("line", r"^#{1,6}\s+", "")), ignorenulls=True).over(w)
    return lines.withColumn("heading", head).where(F.col("line").rlike(pattern)).select(key, "heading", (F.col("i") + 1).alias("line_no"), "line")


def headings(df: DataFrame, key: str, column: str) -> DataFrame:
    lines = df.select(key, F.posexplode(F.split(column, "\n")).alias("i", "line")).where(F.col("line").rlike(r"^#{1,6} \S"))
    return lines.select(key, (F.col("i") + 1).alias("line_no"), F.length(F.regexp_extract("line", r"^(#+)", 1)).alias("level"), F.trim(F.regexp_replace("line", r"^#+ ", "")).alias("title"))


def links(df: DataFrame, key: str, column: str, pattern: str = r"https?://[A-Za-z0-9./_-]+") -> DataFrame:
    found = df.select(key, F.explode(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(0))).alias("url"))
    return found.withColumn("scheme", F.split("url", "://")[0]).withColumn("host", F.regexp_extract("url", r"://([A-Za-z0-9._-]+)", 1))


def link_kind(url: Column) -> Column:
    return F.when(url.rlike(r"^(https?:)?//"), "external").when(url.startswith("mailto:"), "mail").when(url.startswith("#"), "anchor").otherwise("internal")


def front_matter_state(c: Column) -> Column:
    """ok, missing or malformed (opened but never closed)."""
    return F.when(~c.startswith("---\n"), "missing").when(c.rlike(r"^---\n(?s:.*?)\n---(\n|$)"), "ok").otherwise("malformed")


def body_text(c: Column) -> Column:
    return F.regexp_replace(c, r"^---\n(?s:.*?)\n---(\n|$)", "")


def long_lines(df: DataFrame, key: str, column: str, most: int = 100) -> DataFrame:
    lines = df.select(key, F.posexplode(F.split(column, "\n")).alias("i", "line")).where(F.length("line") > most)
    return lines.select(key, (F.col("i") + 1).alias("line_no"), F.length("line").alias("line_length"))


def word_hits(df: DataFrame, column: str, term: str) -> DataFrame:
    return df.where(whole_word(F.col(column), term))


def looks_like_alternation(pattern: str) -> bool:
    """``a\\|b`` is alternation only in basic regular expressions."""
    return bool(re.search(r"\\\|", pattern))
