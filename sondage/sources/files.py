"""Discovery of files, and whole files as rows."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import language_family

#: Folders that hold no sources of one's own (fixed value).
PRUNED = (".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".tox", ".mypy_cache", ".pytest_cache", "vendor", "target", ".idea")


def ignore_pattern(rule: str) -> tuple[str, bool] | None:
    """A line of an ignore file as (pattern over relative paths, whether it ignores)."""
    rule = rule.rstrip("\n").rstrip()
    if not rule or rule.startswith("#"):
        return None
    keep = rule.startswith("!")
    rule = rule[keep:]
    folder = rule.endswith("/")
    rule = rule.rstrip("/")
    rooted = "/" in rule
    body = "".join(
        ".*" if part == "**" else re.sub(r"\\[Zz]$", "", fnmatch.translate(part)).replace("(?s:", "(?:").replace(".*", "[^/]*") if part != "/" else "/"
        for part in re.split(r"(\*\*|/)", rule.lstrip("/"))
        if part
    )
    return ("^" if rooted else "(^|/)") + body + ("/" if folder else "(/|$)"), not keep


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the last matching rule ignores the path."""
    out = F.lit(False)
    for pattern, ignores in filter(None, map(ignore_pattern, rules)):
        out = F.when(path.rlike(pattern), F.lit(ignores)).otherwise(out)
    return out


def discover(spark: SparkSession, root: str, glob: str | None = None, ignore: list[str] | None = None) -> DataFrame:
    """path (below the root), name, size, modified, ext, family; pruned folders are left out. Contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = re.escape(root.rstrip("/"))
    rel = F.regexp_replace("path", f"^(?:file:)?(?://)?(?=/).*?{base}/?", "")
    df = reader.load(root).select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.col("path").alias("url"))
    keep = ~F.col("path").rlike("(^|/)(" + "|".join(map(re.escape, PRUNED)) + ")/") & ~ignored(F.col("path"), ignore or [])
    return df.where(keep).select(
        "path", F.regexp_extract("path", r"[^/]*$", 0).alias("name"), "size", "modified", F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("ext"), language_family(F.col("path")).alias("family"), "url"
    )


def read_texts(spark: SparkSession, root: str, glob: str | None = None, ignore: list[str] | None = None) -> DataFrame:
    """path and text of each file: UTF-8, or else as single bytes."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = re.escape(root.rstrip("/"))
    rel = F.regexp_replace("path", f"^(?:file:)?(?://)?(?=/).*?{base}/?", "").alias("path")
    # what is no UTF-8 is read byte by byte, not refused
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    df = reader.load(root).select(rel, text.cast("string").alias("text"))
    return df.where(~F.col("path").rlike("(^|/)(" + "|".join(map(re.escape, PRUNED)) + ")/") & ~ignored(F.col("path"), ignore or []))


def tally(files: DataFrame) -> DataFrame:
    """Files and bytes per family."""
    return files.groupBy("family").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
