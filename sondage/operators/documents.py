"""Rules over sets of documents: links that lead nowhere, folders without an index, too few references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Files in which few references are expected (fixed values).
SPARSE = ("README.md", "INDEX.md", "CHANGELOG.md", "LICENSE.md")
LEAST_REFERENCES = 2


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*?)/?[^/]*$", 1)


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def normal_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` parts, as far as they can be taken out."""
    return F.array_join(
        F.aggregate(
            F.split(path, "/"), F.array().cast("array<string>"),
            lambda done, x: F.when(x.isin("", "."), done).when((x == "..") & (F.size(done) > 0), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))),
        ), "/",
    )


def links(texts: DataFrame) -> DataFrame:
    """path, line and target of every Markdown link."""
    lines = texts.select("path", F.posexplode(F.split("text", "\n")).alias("i", "_line")).where(F.contains("_line", F.lit("](")))
    return lines.select("path", (F.col("i") + 1).alias("line"), F.explode(F.regexp_extract_all("_line", F.lit(r"\[[^\]]+\]\(([^)]+)\)"), F.lit(1))).alias("target"))


def broken_links(texts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Internal links of Markdown files to files that are not there. ``files``: path of all files (default: those of ``texts``)."""
    internal = links(texts.where(F.col("path").rlike(r"\.(md|markdown)$"))).where(~F.col("target").rlike(r"^([a-zA-Z][a-zA-Z0-9+.-]*:|//|#|\s*$)"))
    bare = F.regexp_replace(F.split(F.trim("target"), " ")[0], r"[#?].*$", "")
    at = internal.withColumn("bare", bare).where("bare <> ''")
    to = F.when(F.col("bare").startswith("/"), normal_path(F.col("bare"))).otherwise(normal_path(F.concat_ws("/", folder(F.col("path")), "bare")))
    known = (files if files is not None else texts).select(normal_path(F.col("path")).alias("to")).distinct()
    # a link to a folder is good where the folder holds a file
    folders = known.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("to", "/")) - 1, F.lit(1))), lambda i: F.array_join(F.slice(F.split("to", "/"), 1, i), "/"))).alias("to"))
    return at.withColumn("to", to).join(known.unionByName(folders).distinct(), "to", "left_anti").select("path", "line", "target", "to")


def external_failures(texts: DataFrame, probes: DataFrame) -> DataFrame:
    """External links that a table of probes (url, status) tells to be broken."""
    outer = links(texts.where(F.col("path").rlike(r"\.(md|markdown)$"))).where(F.col("target").rlike(r"^https?://"))
    return outer.join(probes.where("status >= 400 or status is null").select(F.col("url").alias("target"), "status").distinct(), "target")


def missing_indexes(texts: DataFrame) -> DataFrame:
    """Documentation folders without README.md or INDEX.md, each with its first document."""
    p = F.col("path")
    inside = texts.select("path").where(p.rlike(r"(^|/)docs/"))
    top = inside.withColumn("folder", F.regexp_extract(p, r"^((?:.*?/)?docs)/", 1)).withColumn("rest", F.expr("substring(path, length(folder) + 2)")).where(~F.contains("rest", F.lit("/")))
    per = top.groupBy("folder").agg(F.max(F.col("rest").isin("README.md", "INDEX.md")).alias("indexed"), F.min(F.when(F.col("rest").endswith(".md"), F.col("path"))).alias("path"))
    return per.where("not indexed and path is not null").select("folder", "path")


def few_references(texts: DataFrame, least: int = LEAST_REFERENCES) -> DataFrame:
    """Documents below a docs folder with fewer links to other documents than asked for."""
    p = F.col("path")
    docs = texts.where(p.rlike(r"(^|/)docs/") & p.rlike(r"\.(md|markdown)$") & ~name(p).isin(*SPARSE)).select("path", F.coalesce("text", F.lit("")).alias("text"))
    found = F.regexp_extract_all("text", F.lit(r"\[[^\]]+\]\(([^)]+)\)"), F.lit(1))
    other = F.size(F.filter(found, lambda x: F.contains(x, F.lit(".md")) & ~x.startswith("http") & (name(x) != name(p))))
    return docs.select("path", other.alias("references")).where(F.col("references") < least)


def findings(texts: DataFrame) -> DataFrame:
    """file, line, rule_code, severity, message of the rules L001, L004 and L005."""
    row = lambda df, line, code, severity, message: df.select(F.col("path").alias("file"), line.cast("int").alias("line"), F.lit(code).alias("rule_code"), F.lit(severity).alias("severity"), message.alias("message"))
    return (
        row(broken_links(texts), F.col("line"), "L001", "medium", F.concat(F.lit("leads nowhere: "), F.col("target")))
        .unionByName(row(missing_indexes(texts), F.lit(1), "L004", "low", F.concat("folder", F.lit(" has no index"))))
        .unionByName(row(few_references(texts), F.lit(1), "L005", "low", F.concat(F.lit("references: "), F.col("references").cast("string"))))
    )
