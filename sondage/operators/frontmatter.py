"""Front matter of documents against a schema: required fields, types, own conditions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import qlang

#: What a value must look like (fixed patterns).
TYPES = {"integer": r"^[+-]?\d+$", "number": r"^[+-]?\d+(\.\d+)?$", "boolean": r"^(?i:true|false|yes|no)$", "date": r"^\d{4}-\d{2}-\d{2}", "string": r"(?s)^.*$"}


def check(structure: DataFrame, required: list[str] = (), types: Mapping[str, str] | None = None, conditions: Mapping[str, str] | None = None) -> DataFrame:
    """Findings on the front matter rows of the structure table: path, rule_code, field, message.

    ``conditions`` name fields and what they must meet, in the query language (``"status": "value~=^(draft|final)$"``).
    A list counts as text item by item.
    """
    rows = structure.where("category in ('frontmatter', 'frontmatter_item')").select("path", F.col("name").alias("field"), F.col("detail").alias("value"), "category")
    values = rows.where("category = 'frontmatter_item' or coalesce(value, '') <> ''")
    paths = structure.where("format = 'markdown'").select("path").distinct()
    out = None

    def add(df: DataFrame, code: str, message: str) -> None:
        nonlocal out
        part = df.select("path", F.lit(code).alias("rule_code"), "field", F.lit(message).alias("message")).distinct()
        out = part if out is None else out.unionByName(part)

    have = rows.select("path").distinct()
    for f in required:
        lacking = paths.join(have, "path", "left_semi").join(values.where(F.col("field") == f).select("path"), "path", "left_anti").withColumn("field", F.lit(f))
        add(lacking, "F003", "a required field is missing")
    for f, t in (types or {}).items():
        one = values.where(F.col("field") == f)
        add(one.where(F.col("category") == "frontmatter") if t == "list" else one.where(~F.col("value").rlike(TYPES[t])), "F004", f"the value is no {t}")
    for f, q in (conditions or {}).items():
        test = [qlang.predicate(c, values.schema) for c in qlang.parse(q)]
        for c in test:
            add(values.where((F.col("field") == f) & ~c), "F005", f"the value does not meet {q}")
    return out if out is not None else paths.select("path", F.lit("").alias("rule_code"), F.lit("").alias("field"), F.lit("").alias("message")).limit(0)
