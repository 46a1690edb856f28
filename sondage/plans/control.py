"""Sorting, paging, projecting and budgets of results."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from .qlang import field_type


@dataclass(frozen=True)
class Page:
    sort: str | None = None
    descending: bool = False
    limit: int | None = None
    offset: int = 0


def parse_page(query: str) -> tuple[str, Page]:
    """Take ``sort=``, ``limit=`` and ``offset=`` out of a query; numbers that cannot be read are ignored."""
    rest, found = [], {}
    for part in (x.strip() for x in (query or "").split("&")):
        key, eq, value = part.partition("=")
        if eq and key in ("sort", "limit", "offset"):
            if key == "sort":
                found |= {"sort": value.lstrip("-") or None, "descending": value.startswith("-")}
            elif value.strip().lstrip("+-").isdigit():
                found[key] = int(value)
        elif part:
            rest.append(part)
    return "&".join(rest), Page(**found)


def order(df: DataFrame, page: Page, tiebreak: list[str] | None = None) -> list[Column]:
    """Nulls last in both directions; a list sorts by its first element; the tiebreak makes the order total."""
    if not page.sort:
        return [F.col(c) for c in tiebreak or []]
    kind = field_type(df.schema, page.sort)
    if kind is None:
        return [F.col(c) for c in tiebreak or []]
    c = F.col(page.sort)
    if isinstance(kind, ArrayType):
        c = F.try_element_at(c, F.lit(1))
    return [c.desc_nulls_last() if page.descending else c.asc_nulls_last(), *(F.col(x) for x in tiebreak or [])]


def page(df: DataFrame, control: Page, tiebreak: list[str] | None = None) -> DataFrame:
    """Sort, then skip, then limit: one TakeOrderedAndProject."""
    by = order(df, control, tiebreak)
    out = df.orderBy(*by) if by else df
    if control.offset > 0:
        out = out.offset(control.offset)
    return out.limit(control.limit) if control.limit is not None else out


def project(df: DataFrame, fields: str) -> DataFrame:
    """``a,b.c``: nested fields keep their nesting; unknown fields are dropped."""
    tree: dict = {}
    for f in (x.strip() for x in fields.split(",")):
        if f and field_type(df.schema, f) is not None:
            reduce(lambda t, k: t.setdefault(k, {}), f.split("."), tree)

    def build(t: dict, at: str) -> list[Column]:
        return [(F.struct(*build(v, f"{at}{k}.")) if v else F.col(f"{at}{k}")).alias(k) for k, v in t.items()]

    return df.select(*build(tree, ""))


def shorten(df: DataFrame, longest: int) -> DataFrame:
    """Cut long text, at any nesting depth, and mark it with an ellipsis."""

    def cut(c: Column, kind) -> Column:
        if isinstance(kind, StringType):
            return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest), F.lit("..."))).otherwise(c)
        if isinstance(kind, ArrayType):
            return F.transform(c, lambda x: cut(x, kind.elementType))
        if isinstance(kind, StructType):
            return F.when(c.isNotNull(), F.struct(*[cut(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
        return c

    return df.select(*[cut(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def budget(df: DataFrame, most: int, tiebreak: list[str]) -> DataFrame:
    """The first ``most`` rows with what was there: total_available, truncated, next_cursor."""
    total = df.agg(F.count("*").alias("total_available"))
    kept = df.orderBy(*tiebreak).limit(most)
    over = F.col("total_available") > most
    # one row on the other side
    return kept.join(F.broadcast(total)).withColumns(
        {"truncated": over, "next_cursor": F.when(over, F.lit(f"offset={most}"))}
    )
