"""The small query language: text -> conditions -> one Catalyst predicate.

A query is a list of conditions joined by ``&``. Evaluation is two-valued: no
condition ever yields NULL, so every leaf is closed with ``coalesce``. How lists,
case and nulls behave is a profile, because sources differ in it.

Deviations stated once: patterns of ``~=`` run in Java's dialect, after a check
that they are valid here; a sort over values of clashing types puts nulls last
instead of giving up.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, NumericType, StringType, StructType

#: Text that counts as a number: what a float literal may look like, with single underscores between digits.
NUMERIC = r"^\s*[+-]?(?:(?:\d+(?:_\d+)*)(?:\.(?:\d+(?:_\d+)*)?)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:inf|infinity|nan)\s*$"
LONGEST_PATTERN = 200


@dataclass(frozen=True)
class Profile:
    """How a source compares: any element of a list, letter case, numbers first, null against ``!=``."""

    list_any: bool = True
    case_sensitive: bool = False
    numeric_first: bool = True
    null_differs: bool = True


DEFAULT = Profile()
HISTORY = Profile(list_any=False)
METRICS = Profile(list_any=False, null_differs=False)
CODE = Profile(list_any=False, case_sensitive=True, null_differs=False)


@dataclass(frozen=True)
class Condition:
    field: str
    op: str  # one of = != > >= < <= ~= !~ .. * ? !
    value: object = ""


_BOOL = {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}


def literal(text: str) -> bool | int | float | str:
    """The typed value of a literal; ``1`` and ``0`` are truth values first."""
    if text.lower() in _BOOL:
        return _BOOL[text.lower()]
    for kind in (float,) if "." in text else (int,):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


#: Operators of two characters in the order in which they are looked for anywhere in a condition, then the others.
_TWO = (">=", "<=", "!=", "~=", "!~")
_ONE = (">", "<", "=")


def _condition(part: str) -> Condition:
    if part[0] == "!" and part[1:].strip():
        return Condition(part[1:].strip(), "!")
    op = next((o for o in (*_TWO, *_ONE) if o in part), None)
    if op is None:
        return Condition(part, "?")
    name, value = (x.strip() for x in part.split(op, 1))
    if op != "=" and name.endswith("="):  # ``=>`` and ``=>=`` mean ``>=``
        name = name[:-1].strip()
        op = {">": ">=", "<": "<="}.get(op, op)
    if op == "=":
        if value.startswith("="):
            value = value[1:].strip()
        op = "*" if "*" in value else ".." if ".." in value else "="
    return Condition(name, op, value if op in ("~=", "!~", "*", "..") else literal(value))


def parse(query: str) -> list[Condition]:
    return [_condition(p) for p in (x.strip() for x in (query or "").split("&")) if p]


# --- compilation -------------------------------------------------------------------------------------------------


def as_number(c: Column, kind: DataType) -> Column:
    """The column as double; null where its text is no number."""
    if isinstance(kind, (NumericType, BooleanType)):
        return c.cast("double")
    s = c.cast("string")
    return F.when(s.rlike(NUMERIC), F.regexp_replace(F.trim(s), "(?<=[0-9])_(?=[0-9])", "").try_cast("double"))


def _number(v: object) -> float | None:
    try:
        return float(v)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None


def _text(v: object) -> str:
    return str(v)


def _same(c: Column, kind: DataType, v: object, p: Profile) -> Column:
    left, right = c.cast("string"), F.lit(_text(v))
    if isinstance(kind, BooleanType) or not p.case_sensitive:
        left, right = F.lower(left), F.lower(right)
    same = left == right
    n = _number(v) if p.numeric_first else None
    if n is not None:
        x = as_number(c, kind)
        # a not-a-number equals nothing
        equal = (x == F.lit(n)) & ~F.isnan(x) if n == n else F.lit(False)
        same = F.when(x.isNotNull(), equal).otherwise(same)
    return same


def _ordered(c: Column, kind: DataType, op: str, v: object, p: Profile) -> Column:
    compare = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}[op]
    n = _number(v)
    x = as_number(c, kind)
    by_text = F.lit(False) if p.numeric_first else compare(c.cast("string"), F.lit(_text(v)))
    return by_text if n is None else F.when(x.isNotNull(), compare(x, F.lit(n)) & ~F.isnan(x)).otherwise(by_text)


def _between(c: Column, kind: DataType, v: object, p: Profile) -> Column:
    lo, hi = (x.strip() for x in _text(v).split("..", 1))
    s = c.cast("string")
    by_text = (s >= F.lit(lo)) & (s <= F.lit(hi))
    a, b = (_number(lo) if lo else float("-inf")), (_number(hi) if hi else float("inf"))
    if not p.numeric_first or a is None or b is None:
        return by_text
    x = as_number(c, kind)
    return F.when(x.isNotNull(), (x >= F.lit(a)) & (x <= F.lit(b)) & ~F.isnan(x)).otherwise(by_text)


def wildcard(c: Column, pattern: str, case_sensitive: bool = False) -> Column:
    """``*`` stands for anything; the rest may occur anywhere in the value."""
    body = ".*".join(re.escape(x) for x in pattern.split("*"))
    return c.cast("string").rlike(("" if case_sensitive else "(?i)") + body)


def glob(c: Column, pattern: str, case_sensitive: bool = True) -> Column:
    """File-name style: ``* ? [..]`` against the whole value."""
    import fnmatch

    body = fnmatch.translate(pattern)
    body = re.sub(r"\\[Zz]$", "", body).replace("(?s:", "(?:")
    return c.cast("string").rlike(("(?s)" if case_sensitive else "(?is)") + "^" + body + "$")


def _regex(c: Column, op: str, v: object) -> Column:
    pattern = _text(v)
    try:
        re.compile(pattern)
        usable = len(pattern) <= LONGEST_PATTERN
    except re.error:
        usable = False
    if not usable:
        return F.lit(op == "!~")
    hit = c.cast("string").rlike(pattern)
    return hit if op == "~=" else ~hit


def compare(c: Column, kind: DataType, op: str, v: object, p: Profile = DEFAULT) -> Column:
    """One comparison as a predicate that is never null."""
    if isinstance(kind, ArrayType) and p.list_any:
        some = F.exists(c, lambda x: compare(x, kind.elementType, op, v, p))
        return F.when(c.isNull(), _null(op, v, p)).otherwise(F.coalesce(some, F.lit(False)))
    if op in ("=", "!="):
        test = _between(c, kind, v, p) if op == "=" and isinstance(v, str) and ".." in v else _same(c, kind, v, p)
        test = test if op == "=" else ~test
    elif op == "..":
        test = _between(c, kind, v, p)
    elif op == "*":
        test = wildcard(c, _text(v), p.case_sensitive)
    elif op in ("~=", "!~"):
        test = _regex(c, op, v)
    else:
        test = _ordered(c, kind, op, v, p)
    return F.when(c.isNull(), _null(op, v, p)).otherwise(F.coalesce(test, F.lit(False)))


def _null(op: str, v: object, p: Profile) -> Column:
    return F.lit((p.null_differs and op in ("!=", "!~")) or (op == "=" and isinstance(v, str) and v.lower() == "null"))


def field_type(schema: StructType, name: str) -> DataType | None:
    """The type of a dotted path, or None where there is no such field."""
    kind: DataType = schema
    for step in name.split("."):
        if not isinstance(kind, StructType) or step not in kind.fieldNames():
            return None
        kind = kind[step].dataType
    return kind


def predicate(c: Condition, schema: StructType, p: Profile = DEFAULT, aliases: dict[str, str] | None = None) -> Column:
    name = (aliases or {}).get(c.field, c.field)
    kind = field_type(schema, name)
    column = F.lit(None).cast("string") if kind is None else F.col(".".join(f"`{x}`" for x in name.split(".")))
    kind = kind or StringType()
    if c.op in ("?", "!"):
        empty = column.isNull() | (F.coalesce(column == "", F.lit(False)) if isinstance(kind, StringType) else F.lit(False))
        return empty if c.op == "!" else ~empty
    return compare(column, kind, c.op, c.value, p)


def where(df: DataFrame, query: str | list[Condition], p: Profile = DEFAULT, aliases: dict[str, str] | None = None) -> DataFrame:
    """The rows that meet every condition."""
    conditions = parse(query) if isinstance(query, str) else query
    tests = [predicate(c, df.schema, p, aliases) for c in conditions]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def one_of(c: Column, names: str) -> Column:
    """``a|b`` and ``a,b`` lists of names, each exact or a glob."""
    tests = [glob(c, x) if any(ch in x for ch in "*?[") else c == x for x in re.split(r"[|,]", names) if x]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False)) if tests else F.lit(True)
