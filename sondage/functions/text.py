"""Scalar functions on names and texts, all as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare_name(c: Column) -> Column:
    """The called name alone: no ``new``, no receiver, no namespace, no type arguments."""
    c = F.regexp_replace(F.trim(c), r"^new\s+", "")
    c = F.regexp_replace(c, r"<.*$|\[.*$", "")
    return F.element_at(F.split(c, r"\.|->|::|:|\\"), -1)


def base_tail(c: Column) -> Column:
    """``a.b.Base[T]`` -> ``Base``."""
    return F.element_at(F.split(F.regexp_replace(c, r"\[.*$", ""), r"\."), -1)


def camel_to_snake(c: Column) -> Column:
    c = F.regexp_replace(c, r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(c, r"([a-z\d])([A-Z])", "$1_$2"))


def camelize(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, "_"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20))), "")


def constant_path(c: Column) -> Column:
    """``app/models/user_group.rb`` -> ``UserGroup``-like constant path joined by ``::``, below the second segment."""
    parts = F.split(F.regexp_replace(c, r"\.\w+$", ""), "/")
    return F.array_join(F.transform(F.slice(parts, 3, 100), camelize), "::")


#: Language families by file extension (fixed value).
FAMILIES = {
    "python": ("py", "pyi", "pyx"),
    "javascript": ("js", "jsx", "ts", "tsx", "mjs", "cjs", "vue", "svelte"),
    "jvm": ("java", "kt", "kts", "scala", "groovy"),
    "c": ("c", "h", "cc", "cpp", "cxx", "hpp", "hh", "m", "mm"),
    "go": ("go",),
    "rust": ("rs",),
    "ruby": ("rb", "rake"),
    "php": ("php",),
    "dotnet": ("cs", "vb", "fs"),
    "shell": ("sh", "bash", "zsh"),
}


def language_family(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))
    out = None
    for family, exts in FAMILIES.items():
        test = ext.isin(*exts)
        out = F.when(test, family) if out is None else out.when(test, family)
    return out.otherwise(F.when(ext == "", None).otherwise(ext))


def split_top_commas(c: Column) -> Column:
    """Split on commas that lie in no bracket: a comma splits if the brackets before it are balanced."""
    pieces = F.split(c, ",")
    step = lambda acc, x: F.when(
        F.size(acc) > 0,
        F.when(
            _depth(F.element_at(acc, -1)) > 0,
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(","), x))),
        ).otherwise(F.concat(acc, F.array(x))),
    ).otherwise(F.array(x))
    return F.transform(F.aggregate(pieces, F.array().cast("array<string>"), step), F.trim)


def _depth(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^(\[{]", "")) - F.length(F.regexp_replace(c, r"[^)\]}]", ""))


def parameters(signature: Column) -> Column:
    """Parameter names of ``(a: int, *b, c=1) -> x``; self and cls are left out."""
    inner = F.regexp_extract(signature, r"\((.*)\)", 1)
    names = F.transform(split_top_commas(inner), lambda x: F.regexp_extract(x, r"^\*{0,2}\s*(\w+)", 1))
    return F.filter(names, lambda x: (x != "") & ~x.isin("self", "cls"))


def whole_word(c: Column, term: str) -> Column:
    return c.rlike(r"(?i)\b" + re.escape(term) + r"\b")


def occurrences(c: Column, term: str) -> Column:
    """Non-overlapping occurrences, regardless of case."""
    t = term.lower()
    return F.when(c.isNull() | F.lit(t == ""), 0).otherwise(
        F.floor((F.length(c) - F.length(F.replace(F.lower(c), F.lit(t), F.lit("")))) / max(1, len(t)))
    ).cast("bigint")


def excerpt(c: Column, term: str, around: int = 40) -> Column:
    """The text around the first occurrence, with marks where something was left out."""
    at = F.locate(term.lower(), F.lower(c))
    lo = F.greatest(F.lit(1), at - around)
    hi = F.least(F.length(c), at + len(term) - 1 + around)
    body = F.substring(c, lo, hi - lo + 1)
    return F.when(at > 0, F.concat(F.when(lo > 1, "...").otherwise(""), body, F.when(hi < F.length(c), "...").otherwise("")))


#: Names that hold secrets, and prefixes of variable categories (fixed values).
SECRET = r"(?i)(password|passwd|secret|token|api_?key|private_?key|credential)"
CATEGORIES = {"python": ("PYTHON", "PIP", "VIRTUAL_ENV", "CONDA"), "git": ("GIT_",), "shell": ("SHELL", "TERM", "PS1"), "path": ("PATH", "LD_"), "locale": ("LANG", "LC_", "TZ"), "user": ("USER", "HOME", "LOGNAME")}


def redact(name: Column, value: Column) -> Column:
    return F.when(name.rlike(SECRET), "***").otherwise(value)


def categorize(name: Column, table: dict[str, tuple[str, ...]] | None = None) -> Column:
    out = None
    for k, prefixes in (table or CATEGORIES).items():
        test = F.upper(name).rlike("^(" + "|".join(re.escape(p.upper()) for p in prefixes) + ")")
        out = F.when(test, k) if out is None else out.when(test, k)
    return out.otherwise("other")


def age_label(seconds: Column) -> Column:
    return (
        F.when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago")))
        .when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d ago")))
    )


def percentage(c: Column) -> Column:
    return F.regexp_extract(c, r"([\d.]+)\s*%?", 1).try_cast("double")


def complexity(c: Column) -> Column:
    """Keyword estimate: one, and one more for each branching word or operator."""
    return (F.lit(1) + F.regexp_count(c, F.lit(r"\b(if|elif|else if|for|while|case|catch|except|and|or)\b|&&|\|\|"))).cast("bigint")


def camel_words(c: Column) -> Column:
    return F.split(camel_to_snake(c), "_")
