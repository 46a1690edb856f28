"""The built-in rules over texts and code, as column tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from .checks import Registry, Rule

BUILTIN = Registry()



def lines_of(c):
    """Lines of a text: its line ends and one."""
    return F.regexp_count(c, F.lit("\n")) + 1


#: Sensitive strings (fixed patterns).
_KEYS = r"(?i)(api[_-]?key|secret|token|passwd|password)\s*[:=]\s*['\"][^'\"]{8,}['\"]"

#: Markers in a line that excuse its length (fixed values).
_EXCUSED = ("http://", "https://", "ftp://", "# noqa", "# type:")
#: Values that are no secret (fixed values).
_HARMLESS = r"(?i)['\"](?:[^'\"]*(?:test|example|placeholder|dummy|fake|sample|none|null|todo|fixme|changeme|replace[_-]me|insert[_-]here|not[-_]?set|development|undefined)[^'\"]*|[a-z_]+|[a-z][a-z0-9+.-]*://[^'\"]*)['\"]"
_MD = r"\.(md|markdown)$"
_DOCKER = r"(^|/)Dockerfile(\.[^/]*)?$|\.dockerfile$"


def _too_long(c):
    out = F.length(F.rtrim(c)) > 100
    for x in _EXCUSED:
        out = out & ~c.contains(x)
    return out


for _rule in (
    Rule("B001", "high", "bare except catches everything", lambda c: c.rlike(r"^\s*except\s*:"), targets=r"\.pyi?$"),
    Rule("E501", "low", "line longer than 100 characters", _too_long),
    Rule("S001", "high", "secret in the text", lambda c: c.rlike(_KEYS) & ~F.regexp_extract(c, _KEYS, 0).rlike(_HARMLESS)),
    Rule("S701", "medium", "image without a fixed version", lambda c: c.rlike(r"(?i)^\s*FROM\s+\S+:latest\b") | (c.rlike(r"(?i)^\s*FROM\s+[^\s:@]+\s*$") & ~c.rlike(r"(?i)^\s*FROM\s+scratch\b")), targets=_DOCKER),
    Rule("M501", "low", "work left to do", lambda c: c.rlike(r"\b(TODO|FIXME|HACK|XXX)\b")),
    Rule("U501", "low", "plain http address of a code host", lambda c: c.rlike(r"(?i)http://(www\.)?github\.com/[^\s'\"<>]+|http://[a-z0-9-]+\.github\.(com|io)/[^\s'\"<>]+")),
    Rule("F001", "low", "front matter is missing", lambda c: ~c.startswith("---"), per_line=False, targets=_MD),
    Rule("F002", "low", "front matter is empty", lambda c: c.rlike(r"^---\s*\n\s*---"), per_line=False, targets=_MD),
    Rule("M101", "medium", "file is too large", lambda c: lines_of(c) > 500, per_line=False, high=lambda c: lines_of(c) > 1000),
    # rules of our own
    Rule("X101", "medium", "mutable default argument", lambda c: c.rlike(r"def \w+\(.*=\s*(\[\]|\{\})")),
    Rule("X102", "low", "link without a target", lambda c: c.rlike(r"\]\(\s*\)")),
    Rule("X103", "low", "link to an absolute local file", lambda c: c.rlike(r"\]\(file://")),
    Rule("X104", "critical", "private key in the text", lambda c: c.rlike(r"-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----")),
    Rule("X105", "low", "debug output", lambda c: c.rlike(r"^\s*(print|console\.log)\(")),
    Rule("X106", "medium", "plain http address", lambda c: c.rlike(r"http://(?!localhost|127\.0\.0\.1)[A-Za-z0-9]")),
    Rule("X107", "low", "tabs and spaces mixed", lambda c: c.rlike(r"^ +\t|^\t+ ")),
    Rule("X108", "low", "white space at the end of a line", lambda c: c.rlike(r"[ \t]+$")),
    Rule("X109", "medium", "front matter is not closed", lambda c: c.startswith("---\n") & ~c.rlike(r"^---\n(?s:.*?)\n---(\n|$)"), per_line=False),
    Rule("X110", "low", "empty text", lambda c: F.trim(c) == "", per_line=False),
    Rule("X111", "low", "unbalanced code fence", lambda c: F.regexp_count(c, F.lit(r"(?m)^```")) % 2 == 1, per_line=False),
):
    BUILTIN.add(_rule)
