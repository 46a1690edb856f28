"""Instants in text: ISO 8601 of several styles and offsets, or epoch milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant_micros(c: Column) -> Column:
    """Microseconds since the epoch; text without an offset means UTC, anything unreadable gives null."""
    s = F.trim(c)
    iso = F.when(F.substring(s, 11, 40).rlike(r"([Zz]|UTC|[+-]\d{1,2}(:?\d{2})?)$"), F.upper(s)).when(
        F.length(s) <= 10, F.concat(s, F.lit("T00:00:00Z"))
    ).otherwise(F.concat(s, F.lit("Z")))
    iso = F.regexp_replace(iso, ",", ".")
    return F.when(s.rlike(r"^[+-]?\d{5,17}$"), s.try_cast("bigint") * 1000).otherwise(
        # a time alone would be taken as today's
        F.when(s.rlike(r"^[+-]?\d{4,6}-\d"), F.unix_micros(iso.try_cast("timestamp")))
    )
