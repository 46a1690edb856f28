"""Columns of transcript records: clean roles and tool names, visible text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One character that is neither white space, a format or control character, nor a blank filler.
VISIBLE = r"[^\s\p{Z}\p{C}⠀ㅤᅟᅠﾠ]"


def clean_role(role: Column, record_type: Column) -> Column:
    """user, assistant or system; the record's type where the role is unknown."""

    def known(c: Column) -> Column:
        c = F.lower(F.trim(c))
        return (
            F.when(c.isin("user", "human"), "user")
            .when(c.isin("assistant", "model", "ai", "bot"), "assistant")
            .when(c.isin("system", "developer"), "system")
        )

    return F.coalesce(known(role), known(record_type))


def clean_tool(name: Column) -> Column:
    """Spelling does not matter in tool names; null stays null."""
    return F.lower(F.trim(name))


def has_visible(c: Column) -> Column:
    return F.coalesce(c.rlike(VISIBLE), F.lit(False))
