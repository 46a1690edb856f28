"""One Spark session for all tests, and small transcript rows."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

MESSAGES = (
    "record_type string, uuid string, parent_uuid string, ts string, session_id string, cwd string,"
    " message struct<role: string, content: array<struct<type: string, text: string, thinking: string, name: string, id: string,"
    " input: string, tool_use_id: string, content: string, is_error: boolean>>>, ingested_at timestamp"
)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from sondage.plans.staging import ship

    ship(s)  # the workers need the package, wherever the tests are started
    yield s
    s.stop()


def block(type_=None, **kw):
    names = ("text", "thinking", "name", "id", "input", "tool_use_id", "content", "is_error")
    return (type_, *(kw.get(n) for n in names))


def message(uuid, session="s", ts="2024-01-01T00:00:00Z", role="user", blocks=(), parent=None, record_type=None, cwd=None):
    content = None if blocks is None else (role, list(blocks))
    return (record_type or role, uuid, parent, ts, session, cwd, content, None)


@pytest.fixture
def messages(spark):
    """A transcript table of the given rows, with columns more whose names clash with the operators' own."""

    def make(rows, extra=True):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, MESSAGES)
        if extra:
            df = df.withColumns({c: F.lit("x") for c in ("us", "rid", "role", "part", "kind", "tool", "text", "path", "pos", "b", "content", "reason")})
        return df

    return make
