"""Runs of repeated consecutive events in ordered sequences.

Pointer doubling: every event that asks for the same work as the event before
it points to that event; then pointers are replaced by their pointers'
pointers, in logarithmically many self-joins, until all reach the start of
their run. No group is ever collected: a sequence, or a run, may hold any share
of the rows.

Defined results: a null sequence id or an event without instant never joins a
run; ties in the instant are ordered by ``uuid``, then position; rows delivered
again (same ``uuid`` and position) count once; null input equals null input; an
input that is no JSON object is compared as text with white space collapsed;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions.instants import instant_micros
from ..functions.transcripts import clean_tool
from ..plans.staging import sorted_map, stage

#: Fields of a request that only number, trace or time the attempt: their names in lower case without ``-``, ``_`` and spaces.
ATTEMPT_FIELD = (
    r"^((attempt|retry|try)(no|nr|num|number|count|index|id)?"
    r"|(trace|span|correlation|idempotency)(id|key|parent)?"
    r"|requestid|nonce"
    r"|(sent|requested|issued|queued|submitted|retried|attempted)(at|on|time|ts)?)$"
)
PATH_FIELD = re.compile(r"(^|_)(path|file|dir|directory|cwd)$")
COMMAND_FIELD = re.compile(r"(^|_)(command|cmd)$")
_NUMBER = re.compile(r"-?\d{1,15}(\.\d{1,6})?\Z")


def canonical_value(key: str, v):
    """One spelling for values that differ only in notation."""
    if isinstance(v, str):
        if COMMAND_FIELD.search(key):
            v = " ".join(v.split())
        elif PATH_FIELD.search(key):
            v = re.sub(r"/(?:\./|/)+", "/", re.sub(r"/{2,}", "/", v.strip()))
            v = re.sub(r"^(?:\./)+(?=.)", "", v)
            v = v[:-2] if v.endswith("/.") else v
            v = v.rstrip("/") or v[:1]
        s = v.strip()
        if _NUMBER.match(s):
            v = float(s)
        elif s in ("true", "false"):
            v = s == "true"
    elif isinstance(v, dict):
        return {k: canonical_value(k, x) for k, x in v.items() if x is not None}
    elif isinstance(v, list):
        return [canonical_value(key, x) for x in v]
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return float(v)
    return v


def canonical_request(name: str | None, request: str | None, attempt_field: str = ATTEMPT_FIELD) -> str:
    """The work that a call asks for, in one spelling."""
    tool = (name or "").strip().lower()
    if request is None:
        return f"{tool}\x00"
    try:
        v = json.loads(request)
    except (ValueError, RecursionError):
        return f"{tool}\x00{' '.join(request.split())}"
    if isinstance(v, dict):
        v = {
            k: canonical_value(k, x)
            for k, x in v.items()
            if x is not None and not re.match(attempt_field, re.sub(r"[-_ ]", "", k).lower())
        }
    return f"{tool}\x00{json.dumps(v, sort_keys=True, ensure_ascii=False)}"


def request_key(attempt_field: str):
    @F.pandas_udf(BinaryType())
    def key(name: pd.Series, request: pd.Series) -> pd.Series:
        blake = hashlib.blake2b
        return pd.Series(
            [blake(canonical_request(n, r, attempt_field).encode("utf-8", "surrogatepass"), digest_size=12).digest() for n, r in zip(name, request)],
            dtype=object,
        )

    return key


def tool_calls(messages: DataFrame, attempt_field: str = ATTEMPT_FIELD) -> DataFrame:
    """The tool_use blocks directly in ``message.content``, one row each, with the key of the request."""
    blocks = messages.select(
        "session_id",
        "uuid",
        instant_micros(F.col("ts")).alias("us"),
        F.posexplode("message.content").alias("pos", "b"),
    ).where("b.type = 'tool_use'")
    return blocks.select(
        "session_id",
        "us",
        "uuid",
        "pos",
        clean_tool(F.col("b.name")).alias("tool"),
        F.col("b.id").alias("use_id"),
        request_key(attempt_field)(F.col("b.name"), F.col("b.input")).alias("request"),
    )


_ORDERED = "rid bigint, session_id string, us bigint, tool string, use_id string, request binary, same boolean"


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over a sorted partition: drop repeated deliveries, number the rows, compare each with the one before.

    ``same`` is null for the partition's first row, whose predecessor lies in another partition.
    """
    from pyspark import TaskContext

    rid = TaskContext.get().partitionId() << 33
    names = ("session_id", "us", "uuid", "pos", "tool", "use_id", "request")
    last: dict[str, pa.Array] | None = None  # the row before the batch
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = {c: batch.column(batch.schema.get_field_index(c)) for c in names}
        before = {c: pa.concat_arrays([last[c] if last else pa.nulls(1, v.type), v.slice(0, n - 1)]) for c, v in col.items()}
        equal = {c: pc.fill_null(pc.equal(col[c], before[c]), False).to_numpy(zero_copy_only=False) for c in ("session_id", "us", "uuid", "pos", "request")}
        null = lambda c: pc.and_(pc.is_null(col[c]), pc.is_null(before[c])).to_numpy(zero_copy_only=False)  # noqa: E731, B023
        again = (equal["session_id"] | null("session_id")) & (equal["us"] | null("us")) & equal["uuid"] & equal["pos"]
        same = equal["session_id"] & equal["request"] & pc.is_valid(col["us"]).to_numpy(zero_copy_only=False) & pc.is_valid(before["us"]).to_numpy(zero_copy_only=False)
        keep = np.flatnonzero(~again)
        first = last is None
        last = {c: v.slice(n - 1) for c, v in col.items()}
        if not len(keep):
            continue
        # a row after a repeated delivery is compared with that delivery, which is the same call
        unknown = np.zeros(len(keep), bool)
        unknown[0] = first
        take = pa.array(keep)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rid + np.arange(len(keep)), pa.int64()), *(col[c].take(take) for c in ("session_id", "us", "tool", "use_id", "request")), pa.array(same[keep], pa.bool_(), mask=unknown)],
            names=["rid", "session_id", "us", "tool", "use_id", "request", "same"],
        )
        rid += len(keep)


def link_predecessors(calls: DataFrame) -> DataFrame:
    """Rows numbered in sequence order with ``ptr``: the predecessor if it asks for the same work, else the row itself."""
    # the range sort reads its input twice, to sample it first; so it reads a narrow table
    calls = stage(calls, "requests")
    ordered = stage(sorted_map(calls, ["session_id", "us", "uuid", "pos"], _link, _ORDERED), "calls")
    part = F.shiftright("rid", 33)
    # one row per partition, so its size is bounded by the number of partitions
    edges = (
        ordered.groupBy(part.alias("part"))
        .agg(
            F.min("rid").alias("lo"),
            F.max("rid").alias("hi"),
            *(
                f(F.struct("session_id", "request", "us"), F.col("rid")).alias(n)
                for f, n in ((F.min_by, "first"), (F.max_by, "last"))
            ),
        )
        .orderBy("part")
        .collect()
    )
    joined = {
        b.lo: a.hi
        for a, b in zip(edges, edges[1:])
        if b.first.session_id is not None
        and None not in (a.last.us, b.first.us)
        and (a.last.session_id, a.last.request) == (b.first.session_id, b.first.request)
    }
    across = calls.sparkSession.createDataFrame(list(joined.items()) or [(-1, -1)], "rid bigint, across bigint")
    return ordered.join(F.broadcast(across), "rid", "left").withColumn(
        "ptr", F.when(F.col("same"), F.col("rid") - 1).otherwise(F.coalesce("across", "rid"))
    ).drop("across", "same")


def resolve_pointers(members: DataFrame) -> DataFrame:
    """Pointer doubling over (rid, ptr), the rows that point to another; ptr ends at a row that is no member."""
    table = stage(members.select("rid", "ptr"), "pointers")
    while True:
        target = table.select(F.col("rid").alias("at"), F.col("ptr").alias("next"))
        moved = Observation()  # counted by the job that writes the pointers
        step = table.join(target, F.col("ptr") == F.col("at"), "left").observe(moved, F.count("next").alias("n"))
        table = stage(step.select("rid", F.coalesce("next", "ptr").alias("ptr")), "pointers")
        if not moved.get["n"]:
            return table


def collapse_runs(messages: DataFrame, attempt_field: str = ATTEMPT_FIELD) -> DataFrame:
    """One row per run of consecutive tool calls that ask for the same work; a single call is a run of one.

    ``attempt_field``: a pattern for the names of request fields that do not matter.
    """
    linked = link_predecessors(tool_calls(messages, attempt_field))
    roots = resolve_pointers(linked.where("ptr <> rid"))
    rooted = linked.drop("ptr").join(roots, "rid", "left").withColumn("root", F.coalesce("ptr", "rid"))
    return (
        rooted.groupBy("root")
        .agg(
            F.first("session_id").alias("session_id"),
            F.first("tool").alias("tool"),
            F.count("*").alias("n_calls"),
            F.min("us").alias("first_us"),
            F.max("us").alias("last_us"),
            F.min_by("use_id", "rid").alias("first_use_id"),
            F.max_by("use_id", "rid").alias("last_use_id"),
        )
        .select(
            "session_id",
            "tool",
            "n_calls",
            F.timestamp_micros("first_us").alias("first_ts"),
            F.timestamp_micros("last_us").alias("last_ts"),
            ((F.col("last_us") - F.col("first_us")) / 1e6).alias("duration_s"),
            "first_use_id",
            "last_use_id",
        )
    )
