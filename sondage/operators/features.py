"""One row per entity with counts, recency and totals for each of hundreds of event types.

Events are first reduced to (entity, type) with map-side combination, so an
entity with any share of the rows sends at most one row per type and task. The
event types are cut into blocks; each block is aggregated by entity, and the
blocks, all partitioned alike by entity, are joined onto the complete entity
table without a further shuffle of the blocks.

Defined results: entities without events get zeros and null recency; events of
an unknown entity or an unlisted type are left out of the blocks (totals count
the listed types); failed results without a call count nowhere; a repeated
delivery counts once; a null ``is_error`` is no failure; empty tables give the
entity table with zeros.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.instants import instant_micros
from ..functions.transcripts import clean_tool
from ..plans.staging import stage


def column_names(types: Sequence[str]) -> dict[str, str]:
    """A column-safe, unique spelling for each event type."""
    out: dict[str, str] = {}
    for t in types:
        base = name = re.sub(r"\W", "_", t)
        n = 2
        while name.lower() in {x.lower() for x in out.values()}:
            name, n = f"{base}_{n}", n + 1
        out[t] = name
    return out


def tool_events(messages: DataFrame) -> DataFrame:
    """Distinct calls of tools with the number of failed results: session_id, tool, us, failed."""
    blocks = messages.where("session_id is not null and message.content is not null").select(
        "session_id", "uuid", instant_micros(F.col("ts")).alias("us"), F.posexplode("message.content").alias("pos", "b")
    )
    # calls and failed results travel on their common key in one shuffle
    met = blocks.where("b.type = 'tool_use' or (b.type = 'tool_result' and b.is_error)").select(
        "session_id",
        F.when(F.col("b.type") == "tool_use", F.col("b.id")).otherwise(F.col("b.tool_use_id")).alias("id"),
        F.when(F.col("b.type") == "tool_use", F.coalesce(clean_tool(F.col("b.name")), F.lit(""))).alias("tool"),
        "us",
        "uuid",
        "pos",
    )
    # a call without id is a call of its own; a result without id answers none
    own = F.coalesce("id", F.when(F.col("tool").isNotNull(), F.concat_ws("|", F.lit(""), "uuid", "pos")))
    met = met.withColumn("id", own).where("id is not null").repartition("session_id", "id").dropDuplicates(["session_id", "id", "uuid", "pos"])
    one = met.groupBy("session_id", "id").agg(
        F.min("tool").alias("tool"),
        F.count("tool").alias("calls"),
        F.count_if(F.col("tool").isNull()).alias("failed"),
        F.max(F.when(F.col("tool").isNotNull(), F.col("us"))).alias("us"),
    )
    return one.where("tool is not null")


def feature_table(
    entities: DataFrame,
    messages: DataFrame,
    types: DataFrame,
    block_size: int = 34,
) -> DataFrame:
    """The wide table: session_id, total_calls, total_failed, n_tools, since_last_s and per tool *_calls, *_failed, *_since_s.

    ``types`` (tool_name) is the list of event types; it names the columns, so it is read on the driver and
    must be a short list (checked: at most 2,000).
    """
    names = [r.tool_name for r in types.select("tool_name").where("tool_name is not null").distinct().orderBy("tool_name").limit(2001).collect()]
    if len(names) > 2000:
        raise ValueError("too many event types for a wide table")
    columns = column_names(names)
    newest = messages.agg(F.max(instant_micros(F.col("ts"))).alias("newest_us"))  # one row
    newest_us = newest.first().newest_us
    per_tool = (
        tool_events(messages)
        .groupBy("session_id", "tool")
        .agg(F.sum("calls").alias("calls"), F.sum("failed").alias("failed"), F.max("us").alias("us"))
    )
    listed = messages.sparkSession.createDataFrame([(n.strip().lower(), i) for i, n in enumerate(names)] or [(None, -1)], "tool string, i int")
    per_tool = stage(per_tool.join(F.broadcast(listed), "tool").select("session_id", "i", "calls", "failed", "us"), "per_tool")
    # one exchange, which the totals and all blocks read
    per_tool = per_tool.repartition("session_id")
    wide = entities.select("session_id").where("session_id is not null").dropDuplicates(["session_id"])
    totals = per_tool.groupBy("session_id").agg(
        F.sum("calls").alias("total_calls"), F.sum("failed").alias("total_failed"), F.count("*").alias("n_tools"), F.max("us").alias("last_us")
    )
    wide = wide.join(totals, "session_id", "left")
    for lo in range(0, len(names), block_size):
        block = names[lo : lo + block_size]
        # an entity's entry of a block: one small array, as long as the block
        entry = per_tool.where((F.col("i") >= lo) & (F.col("i") < lo + len(block))).groupBy("session_id").agg(
            F.map_from_entries(F.collect_list(F.struct("i", F.struct("calls", "failed", "us")))).alias(f"block_{lo}")
        )
        wide = wide.join(entry, "session_id", "left")
    since = f"({newest_us if newest_us is not None else 'null'}L - %s) / 1e6D as `%s`".replace("nullL", "cast(null as bigint)")
    out = ["session_id", *(f"coalesce({c}, 0L) as {c}" for c in ("total_calls", "total_failed", "n_tools")), since % ("last_us", "since_last_s")]
    for i, n in enumerate(names):
        cell = f"block_{i // block_size * block_size}[{i}]"
        out += [
            f"coalesce({cell}.calls, 0L) as `{columns[n]}_calls`",
            f"coalesce({cell}.failed, 0L) as `{columns[n]}_failed`",
            since % (f"{cell}.us", f"{columns[n]}_since_s"),
        ]
    return wide.selectExpr(*out)


#: What a call, a failed result and an instant are, in SQL.
_SQL = """
with raw as (select distinct on (uuid) uuid, session_id, trim(ts) as ts, message from session_messages),
m as (
  select uuid, session_id, message,
    case when regexp_matches(ts, '^[0-9]+$') then cast(ts as bigint) * 1000
      when regexp_matches(ts, '(Z|[+-][0-9]{2}:[0-9]{2})$') then epoch_us(cast(replace(ts, 'Z', '+00:00') as timestamptz))
      else epoch_us(cast(ts || '+00:00' as timestamptz)) end as us
  from raw
),
b as (
  select session_id, uuid, us, unnest(message.content) as b from m
),
calls as (select session_id, b.id as id, coalesce(lower(trim(b.name)), '') as tool, us from b where b.type = 'tool_use'),
fails as (
  select session_id, b.tool_use_id as id, count(*) as failed from b
  where b.type = 'tool_result' and b.is_error group by all
),
per_tool as (
  select calls.session_id, tool_name, count(*) as calls, coalesce(sum(failed), 0)::bigint as failed, max(us) as us
  from calls join tool_catalog on tool = lower(trim(tool_name))
  left join fails on calls.session_id = fails.session_id and calls.id = fails.id
  group by all
),
totals as (
  select s.session_id, coalesce(sum(calls), 0)::bigint as total_calls, coalesce(sum(failed), 0)::bigint as total_failed,
    count(tool_name)::bigint as n_tools, ((select max(us) from m) - max(us)) / 1e6::double as since_last_s
  from sessions s left join per_tool p on s.session_id = p.session_id group by s.session_id
)"""


def feature_sql(types: Sequence[str]) -> str:
    """The same table in SQL, for a given list of event types."""
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    cells = []
    for t, c in column_names(sorted(types)).items():
        of = f"filter (tool_name = {quoted(t)})"
        cells.append(f'coalesce(max(calls) {of}, 0)::bigint as "{c}_calls", coalesce(max(failed) {of}, 0)::bigint as "{c}_failed", ((select max(us) from m) - max(us) {of}) / 1e6::double as "{c}_since_s"')
    wide = ",\n  ".join(["s.session_id", *cells])
    return f"{_SQL}, wide as (select {wide}\nfrom sessions s left join per_tool p on s.session_id = p.session_id group by s.session_id)\nselect * from wide join totals using (session_id)"
