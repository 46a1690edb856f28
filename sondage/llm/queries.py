"""Queries of the problems that concern text and conversations, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, leakage, packing, personal, runs, truncation


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = runs.collapse_runs(_t(spark, d, "session_messages"))
    return found.where("n_calls >= 2").select("session_id", "first_use_id", "last_use_id")


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapse_runs(_t(spark, d, "session_messages"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = personal.find_personal(_t(spark, d, "session_messages"))
    return found.select("uuid", "block_no", "field_name", "kind", "start_pos")


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redact(_t(spark, d, "session_messages"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.dropped_sessions(_t(spark, d, "session_messages"))


def p6_conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversations.rebuild_conversations(_t(spark, d, "session_messages"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_t(spark, d, "documents"), _t(spark, d, "pack_targets"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_packed(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(_t(spark, d, "documents"), _t(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_documents(_t(spark, d, "documents"))


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.source_report(_t(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


_ROLE = (
    "case when lower(trim({c})) in ('user', 'human') then 'user' when lower(trim({c})) in ('assistant', 'model', 'ai', 'bot') then 'assistant'"
    " when lower(trim({c})) in ('system', 'developer') then 'system' end"
)
_INSTANT = """case when regexp_matches(trim(ts), '^[0-9]+$') then cast(trim(ts) as bigint) * 1000
      when regexp_matches(trim(ts), '(Z|[+-][0-9]{2}:[0-9]{2})$') then epoch_us(cast(replace(trim(ts), 'Z', '+00:00') as timestamptz))
      else epoch_us(cast(trim(ts) || '+00:00' as timestamptz)) end"""

_P6 = f"""
with m as (
  select session_id, uuid, parent_uuid, message is null as gone, {_INSTANT} as us, coalesce({_ROLE.format(c="message.role")}, {_ROLE.format(c="record_type")}) as role,
    coalesce(len(list_filter(message.content, lambda b: b.type = 'text' and b.text is not null and regexp_matches(b.text, '[^\\s\\p{{Z}}\\p{{C}}]'))) > 0, false) as told
  from (select distinct on (uuid) * from session_messages) where session_id is not null
),
s as (select *, told and role in ('user', 'assistant') as seen from m),
broken as (
  select session_id from s group by session_id having bool_or(gone) or count(*) filter (parent_uuid is null) <> 1
  union select a.session_id from s a left join s b on a.session_id = b.session_id and a.parent_uuid = b.uuid where a.parent_uuid is not null and b.uuid is null
),
silent as (select session_id from s group by session_id having not coalesce(bool_or(seen), false)),
unanswered as (
  select session_id from (select session_id, role, lead(role) over (partition by session_id order by us, uuid) as following from s where seen)
  where role = 'user' and coalesce(following, 'user') = 'user'
)
select session_id, reason from (
  select distinct session_id, case when session_id in (select session_id from broken) then 'broken' when session_id in (select session_id from silent) then 'empty'
    when session_id in (select session_id from unanswered) then 'no_reply' end as reason from s
) where reason is not null"""


def oracle_sql() -> dict[str, str]:
    return {"p6_found": _P6}
