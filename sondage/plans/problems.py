"""Queries of the general data-preparation problems, with their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyarrow import parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, features, shredding
from .staging import stage


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return shredding.link_results(_t(spark, d, "session_messages"))


def p2_tables(spark: SparkSession, d: str) -> DataFrame:
    """The flat tables in one pass: which table a row belongs to, its links and its values."""
    blocks = shredding.distinct_blocks(shredding.flatten_blocks(_t(spark, d, "session_messages")))
    kind = F.col("block_type")
    table = F.when(kind == "tool_use", "calls").when(kind == "tool_result", "results").when(kind.isin("text", "thinking"), "texts").otherwise("other")
    return blocks.select(
        table.alias("table_name"), "session_id", "uuid", "path", "parent_path", "depth",
        F.coalesce("block_id", "block_tool_use_id").alias("use_id"), F.col("block_name").alias("name"), F.col("block_is_error").alias("is_error"),
        F.coalesce("block_text", "block_thinking", "block_input", "block_content").alias("value"),
    )


def p2_messages(spark: SparkSession, d: str) -> DataFrame:
    return shredding.message_table(_t(spark, d, "session_messages"))


def p2_calls(spark: SparkSession, d: str) -> DataFrame:
    return shredding.call_table(_t(spark, d, "session_messages"))


def p2_results(spark: SparkSession, d: str) -> DataFrame:
    return shredding.result_table(_t(spark, d, "session_messages"))


def p2_texts(spark: SparkSession, d: str) -> DataFrame:
    return shredding.text_table(_t(spark, d, "session_messages"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    schemas = drift.file_schemas(_t(spark, d, "session_files"), _t(spark, d, "session_lines"))
    return drift.schema_changes(schemas).select("series_id", "file_seq", "change_kind", "old_path", "new_path")


def p3_versions(spark: SparkSession, d: str) -> DataFrame:
    schemas = stage(drift.file_schemas(_t(spark, d, "session_files"), _t(spark, d, "session_lines")), "schemas")
    return drift.schema_versions(schemas, stage(drift.schema_changes(schemas), "changes"))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent_records(_t(spark, d, "session_files"), _t(spark, d, "session_lines"))


def p4_features(spark: SparkSession, d: str) -> DataFrame:
    return features.feature_table(_t(spark, d, "sessions"), _t(spark, d, "session_messages"), _t(spark, d, "tool_catalog"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


_BLOCKS = """
with recursive raw as (select distinct on (uuid) * from session_messages where uuid is not null),
blocks as (
  select session_id, uuid, unnest(message.content) as b, generate_subscripts(message.content, 1) - 1 as pos from raw
),
arrays(session_id, uuid, prefix, arr) as (
  select session_id, uuid, pos::varchar, try_cast(b.content as json) from blocks where b.type = 'tool_result' and try_cast(b.content as json) is not null and json_type(try_cast(b.content as json)) = 'ARRAY'
  union all
  select session_id, uuid, prefix || '/' || i, inner_array from (
    select session_id, uuid, prefix, i, case json_type(e, '$.content') when 'ARRAY' then json_extract(e, '$.content') when 'VARCHAR' then try_cast(json_extract_string(e, '$.content') as json) end as inner_array
    from (select session_id, uuid, prefix, i, json_extract(arr, '$[' || i || ']') as e from (select *, unnest(range(0, json_array_length(arr)::bigint)) as i from arrays))
    where json_extract_string(e, '$.type') = 'tool_result'
  ) where inner_array is not null and json_type(inner_array) = 'ARRAY'
),
inside as (
  select session_id, uuid, prefix, prefix || '/' || i as path, e, json_extract_string(e, '$.type') as type, json_extract_string(e, '$.id') as id, json_extract_string(e, '$.tool_use_id') as use_id
  from (select session_id, uuid, prefix, i, json_extract(arr, '$[' || i || ']') as e from (select *, unnest(range(0, json_array_length(arr)::bigint)) as i from arrays))
),
calls as (select session_id, b.id as id, min((uuid, pos::varchar)) as c from blocks where b.type = 'tool_use' group by all),
flat as (
  select session_id, uuid, pos::varchar as path, '' as parent_path, 1 as depth, b.type as type, b.id as id, b.tool_use_id as use_id, b.name as name, b.input as input, b.text as text, b.thinking as thinking, b.content as content, b.is_error as is_error from blocks
  union all
  select session_id, uuid, path, prefix, 1 + len(path) - len(replace(path, '/', '')), type, id, use_id, e->>'$.name', e->>'$.input', e->>'$.text', e->>'$.thinking', e->>'$.content', try_cast(e->>'$.is_error' as boolean) from inside
),
linked as (
  select b.session_id, c[1] as use_uuid, c[2] as use_path, b.uuid as result_uuid, b.pos::varchar as result_path
  from blocks b join calls on b.session_id = calls.session_id and b.b.tool_use_id = calls.id where b.b.type = 'tool_result'
  union
  select r.session_id, r.uuid, min(u.path), r.uuid, r.path from inside r join inside u on r.uuid = u.uuid and r.prefix = u.prefix and r.use_id = u.id
  where r.type = 'tool_result' and u.type = 'tool_use' group by r.session_id, r.uuid, r.path
)
"""
_P2 = {
    "p2_found": _BLOCKS + "select * from linked",
    "p2_messages": "select distinct on (uuid) session_id, uuid, parent_uuid, record_type, ts, cwd, message.role as role, len(message.content)::int as n_blocks from session_messages where uuid is not null",
    "p2_calls": _BLOCKS + "select session_id, uuid, path, parent_path, depth::int as depth, id as use_id, name, input from flat where type = 'tool_use'",
    "p2_texts": _BLOCKS + "select session_id, uuid, path, parent_path, depth::int as depth, type as kind, coalesce(text, thinking) as text from flat where type in ('text', 'thinking')",
    "p2_results": _BLOCKS
    + "select f.session_id, uuid, path, parent_path, depth::int as depth, use_id, is_error, content, use_uuid as call_uuid, use_path as call_path"
    " from flat f left join linked l on f.uuid = l.result_uuid and f.path = l.result_path where type = 'tool_result'",
}


_P3 = """
with files as (select file_id, series_id, file_seq::bigint as file_seq from session_files where series_id is not null and file_seq is not null),
seqs as (select distinct series_id, file_seq from files),
records as (
  select f.series_id, f.file_seq, try_cast(l.raw_line as json) as j from session_lines l join files f using (file_id)
  where trim(l.raw_line) like '{%' and json_valid(l.raw_line)
),
seen as (
  select distinct series_id, file_seq, regexp_replace(regexp_replace(t.fullkey, '\\[\\d+\\]', '[]', 'g'), '^\\$\\.?', '') as path,
    case t.type when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' else 'number' end as kind
  from records, json_tree(records.j) t where t.type <> 'NULL' and t.fullkey <> '$'
),
paths as (select series_id, file_seq, path, string_agg(kind, ',' order by kind) as types from seen group by all),
steps as (select series_id, file_seq, lag(file_seq) over (partition by series_id order by file_seq) as before from seqs),
pairs as (
  select s.series_id, s.file_seq, coalesce(o.path, n.path) as path, o.types as old_types, n.types as new_types
  from (select s.series_id, s.file_seq, p.path, p.types from steps s join paths p on p.series_id = s.series_id and p.file_seq = s.before) o
  full join (select s.series_id, s.file_seq, p.path, p.types from steps s join paths p on p.series_id = s.series_id and p.file_seq = s.file_seq where s.before is not null) n
    on o.series_id = n.series_id and o.file_seq = n.file_seq and o.path = n.path
  join steps s on s.series_id = coalesce(o.series_id, n.series_id) and s.file_seq = coalesce(o.file_seq, n.file_seq)
  where o.types is distinct from n.types
),
top as (
  select * from pairs a where not exists (
    select 1 from pairs b where a.series_id = b.series_id and a.file_seq = b.file_seq and (starts_with(a.path, b.path || '.') or starts_with(a.path, b.path || '['))
  )
),
placed as (
  select *, coalesce(old_types, new_types) as types, case when path like '%[]' then left(path, -2) else coalesce(regexp_extract(path, '^(.*)\\.[^.]*$', 1), '') end as parent,
    row_number() over (partition by series_id, file_seq, case when path like '%[]' then left(path, -2) else regexp_extract(path, '^(.*)\\.[^.]*$', 1) end, coalesce(old_types, new_types), old_types is null, new_types is null order by path) as k
  from top
),
renamed as (
  select o.series_id, o.file_seq, o.path as old_path, n.path as new_path from placed o join placed n
    on o.series_id = n.series_id and o.file_seq = n.file_seq and o.parent = n.parent and o.types = n.types and o.k = n.k and o.new_types is null and n.old_types is null
)
select series_id, file_seq, 'renamed' as change_kind, old_path, new_path from renamed
union all
select series_id, file_seq, case when old_types is null then 'added' when new_types is null then 'removed' else 'retyped' end,
  case when old_types is null then '' else path end, case when new_types is null then '' else path end
from placed p where (old_types is not null and new_types is not null)
  or (old_types is null and not exists (select 1 from renamed r where r.series_id = p.series_id and r.file_seq = p.file_seq and r.new_path = p.path))
  or (new_types is null and not exists (select 1 from renamed r where r.series_id = p.series_id and r.file_seq = p.file_seq and r.old_path = p.path))"""


def oracle_sql() -> dict[str, str]:
    sql = {**_P2, "p3_found": _P3}
    # the SQL of a wide table names its columns: the event types are those of the test tables, where they are there
    catalog = os.path.join(os.environ.get("SONDAGE_TEST_DATA", "/root/testdata/sf0.001"), "tool_catalog.parquet")
    if os.path.exists(catalog):
        sql["p4_features"] = features.feature_sql([t for t in parquet.read_table(catalog)["tool_name"].to_pylist() if t is not None])
    return sql
