"""Queries over transcripts, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sessions as S

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

_ROLE = "case when lower(trim({c})) in ('user', 'human') then 'user' when lower(trim({c})) in ('assistant', 'model', 'ai', 'bot') then 'assistant' when lower(trim({c})) in ('system', 'developer') then 'system' end"
_T = f"""
with raw as (select distinct on (uuid) uuid, parent_uuid, session_id, cwd, trim(ts) as ts, message, coalesce({_ROLE.format(c="message.role")}, {_ROLE.format(c="record_type")}) as role from session_messages where session_id is not null and uuid is not null),
timed as (
  select uuid, parent_uuid, session_id, cwd, role, message.content as content,
    case when regexp_matches(ts, '^[0-9]+$') then cast(ts as bigint) * 1000
      when regexp_matches(ts, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') then epoch_us(cast(replace(ts, 'Z', '+00:00') as timestamptz))
      else epoch_us(cast(ts || '+00:00' as timestamptz)) end as us
  from raw
),
t as (select *, row_number() over (partition by session_id order by us, uuid) - 1 as message_index from timed),
b as (select session_id, message_index, us, role, unnest(content) as b, generate_subscripts(content, 1) - 1 as block_no from t),
said as (select session_id, message_index, us, uuid, role, array_to_string(list_transform(list_filter(content, lambda x: x.type = 'text' and length(x.text) > 0), lambda x: x.text), E'\\n\\n') as text from t),
prompt as (
  select session_id, message_index from t where role = 'user' and len(list_filter(content, lambda x: x.type = 'text')) > 0 and len(list_filter(content, lambda x: x.type = 'tool_result')) = 0
    and not coalesce(regexp_matches(list_filter(content, lambda x: x.type = 'text')[1].text, '^\\s*<(task-notification|local-command-caveat|local-command-stdout|local-command-stderr|command-name|command-message|bash-input)>'), false)
),
results as (
  select session_id, message_index, block_no, us, b.tool_use_id as use_id, b.content as result,
    case when coalesce(b.is_error, false) then 'is_error_flag' when ltrim(regexp_extract(coalesce(b.content, ''), '(?i)exit code (\\d+)', 1), '0') <> '' then 'exit_code'
      when regexp_matches(coalesce(b.content, ''), '(?im)^\\s*(?:traceback|exception|error:|fatal:|panic:)') then 'pattern_match' end as error_type
  from b where b.type = 'tool_result'
),
calls as (select session_id, message_index, block_no, us, b.id as use_id, lower(trim(b.name)) as tool, b.input as input from b where b.type = 'tool_use')
"""


def _q(sql: str):
    def register(f):
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = _T + sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, d: str) -> DataFrame:
    return S.turns(spark.read.parquet(f"{d}/session_messages.parquet"))


@_q("select session_id, message_index, text from said where (session_id, message_index) in (select (session_id, message_index) from prompt)")
def q_session_prompts(spark, d):
    return S.prompts(_t(spark, d)).select("session_id", "message_index", "text")


@_q("select session_id, message_index, row_number() over (partition by session_id order by message_index) as turn, text, length(text)::int as chars from said where role = 'assistant' and text <> ''")
def q_session_narrative(spark, d):
    return S.narrative(_t(spark, d)).select("session_id", "message_index", "turn", "text", "chars")


@_q("select session_id, message_index, block_no::int as block_no, substring(b.thinking, 1, 100) as preview, length(b.thinking) // 4 as tokens from b where b.type = 'thinking' and length(b.thinking) > 0")
def q_session_thinking(spark, d):
    return S.thinking(_t(spark, d)).select("session_id", "message_index", "block_no", "preview", "tokens")


@_q("select session_id, uuid, role from t where message_index = 3")
def q_session_message(spark, d):
    return S.message(_t(spark, d), 3).select("session_id", "uuid", "role")


@_q("select session_id, uuid from (select *, max(message_index) over (partition by session_id) as last from t) where message_index = last - 1")
def q_session_message_from_end(spark, d):
    return S.message(_t(spark, d), -2).select("session_id", "uuid")


@_q("select session_id, turn, uuid from (select *, row_number() over (partition by session_id order by message_index) as turn from t where role in ('user', 'assistant')) where turn between 2 and 5")
def q_session_range(spark, d):
    return S.conversation(_t(spark, d), 2, 5).select("session_id", "turn", "uuid")


@_q("""select session_id, tool, count(*) as n, count(*) filter (error_type is not null) as failed, floor(count(*) filter (error_type is null) * 1000 / count(*) + 0.5) / 10 as rate
from calls join results using (session_id, use_id) group by all""")
def q_session_tools(spark, d):
    return S.tools(_t(spark, d))


@_q("""select r.session_id, r.message_index, r.block_no::int as block_no, r.use_id, r.error_type, substring(r.result, 1, 300) as preview, arg_max(c.tool, (c.message_index, c.block_no)) as tool, max(c.message_index) as call_index
from results r left join calls c on r.session_id = c.session_id and r.use_id = c.use_id and c.message_index < r.message_index and c.message_index > greatest(0, r.message_index - 10)
where r.error_type is not null group by all""")
def q_session_errors(spark, d):
    return S.errors(_t(spark, d)).select("session_id", "message_index", "block_no", "use_id", "error_type", "preview", "tool", "call_index")


_STEPS = """, details as (
  select *, case tool when 'bash' then coalesce(nullif(input->>'$.description', ''), input->>'$.command') when 'read' then input->>'$.file_path' when 'write' then input->>'$.file_path' when 'edit' then input->>'$.file_path'
    when 'grep' then concat('''', coalesce(input->>'$.pattern', 'None'), ''' in ', coalesce(input->>'$.path', '.')) when 'glob' then input->>'$.pattern'
    when 'task' then substring(coalesce(nullif(input->>'$.description', ''), input->>'$.prompt'), 1, 200) end as detail from calls
),
outcomes as (select session_id, use_id, arg_max(coalesce(error_type, ''), (message_index, block_no)) as r from results where use_id is not null group by all),
steps as (select d.*, case when r = '' then 'success' when r is not null then 'error' end as outcome from details d left join outcomes o on d.session_id = o.session_id and d.use_id = o.use_id),
lagged as (select *, case when row_number() over w > 1 and tool is not distinct from lag(tool) over w and detail is not distinct from lag(detail) over w then 0 else 1 end as fresh from steps window w as (partition by session_id order by message_index, block_no)),
runs as (select *, sum(fresh) over (partition by session_id order by message_index, block_no rows unbounded preceding)::bigint as step from lagged)
"""


@_q(_STEPS + "select session_id, step, arg_min(tool, (message_index, block_no)) as tool, min(message_index) as message_index, count(*) as run_count from runs group by all")
def q_session_workflow(spark, d):
    return S.workflow(_t(spark, d)).select("session_id", "step", "tool", "message_index", "run_count")


@_q(_STEPS + "select session_id, message_index, block_no::int as block_no, tool, detail, outcome from steps")
def q_session_steps(spark, d):
    return S.steps(_t(spark, d)).select("session_id", "message_index", "block_no", "tool", "detail", "outcome")


@_q("""select session_id, event_type, count(*) as n, min(message_index) as first_index, sum(length(preview))::bigint as chars from (
  select session_id, message_index, case when b.type = 'tool_result' then 'tool_result' when role = 'assistant' and b.type = 'tool_use' then 'tool_call' when role = 'assistant' and b.type = 'thinking' then 'thinking'
    when role = 'assistant' and b.type = 'text' and length(b.text) > 0 then 'assistant_message' end as event_type,
    substring(case b.type when 'text' then b.text when 'thinking' then b.thinking when 'tool_result' then b.content end, 1, 100) as preview from b where role in ('user', 'assistant')
  union all
  select session_id, message_index, 'user_message', substring(array_to_string(list_transform(list_filter(content, lambda x: x.type = 'text' and length(x.text) > 0), lambda x: x.text), ' '), 1, 100)
  from t where role = 'user' and len(list_filter(content, lambda x: x.type = 'text' and length(x.text) > 0)) > 0
) where event_type is not null group by all""")
def q_session_timeline(spark, d):
    return S.timeline(_t(spark, d)).groupBy("session_id", "event_type").agg(F.count("*").alias("n"), F.min("message_index").alias("first_index"), F.sum(F.length("preview")).alias("chars"))


@_q("""select session_id, message_index, cwd as value, previous from (select session_id, message_index, cwd, lag(cwd) over (partition by session_id order by message_index) as previous from t where cwd is not null and cwd <> '')
where cwd is distinct from previous""")
def q_session_context(spark, d):
    return S.context(_t(spark, d)).select("session_id", "message_index", "value", "previous")


@_q(""", x as (select s.*, p.message_index is not null as is_prompt from said s left join prompt p on s.session_id = p.session_id and s.message_index = p.message_index),
y as (select *, sum(is_prompt::int) over (partition by session_id order by message_index rows unbounded preceding)::bigint as exchange from x)
select session_id, exchange, min(message_index) as message_index, max(text) filter (is_prompt) as prompt, arg_max(text, message_index) filter (role = 'assistant' and text <> '') as answer,
  max(message_index) filter (role = 'assistant' and text <> '') as answer_index from y where exchange > 0 group by all""")
def q_session_exchanges(spark, d):
    return S.exchanges(_t(spark, d))


@_q("select session_id, tool, coalesce(input->>'$.file_path', input->>'$.notebook_path') as file, count(*) as n, min(message_index) as first_index from calls where coalesce(input->>'$.file_path', input->>'$.notebook_path') is not null group by all")
def q_session_files(spark, d):
    return S.files(_t(spark, d))


@_q("""select t.session_id, count(*) as n_messages, count(*) filter (t.role = 'user') as n_user, count(*) filter (t.role = 'assistant') as n_assistant, count(p.message_index) as n_prompts,
  sum(coalesce(len(list_filter(t.content, lambda x: x.type = 'tool_use')), 0))::bigint as n_calls, sum(coalesce(len(list_filter(t.content, lambda x: x.type = 'thinking')), 0))::bigint as n_thinking,
  (max(t.us) - min(t.us)) / 1e6 as duration_s, arg_max(substring(s.text, 1, 200), t.message_index) filter (t.role = 'assistant' and s.text <> '') as last_said, coalesce(any_value(e.n), 0) as n_errors
from t left join prompt p on t.session_id = p.session_id and t.message_index = p.message_index left join said s on t.session_id = s.session_id and t.message_index = s.message_index
left join (select session_id, count(*) filter (error_type is not null) as n from results group by 1) e on t.session_id = e.session_id group by t.session_id""")
def q_session_summary(spark, d):
    return S.summary(_t(spark, d))


@_q("""select session_id, message_index, 'prompt' as section, text from said where (session_id, message_index) in (select (session_id, message_index) from prompt)
union all select session_id, message_index, 'narrative', text from said where role = 'assistant' and text <> ''""")
def q_session_digest(spark, d):
    return S.digest(_t(spark, d))


_BLOCK_TEXT = "case b.type when 'text' then b.text when 'thinking' then b.thinking when 'tool_use' then b.input when 'tool_result' then b.content end"


@_q(f"""select session_id, message_index, block_no::int as block_no, b.type as block_type from b where regexp_matches(lower({_BLOCK_TEXT}), '\\bscheduler\\b')""")
def q_session_search_word(spark, d):
    return S.search(_t(spark, d), "Scheduler", word=True).select("session_id", "message_index", "block_no", "block_type")


@_q(f"""select session_id, count(*) as hits, arg_min(case when a > 1 then '...' else '' end || trim(substring(x, a, z - a + 1)) || case when z < length(x) then '...' else '' end, (message_index, block_no)) as excerpt from (
  select *, greatest(1, p - 40) as a, least(length(x), p - 1 + 9 + 80) as z from (select session_id, message_index, block_no, {_BLOCK_TEXT} as x, position('scheduler' in lower({_BLOCK_TEXT})) as p from b) where p > 0
) group by session_id""")
def q_session_search_all(spark, d):
    return S.search_sessions(_t(spark, d), "scheduler").select("session_id", "hits", "excerpt")


@_q("""select s.session_id, s.project, s.title, coalesce(n, 0) as n_messages from sessions s join (select session_id, count(*) as n, max(us) as ended from t group by 1) m on s.session_id = m.session_id
where cast(make_timestamp(ended) as date) between date '2023-02-01' and date '2023-12-31' and (contains(lower(coalesce(s.title, '')), 'an') or contains(lower(s.session_id), 'an') or contains(lower(coalesce(s.project, '')), 'an'))""")
def q_session_list(spark, d):
    return S.listing(spark.read.parquet(f"{d}/sessions.parquet"), _t(spark, d), "an", "2023-02-01", "2023-12-31").select("session_id", "project", "title", "n_messages")


@_q(f"""select session_id, uuid from t where (session_id, message_index) in (select (session_id, message_index) from results where error_type is not null)
and (session_id, message_index) in (select (session_id, message_index) from b where contains(lower({_BLOCK_TEXT}), 'e'))""")
def q_session_composite(spark, d):
    return S.composite(_t(spark, d), errors_only=True, contains="e").select("session_id", "uuid")


@_q("""select c.session_id, c.message_index, c.use_id, r.message_index as result_index, r.error_type, length(r.result)::int as result_chars
from calls c left join results r on c.session_id = r.session_id and c.use_id = r.use_id where c.tool in ('agent', 'task')""")
def q_session_agents(spark, d):
    return S.agents(_t(spark, d)).select("session_id", "message_index", "use_id", "result_index", "error_type", "result_chars")


@_q("""select session_id, message_index, sum(length(coalesce(text, '')) + 10) over (partition by session_id order by message_index rows unbounded preceding)::bigint as cumulative_input from said where role = 'assistant'""")
def q_session_tokens(spark, d):
    """Sizes of texts in place of token counts, which the test tables lack."""
    t = S.by_role(_t(spark, d), "assistant").select("session_id", "message_index", F.length(S.said()).alias("input"), F.lit(0).alias("output"), F.lit(10).alias("cache_read"), F.lit(None).cast("int").alias("cache_created"))
    return S.tokens(t).select("session_id", "message_index", "cumulative_input")


@_q("""select session_id, sum(length(coalesce(text, '')))::bigint as input, (10 * count(*))::bigint as cache_read, count(*) as turns,
  cast(round_even(10 * count(*) / (sum(length(coalesce(text, ''))) + 10 * count(*)) * 100, 0) as bigint) as hit_pct from said where role = 'assistant' group by 1""")
def q_session_token_totals(spark, d):
    t = S.by_role(_t(spark, d), "assistant").select("session_id", "message_index", F.coalesce(F.length(S.said()), F.lit(0)).alias("input"), F.lit(0).alias("output"), F.lit(10).alias("cache_read"), F.lit(0).alias("cache_created"))
    return S.token_totals(t).select("session_id", "input", "cache_read", "turns", "hit_pct")
