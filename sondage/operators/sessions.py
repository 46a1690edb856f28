"""Analyses of transcripts: what was asked, said, thought, done and gone wrong, in the order of a session.

All start from ``turns``: one row per message with its place in its session. Places and neighbours come from scans over
range-sorted partitions, so a session may hold any share of the rows.

Defined results: a row without session or uuid is left out; repeated deliveries count once; a message without readable
instant comes first; ties are ordered by uuid; null blocks and null fields are passed over; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.instants import instant_micros
from ..functions.transcripts import clean_role, clean_tool
from .ordered import scan
from .profile import json_value

#: Texts that a client puts in, no human (fixed values).
SYNTHETIC = r"^\s*<(task-notification|local-command-caveat|local-command-stdout|local-command-stderr|command-name|command-message|bash-input)>"
#: Signs of a failure in what a tool gives back (fixed values).
FAILED_LINE = r"(?im)^\s*(?:traceback|exception|error:|fatal:|panic:)"
EXIT_CODE = r"(?i)exit code (\d+)"
ORDER = ["us", "uuid"]


def turns(messages: DataFrame, content: bool = True) -> DataFrame:
    """session_id, uuid, parent_uuid, us, role, cwd, content and ``message_index`` (from 0 in each session)."""
    rows = messages.where("session_id is not null and uuid is not null").select(
        "session_id", "uuid", "parent_uuid", instant_micros(F.col("ts")).alias("us"), clean_role(F.col("message.role"), F.col("record_type")).alias("role"), "cwd",
        *([F.col("message.content").alias("content")] if content else []),
    )
    return scan(rows.dropDuplicates(["uuid"]), ["session_id"], ORDER, number="message_index")


def _blocks(t: DataFrame, kind: str | None = None) -> DataFrame:
    out = t.select("session_id", "message_index", "uuid", "us", "role", F.posexplode("content").alias("block_no", "b")).where("b is not null")
    return out.where(F.col("b.type") == kind) if kind else out


def _has(kind: str) -> Column:
    return F.coalesce(F.exists("content", lambda b: b["type"] == kind), F.lit(False))


def said(content: str = "content", sep: str = "\n\n") -> Column:
    """The texts of a message that are not empty."""
    return F.array_join(F.transform(F.filter(content, lambda b: (b["type"] == "text") & (F.length(b["text"]) > 0)), lambda b: b["text"]), sep)


def is_prompt() -> Column:
    """Typed by a human: a user's text that does not ride on a tool result and was not put in by the client."""
    first = F.try_element_at(F.filter("content", lambda b: b["type"] == "text"), F.lit(1))["text"]
    return (F.col("role") == "user") & _has("text") & ~_has("tool_result") & ~F.coalesce(first.rlike(SYNTHETIC), F.lit(False))


def by_role(t: DataFrame, role: str) -> DataFrame:
    return t.where(F.col("role") == role)


def prompts(t: DataFrame) -> DataFrame:
    return t.where(is_prompt()).select("session_id", "message_index", "uuid", "us", said().alias("text"))


def narrative(t: DataFrame, search: str | None = None) -> DataFrame:
    """What the assistant said, turn by turn: turn (from 1), message_index, text, chars."""
    out = t.where("role = 'assistant'").select("session_id", "message_index", "us", "uuid", said().alias("text")).where("text <> ''")
    if search:
        out = out.where(F.contains(F.lower("text"), F.lit(search.lower())))
    return scan(out, ["session_id"], ["message_index"], number="turn").withColumns({"turn": F.col("turn") + 1, "chars": F.length("text")})


def thinking(t: DataFrame) -> DataFrame:
    b = _blocks(t, "thinking").where("length(b.thinking) > 0")
    return b.select("session_id", "message_index", "block_no", "us", F.substring("b.thinking", 1, 100).alias("preview"), F.floor(F.length("b.thinking") / 4).alias("tokens"))


def message(t: DataFrame, n: int) -> DataFrame:
    """The message at a place of each session; negative places count from the end."""
    if n >= 0:
        return t.where(F.col("message_index") == n)
    size = t.groupBy("session_id").agg(F.max("message_index").alias("_last"))
    return t.join(size, "session_id").where(F.col("message_index") == F.col("_last") + 1 + n).drop("_last")


def conversation(t: DataFrame, first: int = 1, last: int | None = None) -> DataFrame:
    """Messages of users and assistants, numbered from 1, in a range of numbers."""
    kept = scan(t.where("role in ('user', 'assistant')"), ["session_id"], ["message_index"], number="turn").withColumn("turn", F.col("turn") + 1)
    return kept.where(F.col("turn") >= first) if last is None else kept.where(F.col("turn").between(first, last))


def tail(t: DataFrame, n: int = 1) -> DataFrame:
    """The last turns in which the assistant said something."""
    said_ = narrative(t)
    return said_.join(said_.groupBy("session_id").agg(F.max("turn").alias("_last")), "session_id").where(F.col("turn") > F.col("_last") - n).drop("_last")


def failure(b: str = "b") -> Column:
    """How a result shows a failure: its flag, an exit code, or a line of its text; null where it does not."""
    text = F.coalesce(F.col(f"{b}.content"), F.lit(""))
    code = F.regexp_extract(text, EXIT_CODE, 1)
    return (
        F.when(F.coalesce(f"{b}.is_error", F.lit(False)), "is_error_flag")
        .when((code != "") & (F.ltrim(code, F.lit("0")) != ""), "exit_code")
        .when(text.rlike(FAILED_LINE), "pattern_match")
    )


def calls(t: DataFrame, tool: str | None = None) -> DataFrame:
    """Tool calls: session_id, message_index, block_no, us, use_id, tool, input."""
    b = _blocks(t, "tool_use").select("session_id", "message_index", "block_no", "us", "uuid", F.col("b.id").alias("use_id"), clean_tool(F.col("b.name")).alias("tool"), F.col("b.input").alias("input"))
    return b.where(F.col("tool") == tool.strip().lower()) if tool else b


def results(t: DataFrame) -> DataFrame:
    return _blocks(t, "tool_result").select("session_id", "message_index", "block_no", "us", F.col("b.tool_use_id").alias("use_id"), failure().alias("error_type"), F.col("b.content").alias("result"))


def tools(t: DataFrame) -> DataFrame:
    """Per session and tool: answered calls, failures and the rate of success in per cent."""
    met = calls(t).where("use_id is not null").select("session_id", "use_id", "tool").join(results(t).select("session_id", "use_id", "error_type"), ["session_id", "use_id"])
    ok = F.count_if(F.col("error_type").isNull())
    return met.groupBy("session_id", "tool").agg(F.count("*").alias("n"), F.count_if(F.col("error_type").isNotNull()).alias("failed"), (F.floor(ok * 1000 / F.count("*") + 0.5) / 10).alias("rate"))


def errors(t: DataFrame, reach: int = 10) -> DataFrame:
    """Failed results with the call that led to them, looked for in the messages before (nine, the first of a session apart)."""
    bad = results(t).where("error_type is not null").withColumn("preview", F.substring("result", 1, 300)).drop("result")
    used = calls(t).where("use_id is not null").groupBy("session_id", "use_id", F.col("message_index").alias("call_index")).agg(F.max_by("tool", "block_no").alias("tool"), F.max_by("input", "block_no").alias("input"))
    i, j = F.col("message_index"), F.col("call_index")
    near = bad.where("use_id is not null").select("session_id", "use_id", "message_index", "block_no").join(used, ["session_id", "use_id"]).where((j < i) & (j > F.greatest(F.lit(0), i - reach)))
    best = near.groupBy("session_id", "message_index", "block_no").agg(F.max_by(F.struct("call_index", "tool", "input"), "call_index").alias("c"))
    out = bad.join(best, ["session_id", "message_index", "block_no"], "left")
    shown = F.coalesce(F.substring(json_value(F.col("c.input"), "/command"), 1, 200), json_value(F.col("c.input"), "/file_path"))
    return out.select("session_id", "message_index", "block_no", "us", "use_id", "error_type", "preview", F.col("c.tool").alias("tool"), F.col("c.call_index").alias("call_index"), shown.alias("input_preview"))


def detail(tool: Column, input_: Column) -> Column:
    """What a call is about, by tool."""
    get = lambda k: json_value(input_, f"/{k}")
    return (
        F.when(tool == "bash", F.coalesce(F.nullif(get("description"), F.lit("")), get("command")))
        .when(tool.isin("read", "write", "edit"), get("file_path"))
        .when(tool == "grep", F.concat(F.lit("'"), F.coalesce(get("pattern"), F.lit("None")), F.lit("' in "), F.coalesce(get("path"), F.lit("."))))
        .when(tool == "glob", get("pattern"))
        .when(tool.isin("taskcreate", "taskupdate"), F.coalesce(F.nullif(get("subject"), F.lit("")), get("taskId")))
        .when(tool.isin("agent", "task"), F.substring(F.coalesce(F.nullif(get("description"), F.lit("")), get("prompt")), 1, 200))
    )


def steps(t: DataFrame) -> DataFrame:
    """Every call in order with what it is about and how it came out (null: no result yet)."""
    last = results(t).where("use_id is not null").groupBy("session_id", "use_id").agg(F.max_by(F.coalesce("error_type", F.lit("")), F.struct("message_index", "block_no")).alias("r"))
    c = calls(t).withColumn("detail", detail(F.col("tool"), F.col("input"))).drop("input")
    outcome = F.when(F.col("r") == "", "success").when(F.col("r").isNotNull(), "error")
    return c.join(last, ["session_id", "use_id"], "left").withColumn("outcome", outcome).drop("r")


def workflow(t: DataFrame) -> DataFrame:
    """Steps with repeated ones in a row collapsed: step (from 1), tool, detail, run_count, outcome of the first."""
    s = steps(t).withColumn("_what", F.struct("tool", "detail"))
    s = s.withColumn("_key", F.to_json("_what"))
    lagged = scan(s.drop("_what"), ["session_id"], ["message_index", "block_no"], number="_n", prevs={"_before": F.col("_key")})
    new = (~F.col("_key").eqNullSafe(F.col("_before"))) | (F.col("_n") == 0)
    runs = scan(lagged, ["session_id"], ["message_index", "block_no"], sums={"step": new.cast("bigint")})
    first = F.struct("message_index", "block_no")
    return runs.groupBy("session_id", "step").agg(
        *(F.min_by(c, first).alias(c) for c in ("tool", "detail", "outcome")), F.min("message_index").alias("message_index"), F.count("*").alias("run_count"), F.min("us").alias("us")
    )


def timeline(t: DataFrame) -> DataFrame:
    """What happened in order: message_index, block_no, event_type, preview, tool, use_id, status."""
    said_ = t.where("role = 'user'").select("session_id", "message_index", F.lit(-1).alias("block_no"), "us", F.lit("user_message").alias("event_type"), F.substring(said(sep=" "), 1, 100).alias("preview")).where("preview <> ''")
    b = _blocks(t).where("role in ('user', 'assistant')")
    kind = F.col("b.type")
    talk = F.col("role") == "assistant"
    event = (
        F.when(kind == "tool_result", "tool_result").when(talk & (kind == "tool_use"), "tool_call").when(talk & (kind == "thinking"), "thinking")
        .when(talk & (kind == "text") & (F.length("b.text") > 0), "assistant_message")
    )
    text = F.when(kind == "text", F.col("b.text")).when(kind == "thinking", F.col("b.thinking")).when(kind == "tool_result", F.col("b.content"))
    rows = b.select(
        "session_id", "message_index", "block_no", "us", event.alias("event_type"), F.substring(text, 1, 100).alias("preview"), F.when(kind == "tool_use", clean_tool(F.col("b.name"))).alias("tool"),
        F.coalesce("b.id", "b.tool_use_id").alias("use_id"), F.when(kind == "tool_result", F.when(failure().isNotNull(), "error").otherwise("success")).alias("status"),
    ).where("event_type is not null")
    return rows.unionByName(said_, allowMissingColumns=True)


def context(t: DataFrame) -> DataFrame:
    """Where the working directory changes: message_index, value, previous."""
    told = t.where("cwd is not null and cwd <> ''").select("session_id", "message_index", "us", F.col("cwd").alias("value"))
    return scan(told, ["session_id"], ["message_index"], prevs={"previous": F.col("value")}).where(~F.col("value").eqNullSafe(F.col("previous")))


def exchanges(t: DataFrame) -> DataFrame:
    """Each prompt with the assistant's last text before the next prompt."""
    marked = scan(t.withColumn("_prompt", F.coalesce(is_prompt(), F.lit(False))), ["session_id"], ["message_index"], sums={"exchange": F.col("_prompt").cast("bigint")})
    text = said()
    answers = (F.col("role") == "assistant") & (text != "")
    at = F.when(answers, F.col("message_index"))
    return marked.where("exchange > 0").groupBy("session_id", "exchange").agg(
        F.min("message_index").alias("message_index"), F.max(F.when(F.col("_prompt"), text)).alias("prompt"),
        F.max_by(F.when(answers, text), at).alias("answer"), F.max(at).alias("answer_index"),
    )


def files(t: DataFrame) -> DataFrame:
    """Files that calls name, by session, tool and file, with the number of calls."""
    named = calls(t).withColumn("file", F.coalesce(json_value(F.col("input"), "/file_path"), json_value(F.col("input"), "/notebook_path"))).where("file is not null")
    return named.groupBy("session_id", "tool", "file").agg(F.count("*").alias("n"), F.min("message_index").alias("first_index"))


def agents(t: DataFrame) -> DataFrame:
    """Calls of sub-agents with what came back."""
    used = calls(t).where("tool in ('agent', 'task')").withColumn("detail", detail(F.col("tool"), F.col("input"))).drop("input", "uuid")
    back = results(t).where("use_id is not null").select("session_id", "use_id", F.col("message_index").alias("result_index"), "error_type", F.length("result").alias("result_chars"))
    return used.join(back, ["session_id", "use_id"], "left")


def tokens(usage: DataFrame) -> DataFrame:
    """Turns with their running input (session_id, message_index, input, output, cache_read, cache_created; one row per finished turn)."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    each = usage.select("session_id", "message_index", *(zero(F.col(c)).alias(c) for c in ("input", "output", "cache_read", "cache_created")))
    return scan(each, ["session_id"], ["message_index"], sums={"cumulative_input": F.col("input") + F.col("cache_read") + F.col("cache_created")})


def token_totals(usage: DataFrame) -> DataFrame:
    """Sums per session and the share of input that came from the cache, in whole per cent."""
    sums = usage.groupBy("session_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input", "output", "cache_read", "cache_created")), F.count("*").alias("turns"))
    total = F.col("input") + F.col("cache_read") + F.col("cache_created")
    return sums.withColumn("hit_pct", F.when(total > 0, F.bround(F.col("cache_read") / total * 100)).otherwise(0).cast("bigint"))


def summary(t: DataFrame) -> DataFrame:
    """One row per session: messages by role, prompts, calls, failures, thinking, duration, and the last that was said."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    kinds = lambda k: F.coalesce(F.size(F.filter("content", lambda b: b["type"] == k)), F.lit(0))
    text = said()
    spoke = (F.col("role") == "assistant") & (text != "")
    failed = results(t).groupBy("session_id").agg(n(F.col("error_type").isNotNull()).alias("n_errors"))
    heads = t.groupBy("session_id").agg(
        F.count("*").alias("n_messages"), n(F.col("role") == "user").alias("n_user"), n(F.col("role") == "assistant").alias("n_assistant"), n(is_prompt()).alias("n_prompts"),
        F.sum(kinds("tool_use")).alias("n_calls"), F.sum(kinds("thinking")).alias("n_thinking"), ((F.max("us") - F.min("us")) / 1e6).alias("duration_s"),
        F.max_by(F.when(spoke, F.substring(text, 1, 200)), F.when(spoke, F.col("message_index"))).alias("last_said"),
    )
    return heads.join(failed, "session_id", "left").na.fill({"n_errors": 0})


def digest(t: DataFrame) -> DataFrame:
    """Prompts and what the assistant said, in one readable table."""
    a = prompts(t).select("session_id", "message_index", F.lit("prompt").alias("section"), "text")
    return a.unionByName(narrative(t).select("session_id", "message_index", F.lit("narrative").alias("section"), "text"))


def search(t: DataFrame, term: str, word: bool = False, window: int = 120) -> DataFrame:
    """Blocks that hold a term (whole words if wanted), with an excerpt around its first place."""
    kind = F.col("b.type")
    text = F.when(kind == "text", F.col("b.text")).when(kind == "thinking", F.col("b.thinking")).when(kind == "tool_use", F.col("b.input")).when(kind == "tool_result", F.col("b.content"))
    b = _blocks(t).withColumn("text", text).where("text is not null")
    quoted = "\\Q" + term.lower().replace("\\E", "\\E\\\\E\\Q") + "\\E"
    hit = F.lower("text").rlike(rf"\b{quoted}\b") if word else F.contains(F.lower("text"), F.lit(term.lower()))
    at = F.locate(term.lower(), F.lower("text"))
    start = F.greatest(F.lit(1), at - window // 3)
    end = F.least(F.length("text"), at - 1 + len(term) + window * 2 // 3)
    excerpt = F.concat(F.when(start > 1, "...").otherwise(""), F.trim(F.col("text").substr(start, end - start + 1)), F.when(end < F.length("text"), "...").otherwise(""))
    return b.where(hit).select("session_id", "message_index", "block_no", "role", kind.alias("block_type"), excerpt.alias("excerpt"))


def search_sessions(t: DataFrame, term: str, word: bool = False, window: int = 120) -> DataFrame:
    """Sessions that hold a term, newest first: hits and the first excerpt."""
    hits = search(t, term, word, window)
    ended = t.groupBy("session_id").agg(F.max("us").alias("ended_us"))
    per = hits.groupBy("session_id").agg(F.count("*").alias("hits"), F.min_by("excerpt", F.struct("message_index", "block_no")).alias("excerpt"))
    return per.join(ended, "session_id")


def listing(sessions: DataFrame, t: DataFrame, name: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """The sessions with their size, filtered by a part of their name and by date."""
    per = t.groupBy("session_id").agg(F.count("*").alias("n_messages"), F.min("us").alias("began_us"), F.max("us").alias("ended_us"))
    out = sessions.dropDuplicates(["session_id"]).join(per, "session_id", "left").na.fill({"n_messages": 0})
    if name:
        out = out.where(F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(name.lower())) | F.contains(F.lower("session_id"), F.lit(name.lower())) | F.contains(F.lower(F.coalesce("project", F.lit(""))), F.lit(name.lower())))
    day = F.to_date(F.timestamp_micros("ended_us"))
    if since:
        out = out.where(day >= (F.current_date() if since == "today" else F.lit(since).cast("date")))
    return out.where(day <= F.lit(until).cast("date")) if until else out


def composite(t: DataFrame, errors_only: bool = False, tools_: str | None = None, contains: str | None = None) -> DataFrame:
    """Messages that meet all the given conditions: hold a failed result, call one of the tools, contain a text."""
    out = t
    if errors_only:
        out = out.join(results(t).where("error_type is not null").select("session_id", "message_index").distinct(), ["session_id", "message_index"], "left_semi")
    if tools_:
        wanted = [x.strip().lower() for x in tools_.split(",") if x.strip()]
        out = out.join(calls(t).where(F.col("tool").isin(wanted)).select("session_id", "message_index").distinct(), ["session_id", "message_index"], "left_semi")
    if contains:
        out = out.join(search(t, contains).select("session_id", "message_index").distinct(), ["session_id", "message_index"], "left_semi")
    return out


def chain(t: DataFrame, session: str, longest: int = 50) -> DataFrame:
    """The sessions that continue one another: each begins with a message whose parent lies in the one before."""
    spark = t.sparkSession
    root = t.where("parent_uuid is not null").select("session_id", "parent_uuid")
    link = root.join(t.select(F.col("uuid").alias("parent_uuid"), F.col("session_id").alias("before")), "parent_uuid").where("before <> session_id").select("session_id", "before").distinct()
    out, here, seen = [(session, 0)], session, {session}
    for n in range(1, longest):
        r = link.where(F.col("session_id") == here).orderBy("before").first()
        if r is None or r.before in seen:
            break
        here = r.before
        seen.add(here)
        out.append((here, n))
    return spark.createDataFrame(out, "session_id string, back int")
