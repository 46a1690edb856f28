"""Schemes over tables of facts: certificates, names, databases, hosting, certificate runs, transcripts, the running interpreter.

Facts are gathered elsewhere and come as tables (Parquet, JSON, JSON Lines or CSV); a resource of several tables is a folder
with one table per name. Whatever a resource lacks gives an empty table of the right columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, infra, sessions
from ..sources import files as file_source
from ..sources import formats, stores
from .api import SCHEMES, Call, _on, describe, scheme

_READ = {"parquet": lambda r, p: r.parquet(p), "json": lambda r, p: r.option("multiLine", True).json(p), "jsonl": lambda r, p: r.json(p), "csv": lambda r, p: r.csv(p, header=True, inferSchema=True)}


def read_facts(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table of facts by the ending of its name; with a schema, its columns are those, missing ones null."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    df = _READ.get(kind, _READ["parquet"])(spark.read, path)
    if schema is None:
        return df
    cols = [c.strip().split(" ", 1) for c in schema.split(", ")]
    return df.select(*(F.col(n).cast(t).alias(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in cols))


def table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """One table of a folder of facts, or an empty one."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for kind in _READ:
        at = f"{folder.rstrip('/')}/{name}.{kind}"
        p = fs_path(at)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return read_facts(spark, at, schema)
    return spark.createDataFrame([], schema)


CERTIFICATES = (
    "host string, subject string, issuer string, names array<string>, not_before timestamp, not_after timestamp, checked_at timestamp, chain array<string>, self_signed boolean, responder string, path string"
)


@scheme("ssl", "certificates: checks by host; #dates, #subject, #issuer, #san, #chain, #full", "expiring-within summary check", tiebreak="host check")
def _ssl(spark: SparkSession, call: Call) -> DataFrame:
    p, c = call.params, read_facts(spark, call.resource, CERTIFICATES)
    now = F.coalesce("checked_at", F.current_timestamp())
    days = F.datediff("not_after", now)
    if "expiring-within" in p:
        c = c.where(days <= int(p["expiring-within"]))
    view = {
        "dates": lambda: c.select("host", "not_before", "not_after", days.alias("days_left"), checks.expiry_state(days).alias("state")),
        "subject": lambda: c.select("host", "subject"),
        "issuer": lambda: c.select("host", "issuer", "self_signed"),
        "san": lambda: c.select("host", F.explode("names").alias("name")),
        "chain": lambda: c.select("host", F.posexplode("chain").alias("position", "certificate")),
        "full": lambda: c,
    }
    if call.element:
        return view[call.element]()
    states = infra.certificate_checks(c.withColumn("checked_at", now))
    return checks.summary(states, ["check"]) if "summary" in p else states


RECORDS = "domain string, type string, name string, value string"


@scheme("domain", "names: #dns, #mail, #ns-audit, #registrar, #whois, #http, #ssl; checks of all", "check only-failures", tiebreak="domain check")
def _domain(spark: SparkSession, call: Call) -> DataFrame:
    one = lambda name, schema: table(spark, call.resource, name, schema)
    records = one("records", RECORDS)
    answers = one("answers", "domain string, server string, value string")
    whois = one("whois", "domain string, registrar string, created timestamp, expires timestamp, nameservers array<string>")
    certs = one("certificates", CERTIFICATES)
    http = one("http", "domain string, step int, url string, status int, location string")
    mail = infra.mail_policy(records.where("type = 'TXT'"))
    view = {
        "dns": lambda: records,
        "mail": lambda: mail.join(records.where("type = 'MX'").groupBy("domain").agg(F.sort_array(F.collect_set("value")).alias("mx")), "domain", "full"),
        "ns-audit": lambda: infra.authority(records, answers),
        "registrar": lambda: whois.select("domain", "registrar", "nameservers"),
        "whois": lambda: whois,
        "http": lambda: http.withColumn("secure", F.col("url").startswith("https://")),
        "ssl": lambda: infra.certificate_checks(certs.withColumn("checked_at", F.coalesce("checked_at", F.current_timestamp()))).withColumnRenamed("host", "domain"),
    }
    if call.element:
        return view[call.element]()
    each = mail.select("domain", F.explode(F.array(F.struct(F.lit("spf").alias("check"), F.col("spf").alias("state")), F.struct(F.lit("dmarc").alias("check"), F.col("dmarc").alias("state")))).alias("c")).select("domain", "c.*")
    agree = infra.propagation(answers).select("domain", F.lit("propagation").alias("check"), F.when(F.col("agree"), "pass").otherwise("warning").alias("state"))
    out = each.unionByName(agree).unionByName(view["ssl"]())
    return out.where("state <> 'pass'") if _on(call.params, "only-failures") else out


@scheme("mysql", "a database server: #health, #connections, #innodb, #performance, #variables, #databases, #storage, #tables, #indexes, #slow-queries, #errors, #replication", "check since top only-failures", tiebreak="")
def _mysql(spark: SparkSession, call: Call) -> DataFrame:
    p = call.params
    one = lambda name, schema: table(spark, call.resource, name, schema)
    pairs = "server string, name string, value string"
    status, variables = one("status", pairs), one("variables", pairs)
    top = int(p.get("top", 20))
    sizes = one("tables", "server string, database string, table string, rows bigint, data_bytes bigint, index_bytes bigint, reads bigint, writes bigint")
    view = {
        "health": lambda: infra.server_health(status, variables),
        "connections": lambda: one("processes", "server string, id bigint, user string, host string, command string, seconds bigint, state string"),
        "innodb": lambda: status.where("lower(name) like 'innodb%'"),
        "performance": lambda: infra.server_health(status, variables).where("check in ('full_scans', 'disk_tables', 'thread_cache', 'slow_share')"),
        "variables": lambda: variables,
        "databases": lambda: sizes.groupBy("server", "database").agg(F.count("*").alias("tables"), F.sum(F.coalesce("data_bytes", F.lit(0)) + F.coalesce("index_bytes", F.lit(0))).alias("bytes")),
        "storage": lambda: sizes.groupBy("server", "database", "table").agg(F.sum("data_bytes").alias("data_bytes"), F.sum("index_bytes").alias("index_bytes")),
        "tables": lambda: sizes.withColumn("io", F.coalesce("reads", F.lit(0)) + F.coalesce("writes", F.lit(0))).orderBy(F.desc("io"), "database", "table").limit(top),
        "indexes": lambda: one("indexes", "server string, database string, table string, index string, uses bigint, unique boolean").withColumn("unused", (F.coalesce("uses", F.lit(0)) == 0) & ~F.coalesce("unique", F.lit(False))),
        "slow-queries": lambda: infra.slow_queries(one("slow_log", "ts timestamp, query_time double, sql string"), p.get("since", "1970-01-01"), top),
        "errors": lambda: one("errors", "server string, ts timestamp, level string, message string").where("lower(level) in ('error', 'warning')"),
        "replication": lambda: infra.replication(one("replication", "server string, role string, io_running string, sql_running string, seconds_behind bigint, last_error string")),
    }
    out = view[call.element or "health"]()
    return out.where("state <> 'pass'") if _on(p, "only-failures") and "state" in out.columns else out


@scheme("cpanel", "a hosting account: domains; #domains, #ssl, #acl-check, #full-audit, #help/api", "domain_type dns-verified check-live only-failures", tiebreak="domain check")
def _cpanel(spark: SparkSession, call: Call) -> DataFrame:
    p = call.params
    domains = table(spark, call.resource, "domains", "user string, domain string, type string, docroot string, resolves boolean")
    if "domain_type" in p:
        domains = domains.where(F.col("type") == p["domain_type"])
    if _on(p, "dns-verified"):
        domains = domains.where(F.coalesce("resolves", F.lit(True)))
    certs = table(spark, call.resource, "certificates", CERTIFICATES)
    acl = table(spark, call.resource, "acl", "domain string, denied boolean")
    live = table(spark, call.resource, "live", "domain string, not_after timestamp")
    now = F.coalesce("checked_at", F.current_timestamp())
    held = domains.select("domain").join(certs.withColumnRenamed("host", "domain"), "domain", "left")
    ssl = held.select("domain", F.lit("ssl").alias("check"), F.when(F.col("not_after").isNull(), "failure").otherwise(checks.expiry_state(F.datediff("not_after", now))).alias("state"))
    if _on(p, "check-live"):
        differs = held.join(live.withColumnRenamed("not_after", "served_until"), "domain").select("domain", F.lit("live").alias("check"), F.when(F.col("served_until").eqNullSafe(F.col("not_after")), "pass").otherwise("warning").alias("state"))
        ssl = ssl.unionByName(differs)
    access = domains.select("domain").join(acl, "domain", "left").select("domain", F.lit("acl").alias("check"), F.when(F.col("denied").isNull(), "warning").when(F.col("denied"), "failure").otherwise("pass").alias("state"))
    about = [("domains", "domains of the account"), ("ssl", "certificates on disk"), ("acl-check", "whether the web server may read"), ("full-audit", "all checks")]
    view = {
        "domains": lambda: domains, "ssl": lambda: ssl, "acl-check": lambda: access, "full-audit": lambda: ssl.unionByName(access),
        "help/api": lambda: spark.createDataFrame(about, "element string, about string"),
    }
    if not call.element:
        failing = domains.select("user", "domain").join(ssl.where("check = 'ssl'"), "domain").groupBy("user").agg(F.count_if(F.col("state") == "failure").alias("failing"))
        return domains.groupBy("user").agg(F.count("*").alias("domains"), F.count_if(F.col("type") == "main_domain").alias("main")).join(failing, "user", "left")
    out = view[call.element]()
    return out.where("state <> 'pass'") if _on(p, "only-failures") and "state" in out.columns else out


@scheme("letsencrypt", "certificates on disk with the configurations that refer to them", "check-orphans check-duplicates nginx", tiebreak="path")
def _letsencrypt(spark: SparkSession, call: Call) -> DataFrame:
    certs = read_facts(spark, call.resource, CERTIFICATES)
    p = call.params
    if "nginx" in p:
        rows = formats.structure(file_source.read_texts(spark, p["nginx"])).where("format = 'nginx' and name = 'ssl_certificate'")
        references = rows.select(F.col("detail").alias("path"))
    else:
        references = spark.createDataFrame([], "path string")
    orphans, same = infra.certificate_inventory(certs, references)
    if _on(p, "check-orphans"):
        return orphans
    return same if _on(p, "check-duplicates") else certs.select("path", "host", "names", "not_after", F.datediff("not_after", F.coalesce("checked_at", F.current_timestamp())).alias("days_left"))


@scheme("runlog", "lines of certificate run logs with their user and domain", "only-failures summary user", tiebreak="file n")
def _runlog(spark: SparkSession, call: Call) -> DataFrame:
    """The order within a file is that of its lines: whole files are read, and numbered where they are split."""
    p = call.params
    raw = spark.read.format("binaryFile").load(call.resource).select(F.col("path").alias("file"), F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("n", "line")).where("trim(line) <> ''")
    rec = F.from_json("line", "contents string, indent int, type string, timestamp string")
    log = infra.run_log(raw.select("file", "n", rec.alias("r")).select("file", "n", "r.*"), ["n"])
    if "user" in p:
        log = log.where(F.col("user") == p["user"])
    if _on(p, "summary"):
        return log.where("domain is not null").groupBy("file").agg(F.count_distinct("user").alias("users"), F.count_distinct("domain").alias("domains"), F.count_if(F.lower("type") == "error").alias("errors"))
    return log.where(F.lower("type") == "error") if _on(p, "only-failures") else log


SCHEMES["autossl"] = SCHEMES["runlog"]


# --- transcripts ---

_RAW = (
    "type string, uuid string, parentUuid string, timestamp string, sessionId string, cwd string, gitBranch string, message struct<role: string, stop_reason: string,"
    " usage: struct<input_tokens: bigint, output_tokens: bigint, cache_read_input_tokens: bigint, cache_creation_input_tokens: bigint>,"
    " content: array<struct<type: string, text: string, thinking: string, name: string, id: string, input: string, tool_use_id: string, content: string, is_error: boolean>>>"
)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Message rows from a Parquet table or from JSON Lines; a content that is plain text becomes a text block."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    text = spark.read.text(path).where("trim(value) <> ''")
    plain = F.get_json_object("value", "$.message.content")
    rec = F.from_json("value", _RAW)
    block = F.struct(F.lit("text").alias("type"), plain.alias("text"), *(F.lit(None).cast("string").alias(c) for c in ("thinking", "name", "id", "input", "tool_use_id", "content")), F.lit(None).cast("boolean").alias("is_error"))
    rows = text.select(rec.alias("r"), plain.alias("plain"), F.when(~F.ltrim(plain).startswith("["), F.array(block)).alias("said"))
    content = F.coalesce("r.message.content", "said")
    message = F.struct(F.col("r.message.role").alias("role"), content.alias("content"), F.col("r.message.stop_reason").alias("stop_reason"), F.col("r.message.usage").alias("usage"))
    return rows.select(
        F.col("r.type").alias("record_type"), F.col("r.uuid").alias("uuid"), F.col("r.parentUuid").alias("parent_uuid"), F.col("r.timestamp").alias("ts"), F.col("r.sessionId").alias("session_id"),
        F.col("r.cwd").alias("cwd"), F.when(F.col("r.message").isNotNull(), message).alias("message"), F.current_timestamp().alias("ingested_at"),
    ).where("record_type is not null")


@scheme(
    "transcripts", "transcripts: sessions; #summary, #digest, #prompts, #messages, #message/<n>, #exchanges, #thinking, #tools, #workflow, #timeline, #errors, #files, #context, #tokens, #agents, #chain",
    "session summary errors tools contains search since until word snippet filter project tail last tokens digest full raw role range sessions", tiebreak="session_id message_index block_no",
)
def _transcripts(spark: SparkSession, call: Call) -> DataFrame:
    p, element = call.params, call.element
    raw = read_transcripts(spark, call.resource)
    if "session" in p:
        raw = raw.where(F.col("session_id").contains(p["session"]))
    t = sessions.turns(raw)
    if "since" in p or "until" in p:
        day = F.to_date(F.timestamp_micros("us"))
        since = F.current_date() if p.get("since") == "today" else F.lit(p.get("since", "0001-01-01")).cast("date")
        t = t.where((day >= since) & (day <= F.lit(p.get("until", "9999-12-31")).cast("date")))
    if "project" in p:
        t = t.where(F.contains(F.coalesce("cwd", F.lit("")), F.lit(p["project"])))
    shorten = lambda df: df if _on(p, "full") or "text" not in df.columns else df.withColumn("text", F.substring("text", 1, 600))
    if element and element.startswith("message/"):
        return sessions.message(t, int(element[8:]))
    if element == "chain":
        return sessions.chain(t, p.get("session", ""))
    if element == "tokens" or _on(p, "tokens"):
        names = {"input": "input_tokens", "output": "output_tokens", "cache_read": "cache_read_input_tokens", "cache_created": "cache_creation_input_tokens"}
        if "usage" not in raw.schema["message"].dataType.fieldNames():  # a table without usage has no turns to count
            raw = raw.limit(0).withColumn("message", F.col("message").withField("usage", F.lit(None).cast("struct<" + ", ".join(f"{c}: bigint" for c in names.values()) + ">")).withField("stop_reason", F.lit(None).cast("string")))
        u = raw.where("message.usage is not null and message.stop_reason is not null").select("uuid", *(F.col(f"message.usage.{c}").alias(n) for n, c in names.items()))
        return sessions.tokens(t.where("role = 'assistant'").join(u.dropDuplicates(["uuid"]), "uuid"))
    if _on(p, "raw") or "role" in p:
        return sessions.by_role(t, p.get("role", "user" if element == "prompts" else "assistant"))
    if "range" in p:
        lo, _, hi = p["range"].partition("-")
        return sessions.conversation(t, int(lo), int(hi or lo))
    if "tail" in p or "last" in p:
        return sessions.tail(t, int(p["tail"]) if p.get("tail", "").isdigit() else 1)
    if "search" in p:
        args = (p["search"], _on(p, "word"), max(60, min(500, int(p.get("snippet", 120)))))
        return sessions.search_sessions(t, *args) if _on(p, "sessions") else sessions.search(t, *args)
    view = {
        "digest": lambda: shorten(sessions.digest(t)), "prompts": lambda: shorten(sessions.prompts(t)), "messages": lambda: shorten(sessions.narrative(t)), "exchanges": lambda: sessions.exchanges(t),
        "thinking": lambda: sessions.thinking(t), "tools": lambda: sessions.tools(t), "workflow": lambda: sessions.workflow(t), "timeline": lambda: sessions.timeline(t), "errors": lambda: sessions.errors(t),
        "files": lambda: sessions.files(t), "context": lambda: sessions.context(t), "agents": lambda: sessions.agents(t), "summary": lambda: sessions.summary(t),
    }
    if element:
        return view[element]()
    if _on(p, "digest"):
        return view["digest"]()
    if _on(p, "errors") or "tools" in p or "contains" in p:
        return sessions.composite(t, _on(p, "errors"), p.get("tools"), p.get("contains"))
    out = sessions.summary(t)
    return out.where(F.contains(F.lower("session_id"), F.lit(p["filter"].lower()))) if "filter" in p else out


# --- the interpreter and the engine itself ---


@scheme("python", "the interpreter: installed packages; #packages/<name>, #version, #env, #venv, #syspath, #imports, #module/<name>, #doctor, #debug/bytecode", "root", tiebreak="name")
def _python(spark: SparkSession, call: Call) -> DataFrame:
    e = call.element or "packages"
    if e == "packages":
        return stores.packages(spark)
    if e.startswith("packages/"):
        return stores.packages(spark).where(F.lower("package") == e[9:].lower())
    return spark.createDataFrame(stores.interpreter_facts(e, call.params.get("root", call.resource)), "name string, value string, state string")


@scheme("help", "the schemes themselves: #adapters, #analyzers, #rules, #config", "", tiebreak="scheme")
def _help(spark: SparkSession, call: Call) -> DataFrame:
    from ..operators.rules import BUILTIN

    if call.element == "analyzers":
        return spark.createDataFrame(sorted((k, v) for k, v in formats.extensions().items()), "extension string, format string")
    if call.element == "rules":
        return spark.createDataFrame([(r.code, r.severity, r.message, r.per_line) for r in BUILTIN.chosen()], "rule_code string, severity string, message string, per_line boolean")
    if call.element == "config":
        return spark.createDataFrame(sorted((k, v) for k, v in spark.sparkContext.getConf().getAll() if k.startswith(("spark.sql", "spark.checkpoint", "spark.master"))) or [("", "")], "name string, value string")
    return spark.createDataFrame([(d["scheme"], d["about"], d["params"]) for d in describe()], "scheme string, about string, params array<string>")

