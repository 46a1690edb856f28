"""Checks over configuration, logs and facts about hosts; facts come as tables, whoever gathers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checks import expiry_state, host_matches, state
from .joining import consistency

# --- web server configuration: over the structure table of such files ---


def server_blocks(structure: DataFrame) -> DataFrame:
    """Directives with the server block they stand in: path, server (number), name, detail, line."""
    rows = structure.where("format = 'nginx'")
    w = Window.partitionBy("path").orderBy("line", F.monotonically_increasing_id()).rowsBetween(Window.unboundedPreceding, 0)
    opens = (F.col("category") == "block") & (F.col("name") == "server")
    numbered = rows.withColumn("server", F.sum(opens.cast("int")).over(w)).withColumn("base", F.last(F.when(opens, F.col("level")), ignorenulls=True).over(w))
    inside = numbered.where("server > 0 and level > base")
    # the location a directive stands in, if any
    w2 = Window.partitionBy("path", "server").orderBy("line", F.monotonically_increasing_id()).rowsBetween(Window.unboundedPreceding, 0)
    at = (F.col("category") == "block") & (F.col("name") == "location")
    placed = inside.withColumn("_loc", F.last(F.when(at, F.struct(F.col("detail").alias("detail"), F.col("level").alias("level"))), ignorenulls=True).over(w2))
    return placed.select("path", "server", "category", "name", "detail", "line", F.when(F.col("level") > F.col("_loc.level"), F.col("_loc.detail")).alias("location"))


def virtual_hosts(structure: DataFrame) -> DataFrame:
    """Per server block: names, ports, root, whether it is secure, and where it forwards to."""
    b = server_blocks(structure)
    pick = lambda n: F.max(F.when(F.col("name") == n, F.col("detail")))
    return b.groupBy("path", "server").agg(
        pick("server_name").alias("names"), F.sort_array(F.collect_set(F.when(F.col("name") == "listen", F.col("detail")))).alias("listens"), pick("root").alias("root"),
        F.max(F.coalesce((F.col("name") == "listen") & F.col("detail").rlike(r"\bssl\b|^443"), F.lit(False))).alias("secure"), pick("ssl_certificate").alias("certificate"),
        pick("proxy_pass").alias("forwards_to"), F.max(F.coalesce((F.col("name") == "add_header") & F.col("detail").contains("Strict-Transport-Security"), F.lit(False))).alias("hsts"),
        F.max(F.coalesce((F.col("name") == "limit_req"), F.lit(False))).alias("limited"), F.max(F.coalesce((F.col("name") == "listen") & F.col("detail").contains("http2") | (F.col("name") == "http2"), F.lit(False))).alias("http2"),
        F.max(F.coalesce((F.col("name") == "add_header") & F.col("detail").contains("X-XSS-Protection"), F.lit(False))).alias("old_header"),
        F.max(F.coalesce((F.col("name") == "proxy_set_header") & F.col("detail").startswith("Host"), F.lit(False))).alias("sends_host"), F.min("line").alias("line"),
    )


def server_findings(structure: DataFrame) -> DataFrame:
    """Findings on web server configuration: path, line, rule_code, severity, message."""
    v = virtual_hosts(structure)
    row = lambda df, code, severity, text: df.select("path", "line", F.lit(code).alias("rule_code"), F.lit(severity).alias("severity"), F.lit(text).alias("message"))
    secure = v.where("secure")
    ups = structure.where("format = 'nginx' and category = 'directive' and name = 'server'")
    shared = ups.groupBy(F.split("detail", r"\s+")[0].alias("backend")).agg(F.count("*").alias("n"), F.min("path").alias("path"), F.max("line").alias("line")).where("n > 1")
    tokens = structure.where("format = 'nginx'").groupBy("path").agg(F.max(F.coalesce((F.col("name") == "server_tokens") & (F.col("detail") == "off"), F.lit(False))).alias("off"), F.max(F.coalesce((F.col("name") == "http") | (F.col("name") == "server"), F.lit(False))).alias("web"), F.lit(1).alias("line"))
    parts = [
        row(shared, "N001", "high", "several upstream entries share a backend"),
        row(secure.where("certificate is null"), "N002", "critical", "secure server without certificate"),
        row(v.where("forwards_to is not null and not sends_host"), "N003", "medium", "forwarding without the host header"),
        row(secure.where("not hsts"), "N008", "high", "secure server without strict transport security"),
        row(tokens.where("web and not off"), "N009", "medium", "the server tells its version"),
        row(v.where("old_header"), "N010", "low", "deprecated protection header"),
        row(secure.where("not http2"), "N011", "low", "secure listener without http2"),
        row(v.where("not limited"), "N012", "low", "no rate limit"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.unionByName(range_findings(structure))


#: Safe ranges of times in seconds (fixed values).
TIMES = {
    "send_timeout": (10, 300), "proxy_read_timeout": (10, 300), "proxy_send_timeout": (10, 300), "proxy_connect_timeout": (2, 75),
    "keepalive_timeout": (5, 120), "client_body_timeout": (5, 120), "client_header_timeout": (5, 120),
}
#: Largest sizes in megabytes (fixed values).
SIZES = {"client_body_buffer_size": 64, "client_max_body_size": 2048, "proxy_buffer_size": 32}
#: A body from this size in megabytes on needs timeouts of this many seconds (fixed values).
LARGE_BODY, SAFE_TIMEOUT = 10, 60


def seconds(c):
    n, unit = F.regexp_extract(c, r"^\s*(\d+(?:\.\d+)?)(?:ms|s|m|h)?\s*$", 1), F.regexp_extract(F.lower(c), r"(ms|s|m|h)\s*$", 1)
    return F.nullif(n, F.lit("")).cast("double") * F.when(unit == "ms", 0.001).when(unit == "m", 60.0).when(unit == "h", 3600.0).otherwise(1.0)


def megabytes(c):
    n, unit = F.regexp_extract(F.lower(c), r"^\s*(\d+(?:\.\d+)?)\s*[kmg]?\s*$", 1), F.regexp_extract(F.lower(c), r"([kmg])\s*$", 1)
    return F.nullif(n, F.lit("")).cast("double") * F.when(unit == "k", 1 / 1024).when(unit == "m", 1.0).when(unit == "g", 1024.0).otherwise(1 / 1048576)


def range_findings(structure: DataFrame) -> DataFrame:
    """Directives outside their safe range (N005), timeouts too short for the bodies allowed (N006), challenge roots that differ (N004)."""
    rows = structure.where("format = 'nginx' and category = 'directive'")
    first = F.split("detail", r"\s+")[0]
    low = F.create_map(*[x for k, (a, _) in TIMES.items() for x in (F.lit(k), F.lit(float(a)))])
    high = F.create_map(*[x for k, (_, b) in TIMES.items() for x in (F.lit(k), F.lit(float(b)))])
    most = F.create_map(*[x for k, b in SIZES.items() for x in (F.lit(k), F.lit(float(b)))])
    t, m = seconds(first), megabytes(first)
    outside = rows.where(((t < low[F.col("name")]) | (t > high[F.col("name")])) | (m > most[F.col("name")]))
    unlimited = F.col("detail").rlike(r"^0[mg]?$")
    body = rows.where((F.col("name") == "client_max_body_size") & ~unlimited).groupBy("path").agg(F.min_by(m, "line").alias("mb")).where(F.col("mb") > LARGE_BODY)
    short = rows.where(F.col("name").isin("send_timeout", "proxy_read_timeout", "proxy_send_timeout")).groupBy("path", "name").agg(F.min_by(t, "line").alias("s"), F.min("line").alias("line")).where(F.col("s") < SAFE_TIMEOUT)
    roots = server_blocks(structure).where(F.col("location").contains("acme-challenge") & (F.col("name") == "root")).select("path", F.regexp_replace("detail", "['\"]", "").alias("root"), "line")
    counted = roots.groupBy("path", "root").agg(F.count("*").alias("n"), F.min("line").alias("line"))
    usual = counted.groupBy("path").agg(F.max_by("root", F.struct("n", -F.col("line"))).alias("usual"))
    odd = counted.join(usual, "path").where("root <> usual")
    row = lambda df, code, severity, text: df.select("path", "line", F.lit(code).alias("rule_code"), F.lit(severity).alias("severity"), text.alias("message"))
    return (
        row(outside, "N005", "medium", F.concat("name", F.lit(" "), "detail", F.lit(" is outside its safe range")))
        .unionByName(row(short.join(body, "path"), "N006", "high", F.concat("name", F.lit(" is too short for large bodies"))))
        .unionByName(row(odd, "N004", "high", F.concat(F.lit("challenge root differs: "), "root")))
    )


def stapling_findings(structure: DataFrame, certificates: DataFrame) -> DataFrame:
    """Servers that staple although their certificate names no responder (N007). ``certificates``: path, responder."""
    b = server_blocks(structure)
    pick = lambda n: F.max(F.when(F.col("name") == n, F.col("detail")))
    on = b.groupBy("path", "server").agg(pick("ssl_stapling").alias("stapling"), pick("ssl_certificate").alias("certificate"), F.min(F.when(F.col("name") == "ssl_stapling", F.col("line"))).alias("line")).where("lower(stapling) = 'on'")
    none = certificates.where("responder is null or responder = ''").select(F.col("path").alias("certificate"))
    return on.join(none, "certificate", "left_semi").select("path", "line", F.lit("N007").alias("rule_code"), F.lit("low").alias("severity"), F.concat(F.lit("no responder in "), "certificate").alias("message"))


def locations(structure: DataFrame) -> DataFrame:
    """Location blocks with where they lead: path, server, location, target."""
    b = server_blocks(structure).where("location is not null")
    pick = lambda *n: F.max(F.when(F.col("name").isin(*n), F.col("detail")))
    return b.groupBy("path", "server", "location").agg(F.coalesce(pick("proxy_pass", "fastcgi_pass", "uwsgi_pass", "grpc_pass"), pick("return"), pick("alias"), pick("root")).alias("target"), F.min("line").alias("line"))


def access_control(structure: DataFrame) -> DataFrame:
    return server_blocks(structure).where("name in ('auth_basic', 'auth_request', 'auth_basic_user_file', 'allow', 'deny')").select("path", "server", "location", "name", "detail", "line")


def ports(structure: DataFrame) -> DataFrame:
    """Listening ports of servers with whether they are secure or only redirect."""
    b = server_blocks(structure)
    sent = b.groupBy("path", "server").agg(F.max(F.coalesce((F.col("name") == "return") & F.col("location").isNull() & F.col("detail").rlike(r"^30[1278]"), F.lit(False))).alias("redirects"))
    at = b.where("name = 'listen' and location is null").select("path", "server", F.regexp_extract("detail", r"(?:^|:)(\d+)(?:\s|$)", 1).cast("int").alias("port"), F.col("detail").rlike(r"\bssl\b|(^|:)443\b").alias("secure"), "line")
    return at.join(sent, ["path", "server"])


def fleet_includes(structure: DataFrame) -> DataFrame:
    """Includes that many sites share, with how many lack them."""
    inc = structure.where("format = 'nginx' and name = 'include'").select(F.col("path").alias("site"), F.col("detail").alias("snippet"))
    return consistency(inc, "site", "snippet")


# --- run logs ---


def run_log(lines: DataFrame, order: list[str], file: str = "file") -> DataFrame:
    """Each line of a run log (contents, indent, type) with the user and domain it belongs to, filled forward."""
    w = Window.partitionBy(file).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    user = F.when(F.col("indent") == 0, F.regexp_extract("contents", r"user[^“\"']*[“\"']([^”\"']+)", 1))
    domain = F.when(F.col("indent") == 1, F.regexp_extract("contents", r"([\w-]+(?:\.[\w-]+)+)", 1))
    nz = lambda c: F.when(c != "", c)
    kept = lines.withColumn("_u", nz(user)).withColumn("_d", nz(domain))
    # a new user forgets the domain of the last one
    kept = kept.withColumn("user", F.last("_u", ignorenulls=True).over(w)).withColumn("_n", F.sum(F.col("_u").isNotNull().cast("int")).over(w))
    w2 = Window.partitionBy(file, "_n").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return kept.withColumn("domain", F.last("_d", ignorenulls=True).over(w2)).drop("_u", "_d", "_n")


# --- certificates, names, databases: facts to states ---


def certificate_checks(facts: DataFrame) -> DataFrame:
    """facts (host, names array, not_after, checked_at, issuer, self_signed) -> host, check, state."""
    days = F.datediff("not_after", "checked_at")
    named = F.exists("names", lambda n: host_matches(F.col("host"), n))
    each = F.array(
        F.struct(F.lit("expiry").alias("check"), expiry_state(days).alias("state")),
        F.struct(F.lit("hostname").alias("check"), F.when(F.coalesce(named, F.lit(False)), "pass").otherwise("failure").alias("state")),
        F.struct(F.lit("chain").alias("check"), F.when(F.coalesce("self_signed", F.lit(False)), "failure").otherwise("pass").alias("state")),
    )
    return facts.select("host", F.explode(each).alias("c")).select("host", "c.check", "c.state")


def certificate_inventory(certs: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(certificates that no configuration refers to, sets of names that several certificates share)."""
    orphans = certs.join(references.select("path").distinct(), "path", "left_anti")
    same = certs.groupBy(F.array_sort("names").alias("names")).agg(F.count("*").alias("n"), F.min("path").alias("first")).where("n > 1")
    return orphans, same


def mail_policy(records: DataFrame) -> DataFrame:
    """TXT records (domain, name, value) -> spf and dmarc state per domain."""
    spf = F.col("value").startswith("v=spf1")
    dmarc = F.col("name").startswith("_dmarc") & F.col("value").startswith("v=DMARC1")
    per = records.groupBy("domain").agg(F.count_if(spf).alias("n_spf"), F.max(F.when(spf, F.col("value"))).alias("spf"), F.max(F.when(dmarc, F.regexp_extract("value", r"\bp=(\w+)", 1))).alias("policy"))
    return per.select(
        "domain",
        F.when(F.col("n_spf") == 0, "warning").when(F.col("n_spf") > 1, "failure").when(F.col("spf").rlike(r"\+all"), "failure").when(F.col("spf").rlike(r"[-~]all$"), "pass").otherwise("warning").alias("spf"),
        F.when(F.col("policy").isNull(), "warning").when(F.col("policy") == "none", "warning").otherwise("pass").alias("dmarc"),
    )


def propagation(answers: DataFrame) -> DataFrame:
    """Answers (domain, server, value) -> whether all servers give the same set."""
    per = answers.groupBy("domain", "server").agg(F.array_sort(F.collect_set("value")).alias("v"))
    return per.groupBy("domain").agg(F.count("*").alias("servers"), (F.count_distinct("v") == 1).alias("agree"))


def database_health(metrics: DataFrame) -> DataFrame:
    """metrics (server, connections, max_connections, buffer_reads, buffer_requests, full_scans, queries, disk_tmp, tmp) -> server, check, value, state."""
    pct = lambda a, b: F.when(F.col(b) > 0, F.col(a) * 100.0 / F.col(b))
    hit = 100 - pct("buffer_reads", "buffer_requests")
    rows = [("connections", pct("connections", "max_connections"), 80, 95, True), ("buffer_hit", hit, 99, 95, False), ("full_scans", pct("full_scans", "queries"), 25, 50, True), ("disk_tables", pct("disk_tmp", "tmp"), 25, 50, True)]
    each = F.array(*[F.struct(F.lit(n).alias("check"), v.alias("value"), state(v, w, f, up).alias("state")) for n, v, w, f, up in rows])
    return metrics.select("server", F.explode(each).alias("c")).select("server", "c.*")


def slow_queries(log: DataFrame, since: str, top: int = 20) -> DataFrame:
    """The slowest queries (ts, query_time, sql) since a time."""
    return log.where(F.col("ts") >= F.lit(since).cast("timestamp")).orderBy(F.desc("query_time"), "sql").limit(top)


def authority(records: DataFrame, answers: DataFrame) -> DataFrame:
    """Name servers that the zone names against those that answer: domain, server, state (agrees, orphaned, silent)."""
    named = records.where("type = 'NS'").select("domain", F.lower(F.rtrim("value", F.lit("."))).alias("server")).distinct()
    heard = answers.select("domain", F.lower(F.rtrim("server", F.lit("."))).alias("server")).distinct()
    both = named.withColumn("a", F.lit(True)).join(heard.withColumn("b", F.lit(True)), ["domain", "server"], "full")
    return both.select("domain", "server", F.when(F.col("a").isNull(), "orphaned").when(F.col("b").isNull(), "silent").otherwise("agrees").alias("state"))


def server_health(status: DataFrame, variables: DataFrame) -> DataFrame:
    """Status counters and variables (server, name, value) -> server, check, value, state."""
    both = status.unionByName(variables).groupBy("server").agg(F.map_from_entries(F.collect_set(F.struct(F.lower("name").alias("k"), F.col("value").alias("v")))).alias("m"))
    n = lambda k: F.col("m")[k].try_cast("double")
    pct = lambda a, b: F.when(b > 0, a * 100.0 / b)
    rows = [
        ("connections", pct(n("threads_connected"), n("max_connections")), 80, 95, True),
        ("peak_connections", pct(n("max_used_connections"), n("max_connections")), 85, 100, True),
        ("buffer_hit", 100 - pct(n("innodb_buffer_pool_reads"), n("innodb_buffer_pool_read_requests")), 99, 95, False),
        ("row_lock_waits", n("innodb_row_lock_current_waits"), 10, 50, True),
        ("deadlocks", n("innodb_deadlocks"), 10, 100, True),
        ("open_files", pct(n("open_files"), n("open_files_limit")), 75, 90, True),
        ("full_scans", pct(n("select_scan"), n("com_select")), 25, 50, True),
        ("disk_tables", pct(n("created_tmp_disk_tables"), n("created_tmp_tables")), 25, 50, True),
        ("thread_cache", 100 - pct(n("threads_created"), n("connections")), 90, 50, False),
        ("slow_share", pct(n("slow_queries"), n("questions")), 1, 5, True),
    ]
    each = F.array(*[F.struct(F.lit(k).alias("check"), v.alias("value"), state(v, w, f, up).alias("state")) for k, v, w, f, up in rows])
    return both.select("server", F.explode(each).alias("c")).select("server", "c.*").where("value is not null")


def replication(rows: DataFrame, warn: int = 60, fail: int = 300) -> DataFrame:
    """Replicas with whether they run and how far they are behind."""
    stopped = (F.lower("io_running") != "yes") | (F.lower("sql_running") != "yes")
    return rows.withColumn("state", F.when(F.lower("role") == "source", "pass").when(F.coalesce(stopped, F.lit(True)), "failure").otherwise(state(F.col("seconds_behind"), warn, fail)))
