"""The query catalogue: every operator over the test tables, with its SQL.

Each query is registered with the SQL that gives the same rows; queries that SQL
cannot express have none and are tested against small fixtures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import checks, differences, documents, graphs, joining, profile, scoring, search, sequences, similarity
from ..operators.rules import BUILTIN
from . import control, qlang

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def q(sql: str | None = None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cents(c: Column) -> Column:
    """A sum of money as whole cents, so that the order of summation does not show."""
    return F.sum(F.round(c * 100).cast("bigint"))


# --- flagship ----------------------------------------------------------------------------------------------------

_FLAGSHIP = """select l_orderkey, count(*) as lines, sum(l_quantity::bigint)::bigint as total_qty, max(l_quantity) as max_qty
from lineitem group by l_orderkey having count(*) > 3 and max(l_quantity) between 10 and 40
order by total_qty desc, l_orderkey limit 20"""


@q(_FLAGSHIP)
def q_flagship_stats(spark, d):
    rows, page = control.parse_page("lines>3&max_qty=10..40&sort=-total_qty&limit=20")
    stats = t(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("lines"), F.sum(F.col("l_quantity").cast("bigint")).alias("total_qty"), F.max("l_quantity").alias("max_qty")
    )
    return control.page(qlang.where(stats, rows, qlang.METRICS), page, ["l_orderkey"])


# --- query language ----------------------------------------------------------------------------------------------


def _filter(name: str, table: str, query: str, where: str, columns: str, profile_: qlang.Profile = qlang.DEFAULT, prepare=None, source: str | None = None) -> None:
    def run(spark, d):
        df = t(spark, d, table)
        df = prepare(df) if prepare else df
        return qlang.where(df, query, profile_).select(*[c.strip() for c in columns.split(",")])

    run.__name__ = name
    q(f"select {columns} from {source or table} where {where}")(run)


_filter("q_filter_eq_string", "customer", "c_mktsegment=building", "lower(c_mktsegment) = 'building'", "c_custkey, c_mktsegment")
_filter("q_filter_eq_numeric", "part", "p_size=15", "p_size = 15", "p_partkey, p_size")
_filter("q_filter_ne", "part", "p_brand!=Brand#13", "lower(p_brand) <> 'brand#13'", "p_partkey, p_brand")
_filter("q_filter_null", "documents", "repo=null", "repo is null or lower(repo) = 'null'", "doc_id, repo")
_filter("q_filter_ne_null_matches", "documents", "lang!=en", "lang is null or lower(lang) <> 'en'", "doc_id, lang")
_filter("q_filter_metrics_null_fails", "documents", "lang!=en", "lang is not null and lower(lang) <> 'en'", "doc_id, lang", qlang.METRICS)
_filter("q_filter_ordered", "lineitem", "l_quantity>=49&l_discount<0.02", "l_quantity >= 49 and l_discount < 0.02", "l_orderkey, l_linenumber, l_quantity, l_discount")
_filter("q_filter_range", "lineitem", "l_quantity=10..11", "l_quantity between 10 and 11", "l_orderkey, l_linenumber, l_quantity")
_filter("q_filter_open_range", "lineitem", "l_quantity=..2", "l_quantity <= 2", "l_orderkey, l_linenumber, l_quantity")
_filter("q_filter_range_lexical", "nation", "n_name=NATION_1..NATION_2", "n_name >= 'NATION_1' and n_name <= 'NATION_2'", "n_nationkey, n_name")
_filter("q_filter_wildcard", "part", "p_type=*o*m*", "regexp_matches(lower(p_type), 'o.*m')", "p_partkey, p_type")
_filter("q_filter_regex", "part", "p_name~=^[a-m].*e$", "regexp_matches(p_name, '^[a-m].*e$')", "p_partkey, p_name")
_filter("q_filter_not_regex", "part", "p_name!~[aeiou]{2}", "not regexp_matches(p_name, '[aeiou]{2}')", "p_partkey, p_name")
_filter("q_filter_exists", "documents", "file_path", "file_path is not null and file_path <> ''", "doc_id, file_path")
_filter("q_filter_missing", "documents", "!repo", "repo is null or repo = ''", "doc_id, source")
_filter("q_filter_typo_repair", "part", "p_size=>48", "p_size >= 48", "p_partkey, p_size")
_filter("q_filter_case_sensitive", "customer", "c_mktsegment=building", "c_mktsegment = 'building'", "c_custkey, c_mktsegment", qlang.CODE)
_filter("q_filter_conjunction", "lineitem", "l_quantity>20&l_returnflag=r&l_linestatus!=o&l_tax<=0.03",
        "l_quantity > 20 and lower(l_returnflag) = 'r' and lower(l_linestatus) <> 'o' and l_tax <= 0.03", "l_orderkey, l_linenumber")


@q("select p_partkey from part where list_contains(string_split(p_name, ' '), 'ring') or list_contains(string_split(p_name, ' '), 'bolt')")
def q_filter_list_any(spark, d):
    words = t(spark, d, "part").withColumn("words", F.split("p_name", " "))
    return qlang.where(words, "words~=^(ring|bolt)$").select("p_partkey")


@q("select o_orderkey, o_orderpriority from orders where o_orderpriority in ('1-URGENT', '2-HIGH')")
def q_filter_in_list(spark, d):
    return t(spark, d, "orders").where(qlang.one_of(F.col("o_orderpriority"), "1-URGENT|2-HIGH")).select("o_orderkey", "o_orderpriority")


@q("select p_partkey, p_type from part where regexp_matches(p_type, '^[A-M].*$')")
def q_filter_glob_anchored(spark, d):
    return t(spark, d, "part").where(qlang.glob(F.col("p_type"), "[A-M]*")).select("p_partkey", "p_type")


# --- projections and paging --------------------------------------------------------------------------------------


@q("select o_orderstatus as status, o_orderkey as key, o_orderkey from orders")
def q_project_nested(spark, d):
    nested = t(spark, d, "orders").select("o_orderkey", F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("key"), "o_orderpriority").alias("o"))
    return control.project(nested, "o.status,o.key,o_orderkey,unknown").select("o.*", "o_orderkey")


@q("select doc_id, repo from documents order by repo asc nulls last, doc_id limit 50")
def q_sort_nulls_last_asc(spark, d):
    return control.page(t(spark, d, "documents"), control.Page("repo", False, 50), ["doc_id"]).select("doc_id", "repo")


@q("select doc_id, repo from documents order by repo desc nulls last, doc_id limit 50")
def q_sort_nulls_last_desc(spark, d):
    return control.page(t(spark, d, "documents"), control.Page("repo", True, 50), ["doc_id"]).select("doc_id", "repo")


@q("select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey limit 25 offset 10")
def q_offset_limit(spark, d):
    _, page = control.parse_page("sort=-o_totalprice&limit=25&offset=10")
    return control.page(t(spark, d, "orders"), page, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@q("""select c_custkey, total_available, total_available > 30 as truncated, case when total_available > 30 then 'offset=30' end as next_cursor
from (select c_custkey, count(*) over () as total_available from customer order by c_custkey limit 30)""")
def q_budget_truncate(spark, d):
    return control.budget(t(spark, d, "customer").select("c_custkey"), 30, ["c_custkey"])


@q("select doc_id, case when length(text) > 60 then substr(text, 1, 60) || '...' else text end as text from documents")
def q_shorten_strings(spark, d):
    return control.shorten(t(spark, d, "documents").select("doc_id", "text"), 60)


@q("""select l_orderkey, l_linenumber, row_no::int as row_no from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber) as row_no from lineitem) where row_no between 2 and 3""")
def q_range_slice(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return sequences.numbered_range(rows, ["l_orderkey"], ["l_linenumber"], 2, 3)


# --- profiles and aggregates -------------------------------------------------------------------------------------

_P = "select '{c}' as column_name, count(*) filter ({c} is null or trim({c}::varchar) = '') as missing, floor(count(*) filter ({c} is null or trim({c}::varchar) = '') * 1000 / count(*) + 0.5) / 10 as missing_pct, count(distinct coalesce({c}::varchar, '')) as distinct_count from documents"


@q(" union all ".join(_P.format(c=c) for c in ("lang", "source", "repo", "file_path", "doc_id")))
def q_csv_profile(spark, d):
    return profile.profile_columns(t(spark, d, "documents"), ["lang", "source", "repo", "file_path", "doc_id"])


@q("select 'o_orderkey' as column_name, 'integer' as inferred_type union all select 'o_totalprice', 'float' union all select 'o_orderpriority', 'string' union all select 'nothing', 'unknown'")
def q_infer_type(spark, d):
    text = t(spark, d, "orders").select(F.col("o_orderkey").cast("string"), F.format_string("%.2f", "o_totalprice").alias("o_totalprice"), "o_orderpriority", F.lit("").alias("nothing"))
    return profile.infer_types(text, ["o_orderkey", "o_totalprice", "o_orderpriority", "nothing"])


@q("select nullif(lang, '') as value, count(*) as n from documents group by 1")
def q_value_frequency(spark, d):
    return profile.value_frequency(t(spark, d, "documents"), "lang")


@q("select nullif(value, '') as value, count(*) as n from (select unnest(string_split(p_name, ' ')) as value from part) group by 1")
def q_value_frequency_list(spark, d):
    return profile.value_frequency(t(spark, d, "part").select(F.split("p_name", " ").alias("words")), "words")


@q("select event_type, count(*) as n from events group by event_type")
def q_jsonl_type_histogram(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@q("select key, count(*) as n from (select unnest(json_keys(props)) as key from events) group by key")
def q_json_keys(spark, d):
    return profile.json_keys(t(spark, d, "events"), "props")


@q("select event_id, json_extract_string(props, '$.k') as v from events")
def q_json_path(spark, d):
    return t(spark, d, "events").select("event_id", profile.json_value(F.col("props"), "/k").alias("v"))


@q("select event_id, 'json.' || key as path, json_extract(props, '$.' || key)::varchar as value from (select event_id, props, unnest(json_keys(props)) as key from events)")
def q_gron(spark, d):
    return profile.gron(t(spark, d, "events"), "event_id", "props")


@q("""select l_returnflag, case when sum(n) = 0 then 0.0 else sum(avg_q * n) / sum(n) end as weighted_mean from
(select l_returnflag, l_orderkey, avg(l_quantity) as avg_q, count(*) as n from lineitem group by all) group by l_returnflag""")
def q_weighted_avg(spark, d):
    per = t(spark, d, "lineitem").groupBy("l_returnflag", "l_orderkey").agg(F.avg("l_quantity").alias("avg_q"), F.count("*").alias("n"))
    return profile.weighted_mean(per, "avg_q", "n", ["l_returnflag"])


_LINES = "list_filter(string_split(text, chr(10)), lambda x: {})"


@q("""with l as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
c as (select doc_id, len(ls)::int as total, len(list_filter(ls, lambda x: trim(x, ' ') = ''))::int as empty,
  len(list_filter(ls, lambda x: regexp_matches(x, '^\\s*(#|//|--|/\\*|\\*)')))::int as comments from l)
select doc_id, total, empty, comments, total - empty - comments as code from c""")
def q_line_types(spark, d):
    return profile.line_types(t(spark, d, "documents"), "doc_id", "text")


@q("""select l_suppkey, count(*) as n, count(*) filter (l_returnflag = 'A') as n_a, count(*) filter (l_returnflag = 'N') as n_n, count(*) filter (l_returnflag = 'R') as n_r from lineitem group by l_suppkey""")
def q_pivot_counts(spark, d):
    rows = t(spark, d, "lineitem")
    return profile.pivot_counts(rows, "l_suppkey", "l_returnflag", ["A", "N", "R"]).join(rows.groupBy("l_suppkey").agg(F.count("*").alias("n")), "l_suppkey")


@q("select l_partkey, count(distinct (l_orderkey, l_suppkey)) as callers from lineitem group by l_partkey order by callers desc, l_partkey limit 100")
def q_rank_by_distinct_callers(spark, d):
    ranked = t(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_orderkey", "l_suppkey").alias("callers"))
    return ranked.orderBy(F.desc("callers"), "l_partkey").limit(100)


@q("""select strftime(ts, '%G-W%V') as bucket, count(*) as n, count(distinct user_id) as actors from events group by rollup(strftime(ts, '%G-W%V'))""")
def q_bucket_week(spark, d):
    return profile.timeline(t(spark, d, "events"), "ts", "user_id", "week")


@q("""select strftime(o_orderdate, '%Y-%m') as bucket, count(*) as n, count(distinct o_custkey) as actors from orders group by rollup(strftime(o_orderdate, '%Y-%m'))""")
def q_bucket_month(spark, d):
    return profile.timeline(t(spark, d, "orders"), "o_orderdate", "o_custkey", "month")


@q("""select o_orderpriority, o_orderstatus, count(*) as n, max(o_orderdate) as last_touch,
floor(count(*) / sum(count(*)) over (partition by o_orderpriority) * 10000 + 0.5) / 10000 as share from orders group by o_orderpriority, o_orderstatus""")
def q_ownership_share(spark, d):
    return profile.ownership(t(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "o_orderdate")


@q("""with p as (select l_partkey, l_suppkey, count(*) as n from lineitem group by all),
r as (select *, row_number() over (partition by l_partkey order by n desc, l_suppkey) as r, count(*) over (partition by l_partkey) as actors from p)
select l_partkey, l_suppkey as owner, actors from r where r = 1""")
def q_primary_owner(spark, d):
    return profile.primary_owner(t(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@q("select o_custkey, count(*) as touches from orders where o_orderdate >= timestamp '1997-01-01' group by o_custkey")
def q_churn_since(spark, d):
    return t(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")).groupBy("o_custkey").agg(F.count("*").alias("touches"))


@q("""select l_returnflag, l_linestatus, sum(l_quantity::bigint)::bigint as sum_qty, sum(round(l_extendedprice * 100)::bigint)::bigint as sum_cents, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""")
def q_pricing_summary(spark, d):
    rows = t(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("sum_qty"), cents(F.col("l_extendedprice")).alias("sum_cents"), F.count("*").alias("n"))


# --- joins -------------------------------------------------------------------------------------------------------


@q("select p_partkey, p_name from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)")
def q_uncalled(spark, d):
    calls = t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return joining.unmatched(t(spark, d, "part"), calls, ["p_partkey"]).select("p_partkey", "p_name")


@q("select c_custkey from customer where c_custkey in (select o_custkey from orders)")
def q_used(spark, d):
    orders = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return joining.matched(t(spark, d, "customer"), orders, ["c_custkey"]).select("c_custkey")


@q("""select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45) and not starts_with(p_name, 'a') and p_size > 5""")
def q_unused_skip_rules(spark, d):
    calls = t(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return joining.unmatched(t(spark, d, "part"), calls, ["p_partkey"]).where("not startswith(p_name, 'a') and p_size > 5").select("p_partkey")


@q("select c_custkey, n_name, r_name from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey")
def q_left_lookup(spark, d):
    nations = t(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    regions = t(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return joining.lookup(joining.lookup(t(spark, d, "customer"), nations, ["c_nationkey"]), regions, ["n_regionkey"]).select("c_custkey", "n_name", "r_name")


@q("""select n_name, count(*) as n, sum(round(l_extendedprice * 100)::bigint)::bigint as cents from lineitem join orders on l_orderkey = o_orderkey
join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey group by n_name""")
def q_multi_key_join(spark, d):
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    customers = t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    suppliers = t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    nations = t(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    met = lines.join(orders, "l_orderkey").join(customers, "c_custkey").join(suppliers, ["l_suppkey", "nation"]).join(nations, "nation")
    return met.groupBy("n_name").agg(F.count("*").alias("n"), cents(F.col("l_extendedprice")).alias("cents"))


@q("""select o_orderkey, (select arg_min(name, hi - lo) from (values (8000, 12000, 'early'), (9000, 9400, 'burst'), (9300, 10500, 'late')) v(lo, hi, name)
where date_diff('day', date '1970-01-01', o_orderdate::date) between lo and hi) as name from orders""")
def q_interval_join_tightest(spark, d):
    spans = spark.createDataFrame([(8000, 12000, "early"), (9000, 9400, "burst"), (9300, 10500, "late")], "lo int, hi int, name string")
    orders = t(spark, d, "orders").select("o_orderkey", F.unix_date(F.to_date("o_orderdate")).alias("day"))
    return joining.tightest_interval(orders, F.col("day"), spans, "o_orderkey", 500).select("o_orderkey", "name")


@q("""select event_id, last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as last_purchase from events""")
def q_asof_preceding(spark, d):
    return joining.as_of(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_id", F.col("event_type") == "purchase", "last_purchase").select("event_id", "last_purchase")


@q("""with f as (select distinct n_name, p_brand from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join part on l_partkey = p_partkey where l_quantity > 48),
a as (select list_sort(list(distinct p_brand)) as all_names from f)
select n_name, array_to_string(list_sort(list(p_brand)), ',') as present, array_to_string(list_sort(list_filter(any_value(all_names), lambda x: not list_contains(list(p_brand), x))), ',') as missing from f, a group by n_name""")
def q_cross_matrix(spark, d):
    lines = t(spark, d, "lineitem").where("l_quantity > 48")
    facts = (
        lines.join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("n_name", "p_brand")
    )
    return joining.presence_matrix(facts, "n_name", "p_brand").select("n_name", F.array_join("present", ",").alias("present"), F.array_join("missing", ",").alias("missing"))


@q("""with f as (select distinct source, lang from documents where lang is not null and source is not null), s as (select count(distinct source) as n_sites from f)
select lang, count(*) as n_with, any_value(n_sites) - count(*) as n_without from f, s group by lang having count(*) >= greatest(2, any_value(n_sites) * 0.25)""")
def q_snippet_consistency(spark, d):
    return joining.consistency(t(spark, d, "documents").where("lang is not null and source is not null"), "source", "lang")


@q("""with tails as (select doc_id, unnest(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[i:], '.'))) as ext from (select doc_id, string_split(regexp_extract(file_path, '[^/]*$'), '.') as p from documents where file_path is not null))
select ext, count(*) as n from tails where ext in ('py', 'md', 'rs', 'ts') group by ext""")
def q_suffix_join(spark, d):
    names = t(spark, d, "documents").where("file_path is not null").select("doc_id", F.regexp_extract("file_path", "[^/]*$", 0).alias("name"))
    known = spark.createDataFrame([("py",), ("md",), ("rs",), ("ts",)], "ext string")
    return joining.suffix_match(names, "name", known, "ext").groupBy("ext").agg(F.count("*").alias("n"))


@q("""with h as (select doc_id, sha256(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ')) as h from documents where text is not null and length(text) >= 10)
select doc_id, min(doc_id) over (partition by h) as first_id, count(*) over (partition by h) as copies from h""")
def q_dup_hash(spark, d):
    docs = t(spark, d, "documents").where("text is not null and length(text) >= 10")
    hashed = docs.select("doc_id", F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256).alias("h"))
    per = hashed.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return hashed.join(per, "h").select("doc_id", "first_id", "copies")


@q("select sha256(p_name) as h, count(distinct p_brand) as n from part group by 1 having count(distinct p_brand) >= 3")
def q_literal_cluster(spark, d):
    return t(spark, d, "part").groupBy(F.sha2("p_name", 256).alias("h")).agg(F.count_distinct("p_brand").alias("n")).where("n >= 3")


# --- sequences ---------------------------------------------------------------------------------------------------


@q("select event_id, sum(round(value * 100)::bigint) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as running from events")
def q_running_sum(spark, d):
    return sequences.running_sum(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.round(F.col("value") * 100).cast("bigint"), "running").select("event_id", "running")


@q("""with a as (select *, case when event_type is not distinct from lag(event_type) over w and row_number() over w > 1 then 0 else 1 end as n from events window w as (partition by user_id order by ts, event_id)),
b as (select *, sum(n) over (partition by user_id order by ts, event_id) as island from a)
select user_id, island::bigint as island, event_type, count(*) as run_length from b group by all""")
def q_islands(spark, d):
    return sequences.islands(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@q("""select event_id, event_type, previous from (select event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as previous from events) where event_type is distinct from previous""")
def q_change_detect(spark, d):
    return sequences.changes(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "event_type", "previous")


@q("""with a as (select *, sum(case when event_type = 'view' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as exchange from events)
select user_id, exchange::bigint as exchange, max(case when event_type = 'view' then event_id end) as prompt, arg_max(case when event_type = 'purchase' then event_id end, case when event_type = 'purchase' then row(ts, event_id) end) as reply
from a where exchange > 0 group by user_id, exchange""")
def q_pair_exchange(spark, d):
    kind = F.col("event_type")
    return sequences.pair_exchanges(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], kind == "view", kind == "purchase", "event_id")


@q("""select event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as session_start from events""")
def q_fill_forward(spark, d):
    marked = t(spark, d, "events").withColumn("mark", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return sequences.fill_forward(marked, ["user_id"], ["ts", "event_id"], "mark", "session_start").select("event_id", "session_start")


@q("""select event_id, coalesce(max(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between 10 preceding and 1 preceding) = 1, false) as bought_before from events""")
def q_prev10_window(spark, d):
    return sequences.within_previous(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", 10, "bought_before").select("event_id", "bought_before")


@q("""select o_custkey, o_orderkey, rank::int as rank from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 3""")
def q_top3_per_group(spark, d):
    return sequences.top_per_group(t(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


# --- differences -------------------------------------------------------------------------------------------------

_YEAR = "select o_custkey, count(*) as lines, max(o_orderpriority) as sig, count(distinct o_orderstatus) as cx from orders where year(o_orderdate) = {} group by o_custkey"
_DIFF = f"""with l as ({_YEAR.format(1995)}), r as ({_YEAR.format(1996)}),
j as (select coalesce(l.o_custkey, r.o_custkey) as o_custkey, case when l.o_custkey is null then 'added' when r.o_custkey is null then 'removed'
when l.sig is distinct from r.sig or abs(r.cx - l.cx) >= 2 or (l.lines > 0 and abs(r.lines - l.lines) / l.lines >= 0.10) then 'modified' end as change from l full join r on l.o_custkey = r.o_custkey)"""


def _year(spark, d, year):
    rows = t(spark, d, "orders").where(F.year("o_orderdate") == year)
    return rows.groupBy("o_custkey").agg(F.count("*").alias("lines"), F.max("o_orderpriority").alias("sig"), F.count_distinct("o_orderstatus").alias("cx"))


def _yearly_diff(spark, d):
    test = differences.element_modified(F.col("l.lines"), F.col("r.lines"), F.col("l.cx"), F.col("r.cx"), F.col("l.sig"), F.col("r.sig"))
    return differences.diff(_year(spark, d, 1995), _year(spark, d, 1996), ["o_custkey"], test).select("o_custkey", "change")


@q(f"{_DIFF} select o_custkey, change from j where change is not null")
def q_diff_full_outer(spark, d):
    return _yearly_diff(spark, d)


@q(f"{_DIFF} select change, count(*) as n from j where change is not null group by change")
def q_diff_counts(spark, d):
    return _yearly_diff(spark, d).groupBy("change").agg(F.count("*").alias("n"))


@q("""with a as (select distinct l_partkey, l_suppkey from lineitem where l_shipdate < timestamp '1995-01-01'), b as (select distinct l_partkey, l_suppkey from lineitem where l_shipdate >= timestamp '1995-01-01')
select *, 'left' as side from (select * from a except select * from b) union all select *, 'right' as side from (select * from b except select * from a)""")
def q_diff_set(spark, d):
    rows = t(spark, d, "lineitem")
    cut = F.lit("1995-01-01").cast("timestamp")
    pair = lambda c: rows.where(c).select("l_partkey", "l_suppkey")
    return differences.set_difference(pair(F.col("l_shipdate") < cut), pair(F.col("l_shipdate") >= cut))


@q("""with a as (select o_custkey, count(*) as base_n from orders where o_orderstatus = 'F' group by 1), b as (select o_custkey, count(*) as head_n from orders where o_orderstatus = 'O' group by 1)
select coalesce(a.o_custkey, b.o_custkey) as o_custkey, base_n, head_n from a full join b on a.o_custkey = b.o_custkey where base_n is distinct from head_n""")
def q_diff_count_delta(spark, d):
    rows = t(spark, d, "orders")
    return differences.count_delta(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus = 'O'"), "o_custkey")


@q("select o_custkey, arg_max(o_orderstatus, o_orderkey) as o_orderstatus from orders group by o_custkey")
def q_last_by_key(spark, d):
    return differences.last_by_key(t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderstatus")


# --- graphs ------------------------------------------------------------------------------------------------------

_EDGES = """select c_nationkey as src, s_nationkey as dst, l_quantity as qty from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey"""
#: The strong ties: pairs with more calls than one deviation above the mean.
_SPARSE = f"""(select src, dst from (select *, avg(n) over () + stddev_samp(n) over () as least from (select src, dst, count(*) as n from ({_EDGES}) where src <> dst group by src, dst)) where n > least)"""


def _calls(spark, d):
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("src"))
    suppliers = t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst"))
    return lines.join(orders, "l_orderkey").join(customers, "o_custkey").join(suppliers, "l_suppkey").select("src", "dst")


def _sparse(spark, d):
    edges = graphs.file_edges(_calls(spark, d), "src", "dst")
    least = edges.agg((F.avg("n") + F.stddev_samp("n")).alias("least"))  # one row
    return edges.join(F.broadcast(least), F.col("n") > F.col("least")).select("src", "dst")


@q(f"select src, dst, count(*) as n from ({_EDGES}) where src <> dst group by src, dst")
def q_module_graph(spark, d):
    return graphs.file_edges(_calls(spark, d), "src", "dst")


@q(f"""with e as {_SPARSE}, n as (select src as node from e union select dst from e)
select node, (select count(*) from e where dst = node) as fan_in, (select count(*) from e where src = node) as fan_out from n""")
def q_fan_in_out(spark, d):
    return graphs.degrees(_sparse(spark, d))


@q("""with e as (select distinct 's' || l_suppkey as src, 'p' || l_partkey as dst from lineitem), n as (select src as node from e union select dst from e)
select node, coalesce(i, 0) as fan_in, coalesce(o, 0) as fan_out from n left join (select dst, count(*) as i from e group by 1) on node = dst left join (select src, count(*) as o from e group by 1) on node = src""")
def q_degrees_trade(spark, d):
    """Over all of a graph that grows with the data."""
    name = lambda c, p: F.concat(F.lit(p), F.col(c).cast("string"))
    return graphs.degrees(t(spark, d, "lineitem").select(name("l_suppkey", "s").alias("src"), name("l_partkey", "p").alias("dst")).distinct())


@q(f"select n_nationkey as node from nation where n_nationkey not in (select dst from {_SPARSE})")
def q_entrypoints(spark, d):
    return graphs.entrypoints(_sparse(spark, d), t(spark, d, "nation").select(F.col("n_nationkey").alias("node")))


@q(f"""with e as (select a.n_regionkey as a, b.n_regionkey as b from {_SPARSE} e join nation a on src = a.n_nationkey join nation b on dst = b.n_nationkey),
x as (select a as component, count(*) filter (a = b) as internal, count(*) filter (a <> b) as outgoing from e group by a),
y as (select b as component, count(*) as incoming from e where a <> b group by b)
select coalesce(x.component, y.component) as component, coalesce(internal, 0) as internal, coalesce(outgoing, 0) as outgoing, coalesce(incoming, 0) as incoming,
case when coalesce(internal, 0) + coalesce(outgoing, 0) = 0 then 0.0 else floor(internal / (internal + outgoing) * 1000 + 0.5) / 1000 end as cohesion from x full join y on x.component = y.component""")
def q_components(spark, d):
    of = t(spark, d, "nation").select("n_nationkey", "n_regionkey")
    e = _sparse(spark, d).join(of.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("a")), "src").join(of.select(F.col("n_nationkey").alias("dst"), F.col("n_regionkey").alias("b")), "dst")
    return graphs.components(e, F.col("a"), F.col("b"))


_CLOSURE = """with recursive e as {e}, c(node, level) as (select n_nationkey, 0 from nation where n_regionkey = {s} union select {b}, level + 1 from c join e on {a} = node where level < {n})
select node, min(level) as level from c group by node having min(level) > 0"""


@q(_CLOSURE.format(e=_SPARSE, s=1, a="dst", b="src", n=3))
def q_callers_depth3(spark, d):
    return graphs.closure(_sparse(spark, d), t(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("node")), 3, backwards=True)


@q(_CLOSURE.format(e=_SPARSE, s=1, a="src", b="dst", n=2))
def q_callees_depth2(spark, d):
    return graphs.closure(_sparse(spark, d), t(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("node")), 2)


_REACH = f"""with recursive e as {_SPARSE}, r(a, b) as (select src, dst from e union select a, dst from r join e on b = src),
s as (select x.a as node, min(x.b) as component from r x join r y on x.a = y.b and x.b = y.a group by x.a)"""
_SCC = f"{_REACH}, g as (select component from s group by component having count(*) > 1) select node, component from s where component in (select component from g)"


@q(_SCC)
def q_scc(spark, d):
    return graphs.strong_components(_sparse(spark, d))


@q(f"{_REACH} select src, dst from e join s a on src = a.node join s b on dst = b.node where a.component = b.component and src <> dst")
def q_cycle_edges(spark, d):
    return graphs.cycle_edges(_sparse(spark, d))


@q()
def q_pagerank30(spark, d):
    return graphs.personal_rank(_sparse(spark, d), t(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("node")))


@q(f"select src, dst from {_SPARSE} e join nation a on src = a.n_nationkey join nation b on dst = b.n_nationkey where (a.n_regionkey, b.n_regionkey) in ((0, 1), (2, 3))")
def q_layer_violations(spark, d):
    layers = t(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("layer"))
    rules = spark.createDataFrame([(0, 1), (2, 3)], "layer int, forbidden int")
    return graphs.layer_violations(_sparse(spark, d), layers, rules).select("src", "dst")


# --- search ------------------------------------------------------------------------------------------------------

_OCC = "((length({c}) - length(replace(lower({c}), '{t}', ''))) // {n})"


@q("""with h as (select doc_id, text, array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\\s{0,3}#{1,6}\\s')), chr(10)) as hd from documents where contains(lower(text), 'parser') and contains(lower(text), 'cache'))
select doc_id, """ + " + ".join(_OCC.format(c=c, t=x, n=len(x)) + w for x in ("parser", "cache") for c, w in (("text", ""), ("hd", " * 3"))) + """ as score from h""")
def q_relevance_rank(spark, d):
    return search.search(t(spark, d, "documents"), "text", ["parser", "cache"]).select("doc_id", "score")


@q("""select doc_id, case when p - 40 > 1 then '...' else '' end || substr(text, greatest(1, p - 40)::int, (least(length(text), p + 5 + 40) - greatest(1, p - 40) + 1)::int) || case when p + 5 + 40 < length(text) then '...' else '' end as excerpt
from (select doc_id, text, strpos(lower(text), 'parser') as p from documents) where p > 0""")
def q_excerpt(spark, d):
    return t(spark, d, "documents").where("contains(lower(text), 'parser')").select("doc_id", T.excerpt(F.col("text"), "parser").alias("excerpt"))


@q("select doc_id from documents where regexp_matches(lower(text), '\\bcache\\b')")
def q_whole_word(spark, d):
    return search.word_hits(t(spark, d, "documents"), "text", "cache").select("doc_id")


@q("""select doc_id, i::int as line_no, line from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where regexp_matches(line, '^def [a-z_]+\\(')""")
def q_grep_lines(spark, d):
    return search.grep(t(spark, d, "documents"), "doc_id", "text", r"^def [a-z_]+\(")


@q("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
h as (select *, last_value(case when regexp_matches(line, '^#{1,6}\\s') then regexp_replace(line, '^#{1,6}\\s+', '') end ignore nulls) over (partition by doc_id order by i rows unbounded preceding) as heading from l)
select doc_id, heading, i::int as line_no, line from h where regexp_matches(line, '^\\| [A-Z][0-9]+ ')""")
def q_grep_by_heading(spark, d):
    return search.nearest_heading(t(spark, d, "documents"), "doc_id", "text", r"^\| [A-Z][0-9]+ ")


@q("""select doc_id, i::int as line_no, length(regexp_extract(line, '^(#+)', 1))::int as level, trim(regexp_replace(line, '^#+ ', ''), ' ') as title
from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where regexp_matches(line, '^#{1,6} \\S')""")
def q_heading_levels(spark, d):
    return search.headings(t(spark, d, "documents"), "doc_id", "text")


@q("""select doc_id, i::int as line_no, length(line)::int as line_length from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where length(line) > 100""")
def q_long_lines(spark, d):
    return search.long_lines(t(spark, d, "documents"), "doc_id", "text")


@q("""with u as (select doc_id, unnest(regexp_extract_all(text, 'https?://[A-Za-z0-9./_-]+')) as url from documents)
select doc_id, url, string_split(url, '://')[1] as scheme, regexp_extract(url, '://([A-Za-z0-9._-]+)', 1) as host from u""")
def q_url_links(spark, d):
    return search.links(t(spark, d, "documents"), "doc_id", "text")


@q("""select host, count(*) as n from (select regexp_extract(unnest(regexp_extract_all(text, 'https?://[A-Za-z0-9./_-]+')), '://([A-Za-z0-9._-]+)', 1) as host from documents) group by host""")
def q_link_hosts(spark, d):
    return search.links(t(spark, d, "documents"), "doc_id", "text").groupBy("host").agg(F.count("*").alias("n"))


@q("""select case when not starts_with(text, '---' || chr(10)) then 'missing' when regexp_matches(text, '^---\\n(?s:.*?)\\n---(\\n|$)') then 'ok' else 'malformed' end as state, count(*) as n from documents where text is not null group by 1""")
def q_front_matter(spark, d):
    docs = t(spark, d, "documents").where("text is not null")
    return docs.groupBy(search.front_matter_state(F.col("text")).alias("state")).agg(F.count("*").alias("n"))


# --- sessions ----------------------------------------------------------------------------------------------------

_MSG = "(select distinct on (uuid) * from session_messages)"
_ROLE = "case when lower(trim({c})) in ('user', 'human') then 'user' when lower(trim({c})) in ('assistant', 'model', 'ai', 'bot') then 'assistant' when lower(trim({c})) in ('system', 'developer') then 'system' end"
_R = f"coalesce({_ROLE.format(c='message.role')}, {_ROLE.format(c='record_type')})"


def _messages(spark, d, *columns):
    return t(spark, d, "session_messages").select("uuid", *columns).dropDuplicates(["uuid"])


@q(f"select {_R} as role, count(*) as n from {_MSG} group by 1")
def q_role_counts(spark, d):
    from ..functions.transcripts import clean_role

    rows = _messages(spark, d, clean_role(F.col("message.role"), F.col("record_type")).alias("role"))
    return rows.groupBy("role").agg(F.count("*").alias("n"))


@q(f"select b.type as block_type, count(*) as n, coalesce(sum(length(b.text)), 0)::bigint as chars from (select unnest(message.content) as b from {_MSG}) group by 1")
def q_block_sizes(spark, d):
    blocks = _messages(spark, d, "message.content").select(F.explode("content").alias("b"))
    return blocks.groupBy(F.col("b.type").alias("block_type")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("b.text").cast("bigint")), F.lit(0)).alias("chars"))


@q(f"select lower(trim(b.name)) as tool, count(*) as n from (select unnest(message.content) as b from {_MSG}) where b.type = 'tool_use' group by 1")
def q_tool_histogram(spark, d):
    from ..functions.transcripts import clean_tool

    blocks = _messages(spark, d, "message.content").select(F.explode("content").alias("b")).where("b.type = 'tool_use'")
    return blocks.groupBy(clean_tool(F.col("b.name")).alias("tool")).agg(F.count("*").alias("n"))


@q(f"""with b as (select session_id, unnest(message.content) as b from {_MSG}),
u as (select session_id, b.id as id, lower(trim(b.name)) as tool from b where b.type = 'tool_use'),
r as (select session_id, b.tool_use_id as id, coalesce(b.is_error, false) as failed from b where b.type = 'tool_result')
select tool, count(*) filter (not failed) as n_ok, count(*) filter (failed) as n_failed, floor(count(*) filter (not failed) * 1000 / count(*) + 0.5) / 10 as rate
from u join r on u.session_id = r.session_id and u.id = r.id group by tool""")
def q_tool_success_rate(spark, d):
    from ..functions.transcripts import clean_tool

    blocks = _messages(spark, d, "session_id", "message.content").select("session_id", F.explode("content").alias("b"))
    uses = blocks.where("b.type = 'tool_use'").select("session_id", F.col("b.id").alias("id"), clean_tool(F.col("b.name")).alias("tool"))
    results = blocks.where("b.type = 'tool_result'").select("session_id", F.col("b.tool_use_id").alias("id"), F.coalesce("b.is_error", F.lit(False)).alias("failed"))
    ok = F.count_if(~F.col("failed"))
    return uses.join(results, ["session_id", "id"]).groupBy("tool").agg(ok.alias("n_ok"), F.count_if("failed").alias("n_failed"), (F.floor(ok * 1000 / F.count("*") + 0.5) / 10).alias("rate"))


@q(f"""select session_id, count(*) as hits from (select session_id, unnest(message.content) as b from {_MSG}) where contains(lower(b.text), 'scheduler') or contains(lower(b.content), 'scheduler') group by session_id""")
def q_session_search(spark, d):
    blocks = _messages(spark, d, "session_id", "message.content").select("session_id", F.explode("content").alias("b"))
    hit = F.coalesce(F.contains(F.lower("b.text"), F.lit("scheduler")), F.lit(False)) | F.coalesce(F.contains(F.lower("b.content"), F.lit("scheduler")), F.lit(False))
    return blocks.where(hit).groupBy("session_id").agg(F.count("*").alias("hits"))


@q(f"""select s.session_id, s.title, count(m.uuid) as n_messages, count(distinct m.cwd) as n_dirs from sessions s left join {_MSG} m on s.session_id = m.session_id group by s.session_id, s.title""")
def q_session_overview(spark, d):
    per = _messages(spark, d, "session_id", "cwd").groupBy("session_id").agg(F.count("uuid").alias("n_messages"), F.count_distinct("cwd").alias("n_dirs"))
    return t(spark, d, "sessions").select("session_id", "title").join(per, "session_id", "left").select("session_id", "title", F.coalesce("n_messages", F.lit(0)).alias("n_messages"), F.coalesce("n_dirs", F.lit(0)).alias("n_dirs"))


@q(f"""select session_id, file, count(*) as n from (select session_id, json_extract_string(b.input, '$.file_path') as file from (select session_id, unnest(message.content) as b from {_MSG}) where b.type = 'tool_use') where file is not null group by all""")
def q_files_touched(spark, d):
    blocks = _messages(spark, d, "session_id", "message.content").select("session_id", F.explode("content").alias("b")).where("b.type = 'tool_use'")
    return blocks.select("session_id", profile.json_value(F.col("b.input"), "/file_path").alias("file")).where("file is not null").groupBy("session_id", "file").agg(F.count("*").alias("n"))


# --- scores ------------------------------------------------------------------------------------------------------

_S = """select l_suppkey, avg(l_quantity) as avg_cx, avg(l_extendedprice) / 100 as avg_len, count(*) filter (l_quantity > 40) as long_n, count(*) filter (l_discount > 0.08) as deep_n, count(*) as total from lineitem group by l_suppkey"""
_CAP = "least(greatest({}, 0.0), {}.0)"
_QUALITY = f"""select *, greatest(100.0 - {_CAP.format('(avg_cx - 10) * 3', 30)} - {_CAP.format('(avg_len - 50) / 2', 20)} - {_CAP.format('long_n / total * 50', 25)} - {_CAP.format('deep_n / total * 50', 25)}, 0.0) as quality from ({_S})"""


def _quality(spark, d):
    per = t(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.avg("l_quantity").alias("avg_cx"), (F.avg("l_extendedprice") / 100).alias("avg_len"), F.count_if(F.col("l_quantity") > 40).alias("long_n"), F.count_if(F.col("l_discount") > 0.08).alias("deep_n"), F.count("*").alias("total")
    )
    c = F.col
    return per.withColumn("quality", scoring.quality(c("avg_cx"), c("avg_len"), c("long_n"), c("deep_n"), c("total")))


@q(f"select l_suppkey, floor(quality * 1000 + 0.5) as quality from ({_QUALITY})")
def q_quality_score(spark, d):
    return _quality(spark, d).select("l_suppkey", F.floor(F.col("quality") * 1000 + 0.5).cast("double").alias("quality"))


@q(f"""select l_suppkey, floor(score * 10 + 0.5) / 10 as score from (select l_suppkey, case when quality < 70 then (70 - quality) / 10 else 0 end + case when avg_cx > 10 then avg_cx - 10 else 0 end + 5 * long_n + 3 * deep_n + case when total > 20 then 0.2 * (total - 20) else 0 end as score from ({_QUALITY})) where score > 0 order by score desc, l_suppkey limit 10""")
def q_hotspot_top10(spark, d):
    c = F.col
    scored = _quality(spark, d).withColumn("score", scoring.hotspot(c("quality"), c("avg_cx"), c("long_n"), c("deep_n"), c("total")))
    return scored.where("score > 0").orderBy(F.desc("score"), "l_suppkey").limit(10).select("l_suppkey", (F.floor(c("score") * 10 + 0.5) / 10).alias("score"))


@q("""select source, score::double as score from (select source, n + 0.5 * greatest(n - 10, 0) + 0.5 * private + greatest(most - 3, 0) as score from (select source, sum(k)::bigint as n, sum(case when repo is null then k else 0 end)::bigint as private, max(k) as most from (select source, repo, count(*) as k from documents group by all) group by source))""")
def q_patch_groups(spark, d):
    per = t(spark, d, "documents").groupBy("source", "repo").agg(F.count("*").alias("k"))
    g = per.groupBy("source").agg(F.sum("k").alias("n"), F.coalesce(F.sum(F.when(F.col("repo").isNull(), F.col("k"))), F.lit(0)).alias("private"), F.max("k").alias("most"))
    return g.select("source", scoring.pressure(F.col("n"), F.col("private"), F.col("most")).alias("score"))


@q("""with recursive p as (select l_orderkey, l_linenumber, l_quantity::bigint as cost, row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber) as r from lineitem),
k(l_orderkey, r, used, kept, l_linenumber) as (select l_orderkey, r, case when cost <= 60 then cost else 0 end, cost <= 60, l_linenumber from p where r = 1
union all select p.l_orderkey, p.r, case when k.used + p.cost <= 60 then k.used + p.cost else k.used end, k.used + p.cost <= 60, p.l_linenumber from k join p on p.l_orderkey = k.l_orderkey and p.r = k.r + 1)
select l_orderkey, l_linenumber::bigint as l_linenumber, max(used) over (partition by l_orderkey) as used from k qualify kept""")
def q_pack_budget(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", (-F.col("l_quantity")).alias("rank"), "l_linenumber", F.col("l_quantity").cast("bigint").alias("cost"))
    return scoring.fit_budgets(rows, ["l_orderkey"], ["rank", "l_linenumber"], "cost", 60)


@q("""select p_partkey, case when n >= 15 then 5 when n >= 5 then 3 when n >= 1 then 1 else 0 end + case when p_size > 40 then 10 else 0 end - case when p_name like 'a%' then 3 else 0 end as priority
from (select p_partkey, p_size, p_name, (select count(distinct l_suppkey) from lineitem where l_partkey = p_partkey) as n from part)""")
def q_pack_priority(spark, d):
    fan_in = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count_distinct("l_suppkey").alias("n"))
    parts = t(spark, d, "part").join(fan_in, "p_partkey", "left").na.fill({"n": 0})
    return parts.select("p_partkey", (scoring.fan_in_bonus(F.col("n")) + F.when(F.col("p_size") > 40, 10).otherwise(0) - F.when(F.col("p_name").startswith("a"), 3).otherwise(0)).alias("priority"))


# --- checks and rules --------------------------------------------------------------------------------------------

_STATE = "case when s_acctbal is null then 'warning' when s_acctbal <= 0 then 'failure' when s_acctbal <= 2000 then 'warning' else 'pass' end"


@q(f"select s_suppkey, {_STATE} as state from supplier")
def q_health_thresholds(spark, d):
    return t(spark, d, "supplier").select("s_suppkey", checks.state(F.col("s_acctbal"), 2000, 0, above=False).alias("state"))


@q(f"""select s_nationkey, count(*) filter (state = 'pass') as n_pass, count(*) filter (state = 'warning') as n_warning, count(*) filter (state = 'failure') as n_failure,
case when bool_or(state = 'failure') then 'failure' when bool_or(state = 'warning') then 'warning' else 'pass' end as overall from (select s_nationkey, {_STATE} as state from supplier) group by s_nationkey""")
def q_worst_status(spark, d):
    states = t(spark, d, "supplier").select("s_nationkey", checks.state(F.col("s_acctbal"), 2000, 0, above=False).alias("state"))
    return checks.summary(states, ["s_nationkey"])


@q("select user_id, event_type, count(*) as n from events group by rollup(user_id, event_type)")
def q_status_user_rollup(spark, d):
    return checks.status_rollup(t(spark, d, "events"), "user_id", "event_type")


_RULE_LINES = "(select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as line from documents)"
_RULES = f"""select doc_id, line::int as line, rule_code, severity from (
select doc_id, line, 'E501' as rule_code, 'low' as severity from {_RULE_LINES} where length(rtrim(l, ' ')) > 100 and not regexp_matches(l, 'http://|https://|ftp://|# noqa|# type:')
union all select doc_id, line, 'M501', 'low' from {_RULE_LINES} where regexp_matches(l, '\\b(TODO|FIXME|HACK|XXX)\\b')
union all select doc_id, line, 'U501', 'low' from {_RULE_LINES} where regexp_matches(l, '(?i)http://(www\\.)?github\\.com/[^\\s''"<>]+|http://[a-z0-9-]+\\.github\\.(com|io)/[^\\s''"<>]+')
union all select doc_id, line, 'X108', 'low' from {_RULE_LINES} where regexp_matches(l, '[ \\t]+$')
union all select doc_id, 1, 'M101', case when n > 1000 then 'high' else 'medium' end from (select doc_id, len(string_split(text, chr(10))) as n from documents where text is not null) where n > 500
union all select doc_id, 1, 'X110', 'low' from documents where trim(text, ' ') = '')"""


def _findings(spark, d, **chosen):
    return checks.run_rules(t(spark, d, "documents").where("text is not null"), "doc_id", "text", BUILTIN.chosen(**chosen))


@q(_RULES)
def q_rules_union(spark, d):
    return _findings(spark, d, select="E501,M501,U501,X108,M101,X110").select("doc_id", "line", "rule_code", "severity")


@q(f"select severity, count(*) as n from ({_RULES}) group by severity")
def q_severity_counts(spark, d):
    return _findings(spark, d, select="E501,M501,U501,X108,M101,X110").groupBy("severity").agg(F.count("*").alias("n"))


@q(f"select doc_id, line, rule_code, severity from ({_RULES}) where severity <> 'low'")
def q_severity_min(spark, d):
    return _findings(spark, d, select="E501,M501,U501,X108,M101,X110", least="medium").select("doc_id", "line", "rule_code", "severity")


@q()
def q_rules_all(spark, d):
    """All built-in rules; some patterns look ahead, which the SQL dialect cannot."""
    return _findings(spark, d)


@q("""select doc_id, i::int as line from (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where regexp_matches(l, '(?i)(api[_-]?key|secret|token|passwd|password)\\s*[:=]\\s*[''"][^''"]{8,}[''"]')
and not regexp_matches(regexp_extract(l, '(?i)(api[_-]?key|secret|token|passwd|password)\\s*[:=]\\s*[''"][^''"]{8,}[''"]'), '(?i)[''"](?:[^''"]*(?:test|example|placeholder|dummy|fake|sample|none|null|todo|fixme|changeme|replace[_-]me|insert[_-]here|not[-_]?set|development|undefined)[^''"]*|[a-z_]+|[a-z][a-z0-9+.-]*://[^''"]*)[''"]')""")
def q_secret_scan(spark, d):
    return _findings(spark, d, select="S001").select("doc_id", "line")


_PATH = "coalesce(file_path, 'notes/' || doc_id || '.md')"
_LINKS = rf"""(select doc_id, path, i as line, unnest(regexp_extract_all(l, '\[[^\]]+\]\(([^)]+)\)', 1)) as target
from (select doc_id, {_PATH} as path, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i
from (select doc_id, file_path, regexp_replace(text, '\b((?:\w+/)+\w+\.\w{{1,5}})\b', '[\1](/\1)', 'g') as text from documents)))"""


def _files(spark, d):
    """Documents as files; those without a path as notes."""
    return t(spark, d, "documents").select("doc_id", F.coalesce("file_path", F.concat(F.lit("notes/"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), "text")


def _linked(spark, d):
    """The paths that documents name as links."""
    return _files(spark, d).withColumn("text", F.regexp_replace("text", r"\b((?:\w+/)+\w+\.\w{1,5})\b", "[$1](/$1)"))


@q(f"select path, line::int as line, target, count(*) as n from {_LINKS} group by all")
def q_link_targets(spark, d):
    return documents.links(_linked(spark, d)).groupBy("path", "line", "target").agg(F.count("*").alias("n"))


@q(r"""select path, n::int as references, count(*) as copies from (select file_path as path, len(list_filter(regexp_extract_all(coalesce(text, ''), '\[[^\]]+\]\(([^)]+)\)', 1), lambda x: contains(x, '.md') and not starts_with(x, 'http') and regexp_extract(x, '([^/]*)$', 1) <> regexp_extract(file_path, '([^/]*)$', 1))) as n
from documents where regexp_matches(file_path, '(^|/)docs/') and regexp_matches(file_path, '\.(md|markdown)$') and regexp_extract(file_path, '([^/]*)$', 1) not in ('README.md', 'INDEX.md', 'CHANGELOG.md', 'LICENSE.md')) where n < 2 group by all""")
def q_few_references(spark, d):
    return documents.few_references(_files(spark, d)).groupBy("path", "references").agg(F.count("*").alias("copies"))


@q(r"""with p as (select distinct file_path as path, regexp_extract(file_path, '^((?:.*?/)?docs)/', 1) as folder from documents where regexp_matches(file_path, '(^|/)docs/')),
r as (select path, folder, substring(path, length(folder) + 2) as rest from p)
select folder, min(path) filter (ends_with(rest, '.md')) as path from r where not contains(rest, '/') group by folder having not bool_or(rest in ('README.md', 'INDEX.md')) and count(*) filter (ends_with(rest, '.md')) > 0""")
def q_missing_indexes(spark, d):
    return documents.missing_indexes(_files(spark, d))


@q(rf"""with l as (select distinct path, line, target, regexp_replace(string_split(trim(target), ' ')[1], '[#?].*$', '') as bare from {_LINKS} where regexp_matches(path, '\.(md|markdown)$') and not regexp_matches(target, '^([a-zA-Z][a-zA-Z0-9+.-]*:|//|#|\s*$)')),
j as (select *, list_filter(string_split(case when starts_with(bare, '/') then bare else regexp_extract(path, '^(.*?)/?[^/]*$', 1) || '/' || bare end, '/'), lambda x: x not in ('', '.')) as parts from l where bare <> ''),
known as (select distinct {_PATH} as p from documents)
select path, line::int as line, target from j where not list_contains(parts, '..') and array_to_string(parts, '/') not in (select p from known)
and not exists (select 1 from known where starts_with(p, array_to_string(parts, '/') || '/'))""")
def q_broken_links(spark, d):
    """Links without ``..``, which the SQL leaves out; those are tested on a fixture."""
    broken = documents.broken_links(_linked(spark, d)).where(~F.contains(F.concat(F.lit("/"), F.regexp_replace(F.split("target", " ")[0], r"[#?].*$", ""), F.lit("/")), F.lit("/../")))
    return broken.select("path", "line", "target").distinct()


# --- scalar functions --------------------------------------------------------------------------------------------


@q("""select c_custkey, string_split(regexp_replace(c_name, '<.*$', ''), '#')[1] as base, lower(regexp_replace(regexp_replace('Customer' || c_mktsegment, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '([a-z\\d])([A-Z])', '\\1_\\2', 'g')) as snake from customer""")
def q_bare_and_snake(spark, d):
    return t(spark, d, "customer").select("c_custkey", T.bare_name(F.regexp_replace("c_name", "#.*$", "")).alias("base"), T.camel_to_snake(F.concat(F.lit("Customer"), "c_mktsegment")).alias("snake"))


@q("""select p_partkey, case when regexp_matches(p_type, '(?i)(promo|small)') then '***' else p_name end as shown from part""")
def q_redact(spark, d):
    return t(spark, d, "part").select("p_partkey", F.when(F.col("p_type").rlike("(?i)(promo|small)"), "***").otherwise(F.col("p_name")).alias("shown"))


@q("""select o_orderkey, case when upper(o_orderpriority) like '1%' or upper(o_orderpriority) like '2%' then 'rush' when upper(o_orderpriority) like '3%' then 'normal' else 'other' end as category from orders""")
def q_categorize(spark, d):
    return t(spark, d, "orders").select("o_orderkey", T.categorize(F.col("o_orderpriority"), {"rush": ("1", "2"), "normal": ("3",)}).alias("category"))


@q("""select doc_id, 1 + len(regexp_extract_all(text, '\\b(if|elif|else if|for|while|case|catch|except|and|or)\\b|&&|\\|\\|')) as complexity from documents where text is not null""")
def q_complexity(spark, d):
    return t(spark, d, "documents").where("text is not null").select("doc_id", T.complexity(F.col("text")).alias("complexity"))


@q("""select lower(regexp_extract(file_path, '\\.(\\w+)$', 1)) as ext, count(*) as n from documents where file_path is not null group by 1""")
def q_language_breakdown(spark, d):
    docs = t(spark, d, "documents").where("file_path is not null")
    return docs.groupBy(F.lower(F.regexp_extract("file_path", r"\.(\w+)$", 1)).alias("ext")).agg(F.count("*").alias("n"))


@q("""select vec_id, case when date_diff('second', timestamp '2020-01-01', timestamp '2020-01-01' + to_seconds(vec_id * 997)) < 3600 then (vec_id * 997 // 60)::varchar || 'm ago' when vec_id * 997 < 86400 then (vec_id * 997 // 3600)::varchar || 'h ago' else (vec_id * 997 // 86400)::varchar || 'd ago' end as age from embeddings""")
def q_age_label(spark, d):
    return t(spark, d, "embeddings").select("vec_id", T.age_label(F.col("vec_id") * 997).alias("age"))


@q("""with s as (select q.vec_id as query_id, e.vec_id as match_id, list_cosine_similarity(q.embedding::double[], e.embedding::double[]) as sim from embeddings q join embeddings e on q.vec_id <> e.vec_id where q.vec_id % 100 = 0)
select query_id, match_id, rank::int as rank from (select *, row_number() over (partition by query_id order by sim desc, match_id) as rank from s) where rank <= 5""")
def q_nearest_vectors(spark, d):
    vectors = t(spark, d, "embeddings")
    return similarity.nearest(vectors, vectors.where("vec_id % 100 = 0"), "vec_id", "embedding", 5).select("query_id", "match_id", "rank")


@q("""select label, count(*) as n, avg(embedding[1]::double) as first_mean from embeddings group by label""")
def q_vector_profile(spark, d):
    return t(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.avg(F.col("embedding")[0].cast("double")).alias("first_mean"))


@q("""select doc_id, len(string_split(regexp_replace(file_path, '[^/]*$', ''), '/')) - 1 as depth, regexp_extract(file_path, '^([^/]*)/', 1) as top from documents where file_path is not null""")
def q_path_parts(spark, d):
    docs = t(spark, d, "documents").where("file_path is not null")
    return docs.select("doc_id", (F.size(F.split(F.regexp_replace("file_path", "[^/]*$", ""), "/")) - 1).cast("bigint").alias("depth"), F.regexp_extract("file_path", "^([^/]*)/", 1).alias("top"))


@q("""select doc_id, array_to_string(list_transform(string_split(source, '_'), lambda x: upper(x[1]) || x[2:]), '') as camel from documents""")
def q_camelize(spark, d):
    return t(spark, d, "documents").select("doc_id", T.camelize(F.col("source")).alias("camel"))


@q("""select user_id, event_type, n, floor(n * 1000 / sum(n) over (partition by user_id) + 0.5) / 10 as pct from (select user_id, event_type, count(*) as n from events group by all)""")
def q_share_per_group(spark, d):
    from pyspark.sql import Window

    per = t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return per.withColumn("pct", F.floor(F.col("n") * 1000 / F.sum("n").over(Window.partitionBy("user_id")) + 0.5) / 10)


@q("""with p as (select s_suppkey, s_nationkey, s_acctbal from supplier), m as (select s_nationkey, avg(s_acctbal) as mean, stddev_samp(s_acctbal) as dev from p group by all)
select s_suppkey from p join m on p.s_nationkey = m.s_nationkey where s_acctbal > mean + dev""")
def q_outliers(spark, d):
    rows = t(spark, d, "supplier")
    m = rows.groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("mean"), F.stddev_samp("s_acctbal").alias("dev"))
    return rows.join(m, "s_nationkey").where("s_acctbal > mean + dev").select("s_suppkey")


@q("""with e as (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 1 day then 0 else 1 end as s from events)
select user_id, visit::bigint as visit, count(*) as n, min(ts) as began, max(ts) as ended from (select *, sum(s) over (partition by user_id order by ts, event_id rows unbounded preceding) as visit from e) group by user_id, visit""")
def q_visits(spark, d):
    from ..operators.ordered import scan

    lagged = scan(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], prevs={"before": F.col("ts")})
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))
    e = lagged.withColumn("s", F.when(gap <= 86_400_000_000, 0).otherwise(1))
    return sequences.running_sum(e, ["user_id"], ["ts", "event_id"], F.col("s"), "visit").groupBy("user_id", "visit").agg(F.count("*").alias("n"), F.min("ts").alias("began"), F.max("ts").alias("ended"))
