"""One entry for every source: ``scheme://resource[/element]?conditions&sort=&limit=&offset=&fields=``.

A scheme is a table function that gives a DataFrame; conditions, order, page and
projection are put on top as plan nodes, so they reach the scan where they can.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import checks, code, documents, frontmatter, graphs, history, infra, profile, scoring, search
from ..operators.ordered import scan
from ..operators.rules import BUILTIN
from ..sources import files as file_source
from ..sources import formats, python_code, stores
from . import control, qlang
from .staging import ship


@dataclass(frozen=True)
class Call:
    """A parsed address: what is asked of which resource."""

    scheme: str
    resource: str
    element: str | None
    params: dict[str, str]
    query: str
    page: control.Page
    fields: str | None


@dataclass(frozen=True)
class Scheme:
    name: str
    run: Callable[[SparkSession, Call], DataFrame]
    about: str
    params: tuple[str, ...] = ()
    profile: qlang.Profile = qlang.DEFAULT
    tiebreak: tuple[str, ...] = ()
    aliases: dict[str, str] = field(default_factory=dict)


SCHEMES: dict[str, Scheme] = {}


def scheme(name: str, about: str, params: str = "", profile_: qlang.Profile = qlang.DEFAULT, tiebreak: str = "", aliases: dict[str, str] | None = None):
    """Register a table function under a scheme; plugins use the same call."""

    def register(fn):
        SCHEMES[name] = Scheme(name, fn, about, tuple(params.split()), profile_, tuple(tiebreak.split()), aliases or {})
        return fn

    return register


def parse(uri: str) -> Call:
    head, _, query = uri.partition("?")  # an element stands before the conditions
    name, sep, rest = head.partition("://")
    if not sep or name not in SCHEMES:
        raise ValueError(f"unknown scheme in {uri!r}; known: {', '.join(sorted(SCHEMES))}")
    rest, _, element = unquote(rest).partition("#")
    query, page = control.parse_page(query)
    known, params, conditions, fields = SCHEMES[name].params, {}, [], None
    for part in filter(None, query.split("&")):
        key, eq, value = part.partition("=")
        if key == "fields" and eq:
            fields = unquote(value)
        elif part.startswith("content~"):
            params["content~"] = unquote(part[8:].lstrip("="))
        elif key in known and not key.endswith(("!", "<", ">", "~")):
            value = unquote(value) if eq else "true"
            params[key] = f"{params[key]},{value}" if key in params and key == "body-contains" else value
        elif (m := re.match(r"([\w-]+)([<>])(.*)$", part)) and m.group(1) in known:
            params[m.group(1)] = m.group(2) + unquote(m.group(3))
        else:
            conditions.append(unquote(part))
    return Call(name, rest or ".", element or None, params, "&".join(conditions), page, fields)


def query(spark: SparkSession, uri: str) -> DataFrame:
    """The rows that an address asks for."""
    call = parse(uri)
    ship(spark)
    s = SCHEMES[call.scheme]
    df = qlang.where(s.run(spark, call), call.query, s.profile, s.aliases)
    df = control.page(df, call.page, [c for c in s.tiebreak if c in df.columns])
    return control.project(df, call.fields) if call.fields else df


def analyze(spark: SparkSession, path: str) -> DataFrame:
    """The structure of the files below a path."""
    return formats.structure(file_source.read_texts(spark, path))


def element(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Definitions of a name, with their text."""
    texts = file_source.read_texts(spark, path, "*.py")
    found = python_code.element_table(texts).where((F.col("name") == name) | (F.col("qualified") == name))
    lines = F.split("text", "\n")
    return found.join(texts.withColumnRenamed("path", "file"), "file").withColumn("source", F.array_join(F.slice(lines, F.col("line"), F.col("line_count")), "\n")).drop("text")


def check(spark: SparkSession, path: str, select: str | None = None, ignore: str | None = None, severity: str | None = None) -> DataFrame:
    """All findings below a path: file, line, rule_code, severity, message."""
    texts = file_source.read_texts(spark, path)
    cols = ["file", "line", "rule_code", "severity", "message"]
    line_rules = checks.run_rules(texts.withColumnRenamed("path", "file"), "file", "text", BUILTIN.chosen(select, ignore, severity), "file") if BUILTIN.chosen(select, ignore, severity) else None
    py = texts.where(F.col("path").rlike(r"\.pyi?$"))
    elements, imports, facts = python_code.element_table(py), python_code.import_table(py), python_code.fact_table(py)
    more = code.element_findings(elements, imports, python_code.symbol_table(py)).unionByName(code.fact_findings(facts)).unionByName(
        code.module_findings(py, imports, elements, facts, stores.importable(), stores.project_version(texts))
    ).unionByName(documents.findings(texts)).unionByName(
        infra.server_findings(formats.structure(texts.where(F.col("path").rlike(r"\.(conf|nginx|vhost)$")))).withColumnRenamed("path", "file")
    )
    alike = python_code.similar_table(py)
    more = more.unionByName(
        alike.select("file", "line", F.lit("D002").alias("rule_code"), F.lit("low").alias("severity"), F.concat("name", F.lit(" is much like "), "other").alias("message"))
    )
    named = lambda names: " or ".join(f"startswith(rule_code, '{x.strip()}')" for x in names.split(",") if x.strip().isalnum()) or "true"
    if select:
        more = more.where(named(select))
    if ignore:
        more = more.where(f"not ({named(ignore)})")
    if severity:
        more = more.where(checks.rank_of(F.col("severity"), checks.SEVERITIES) >= checks.SEVERITIES.index(severity) + 1)
    return more.select(*cols) if line_rules is None else line_rules.select(*cols).unionByName(more.select(*cols))


def describe() -> list[dict]:
    """Every scheme with what it gives and its parameters."""
    return [{"scheme": s.name, "about": s.about, "params": list(s.params)} for s in sorted(SCHEMES.values(), key=lambda s: s.name)]


def _on(params: dict[str, str], name: str) -> bool:
    return params.get(name, "false").lower() not in ("false", "0", "no")


# --- schemes -----------------------------------------------------------------------------------------------------


_TESTS = r"(^|/)tests?/|(^|/)(test_[^/]*|[^/]*_test|conftest)\.py$"


def _py(spark, call):
    return file_source.read_texts(spark, call.resource, "*.py")


def _elements(spark, call):
    return python_code.element_table(_py(spark, call))


def _graph(spark, call):
    texts = _py(spark, call)
    return code.dependency_edges(python_code.import_table(texts), texts.select(F.col("path").alias("file")))


def _glob(c, pattern: str):
    return c.rlike("^" + "".join(".*" if x == "*" else "." if x == "?" else "\\Q" + x + "\\E" for x in pattern) + "$")


@scheme(
    "code", "definitions in Python sources; #name", "decorator callee_of param_type return_type has_annotations callers type_evidence show", qlang.CODE, "file line",
    {"lines": "line_count", "type": "category"},
)
def _code(spark, call):
    p, texts = call.params, _py(spark, call)
    if "type_evidence" in p:
        return python_code.evidence_table(texts).where(F.col("variable") == p["type_evidence"])
    df = python_code.element_table(texts)
    if p.get("show") == "calls":
        return code.call_edges(df)
    if p.get("show") == "dict-heatmap":
        return code.key_heatmap(python_code.event_table(texts))
    if "decorator" in p:
        df = df.where(F.exists("decorators", lambda d: _glob(d, p["decorator"]) | _glob(F.concat(F.lit("@"), d), p["decorator"])))
    if "callee_of" in p:
        named = code.call_edges(df).where((F.col("caller") == p["callee_of"]) | F.col("caller").endswith("." + p["callee_of"]))
        df = df.join(named.select("file", F.col("bare").alias("name")).distinct(), ["file", "name"], "left_semi")
    if "param_type" in p:
        kinds = F.transform(F.regexp_extract_all("signature", F.lit(r":\s*([^,=)]+(?:\[[^\]]*\])?)"), F.lit(1)), lambda x: F.trim(x))
        df = df.where(F.exists(kinds, lambda k: _glob(k, p["param_type"]) | k.startswith(p["param_type"] + "[")))
    if "return_type" in p:
        df = df.where(_glob(F.trim(F.regexp_extract("signature", r"->\s*(.+)$", 1)), p["return_type"]))
    if "has_annotations" in p:
        told = F.col("signature").rlike(r":\s*\w|->")
        df = df.where(told if _on(p, "has_annotations") else ~told & F.col("category").isin("functions", "methods"))
    if "callers" not in p and "callers" not in f"{call.query}{call.fields}{call.page.sort}":  # counted only where asked for
        return df.where((F.col("name") == call.element) | (F.col("qualified") == call.element)) if call.element else df
    n = code.call_edges(python_code.element_table(texts)).groupBy(F.col("bare").alias("name")).agg(F.count_distinct("file", "caller").alias("callers"))
    df = df.join(n, "name", "left").na.fill({"callers": 0})
    if "callers" in p:
        op, value = (p["callers"][0], p["callers"][1:]) if p["callers"][:1] in "<>" else ("=", p["callers"])
        df = qlang.where(df, f"callers{op}{value}", qlang.CODE)
    return df.where((F.col("name") == call.element) | (F.col("qualified") == call.element)) if call.element else df


@scheme("calls", "the call graph: callers or callees of a name, uncalled names, most called, modules", "target callees root depth uncalled type rank top format builtins modules external test-framework", qlang.CODE, "node")
def _calls(spark, call):
    import builtins

    p, texts = call.params, _py(spark, call)
    e = python_code.element_table(texts)
    depth = int(p["depth"]) if p.get("depth", "").isdigit() else 1
    tests = F.col("file").rlike(r"(^|/)tests?/|(^|/)(test_[^/]*|[^/]*_test|conftest)\.py$")
    if "target" in p:
        out = code.callers(e, p["target"]) if depth == 1 else code.call_closure(e, p["target"], depth, True)
    elif "callees" in p or "root" in p:
        out = code.call_closure(e, p.get("callees") or p["root"], depth if "callees" in p else max(depth, 3), False)
        if not _on(p, "builtins"):
            out = out.where(~F.col("node").isin(sorted(n for n in dir(builtins) if not n.startswith("_"))))
    elif "modules" in p:
        imports = python_code.import_table(texts)
        out = code.dependency_edges(imports, texts.select(F.col("path").alias("file")))
        if _on(p, "external"):
            lost = code.module_files(imports, texts.select(F.col("path").alias("file"))).where("target is null and level = 0")
            out = out.unionByName(lost.select(F.col("file").alias("src"), F.split("module", r"\.")[0].alias("dst")).distinct())
    elif "uncalled" in p:
        out = code.uncalled(e, entries=_on(p, "test-framework")).select("file", "qualified", "line", "category")
        if "type" in p:
            out = out.where(F.col("category") == {"function": "functions", "method": "methods"}.get(p["type"], p["type"]))
        if not _on(p, "test-framework"):
            out = out.where(~tests)
        out = out.orderBy("file", "line").limit(int(p["top"])) if "top" in p else out
    elif "rank" in p:
        out = code.rank_by_callers(e if _on(p, "test-framework") else e.where(~tests), int(p.get("top", 10)))
    else:
        out = code.call_edges(e)
    return _dot(out, *(("src", "dst") if "modules" in p else ("caller", "callee"))) if p.get("format") == "dot" and {"caller", "src"} & set(out.columns) else out


def _dot(edges, src: str, dst: str):
    """Edges as lines of a graph description."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', "'"), F.lit('"'))
    return edges.select(F.concat(F.lit("  "), quoted(F.col(src)), F.lit(" -> "), quoted(F.col(dst)), F.lit(";")).alias("line")).distinct()


@scheme("imports", "import statements, unused ones, cycles, degrees, entry points, components, layer violations", "unused circular fan-in rank top entrypoints components violations format", qlang.CODE, "file line")
def _imports(spark, call):
    p, texts = call.params, _py(spark, call)
    imports = python_code.import_table(texts)
    names = texts.select(F.col("path").alias("file"))
    if "unused" in p:
        return code.unused_imports(imports, python_code.symbol_table(texts))
    edges = code.dependency_edges(imports, names)
    folder = lambda c: F.regexp_extract(c, r"^(.*?)(?:/[^/]*)?$", 1)
    if p.get("format") == "dot":
        return _dot(edges, "src", "dst")
    if "circular" in p:
        return graphs.strong_components(edges)
    if "fan-in" in p or p.get("rank") == "fan-in":
        # files that nothing imports have a degree as well
        out = names.distinct().select(F.col("file").alias("node")).join(graphs.degrees(edges), "node", "left").na.fill(0)
        return out.orderBy(F.desc("fan_in"), "node").limit(int(p["top"])) if "top" in p else out
    if "entrypoints" in p:
        return graphs.entrypoints(edges, names.select(F.col("file").alias("node")))
    if "components" in p:
        return graphs.components(edges, folder("src"), folder("dst"))
    if "violations" in p:  # from:to,from:to
        rules = spark.createDataFrame([tuple(x.split(":", 1)) for x in p["violations"].split(",") if ":" in x], "layer string, forbidden string")
        layers = names.select(F.col("file").alias("node"), F.split("file", "/")[0].alias("layer"))
        return graphs.layer_violations(edges, layers, rules)
    return code.module_files(imports, names)


@scheme("depends", "which files import a file, or dependents per file", "top format root", qlang.CODE, "dst")
def _depends(spark, call):
    p = call.params
    e = _graph(spark, replace(call, resource=p["root"]) if "root" in p else call)
    if call.element:
        e = e.where((F.col("dst") == call.element) | F.col("dst").startswith(call.element.rstrip("/") + "/"))
        return _dot(e, "src", "dst") if p.get("format") == "dot" else e
    if p.get("format") == "dot":
        return _dot(e, "src", "dst")
    out = e.groupBy("dst").agg(F.count_distinct("src").alias("dependents"))
    return out.orderBy(F.desc("dependents"), "dst").limit(int(p["top"])) if "top" in p else out


@scheme("deps", "packages by kind and number of importing files, unused imports, cycles", "top no_unused no_circular", tiebreak="section name")
def _deps(spark, call):
    p, texts = call.params, _py(spark, call)
    imports = python_code.import_table(texts)
    out = code.package_counts(imports).select(F.lit("package").alias("section"), F.col("package").alias("name"), "package", "kind", "files")
    if not _on(p, "no_unused"):
        unused = code.unused_imports(imports, python_code.symbol_table(texts))
        out = out.unionByName(unused.groupBy(F.col("file").alias("name")).agg(F.count("*").alias("files")).withColumns({"section": F.lit("unused"), "kind": F.lit("imports")}), allowMissingColumns=True)
    if not _on(p, "no_circular"):
        cycles = graphs.strong_components(code.dependency_edges(imports, texts.select(F.col("path").alias("file"))))
        out = out.unionByName(cycles.groupBy(F.col("component").cast("string").alias("name")).agg(F.count("*").alias("files")).where("files > 1").withColumns({"section": F.lit("circular"), "kind": F.lit("files")}), allowMissingColumns=True)
    if "top" in p:
        w = Window.partitionBy("section").orderBy(F.desc("files"), "name")
        out = out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= int(p["top"])).drop("_r")
    return out


def _churn(spark, call):
    """Commits per file, where the resource lies in a repository; an empty table elsewhere."""
    p = call.params
    if not stores.is_repository(call.resource):
        return spark.createDataFrame([], "file string, commits bigint")
    touched = stores.history(spark, call.resource, "HEAD", True)
    return history.churn(touched, p.get("since"), merges=not _on(p, "no_merges")).select(F.col("path").alias("file"), "commits")


@scheme("stats", "lines, elements, complexity and quality per file", "hotspots code_only min_lines max_lines min_complexity max_complexity min_functions churn since no_merges summary_only", qlang.METRICS, "file")
def _stats(spark, call):
    p, c = call.params, F.col
    texts = file_source.read_texts(spark, call.resource)
    texts = texts.where(c("path").rlike(r"\.pyi?$")) if _on(p, "code_only") or not _on(p, "all") else texts
    df = code.file_stats(python_code.element_table(texts.where(c("path").rlike(r"\.pyi?$"))), texts)
    for key, column, least in (("min_lines", "lines", True), ("max_lines", "lines", False), ("min_complexity", "avg_complexity", True), ("max_complexity", "avg_complexity", False), ("min_functions", "functions", True)):
        if key in p:
            df = df.where(c(column) >= float(p[key]) if least else c(column) <= float(p[key]))
    if _on(p, "hotspots"):
        commits = F.lit(0)
        if _on(p, "churn"):
            df = df.join(_churn(spark, call), "file", "left").na.fill({"commits": 0})
            commits = c("commits")
        df = df.withColumn("score", scoring.hotspot(c("quality"), c("avg_complexity"), c("long_functions"), c("deep_functions"), commits)).where("score > 0").orderBy(F.desc("score"), "file").limit(10)
    if _on(p, "summary_only"):
        return df.agg(F.count("*").alias("files"), *(F.sum(x).alias(x) for x in ("lines", "functions", "classes")), F.avg("avg_complexity").alias("avg_complexity"), F.avg("quality").alias("quality"))
    return df


@scheme("flow", "events in functions: reads, writes, calls, exits, effects, loops, conditions", "inputs outputs effects keys", qlang.CODE, "file line")
def _flow(spark, call):
    p, e = call.params, python_code.event_table(_py(spark, call))
    if call.element:
        e = e.where(F.col("function") == call.element)
    for name, fn in (("inputs", code.inputs), ("outputs", code.outputs)):
        if name in p:
            lo, _, hi = p[name].partition("-")
            return fn(e, int(lo), int(hi or lo))
    return code.effects(e) if "effects" in p else code.key_heatmap(e) if "keys" in p else e


@scheme("contracts", "abstract classes, protocols, typed dicts, data classes and models with their implementations", "abstract_only implementations", tiebreak="contract child")
def _contracts(spark, call):
    p, df = call.params, code.implementations(_elements(spark, call))
    if _on(p, "abstract_only"):
        df = df.where("kind in ('abstract', 'protocol')")
    return df if p.get("implementations", "true") != "false" else df.select("contract_file", "contract", "kind").distinct()


@scheme("surface", "where code touches the outside: files, network, databases, environment, processes", "type source_only", tiebreak="file line")
def _surface(spark, call):
    p = call.params
    e = python_code.event_table(_py(spark, call)).where("startswith(kind, 'EFFECT:')")
    out = e.select("file", "function", F.substring("kind", 8, 20).alias("surface"), "line", F.col("text").alias("call"))
    if "type" in p:
        out = out.where(F.col("surface") == p["type"])
    return out.where(~F.col("file").rlike(_TESTS)) if _on(p, "source_only") else out


@scheme("trace", "effects that functions reach through calls, from one function if wanted", "from depth", tiebreak="node effect")
def _trace(spark, call):
    p, texts = call.params, _py(spark, call)
    depth = int(p["depth"]) if p.get("depth", "").isdigit() else 2
    out = code.effects_through_calls(python_code.event_table(texts), python_code.element_table(texts), depth)
    return out.where(F.col("node") == p["from"]) if "from" in p else out


@scheme("patches", "what tests patch, grouped by target, test or file, with its pressure", "group min target private suppress", tiebreak="group")
def _patches(spark, call):
    p = call.params
    uses = code.patch_uses(python_code.fact_table(_py(spark, call)))
    if p.get("group") == "none":
        return uses
    return code.patch_groups(uses, p.get("group", "target"), int(p.get("min", 1)), p.get("target", ""), _on(p, "private"), p.get("suppress", "true") != "false")


@scheme("testability", "functions by what makes them hard to test, with the patches of tests that name them", "tests top min_patches min_categories include_unresolved", tiebreak="file function")
def _testability(spark, call):
    p, texts = call.params, _py(spark, call)
    fx = code.effects(python_code.event_table(texts)).select("file", "function", F.size("effects").alias("categories"))
    el = python_code.element_table(texts).where("complexity is not null").select("file", F.col("qualified").alias("function"), "name", "complexity", "line_count")
    where = [x.strip().rstrip("/") for x in p["tests"].split(",")] if "tests" in p else None
    tests = texts.where(F.col("path").rlike("^(" + "|".join(map(re.escape, where)) + ")(/|$)") if where else F.col("path").rlike(_TESTS))
    uses = code.patch_uses(python_code.fact_table(tests))
    n = uses.groupBy(F.col("symbol").alias("name")).agg(F.count("*").alias("patches"))
    both = el.where(~F.col("file").rlike(_TESTS)).join(fx, ["file", "function"], "left").join(n, "name", "left").na.fill({"categories": 0, "patches": 0})
    if _on(p, "include_unresolved"):
        lost = n.join(el.select("name").distinct(), "name", "left_anti").select("name", F.col("name").alias("function"), "patches")
        both = both.unionByName(lost, allowMissingColumns=True).na.fill({"categories": 0, "complexity": 0, "line_count": 0})
    both = both.where((F.col("patches") >= int(p.get("min_patches", 0))) & ((F.col("patches") > 0) | (F.col("categories") >= int(p.get("min_categories", 0)))))
    out = both.drop("name").withColumn("score", scoring.boundary(F.col("categories"), F.col("complexity"), F.col("line_count"), F.lit(False), F.col("patches")))
    return out.orderBy(F.desc("score"), "file", "function").limit(int(p["top"])) if "top" in p else out


@scheme("hotspots", "the worst files and functions", "top min_complexity functions_only files_only", tiebreak="file line")
def _hotspots(spark, call):
    p, top = call.params, int(call.params.get("top", 10))
    least = int(p.get("min_complexity", code.LIMITS["complexity"]))
    files = _stats(spark, Call("stats", call.resource, None, {"hotspots": "true"}, "", control.Page(), None)).select(F.lit("file").alias("what"), "file", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("line"), "score").orderBy(F.desc("score"), "file").limit(top)
    functions = _elements(spark, call).where(F.col("complexity") >= least).select(F.lit("function").alias("what"), "file", F.col("qualified").alias("name"), "line", F.col("complexity").cast("double").alias("score"))
    functions = functions.orderBy(F.desc("score"), "file", "line").limit(top)
    if _on(p, "functions_only"):
        return functions
    return files if _on(p, "files_only") else files.unionByName(functions)


@scheme("overview", "files, bytes, lines and definitions per language family; recent commits, most imported files", "top no_git no_imports exclude respect_gitignore", tiebreak="section name")
def _overview(spark, call):
    p, top = call.params, int(call.params.get("top", 5))
    rules = [x.strip() for x in p.get("exclude", "").split(",") if x.strip()]
    if p.get("respect_gitignore", "true") != "false":
        lines = spark.read.format("binaryFile").option("pathGlobFilter", ".gitignore").option("recursiveFileLookup", "true").load(call.resource).orderBy(F.length("path")).select(F.col("content").cast("string").alias("t")).first()
        rules += lines.t.split("\n") if lines else []
    found = file_source.discover(spark, call.resource, ignore=rules)
    per = found.groupBy("family").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    defs = _elements(spark, call).groupBy(F.lit("python").alias("family")).agg(F.count("*").alias("elements"))
    out = per.join(defs, "family", "left").select(F.lit("language").alias("section"), F.col("family").alias("name"), "family", "files", "bytes", "elements")
    if not _on(p, "no_imports"):
        d = graphs.degrees(_graph(spark, call)).orderBy(F.desc("fan_in"), "node").limit(top)
        out = out.unionByName(d.select(F.lit("imported").alias("section"), F.col("node").alias("name"), F.col("fan_in").cast("bigint").alias("files")), allowMissingColumns=True)
    if not _on(p, "no_git") and stores.is_repository(call.resource):
        recent = stores.history(spark, call.resource).orderBy(F.desc("ts"), "hash").limit(top)
        out = out.unionByName(recent.select(F.lit("commit").alias("section"), F.col("subject").alias("name")), allowMissingColumns=True)
    return out


@scheme("architecture", "fan-in, fan-out, cycle and rank of every file", "top no_imports", tiebreak="node")
def _architecture(spark, call):
    p, texts = call.params, _py(spark, call)
    stats = code.file_stats(python_code.element_table(texts), texts).select(F.col("file").alias("node"), "lines", "quality")
    if _on(p, "no_imports"):
        out = stats.withColumn("rank", F.col("quality"))
        return out.orderBy("rank", "node").limit(int(p["top"])) if "top" in p else out
    e = _graph(spark, call)
    rank = graphs.personal_rank(e, e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), rounds=10)
    out = stats.join(graphs.degrees(e), "node", "left").join(graphs.strong_components(e), "node", "left").join(rank, "node", "left").na.fill({"fan_in": 0, "fan_out": 0})
    return out.orderBy(F.desc("fan_in"), "node").limit(int(p["top"])) if "top" in p else out


@scheme("pack", "files that fit a budget of tokens, most important first", "budget focus since content architecture", tiebreak="rank")
def _pack(spark, call):
    kind, most = scoring.parse_budget(call.params.get("budget"))
    texts = file_source.read_texts(spark, call.resource)
    fan = graphs.degrees(_graph(spark, call)).select(F.col("node").alias("path"), "fan_in")
    cost = F.size(F.split("text", "\n")) if kind == "lines" else F.ceil(F.length("text") / 4)
    focus = F.lower("path").contains((call.params.get("focus") or "\x00").lower())
    entry_point = F.col("path").rlike(r"(^|/)(main|__main__|app|cli|index|manage)\.\w+$")
    low = F.col("path").rlike(r"(^|/)(tests?|docs?|vendor|examples?)/")
    score = F.greatest(F.lit(0), scoring.fan_in_bonus(F.coalesce("fan_in", F.lit(0))) + F.when(entry_point, 10).otherwise(0) + F.when(focus, 8).otherwise(0) - F.when(low, 3).otherwise(0))
    if _on(call.params, "architecture"):
        score = score + F.least(F.coalesce("fan_in", F.lit(0)), F.lit(20)) / 4
    joined = texts.join(fan, "path", "left")
    if "since" in call.params:  # files that changed come first
        changed = spark.createDataFrame([(x,) for x in stores.git(call.resource, "diff", "--name-only", call.params["since"]).split("\n") if x] or [("",)], "path string").withColumn("_new", F.lit(100))
        joined, score = joined.join(changed, "path", "left"), score + F.coalesce("_new", F.lit(0))
    keep = ["path", score.alias("priority"), cost.cast("bigint").alias("cost")]
    ranked = scan(joined.select(*keep).withColumn("_first", -F.col("priority")), [], ["_first", "cost", "path"], number="rank").drop("_first").withColumn("rank", F.col("rank") + 1)
    kept = scoring.fit_budget(ranked, "rank", "cost", most)
    if not _on(call.params, "content"):
        return kept
    # whole texts for the first third of the budget, definitions for the next, names for the rest
    tier = F.when(F.col("used") <= most / 3, "full").when(F.col("used") <= most * 2 / 3, "structure").otherwise("name")
    outline = python_code.element_table(texts.where(F.col("path").rlike(r"\.pyi?$"))).groupBy(F.col("file").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "qualified", "signature"))), lambda x: F.concat(x["qualified"], x["signature"])), "\n").alias("outline"))
    both = kept.withColumn("tier", tier).join(texts, "path").join(outline, "path", "left")
    return both.withColumn("content", F.when(F.col("tier") == "full", F.col("text")).when(F.col("tier") == "structure", F.coalesce("outline", F.substring("text", 1, 200)))).drop("text", "outline")


@scheme("structure", "headings, links, keys, blocks, definitions of files of any known format", tiebreak="path line")
def _structure(spark, call):
    return analyze(spark, call.resource)


@scheme(
    "markdown", "front matter and text of Markdown files, links between them; conditions and fields name front matter fields",
    "links link-graph backlinks aggregate search body-contains explain missing lint lint-fields", tiebreak="path",
)
def _markdown(spark, call):
    p, texts = call.params, file_source.read_texts(spark, call.resource, "*.md")
    if "search" in p or "body-contains" in p:
        terms = [x for x in re.split(r"[,\x01]", p.get("search") or p["body-contains"]) if x]
        body = texts.withColumn("text", search.body_text(F.col("text")))
        out = search.search(body, "text", terms)
        if _on(p, "explain"):
            heads = lambda t: F.regexp_count("text", F.lit(r"(?im)^#+ .*\\Q".replace("\\\\", "\\") + t + "\\E"))
            out = out.withColumns({f"n_{i}": F.regexp_count(F.lower("text"), F.lit("\\Q" + t.lower() + "\\E")) for i, t in enumerate(terms)} | {f"in_headings_{i}": heads(t) for i, t in enumerate(terms)})
        return out.drop("text")
    rows = formats.structure(texts)
    links = rows.where("category = 'link'").select(F.col("path").alias("src"), F.regexp_replace("detail", "[#?].*$", "").alias("dst")).where(search.link_kind(F.col("dst")) == "internal").where("dst rlike '[.]md$'").distinct()
    if "links" in p:
        return links
    if "link-graph" in p:
        to = links.select("src", documents.normal_path(F.concat_ws("/", documents.folder(F.col("src")), "dst")).alias("dst"))
        d = graphs.degrees(to.where("src <> dst")).select(F.col("node").alias("path"), "fan_in", "fan_out")
        out = texts.select("path").join(d, "path", "left").na.fill(0)
        back = to.groupBy(F.col("dst").alias("path")).agg(F.sort_array(F.collect_set("src")).alias("backlinks"))
        forth = to.groupBy(F.col("src").alias("path")).agg(F.sort_array(F.collect_set("dst")).alias("forward"))
        return out.join(forth, "path", "left").join(back, "path", "left").withColumn("orphan", F.col("fan_in") == 0)
    if "backlinks" in p:
        name = F.regexp_extract("dst", "[^/]*$", 0)
        return links.where((F.col("dst") == p["backlinks"]) | (name == p["backlinks"].rsplit("/", 1)[-1]))
    front = rows.where("category in ('frontmatter', 'frontmatter_item')")
    if "aggregate" in p:
        return profile.value_frequency(front.where((F.col("name") == p["aggregate"]) & (F.coalesce("detail", F.lit("")) != "")), "detail")
    if "missing" in p:
        return texts.select("path").join(front.where(F.col("name") == p["missing"]).select("path"), "path", "left_anti")
    state = search.front_matter_state(F.col("text")).alias("state")
    if "lint" in p or "lint-fields" in p:
        wanted = [x.strip() for x in p.get("lint-fields", "").split(",") if x.strip()]
        bad = texts.select("path", state).where("state <> 'ok'").select("path", F.col("state").alias("problem"))
        each = texts.select("path", F.explode(F.array(*[F.lit(x) for x in wanted]) if wanted else F.array().cast("array<string>")).alias("name"))
        lacking = each.join(front.select("path", "name").distinct(), ["path", "name"], "left_anti").select("path", F.concat(F.lit("missing "), "name").alias("problem"))
        return bad.unionByName(lacking)
    fields = front.groupBy("path", "name").agg(F.array_join(F.array_sort(F.collect_list("detail")), ",").alias("v")).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("name", "v"))).alias("front_matter"))
    out = texts.select("path", state, F.length("text").alias("chars")).join(fields, "path", "left")
    # fields that the address names become columns
    named = [c.field for c in qlang.parse(call.query)] + [x.lstrip("-") for x in re.split(r"[,&]", f"{call.fields or ''},{call.page.sort or ''}") if x]
    return out.withColumns({n: F.col("front_matter")[n] for n in dict.fromkeys(named) if n not in out.columns and re.fullmatch(r"[\w-]+", n)})


@scheme("frontmatter", "findings on front matter: missing fields, wrong types (``required=a,b&types=a:integer``)", "required types", tiebreak="path field")
def _frontmatter(spark, call):
    p = call.params
    types = dict(x.split(":", 1) for x in p.get("types", "").split(",") if ":" in x)
    return frontmatter.check(formats.structure(file_source.read_texts(spark, call.resource, "*.md")), [x for x in p.get("required", "").split(",") if x], types)


@scheme("json", "a JSON document: its rows, or gron lines, keys, length, type, schema, at a path", "gron flatten keys length type schema path", tiebreak="")
def _json(spark, call):
    p = call.params
    text = spark.read.text(call.resource, wholetext=True).select(F.lit(1).alias("doc"), F.col("value").alias("v"))
    if call.element or "path" in p:
        text = text.select("doc", profile.json_value(F.col("v"), call.element or p["path"]).alias("v"))
    if "type" in p:
        first = F.substring(F.ltrim("v"), 1, 1)
        kind = F.when(F.col("v").isNull(), "null").when(first == "[", "array").when(first == "{", "object").when(F.col("v").isin("true", "false"), "boolean").when(F.col("v").try_cast("double").isNotNull(), "number").otherwise("string")
        return text.select(kind.alias("type"), F.coalesce(F.json_array_length("v"), F.size(F.json_object_keys("v"))).alias("n"))
    if "gron" in p or "flatten" in p:
        return profile.gron(text, "doc", "v").drop("doc")
    if "keys" in p:
        return text.select(F.explode(F.json_object_keys("v")).alias("key"))
    if "length" in p:
        return text.select(F.coalesce(F.json_array_length("v"), F.size(F.json_object_keys("v")), F.length("v")).alias("length"))
    if "schema" in p:
        return text.select(F.schema_of_variant(F.try_parse_json("v")).alias("schema"))
    if call.element or "path" in p:
        one = text.first()  # one document
        if not one or not one.v or one.v.lstrip()[:1] not in ("[", "{"):
            return text.select("v")
        kind = spark.range(1).select(F.schema_of_json(F.lit(one.v))).first()[0]
        rows = text.select(F.from_json("v", kind).alias("r"))
        rows = rows.select(F.explode("r").alias("r")) if kind.startswith("ARRAY") else rows
        return rows.select("r.*") if "STRUCT<" in kind[:13] else rows
    return spark.read.json(call.resource, multiLine=True)


@scheme("jsonl", "records of a JSON Lines file, or how many of each type", "types")
def _jsonl(spark, call):
    df = spark.read.json(call.resource)
    return df.groupBy("type").agg(F.count("*").alias("n")) if "types" in call.params else df


@scheme("csv", "rows of a CSV file, or a profile of its columns", "profile sep")
def _csv(spark, call):
    df = spark.read.csv(call.resource, header=True, sep=call.params.get("sep", ","))
    return profile.profile_columns(df).join(profile.infer_types(df, df.columns), "column_name") if "profile" in call.params else df


@scheme("parquet", "rows of a Parquet table, or a profile of its columns", "profile")
def _parquet(spark, call):
    df = spark.read.parquet(call.resource)
    return profile.profile_columns(df) if "profile" in call.params else df


@scheme("sqlite", "a SQLite database: its catalogue, or the rows of a table (``#table``)")
def _sqlite(spark, call):
    return stores.sqlite_table(spark, call.resource, call.element) if call.element else stores.sqlite_catalog(spark, call.resource)


@scheme("jdbc", "a table of a database server through its driver (``url`` and ``#table``)", "url user password")
def _jdbc(spark, call):
    r = spark.read.format("jdbc").option("url", call.params["url"]).option("dbtable", call.element)
    for k in ("user", "password"):
        r = r.option(k, call.params[k]) if k in call.params else r
    return r.load()


@scheme("xlsx", "cells of workbooks, of a range, or with a text; formulas, names, connections, query code, model", "range sheet search format formulas names connections powerquery powerpivot", tiebreak="path sheet row col name")
def _xlsx(spark, call):
    p = call.params
    for key, kinds in (("formulas", ("formula",)), ("names", ("name",)), ("connections", ("connection",)), ("powerquery", ("query",)), ("powerpivot", ("model", "table"))):
        if key in p:
            parts = stores.book_parts(spark, call.resource).where(F.col("kind").isin(*kinds))
            return parts.where(F.col("name") == p[key]) if key == "powerquery" and p[key] not in ("true", "list", "show") else parts
    df = stores.cells(spark, call.resource)
    if "sheet" in p and p["sheet"].isdigit():
        names = df.select("sheet").distinct().orderBy("sheet").limit(int(p["sheet"])).collect()
        df = df.where(F.col("sheet") == (names[-1].sheet if len(names) == int(p["sheet"]) and names else ""))
    elif "sheet" in p:
        df = df.where(F.lower("sheet").contains(p["sheet"].lower()))
    if "search" in p:
        df = df.where(F.lower("value").contains(p["search"].lower()))
    df = stores.cell_range(df, p["range"]) if "range" in p else df
    if p.get("format") in ("csv", "json"):  # a line per row
        one = F.array_sort(F.collect_list(F.struct("col", "value")))
        line = F.array_join(F.transform(one, lambda x: F.when(x["value"].rlike('[",\n]'), F.concat(F.lit('"'), F.regexp_replace(x["value"], '"', '""'), F.lit('"'))).otherwise(x["value"])), ",") if p["format"] == "csv" else F.to_json(F.transform(one, lambda x: x["value"]))
        return df.groupBy("path", "sheet", "row").agg(line.alias("line"))
    return df


@scheme("office", "paragraphs of text documents, slides and open documents", tiebreak="path part number")
def _office(spark, call):
    return stores.document_text(spark, call.resource)


@scheme(
    "git", "commits; files they touch, ownership, churn, timeline, pickaxe; #path for a file's history, blame, text or difference; branches, tags, noise",
    "ref files ownership churn timeline bucket type detail element context author email message hash date since until no_merges merges ignore raw content~ old branches tags noise", qlang.HISTORY, "hash",
)
def _git(spark, call):
    p, path = call.params, call.element
    ref = p.get("ref", "HEAD")
    kind = p.get("type", "")
    if "branches" in p or "tags" in p:
        return stores.refs(spark, call.resource).where(F.col("kind") == ("branch" if "branches" in p else "tag"))
    if path and kind == "blame":
        lines = None
        if "element" in p:  # the lines of a definition
            found = python_code.element_table(stores.file_at(spark, call.resource, path, ref)).where((F.col("name") == p["element"]) | (F.col("qualified") == p["element"])).first()
            lines = f"{found.line},{found.line_end}" if found else None
        hunks = stores.blame(spark, call.resource, path, ref, [x for x in p.get("ignore", "").split(",") if x], lines)
        return hunks if _on(p, "detail") else hunks.groupBy("hash", "author", "email", "ts", "subject").agg(F.count("*").alias("lines"), F.min("line").alias("line_start"), F.max("line").alias("line_end"))
    if path and kind == "diff":
        return stores.file_diff(spark, call.resource, path, p.get("old", f"{ref}~1"), ref, int(p.get("context", 3)))
    if path and (kind == "file" or "raw" in p):
        text = stores.file_at(spark, call.resource, path, ref)
        return text if _on(p, "raw") else formats.structure(text)
    touched = bool(path) or any(k in p for k in ("files", "ownership", "churn")) or kind in ("history", "ownership", "churn")
    df = stores.history(spark, call.resource, ref, touched, p.get("content~"))
    df = df.withColumn("at", F.timestamp_seconds("ts")).withColumn("date", F.to_date("at"))
    if path:
        df = df.where((F.col("path") == path) | F.col("path").startswith(path.rstrip("/") + "/"))
    for key, column in (("author", "author"), ("email", "email"), ("message", "subject")):
        if key in p:
            df = df.where(F.contains(F.lower(column), F.lit(p[key].lower())))
    if "hash" in p:
        df = df.where(F.col("hash").startswith(p["hash"]))
    for key, test in (("date", lambda d: F.col("date") == d), ("since", lambda d: F.col("date") >= d), ("until", lambda d: F.col("date") <= d)):
        if key in p:
            df = df.where(test(F.lit(p[key]).cast("date")))
    if _on(p, "no_merges"):
        df = df.where(F.size("parents") < 2)
    if "noise" in p:
        return stores.noise(df)
    if "ownership" in p or kind == "ownership":
        return history.owners(df if _on(p, "merges") else df.where(F.size("parents") < 2))
    if "churn" in p or kind == "churn":
        return history.churn(df, None if p.get("churn", "true") == "true" else p["churn"], merges=_on(p, "merges"))
    bucket = p.get("bucket") or p.get("timeline")
    return profile.timeline(df, "at", "email", bucket if bucket in ("week", "month") else "month") if bucket else df


@scheme("nginx", "virtual hosts of web server configurations; findings, shared includes; #ports, #locations, #upstream, #auth, #config", "check includes", tiebreak="path server")
def _nginx(spark, call):
    rows = formats.structure(file_source.read_texts(spark, call.resource))
    view = {"ports": infra.ports, "locations": infra.locations, "auth": infra.access_control, "config": infra.server_blocks, "upstream": lambda r: infra.locations(r).where("target rlike '^(https?|unix|grpc)'")}
    if call.element:
        return view[call.element](rows)
    return infra.server_findings(rows) if "check" in call.params else infra.fleet_includes(rows) if "includes" in call.params else infra.virtual_hosts(rows)


@scheme("env", "environment variables by category, secrets masked", tiebreak="name")
def _env(spark, call):
    return stores.environment(spark)


@scheme("sessions", "blocks of transcripts: Parquet tables or JSON Lines", "tables", tiebreak="session_id uuid path")
def _sessions(spark, call):
    from ..operators import shredding

    if call.resource.endswith(".parquet"):
        return shredding.distinct_blocks(shredding.flatten_blocks(spark.read.parquet(call.resource)))
    raw = spark.read.schema(
        "type string, uuid string, parentUuid string, timestamp string, sessionId string, cwd string, message struct<role: string, content: array<struct<type: string,"
        " text: string, thinking: string, name: string, id: string, input: string, tool_use_id: string, content: string, is_error: boolean>>>"
    ).json(call.resource)
    return shredding.distinct_blocks(shredding.flatten_blocks(raw.withColumnRenamed("sessionId", "session_id")))


@scheme("diff", "definitions that differ between two trees: ``left:right``", tiebreak="file qualified")
def _diff(spark, call):
    from ..operators.differences import diff, element_modified

    left, _, right = call.resource.partition(":")
    c = F.col
    keep = ["file", "qualified", "line_count", "complexity", "signature"]
    side = lambda root: python_code.element_table(file_source.read_texts(spark, root, "*.py")).select(*keep)
    test = element_modified(c("l.line_count"), c("r.line_count"), c("l.complexity"), c("r.complexity"), c("l.signature"), c("r.signature"))
    return diff(side(left), side(right), ["file", "qualified"], test)


@scheme("check", "findings of all rules below a path", "select ignore severity", tiebreak="file line rule_code")
def _check(spark, call):
    p = call.params
    return check(spark, call.resource, p.get("select"), p.get("ignore"), p.get("severity"))


@scheme("grep", "lines that match a pattern", "pattern", tiebreak="path line_no")
def _grep(spark, call):
    return search.grep(file_source.read_texts(spark, call.resource), "path", "text", call.params.get("pattern", ""))


@scheme("files", "files with size, age and language family", tiebreak="path")
def _files(spark, call):
    return file_source.discover(spark, call.resource).drop("url")


@scheme("rules", "the built-in rules over texts", tiebreak="rule_code")
def _rules(spark, call):
    return spark.createDataFrame([(r.code, r.severity, r.message, r.per_line) for r in BUILTIN.chosen()], "rule_code string, severity string, message string, per_line boolean")


from . import facts as _facts  # noqa: E402, F401  (registers its schemes)
