"""Analyses over tables of code: call graph, imports, variable flow, findings on elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bare_name, base_tail
from . import graphs

LIMITS = {"complexity": 10, "lines": 75, "many_lines": 100, "depth": 4, "args": 5, "property": 15, "literals": 5}
IMPLICIT = r"^(__\w+__|main|test_.*|setUp|tearDown|setUpClass|tearDownClass|visit_\w+|do_[A-Z]+)$"


def call_edges(elements: DataFrame) -> DataFrame:
    """file, caller, callee (as written) and its bare name."""
    return elements.select("file", F.col("qualified").alias("caller"), F.explode("calls").alias("callee")).withColumn("bare", bare_name(F.col("callee")))


def callers(elements: DataFrame, name: str) -> DataFrame:
    e = call_edges(elements)
    return e.where((F.col("callee") == name) | (F.col("bare") == name))


def resolve_calls(elements: DataFrame, imports: DataFrame) -> DataFrame:
    """Calls with the file that defines the callee: imported symbols by the part left of the first dot, else the same file."""
    calls = call_edges(elements).withColumn("head", F.split("callee", r"\.")[0])
    bound = module_files(imports, elements.select("file").distinct()).select("file", F.col("bound").alias("head"), F.col("target").alias("imported_from"))
    local = elements.select("file", F.col("name").alias("head")).distinct().withColumn("here", F.lit(True))
    both = calls.join(bound.dropDuplicates(["file", "head"]), ["file", "head"], "left").join(local, ["file", "head"], "left")
    return both.withColumn("target", F.coalesce("imported_from", F.when(F.col("here"), F.col("file")))).select("file", "caller", "callee", "bare", "target")


def call_closure(elements: DataFrame, name: str, depth: int, backwards: bool) -> DataFrame:
    """Names that reach, or are reached from, a name by calls; at most five steps."""
    e = elements.select(F.col("name").alias("src"), F.explode("calls").alias("c")).select("src", bare_name(F.col("c")).alias("dst"))
    start = elements.sparkSession.createDataFrame([(name,)], "node string")
    return graphs.closure(e, start, depth, backwards)


def uncalled(elements: DataFrame, entries: bool = False) -> DataFrame:
    """Functions and methods that no call names; implicit entry points (unless wanted), properties and routes are left out."""
    defs = elements.where("category in ('functions', 'methods')")
    defs = defs if entries else defs.where(~F.col("name").rlike(IMPLICIT))
    defs = defs.where(~F.exists("decorators", lambda d: d.rlike(r"property|route|fixture|command|abstractmethod|overload|register")))
    return defs.join(call_edges(elements).select(F.col("bare").alias("name")).distinct(), "name", "left_anti")


def rank_by_callers(elements: DataFrame, top: int) -> DataFrame:
    n = call_edges(elements).groupBy("bare").agg(F.count_distinct("file", "caller").alias("callers"))
    known = n.join(elements.select(F.col("name").alias("bare")).distinct(), "bare", "left_semi")
    return known.orderBy(F.desc("callers"), "bare").limit(max(1, min(100, top)))


def module_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\.pyi?$", ""), r"/__init__$", ""), "/", ".")


def module_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Import statements with the file they resolve to: candidates by dotted suffix, the longest and nearest first."""
    package = F.regexp_replace("file", r"/?[^/]*$", "")
    up = F.expr("array_join(slice(split(regexp_replace(file, '/?[^/]*$', ''), '/'), 1, greatest(0, size(split(regexp_replace(file, '/?[^/]*$', ''), '/')) - level + 1)), '.')")
    base = F.when(F.col("level") > 0, F.concat_ws(".", F.when(up != "", up), F.when(F.col("module") != "", F.col("module")))).otherwise(F.col("module"))
    one = imports.withColumn("name", F.when(F.size("names") > 0, F.col("names")[0])).withColumn("base", base).withColumn("_package", package)
    one = one.withColumn("bound", F.coalesce("alias", "name", F.split("module", r"\.")[0]))
    tries = F.filter(F.array(F.struct(F.lit(2).alias("p"), F.concat_ws(".", "base", "name").alias("m")), F.struct(F.lit(1).alias("p"), F.col("base").alias("m"))), lambda x: x["m"] != "")
    cand = one.withColumn("t", F.explode(tries)).select("*", "t.p", F.col("t.m").alias("m"))
    parts = F.split("module_path", r"\.")
    known = files.select(F.col("file").alias("target"), module_name(F.col("file")).alias("module_path"))
    known = known.select("target", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("m"), F.length("module_path").alias("len"))
    hit = cand.join(known, "m").where("target <> file")
    near = (F.regexp_extract("target", r"^([^/]*)/", 1) == F.regexp_extract("file", r"^([^/]*)/", 1)).cast("int")
    keys = ["file", "line", "module", "bound"]
    best = hit.groupBy(*keys).agg(F.max_by("target", F.struct("p", near, -F.col("len"), F.col("target"))).alias("target"))
    return one.select(*keys, "level", "in_function", "type_checking", "name").join(best, keys, "left")


def dependency_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    return module_files(imports, files).where("target is not null").select(F.col("file").alias("src"), F.col("target").alias("dst")).distinct()


def unused_imports(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """Imports whose name is used nowhere; package files, stars, future and type-checking imports are left out."""
    one = imports.withColumn("bound", F.coalesce("alias", F.when(F.size("names") > 0, F.col("names")[0]), F.split("module", r"\.")[0]))
    one = one.where("bound <> '*' and module <> '__future__' and not type_checking").where(~F.col("file").endswith("__init__.py"))
    return one.join(symbols.select("file", F.col("symbol").alias("bound")), ["file", "bound"], "left_anti")


def package_counts(imports: DataFrame) -> DataFrame:
    """Top-level packages with their kind and number of importing files."""
    import sys

    std = sorted(n for n in sys.stdlib_module_names if not n.startswith("_"))
    top = F.split("module", r"\.")[0]
    kind = F.when(F.col("level") > 0, "relative").when(top.isin(std), "stdlib").otherwise("external")
    return imports.groupBy(F.when(F.col("level") > 0, ".").otherwise(top).alias("package"), kind.alias("kind")).agg(F.count_distinct("file").alias("files"))


def implementations(elements: DataFrame) -> DataFrame:
    """Contracts (abstract classes, protocols, typed dicts, data classes, models) with the classes that name them as base."""
    classes = elements.where("category = 'classes'")
    bases = F.transform("bases", base_tail)
    kind = (
        F.when(F.exists(bases, lambda b: b.isin("ABC", "ABCMeta")), "abstract").when(F.array_contains(bases, "Protocol"), "protocol")
        .when(F.array_contains(bases, "TypedDict"), "typeddict").when(F.exists("decorators", lambda d: d.rlike(r"dataclass")), "dataclass").when(F.array_contains(bases, "BaseModel"), "model")
    )
    contracts = classes.withColumn("kind", kind).where("kind is not null").select(F.col("file").alias("contract_file"), F.col("name").alias("contract"), "kind")
    children = classes.select("file", "name", F.explode("bases").alias("b")).select("file", F.col("name").alias("child"), base_tail(F.col("b")).alias("contract"))
    return contracts.join(children, "contract", "left")


def file_stats(elements: DataFrame, files: DataFrame) -> DataFrame:
    """Per file: lines, elements, complexity and quality."""
    from .scoring import quality

    lines = files.select(F.col("path").alias("file"), F.size(F.split("text", "\n")).alias("lines"))
    fn = elements.where("category in ('functions', 'methods')").groupBy("file").agg(
        F.count("*").alias("functions"), F.avg("complexity").alias("avg_complexity"), F.max("complexity").alias("max_complexity"), F.avg("line_count").alias("avg_length"),
        F.count_if(F.col("line_count") > LIMITS["many_lines"]).alias("long_functions"), F.count_if(F.col("depth") > LIMITS["depth"]).alias("deep_functions"),
    )
    classes = elements.where("category = 'classes'").groupBy("file").agg(F.count("*").alias("classes"))
    both = lines.join(fn, "file", "left").join(classes, "file", "left").na.fill(0)
    c = F.col
    return both.withColumn("quality", quality(c("avg_complexity"), c("avg_length"), c("long_functions"), c("deep_functions"), c("functions")))


def element_findings(elements: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """Findings on definitions and imports: file, line, rule_code, severity, message."""
    f = elements.where("category in ('functions', 'methods')")
    row = lambda df, code, severity, message: df.select("file", "line", F.lit(code).alias("rule_code"), F.lit(severity).alias("severity"), message.alias("message"))
    name = F.col("name")
    static = F.exists("decorators", lambda d: d == "staticmethod") & F.col("signature").rlike(r"^\(self\b")
    prop = F.exists("decorators", lambda d: d == "property")
    w = Window.partitionBy("file", "body_hash").orderBy("line")
    dup = f.where("body_hash is not null").withColumn("k", F.row_number().over(w)).withColumn("first", F.first("name").over(w)).where("k > 1")
    same = imports.groupBy("file", "module", "names", "alias", "level").agg(F.min("line").alias("first"), F.max("line").alias("line"), F.count("*").alias("n")).where("n > 1")
    parts = [
        row(f.where(F.col("complexity") > LIMITS["complexity"]), "C901", "medium", F.concat(name, F.lit(" is too complex: "), F.col("complexity").cast("string"))),
        row(f.where(F.col("line_count") > LIMITS["many_lines"]), "C902", "high", F.concat(name, F.lit(" is far too long: "), F.col("line_count").cast("string"))),
        row(f.where(F.col("line_count").between(LIMITS["lines"] + 1, LIMITS["many_lines"])), "C902", "medium", F.concat(name, F.lit(" is too long: "), F.col("line_count").cast("string"))),
        row(f.where(F.col("depth") > LIMITS["depth"]), "C905", "medium", F.concat(name, F.lit(" is nested too deep: "), F.col("depth").cast("string"))),
        row(f.where(F.col("n_args") > LIMITS["args"]), "R913", "medium", F.concat(name, F.lit(" takes too many arguments: "), F.col("n_args").cast("string"))),
        row(f.where(static), "B002", "high", F.concat(name, F.lit(" is static but takes self"))),
        row(f.where(prop & (F.col("line_count") > LIMITS["property"])), "B003", "medium", F.concat(name, F.lit(" is a property with too much in it"))),
        row(f.where(~F.col("typed") & F.col("signature").rlike(r":|->")), "T005", "low", F.concat(name, F.lit(" has incomplete annotations"))),
        row(f.where(F.col("signature").rlike(r"\w+: (?!Optional|.*\bNone\b[^=,]*=)[\w\[\]., ]+? = None\b")), "T004", "medium", F.concat(name, F.lit(" has a None default without an optional type"))),
        row(dup, "D001", "medium", F.concat(name, F.lit(" repeats "), F.col("first"))),
        row(unused_imports(imports, symbols), "I001", "medium", F.concat(F.lit("unused import "), F.col("bound"))),
        row(same, "I005", "low", F.concat(F.lit("imported again: "), F.col("module"))),
        row(imports.where("in_function"), "I006", "low", F.concat(F.lit("import inside a function: "), F.col("module"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fact_findings(facts: DataFrame) -> DataFrame:
    """Findings on handlers, properties and literals: file, line, rule_code, severity, message."""
    row = lambda df, code, severity, message: df.select("file", "line", F.lit(code).alias("rule_code"), F.lit(severity).alias("severity"), message.alias("message"))
    handlers = facts.where("kind = 'HANDLER'")
    return (
        row(handlers.where("name = 'broad' and detail = 'silent'"), "B006", "medium", F.lit("broad exception handler that shows nothing of the failure"))
        .unionByName(row(facts.where("kind = 'NO_VALUE'"), "B004", "high", F.concat("name", F.lit(" is a property without a value"))))
        .unionByName(row(facts.where((F.col("kind") == "LITERALS") & (F.col("n") >= LIMITS["literals"])), "M104", "low", F.concat("name", F.lit(" is a literal list of "), F.col("n").cast("string"))))
    )


def module_findings(files: DataFrame, imports: DataFrame, elements: DataFrame, facts: DataFrame, installed: list[str] | None = None, project_version: str | None = None) -> DataFrame:
    """Findings on modules: unresolvable imports (B005), cycles (I002), shadowed standard modules (I004), orphans (M102), versions that differ (M103).

    ``installed``: names of packages that can be imported besides the standard library; None leaves B005 out.
    """
    import sys

    std = sorted(sys.stdlib_module_names)
    row = lambda df, code, severity, message: df.select("file", F.coalesce("line", F.lit(1)).cast("int").alias("line"), F.lit(code).alias("rule_code"), F.lit(severity).alias("severity"), message.alias("message"))
    names = files.select(F.col("path").alias("file")).distinct()
    here = names.withColumn("line", F.lit(1))
    resolved = module_files(imports, names)
    stem = F.regexp_extract("file", r"([^/]+)\.pyi?$", 1)
    test = F.col("file").rlike(r"(^|/)tests?/|(^|/)(test_[^/]*|[^/]*_test|conftest)\.py$")
    edges = resolved.where("target is not null").select(F.col("file").alias("src"), F.col("target").alias("dst")).distinct()
    cyclic = graphs.strong_components(edges)
    cycle = cyclic.join(cyclic.groupBy("component").agg(F.count("*").alias("_n")).where("_n > 1"), "component").select(F.col("node").alias("file"), F.lit(1).alias("line"), "_n")
    imported = edges.select(F.col("dst").alias("file")).distinct()
    entry = F.col("file").rlike(r"(^|/)(__init__|__main__|main|app|cli|manage|setup|conf|wsgi|asgi)\.py$") | test
    has = elements.select("file").distinct()
    parts = [
        row(here.where(stem.isin(std) & ~test & (F.size(F.split("file", "/")) <= 2)), "I004", "medium", F.concat(stem, F.lit(" hides a module of the standard library"))),
        row(cycle, "I002", "high", F.concat(F.lit("part of a cycle of "), F.col("_n").cast("string"), F.lit(" files"))),
        row(here.where(~entry).join(imported, "file", "left_anti").join(has, "file", "left_semi"), "M102", "medium", F.lit("no file imports this one")),
    ]
    if installed is not None:
        top = F.split("module", r"\.")[0]
        lost = resolved.where((F.col("level") == 0) & F.col("target").isNull() & ~F.col("type_checking") & ~top.isin(sorted({*std, *installed})))
        parts.append(row(lost, "B005", "high", F.concat(F.lit("cannot be resolved: "), F.col("module"))))
    if project_version is not None:
        parts.append(row(facts.where((F.col("kind") == "VERSION") & (F.col("detail") != project_version)), "M103", "high", F.concat(F.lit("version "), F.col("detail"), F.lit(f" is not {project_version}"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Handles that say nothing about a design when tests patch them (fixed values).
NOISE = ("sys.stdout", "sys.stderr", "sys.stdin", "builtins.print", "builtins.input")


def patch_uses(facts: DataFrame) -> DataFrame:
    """What tests patch: file, test, line, kind, target, symbol, private."""
    symbol = F.element_at(F.split("detail", r"\."), -1)
    return facts.where("kind = 'PATCH'").select(
        "file", F.col("function").alias("test"), "line", F.col("name").alias("kind"), F.col("detail").alias("target"), symbol.alias("symbol"),
        (symbol.startswith("_") & ~symbol.rlike(r"^__\w+__$")).alias("private"),
    )


def patch_groups(uses: DataFrame, by: str = "target", least: int = 1, target: str = "", private: bool = False, suppress: bool = True) -> DataFrame:
    """Patches grouped by target, test or file with their pressure: group, n, tests, n_private, most, score.

    ``target``: a part of the target, or a glob.
    """
    from .scoring import pressure

    u = uses
    if suppress:
        u = u.where(~F.col("target").isin(*NOISE))
    if private:
        u = u.where("private")
    if target:
        glob = any(c in target for c in "*?[")
        pattern = "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\Q" + c + "\\E" for c in target) + "$"
        u = u.where(F.col("target").rlike(pattern) if glob else F.contains(F.lower("target"), F.lit(target.lower())))
    key = {"target": F.col("target"), "test": F.concat_ws("::", "file", "test"), "file": F.col("file")}[by]
    per = u.groupBy(key.alias("group"), "file", "test").agg(F.count("*").alias("k"), F.count_if("private").alias("p"))
    g = per.groupBy("group").agg(F.sum("k").alias("n"), F.count("*").alias("tests"), F.sum("p").alias("n_private"), F.max("k").alias("most")).where(F.col("n") >= least)
    return g.withColumn("score", pressure(F.col("n"), F.col("n_private"), F.col("most")))


# --- inside functions: over the table of events ---


def in_range(events: DataFrame, lo: int, hi: int) -> DataFrame:
    return events.where(F.col("line").between(lo, hi))


def inputs(events: DataFrame, lo: int, hi: int) -> DataFrame:
    """Variables that a range reads before it writes them, with the first write before the range."""
    v = events.where("kind in ('READ', 'WRITE')")
    first = in_range(v, lo, hi).groupBy("file", "function", "text").agg(F.min_by("kind", F.struct("line", "kind")).alias("first"), F.min("line").alias("line")).where("first = 'READ'")
    written = v.where((F.col("kind") == "WRITE") & (F.col("line") < lo)).groupBy("file", "function", "text").agg(F.min("line").alias("written_at"))
    return first.join(written, ["file", "function", "text"]).select("file", "function", F.col("text").alias("variable"), F.col("line").alias("read_at"), "written_at")


def outputs(events: DataFrame, lo: int, hi: int) -> DataFrame:
    """Variables that a range writes, with their last write and the first event after the range."""
    v = events.where("kind in ('READ', 'WRITE')")
    last = in_range(v, lo, hi).where("kind = 'WRITE'").groupBy("file", "function", "text").agg(F.max("line").alias("written_at"))
    later = v.where(F.col("line") > hi).groupBy("file", "function", "text").agg(F.min("line").alias("used_at"))
    return last.join(later, ["file", "function", "text"]).withColumnRenamed("text", "variable")


def effects(events: DataFrame) -> DataFrame:
    e = events.where(F.col("kind").startswith("EFFECT:"))
    return e.groupBy("file", "function").agg(F.sort_array(F.collect_set(F.substring("kind", 8, 20))).alias("effects"), F.count("*").alias("n"))  # as many as there are categories


def effects_through_calls(events: DataFrame, elements: DataFrame, depth: int = 3) -> DataFrame:
    """Effect categories that each function reaches within some calls."""
    own = events.where(F.col("kind").startswith("EFFECT:")).select(F.element_at(F.split("function", r"\."), -1).alias("node"), F.substring("kind", 8, 20).alias("effect")).distinct()
    edges = call_edges(elements).select(F.element_at(F.split("caller", r"\."), -1).alias("src"), F.col("bare").alias("dst")).distinct()
    reach = own
    for _ in range(max(1, min(graphs.DEEPEST, depth))):
        reach = reach.unionByName(edges.join(reach, edges.dst == reach.node).select(F.col("src").alias("node"), "effect")).distinct()
    return reach


def key_heatmap(events: DataFrame) -> DataFrame:
    """Different keys read from each mapping variable of a function."""
    k = events.where("kind = 'KEY'").select("file", "function", F.regexp_extract("text", r"^(.*)\[", 1).alias("variable"), F.regexp_extract("text", r"\[(.*)\]$", 1).alias("key"))
    return k.groupBy("file", "function", "variable").agg(F.count_distinct("key").alias("keys")).orderBy(F.desc("keys"), "file", "function", "variable")
