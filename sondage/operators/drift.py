"""Schemas that drift between files: versions, changes and one consistent table.

Each file is reduced, where it is read, to the set of its paths and JSON types:
its schema fingerprint. Files are range-sorted by series and sequence number, so
neighbours meet without gathering a series; only the first and last schema of a
partition travel to the driver (two small rows per partition). Every difference
becomes a recorded change, and the changes of a series become explicit migration
steps (rename, default, cast), chained into the rule of each schema version. A
version is known by the fingerprint that all its files share; each file is
routed by its own fingerprint to the version of its stretch of the series.

Defined results: lines that are blank, broken or not an object are no records;
null values show no path; files delivered twice (same series and sequence
number) count once; a file without manifest entry is ignored, as is one without
series or number; a file without a record has an empty schema; if several paths
could be a rename, those most alike in values, presence and name pair up; extra
columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import sorted_map, stage

_KIND = {str: "string", int: "number", float: "number", bool: "boolean", dict: "object", list: "array"}
_SKETCH = 8  # smallest value hashes kept of a path in a file


def parse_record(line: str | None) -> dict | None:
    if not line or not line.strip():
        return None
    try:
        v = json.loads(line)
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def walk(record: dict) -> Iterator[tuple[str, object]]:
    """(path, value) of everything not null in a record."""
    stack: list[tuple[str, object]] = [("", record)]
    while stack:
        at, v = stack.pop()
        if isinstance(v, dict):
            inner = [(f"{at}.{k}" if at else k, x) for k, x in v.items() if x is not None]
        else:
            inner = [(f"{at}[]", x) for x in v if x is not None]
        for path, x in inner:
            yield path, x
            if isinstance(x, (dict, list)):
                stack.append((path, x))


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file_id, raw_line -> one row per file, path and type in a batch, with counts and a sketch of the values."""
    for batch in batches:
        seen: dict[tuple, list] = {}
        for f, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if f is None or (record := parse_record(line)) is None:
                continue
            for path, v in walk(record):
                kind = _KIND[type(v)]
                s = seen.get((f, path, kind))
                if s is None:
                    s = seen[(f, path, kind)] = [0, 0, set()]
                s[0] += 1
                if kind in ("string", "number", "boolean"):
                    text = v if isinstance(v, str) else json.dumps(v)
                    s[1] += len(text)
                    s[2].add(int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=6).digest(), "big"))
                    if len(s[2]) > 4 * _SKETCH:
                        s[2] = set(sorted(s[2])[:_SKETCH])
        if seen:
            yield pa.RecordBatch.from_pydict(
                {
                    "file_id": pa.array([k[0] for k in seen], pa.int64()),
                    "path": pa.array([k[1] for k in seen], pa.string()),
                    "kind": pa.array([k[2] for k in seen], pa.string()),
                    "n": pa.array([v[0] for v in seen.values()], pa.int64()),
                    "chars": pa.array([v[1] for v in seen.values()], pa.int64()),
                    "sketch": pa.array([sorted(v[2])[:_SKETCH] for v in seen.values()], pa.list_(pa.int64())),
                }
            )


def file_schemas(files: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per file of a series: series_id, file_seq, version fingerprint and the schema as JSON."""
    observed = lines.select(F.col("file_id").cast("bigint"), F.col("raw_line").cast("string")).mapInArrow(
        _observe, "file_id bigint, path string, kind string, n bigint, chars bigint, sketch array<bigint>"
    )
    known = files.where("series_id is not null and file_seq is not null").select("file_id", "series_id", "file_seq")
    merged = (
        known.join(observed, "file_id", "left")
        .groupBy("series_id", "file_seq", "path", "kind")
        .agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.array_compact(F.array(*[F.min(F.try_element_at("sketch", F.lit(i + 1))) for i in range(_SKETCH)])).alias("sketch"))
    )
    # collected per file: as many entries as a file has paths, not rows
    entry = F.struct("path", "kind", "n", "chars", "sketch")
    one = merged.groupBy("series_id", "file_seq").agg(
        F.array_sort(F.collect_list(F.when(F.col("path").isNotNull(), entry))).alias("entries")
    )
    return one.select(
        "series_id",
        "file_seq",
        F.sha2(F.to_json(F.transform("entries", lambda e: F.concat_ws(":", e["path"], e["kind"]))), 256).alias("fingerprint"),
        F.to_json("entries").alias("schema"),
    )


def _load(schema: str) -> dict[str, dict]:
    out: dict[str, dict] = {}
    for e in json.loads(schema):
        p = out.setdefault(e["path"], {"types": set(), "n": 0, "chars": 0, "sketch": set()})
        p["types"].add(e["kind"])
        p["n"] += e["n"]
        p["chars"] += e["chars"]
        p["sketch"] |= set(e.get("sketch") or ())
    return out


def parent(path: str) -> str:
    return path[:-2] if path.endswith("[]") else path.rpartition(".")[0]


def _alike(a: str, b: str, old: dict, new: dict) -> float:
    x, y = old[a], new[b]
    ratio = lambda p, q: min(p, q) / max(p, q) if max(p, q) else 1.0
    shared = len(x["sketch"] & y["sketch"]) / max(1, min(len(x["sketch"]), len(y["sketch"])))
    names = SequenceMatcher(None, a.rpartition(".")[2].lower(), b.rpartition(".")[2].lower()).ratio()
    return 2 * shared + ratio(x["n"], y["n"]) + ratio(x["chars"] / x["n"], y["chars"] / y["n"]) + names


def compare_schemas(old: dict[str, dict], new: dict[str, dict]) -> list[tuple[str, str, str, str]]:
    """The changes (kind, old_path, new_path, old types) from one file's schema to the next."""
    gone, came = set(old) - set(new), set(new) - set(old)
    retyped = {p for p in set(old) & set(new) if old[p]["types"] != new[p]["types"]}
    changed = gone | came | retyped

    def below(path: str) -> bool:
        p = parent(path)
        while p:
            if p in changed:
                return True
            p = parent(p)
        return False

    gone, came, retyped = ({p for p in s if not below(p)} for s in (gone, came, retyped))
    groups: dict[tuple, tuple[list, list]] = defaultdict(lambda: ([], []))
    for side, (paths, schema) in enumerate(((gone, old), (came, new))):
        for p in sorted(paths):
            groups[(parent(p), frozenset(schema[p]["types"]))][side].append(p)
    types = lambda s: ",".join(sorted(s))
    out = []
    for a, b in groups.values():
        for _, x, y in sorted(((-_alike(x, y, old, new), x, y) for x in a for y in b)):
            if x in gone and y in came:
                out.append(("renamed", x, y, types(old[x]["types"])))
                gone.discard(x)
                came.discard(y)
    out += [("added", "", p, "") for p in came] + [("removed", p, "", types(old[p]["types"])) for p in gone]
    out += [("retyped", p, p, types(old[p]["types"])) for p in retyped]
    return sorted(out)


_STEP = "what string, series_id string, file_seq bigint, change_kind string, old_path string, new_path string, old_types string, schema string"


def _step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last: tuple | None = None
    names = [c.split()[0] for c in _STEP.split(", ")]
    kinds = [pa.int64() if c.endswith("bigint") else pa.string() for c in _STEP.split(", ")]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
    for batch in batches:
        out = []
        for s, q, schema in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if last is None:
                out.append((f"first {part}", s, q, None, None, None, None, schema))
            elif last[0] == s:
                out += [("change", s, q, *c, None) for c in compare_schemas(_load(last[2]), _load(schema))]
            last = (s, q, schema)
        if out:
            yield pack(out)
    if last is not None:
        yield pack([(f"last {part}", last[0], last[1], None, None, None, None, last[2])])


def schema_changes(schemas: DataFrame) -> DataFrame:
    """Every change and the file in which it first shows: series_id, file_seq, change_kind, old_path, new_path, old_types."""
    spark = schemas.sparkSession
    steps = stage(sorted_map(schemas.select("series_id", "file_seq", "schema"), ["series_id", "file_seq"], _step, _STEP), "steps")
    edges = defaultdict(dict)
    for r in steps.where("what <> 'change'").collect():  # two rows per partition
        name, part = r.what.split()
        edges[int(part)][name] = r
    across = []
    order = [edges[k] for k in sorted(edges)]
    for a, b in zip(order, order[1:]):
        x, y = a["last"], b["first"]
        if x.series_id == y.series_id:
            across += [(y.series_id, y.file_seq, *c) for c in compare_schemas(_load(x.schema), _load(y.schema))]
    cols = "series_id string, file_seq bigint, change_kind string, old_path string, new_path string, old_types string"
    inside = steps.where("what = 'change'").select(*(c.split()[0] for c in cols.split(", ")))
    return inside.unionByName(spark.createDataFrame(across, cols)) if across else inside


# --- migration ---------------------------------------------------------------------------------------------------


def canonical(path: str, rename: dict[str, str]) -> str:
    """A version's path in the canonical layout, key by key from the outermost, as renamed parents may hold renamed keys."""
    here = canon = ""
    for part in path.split("."):
        key = part.rstrip("[]")
        tail = part[len(key) :]
        here = f"{here}.{key}" if here else key
        key = rename.get(here, here).rpartition(".")[2]
        canon = (f"{canon}.{key}" if canon else key) + tail
        here += tail
    return canon


def _chain(changes: pd.DataFrame) -> pd.DataFrame:
    """The changes of one series, folded in order into the rule of each version.

    A rule maps the version's paths to canonical ones (those of the series' first file), names the types to cast to, and
    gives the value of each field that comes or goes along the series where a record lacks it. Version 1 precedes all changes.
    """
    rename: dict[str, str] = {}
    cast: dict[str, str] = {}
    default: dict[str, None] = {}
    out = [(0, -(2**62), "{}", "{}")]
    changes = changes.sort_values(["file_seq", "change_kind", "old_path", "new_path"], kind="stable")
    for seq, step in changes.groupby("file_seq", sort=True):
        for kind, a, b, types in zip(step.change_kind, step.old_path, step.new_path, step.old_types):
            if kind == "renamed":
                c = canonical(a, rename)
                # what is below moves along with its parent
                rename = {b + p[len(a) :] if p.startswith((a + ".", a + "[")) else p: x for p, x in rename.items() if p != a}
                if c.rpartition(".")[2] != b.rpartition(".")[2]:
                    rename[b] = c
            elif kind == "retyped":
                cast.setdefault(canonical(a, rename), types)
            else:
                path = canonical(a or b, rename)
                if not path.endswith("[]"):  # an array may be without elements
                    default[path] = None
        out.append((len(out), int(seq), json.dumps(rename, sort_keys=True), json.dumps(cast, sort_keys=True)))
    # the layout of a series has all fields that any of its files has, so defaults hold for all versions
    rule = [json.dumps({"rename": json.loads(x), "cast": json.loads(y), "default": default}, sort_keys=True) for _, _, x, y in out]
    table = pd.DataFrame({"series_id": changes.series_id.iloc[0], "since_seq": [q for _, q, _, _ in out], "version": [n + 1 for n, _, _, _ in out], "rule": rule})
    table["until_seq"] = table["since_seq"].shift(-1).fillna(2**62).astype("int64")
    return table


def migration_rules(changes: DataFrame) -> DataFrame:
    """series_id, since_seq, until_seq, version, rule. Grouped are changes, which number as a series' layouts, not as its rows."""
    return changes.groupBy("series_id").applyInPandas(
        _chain, "series_id string, since_seq bigint, version bigint, rule string, until_seq bigint"
    )


#: Of several types that a field had, the one to cast to comes first: what holds the value as it is, then what holds any.
_WIDEST = ("number", "boolean", "string", "array", "object")


def cast_value(v, kind: str):
    """A value as one of the given JSON types (with commas between), of several as the one that holds most; null where that cannot be.

    Where an object is asked for, any other value gets an object of its own.
    """
    if v is None or _KIND[type(v)] in (kinds := kind.split(",")):
        return v
    if len(kinds) > 1:
        fitting = [x for k in _WIDEST if k in kinds and (x := cast_value(v, k)) is not None]
        return fitting[0] if fitting else None
    if kind == "string":
        return json.dumps(v, ensure_ascii=False, sort_keys=True)
    if kind == "boolean":
        return {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}.get(str(v).lower())
    if kind == "number":
        try:
            return json.loads(v) if isinstance(v, str) and type(json.loads(v)) in (int, float) else int(v)
        except (ValueError, TypeError):
            return None
    return [v] if kind == "array" else {"value": v}


def migrate(record: dict, rename: dict[str, str], cast: dict[str, str], uncast: dict | None = None, default: dict | None = None) -> dict:
    """A record in the canonical layout: keys renamed, values cast, missing fields given their default, at any depth.

    ``uncast`` gets each value whose cast does not fit, as it was, by its canonical path with positions.
    """

    lacking: dict[str, dict] = defaultdict(dict)
    for path, v in (default or {}).items():
        lacking[parent(path)][path.rpartition(".")[2]] = v

    def fit(v, x, c: str, at: str):
        if c not in cast:
            return x
        y = cast_value(x, cast[c])
        if uncast is not None and x is not None and (y is None or (isinstance(y, dict) and not isinstance(x, dict))):
            uncast[at] = v
        return y

    def go(v, here: str, canon: str, at: str):
        if isinstance(v, dict):
            out = {}
            for k, x in v.items():
                p = f"{here}.{k}" if here else k
                c = rename.get(p)
                key = c.rpartition(".")[2] if c is not None else k
                if key != k and key in v and (f"{here}.{key}" if here else key) not in rename:
                    key = k  # another field has the old name by now: both stay
                c = f"{canon}.{key}" if canon else key
                a = f"{at}.{key}" if at else key
                out[key] = fit(x, go(x, p, c, a), c, a)
            for key, x in lacking.get(canon, {}).items():
                out.setdefault(key, x)
            return out
        if isinstance(v, list):
            c = f"{canon}[]"
            return [fit(x, go(x, f"{here}[]", c, f"{at}[{i}]"), c, f"{at}[{i}]") for i, x in enumerate(v)]
        return v

    return go(record, "", "", "")


def schema_versions(schemas: DataFrame, changes: DataFrame) -> DataFrame:
    """The versions of each series: series_id, version, fingerprint, since_seq, until_seq (the next one's first), rule.

    A version begins with each file that differs from the one before; all its files have the fingerprint of its first.
    """
    first = schemas.groupBy("series_id").agg(F.min("file_seq").alias("first_seq"))
    changed = changes.select("series_id").distinct()
    rules = migration_rules(changes).unionByName(
        first.join(changed, "series_id", "left_anti").selectExpr("series_id", "-(1L << 62) as since_seq", "1L as version", "cast(null as string) as rule", "(1L << 62) as until_seq")
    )
    begun = rules.join(first, "series_id").withColumn("file_seq", F.greatest("since_seq", "first_seq"))
    return begun.join(schemas.select("series_id", "file_seq", "fingerprint"), ["series_id", "file_seq"]).select(
        "series_id", "version", "fingerprint", F.col("file_seq").alias("since_seq"), "until_seq", "rule"
    )


def consistent_records(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Every parsable record of every file in the canonical layout of its series.

    series_id, file_seq, line_no, version, type, uuid, session_id, ts, cwd, message (JSON), rest (JSON), uncast (JSON: path and value of each
    value that does not fit the type it is cast to, null where all do).
    """
    schemas = stage(file_schemas(files, lines), "schemas")
    versions = stage(schema_versions(schemas, stage(schema_changes(schemas), "changes")), "versions")
    known = files.where("series_id is not null and file_seq is not null")
    # a file delivered twice counts once: the delivery with the smallest id
    once = known.groupBy("series_id", "file_seq").agg(F.min("file_id").alias("file_id"))
    marked = once.join(schemas.select("series_id", "file_seq", "fingerprint"), ["series_id", "file_seq"])
    routed = marked.join(versions, ["series_id", "fingerprint"]).where("file_seq >= since_seq and file_seq < until_seq").select("file_id", "series_id", "file_seq", "version", "rule")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str | None, dict] = {None: {"rename": {}, "cast": {}, "default": {}}}
        text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        for batch in batches:
            keep, rows = [], []
            for i, (rule, line) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                if (record := parse_record(line)) is None:
                    continue
                if rule not in loaded:
                    loaded[rule] = json.loads(rule)
                uncast: dict = {}
                try:
                    r = migrate(record, **loaded[rule], uncast=uncast)
                except RecursionError:  # nested beyond reason: left in its own layout
                    r, uncast = record, {}
                keep.append(i)
                rows.append((*(text(r.pop(k, None)) for k in ("type", "uuid", "sessionId", "timestamp", "cwd", "message")), json.dumps(r, ensure_ascii=False, sort_keys=True), json.dumps(uncast, ensure_ascii=False, sort_keys=True) if uncast else None))
            if rows:
                head = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays(
                    [*(head.column(i) for i in range(4)), *(pa.array(c, pa.string()) for c in zip(*rows))],
                    names=["series_id", "file_seq", "line_no", "version", "type", "uuid", "session_id", "ts", "cwd", "message", "rest", "uncast"],
                )

    joined = lines.select("file_id", "line_no", "raw_line").join(routed, "file_id").select(
        F.col("series_id").cast("string"), F.col("file_seq").cast("bigint"), F.col("line_no").cast("bigint"), F.col("version").cast("bigint"), "rule", "raw_line"
    )
    return joined.mapInArrow(
        apply,
        "series_id string, file_seq bigint, line_no bigint, version bigint, type string, uuid string, session_id string, ts string, cwd string, message string, rest string, uncast string",
    )
