import json
import random

import pytest
from conftest import block, message

from sondage.operators import drift as D
from sondage.operators import features as X
from sondage.operators import shredding as S


def use(id_, name="T"):
    return block("tool_use", id=id_, name=name)


def result(id_, content=None, err=None):
    return block("tool_result", tool_use_id=id_, content=content, is_error=err)


# --- nested records ---


def brute_links(rows):
    seen, calls, out, results = set(), {}, set(), []

    def array(c):
        if isinstance(c, str):
            try:
                c = json.loads(c)
            except ValueError:
                return None
        return c if isinstance(c, list) else None

    def inner(a, path, uuid, session):
        own = {}
        for i, b in enumerate(a):
            if isinstance(b, dict) and b.get("type") == "tool_use":
                own.setdefault(b.get("id"), f"{path}/{i}")
        for i, b in enumerate(a):
            if isinstance(b, dict) and b.get("type") == "tool_result":
                if b.get("tool_use_id") in own:
                    out.add((session, uuid, own[b["tool_use_id"]], uuid, f"{path}/{i}"))
                if (n := array(b.get("content"))) is not None:
                    inner(n, f"{path}/{i}", uuid, session)

    for r in rows:
        uuid, session, content = r[1], r[4], (r[6] or (None, []))[1]
        if uuid in seen:
            continue
        seen.add(uuid)
        for i, b in enumerate(content):
            if b[0] == "tool_use":
                calls[(session, b[4])] = (uuid, str(i))
            if b[0] == "tool_result":
                results.append((session, b[6], uuid, str(i)))
                if (n := array(b[7])) is not None:
                    inner(n, str(i), uuid, session)
    out |= {(s, *calls[(s, i)], u, p) for s, i, u, p in results if (s, i) in calls}
    return out


def nested(rng, depth):
    blocks = []
    for i in range(rng.randint(0, 4)):
        kind = rng.choice(["text", "tool_use", "tool_result", "tool_result"])
        if kind == "text":
            blocks.append({"type": "text", "text": "[not json"})
        elif kind == "tool_use":
            blocks.append({"type": "tool_use", "id": f"c{i}", "name": "N", "input": {"a": [1]}})
        else:
            content = rng.choice(["plain", None, "[1, 2", nested(rng, depth - 1) if depth else []])
            blocks.append({"type": "tool_result", "tool_use_id": f"c{rng.randint(0, 3)}", "content": content, "is_error": rng.choice([True, False, None])})
    return blocks


def links(df):
    return {tuple(r) for r in S.link_results(df).collect()}


def test_links_against_brute_force(messages):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        blocks = [rng.choice([use(f"t{i}"), result(f"t{rng.randint(0, i)}", json.dumps(nested(rng, 3))), result("gone"), block("text", text="x"), block(None)]) for _ in range(rng.randint(0, 4))]
        blocks = [b for k, b in enumerate(blocks) if b[0] != "tool_use" or use(f"t{i}") not in blocks[:k]]
        rows.append(message(f"u{i}", session=rng.choice(["hot", "hot", "a"]), blocks=blocks))
    assert links(messages(rows + rows[:30]).repartition(6)) == brute_links(rows) != set()


def test_links_edge_cases(messages):
    assert links(messages([])) == set()
    deep = "[" * 50_000
    rows = [
        message("a", blocks=None), message("b", blocks=[]), message("c", blocks=[block(None), use(None), result(None)]),
        message("d", blocks=[result("x", deep), result("x", "[]"), result("x", '[{"type":"tool_use","id":"y"},{"type":"tool_result","tool_use_id":"y"}] tail')]),
        message("e", session=None, blocks=[use("q"), result("q")]), message("f", blocks=[use("x")]),
        message("g", blocks=[result("x", '\n\t [null, {"type":"tool_use","id":1}, {"type":"tool_result","tool_use_id":1}]')]),
    ]
    assert links(messages(rows)) == {("s", "f", "0", "d", "0"), ("s", "f", "0", "d", "1"), ("s", "f", "0", "d", "2"), ("s", "f", "0", "g", "0"), ("s", "g", "0/1", "g", "0/2")}


def test_level_sequences():
    import numpy as np

    assert [p.tolist() for p in S.positions(np.array([0, 1, 2, 2, 1, 0, 2]), 2)] == [[0, 1, 1, 1, 2, 0, 0], [0, 0, 1, 2, 0, 0, 1]]


def test_tables_keep_their_links(messages):
    inner = [{"type": "text", "text": "deep"}, {"type": "tool_use", "id": "k", "name": "N", "input": {"a": 1}}]
    rows = [message("a", blocks=[block("thinking", thinking="hm"), use("k"), result("k", json.dumps(inner), True)])]
    t = S.record_tables(messages(rows + rows))
    assert t["messages"].count() == 1
    assert {(r.path, r.parent_path, r.kind, r.text) for r in t["texts"].collect()} == {("0", "", "thinking", "hm"), ("2/0", "2", "text", "deep")}
    assert {(r.path, r.use_id, r.input) for r in t["calls"].collect()} == {("1", "k", None), ("2/1", "k", '{"a":1}')}
    assert [(r.path, r.use_id, r.is_error, r.call_uuid, r.call_path) for r in t["results"].collect()] == [("2", "k", True, "a", "1")]


def test_results_without_call_stay(messages):
    rows = [message("a", blocks=[result(None), result("x"), use("y"), result("y"), block(None), None]), message("b", session=None, blocks=[use("q"), result("q")]), message("c", blocks=None)]
    t = S.record_tables(messages(rows + rows[:2]))
    assert {(r.uuid, r.path, r.call_path) for r in t["results"].collect()} == {("a", "0", None), ("a", "1", None), ("a", "3", "2"), ("b", "1", None)}
    assert {(r.uuid, r.n_blocks) for r in t["messages"].collect()} == {("a", 6), ("b", 2), ("c", None)}
    # a block without any field is there, a null block is not
    assert {(r.path, r.block_type) for r in S.flatten_blocks(messages(rows[:1])).collect()} == {("0", "tool_result"), ("1", "tool_result"), ("2", "tool_use"), ("3", "tool_result"), ("4", None)}


# --- drift ---


def series(spark, files, extra=True):
    from pyspark.sql import functions as F

    manifest = spark.createDataFrame([(i, s, q, "f", None) for i, (s, q, _) in enumerate(files)], "file_id bigint, series_id string, file_seq bigint, file_name string, n_lines int")
    lines = spark.createDataFrame([(i, k, x) for i, (_, _, ls) in enumerate(files) for k, x in enumerate(ls)] or [], "file_id bigint, line_no int, raw_line string")
    if extra:
        lines = lines.withColumns({c: F.lit("x") for c in ("series_id", "rule", "version", "path", "file_seq")})
        manifest = manifest.withColumns({c: F.lit("x") for c in ("path", "kind", "n")})
    return manifest, lines


def found(spark, files):
    rows = D.schema_changes(D.file_schemas(*series(spark, files))).collect()
    return {(r.series_id, r.file_seq, r.change_kind, r.old_path, r.new_path) for r in rows}


def test_kinds_of_change(spark):
    j = json.dumps
    files = [
        ("s", 1, [j({"type": "a", "m": {"c": [{"err": True, "x": "t"}]}}), "", "  ", "{broken", "null", "[1]"]),
        ("s", 2, [j({"kind": "a", "m": {"c": [{"err": True, "x": "t"}]}})]),
        ("s", 2, [j({"kind": "a", "m": {"c": [{"err": True, "x": "t"}]}})]),  # delivered twice
        ("s", 4, [j({"kind": 1, "m": {"c": [{"err": "true", "x": [{"t": "t"}]}], "u": {"n": 1}}})]),
        ("s", 5, [j({"kind": 1, "gone": None})]),
        ("t", 5, [j({"q": 1})]),
        (None, 1, [j({"q": 1})]),
    ]
    c = "m.c[]"
    assert found(spark, files) == {
        ("s", 2, "renamed", "type", "kind"), ("s", 4, "retyped", "kind", "kind"), ("s", 4, "retyped", f"{c}.err", f"{c}.err"),
        ("s", 4, "retyped", f"{c}.x", f"{c}.x"), ("s", 4, "added", "", "m.u"), ("s", 5, "removed", "m", ""),
    }


def test_drift_empty_and_long(spark):
    assert found(spark, []) == set()
    assert found(spark, [("s", 1, []), ("s", 2, ["\x00", "{" * 100_000])]) == set()
    assert found(spark, [("s", 1, []), ("s", 2, [json.dumps({"a": "x" * 500_000})])]) == {("s", 2, "added", "", "a")}


def test_neighbours_meet_across_partitions(spark):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        files = [("hot", q, [json.dumps({f"v{q}": q})]) for q in range(40)]
        assert found(spark, files) == {("hot", q, "renamed", f"v{q - 1}", f"v{q}") for q in range(1, 40)}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_one_consistent_table(spark):
    j = json.dumps
    files = [
        ("s", 1, [j({"type": "user", "uuid": "1", "message": {"content": [{"is_error": False}]}}), "bad"]),
        ("s", 2, [j({"kind": "user", "uuid": "2", "message": {"content": [{"failed": False}]}})]),
        ("s", 3, [j({"kind": 7, "uuid": "3", "message": {"content": [{"failed": "true"}]}})]),
    ]
    rows = sorted(D.consistent_records(*series(spark, files)).collect(), key=lambda r: r.uuid)
    assert [(r.file_seq, r.version, r.type) for r in rows] == [(1, 1, "user"), (2, 2, "user"), (3, 3, "7")]
    assert [json.loads(r.message)["content"][0] for r in rows] == [{"is_error": False}, {"is_error": False}, {"is_error": True}]
    assert D.consistent_records(*series(spark, [])).count() == 0


def test_no_value_is_lost_by_a_cast(spark):
    j = json.dumps
    files = [
        ("s", 1, [j({"uuid": "1", "message": {"usage": {"n": 1}, "size": 1, "c": [{"ok": True}]}})]),
        ("s", 2, [j({"uuid": "2", "message": {"usage": 17, "size": "big", "c": [{"ok": "yes"}, {"ok": "perhaps"}]}})]),
        ("s", 3, [j({"uuid": "3", "message": {"usage": 18, "size": "true", "c": [{"ok": "no"}]}})]),
    ]
    rows = sorted(D.consistent_records(*series(spark, files)).collect(), key=lambda r: r.uuid)
    assert [json.loads(r.message)["usage"] for r in rows] == [{"n": 1}, {"value": 17}, {"value": 18}]
    assert [json.loads(r.uncast or "{}") for r in rows] == [
        {}, {"message.usage": 17, "message.size": "big", "message.c[1].ok": "perhaps"}, {"message.usage": 18, "message.size": "true"},
    ]


def test_versions_are_known_by_their_fingerprint(spark):
    j = json.dumps
    files = [("s", q, [j({"uuid": str(q), **x})]) for q, x in enumerate(({"a": 1}, {"a": 2}, {"a": "x"}, {"a": 3}, {"b": 4}), 1)] + [("t", 1, [j({"uuid": "9"})])]
    manifest, lines = series(spark, files)
    schemas = D.file_schemas(manifest, lines)
    rows = {(r.series_id, r.version): r for r in D.schema_versions(schemas, D.schema_changes(schemas)).collect()}
    assert {k: (r.since_seq, min(r.until_seq, 99)) for k, r in rows.items()} == {("s", 1): (1, 3), ("s", 2): (3, 4), ("s", 3): (4, 5), ("s", 4): (5, 99), ("t", 1): (1, 99)}
    prints = [rows["s", v].fingerprint for v in (1, 2, 3, 4)]
    assert prints[0] == prints[2] and len(set(prints)) == 3  # the layout came back
    got = {r.uuid: (r.version, json.loads(r.rest)["a"] if r.series_id == "s" else None) for r in D.consistent_records(manifest, lines).collect()}
    assert got == {"1": (1, 1), "2": (1, 2), "3": (2, None), "4": (3, 3), "5": (4, 4), "9": (1, None)}


def test_several_old_types():
    assert D.cast_value("x", "number,string") == "x" and D.cast_value(True, "number,string") == "true" or D.cast_value(True, "number,string") == 1
    assert D.cast_value([1], "number,string") == "[1]" and D.cast_value({"a": 1}, "boolean,object") == {"a": 1} and D.cast_value("zz", "boolean,number") is None


def test_fields_that_come_and_go_get_defaults(spark):
    j = json.dumps
    files = [
        ("s", 1, [j({"uuid": "1", "old": {"k": 1}, "message": {"c": [{"t": 1}]}})]),
        ("s", 2, [j({"uuid": "2", "old": {"k": 1}, "message": {"c": [{"t": 1, "caller": "x"}, {"t": 2}], "more": []}})]),
        ("s", 3, [j({"uuid": "3", "message": {"c": [{"t": 1, "caller": "x"}], "more": []}})]),
    ]
    rows = sorted(D.consistent_records(*series(spark, files)).collect(), key=lambda r: r.uuid)
    assert [r.version for r in rows] == [1, 2, 3]
    assert [json.loads(r.rest) for r in rows] == [{"old": {"k": 1}}, {"old": {"k": 1}}, {"old": None}]
    assert [json.loads(r.message) for r in rows] == [
        {"c": [{"t": 1, "caller": None}], "more": None}, {"c": [{"t": 1, "caller": "x"}, {"t": 2, "caller": None}], "more": []},
        {"c": [{"t": 1, "caller": "x"}], "more": []},
    ]


def test_rules_chain_below_a_renamed_parent(spark):
    j = json.dumps
    layouts = [
        {"p": {"old": [{"leaf": "x", "n": 1}]}}, {"p": {"new": [{"leaf": "x", "n": 1}]}},  # the parent, then what is below
        {"p": {"new": [{"twig": "x", "n": 1}]}}, {"p": {"new": [{"twig": "x", "n": "1"}]}},
        {"q": {"new": [{"twig": "x", "n": "1"}]}}, {"q": {"last": [{"twig": "x", "n": "1"}]}},  # and a parent above all that
    ]
    files = [("s", k + 1, [j({"uuid": str(k), **x})]) for k, x in enumerate(layouts)]
    rows = D.consistent_records(*series(spark, files)).collect()
    assert len(rows) == 6 and {(r.rest, r.uncast) for r in rows} == {(j(layouts[0]), None)}
    assert D.migrate({"a": 1, "b": 2}, {"b": "a"}, {}) == {"a": 1, "b": 2} and D.migrate({"b": 2}, {"b": "a"}, {}) == {"a": 2}


# --- features ---


def test_features(spark, messages):
    tools = spark.createDataFrame([("Read", "b"), ("my tool", "x"), ("my_tool", "x"), (None, "n")], "tool_name string, family string")
    entities = spark.createDataFrame([("s", 1), ("t", 1), ("t", 2), (None, 3)], "session_id string, i int")
    rows = [
        message("a", ts="2024-01-01T00:00:00Z", role="assistant", blocks=[use("1", " READ"), use("2", "Read"), use("3", "other"), use(None, "read"), use(None, "read")]),
        message("b", ts="2024-01-01T00:00:05Z", blocks=[result("1", err=True), result("1", err=True), result("2"), result("9", err=True), result(None, err=True)]),
        message("c", ts="2024-01-01T00:01:00Z", session="zz", blocks=[use("1", "my_tool")]),
    ]
    for block_size in (1, 34):
        got = {r.session_id: r.asDict() for r in X.feature_table(entities, messages(rows + rows), tools, block_size).collect()}
        assert set(got) == {"s", "t"}
        s = got["s"]
        assert (s["total_calls"], s["total_failed"], s["n_tools"], s["since_last_s"]) == (4, 2, 1, 60.0)
        assert (s["Read_calls"], s["Read_failed"], s["Read_since_s"], s["my_tool_calls"], s["my_tool_2_calls"]) == (4, 2, 60.0, 0, 0)
        assert (got["t"]["total_calls"], got["t"]["since_last_s"], got["t"]["Read_since_s"]) == (0, None, None)
    empty = X.feature_table(entities, messages([]), tools).collect()
    assert {(r.session_id, r.total_calls) for r in empty} == {("s", 0), ("t", 0)}
    assert X.feature_table(entities.limit(0), messages(rows), tools.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text,micros",
    [
        ("1970-01-01T00:00:01Z", 1_000_000), ("1970-01-01 00:00:01.5", 1_500_000), ("1970-01-01T02:00:00+02:00", 0), ("1970-01-01T02:00:00+0200", 0),
        ("1700000000123", 1_700_000_000_123_000), ("1970-01-02", 86_400_000_000), (" 1970-01-01T00:00:00,25Z ", 250_000), ("x", None), ("", None), (None, None),
    ],
)
def test_instants(spark, text, micros):
    from pyspark.sql import functions as F

    from sondage.functions.instants import instant_micros

    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert spark.createDataFrame([(text,)], "t string").select(instant_micros(F.col("t"))).first()[0] == micros
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
