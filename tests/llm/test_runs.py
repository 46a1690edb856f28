import json
import random

from conftest import block, message

from sondage.llm.runs import canonical_request, collapse_runs


def use(name, id_, **request):
    return block("tool_use", name=name, id=id_, input=json.dumps(request))


def found(df):
    return {(r.session_id, r.first_use_id, r.last_use_id) for r in collapse_runs(df).where("n_calls >= 2").collect()}


def test_notation_and_attempt_fields_do_not_matter():
    same = [
        ("Read", '{"file_path": "a/b.py", "limit": 50}'),
        (" READ", '{"limit":"50","file_path":"./a//b.py","attempt":3}'),
        ("read ", '{"file_path":"a/./b.py","limit":50.0,"trace":{"id":"x"},"requestId":"q"}'),
    ]
    assert len({canonical_request(*x) for x in same}) == 1
    assert canonical_request("Bash", '{"command":" ls  -l\\n"}') == canonical_request("bash", '{"command":"ls -l"}')
    base = canonical_request("Read", '{"file_path":"a"}')
    for other in ('{"file_path":"b"}', '{"file_path":"a","offset":10}', '{"file_path":"a","timeout":10}', None, "broken {", "[]"):
        assert canonical_request("Read", other) != base
    assert canonical_request("Bash", '{"command":"ls -x"}') != canonical_request("Bash", '{"command":"ls"}')


def test_runs_cross_messages_and_end_at_other_calls(messages):
    rows = [
        message("m3", ts="2024-01-01T03:00:00+02:00", role="assistant", blocks=[use("Read", "c", file_path="x")]),  # 01:00 UTC
        message("m1", ts="1704067200000", role="assistant", blocks=[block("text", text="hi"), use("Read", "a", file_path="x")]),
        message("m2", ts="2024-01-01 00:30:00", role="assistant", blocks=[use("Read", "b", file_path="x", attempt=2)]),
        message("m2", ts="2024-01-01 00:30:00", role="assistant", blocks=[use("Read", "b", file_path="x", attempt=2)]),
        message("m4", ts="2024-01-01T02:00:00Z", role="assistant", blocks=[use("Grep", "d", pattern="x"), use("Read", "e", file_path="x")]),
        message("n1", session="t", ts="2024-01-01T02:00:01Z", role="assistant", blocks=[use("Read", "e", file_path="x")]),
    ]
    out = collapse_runs(messages(rows)).collect()
    assert {(r.session_id, r.first_use_id, r.last_use_id, r.n_calls, r.duration_s) for r in out} == {
        ("s", "a", "c", 3, 3600.0), ("s", "d", "d", 1, 0.0), ("s", "e", "e", 1, 0.0), ("t", "e", "e", 1, 0.0),
    }


def test_nulls_ties_and_empty(messages):
    assert found(messages([])) == set()
    rows = [
        message("a", session=None, blocks=[use("Read", "1", f=1)]),
        message("b", session=None, blocks=[use("Read", "2", f=1)]),
        message("c", ts=None, blocks=[use("Read", "3", f=1)]),
        message("d", ts="not a time", blocks=[use("Read", "4", f=1)]),
        message("e", blocks=None),
        message("f", blocks=[block(None), block("tool_use"), block("tool_use")]),
        message("g", session="tie", blocks=[use("Read", "x", f=1)]),
        message("h", session="tie", blocks=[use("Read", "y", f=1), use("Read", "z", f=1)]),
        message("i", session="long", blocks=[block("tool_use", name="W", id="p", input="x" * 300_000), block("tool_use", name="W", id="q", input="x" * 300_000 + " ")]),
    ]
    assert found(messages(rows)) == {("tie", "x", "z"), ("long", "p", "q"), ("s", None, None)}


def test_against_brute_force(messages):
    rng = random.Random(7)
    rows, expected = [], set()
    for s in ("hot", "a", "b"):
        calls = [(f"{s}{i}", rng.choice("xy"), 1_700_000_000_000 + i * 1000) for i in range(400 if s == "hot" else 30)]
        rows += [message(f"{u}", session=s, ts=str(at), blocks=[use("Read", u, f=k)]) for u, k, at in calls]
        i = 0
        while i < len(calls):
            j = i
            while j + 1 < len(calls) and calls[j + 1][1] == calls[i][1]:
                j += 1
            if j > i:
                expected.add((s, calls[i][0], calls[j][0]))
            i = j + 1
    rng.shuffle(rows)
    assert found(messages(rows).repartition(7)) == expected


def test_a_run_over_many_partitions(spark, messages):
    rows = [message(f"u{i:04}", ts=str(1_700_000_000_000 + i), blocks=[use("Read", f"{i}", f=1)]) for i in range(700)]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert found(messages(rows)) == {("s", "0", "699")}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
