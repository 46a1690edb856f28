import random

import numpy as np
from conftest import block, message

from sondage.llm import conversations as C


def text(t):
    return block("text", text=t)


def chat(session, turns, start=1_700_000_000_000):
    rows, parent = [], None
    for i, (role, t) in enumerate(turns):
        rows.append(message(f"{session}{i}", session=session, ts=str(start + 1000 * i), role=role, blocks=[text(t)], parent=parent))
        parent = f"{session}{i}"
    return rows


def dropped(df):
    return {(r.session_id, r.reason) for r in C.dropped_sessions(df).collect()}


def test_reasons(messages):
    good = chat("good", [("user", "a"), ("assistant", "b"), ("user", "c"), ("Model ", "d")])
    lost = chat("lost", [("user", "a"), ("assistant", "b")])
    lost[1] = message("lost1", session="lost", ts="1700000001000", role="assistant", blocks=[text("b")], parent="good0")
    roots = chat("roots", [("user", "a"), ("assistant", "b")])
    roots[1] = message("roots1", session="roots", ts="1700000001000", role="assistant", blocks=[text("b")])
    null = chat("null", [("user", "a"), ("assistant", "b")]) + [message("null9", session="null", ts="1700000009000", blocks=None, parent="null0")]
    empty = chat("empty", [("user", " \u200b\u00a0\n"), ("assistant", "")]) + [message("empty9", session="empty", ts="1700000009000", role="system", blocks=[text("note")], parent="empty0")]
    unanswered = chat("open", [("user", "a"), ("assistant", "b"), ("user", "c")])
    twice = chat("twice", [("user", "a"), ("user", "b"), ("assistant", "c")])
    toolonly = chat("tool", [("user", "a")]) + [message("tool9", session="tool", ts="1700000009000", role="assistant", blocks=[block("tool_use", name="x")], parent="tool0")]
    rows = good + lost + roots + null + empty + unanswered + twice + toolonly
    assert dropped(messages(rows + rows[:5]).repartition(5)) == {
        ("lost", "broken"), ("roots", "broken"), ("null", "broken"), ("empty", "empty"), ("open", "no_reply"), ("twice", "no_reply"), ("tool", "no_reply"),
    }


def test_turns_are_ordered_and_numbered(messages):
    rows = chat("good", [("user", "a"), ("assistant", "b"), ("human", "c"), ("assistant", "d")])
    out = C.rebuild_conversations(messages(list(reversed(rows)) + rows)).orderBy("turn_no").collect()
    assert [(r.turn_no, r.role, r.text) for r in out] == [(0, "user", "a"), (1, "assistant", "b"), (2, "user", "c"), (3, "assistant", "d")]


def test_role_falls_back_to_record_type(messages):
    rows = [
        message("a", ts="1700000000000", role=None, record_type="user", blocks=[text("q")]),
        message("b", ts="1700000001000", role=None, record_type="assistant", blocks=[text("r")], parent="a"),
    ]
    assert dropped(messages(rows)) == set()


def test_a_clock_that_runs_behind_is_corrected(messages):
    rows, parent = [], None
    for i in range(12):
        role = "user" if i % 2 == 0 else "assistant"
        at = 1_700_000_000_000 + 60_000 * i - (3_600_000 if role == "assistant" else 0)
        rows.append(message(f"k{i:02}", session="skew", ts=str(at), role=role, blocks=[text(str(i))], parent=parent))
        parent = f"k{i:02}"
    assert dropped(messages(rows)) == set()
    out = C.rebuild_conversations(messages(rows)).orderBy("turn_no").collect()
    assert [r.text for r in out] == [str(i) for i in range(12)]
    assert {r.clock for r in out} == {"corrected"}


def planted(seed, offsets, n=39):
    """A true order of replies with uneven delays, and what clocks with these offsets (seconds) make of it."""
    rng = random.Random(seed)
    at, out, parent = 1_700_000_000_000, [], None
    for i in range(n):
        role = ("user", "assistant", "system")[i % 3]
        at += int(1000 * (rng.uniform(20, 400) if role == "user" else rng.uniform(2, 30)))
        out.append(message(f"p{seed}-{i:02}", session=f"p{seed}", ts=str(at + 1000 * offsets.get(role, 0)), role=role, blocks=[text(str(i))], parent=parent))
        parent = f"p{seed}-{i:02}"
    return out


def test_planted_clocks(messages):
    cases = {1: {}, 2: {"assistant": -900}, 3: {"assistant": -3600, "system": 5000}, 4: {"user": 7200}, 5: {"system": -86_400, "assistant": -86_000}, 6: {"assistant": 5}}
    rows = [r for seed, offsets in cases.items() for r in planted(seed, offsets)]
    random.Random(0).shuffle(rows)
    df = messages(rows + rows[:50])
    assert dropped(df) == set()
    out = C.rebuild_conversations(df).orderBy("session_id", "turn_no").collect()
    assert all([int(r.text) for r in out if r.session_id == f"p{seed}"] == list(range(39)) for seed in cases)
    assert {r.session_id: r.clock for r in out} == {"p1": "stated", "p2": "corrected", "p3": "corrected", "p4": "corrected", "p5": "corrected", "p6": "stated"}


def test_offsets():
    n, d, m = np.zeros((3, 3)), np.zeros((3, 3)), np.zeros((3, 3))
    n[0, 1] = n[1, 0] = 4  # the assistant's clock is 100 s behind; all delays are 10 s
    d[0, 1], m[0, 1], d[1, 0], m[1, 0] = 4 * -90e6, -90e6, 4 * 110e6, 110e6
    fitted, estimate = C.solve_offsets(n, d, m)
    assert abs(estimate[1] + 100e6) < 10 and abs(fitted[1] + 100e6) < 10 and fitted[0] == 0
    m[1, 0] = 80e6  # one pause was short: no offset meets both
    assert C.solve_offsets(n, d, m)[0] is None
    m[1, 0] = 95e6  # the estimate is drawn into what the least delays allow
    assert m[0, 1] - 1000 >= C.solve_offsets(n, d, m)[0][1] >= -m[1, 0] + 1000
    n[0, 0], m[0, 0] = 1, -5
    assert C.solve_offsets(n, d, m)[0] is None
    assert C.solve_offsets(np.zeros((3, 3)), d * 0, m * 0)[0].tolist() == [0, 0, 0]


def test_batches_of_any_size_agree(spark, messages):
    rows = [r for seed in range(8) for r in planted(seed, {"assistant": -900} if seed % 2 else {}, 24)] + chat("open", [("user", "a"), ("assistant", "b"), ("user", "c"), ("user", "d")])
    df = messages(rows + rows[::3])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = []
    try:
        for n in ("1", "3", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            got.append((dropped(df), {tuple(r) for r in C.rebuild_conversations(df).collect()}))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got[0] == got[1] == got[2] and got[0][0] == {("open", "no_reply")} and len(got[0][1]) == 192


def test_single_broken_constraint_keeps_the_order(messages):
    rows = chat("one", [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")])
    rows[1] = message("one1", session="one", ts="1700000001000", role="assistant", blocks=[text("b")], parent="one2")
    assert dropped(messages(rows)) == set()
    # replies that precede what they answer by any clock: the order stays, and the conversation can be rejected
    rows[2] = message("one2", session="one", ts="1700000002000", role="user", blocks=[text("c")], parent="one1")
    out = C.rebuild_conversations(messages(rows)).orderBy("turn_no").collect()
    assert [r.text for r in out] == ["a", "b", "c", "d"] and {r.clock for r in out} == {"infeasible"}


def test_empty_and_nulls(messages):
    assert dropped(messages([])) == set()
    rows = [message("a", session=None, blocks=[text("x")]), message(None, session="n", blocks=[block(None), text(None)], ts=None)]
    assert dropped(messages(rows)) == {("n", "empty")}


def test_hot_session_over_partitions(spark, messages):
    turns = [("user" if i % 2 == 0 else "assistant", "x" * 50) for i in range(600)]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert dropped(messages(chat("hot", turns))) == set()
        assert dropped(messages(chat("hot", turns + [("user", "last")]))) == {("hot", "no_reply")}
        out = C.rebuild_conversations(messages(chat("hot", turns))).orderBy("turn_no").select("uuid").collect()
        assert [r.uuid for r in out] == [f"hot{i}" for i in range(600)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
