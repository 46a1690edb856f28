import json

from conftest import block, message

from sondage.operators import sessions as S


def rows():
    use = lambda name, id_, **kw: block("tool_use", name=name, id=id_, input=json.dumps(kw))
    at = lambda i: f"2024-01-01T00:{i:02}:00Z"
    return [
        message("m0", ts=at(0), blocks=[block("text", text="Please look")], cwd="/a"),
        message("m1", ts=at(1), role="assistant", blocks=[block("thinking", thinking="hm " * 40), block("text", text="Looking."), use("Bash", "t1", command="ls")], parent="m0", cwd="/a"),
        message("m2", ts=at(2), blocks=[block("tool_result", tool_use_id="t1", content="Error: no\nexit code 0")], parent="m1", cwd=None),
        message("m3", ts=at(3), role="assistant", blocks=[use("Bash", "t2", command="ls"), use("Read", "t3", file_path="x.py")], parent="m2", cwd="/b"),
        message("m4", ts=at(4), blocks=[block("tool_result", tool_use_id="t2", content="fine"), block("tool_result", tool_use_id="t3", content="exit code 12")], parent="m3"),
        message("m5", ts=at(5), role="assistant", blocks=[block("text", text="Done."), block(None), None], parent="m4"),
        message("m6", ts=at(6), blocks=[block("text", text="<bash-input>x</bash-input>")], parent="m5"),
        message("m7", ts=at(7), blocks=[block("text", text="Thanks")], parent="m6"),
        message("m8", ts=at(8), blocks=None, parent="m7"),
        message("n0", session="t", ts=at(0), blocks=[block("text", text="go on")], parent="m8"),
        message(None, session="t", ts=at(1), blocks=[]), message("n2", session=None, blocks=[]),
    ]


def test_views(messages):
    t = S.turns(messages(rows() + rows()[:4])).cache()
    assert {(r.session_id, r.uuid, r.message_index) for r in t.collect()} == {("s", f"m{i}", i) for i in range(9)} | {("t", "n0", 0)}
    assert {r.uuid for r in S.prompts(t).collect()} == {"m0", "m7", "n0"}
    assert [(r.turn, r.text) for r in S.narrative(t).orderBy("turn").collect()] == [(1, "Looking."), (2, "Done.")]
    assert [(r.turn, r.text) for r in S.tail(t, 1).collect()] == [(2, "Done.")] and S.narrative(t, "DONE").count() == 1
    assert [(r.message_index, r.tokens) for r in S.thinking(t).collect()] == [(1, 30)]
    assert {(r.message_index, r.error_type, r.tool, r.call_index) for r in S.errors(t).collect()} == {(2, "pattern_match", "bash", 1), (4, "exit_code", "read", 3)}
    assert {(r.step, r.tool, r.detail, r.run_count, r.outcome) for r in S.workflow(t).collect()} == {(1, "bash", "ls", 2, "error"), (2, "read", "x.py", 1, "error")}
    assert {(r.message_index, r.value, r.previous) for r in S.context(t).collect()} == {(0, "/a", None), (3, "/b", "/a")}
    assert {(r.prompt, r.answer) for r in S.exchanges(t).where("session_id = 's'").collect()} == {("Please look", "Done."), ("Thanks", None)}
    assert [(r.tool, r.file, r.n) for r in S.files(t).collect()] == [("read", "x.py", 1)]
    assert {r.event_type for r in S.timeline(t).collect()} == {"user_message", "assistant_message", "thinking", "tool_call", "tool_result"}
    s = S.summary(t).where("session_id = 's'").first()
    assert (s.n_messages, s.n_prompts, s.n_calls, s.n_errors, s.duration_s, s.last_said) == (9, 2, 3, 2, 480.0, "Done.")
    assert {(r.message_index, r.excerpt) for r in S.search(t, "LS", window=30).collect()} == {(1, '...ommand": "ls"}'), (3, '...ommand": "ls"}')}
    assert S.search(t, "look", word=True).count() == 1 and S.search(t, "look").count() == 2
    assert [r.uuid for r in S.message(t, -1).orderBy("uuid").collect()] == ["m8", "n0"]
    assert {r.uuid for r in S.composite(t, errors_only=True, contains="fine").collect()} == {"m4"} and S.composite(t, tools_="read, x").count() == 1
    assert [(r.session_id, r.back) for r in S.chain(t, "t").orderBy("back").collect()] == [("t", 0), ("s", 1)]
    assert S.digest(t).count() == 5 and S.conversation(t, 2, 3).count() == 2


def test_empty(messages):
    t = S.turns(messages([]))
    for f in (S.prompts, S.narrative, S.thinking, S.errors, S.workflow, S.timeline, S.context, S.exchanges, S.files, S.summary, S.tools, S.digest, S.agents):
        assert f(t).count() == 0
