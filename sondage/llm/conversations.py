"""Rebuilding ordered conversations from message rows.

The rows are range-sorted by session and instant, so a hot session is spread
over many partitions; each partition reduces its stretch of a session to one
small summary, and the summaries of a session are merged in order. Every
``parent_uuid`` is a reply-before constraint between two senders' clocks. All
constraints of a session enter a least-squares estimate of its senders' clock
offsets (the user's clock being the reference) as sums and least delays for each
pair of senders: those of neighbours are summed in the sorted pass, the few
others after a join. Where a clock is wrong, most replies of one sender to
another seem to come before what they answer; there the estimated offsets, kept within what the
constraints allow, correct the instants, and the session is merged again by the
corrected ones. Where no offsets meet all constraints, the session is
``infeasible``: it stays in the order of its instants.

Defined results: reasons in order ``broken``, ``empty``, ``no_reply``; rows
delivered again (same uuid) count once; a row without session is ignored; a
message without readable instant sorts first; ties sort by uuid; an empty table
gives an empty result; extra columns are ignored. Single contradictory instants
correct nothing (of one sender's replies to another, ``_BROKEN`` and more than half must be broken).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.instants import instant_micros
from ..functions.transcripts import VISIBLE, clean_role
from ..plans.staging import sorted_map, stage

_PASS = (
    "kind string, session_id string, part int, rid bigint, n bigint, n_null bigint, n_roots bigint, visible boolean,"
    " first_v string, last_v string, bad boolean, uuid string, parent_uuid string, us bigint, role string, parent_role string, text string, delays double"
)
_NAMES = [c.split()[0] for c in _PASS.split(",")]
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
_TYPES = {n: _ARROW[c.split()[1]] for n, c in zip(_NAMES, _PASS.split(","))}
SENDERS = ("user", "assistant", "system")
#: Broken replies from which on a clock may be wrong.
_BROKEN = 3


def message_rows(messages: DataFrame, with_text: bool = False) -> DataFrame:
    """What a conversation needs of each message row: sender, instant, parent, and whether text is visible."""
    texts = F.filter("message.content", lambda b: (b["type"] == "text") & b["text"].isNotNull())
    role = clean_role(F.col("message.role"), F.col("record_type"))
    seen = F.coalesce(F.exists(texts, lambda b: b["text"].rlike(VISIBLE)), F.lit(False))
    text: Column = F.array_join(F.transform(texts, lambda b: b["text"]), "\n") if with_text else F.lit(None).cast("string")
    return messages.where("session_id is not null").select(
        "session_id",
        instant_micros(F.col("ts")).alias("us"),
        "uuid",
        "parent_uuid",
        role.alias("role"),
        F.col("message").isNotNull().alias("there"),
        (seen & role.isin("user", "assistant")).alias("seen"),
        text.alias("text"),
    )


def _batch(kind: str, size: int, **columns) -> pa.RecordBatch:
    cols = {c: pa.array(v, _TYPES[c]) if not isinstance(v, (pa.Array, pa.ChunkedArray)) else v for c, v in columns.items()}
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * size, pa.string()) if c == "kind" else cols[c] if c in cols else pa.nulls(size, _TYPES[c]) for c in _NAMES], names=_NAMES
    )


def _same(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Where two columns are equal; null equals nothing."""
    return pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False)


def _summarise(emit_rows: bool):
    """Over a sorted partition, column by column: the stretches of sessions (``seg``), replies to the message before by pairs of senders
    (``pair``), other replies (``open``), and the rows if wanted. A stretch that goes on in the next batch is carried over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rid = part << 33
        last: dict[str, pa.Array] | None = None  # the row before the batch
        seg: dict | None = None  # the stretch not yet given out
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {c: batch.column(batch.schema.get_field_index(c)) for c in ("session_id", "us", "uuid", "parent_uuid", "role", "there", "seen", "text")}
            shifted = lambda c, col: pa.concat_arrays([last[c] if last else pa.nulls(1, col[c].type), col[c].slice(0, len(col[c]) - 1)])  # noqa: E731, B023
            again = _same(col["session_id"], shifted("session_id", col)) & _same(col["uuid"], shifted("uuid", col))
            tail = {c: v.slice(len(v) - 1) for c, v in col.items()}
            if again.any():
                keep = pa.array(~again)
                col = {c: v.filter(keep) for c, v in col.items()}
            n = len(col["session_id"])
            if n:
                before = {c: shifted(c, col) for c in ("session_id", "uuid", "us", "role")}
                goes_on = _same(col["session_id"], before["session_id"])
                rids = rid + np.arange(n)
                rid += n
                part_of = np.cumsum(~goes_on) - (0 if goes_on[0] else 1)  # 0: the stretch carried over, or the first
                begins = np.flatnonzero(~goes_on)
                begins = begins if len(begins) and begins[0] == 0 else np.concatenate([[0], begins])
                no_parent = pc.is_null(col["parent_uuid"]).to_numpy(zero_copy_only=False)
                follows = goes_on & ~no_parent & _same(col["parent_uuid"], before["uuid"])
                yield from _pairs(col, before, follows, part_of, begins)
                at = np.flatnonzero(~no_parent & ~follows)
                if len(at):
                    take = pa.array(at)
                    yield _batch("open", len(at), part=np.full(len(at), part), rid=rids[at], **{c: col[c].take(take) for c in ("session_id", "uuid", "parent_uuid", "us", "role")})
                if emit_rows:
                    yield _batch("row", n, part=np.full(n, part), rid=rids, **{c: col[c] for c in ("session_id", "uuid", "parent_uuid", "us", "role", "text")})
                segs = _stretches(col, rids, begins, part_of, no_parent)
                if seg is not None:
                    if goes_on[0]:
                        segs[0] = _joined(seg, segs[0])
                    else:
                        segs.insert(0, seg)
                seg = segs.pop()
                if segs:
                    yield _segs(segs, part)
            last = tail
        if seg is not None:
            yield _segs([seg], part)

    return run


def _pairs(col: dict, before: dict, follows: np.ndarray, part_of: np.ndarray, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
    code = {r: i for i, r in enumerate(SENDERS)}
    sender = lambda c: np.array([code.get(r, -1) for r in c.to_pylist()])
    child, parent = sender(col["role"]), sender(before["role"])
    delay = np.where(follows, pc.fill_null(pc.subtract(col["us"], before["us"]), -1).to_numpy(zero_copy_only=False), 0)
    at = np.flatnonzero(follows & (child >= 0) & (parent >= 0) & pc.is_valid(col["us"]).to_numpy(zero_copy_only=False) & pc.is_valid(before["us"]).to_numpy(zero_copy_only=False))
    if not len(at):
        return
    key, where, counts = np.unique((part_of[at] * 3 + parent[at]) * 3 + child[at], return_inverse=True, return_counts=True)
    least = np.full(len(key), np.iinfo(np.int64).max)
    np.minimum.at(least, where, delay[at])
    yield _batch(
        "pair", len(key), session_id=col["session_id"].take(pa.array(begins[key // 9])), n=counts, n_null=np.bincount(where, weights=delay[at] <= 0).astype(np.int64),
        us=least, delays=np.bincount(where, weights=delay[at].astype(float)), role=[SENDERS[k % 3] for k in key.tolist()], parent_role=[SENDERS[k // 3 % 3] for k in key.tolist()],
    )


def _stretches(col: dict, rids: np.ndarray, begins: np.ndarray, part_of: np.ndarray, no_parent: np.ndarray) -> list[dict]:
    count = lambda x: np.add.reduceat(x.astype(np.int64), begins).tolist()
    seen = np.flatnonzero(pc.fill_null(col["seen"], False).to_numpy(zero_copy_only=False))
    user = pc.fill_null(pc.equal(col["role"], "user"), False).to_numpy(zero_copy_only=False)[seen]
    of = part_of[seen]
    out = [
        {"session_id": s, "rid": r, "n": n, "n_null": x, "n_roots": y, "visible": False, "first_v": None, "last_v": None, "bad": False}
        for s, r, n, x, y in zip(
            col["session_id"].take(pa.array(begins)).to_pylist(), rids[begins].tolist(), count(np.ones(len(rids))),
            count(~pc.fill_null(col["there"], False).to_numpy(zero_copy_only=False)), count(no_parent),
        )
    ]
    if len(seen):
        same = of[1:] == of[:-1]
        for k in np.unique(of[1:][same & user[1:] & user[:-1]]).tolist():
            out[k]["bad"] = True
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        final = np.append(first[1:], len(of)) - 1
        for k, a, b in zip(of[first].tolist(), user[first].tolist(), user[final].tolist()):
            out[k] |= {"visible": True, "first_v": "u" if a else "a", "last_v": "u" if b else "a"}
    return out


def _joined(a: dict, b: dict) -> dict:
    return {
        **a, **{c: a[c] + b[c] for c in ("n", "n_null", "n_roots")}, "visible": a["visible"] or b["visible"], "first_v": a["first_v"] or b["first_v"], "last_v": b["last_v"] or a["last_v"],
        "bad": a["bad"] or b["bad"] or (a["last_v"] == "u" == b["first_v"]),
    }


def _segs(segs: list[dict], part: int) -> pa.RecordBatch:
    return _batch("seg", len(segs), part=[part] * len(segs), **{c: [x[c] for x in segs] for c in segs[0]})


def _passed(rows: DataFrame, emit_rows: bool) -> DataFrame:
    return stage(sorted_map(rows, ["session_id", "us", "uuid"], _summarise(emit_rows), _PASS), "turns")


_PAIRS = [(p, c) for p in SENDERS for c in SENDERS]
_OFFSETS = "session_id string, feasible boolean, off_assistant bigint, off_system bigint"


def solve_offsets(n: np.ndarray, delays: np.ndarray, least: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """Offsets (user, assistant, system) of one session's clocks, or None where no offsets meet the constraints.

    ``n``, ``delays``, ``least``: 3 x 3 by (parent, child): replies, the sum of their delays, the least delay (microseconds).
    Least squares over all replies between different senders: delay = offset of the child - offset of the parent + a common
    delay; each direction counts with the root of its replies, so that neither long pauses nor many turns of one sender decide.
    The second value is the estimate before it is fitted into what the least delays allow.
    """
    rows, values = [], []
    for p in range(3):
        for c in range(3):
            if p != c and n[p, c]:
                w = np.sqrt(np.sqrt(n[p, c]))
                x = np.zeros(3)
                if c:
                    x[c - 1] += w
                if p:
                    x[p - 1] -= w
                x[2] = w
                rows.append(x)
                values.append(w * delays[p, c] / n[p, c])
    estimate = np.zeros(3)
    if rows:
        a = np.array(rows)
        solved = np.linalg.solve(a.T @ a + 1e-9 * np.eye(3), a.T @ np.array(values))
        estimate[1:] = solved[:2]
    # true delay = least - offset of child + offset of parent must be at least 1 ms: offset[c] - offset[p] <= least - 1000
    room = np.full((3, 3), np.inf)
    for p in range(3):
        for c in range(3):
            if p != c and n[p, c]:
                room[p, c] = least[p, c] - 1000
            elif p == c and n[p, c] and least[p, c] <= 0:
                return None, estimate  # no offset of a clock mends replies to oneself
    short = room.copy()
    np.fill_diagonal(short, 0)
    for k in range(3):
        short = np.minimum(short, short[:, k : k + 1] + short[k : k + 1, :])
    if (np.diag(short) < 0).any():
        return None, estimate
    fitted = np.zeros(3)
    # the offsets nearest to the estimate, one after the other, within what the closed constraints allow
    for c in (1, 2):
        lo = max(fitted[p] - short[c, p] for p in range(c))
        hi = min(fitted[p] + short[p, c] for p in range(c))
        fitted[c] = min(max(estimate[c], lo), hi)
    return fitted, estimate


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out = [], []
        for s, n, d, m in zip(*(batch.column(i).to_pylist() for i in range(4))):
            grid = lambda x, none: np.array([none if v is None else v for v in x], float).reshape(3, 3)
            fitted, _ = solve_offsets(grid(n, 0), grid(d, 0), grid(m, 0))
            ids.append(s)
            out.append((fitted is not None, *((int(fitted[1]), int(fitted[2])) if fitted is not None else (0, 0))))
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.bool_(), pa.int64(), pa.int64())))], names=["session_id", "feasible", "off_assistant", "off_system"])


def clock_offsets(pairs: DataFrame) -> DataFrame:
    """Per session with broken replies: whether some offsets of its clocks mend all, and the offsets that correct it.

    ``pairs``: session_id, parent_role, role, n, n_broken, delays (their sum), least (the least), of all replies of all
    sessions. The offsets are 0 where too few replies are broken to put it down to a clock. Sums only, so any share of
    the rows may be one session's.
    """
    here = lambda p, c: (F.col("parent_role") == p) & (F.col("role") == c)
    grid = lambda f, v: F.array(*[f(F.when(here(p, c), F.col(v))) for p, c in _PAIRS])
    sums = pairs.groupBy("session_id").agg(
        F.sum("n_broken").alias("n_broken"), grid(F.sum, "n_broken").alias("b"),
        grid(F.sum, "n").alias("n"), grid(F.sum, "delays").alias("d"), grid(F.min, "least").alias("m"),
    ).where("n_broken > 0")
    solved = sums.select("session_id", F.transform("n", lambda x: x.cast("double")).alias("n"), "d", F.transform("m", lambda x: x.cast("double")).alias("m")).mapInArrow(_solve, _OFFSETS)
    one_way = F.exists(F.arrays_zip("n", "b"), lambda x: F.coalesce((x["b"] >= _BROKEN) & (x["b"] * 2 > x["n"]), F.lit(False)))
    wrong = F.col("feasible") & F.col("one_way")
    return sums.select("session_id", one_way.alias("one_way")).join(solved, "session_id").select(
        "session_id", "feasible", wrong.alias("corrected"), *(F.when(wrong, F.col(c)).otherwise(0).alias(c) for c in ("off_assistant", "off_system"))
    )


def order_messages(messages: DataFrame, emit_rows: bool = False) -> tuple[DataFrame, DataFrame]:
    """Ordered stretches of sessions (kind ``seg``; ``row`` too if wanted) and the state of sessions' replies.

    The second table has a row for each session that has lost parents or broken replies: session_id, lost, feasible, corrected.
    """
    rows = message_rows(messages, emit_rows)
    passed = _passed(rows, emit_rows)
    pending = passed.where("kind = 'open'").select("session_id", "uuid", "parent_uuid", "us", "role")
    # few rows against all: no side is forced to be broadcast, the runtime checks sizes; the key holds the parent, so no session is hot
    parents = rows.select("session_id", F.col("uuid").alias("parent_uuid"), F.col("us").alias("parent_us"), F.col("role").alias("parent_role"))
    wanted = pending.select("session_id", "parent_uuid").distinct()
    found = parents.join(wanted, ["session_id", "parent_uuid"], "left_semi").dropDuplicates(["session_id", "parent_uuid"]).withColumn("found", F.lit(True))
    replies = stage(pending.join(found, ["session_id", "parent_uuid"], "left").dropDuplicates(["session_id", "uuid"]), "replies")
    delay = F.col("us") - F.col("parent_us")
    far = replies.where("us is not null and parent_us is not null and role is not null and parent_role is not null").groupBy("session_id", "parent_role", "role").agg(
        F.count("*").alias("n"), F.count_if(delay <= 0).alias("n_broken"), F.sum(delay.cast("double")).alias("delays"), F.min(delay).alias("least")
    )
    near = passed.where("kind = 'pair'").select("session_id", "parent_role", "role", "n", F.col("n_null").alias("n_broken"), "delays", F.col("us").alias("least"))
    offsets = stage(clock_offsets(near.unionByName(far)), "offsets")
    if not offsets.where("corrected").isEmpty():
        moving = offsets.where("corrected").select("session_id", "off_assistant", "off_system")
        off = F.when(F.col("role") == "assistant", F.col("off_assistant")).when(F.col("role") == "system", F.col("off_system")).otherwise(0)
        # an offset of the clock is how far it is ahead
        moved = rows.join(moving, "session_id").withColumn("us", F.col("us") - off).drop("off_assistant", "off_system")
        again = _passed(moved, emit_rows).where("kind in ('seg', 'row')")
        passed = passed.join(moving.select("session_id"), "session_id", "left_anti").unionByName(again)
    lost = replies.where("found is null").select("session_id").distinct().withColumn("lost", F.lit(True))
    state = lost.join(offsets.select("session_id", "feasible", "corrected"), "session_id", "full").select(
        "session_id", F.coalesce("lost", F.lit(False)).alias("lost"), F.coalesce("feasible", F.lit(True)).alias("feasible"), F.coalesce("corrected", F.lit(False)).alias("corrected")
    )
    return passed, state


def judge_sessions(passed: DataFrame, state: DataFrame) -> DataFrame:
    """One row per session with ``reason`` (null: a good conversation), ``clock`` (stated, corrected or infeasible), ``n_messages`` and its stretches."""
    segs = (
        passed.where("kind = 'seg'")
        .groupBy("session_id")
        .agg(
            F.sum("n").alias("n_messages"),
            F.sum("n_null").alias("n_null"),
            F.sum("n_roots").alias("n_roots"),
            F.max("visible").alias("visible"),
            F.max("bad").alias("bad"),
            # one entry for each partition that holds a stretch of the session: bounded by the partitions
            F.array_sort(F.collect_list(F.struct("rid", "n", "first_v", "last_v"))).alias("stretches"),
        )
    )
    told = F.filter("stretches", lambda x: x["first_v"].isNotNull())
    unanswered = F.col("bad") | (F.element_at(told, -1)["last_v"] == "u") | F.exists(
        F.sequence(F.lit(1), F.size(told)),
        lambda i: (F.try_element_at(told, i)["last_v"] == "u") & (F.try_element_at(told, i + 1)["first_v"] == "u"),
    )
    return segs.join(state, "session_id", "left").select(
        "session_id",
        F.when((F.col("n_null") > 0) | (F.col("n_roots") != 1) | F.coalesce("lost", F.lit(False)), "broken")
        .when(~F.col("visible"), "empty")
        .when(F.coalesce(unanswered, F.lit(False)), "no_reply")
        .alias("reason"),
        F.when(F.col("corrected"), "corrected").when(~F.col("feasible"), "infeasible").otherwise("stated").alias("clock"),
        "n_messages",
        "stretches",
    )


def dropped_sessions(messages: DataFrame) -> DataFrame:
    return judge_sessions(*order_messages(messages)).where("reason is not null").select("session_id", "reason")


def rebuild_conversations(messages: DataFrame) -> DataFrame:
    """The good conversations, one row per turn: session_id, turn_no, uuid, role, ts (corrected where ``clock`` says so), text, clock.

    The sessions are all but those of ``dropped_sessions``. Those whose constraints no offsets meet are marked ``infeasible``, so that they can be rejected.
    """
    passed, state = order_messages(messages, emit_rows=True)
    good = judge_sessions(passed, state).where("reason is null")
    before = lambda i: F.aggregate(F.slice("stretches", 1, i), F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])
    starts = good.select("session_id", F.posexplode("stretches").alias("i", "x"), "stretches", "clock").select(
        "session_id", "clock", F.shiftright("x.rid", 33).cast("int").alias("part"), F.col("x.rid").alias("start"), before(F.col("i")).alias("base")
    )
    rows = passed.where("kind = 'row'").select("session_id", "part", "rid", "uuid", "role", "us", "text")
    return rows.join(starts, ["session_id", "part"]).select(
        "session_id", (F.col("rid") - F.col("start") + F.col("base")).alias("turn_no"), "uuid", "role", F.timestamp_micros("us").alias("ts"), "text", "clock"
    )
