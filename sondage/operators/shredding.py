"""Deeply nested records as flat tables, by columnar shredding.

Each leaf path of a record becomes a column chunk with two level sequences:
the repetition level says at which repeated ancestor an entry starts anew (0: a
new record, k: a new element of the array at depth k), the definition level how
much of its path is there (per depth one level for the element and, at the
leaf's own depth, one more for the leaf). Tables are rebuilt per repeated
ancestor from the level sequences alone: positions are running counts of
repetition levels, elements and values are there where the definition level
says so. All of it is array arithmetic over whole batches; only text that itself
holds an array of blocks is parsed, one nesting depth after the other, to any
depth.

Defined results: a null record or null array gives no block; a null block keeps
its position but gives no row, a block whose fields are all null gives one; text
that does not parse as a JSON array is plain text; a repeated delivery (same ``uuid``) counts once; a result whose id is null
or unknown in its scope answers nothing; if several calls of one scope share an
id, the first by (uuid, path) is answered; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Leaf paths of a block, below the repeated ancestor ``content``.
LEAVES = ("type", "text", "thinking", "name", "id", "input", "tool_use_id", "content", "is_error")


class Chunk(NamedTuple):
    """The column chunks below one repeated ancestor; all leaves share the repetition levels."""

    depth: int
    records: np.ndarray  # which records take part; the others have nothing at this depth
    repetition: np.ndarray
    definition: dict[str, np.ndarray]  # per leaf: ``depth`` where its element is there, one more where the leaf is too, less where neither
    leaves: dict[str, list | pa.Array]  # one value for each entry, null where undefined

    def there(self) -> np.ndarray:
        """Whether each entry's element is there; all leaves agree on that."""
        return next(iter(self.definition.values())) >= self.depth


#: The list column that tells which elements are there, beside the leaves.
ELEMENT = "element"


def shred_top(lists: dict[str, pa.Array]) -> Chunk:
    """The chunk at depth 1, from the offsets of the arrays; no value is touched.

    The list ``element``, if given, tells which elements are there; else those with any leaf are.
    """
    first = next(iter(lists.values()))
    if isinstance(first, pa.ChunkedArray):
        lists = {k: v.combine_chunks() for k, v in lists.items()}
        first = next(iter(lists.values()))
    sizes = pc.fill_null(pc.list_value_length(first), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    records = np.flatnonzero(sizes)
    n = sizes[records]
    starts = np.cumsum(n) - n
    repetition = np.ones(int(n.sum()), np.int8)
    repetition[starts] = 0
    leaves = {k: pc.list_flatten(v) for k, v in lists.items()}
    defined = {k: v.is_valid().to_numpy(zero_copy_only=False) for k, v in leaves.items() if k != ELEMENT}
    if (told := leaves.pop(ELEMENT, None)) is not None:
        there = pc.fill_null(told, False).to_numpy(zero_copy_only=False).astype(bool)
    else:
        there = np.logical_or.reduce(list(defined.values()))
    return Chunk(1, records, repetition, {k: there.astype(np.int16) + d for k, d in defined.items()}, leaves)


def nested_blocks(text) -> list | None:
    """The array of blocks that a content holds, or None where it is plain text."""
    if isinstance(text, str):
        if not text.lstrip()[:1] == "[":
            return None
        try:
            text = json.loads(text)
        except (ValueError, RecursionError):
            return None
    return text if isinstance(text, list) and any(isinstance(x, dict) for x in text) else None


def _leaf(name: str, v):
    if v is None or (name == "is_error" and isinstance(v, bool)):
        return v
    if name == "is_error":
        return {"true": True, "false": False}.get(str(v).lower())
    return v if isinstance(v, str) else as_json(v)


def as_json(v) -> str:
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def shred_deeper(chunk: Chunk, names: Sequence[str]) -> Chunk | None:
    """The chunk one depth further in, or None where no content holds an array."""
    content = chunk.leaves["content"]
    parsed: dict[int, list] = {}
    if isinstance(content, pa.Array):
        where = np.flatnonzero(pc.fill_null(pc.starts_with(pc.utf8_ltrim_whitespace(content), "["), False).to_numpy(zero_copy_only=False))
        candidates = zip(where.tolist(), content.take(pa.array(where)).to_pylist())
    else:
        candidates = enumerate(content)
    for i, text in candidates:
        if (blocks := nested_blocks(text)) is not None:
            parsed[i] = blocks
    if not parsed:
        return None
    # a record takes part if any of its entries goes deeper; its other entries stay as undefined ones
    of = np.cumsum(chunk.repetition == 0) - 1
    taking = np.unique(of[np.fromiter(parsed, np.int64, len(parsed))])
    repetition: list[int] = []
    element: list[int] = []  # how much of the way to the element is there
    leaves: dict[str, list] = {k: [] for k in names}
    outer = chunk.definition["content"]
    for i in np.flatnonzero(np.isin(of, taking)).tolist():
        blocks = parsed.get(i)
        if blocks is None:
            repetition.append(int(chunk.repetition[i]))
            element.append(min(int(outer[i]), chunk.depth))
            for k in names:
                leaves[k].append(None)
            continue
        for j, b in enumerate(blocks):
            repetition.append(int(chunk.repetition[i]) if j == 0 else chunk.depth + 1)
            element.append(chunk.depth + 1 if isinstance(b, dict) else chunk.depth)
            for k in names:
                v = b.get(k) if isinstance(b, dict) else None
                leaves[k].append(v if k == "content" and isinstance(v, list) else _leaf(k, v))
    level = np.array(element, np.int16)
    definition = {k: level + np.array([v is not None for v in x], np.int16) for k, x in leaves.items()}
    return Chunk(chunk.depth + 1, chunk.records[taking], np.array(repetition, np.int16), definition, leaves)


def positions(repetition: np.ndarray, depth: int) -> list[np.ndarray]:
    """Per depth, each entry's position in its array, from the repetition levels alone."""
    at = np.arange(len(repetition))
    out = []
    for j in range(1, depth + 1):
        count = np.cumsum(repetition == j)
        began = np.maximum.accumulate(np.where(repetition < j, at, 0))
        out.append(count - count[began])
    return out


def assemble(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, list[str], list[str]]:
    """Of the elements that are there: entry, record, path and the enclosing block's path."""
    there = np.flatnonzero(chunk.there())
    record = chunk.records[(np.cumsum(chunk.repetition == 0) - 1)[there]]
    pos = [p[there].tolist() for p in positions(chunk.repetition, chunk.depth)]
    if chunk.depth == 1:
        return there, record, [str(p) for p in pos[0]], [""] * len(there)
    path = ["/".join(map(str, p)) for p in zip(*pos)]
    return there, record, path, [p.rpartition("/")[0] for p in path]


def _flattener(keys: Sequence[str], names: Sequence[str], types: Sequence[str] | None, whole: bool) -> Callable:
    string = [k for k in names if k != "is_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda k: batch.column(batch.schema.get_field_index(k))  # noqa: E731, B023
            chunk: Chunk | None = shred_top({k: column(f"_{k}") for k in (*names, *([ELEMENT] if whole else ()))})
            while chunk is not None and len(chunk.records):
                entry, record, path, parent = assemble(chunk)
                values = {k: (v if isinstance(v, pa.Array) else pa.array([x if isinstance(x, (str, bool)) else None if x is None else as_json(x) for x in v], pa.string() if k in string else pa.bool_())) for k, v in chunk.leaves.items()}
                take = pa.array(entry)
                cols = {k: column(k).take(pa.array(record)) for k in keys}
                cols |= {"path": pa.array(path, pa.string()), "parent_path": pa.array(parent, pa.string()), "depth": pa.array(np.full(len(path), chunk.depth, np.int32))}
                cols |= {f"block_{k}": v.take(take).cast(pa.string() if k in string else pa.bool_()) for k, v in values.items()}
                out = pa.RecordBatch.from_pydict(cols)
                if types is not None:
                    out = out.filter(pc.is_in(out.column(out.schema.get_field_index("block_type")), pa.array(types)))
                if out.num_rows:
                    yield out
                chunk = shred_deeper(chunk, names)

    return run


def flatten_blocks(
    messages: DataFrame,
    leaves: Sequence[str] = LEAVES,
    types: Sequence[str] | None = None,
    keys: Sequence[str] = ("session_id", "uuid"),
    keep_plain_content: bool = True,
) -> DataFrame:
    """One row per block at any depth: keys, path, parent_path, depth and the leaves as ``block_*``.

    Only the named leaves are read from the file. ``types`` keeps the blocks of some types.
    Rows of repeated deliveries are still there; see ``distinct_blocks``.
    """
    names = list(dict.fromkeys(["type", *leaves, "content"]))
    cols: list[Column] = [F.col(k) for k in keys]
    for k in names:
        c = F.col(f"message.content.{k}")
        if k == "content" and not keep_plain_content:
            c = F.transform(c, lambda x: F.when(x.rlike(r"^\s*\["), x))
        cols.append(c.alias(f"_{k}"))
    # which elements are there is told by the file only where all leaves are read
    whole = set(LEAVES) <= set(names)
    if whole:
        cols.append(F.transform("message.content", lambda b: b.isNotNull()).alias(f"_{ELEMENT}"))
    schema = ", ".join(
        [*(f"`{k}` string" for k in keys), "path string", "parent_path string", "depth int"]
        + [f"block_{k} {'boolean' if k == 'is_error' else 'string'}" for k in names]
    )
    return messages.select(*cols).mapInArrow(_flattener(list(keys), names, types, whole), schema)


def distinct_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.dropDuplicates(["session_id", "uuid", "path"])


LINKS = ("session_id", "uuid", "path", "parent_path", "depth")


def message_table(messages: DataFrame) -> DataFrame:
    """One row per message, the parent of its blocks: the fields that are no blocks, and how many blocks it holds."""
    return messages.where("uuid is not null").select(
        "session_id", "uuid", "parent_uuid", "record_type", "ts", "cwd", F.col("message.role").alias("role"), F.coalesce(F.size("message.content.type"), F.lit(-1)).alias("n_blocks")
    ).dropDuplicates(["uuid"]).withColumn("n_blocks", F.when(F.col("n_blocks") >= 0, F.col("n_blocks")))


def call_table(messages: DataFrame) -> DataFrame:
    """One row per tool_use at any depth, with its message (session_id, uuid), place (path) and enclosing block (parent_path)."""
    blocks = flatten_blocks(messages, ("name", "id", "input"), ("tool_use",), keep_plain_content=False)
    return distinct_blocks(blocks).select(*LINKS, F.col("block_id").alias("use_id"), F.col("block_name").alias("name"), F.col("block_input").alias("input"))


def text_table(messages: DataFrame) -> DataFrame:
    """One row per text or thinking block at any depth."""
    blocks = flatten_blocks(messages, ("text", "thinking"), ("text", "thinking"), keep_plain_content=False)
    return distinct_blocks(blocks).select(*LINKS, F.col("block_type").alias("kind"), F.coalesce("block_text", "block_thinking").alias("text"))


def result_table(messages: DataFrame) -> DataFrame:
    """One row per tool_result at any depth, with the message and path of the call it answers (null where none does)."""
    blocks = flatten_blocks(messages, ("id", "tool_use_id", "is_error"), ("tool_use", "tool_result"))
    met = _met(blocks, F.col("block_is_error").alias("is_error"), F.when(F.col("block_type") == "tool_result", F.col("block_content")).alias("content"))
    # a result without id meets no call: a key of its own keeps such rows apart
    met = met.withColumn("known", F.col("id").isNotNull() & F.col("session_id").isNotNull()).withColumn("meet", F.when(F.col("known"), F.col("id")).otherwise(F.concat_ws("|", F.lit("\0"), "uuid", "path")))
    return _answered(met, "meet").where("not is_call").select(
        *LINKS, F.col("id").alias("use_id"), "is_error", "content",
        *(F.when(F.col("known"), F.col(f"call.{c}")).alias(n) for c, n in (("uuid", "call_uuid"), ("path", "call_path"))),
    )


def record_tables(messages: DataFrame) -> dict[str, DataFrame]:
    """The flat tables; every block keeps its message and enclosing block, every result its call."""
    return {"messages": message_table(messages), "calls": call_table(messages), "results": result_table(messages), "texts": text_table(messages)}


def _met(blocks: DataFrame, *more: Column) -> DataFrame:
    """Calls and results with the scope and id by which they meet: one pass over the file, told apart afterwards."""
    scope = F.when(F.col("depth") == 1, "").otherwise(F.concat_ws("|", "uuid", "parent_path")).alias("scope")
    key = F.when(F.col("block_type") == "tool_use", F.col("block_id")).otherwise(F.col("block_tool_use_id"))
    return blocks.select(*LINKS, scope, key.alias("id"), (F.col("block_type") == "tool_use").alias("is_call"), *more)


def _answered(met: DataFrame, key: str) -> DataFrame:
    """Each row with ``call``, the first call of its scope and id; repeated deliveries left out."""
    # calls sort first in their key; the window spills, whatever share of the rows a key holds
    first = Window.partitionBy("session_id", "scope", key).orderBy(F.desc("is_call"), "uuid", "path")
    return met.withColumn("call", F.first(F.when(F.col("is_call"), F.struct("uuid", "path"))).over(first)).dropDuplicates(["session_id", "scope", key, "uuid", "path", "is_call"])


def link_results(messages: DataFrame) -> DataFrame:
    """Each tool_result with the call it answers.

    Blocks meet in their scope: the session for those directly in a message, else the enclosing array.
    Calls and results are spread by (session, scope, id), so a hot session takes no single task.
    """
    blocks = flatten_blocks(messages, ("type", "id", "tool_use_id", "content"), ("tool_use", "tool_result"), keep_plain_content=False)
    met = _met(blocks).where("id is not null and session_id is not null").drop("parent_path", "depth")
    return _answered(met, "id").where("not is_call and call is not null").select(
        "session_id",
        F.col("call.uuid").alias("use_uuid"),
        F.col("call.path").alias("use_path"),
        F.col("uuid").alias("result_uuid"),
        F.col("path").alias("result_path"),
    )
