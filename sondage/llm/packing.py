"""Filling containers of fixed capacity with texts measured in tokens.

Bulk-synchronous best fit. Texts are range-sorted by size, which ranks them
within their size without gathering them; equal sizes are interchangeable, and
so are equal gaps, so the rounds run on classes: sizes with their counts and
gaps with their ranges of containers, at most as many as the capacity has
values, whatever the number of texts. In each round a successor sweep gives every size, from the
largest down, the tightest gaps that hold it (a container takes one text a
round); conflicts are resolved by rank; gaps are updated; the rounds repeat, and
where nothing fits, as many new containers open as the remaining tokens need at
least. No class is larger for more texts, so one task per capacity sweeps them;
the texts stay where they were sorted. The outcome, a table of ranges of ranks,
is joined to the ranked texts by size, partition and block of ranks: nothing of
it passes through the driver.

Defined results: a text over the capacity is divided into full pieces and a
remainder; no other text is divided; texts without tokens (null, empty) go to
container 0 and take no room; capacities that are null or below 1 are ignored;
ties in size are ordered by doc_id; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import sorted_map, stage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE of this vocabulary cuts text before merging (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ranks in a block, by which texts meet their ranges.
BLOCK = 4096

_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return run


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and the number of tokens of its whole text."""
    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        _count(tokenizer), "doc_id bigint, n_tokens bigint"
    )


# --- rounds on classes -------------------------------------------------------------------------------------------


def plan_rounds(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Ranges (size, first rank, n, first container) that place all texts, and the number of containers."""
    left = {int(s): int(n) for s, n in zip(sizes, counts) if n > 0}
    rank = dict.fromkeys(left, 0)
    order = sorted(left, reverse=True)
    out: list[tuple[int, int, int, int]] = []
    gaps: list[tuple[int, int, int]] = []  # gap, first container, number of containers
    used = 0

    def put(s: int, n: int, first: int) -> None:
        out.append((s, rank[s], n, first))
        rank[s] += n
        left[s] -= n

    # no two texts over half the capacity share a container
    for s in order:
        if 2 * s > capacity and left[s]:
            gaps.append((capacity - s, used, left[s]))
            n = left[s]
            put(s, n, used)
            used += n
    while order := [s for s in order if left[s]]:
        gaps = sorted(g for g in gaps if g[0] >= order[-1])
        matched: list[tuple[int, int, int]] = []
        stack: list[tuple[int, int, int]] = []
        i = len(gaps) - 1
        for s in order:
            while i >= 0 and gaps[i][0] >= s:  # the smallest gap that holds s ends on top
                stack.append(gaps[i])
                i -= 1
            while left[s] and stack:
                gap, first, n = stack.pop()
                m = min(n, left[s])
                put(s, m, first)
                matched.append((gap - s, first, m))
                if m < n:
                    stack.append((gap, first + m, n - m))
        gaps = gaps[: i + 1] + stack + matched
        if not matched:
            need = -(-sum(s * n for s, n in left.items()) // capacity)
            for s in order:
                m = min(need, left[s])
                if not m:
                    break
                gaps.append((capacity - s, used, m))
                put(s, m, used)
                used += m
                need -= m
    return out, used


_RANKED = "target_id bigint, capacity bigint, size bigint, doc_id bigint, piece_no bigint, start_token bigint, part int, k bigint"
_NAMES = [c.split()[0] for c in _RANKED.split(", ")]


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks within (target, size), counted within the partition."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last, seen = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        t, s = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("target_id", "size"))
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
        at = np.arange(len(t))
        start = np.maximum.accumulate(np.where(new, at, 0))
        k = at - start
        if last == (t[0], s[0]):
            k[start == 0] += seen
        last, seen = (t[-1], s[-1]), int(k[-1]) + 1
        cols = [b.column(b.schema.get_field_index(c)) for c in _NAMES[:6]]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(t), part, np.int32)), pa.array(k.astype(np.int64))], names=_NAMES)


_RANGES = "target_id bigint, size bigint, a bigint, n bigint, container bigint"


def _plan(target: pd.DataFrame) -> pd.DataFrame:
    """The placement ranges of one target from its counts by size: as many rows as the capacity has sizes, at most."""
    target = target.sort_values("size", kind="stable")
    ranges, _ = plan_rounds(target["size"].to_numpy(), target["n"].to_numpy(), int(target["capacity"].iloc[0]))
    return pd.DataFrame(ranges, columns=["size", "a", "n", "container"]).assign(target_id=int(target["target_id"].iloc[0]))[["target_id", "size", "a", "n", "container"]]


def place(ranked: DataFrame, counts: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each ranked piece with its container. ``counts``: target_id, size, part, n; ``ranges``: what ``_plan`` gives."""
    # a partition's ranks within a size begin after those of the partitions before it
    before = Window.partitionBy("target_id", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint"))).withColumnRenamed("n", "many")
    end = F.col("begin") + F.col("many")
    lo, hi = F.greatest("a", "begin"), F.least(F.col("a") + F.col("n"), end)
    pieces = groups.join(ranges, ["target_id", "size"]).where((F.col("a") < end) & (F.col("a") + F.col("n") > F.col("begin"))).select(
        "target_id", "size", "part", (lo - F.col("begin")).alias("lo"), (hi - F.col("begin")).alias("hi"), (F.col("container") + lo - F.col("a")).alias("first")
    )
    block = lambda c: F.floor(c / BLOCK).cast("bigint")
    blocks = pieces.withColumn("block", F.explode(F.sequence(block(F.col("lo")), block(F.col("hi") - 1))))
    key = ["target_id", "size", "part", "block"]
    return ranked.withColumn("block", block(F.col("k"))).join(blocks, key).where("k >= lo and k < hi").select(
        "target_id", "capacity", (F.col("first") + F.col("k") - F.col("lo")).alias("container_id"), "doc_id", "piece_no", "start_token", F.col("size").alias("n_tokens")
    )


_PLACED = "target_id bigint, capacity bigint, container_id bigint, doc_id bigint, piece_no bigint, start_token bigint, n_tokens bigint"


def pack(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Where each text, or piece of a text, goes for each capacity.

    ``targets`` is a short list (checked: at most 1,000 capacities).
    """
    spark = documents.sparkSession
    caps = targets.where("target_id is not null and capacity_tokens >= 1").select("target_id", "capacity_tokens").distinct().limit(1001).collect()
    if len(caps) > 1000:
        raise ValueError("too many capacities")
    if not caps:
        return spark.createDataFrame([], _PLACED)
    counted = stage(token_counts(documents, tokenizer), "tokens")
    each = F.explode(F.array(*[F.struct(F.lit(int(t)).cast("bigint").alias("t"), F.lit(int(c)).cast("bigint").alias("c")) for t, c in caps]))
    sized = counted.select("doc_id", "n_tokens", each.alias("x")).select("doc_id", "n_tokens", F.col("x.t").alias("target_id"), F.col("x.c").alias("capacity"))
    full = F.floor(F.col("n_tokens") / F.col("capacity")).cast("bigint")
    pieces = sized.where("n_tokens > 0").select(
        "target_id", "capacity", "doc_id", "n_tokens",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.lit(0).cast("bigint"), full - F.when(F.col("n_tokens") % F.col("capacity") == 0, 1).otherwise(0)))).alias("piece_no"),
    )
    start = F.col("piece_no") * F.col("capacity")
    items = pieces.select("target_id", "capacity", F.least(F.col("capacity"), F.col("n_tokens") - start).alias("size"), "doc_id", "piece_no", start.alias("start_token"))
    ranked = stage(sorted_map(items, ["target_id", "size", "doc_id", "piece_no"], _rank, _RANKED), "ranked")
    counts = stage(ranked.groupBy("target_id", "capacity", "size", "part").agg(F.count("*").alias("n")), "counts")
    # one group per capacity, of at most as many rows as the capacity has sizes
    by_size = counts.groupBy("target_id", "capacity", "size").agg(F.sum("n").alias("n"))
    ranges = stage(by_size.groupBy("target_id").applyInPandas(_plan, _RANGES), "ranges")
    placed = place(ranked, counts.drop("capacity"), ranges)
    nothing = sized.where("n_tokens = 0").selectExpr(
        "target_id", "capacity", "0L as container_id", "doc_id", "0L as piece_no", "0L as start_token", "0L as n_tokens"
    )
    return placed.unionByName(nothing)


def fill_report(packed: DataFrame) -> DataFrame:
    """Per capacity: containers, the least number possible for the tokens, and the share of room used."""
    return packed.groupBy("target_id", "capacity").agg(
        (F.max("container_id") + 1).alias("n_containers"),
        F.ceil(F.sum("n_tokens") / F.first("capacity")).alias("least_containers"),
        (F.sum("n_tokens") / ((F.max("container_id") + 1) * F.first("capacity"))).alias("fill"),
    )
