"""Nearest vectors of a stated query set, exact: queries in blocks against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(vectors: DataFrame, queries: DataFrame, key: str, column: str, k: int, block: int = 2048) -> DataFrame:
    """query_id, rank, match_id, similarity: the k most similar rows by cosine for each query row, itself left out.

    The query set is read in blocks of bounded size; each task keeps its own k best per query, so the exchange holds
    k rows per query and task. Ties go to the smaller id; null or zero vectors match nothing.
    """
    out = None
    stated = queries.where(f"{column} is not null").select(key, column)
    blocks = max(1, -(-stated.count() // block))
    for b in range(blocks):
        # bounded: a block holds about as many of the stated queries
        part = stated.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).collect()
        q_id = np.array([r[0] for r in part], np.int64)
        q = np.array([r[1] for r in part], np.float64).reshape(len(part), -1)
        norm = np.linalg.norm(q, axis=1, keepdims=True) if len(part) else q
        q, q_id = (q[norm[:, 0] > 0] / norm[norm[:, 0] > 0], q_id[norm[:, 0] > 0]) if len(part) else (q, q_id)

        def run(batches: Iterator[pa.RecordBatch], q=q, q_id=q_id) -> Iterator[pa.RecordBatch]:
            best: list[tuple[np.ndarray, np.ndarray]] = []
            for b in batches:
                v = b.column(1)
                keep = np.array(v.is_valid()) if v.null_count else np.ones(len(v), bool)
                idx = np.flatnonzero(keep)
                if not len(idx) or not len(q_id):
                    continue
                rows = v.take(pa.array(idx))
                m = np.asarray(rows.flatten(), np.float64).reshape(len(idx), -1)
                n = np.linalg.norm(m, axis=1)
                ok = n > 0
                ids_, sims = b.column(0).to_numpy()[idx][ok], q @ (m[ok] / n[ok, None]).T
                sims[q_id[:, None] == ids_[None, :]] = -np.inf
                best.append((np.broadcast_to(ids_, sims.shape), sims))
                all_ids, all_sims = np.concatenate([x[0] for x in best], 1), np.concatenate([x[1] for x in best], 1)
                order = np.lexsort((all_ids, -all_sims), axis=1)[:, :k]
                best = [(np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_sims, order, 1))]
            if best:
                i, s = best[0]
                good = np.isfinite(s)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_id, i.shape[1])[good.ravel()]), pa.array(i.ravel()[good.ravel()]), pa.array(s.ravel()[good.ravel()])], names=["query_id", "match_id", "similarity"])

        found = vectors.select(F.col(key).cast("bigint"), column).mapInArrow(run, "query_id bigint, match_id bigint, similarity double")
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "match_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
