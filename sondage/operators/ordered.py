"""Ordered rows of groups of any size: numbers, running sums, earlier values.

Rows are range-sorted by group and order, so a group that holds any share of the
rows is spread over many partitions; each partition is scanned column by column.
What a partition's first group carries over from the partitions before it is one
small row per partition: their number bounds the only table that is broadcast.

Defined results: null is a group of its own; rows that agree in group and order
stand in no fixed order; null values add nothing to a sum and are passed over
where the last value is asked for; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from ..plans.staging import sorted_map, stage


def _changed(col: pa.Array, before: pa.Array) -> np.ndarray:
    """Where a column differs from another; null equals null."""
    equal = pc.fill_null(pc.equal(col, before), False).to_numpy(zero_copy_only=False)
    null = pc.and_(pc.is_null(col), pc.is_null(before)).to_numpy(zero_copy_only=False)
    return ~(equal | null)


def _scanner(names: list[str], by: Sequence[str], sums: Sequence[str], lasts: Sequence[str], prevs: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tail: dict[str, pa.Array] | None = None  # the last row so far
        k0, first_group = 0, True
        total = dict.fromkeys(sums, 0)
        filled: dict[str, pa.Array | None] = dict.fromkeys(lasts)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            col = {c: batch.column(batch.schema.get_field_index(c)) for c in names}
            before = {c: pa.concat_arrays([tail[c] if tail else pa.nulls(1, col[c].type), col[c].slice(0, n - 1)]) for c in {*by, *prevs}}
            new = np.zeros(n, bool)
            for c in by:
                new |= _changed(col[c], before[c])
            if tail is None:
                new[0] = True
            at = np.arange(n)
            goes_on = np.cumsum(new) == 0  # rows of the group that the last batch ended with
            start = np.maximum.accumulate(np.where(new, at, 0))
            k = at - start + np.where(goes_on, k0, 0)
            begun = np.cumsum(new) - (1 if tail is None else 0)
            is_open = first_group & (begun == 0)
            out = {c: col[c] for c in names}
            out["_part"] = pa.array(np.full(n, part, np.int32))
            out["_open"] = pa.array(is_open)
            out["_k"] = pa.array(k.astype(np.int64))
            for c in sums:
                v = pc.fill_null(pc.cast(col[c], pa.int64()), 0).to_numpy(zero_copy_only=False)
                run_ = np.cumsum(v)
                out[f"_sum_{c}"] = pa.array(run_ - np.where(goes_on, -total[c], (run_ - v)[start]))
                total[c] = int(out[f"_sum_{c}"][n - 1].as_py())
            for c in lasts:
                there = col[c].is_valid().to_numpy(zero_copy_only=False)
                seen = np.maximum.accumulate(np.where(there, at, -1))
                seen = np.where(seen >= np.where(goes_on, 0, start), seen, -1)
                carried = filled[c] if filled[c] is not None else pa.nulls(1, col[c].type)
                source = pa.concat_arrays([col[c], carried, pa.nulls(1, col[c].type)])
                out[f"_last_{c}"] = source.take(pa.array(np.where(seen >= 0, seen, np.where(goes_on, n, n + 1))))
                until = out[f"_last_{c}"]
                shifted = pa.concat_arrays([carried, until.slice(0, n - 1), pa.nulls(1, col[c].type)])
                out[f"_before_{c}"] = shifted.take(pa.array(np.where(new, n, at)))
                filled[c] = until.slice(n - 1)
            for c in prevs:
                source = pa.concat_arrays([before[c], pa.nulls(1, col[c].type)])
                out[f"_prev_{c}"] = source.take(pa.array(np.where(new, n, at)))
            k0, first_group = int(k[-1]) + 1, bool(is_open[-1])
            tail = {c: v.slice(n - 1) for c, v in col.items()}
            yield pa.RecordBatch.from_pydict(out)

    return run


def scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    number: str | None = None,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    prevs: Mapping[str, Column] | None = None,
    earlier: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Rows with columns more: ``number`` (from 0 in each group), running whole sums, the last value that is not null up to the row,
    the value of the row before, and the last value that is not null before the row."""
    sums, prevs, strict = dict(sums or {}), dict(prevs or {}), dict(earlier or {})
    lasts = dict(lasts or {}) | strict
    original = df.columns
    wide = df.select("*", *(e.alias(f"v_{n}") for n, e in (sums | lasts | prevs).items()), *(c.alias(f"g_{i}") for i, c in enumerate([*(map(F.col, by) if by else [F.lit(0)]), *map(F.col, order)])))
    keys = [f"g_{i}" for i in range(len(by) or 1)]  # without groups all rows are one
    ordering = [f"g_{i}" for i in range(len(keys) + len(order))]
    kinds = dict(zip(wide.columns, wide.schema.fields))
    v = lambda names: [f"v_{n}" for n in names]
    fields = [*wide.schema.fields, StructField("_part", IntegerType()), StructField("_open", BooleanType()), StructField("_k", LongType())]
    fields += [StructField(f"_sum_{c}", LongType()) for c in v(sums)]
    fields += [StructField(f"_{what}_{c}", kinds[c].dataType) for what, names in (("last", lasts), ("prev", prevs)) for c in v(names)]
    # the scanner gives columns in this order: what was before a row comes after what is up to it
    told = [f for f in fields if f.name.startswith("_last_")]
    fields = [x for f in fields for x in ((f, StructField(f.name.replace("_last_", "_before_", 1), f.dataType)) if f in told else (f,))]
    fields = [StructField(f.name, f.dataType, True) for f in fields]
    scanned = stage(sorted_map(wide, ordering, _scanner(wide.columns, keys, v(sums), v(lasts), v(prevs)), StructType(fields)), "scanned")
    # one row for each partition: how its last group stands at its end
    ends = scanned.groupBy("_part").agg(
        F.max_by(F.struct(*keys), F.struct(*ordering, "_k")).alias("key"), F.min_by(F.struct(*keys), F.struct(*ordering, "_k")).alias("first"),
        *(F.max_by(c, F.struct(*ordering, "_k")).alias(c) for c in ("_k", "_open", *(f"_sum_{c}" for c in v(sums)), *(f"_last_{c}" for c in v(lasts)), *v(prevs))),
    )
    carried, state = [], None  # the state at the end of the partitions before: key, count, sums, lasts, last row's values
    names = [*(f"_sum_{c}" for c in v(sums)), *(f"_last_{c}" for c in v(lasts)), *v(prevs)]
    for r in sorted(ends.collect(), key=lambda r: r._part):
        if state is not None and r.first == state["key"]:
            carried.append((r._part, state["_k"] + 1, *(state[c] for c in names)))
            here = {"key": r.key, "_k": r._k + (state["_k"] + 1 if r._open else 0)}
            for c in names:
                x = r[c]
                if r._open and c.startswith("_sum_"):
                    x = x + state[c]
                elif r._open and c.startswith("_last_") and x is None:
                    x = state[c]
                here[c] = x
            state = here
        else:
            state = {"key": r.key, "_k": r._k, **{c: r[c] for c in names}}
    types = {f.name: f.dataType for f in fields}
    schema = StructType([StructField("_part", IntegerType()), StructField("c__k", LongType()), *(StructField(f"c_{c}", types[c]) for c in names)])
    table = F.broadcast(df.sparkSession.createDataFrame(carried, schema)) if carried else None
    out = scanned.join(table, "_part", "left") if table is not None else scanned.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema.fields[1:]})
    here = F.col("_open")
    cols = [F.col(f"`{c}`") for c in original]
    if number:
        cols.append((F.col("_k") + F.when(here, F.coalesce("c__k", F.lit(0))).otherwise(0)).alias(number))
    cols += [(F.col(f"_sum_v_{n}") + F.when(here, F.coalesce(f"c__sum_v_{n}", F.lit(0))).otherwise(0)).alias(n) for n in sums]
    cols += [F.coalesce(f"_{'before' if n in strict else 'last'}_v_{n}", F.when(here, F.col(f"c__last_v_{n}"))).alias(n) for n in lasts]
    cols += [F.when(here & (F.col("_k") == 0), F.col(f"c_v_{n}")).otherwise(F.col(f"_prev_v_{n}")).alias(n) for n in prevs]
    return out.select(*cols)
