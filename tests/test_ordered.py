import random

import pytest
from pyspark.sql import functions as F

from sondage.operators import sequences
from sondage.operators.ordered import scan


def expected(rows):
    out, by = {}, {}
    for g, o, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        n, total, last, prev = by.get(g, (0, 0, None, None))
        total, last = total + (v or 0), v if v is not None else last
        out[(g, o)] = (n, total, last, prev, by.get(g, (0, 0, None, None))[2])
        by[g] = (n + 1, total, last, v)
    return out


@pytest.mark.parametrize("batch", ["1", "10000"])
@pytest.mark.parametrize("shape", ["hot", "many", "one", "nulls"])
def test_scan_against_lists(spark, batch, shape):
    rng = random.Random(shape)
    group = {"hot": lambda: rng.choice(["h"] * 8 + ["a", "z"]), "many": lambda: f"g{rng.randrange(150)}", "one": lambda: "x", "nulls": lambda: rng.choice([None, "a"])}[shape]
    rows = [(group(), i, rng.choice([None, 1, 2, 3])) for i in range(300)]
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "g string, o int, v int").repartition(5)
        got = scan(df, ["g"], ["o"], number="n", sums={"total": F.col("v")}, lasts={"last": F.col("v")}, prevs={"prev": F.col("v")}, earlier={"before": F.col("v")}).collect()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert {(r.g, r.o): (r.n, r.total, r["last"], r.prev, r.before) for r in got} == expected(rows)


def test_empty_and_sequences(spark):
    empty = spark.createDataFrame([], "g string, o int, v int")
    assert scan(empty, ["g"], ["o"], number="n", sums={"t": F.col("v")}).count() == 0
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 1, 2, None, None, 1])], "g string, o int, v int")
    runs = sorted((r.island, r.v, r.run_length) for r in sequences.islands(df, ["g"], ["o"], "v").collect())
    assert runs == [(1, 1, 2), (2, 2, 1), (3, None, 2), (4, 1, 1)]
    assert [r.o for r in sequences.changes(df, ["g"], ["o"], "v").orderBy("o").collect()] == [0, 2, 3, 5]
    seen = {r.o: r.near for r in sequences.within_previous(df, ["g"], ["o"], F.col("v") == 2, 2, "near").collect()}
    assert seen == {0: False, 1: False, 2: False, 3: True, 4: True, 5: False}
