import pytest
from helpers import rows

from weftplan import col
from weftplan import functions as fn
from weftplan.errors import PlanError, SchemaError
from weftplan.operators import NullMatch


@pytest.fixture
def sides(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, status string")
    right = spark.createDataFrame([(1, "x", 10), (1, "y", 11), (3, "z", 12), (None, "n", 13)], "id long, status string, amount long")
    return {"l": left, "r": right}


EXPECTED = {
    "inner": [(1, "a", "x", 10), (1, "a", "y", 11), (None, "c", "n", 13)],
    "left": [(1, "a", "x", 10), (1, "a", "y", 11), (2, "b", None, None), (None, "c", "n", 13)],
    "right": [(1, "a", "x", 10), (1, "a", "y", 11), (3, None, "z", 12), (None, "c", "n", 13)],
    "full": [(1, "a", "x", 10), (1, "a", "y", 11), (2, "b", None, None), (3, None, "z", 12), (None, "c", "n", 13)],
    "semi": [(1, "a"), (None, "c")],
    "anti": [(2, "b")],
}


@pytest.mark.parametrize("how", EXPECTED)
def test_joins_match_nulls_by_default(run, sides, how):
    out = run(lambda b, l, r: b.join("j", l, r, how, ["id"]), **sides)
    assert rows(out) == sorted(EXPECTED[how], key=repr)
    assert out.columns == (["id", "status"] if how in ("semi", "anti") else ["id", "status", "status_right", "amount"])


def test_never_match(run, sides):
    assert rows(run(lambda b, l, r: b.join("j", l, r, "inner", ["id"], nulls=NullMatch.NEVER_MATCH), **sides)) == [(1, "a", "x", 10), (1, "a", "y", 11)]
    assert run(lambda b, l, r: b.join("j", l, r, "full", ["id"], nulls="never_match"), **sides).count() == 6


def test_cross_self_and_names(run, sides, spark):
    assert run(lambda b, l, r: b.join("j", l, r, "cross"), **sides).columns == ["id", "status", "id_right", "status_right", "amount"]
    assert run(lambda b, l: b.join("j", l, l, "inner", ["id"], right_suffix="_2"), l=sides["l"]).columns == ["id", "status", "status_2"]
    out = run(lambda b, l, r: b.join("j", l, b.rename("n", r, {"id": "key"}), "right", [("id", "key")]), **sides)
    assert rows(out) == sorted(EXPECTED["right"], key=repr)


def test_join_checks(run, sides):
    for bad, error in ((lambda b, l, r: b.join("j", l, r, "inner"), PlanError), (lambda b, l, r: b.join("j", l, r, "cross", ["id"]), PlanError), (lambda b, l, r: b.join("j", l, r, "inner", [("id", "status")]), SchemaError), (lambda b, l, r: b.join("j", b.rename("q", l, {"status": "status_right"}), b.rename("w", r, {"amount": "status_right"}), "cross", right_suffix="_right"), None)):
        if error:
            with pytest.raises(error):
                run(bad, **sides)
    clash = lambda b, l, r: b.join("j", b.derive("d", l, "status_right", col("status")), r, "inner", ["id"])
    with pytest.raises(SchemaError):
        run(clash, **sides)


def test_set_operations(spark, run):
    a, b_ = spark.createDataFrame([(1,), (1,), (2,), (None,)], "v long"), spark.createDataFrame([(2,), (3,), (None,)], "v long")
    assert rows(run(lambda b, x, y: b.union("u", x, y), x=a, y=b_)) == [(1,), (2,), (3,), (None,)]
    assert run(lambda b, x, y: b.union("u", x, y, all=True), x=a, y=b_).count() == 7
    assert rows(run(lambda b, x, y: b.intersect("u", x, y), x=a, y=b_)) == [(2,), (None,)]
    assert rows(run(lambda b, x, y: b.except_("u", x, y), x=a, y=b_)) == [(1,)]
    with pytest.raises(SchemaError):
        run(lambda b, x, y: b.union("u", x, b.rename("r", y, {"v": "w"})), x=a, y=b_)


def test_union_all_keeps_order_for_dedup(spark, run):
    a, b_ = spark.createDataFrame([(1, "left")], "k long, side string"), spark.createDataFrame([(1, "right"), (2, "right")], "k long, side string")
    assert rows(run(lambda b, x, y: b.deduplicate("d", b.union("u", x, y, all=True), ["k"]), x=a, y=b_)) == [(1, "left"), (2, "right")]


def test_aggregates(spark, run):
    df = spark.createDataFrame([("FR", 1.0), ("FR", None), (None, 3.0), ("US", None)], "c string, v double")
    m = {"n": fn.count(), "k": fn.count(col("v")), "s": fn.sum_(col("v")), "a": fn.mean(col("v")), "d": fn.count_distinct(col("v"))}
    assert rows(run(lambda b, x: b.aggregate("g", x, ["c"], m), x=df)) == [("FR", 2, 1, 1.0, 1.0, 1), ("US", 1, 0, None, None, 0), (None, 1, 1, 3.0, 3.0, 1)]
    empty = run(lambda b, x: b.aggregate("g", b.filter("f", x, col("c") == "zz"), (), m), x=df)
    assert rows(empty) == [(0, 0, None, None, 0)]
    out = run(lambda b, x: b.aggregate("g", x, [fn.lower(col("c")), "c"], {"n": fn.count()}), x=df)
    assert out.columns == ["group_0", "c", "n"]
    for bad in ({}, {"c": fn.count()}, {"n": col("v")}):
        with pytest.raises(PlanError):
            run(lambda b, x, bad=bad: b.aggregate("g", x, ["c"], bad), x=df)


def test_result_types(spark, run):
    df = spark.createDataFrame([(1, 1.5)], "i int, f float").selectExpr("i", "f", "cast(1.25 as decimal(5,2)) d")
    out = run(lambda b, x: b.aggregate("g", x, (), {"i": fn.sum_(col("i")), "f": fn.sum_(col("f")), "d": fn.sum_(col("d")), "m": fn.mean(col("d"))}), x=df)
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "float", "decimal(5,2)", "double"]
