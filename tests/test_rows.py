from decimal import Decimal as D

import pytest
from helpers import rows
from pyspark.errors import PySparkException

from weftplan import PlanBuilder, Runtime, Schema, col, lit
from weftplan import functions as fn
from weftplan import types as t
from weftplan.errors import PlanError, SchemaError
from weftplan.operators import SortKey


def test_projection(spark, run):
    df = spark.createDataFrame([(1, "x", 2.0)], "a long, b string, c double")
    assert run(lambda b, x: b.select("s", x, ["c", "a"]), x=df).columns == ["c", "a"]
    assert run(lambda b, x: b.drop("s", x, ["b"]), x=df).columns == ["a", "c"]
    out = run(lambda b, x: b.rename("s", x, {"a": "b", "b": "a"}), x=df)
    assert out.columns == ["b", "a", "c"] and out.first()["b"] == 1
    for bad in (lambda b, x: b.drop("s", x, ["A"]), lambda b, x: b.select("s", x, ["z"])):
        with pytest.raises(SchemaError):
            run(bad, x=df)
    with pytest.raises(PlanError):
        run(lambda b, x: b.select("s", x, ["a", "a"]), x=df)


def test_odd_names(spark, run):
    df = spark.createDataFrame([(1, 2)], "`a.b` long, `c ``d` long")
    assert run(lambda b, x: b.rename("s", x, {"a.b": "ok", "c `d": "e f"}), x=df).columns == ["ok", "e f"]


def test_filter_keeps_true_only(spark, run):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "a long, f boolean")
    assert rows(run(lambda b, x: b.filter("s", x, col("f")), x=df)) == [(1, True)]
    assert rows(run(lambda b, x: b.filter("s", x, ~col("f") | (col("a") == 3)), x=df)) == [(2, False), (3, None)]
    with pytest.raises(SchemaError):
        run(lambda b, x: b.filter("s", x, col("a")), x=df)


def test_nan_is_not_null(spark, run):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    assert run(lambda b, x: b.filter("s", x, col("v").is_null()), x=df).count() == 1


def test_sort_limit_and_null_order(spark, run):
    df = spark.createDataFrame([(3, None), (1, 5), (2, 4), (4, None)], "a long, v long")
    go = lambda keys: [r.a for r in run(lambda b, x: b.sort("s", x, keys), x=df).collect()]
    assert go(["v", "a"]) == [2, 1, 3, 4]
    assert go([SortKey("v", True), SortKey("a")]) == [1, 2, 3, 4]
    assert go([SortKey("v", True, True), SortKey("a", True)]) == [4, 3, 1, 2]
    assert [r.a for r in run(lambda b, x: b.limit("l", b.sort("s", x, ["a"], descending=True), 2), x=df).collect()] == [4, 3]
    assert run(lambda b, x: b.limit("l", x, 0), x=df).count() == 0
    for bad in (-1, True, 1.5):
        with pytest.raises(PlanError):
            run(lambda b, x, bad=bad: b.limit("l", x, bad), x=df)


def test_limit_and_dedup_follow_input_order(spark, run):
    df = spark.createDataFrame([(i, i % 3 if i % 4 else None) for i in range(100)], "i long, k long").repartition(1).sortWithinPartitions("i")
    assert [r.i for r in run(lambda b, x: b.limit("l", b.filter("f", x, col("i") > 10), 3), x=df).collect()] == [11, 12, 13]
    assert rows(run(lambda b, x: b.deduplicate("d", x, ["k"]), x=df)) == [(0, None), (1, 1), (2, 2), (3, 0)]
    assert rows(run(lambda b, x: b.deduplicate("d", x, ["k"], "last"), x=df)) == [(96, None), (97, 1), (98, 2), (99, 0)]
    # a sort in between decides, and its columns may go before the order is needed
    assert rows(run(lambda b, x: b.select("p", b.deduplicate("d", b.sort("s", x, ["i"], descending=True), ["k"]), ["i"]), x=df)) == [(96,), (97,), (98,), (99,)]
    out = run(lambda b, x: b.limit("l", b.drop("p", b.sort("s", x, ["i"], descending=True), ["i"]), 2), x=df)
    assert [r.k for r in out.collect()] == [0, 2] and out.columns == ["k"]


def test_order_key_beats_file_order(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y")], "i long, k string")
    b = PlanBuilder("p")
    b.output("o", b.deduplicate("d", b.input("x", Schema.from_spark(df.schema), order_key=["i"]), ["k"]))
    assert rows(Runtime(spark).execute(b.build(), {"x": df}).output()) == [(1, "x"), (2, "y")]


def test_distinct_nulls_equal_and_maps_refused(spark, run):
    df = spark.createDataFrame([(None, 1), (None, 1), (2, 1)], "a long, b long")
    assert run(lambda b, x: b.distinct("d", x), x=df).count() == 2
    m = spark.createDataFrame([({"a": 1},)], "m map<string,long>")
    with pytest.raises(SchemaError):
        run(lambda b, x: b.distinct("d", x), x=m)


def test_casts(spark, run):
    df = spark.createDataFrame([("10.10",), ("2.35",), ("bad",), (None,)], "v string")
    out = run(lambda b, x: b.aggregate("s", b.cast("c", x, "v", t.Decimal(10, 2), "null"), (), {"s": fn.sum_(col("v"))}), x=df)
    assert out.first().s == D("12.45") and out.schema["s"].dataType.simpleString() == "decimal(10,2)"
    with pytest.raises(PySparkException):
        run(lambda b, x: b.cast("c", x, "v", t.INT64), x=df).collect()
    half = spark.createDataFrame([(1.565,), (1.575,), (2.5,)], "v double")
    assert [r.v for r in run(lambda b, x: b.cast("c", x, "v", t.Decimal(10, 2)), x=half).collect()] == [D("1.56"), D("1.58"), D("2.50")]
    assert [r.v for r in run(lambda b, x: b.cast("c", x, "v", t.INT64), x=half).collect()] == [1, 1, 2]
    u = spark.createDataFrame([(300,), (-1,), (255,)], "v long")
    assert [r.v for r in run(lambda b, x: b.cast("c", x, "v", t.UINT8, "null"), x=u).collect()] == [None, None, 255]
    with pytest.raises(PySparkException):
        run(lambda b, x: b.cast("c", x, "v", t.UINT8), x=u).collect()


def test_derive_types_positions_and_division(spark, run):
    df = spark.createDataFrame([(1, 0.0, None), (0, 0.0, 2)], "i int, z double, n int")
    out = run(lambda b, x: b.derive("d", x, "i", col("i") + col("n"), replace_existing=True), x=df)
    assert out.columns == ["i", "z", "n"] and out.schema["i"].dataType.simpleString() == "int"
    with pytest.raises(SchemaError):
        run(lambda b, x: b.derive("d", x, "i", lit(1)), x=df)
    out = [r.q for r in run(lambda b, x: b.derive("d", x, "q", col("i") / col("z")), x=df).collect()]
    assert out[0] == float("inf") and out[1] != out[1]
    out = [r.q for r in run(lambda b, x: b.derive("d", x, "q", col("n") / col("z")), x=df).collect()]
    assert out == [None, float("inf")]
    assert run(lambda b, x: b.derive("d", x, "five", lit(5)), x=df).schema["five"].dataType.simpleString() == "bigint"


def test_integer_overflow_raises(spark, run):
    df = spark.createDataFrame([(2**62,)], "i long")
    with pytest.raises(PySparkException):
        run(lambda b, x: b.derive("d", x, "j", col("i") + col("i")), x=df).collect()


def test_trim_takes_all_white_space(spark, run):
    df = spark.createDataFrame([("\t  É x \n",)], "s string")
    out = run(lambda b, x: b.derive("e", b.derive("d", x, "t", fn.trim(col("s"))), "l", fn.lower(col("t"))), x=df).first()
    assert (out.t, out.l) == ("É x", "é x")
