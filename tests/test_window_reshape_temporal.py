from datetime import date, datetime, timedelta

import pytest
from helpers import rows

from weftplan import col, lit
from weftplan import functions as fn
from weftplan import types as t
from weftplan.errors import PlanError, SchemaError
from weftplan.functions import window as w


@pytest.fixture
def orders(spark):
    data = [(1, 2, "B", 20.0), (1, 1, "A", 10.0), (1, 2, "C", None), (1, 3, "D", 40.0), (2, 1, "E", 5.0)]
    return spark.createDataFrame(data, "c long, at long, s string, v double").coalesce(1)


BY = w.partition_by("c").order_by("at")


def one(run, orders, e):
    return [r.x for r in sorted(run(lambda b, x: b.derive("d", x, "x", e), x=orders).collect(), key=lambda r: r.s)]


@pytest.mark.parametrize(("e", "want"), [
    (w.row_number().over(BY), [1, 2, 3, 4, 1]),
    (w.rank().over(BY), [1, 2, 2, 4, 1]),
    (w.dense_rank().over(BY), [1, 2, 2, 3, 1]),
    (w.lag(col("s"), 1, "START").over(BY), ["START", "A", "B", "C", "START"]),
    (w.lag(col("v"), 1, 0.0).over(BY), [0.0, 10.0, 20.0, None, 0.0]),
    (w.lead(col("s"), 2).over(BY), ["C", "D", None, None, None]),
    (w.sum_(col("v")).over(w.partition_by("c")), [70.0] * 4 + [5.0]),
    (w.sum_(col("v")).over(BY), [70.0] * 4 + [5.0]),
    (w.sum_(col("v")).over(BY.rows_between(w.UNBOUNDED_PRECEDING, w.CURRENT_ROW)), [10.0, 30.0, 30.0, 70.0, 5.0]),
    (w.sum_(col("v")).over(BY.rows_between(w.preceding(1), w.CURRENT_ROW)), [10.0, 30.0, 20.0, 40.0, 5.0]),
    (w.count().over(BY.rows_between(w.following(1), w.UNBOUNDED_FOLLOWING)), [3, 2, 1, 0, 0]),
    (w.max_(col("v")).over(BY.range_between(w.preceding(1), w.CURRENT_ROW)), [10.0, 20.0, 20.0, 40.0, 5.0]),
    (w.mean(col("v")).over(BY.range_between(w.UNBOUNDED_PRECEDING, w.CURRENT_ROW)), [10.0, 15.0, 15.0, 70 / 3, 5.0]),
    (w.min_(col("s")).over(w.order_by(w.desc("v", nulls_first=True)).rows_between(w.CURRENT_ROW, w.CURRENT_ROW)), ["A", "B", "C", "D", "E"]),
])
def test_windows(run, orders, e, want):
    assert one(run, orders, e) == want


def test_chained_windows_share_one_exchange(run, orders):
    def build(b, x):
        x = b.derive("a", x, "a", w.sum_(col("v")).over(w.partition_by("c")))
        x = b.derive("b", x, "b", w.rank().over(BY))
        return b.derive("e", x, "e", w.sum_(col("v")).over(BY.rows_between(w.UNBOUNDED_PRECEDING, w.CURRENT_ROW)))

    plan = run(build, x=orders.repartition(3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_pivot(spark, run):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (1, "b", None), (2, "zz", 3.0)], "id long, k string, v double")
    go = lambda how, index=("id",): rows(run(lambda b, x: b.pivot("p", x, index, "k", "v", ["a", "b", "c"], how), x=df))
    assert go("sum") == [(1, 3.0, None, None), (2, None, None, None)]
    assert go("count") == [(1, 2, 0, 0), (2, 0, 0, 0)]
    assert go("mean", ()) == [(1.5, None, None)]
    for bad in (lambda b, x: b.pivot("p", x, ["id"], "k", "v", ["a", "a"]), lambda b, x: b.pivot("p", x, ["id"], "k", "v", [" "]), lambda b, x: b.pivot("p", x, ["id"], "k", "v", ["a"], "median")):
        with pytest.raises(PlanError):
            run(bad, x=df)
    with pytest.raises(SchemaError):
        run(lambda b, x: b.pivot("p", x, ["k"], "id", "v", ["a"]), x=df)


def test_unpivot_explode_flatten(spark, run):
    df = spark.createDataFrame([(1, 2.0, None)], "id long, q1 double, q2 double")
    assert rows(run(lambda b, x: b.unpivot("u", x, ["id"], ["q1", "q2"]), x=df)) == [(1, "q1", 2.0), (1, "q2", None)]
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id long, tags array<string>")
    assert rows(run(lambda b, x: b.explode("e", x, "tags"), x=df)) == [(1, "a"), (1, "b"), (2, None), (3, None)]
    df = spark.createDataFrame([(1, (("P", 2),), 9), (2, None, 8)], "id long, p struct<in:struct<city:string,score:long>>, z long")
    out = run(lambda b, x: b.flatten("g", b.flatten("f", x, "p"), "p_in", "in_"), x=df)
    assert out.columns == ["id", "in_city", "in_score", "z"] and rows(out) == [(1, "P", 2, 9), (2, None, None, 8)]
    assert rows(run(lambda b, x: b.select("s", b.derive("d", x, "c", col("p.in.city")), ["c"]), x=df)) == [("P",), (None,)]
    for bad in (lambda b, x: b.explode("e", x, "id"), lambda b, x: b.flatten("e", x, "id"), lambda b, x: b.unpivot("u", x, [], ["id", "p"])):
        with pytest.raises(SchemaError):
            run(bad, x=df)


def test_time_zones(spark, run):
    df = spark.createDataFrame([(datetime(2024, 7, 1, 10, 30, 5),)], "ts timestamp_ntz")

    def build(b, x):
        x = b.derive("n", x, "utc", fn.normalize_timestamp(col("ts"), "UTC"))
        x = b.derive("p", x, "paris", fn.convert_timezone(col("utc"), "Europe/Paris"))
        x = b.derive("h", x, "h", fn.hour(col("paris")))
        x = b.derive("w", x, "wall", fn.normalize_timestamp(col("paris"), "America/New_York"))
        x = b.derive("g", x, "back", fn.hour(fn.convert_timezone(col("wall"), "UTC")))
        x = b.derive("d", x, "gap", fn.duration_between(col("utc"), col("wall"), "s"))
        x = b.derive("e", x, "day", fn.to_date(fn.convert_timezone(col("utc"), "Pacific/Kiritimati")))
        return b.select("s", x, ["h", "back", "gap", "day"])

    assert rows(run(build, x=df)) == [(12, 16, timedelta(hours=6), date(2024, 7, 2))]


def test_parts_and_time(spark, run):
    df = spark.sql("select timestamp_ntz'2024-02-29 23:59:58.7' ts, date'2023-01-02' d, time'07:08:09' c")
    parts = {"y": fn.year(col("d")), "m": fn.month(col("ts")), "dd": fn.day(col("ts")), "h": fn.hour(col("c")), "mi": fn.minute(col("c")), "s": fn.second(col("ts")), "s2": fn.second(col("c"))}

    def build(b, x):
        for n, e in parts.items():
            x = b.derive(n, x, n, e)
        return b.select("sel", x, list(parts))

    assert rows(run(build, x=df)) == [(2023, 2, 29, 7, 8, 58, 9)]
    assert t.Time() == t.from_spark(df.schema["c"].dataType)
    assert lit("x") is not None


def test_whole_table_aggregates_need_no_single_task(spark, run):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 4.5)], "id long, v double")
    for make, want in ((lambda: w.mean(col("v")).over(w.WindowSpec()), 3.25), (lambda: w.count(col("v")).over(w.order_by("id")), 2), (lambda: w.max_(col("id")).over(w.WindowSpec()), 3)):
        out = run(lambda b, x, make=make: b.derive("d", x, "x", make()), t=df)
        assert {r.x for r in out.collect()} == {want} and "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    empty = run(lambda b, x: b.derive("d", x, "x", w.count().over(w.WindowSpec())), t=df.limit(0))
    assert empty.count() == 0 and not empty.schema["x"].nullable
