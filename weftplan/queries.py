"""A query for each operator, function and option, as plans over the test tables, with the same in SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from . import quality as q
from . import types as t
from .functions import col, lit
from .functions import window as w
from .operators import CastPolicy, NullMatch, SortKey
from .plans import Optimizer, PlanBuilder, analyse
from .plans.compile import compile_plan
from .errors import QualityGateError
from .runtime import OutputBinding, Runtime
from .schema import Schema
from .sources import ReadRequest, Resource, WriteMode, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MONEY = t.Decimal(18, 2)


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


class Draft:
    """A plan under construction with its tables bound; step names are numbered."""

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf, self.b, self.bound, self.n = spark, sf, PlanBuilder("query"), {}, 0

    def table(self, name: str, *columns: str, order_key: tuple[str, ...] = ()):  # noqa: ANN201
        df = load(self.spark, self.sf, name)
        return self.frame(name, df.select(*columns) if columns else df, order_key)

    def frame(self, name: str, df: DataFrame, order_key: tuple[str, ...] = ()):  # noqa: ANN201
        self.n += 1
        name = f"{name}_{self.n}"
        self.bound[name] = df
        return self.b.input(name, Schema.from_spark(df.schema), order_key)

    def __getattr__(self, step: str):  # noqa: ANN204
        def call(*args, **kw):  # noqa: ANN002, ANN003, ANN202
            self.n += 1
            return getattr(self.b, step)(f"{step}_{self.n}", *args, **kw)

        return call

    def plan(self, *datasets):  # noqa: ANN002, ANN201
        for i, d in enumerate(datasets):
            self.b.output(f"out{i}", d)
        return self.b.build()

    def run(self, dataset) -> DataFrame:  # noqa: ANN001
        result = Runtime(self.spark).execute(self.plan(dataset), self.bound)
        result.close()
        return result.output()


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return f(Draft(spark, sf))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""
SELECT c.c_custkey, c.c_name, c.c_mktsegment, o.n AS n_orders, o.spent, upper(c.c_mktsegment) AS segment
FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS spent
  FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) o ON o.o_custkey = c.c_custkey""")
def customer_360(d):  # noqa: ANN001, ANN201
    orders = d.filter(d.table("orders", "o_custkey", "o_orderstatus", "o_totalprice"), col("o_orderstatus") == "F")
    orders = d.cast(orders, "o_totalprice", MONEY)
    per = d.aggregate(orders, ["o_custkey"], {"n_orders": fn.count(), "spent": fn.sum_(col("o_totalprice"))})
    both = d.join(d.table("customer"), per, "left", [("c_custkey", "o_custkey")])
    both = d.derive(both, "segment", fn.upper(col("c_mktsegment")))
    both = d.validate(both, q.ValidationSpec((q.not_null("c_custkey"), q.unique("c_custkey"), q.range_("n_orders", 1), q.row_count(1)), q.Policy.FAIL_AT_END))
    return d.run(d.sort(d.select(both, ["c_custkey", "c_name", "c_mktsegment", "n_orders", "spent", "segment"]), ["c_custkey"]))


@query("SELECT p_partkey, p_brand FROM part")
def scan_project(d):  # noqa: ANN001, ANN201
    return d.run(d.select(d.table("part"), ["p_partkey", "p_brand"]))


@query("SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def drop_columns(d):  # noqa: ANN001, ANN201
    return d.run(d.drop(d.table("part"), ["p_brand", "p_type"]))


@query("SELECT s_suppkey AS s_nationkey, s_name, s_nationkey AS s_suppkey, s_acctbal FROM supplier")
def rename_swap(d):  # noqa: ANN001, ANN201
    return d.run(d.rename(d.table("supplier"), {"s_suppkey": "s_nationkey", "s_nationkey": "s_suppkey"}))


def with_nulls(d):  # noqa: ANN001, ANN201
    """orders with n: NULL where the key is divisible by three, as no table has a NULL of its own."""
    o = load(d.spark, d.sf, "orders").withColumn("n", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 100))
    return d.frame("orders", o)


ORDERS_N = "(SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 100 END AS n FROM orders)"


@query(f"SELECT o_orderkey, n FROM {ORDERS_N} WHERE (n > 50 AND o_orderstatus = 'F') OR NOT (n < 90)")
def filter_three_valued(d):  # noqa: ANN001, ANN201
    return d.run(d.select(d.filter(with_nulls(d), (col("n") > 50) & (col("o_orderstatus") == "F") | ~(col("n") < 90)), ["o_orderkey", "n"]))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey = NULL")
def filter_null_literal(d):  # noqa: ANN001, ANN201
    return d.run(d.select(d.filter(d.table("orders"), col("o_orderkey") == lit(None, t.INT64)), ["o_orderkey"]))


@query(f"SELECT o_orderkey, n IS NULL AS missing, n IS NOT NULL AS present FROM {ORDERS_N} WHERE n IS NULL OR n <> 7")
def null_predicates(d):  # noqa: ANN001, ANN201
    x = d.filter(with_nulls(d), col("n").is_null() | (col("n") != 7))
    x = d.derive(d.derive(x, "missing", col("n").is_null()), "present", col("n").is_not_null())
    return d.run(d.select(x, ["o_orderkey", "missing", "present"]))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def limit_topk(d):  # noqa: ANN001, ANN201
    x = d.sort(d.table("orders"), [SortKey("o_totalprice", True), SortKey("o_orderkey")])
    return d.run(d.select(d.limit(x, 100), ["o_orderkey", "o_totalprice"]))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10")
def limit_by_order_key(d):  # noqa: ANN001, ANN201
    return d.run(d.limit(d.table("orders", "o_orderkey", order_key=("o_orderkey",)), 10))


@query(f"SELECT o_orderkey, n FROM {ORDERS_N} ORDER BY n DESC NULLS FIRST, o_orderkey")
def sort_nulls_first(d):  # noqa: ANN001, ANN201
    return d.run(d.select(d.sort(with_nulls(d), [SortKey("n", True, True), SortKey("o_orderkey")]), ["o_orderkey", "n"]))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(d):  # noqa: ANN001, ANN201
    return d.run(d.distinct(d.table("lineitem", "l_returnflag", "l_linestatus")))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def dedup_first(d):  # noqa: ANN001, ANN201
    return d.run(d.deduplicate(d.table("orders", "o_custkey", "o_orderkey", order_key=("o_orderkey",)), ["o_custkey"], "first"))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def dedup_last(d):  # noqa: ANN001, ANN201
    return d.run(d.deduplicate(d.table("orders", "o_custkey", "o_orderkey", order_key=("o_orderkey",)), ["o_custkey"], "last"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def dedup_after_sort(d):  # noqa: ANN001, ANN201
    x = d.sort(d.table("orders", "o_custkey", "o_orderkey", "o_totalprice", order_key=("o_orderkey",)), ["o_totalprice"], descending=True)
    return d.run(d.deduplicate(x, ["o_custkey"]))


@query("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def cast_raise(d):  # noqa: ANN001, ANN201
    return d.run(d.cast(d.table("orders", "o_orderkey", "o_custkey"), "o_custkey", t.STRING))


@query("SELECT o_orderkey, TRY_CAST(o_orderpriority AS DECIMAL(10,2)) AS o_orderpriority FROM orders")
def cast_null_decimal(d):  # noqa: ANN001, ANN201
    return d.run(d.cast(d.table("orders", "o_orderkey", "o_orderpriority"), "o_orderpriority", t.Decimal(10, 2), CastPolicy.NULL))


@query("SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS p_retailprice FROM part")
def cast_float_int(d):  # noqa: ANN001, ANN201
    return d.run(d.cast(d.table("part", "p_partkey", "p_retailprice"), "p_retailprice", t.INT64))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
def cast_date(d):  # noqa: ANN001, ANN201
    return d.run(d.cast(d.table("orders", "o_orderkey", "o_orderdate"), "o_orderdate", t.DATE))


@query("SELECT p_partkey, p_size + p_partkey AS a, CAST(p_size AS BIGINT) * 3 - 1 AS b, p_retailprice * 2.0 AS c, -p_size AS e FROM part")
def arithmetic(d):  # noqa: ANN001, ANN201
    x = d.table("part", "p_partkey", "p_size", "p_retailprice")
    x = d.derive(x, "a", col("p_size") + col("p_partkey"))
    x = d.derive(x, "b", col("p_size") * 3 - 1)
    x = d.derive(x, "c", col("p_retailprice") * 2.0)
    x = d.derive(x, "e", -col("p_size"))
    return d.run(d.select(x, ["p_partkey", "a", "b", "c", "e"]))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) / p_partkey AS a, 'Infinity' AS more, '-Infinity' AS less, 'NaN' AS none FROM part")
def division_by_zero(d):  # noqa: ANN001, ANN201
    x, zero = d.table("part", "p_partkey", "p_size"), col("p_size") - col("p_size")
    for name, e in (("a", col("p_size") / col("p_partkey")), ("more", col("p_size") / zero), ("less", -col("p_size") / zero), ("none", zero / zero)):
        x = d.derive(x, name, e)
    for name in ("more", "less", "none"):
        x = d.cast(x, name, t.STRING)
    return d.run(d.drop(x, ["p_size"]))


@query("SELECT p_partkey, CAST(5 AS BIGINT) AS five, TRUE AS yes, 'x' AS x, CAST(1.50 AS DECIMAL(3,2)) AS dec FROM part")
def literals(d):  # noqa: ANN001, ANN201
    from decimal import Decimal

    x = d.table("part", "p_partkey")
    for name, v in (("five", 5), ("yes", True), ("x", "x"), ("dec", Decimal("1.50"))):
        x = d.derive(x, name, lit(v))
    return d.run(x)


@query("SELECT p_partkey, p_size + 1 AS p_size, p_name FROM part")
def derive_replace(d):  # noqa: ANN001, ANN201
    x = d.derive(d.table("part", "p_partkey", "p_size", "p_name"), "p_size", col("p_size") + lit(1, t.INT32), replace_existing=True)
    return d.run(x)


def nations(d):  # noqa: ANN001, ANN201
    """Left: nations of three regions; right: regions from the second on, so either side has rows without a match."""
    left = d.filter(d.rename(d.table("nation"), {"n_regionkey": "regionkey"}), col("regionkey") < lit(3, t.INT32))
    right = d.filter(d.rename(d.table("region"), {"r_regionkey": "regionkey"}), col("regionkey") >= lit(1, t.INT32))
    return left, right


N3, R1 = "(SELECT n_nationkey, n_name, n_regionkey AS regionkey FROM nation WHERE n_regionkey < 3)", "(SELECT r_regionkey AS regionkey, r_name FROM region WHERE r_regionkey >= 1)"

for _how in ("inner", "left", "right", "full"):
    def _join(d, how=_how):  # noqa: ANN001, ANN202
        return d.run(d.join(*nations(d), how, ["regionkey"]))

    _join.__name__ = f"join_{_how}"
    query(f"SELECT n_nationkey, n_name, coalesce(a.regionkey, b.regionkey) AS regionkey, r_name FROM {N3} a {_how.upper()} JOIN {R1} b ON a.regionkey = b.regionkey")(_join)

for _how, _not in (("semi", ""), ("anti", "NOT ")):
    def _half(d, how=_how):  # noqa: ANN001, ANN202
        return d.run(d.join(*nations(d), how, ["regionkey"]))

    _half.__name__ = f"join_{_how}"
    query(f"SELECT * FROM {N3} a WHERE {_not}EXISTS (SELECT 1 FROM {R1} b WHERE a.regionkey = b.regionkey)")(_half)


@query(f"SELECT n_nationkey, a.regionkey, b.regionkey AS regionkey_right, r_name FROM {N3} a CROSS JOIN {R1} b")
def join_cross(d):  # noqa: ANN001, ANN201
    left, right = nations(d)
    return d.run(d.drop(d.join(left, right, "cross"), ["n_name"]))


def null_sides(d):  # noqa: ANN001, ANN201
    """All orders, a third of them with a NULL key, and a row for each key, the NULL one included."""
    left = d.select(with_nulls(d), ["o_orderkey", "n"])
    return left, d.aggregate(with_nulls(d), ["n"], {"m": fn.count(), "least": fn.min_(col("o_orderkey"))})


PER_N = f"(SELECT n, count(*) AS m, min(o_orderkey) AS least FROM {ORDERS_N} GROUP BY n)"


@query(f"SELECT o_orderkey, a.n, m, least FROM {ORDERS_N} a JOIN {PER_N} b ON a.n IS NOT DISTINCT FROM b.n")
def join_null_match(d):  # noqa: ANN001, ANN201
    return d.run(d.join(*null_sides(d), "inner", ["n"], NullMatch.MATCH))


@query(f"SELECT o_orderkey, a.n, m, least FROM {ORDERS_N} a LEFT JOIN {PER_N} b ON a.n = b.n")
def join_null_never(d):  # noqa: ANN001, ANN201
    return d.run(d.join(*null_sides(d), "left", ["n"], NullMatch.NEVER_MATCH))


@query("SELECT a.l_partkey, a.l_suppkey, n, m FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) a JOIN (SELECT l_partkey, l_suppkey, count(*) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey")
def join_multi_key(d):  # noqa: ANN001, ANN201
    x = d.table("lineitem", "l_partkey", "l_suppkey", "l_returnflag")
    a = d.aggregate(x, ["l_partkey", "l_suppkey"], {"n": fn.count()})
    b = d.aggregate(d.filter(x, col("l_returnflag") == "R"), ["l_partkey", "l_suppkey"], {"m": fn.count()})
    return d.run(d.join(a, b, "inner", ["l_partkey", "l_suppkey"]))


@query("SELECT coalesce(c_custkey, o_custkey) AS c_custkey, c_name, n FROM (SELECT c_custkey, c_name FROM customer WHERE c_custkey > 100) c FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def join_different_names(d):  # noqa: ANN001, ANN201
    c = d.filter(d.table("customer", "c_custkey", "c_name"), col("c_custkey") > 100)
    o = d.aggregate(d.table("orders", "o_custkey"), ["o_custkey"], {"n": fn.count()})
    return d.run(d.join(c, o, "full", [("c_custkey", "o_custkey")]))


@query("SELECT a.n_nationkey, a.n_name, a.n_regionkey, b.n_name AS n_name_twin FROM nation a JOIN nation b ON a.n_nationkey = b.n_regionkey")
def join_suffix(d):  # noqa: ANN001, ANN201
    x = d.table("nation")
    y = d.rename(d.drop(d.table("nation"), ["n_nationkey"]), {"n_regionkey": "key"})
    return d.run(d.join(x, y, "inner", [("n_nationkey", "key")], right_suffix="_twin"))


SIDES = "(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')", "(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')"


def custkeys(d):  # noqa: ANN001, ANN201
    x = d.table("orders", "o_custkey", "o_orderstatus")
    return [d.rename(d.select(d.filter(x, col("o_orderstatus") == s), ["o_custkey"]), {"o_custkey": "k"}) for s in "FP"]


@query("SELECT k FROM {} UNION SELECT k FROM {}".format(*SIDES))
def union_distinct(d):  # noqa: ANN001, ANN201
    return d.run(d.union(*custkeys(d)))


@query("SELECT k FROM {} UNION ALL SELECT k FROM {}".format(*SIDES))
def union_all(d):  # noqa: ANN001, ANN201
    return d.run(d.union(*custkeys(d), all=True))


@query("SELECT k FROM {} INTERSECT SELECT k FROM {}".format(*SIDES))
def intersect(d):  # noqa: ANN001, ANN201
    return d.run(d.intersect(*custkeys(d)))


@query("SELECT k FROM {} EXCEPT SELECT k FROM {}".format(*SIDES))
def except_rows(d):  # noqa: ANN001, ANN201
    return d.run(d.except_(*custkeys(d)))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines, min(l_shipdate) AS first, max(l_quantity) AS most,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS price, avg(l_linenumber) AS line FROM lineitem GROUP BY ALL""")
def agg_group(d):  # noqa: ANN001, ANN201
    x = d.cast(d.table("lineitem"), "l_extendedprice", MONEY)
    m = {"n": fn.count(), "lines": fn.sum_(col("l_linenumber")), "first": fn.min_(col("l_shipdate")), "most": fn.max_(col("l_quantity")), "price": fn.sum_(col("l_extendedprice")), "line": fn.mean(col("l_linenumber"))}
    return d.run(d.aggregate(x, ["l_returnflag", "l_linestatus"], m))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS group_0, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def agg_expression_key(d):  # noqa: ANN001, ANN201
    return d.run(d.aggregate(d.table("orders"), [fn.year(col("o_orderdate")), "o_orderstatus"], {"n": fn.count()}))


@query(f"SELECT n, count(*) AS rows_, count(n) AS present, CAST(sum(n) AS BIGINT) AS s FROM {ORDERS_N} GROUP BY n")
def agg_null_group(d):  # noqa: ANN001, ANN201
    return d.run(d.aggregate(with_nulls(d), ["n"], {"rows_": fn.count(), "present": fn.count(col("n")), "s": fn.sum_(col("n"))}))


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders")
def agg_global(d):  # noqa: ANN001, ANN201
    return d.run(d.aggregate(d.table("orders"), (), {"n": fn.count(), "customers": fn.count_distinct(col("o_custkey"))}))


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders WHERE o_orderkey < 0")
def agg_global_empty(d):  # noqa: ANN001, ANN201
    return d.run(d.aggregate(d.filter(d.table("orders"), col("o_orderkey") < 0), (), {"n": fn.count(), "s": fn.sum_(col("o_orderkey"))}))


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY 1")
def agg_count_distinct(d):  # noqa: ANN001, ANN201
    return d.run(d.aggregate(d.table("orders"), ["o_custkey"], {"kinds": fn.count_distinct(col("o_orderpriority"))}))


def windowed(name: str, sql: str, made) -> None:  # noqa: ANN001
    def f(d):  # noqa: ANN001, ANN202
        x = d.derive(d.table("orders", "o_orderkey", "o_custkey", "o_orderdate", order_key=("o_orderkey",)), "x", made())
        return d.run(d.select(x, ["o_orderkey", "x"]))

    f.__name__ = name
    query(f"SELECT o_orderkey, {sql} AS x FROM orders")(f)


BY_DATE = w.partition_by("o_custkey").order_by("o_orderdate")
BY_KEY = w.partition_by("o_custkey").order_by("o_orderkey")
W_DATE, W_KEY = "PARTITION BY o_custkey ORDER BY o_orderdate", "PARTITION BY o_custkey ORDER BY o_orderkey"
KEY = col("o_orderkey")
windowed("win_row_number", f"row_number() OVER ({W_DATE}, o_orderkey)", lambda: w.row_number().over(BY_DATE))
windowed("win_rank", f"rank() OVER ({W_DATE})", lambda: w.rank().over(BY_DATE))
windowed("win_dense_rank", "dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST)", lambda: w.dense_rank().over(w.partition_by("o_custkey").order_by(w.desc("o_orderdate"))))
windowed("win_lag_default", f"lag(o_orderkey, 2, -1) OVER ({W_KEY})", lambda: w.lag(KEY, 2, -1).over(BY_KEY))
windowed("win_lag_column_default", f"lag(o_orderkey, 1, o_custkey) OVER ({W_KEY})", lambda: w.lag(KEY, 1, col("o_custkey")).over(BY_KEY))
windowed("win_lead", f"lead(o_orderkey) OVER ({W_KEY})", lambda: w.lead(KEY).over(BY_KEY))
windowed("win_full", "CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey) AS BIGINT)", lambda: w.sum_(KEY).over(w.partition_by("o_custkey")))
windowed("win_global", "count(*) OVER ()", lambda: w.count().over(w.WindowSpec()))
windowed("win_global_sum", "CAST(sum(o_custkey) OVER () AS BIGINT)", lambda: w.sum_(col("o_custkey")).over(w.order_by("o_orderkey")))
windowed("win_ordered_no_frame", f"CAST(sum(o_orderkey) OVER ({W_KEY} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS BIGINT)", lambda: w.sum_(KEY).over(BY_KEY))
windowed("win_cumulative", f"CAST(sum(o_orderkey) OVER ({W_KEY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)", lambda: w.sum_(KEY).over(BY_KEY.rows_between(w.UNBOUNDED_PRECEDING, w.CURRENT_ROW)))
windowed("win_moving", f"min(o_orderkey) OVER ({W_KEY} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", lambda: w.min_(KEY).over(BY_KEY.rows_between(w.preceding(2), w.CURRENT_ROW)))
windowed("win_following", f"max(o_orderkey) OVER ({W_KEY} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)", lambda: w.max_(KEY).over(BY_KEY.rows_between(w.following(1), w.following(3))))
windowed("win_mean", f"avg(o_orderkey) OVER ({W_KEY} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)", lambda: w.mean(KEY).over(BY_KEY.rows_between(w.preceding(1), w.following(1))))
windowed("win_range", f"count(*) OVER ({W_KEY} RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW)", lambda: w.count().over(BY_KEY.range_between(w.preceding(1000), w.CURRENT_ROW)))


def pivot(kind: str, sql: str, index=("o_orderpriority",)):  # noqa: ANN001, ANN201
    def f(d):  # noqa: ANN001, ANN202
        return d.run(d.pivot(d.table("orders"), index, "o_orderstatus", "o_orderkey", ["F", "O", "none"], kind))

    f.__name__ = f"pivot_{kind}" if index else "pivot_global"
    cells = ", ".join(f"{sql.format(c)} AS \"{c}\"" for c in ("F", "O", "none"))
    query(f"SELECT {'o_orderpriority, ' if index else ''}{cells} FROM orders {'GROUP BY 1' if index else ''}")(f)


pivot("sum", "CAST(sum(o_orderkey) FILTER (WHERE o_orderstatus = '{0}') AS BIGINT)")
pivot("count", "count(o_orderkey) FILTER (WHERE o_orderstatus = '{0}')")
pivot("min", "min(o_orderkey) FILTER (WHERE o_orderstatus = '{0}')")
pivot("max", "max(o_orderkey) FILTER (WHERE o_orderstatus = '{0}')")
pivot("mean", "avg(o_orderkey) FILTER (WHERE o_orderstatus = '{0}')")
pivot("max", "max(o_orderkey) FILTER (WHERE o_orderstatus = '{0}')", ())


@query(f"SELECT o_orderkey, 'o_custkey' AS variable, o_custkey AS value FROM {ORDERS_N} UNION ALL SELECT o_orderkey, 'n', n FROM {ORDERS_N}")
def unpivot(d):  # noqa: ANN001, ANN201
    return d.run(d.unpivot(with_nulls(d), ["o_orderkey"], ["o_custkey", "n"]))


@query("SELECT vec_id, unnest(embedding) AS embedding FROM embeddings UNION ALL SELECT * FROM (VALUES (-1, NULL), (-2, NULL))")
def explode_list(d):  # noqa: ANN001, ANN201
    e = load(d.spark, d.sf, "embeddings").select("vec_id", "embedding")
    odd = d.spark.createDataFrame([(-1, []), (-2, None)], e.schema)  # no table has an empty or a missing list
    return d.run(d.explode(d.frame("embeddings", e.union(odd)), "embedding"))


def events(d):  # noqa: ANN001, ANN201
    e = load(d.spark, d.sf, "events").select("event_id", F.struct("ts", F.struct("value", "event_type").alias("what")).alias("e"))
    return d.frame("events", e)


@query("SELECT event_id, ts AS x_ts, value AS w_value, event_type AS w_event_type FROM events")
def flatten_struct(d):  # noqa: ANN001, ANN201
    return d.run(d.flatten(d.flatten(events(d), "e", "x_"), "x_what", "w_"))


@query("SELECT event_id, event_type AS kind FROM events WHERE value > 50")
def nested_path(d):  # noqa: ANN001, ANN201
    x = d.derive(d.filter(events(d), col("e.what.value") > 50.0), "kind", col("e.what.event_type"))
    return d.run(d.drop(x, ["e"]))


@query("SELECT c_custkey, lower(c_name) AS low, upper(c_mktsegment) AS up, trim(c_name) AS t, c_name || '/' || c_mktsegment AS both_ FROM customer")
def strings(d):  # noqa: ANN001, ANN201
    x = d.table("customer")
    x = d.derive(x, "low", fn.lower(col("c_name")))
    x = d.derive(x, "up", fn.upper(col("c_mktsegment")))
    padded = fn.concat(lit(" \t\n "), col("c_name"), lit("\r  "))
    x = d.derive(d.derive(x, "t", fn.trim(padded)), "both_", fn.concat(col("c_name"), lit("/"), col("c_mktsegment")))
    return d.run(d.select(x, ["c_custkey", "low", "up", "t", "both_"]))


@query("SELECT doc_id, lower(text) AS low, replace(upper(text), 'ẞ', 'SS') AS up FROM documents")
def strings_unicode(d):  # noqa: ANN001, ANN201
    x = d.derive(d.derive(d.table("documents", "doc_id", "text"), "low", fn.lower(col("text"))), "up", fn.upper(col("text")))
    return d.run(d.drop(x, ["text"]))


PARTS = ("year", "month", "day", "hour", "minute", "second")


def parts(d, x, source: str, prefix: str = ""):  # noqa: ANN001, ANN201
    for p in PARTS:
        x = d.derive(x, prefix + p, getattr(fn, p)(col(source)))
    return x


@query("SELECT event_id, " + ", ".join(f"CAST({p}(ts) AS INTEGER) AS {p}" for p in PARTS) + ", CAST(ts AS DATE) AS on_ FROM events")
def timestamp_parts(d):  # noqa: ANN001, ANN201
    x = parts(d, d.table("events", "event_id", "ts"), "ts")
    return d.run(d.drop(d.derive(x, "on_", fn.to_date(col("ts"))), ["ts"]))


@query("SELECT event_id, CAST(hour((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Paris') AS INTEGER) AS hour, CAST(day((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Paris') AS INTEGER) AS day FROM events")
def convert_timezone(d):  # noqa: ANN001, ANN201
    x = d.derive(d.table("events", "event_id", "ts"), "z", fn.convert_timezone(fn.normalize_timestamp(col("ts"), "UTC"), "Europe/Paris"))
    x = d.derive(d.derive(x, "hour", fn.hour(col("z"))), "day", fn.day(col("z")))
    return d.run(d.select(x, ["event_id", "hour", "day"]))


@query("SELECT event_id, CAST(hour((ts AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC') AS INTEGER) AS hour FROM events")
def normalize_timezone(d):  # noqa: ANN001, ANN201
    x = d.derive(d.table("events", "event_id", "ts"), "z", fn.convert_timezone(fn.normalize_timestamp(col("ts"), "America/New_York"), "UTC"))
    return d.run(d.select(d.derive(x, "hour", fn.hour(col("z"))), ["event_id", "hour"]))


@query("SELECT user_id, CAST(epoch_us(max(ts) - min(ts)) AS BIGINT) AS us FROM events GROUP BY 1")
def duration(d):  # noqa: ANN001, ANN201
    x = d.aggregate(d.table("events"), ["user_id"], {"a": fn.min_(col("ts")), "b": fn.max_(col("ts"))})
    out = d.run(d.derive(x, "d", fn.duration_between(col("a"), col("b"))))
    day, hour, minute = (F.expr(f"extract({u} FROM d)").cast("long") for u in ("DAY", "HOUR", "MINUTE"))
    us = (F.expr("extract(SECOND FROM d)") * 1_000_000).cast("long")
    return out.select("user_id", (((day * 24 + hour) * 60 + minute) * 60_000_000 + us).alias("us"))


RULES = (
    q.not_null("n", max_violations=None, name="not_null"),
    q.unique("o_custkey", max_violations=None, name="unique"),
    q.unique("n", "o_orderstatus", max_violations=None, name="unique_pair"),
    q.range_("n", 10, 90, include_max=False, max_violations=None, name="range"),
    q.allowed_values("o_orderstatus", ["F", "O"], max_violations=None, name="allowed"),
    q.regex("o_orderpriority", r"\d-[A-Z ]+", max_violations=None, name="regex"),
    q.row_count(1, name="row_count"),
    q.expression(col("n") < 50, name="expression", max_violations=None),
)


@query(f"""WITH o AS (SELECT * FROM {ORDERS_N}), c AS (SELECT count(*) AS k FROM o)
SELECT 'not_null' AS rule, count(*) FILTER (WHERE n IS NULL) AS violations, count(*) AS evaluated FROM o
UNION ALL SELECT 'unique', count(*) - count(DISTINCT o_custkey), count(*) FROM o
UNION ALL SELECT 'unique_pair', (SELECT k FROM c) - (SELECT count(*) FROM (SELECT DISTINCT n, o_orderstatus FROM o)), (SELECT k FROM c)
UNION ALL SELECT 'range', count(*) FILTER (WHERE n < 10 OR n >= 90), count(*) FROM o
UNION ALL SELECT 'allowed', count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')), count(*) FROM o
UNION ALL SELECT 'regex', count(*) FILTER (WHERE NOT regexp_full_match(o_orderpriority, '\\d-[A-Z ]+')), count(*) FROM o
UNION ALL SELECT 'row_count', 0, 1
UNION ALL SELECT 'expression', count(*) FILTER (WHERE NOT coalesce(n < 50, FALSE)), count(*) FROM o""")
def gate_evidence(d):  # noqa: ANN001, ANN201
    x = d.validate(with_nulls(d), q.ValidationSpec(RULES, q.Policy.WARN_ONLY))
    got = Runtime(d.spark).execute(d.plan(x), d.bound)
    rows = [(r.rule, r.violations, r.evaluated) for g in got.gates for r in g.rules]
    got.close()
    return d.spark.createDataFrame(rows, "rule string, violations long, evaluated long")


SEGMENT = "SELECT o_orderpriority, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1"


@query(SEGMENT)
def optimized_plan(d):  # noqa: ANN001, ANN201
    x = d.filter(d.sort(d.select(d.table("orders"), ["o_orderkey", "o_orderpriority", "o_orderstatus"]), ["o_orderkey"]), (col("o_orderstatus") == "F") & (lit(1) < 2))
    x = d.aggregate(x, ["o_orderpriority"], {"n": fn.count(), "s": fn.sum_(col("o_orderkey"))})
    return Runtime(d.spark).execute(Optimizer().optimize(d.plan(x)), d.bound).output()


@query("SELECT o_orderpriority, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def reference_shape(d):  # noqa: ANN001, ANN201
    x = d.filter(d.table("orders", "o_orderpriority", "o_orderstatus", "o_totalprice"), col("o_orderstatus") == "F")
    x = d.derive(x, "tidy", fn.lower(fn.trim(col("o_orderpriority"))))
    x = d.cast(x, "o_totalprice", MONEY)
    return d.run(d.sort(d.aggregate(x, ["o_orderpriority"], {"n": fn.count(), "s": fn.sum_(col("o_totalprice"))}), ["o_orderpriority"]))


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def parquet_pushdown(d):  # noqa: ANN001, ANN201
    return read(d.spark, ReadRequest(Resource(f"{d.sf}/lineitem.parquet"), columns=("l_orderkey", "l_quantity"), predicate=(col("l_quantity") > 45.0) & (col("l_returnflag") == "R"))).df


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def resource_binding(d):  # noqa: ANN001, ANN201
    from .runtime import InputBinding

    x = d.aggregate(d.table("orders"), ["o_orderstatus"], {"n": fn.count()})
    (name,) = d.bound
    return Runtime(d.spark).execute(d.plan(x), [InputBinding.from_resource(name, Resource(f"{d.sf}/orders.parquet"))]).output()


@query("""SELECT * FROM (VALUES
  ('aggregate_2', 'first', 'join_4', 'first', 'direct'),
  ('aggregate_2', 'n', 'join_4', 'n', 'direct'),
  ('customer_3', 'c_acctbal', 'join_4', 'c_acctbal', 'direct'),
  ('customer_3', 'c_custkey', 'join_4', 'c_custkey', 'direct'),
  ('customer_3', 'c_mktsegment', 'join_4', 'c_mktsegment', 'direct'),
  ('customer_3', 'c_name', 'join_4', 'c_name', 'direct'),
  ('customer_3', 'c_nationkey', 'join_4', 'c_nationkey', 'direct'),
  ('join_4', 'c_acctbal', 'output:out0', 'c_acctbal', 'direct'),
  ('join_4', 'c_custkey', 'output:out0', 'c_custkey', 'direct'),
  ('join_4', 'c_mktsegment', 'output:out0', 'c_mktsegment', 'direct'),
  ('join_4', 'c_name', 'output:out0', 'c_name', 'direct'),
  ('join_4', 'c_nationkey', 'output:out0', 'c_nationkey', 'direct'),
  ('join_4', 'first', 'output:out0', 'first', 'direct'),
  ('join_4', 'n', 'output:out0', 'n', 'direct'),
  ('orders_1', 'o_custkey', 'aggregate_2', 'o_custkey', 'direct'),
  ('orders_1', 'o_orderdate', 'aggregate_2', 'first', 'aggregated')
) AS edges(source, source_field, target, target_field, kind)""")
def lineage_edges(d):  # noqa: ANN001, ANN201
    per = d.aggregate(d.table("orders"), ["o_custkey"], {"n": fn.count(), "first": fn.min_(col("o_orderdate"))})
    got = analyse(d.plan(d.join(d.table("customer"), per, "left", [("c_custkey", "o_custkey")])))
    return d.spark.createDataFrame([(e.source.step, e.source.field, e.target.step, e.target.field, str(e.kind)) for e in got.edges], "source string, source_field string, target string, target_field string, kind string")


def scratch(d, name: str) -> str:  # noqa: ANN001
    """A fresh place in the folder that all executors share (where none is named, and the master is local: a temporary one)."""
    base = d.spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not d.spark.sparkContext.master.startswith("local") or "-cluster" in d.spark.sparkContext.master:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="weftplan-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}/{name}"


def through(d, dataset, name: str, times=(WriteMode.CREATE_NEW,)) -> DataFrame:  # noqa: ANN001
    """``dataset`` written once for each mode, and what is read back under its schema."""
    target, plan = Resource(scratch(d, name)), d.plan(dataset)
    for mode in times:
        Runtime(d.spark).execute(plan, d.bound, [OutputBinding.to_resource("out0", target, mode)])
    b = PlanBuilder("back")
    b.output("out", b.input("in", dataset.schema))
    return Runtime(d.spark).execute(b.build(), {"in": target}).output()


SOME_ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority FROM orders"
ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")


@query(SOME_ORDERS)
def sink_csv(d):  # noqa: ANN001, ANN201
    return through(d, d.table("orders", *ORDER_COLUMNS), "o.csv")


@query("SELECT event_id, ts, value, event_type FROM events")
def sink_jsonl(d):  # noqa: ANN001, ANN201
    return through(d, events(d), "e.jsonl").select("event_id", "e.ts", "e.what.*")


@query("SELECT * FROM part")
def sink_parquet(d):  # noqa: ANN001, ANN201
    return through(d, d.table("part"), "p.parquet")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sink_arrow(d):  # noqa: ANN001, ANN201
    return through(d, d.table("nation"), "n.arrow")  # one file, by the driver, so a small table


@query(f"{SOME_ORDERS} UNION ALL {SOME_ORDERS}")
def sink_append(d):  # noqa: ANN001, ANN201
    return through(d, d.table("orders", *ORDER_COLUMNS), "o.csv", (WriteMode.CREATE_NEW, WriteMode.APPEND))


@query("SELECT o_orderkey + 2 AS o_orderkey, o_custkey FROM orders")
def sink_replace_own_input(d):  # noqa: ANN001, ANN201
    target = Resource(scratch(d, "o.parquet"))
    Runtime(d.spark).execute(d.plan(d.table("orders", "o_orderkey", "o_custkey")), d.bound, [OutputBinding.to_resource("out0", target)])
    b = PlanBuilder("more")
    x = b.input("in", Schema.of(("o_orderkey", t.INT64), ("o_custkey", t.INT64)))
    b.output("out", b.derive("add", x, "o_orderkey", col("o_orderkey") + 1, replace_existing=True))
    for _ in range(2):
        Runtime(d.spark).execute(b.build(), {"in": target}, [OutputBinding.to_resource("out", target, WriteMode.REPLACE)])
    return read(d.spark, ReadRequest(target)).df


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
def partition_filters(d):  # noqa: ANN001, ANN201
    path = scratch(d, "o.parquet")
    load(d.spark, d.sf, "orders").write.partitionBy("o_orderstatus").parquet(path)
    got = read(d.spark, ReadRequest(Resource(path), columns=("o_orderkey", "o_totalprice"), predicate=col("o_totalprice") > 1000.0, partition_filters=(("o_orderstatus", "F"),)))
    if set(got.evidence.values()) != {"source"}:
        raise AssertionError(got.evidence)
    return got.df


def bound_as(d, make) -> DataFrame:  # noqa: ANN001
    """A plan over the nations, bound as another library's table: a small one, which passes the driver."""
    x = d.table("nation")
    (name,) = d.bound
    return Runtime(d.spark).execute(d.plan(d.filter(x, col("n_regionkey") > lit(0, t.INT32))), {name: make(d.bound[name])}).output()


@query("SELECT * FROM nation WHERE n_regionkey > 0")
def bind_arrow(d):  # noqa: ANN001, ANN201
    return bound_as(d, lambda df: df.toArrow())


@query("SELECT * FROM nation WHERE n_regionkey > 0")
def bind_pandas(d):  # noqa: ANN001, ANN201
    return bound_as(d, lambda df: df.toPandas())


def evidence(d, gates) -> DataFrame:  # noqa: ANN001
    return d.spark.createDataFrame([(r.rule, r.violations, r.evaluated) for g in gates for r in g.rules], "rule string, violations long, evaluated long")


@query("SELECT * FROM (VALUES ('exact', CAST(0 AS BIGINT), CAST(1 AS BIGINT)), ('subset', 0, 1), ('other', 1, 1)) AS e(rule, violations, evaluated)")
def gate_schema(d):  # noqa: ANN001, ANN201
    x = d.table("part", "p_partkey", "p_name")
    other = Schema.of(("p_partkey", t.STRING))
    spec = q.ValidationSpec((q.schema(x.schema, name="exact"), q.schema(x.schema.select(["p_name"]), exact=False, name="subset"), q.schema(other, exact=False, name="other")), q.Policy.WARN_ONLY)
    return evidence(d, Runtime(d.spark).execute(d.plan(d.validate(x, spec)), d.bound).gates)


@query(f"SELECT 'present' AS rule, count(*) FILTER (WHERE o_orderkey IS NULL) AS violations, count(*) AS evaluated FROM orders UNION ALL SELECT 'n', count(*) FILTER (WHERE n IS NULL), count(*) FROM {ORDERS_N}")
def gate_fail_fast(d):  # noqa: ANN001, ANN201
    rules = (q.not_null("o_orderkey", name="present"), q.not_null("n", name="n"), q.range_("n", 0, 50, name="never reached"))
    x = d.validate(with_nulls(d), q.ValidationSpec(rules, q.Policy.FAIL_FAST))
    try:
        Runtime(d.spark).execute(d.plan(x), d.bound)
    except QualityGateError as e:
        return evidence(d, [e.result])
    raise AssertionError("the gate holds")


@query(f"SELECT o_orderkey, n FROM {ORDERS_N}")
def gate_ignore(d):  # noqa: ANN001, ANN201
    return d.run(d.select(d.validate(with_nulls(d), q.ValidationSpec((q.not_null("n"),), q.Policy.IGNORE)), ["o_orderkey", "n"]))


@query("SELECT 'rate_low' AS rule, count(*) FILTER (WHERE n IS NULL) AS violations, count(*) AS evaluated, FALSE AS passed FROM {0} UNION ALL SELECT 'rate_high', count(*) FILTER (WHERE n IS NULL), count(*), TRUE FROM {0}".format(ORDERS_N))
def gate_rates(d):  # noqa: ANN001, ANN201
    rules = (q.not_null("n", max_violations=None, max_violation_rate=0.1, name="rate_low"), q.not_null("n", max_violations=None, max_violation_rate=0.5, name="rate_high"))
    got = Runtime(d.spark).execute(d.plan(d.validate(with_nulls(d), q.ValidationSpec(rules, q.Policy.WARN_ONLY))), d.bound)
    return d.spark.createDataFrame([(r.rule, r.violations, r.evaluated, r.passed) for g in got.gates for r in g.rules], "rule string, violations long, evaluated long, passed boolean")


@query("SELECT event_id, value * 2 AS twice, upper(event_type) AS kind FROM events WHERE value > 10")
def stream_steps(d):  # noqa: ANN001, ANN201
    """The same steps over a stream of files, into files."""
    from . import streaming

    source, out = scratch(d, "in"), scratch(d, "out")
    load(d.spark, d.sf, "events").select("event_id", "event_type", "value").write.parquet(source)
    schema = Schema.of(("event_id", t.INT64), ("event_type", t.STRING), ("value", t.FLOAT64))
    b = PlanBuilder("stream")
    x = b.filter("some", b.input("events", schema), col("value") > 10.0)
    x = b.derive("kind", b.derive("twice", x, "twice", col("value") * 2.0), "kind", fn.upper(col("event_type")))
    b.output("out", b.select("columns", x, ["event_id", "twice", "kind"]))
    q_ = streaming.start(b.build(), {"events": streaming.read_stream(d.spark, source, schema)}, "out", "parquet", scratch(d, "checkpoint"), path=out)
    q_.processAllAvailable()
    q_.stop()
    return d.spark.read.parquet(out)


def per_customer(d):  # noqa: ANN001, ANN201
    x = d.filter(d.table("orders", "o_orderkey", "o_custkey", "o_orderstatus"), col("o_orderstatus") == "F")
    return d.derive(d.aggregate(x, ["o_custkey"], {"n": fn.count(), "most": fn.max_(col("o_orderkey"))}), "total", w.sum_(col("n")).over(w.WindowSpec()))


PER_CUSTOMER = "SELECT *, CAST(sum(n) OVER () AS BIGINT) AS total FROM (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS most FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)"


@query(PER_CUSTOMER)
def wire_plan(d):  # noqa: ANN001, ANN201
    """A plan as a document, read back, and then run."""
    from .wire import dumps, loads

    plan = d.plan(per_customer(d))
    again = loads(dumps(plan))
    if again.fingerprint != plan.fingerprint:
        raise AssertionError("a plan changed on the wire")
    return Runtime(d.spark).execute(again, d.bound).output()


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def yaml_schema(d):  # noqa: ANN001, ANN201
    """An input under a schema that went through its document."""
    from .schema_yaml import dumps_schema, loads_schema

    df = load(d.spark, d.sf, "supplier")
    schema = loads_schema(dumps_schema(Schema.from_spark(df.schema), "supplier"))
    b = PlanBuilder("yaml")
    b.output("out", b.filter("some", b.input("supplier", schema), col("s_acctbal") > 0.0))
    return Runtime(d.spark).execute(b.build(), {"supplier": df}).output()


@query("SELECT p_partkey, upper(trim(p_brand)) || '!' AS loud FROM part")
def plugin_function(d):  # noqa: ANN001, ANN201
    from .plugins import Extensions, FunctionExtension

    ext = Extensions()
    ext.add("function", "shout", FunctionExtension("shout", lambda e: fn.concat(fn.upper(fn.trim(e)), lit("!"))))
    return d.run(d.drop(d.derive(d.table("part", "p_partkey", "p_brand"), "loud", ext.freeze().function("shout")(col("p_brand"))), ["p_brand"]))


@query("SELECT c_custkey, lower(c_mktsegment) AS segment FROM customer WHERE c_acctbal >= 0")
def fluent_pipeline(d):  # noqa: ANN001, ANN201
    from .plans import Pipeline

    df = load(d.spark, d.sf, "customer")
    p = Pipeline("fluent", Schema.from_spark(df.schema)).filter(col("c_acctbal") >= 0.0).derive("segment", fn.lower(col("c_mktsegment"))).select(["c_custkey", "segment"])
    return p.run(d.spark, df)


@query("SELECT * FROM region")
def interchange(d):  # noqa: ANN001, ANN201
    """To Arrow and pandas, and back; a small table, as all of it passes the driver."""
    from .sources.interchange import Fidelity, from_arrow, from_pandas, to_arrow, to_pandas

    df = from_arrow(d.spark, to_arrow(load(d.spark, d.sf, "region")))
    frame, _ = to_pandas(df, Fidelity.ALLOW_POTENTIALLY_LOSSY)
    return from_pandas(d.spark, frame, Schema.from_spark(df.schema))


@query("""SELECT * FROM (VALUES ('aggregate_3', 'n'), ('aggregate_3', 'o_custkey'), ('aggregate_3', 'most'), ('derive_4', 'most'), ('derive_4', 'n'), ('derive_4', 'o_custkey'), ('derive_4', 'total'),
  ('filter_2', 'o_custkey'), ('filter_2', 'o_orderkey'), ('filter_2', 'o_orderstatus'), ('output:out0', 'most'), ('output:out0', 'n'), ('output:out0', 'o_custkey'), ('output:out0', 'total')) AS t(step, field)""")
def impact(d):  # noqa: ANN001, ANN201
    """All that changes if the status of orders does: rows are dropped by it, so every field after the filter."""
    got = analyse(d.plan(per_customer(d))).downstream("orders_1", "o_orderstatus")
    return d.spark.createDataFrame(sorted((r.step, r.field) for r in got), "step string, field string")


@query("SELECT * FROM (VALUES ('sort', FALSE), ('filter', TRUE), ('aggregate', FALSE)) AS t(step, streams)")
def stream_capabilities(d):  # noqa: ANN001, ANN201
    """Which steps a stream takes, by asking before any job."""
    from .errors import CapabilityError
    from .runtime.capabilities import check

    schema, out = Schema.of(("a", t.INT64)), []
    for step, args in (("sort", (["a"],)), ("filter", (col("a") > 0,)), ("aggregate", (["a"], {"n": fn.count()}))):
        b = PlanBuilder("stream")
        b.output("out", getattr(b, step)("step", b.input("in", schema), *args))
        try:
            check(compile_plan(b.build()), streaming=frozenset(["in"]))
            out.append((step, True))
        except CapabilityError:
            out.append((step, False))
    return d.spark.createDataFrame(out, "step string, streams boolean")
