from datetime import date, datetime, timezone
from decimal import Decimal as D

import pytest

from weftplan import Schema, col, lit
from weftplan import functions as fn
from weftplan import types as t
from weftplan.errors import FunctionNotFoundError, SchemaError, TypingError
from weftplan.functions import window as w
from weftplan.functions.expr import Call, same
from weftplan.functions.typing import typed

S = Schema.of(("i8", t.INT8, False), ("i32", t.INT32), ("i64", t.INT64, False), ("u16", t.UINT16, False), ("f32", t.FLOAT32, False), ("f64", t.FLOAT64), ("d", t.Decimal(10, 2)), ("s", t.STRING), ("n", t.STRING, False), ("b", t.BOOLEAN, False), ("day", t.DATE), ("ts", t.Timestamp()), ("tz", t.Timestamp("us", "UTC"), False), ("clock", t.Time()))
C = {f.name: col(f.name) for f in S}

GOOD = [
    (C["i64"] == "x", t.BOOLEAN, False), (C["i32"] < C["i64"], t.BOOLEAN, True), (C["s"].is_null(), t.BOOLEAN, False),
    (C["b"] & (C["i32"] > 1), t.BOOLEAN, True), (~C["b"], t.BOOLEAN, False), (-C["i32"], t.INT32, True), (-C["d"], t.Decimal(10, 2), True),
    (C["i8"] + C["i32"], t.INT32, True), (C["i8"] + C["u16"], t.INT16, False), (C["u16"] * C["u16"], t.UINT16, False), (C["i8"] / C["i8"], t.FLOAT64, False),
    (C["f32"] + C["i8"], t.FLOAT64, False), (C["f32"] * C["f32"], t.FLOAT32, False), (C["i32"] - 1, t.INT64, True),
    (fn.lower(C["s"]), t.STRING, True), (fn.concat(C["n"], "x"), t.STRING, False), (fn.year(C["day"]), t.INT32, True), (fn.hour(C["clock"]), t.INT32, True),
    (fn.to_date(C["tz"]), t.DATE, False), (fn.normalize_timestamp(C["ts"], "Europe/Paris", "ms"), t.Timestamp("ms", "Europe/Paris"), True),
    (fn.convert_timezone(C["tz"], "Asia/Tokyo"), t.Timestamp("us", "Asia/Tokyo"), False), (fn.duration_between(C["ts"], C["ts"], "s"), t.Duration("s"), True),
    (lit(None), t.UNKNOWN, True), (lit(1), t.INT64, False), (lit(True), t.BOOLEAN, False), (lit(D("1.25")), t.Decimal(3, 2), False), (lit(date(2020, 1, 1)), t.DATE, False),
    (lit(datetime(2020, 1, 1)), t.Timestamp(), False), (lit(datetime(2020, 1, 1, tzinfo=timezone.utc)), t.Timestamp("us", "UTC"), False), (lit(1, t.INT8), t.INT8, False),
]


@pytest.mark.parametrize(("e", "kind", "nullable"), GOOD)
def test_static_types(e, kind, nullable):
    assert typed(e, S) == (kind, nullable)


BAD = [C["d"] + 1, C["s"] + C["s"], C["s"] & C["b"], ~C["i8"], -C["s"], fn.lower(C["i8"]), fn.hour(C["day"]), fn.year(C["clock"]), fn.convert_timezone(C["ts"], "UTC"), fn.normalize_timestamp(C["ts"], " "), fn.duration_between(C["ts"], C["tz"]), fn.duration_between(C["ts"], C["ts"], "h"), Call("lower", ()), fn.count(), lit(object())]


@pytest.mark.parametrize("e", BAD)
def test_type_errors(e):
    with pytest.raises(TypingError):
        typed(e, S)


def test_unknown_names():
    with pytest.raises(FunctionNotFoundError):
        typed(Call("soundex", (C["s"],)), S)
    with pytest.raises(SchemaError):
        typed(col("zz"), S)


@pytest.mark.parametrize(("e", "kind", "nullable"), [(fn.count(), t.INT64, False), (fn.count_distinct(C["s"]), t.INT64, False), (fn.sum_(C["i8"]), t.INT64, True), (fn.sum_(C["u16"]), t.UINT64, True), (fn.sum_(C["f32"]), t.FLOAT32, True), (fn.sum_(C["d"]), t.Decimal(10, 2), True), (fn.min_(C["s"]), t.STRING, True), (fn.mean(C["d"]), t.FLOAT64, True)])
def test_aggregate_types(e, kind, nullable):
    assert typed(e, S, aggregates=True) == (kind, nullable)


BY = w.partition_by("s").order_by("i64")


@pytest.mark.parametrize(("e", "kind", "nullable"), [(w.row_number().over(BY), t.INT64, False), (w.lag(C["i64"]).over(BY), t.INT64, True), (w.lag(C["i64"], 1, 0).over(BY), t.INT64, False), (w.lead(C["i64"], 1, lit(None)).over(BY), t.INT64, True), (w.sum_(C["i8"]).over(BY), t.INT64, True)])
def test_window_types(e, kind, nullable):
    assert typed(e, S, window=True) == (kind, nullable)


def test_window_rules():
    for bad in (lambda: w.rank().over(w.partition_by("s")), lambda: w.rank().over(BY.rows_between(w.preceding(1), w.CURRENT_ROW)), lambda: w.sum_(C["i8"]).over(w.partition_by("s").rows_between(w.preceding(1), w.CURRENT_ROW)), lambda: w.lag(C["i8"], 0), lambda: w.preceding(-1), lambda: BY.rows_between(w.following(2), w.following(1)), lambda: BY.rows_between(w.UNBOUNDED_FOLLOWING, w.UNBOUNDED_FOLLOWING)):
        with pytest.raises(TypingError):
            bad()
    for e in (w.lag(C["i64"], 1, "x").over(BY), w.sum_(C["i8"]).over(w.order_by("s").range_between(w.preceding(1), w.CURRENT_ROW)), w.sum_(C["i8"]).over(w.order_by("i64", "i8").range_between(w.preceding(1), w.CURRENT_ROW))):
        with pytest.raises(TypingError):
            typed(e, S, window=True)
    with pytest.raises(TypingError):
        typed(w.rank().over(BY) + 1, S, window=True)
    kinds = [(w.UNBOUNDED_PRECEDING, w.CURRENT_ROW, "cumulative"), (w.preceding(3), w.CURRENT_ROW, "moving"), (w.preceding(3), w.following(1), "arbitrary"), (w.UNBOUNDED_PRECEDING, w.UNBOUNDED_FOLLOWING, "arbitrary")]
    assert [BY.rows_between(a, b).frame.kind for a, b, _ in kinds] == [k for *_, k in kinds]


def test_truth_equality_and_fingerprints():
    with pytest.raises(TypingError):
        bool(C["i8"] == 1)
    assert same(C["i8"] + 1, col("i8") + 1) and not same(C["i8"] + 1, C["i8"] + 1.0)
    assert (C["i8"] + 1).fingerprint == (col("i8") + 1).fingerprint != (C["i8"] + lit(1, t.INT8)).fingerprint
    assert (C["i8"] + C["i64"] * C["i8"]).columns() == ("i8", "i64")
