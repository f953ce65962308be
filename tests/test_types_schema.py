from decimal import Decimal as D

import pytest
from pyspark.sql import types as S

from weftplan import Field, Schema
from weftplan import types as t
from weftplan.errors import CapabilityError, SchemaError

ALL = [*t.PRIMITIVES.values(), t.Decimal(38, 9), t.Time("ns"), t.Timestamp("us", "UTC"), t.Timestamp("ns"), t.Duration("s"), t.List(t.Struct((t.Member("a", t.INT64, False), t.Member("m", t.Map(t.STRING, t.List(t.STRING, False), False)))), False)]


@pytest.mark.parametrize("kind", ALL, ids=str)
def test_encode_round_trip(kind):
    assert t.decode(t.encode(kind)) == kind


@pytest.mark.parametrize("kind", [k for k in ALL if "ns" not in str(k)], ids=str)
def test_spark_round_trip_through_metadata(kind):
    s = Schema.of(("x", kind)).to_spark()
    assert Schema.from_spark(s).field("x").type == kind


@pytest.mark.parametrize(("kind", "spark"), [(t.UINT8, S.ShortType()), (t.UINT16, S.IntegerType()), (t.UINT32, S.LongType()), (t.UINT64, S.DecimalType(20, 0)), (t.Timestamp(), S.TimestampNTZType()), (t.Timestamp("us", "UTC"), S.TimestampType()), (t.Duration(), S.DayTimeIntervalType(0, 3))])
def test_wider_and_zoned_types(kind, spark):
    assert t.to_spark(kind) == spark


def test_what_spark_cannot_hold():
    for kind in (t.Timestamp("ns"), t.Time("ns"), t.Duration("ns"), t.Decimal(39, 0)):
        with pytest.raises(CapabilityError):
            t.to_spark(kind)


@pytest.mark.parametrize("bad", [lambda: t.Integer(7), lambda: t.Decimal(2, 3), lambda: t.Timestamp("m"), lambda: t.Struct(()), lambda: t.decode("text"), lambda: t.decode({"decimal": {"precision": 2, "x": 1}}), lambda: t.decode({"list": {"element": "string"}})])
def test_bad_types(bad):
    with pytest.raises(SchemaError):
        bad()


@pytest.mark.parametrize(("text", "p", "s"), [("1.50", 3, 2), ("0.001", 3, 3), ("100", 3, 0), ("1E+2", 3, 0), ("-2.5", 2, 1)])
def test_decimal_of_a_literal(text, p, s):
    assert t.decimal_of(D(text)) == t.Decimal(p, s)


SCHEMA = Schema.of(("a", t.INT64, False), ("b", t.STRING), ("s", t.Struct((t.Member("x", t.FLOAT64, False), t.Member("y", t.Struct((t.Member("z", t.DATE),)), False)))))


def test_schema_algebra():
    assert SCHEMA.select(["b", "a"]).names == ("b", "a")
    assert SCHEMA.drop(["a"]).names == ("b", "s")
    assert SCHEMA.rename({"a": "b", "b": "a"}).names == ("b", "a", "s")
    assert SCHEMA.replace(Field("b", t.INT8)).names == ("a", "b", "s")
    for bad in (lambda: SCHEMA.select(["A"]), lambda: SCHEMA.drop(["q"]), lambda: SCHEMA.rename({"a": "b"}), lambda: SCHEMA.append(Field("a", t.DATE)), lambda: Field(" ", t.DATE)):
        with pytest.raises(SchemaError):
            bad()


def test_paths_are_nullable_if_any_level_is():
    assert SCHEMA.resolve("s.x") == (t.FLOAT64, True)
    assert SCHEMA.resolve("s.y.z") == (t.DATE, True)
    assert SCHEMA.resolve("a") == (t.INT64, False)
    for bad in ("a.b", "s.q", "q"):
        with pytest.raises(SchemaError):
            SCHEMA.resolve(bad)
