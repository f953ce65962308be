"""The published profile: each claimed dimension names tests that exist, and the two dimensions without a module of their own."""

import re
from pathlib import Path

import pytest
from helpers import rows

from weftplan import col, lit
from weftplan import functions as fn
from weftplan import quality as q
from weftplan.runtime.capabilities import CONFORMANCE, EVIDENCE, Dimension

HERE = Path(__file__).resolve().parent


@pytest.mark.parametrize("dimension", Dimension)
def test_claims_have_tests(dimension):
    assert CONFORMANCE[dimension] == ("qualified" if EVIDENCE.get(dimension) else "unclaimed")
    for name in EVIDENCE.get(dimension, ()):
        file, _, test = name.partition("::")
        assert re.search(rf"^def {test}\(", (HERE / file).read_text(), re.M), name


def test_unicode(spark, run):
    names = ["Zoë", "ZOË", "straße", "", "日本", "e\u0301", "é", "😀 x"]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    out = run(lambda b, x: b.derive("u", b.derive("l", x, "low", fn.lower(col("name"))), "both", fn.concat(col("name"), lit("·"))), t=df)
    assert rows(out) == sorted([(i, n, n.lower(), n + "·") for i, n in enumerate(names)], key=repr)
    assert sorted(r.name for r in run(lambda b, x: b.distinct("d", b.select("s", x, ["name"])), t=df).collect()) == sorted(names)  # no normalisation
    assert [r.id for r in run(lambda b, x: b.filter("f", x, col("name") == "é"), t=df).collect()] == [6]


def test_empty_data(spark, run):
    df = spark.createDataFrame([], "k long, v double, s string, l array<long>")
    for build in (
        lambda b, x: b.filter("a", x, col("k") > 1), lambda b, x: b.sort("a", x, ["k"]), lambda b, x: b.limit("a", x, 3), lambda b, x: b.distinct("a", b.drop("d", x, ["l"])),
        lambda b, x: b.deduplicate("a", x, ["k"]), lambda b, x: b.aggregate("a", x, ["k"], {"n": fn.count()}), lambda b, x: b.explode("a", x, "l"), lambda b, x: b.unpivot("a", b.select("s", x, ["s", "k"]), ["s"], ["k"]),
        lambda b, x: b.pivot("a", x, ["k"], "s", "v", ["p"], "sum"), lambda b, x: b.join("a", x, b.rename("r", x, {"v": "w", "s": "t", "l": "m"}), "full", ["k"]),
        lambda b, x: b.validate("a", x, q.ValidationSpec((q.not_null("k"), q.unique("k")))),
    ):
        assert run(build, t=df).collect() == []
    (one,) = run(lambda b, x: b.aggregate("a", x, (), {"n": fn.count(), "s": fn.sum_(col("v")), "m": fn.mean(col("k"))}), t=df).collect()
    assert tuple(one) == (0, None, None)
