import pytest
from helpers import rows

from weftplan import PlanBuilder, Runtime, Schema, col
from weftplan import quality as q
from weftplan import types as t
from weftplan.errors import PlanError, QualityGateError, SchemaError
from weftplan.runtime import MemorySink


@pytest.fixture
def customers(spark):
    data = [(1, "a@x.io", "ACTIVE", 10.0), (2, None, "ACTIVE", float("nan")), (2, "bad\n", "OTHER", 150.0), (3, "c@x.io", "ACTIVE", None)]
    return spark.createDataFrame(data, "id long, email string, status string, score double")


def gate(spark, df, rules, policy):
    b = PlanBuilder("g")
    b.output("o", b.validate("gate", b.input("x", Schema.from_spark(df.schema)), q.ValidationSpec(tuple(rules), policy)))
    return Runtime(spark).execute(b.build(), {"x": df})


EIGHT = [q.not_null("score"), q.unique("id"), q.range_("score", 0, 100), q.allowed_values("status", ["ACTIVE"]), q.regex("email", r"[^@]+@x\.io"), q.row_count(1, 10), q.expression(col("score") < 100.0), q.schema(Schema.of(("id", t.INT64)), exact=False)]


def test_counts_under_warn_only(spark, customers):
    got = gate(spark, customers, EIGHT, q.Policy.WARN_ONLY)
    assert [(r.violations, r.evaluated) for r in got.gates[0].rules] == [(2, 4), (1, 4), (1, 4), (1, 4), (1, 4), (0, 1), (3, 4), (0, 1)]
    assert [r.passed for r in got.gates[0].rules] == [False] * 5 + [True, False, True]
    assert got.output().count() == 4 and len(got.manifest.diagnostics) == 6
    got.close()


def test_policies(spark, customers):
    with pytest.raises(QualityGateError) as e:
        gate(spark, customers, EIGHT, q.Policy.FAIL_FAST)
    assert len(e.value.result.rules) == 1 and e.value.manifest.failure.category == "contract_violation"
    with pytest.raises(QualityGateError) as e:
        gate(spark, customers, EIGHT, q.Policy.FAIL_AT_END)
    assert len(e.value.result.rules) == 8
    got = gate(spark, customers, EIGHT, q.Policy.IGNORE).gates[0]
    assert got.ignored and got.rules == () and got.passed
    assert gate(spark, customers.limit(0), EIGHT[:5], q.Policy.FAIL_FAST).gates[0].passed


def test_thresholds_and_null_keys(spark, customers):
    got = gate(spark, customers, [q.not_null("score", max_violations=2), q.not_null("score", max_violations=None, max_violation_rate=0.4), q.unique("email", "status"), q.range_("score", max=150.0, include_max=False), q.row_count(max=3)], q.Policy.WARN_ONLY)
    assert [r.passed for r in got.gates[0].rules] == [True, False, True, False, False]
    dup = spark.createDataFrame([(None, 1), (None, 1), (None, 2)], "a long, b long")
    assert gate(spark, dup, [q.unique("a", "b")], q.Policy.WARN_ONLY).gates[0].rules[0].violations == 1


def test_static_checks(spark, customers):
    for bad in (q.not_null("zz"), q.regex("id", "x"), q.expression(col("id"))):
        with pytest.raises(SchemaError):
            gate(spark, customers, [bad], q.Policy.IGNORE)
    for bad in (lambda: q.regex("email", "("), lambda: q.range_("score"), lambda: q.allowed_values("id", []), lambda: q.row_count(), lambda: q.row_count(3, 2), lambda: q.unique(), lambda: q.ValidationSpec(()), lambda: q.Threshold(-1)):
        with pytest.raises(PlanError):
            bad()


def test_row_rules_share_one_job(spark, customers):
    sink = MemorySink()
    b = PlanBuilder("g")
    b.output("o", b.validate("gate", b.input("x", Schema.from_spark(customers.schema)), q.ValidationSpec((EIGHT[0], EIGHT[2], EIGHT[3], EIGHT[6]), q.Policy.WARN_ONLY)))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    Runtime(spark, [sink]).execute(b.build(), {"x": customers}).close()
    assert sink.names("span") == ["weftplan.gate"]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - before <= 3
    assert rows(customers.select("id")) == [(1,), (2,), (2,), (3,)]
