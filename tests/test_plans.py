from dataclasses import replace

import pytest
from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from weftplan import Optimizer, PlanBuilder, Runtime, Schema, analyse, col, compile_plan, lit
from weftplan import functions as fn
from weftplan import types as t
from weftplan.errors import CapabilityError, PlanError
from weftplan.functions import window as w
from weftplan.functions.expr import Lit, Op, same
from weftplan.plans.lineage import Dependency, Derivation, FieldRef
from weftplan.plans.optimize import simplify
from weftplan.plans.plan import Node, Plan
from weftplan.runtime import capabilities

S = Schema.of(("id", t.INT64, False), ("status", t.STRING), ("amount", t.INT64))


def chain(extra=False):
    b = PlanBuilder("p")
    x = b.input("x", S)
    s = b.select("cols", b.sort("sorted", x, ["id"]), ["id", "status", "amount"])
    f = b.filter("only", s, (col("status") == "A") & (lit(1) < lit(2)))
    b.output("o", b.select("last", f, ["id"]))
    return b.build()


def test_validation():
    b = PlanBuilder("p")
    x = b.input("x", S)
    b.limit("unused", x, 1)
    b.output("o", x)
    with pytest.raises(PlanError):
        b.build()
    with pytest.raises(PlanError):
        b.input("x", S)
    other = PlanBuilder("q").input("y", S)
    with pytest.raises(PlanError):
        b.limit("l", other, 1)
    a, c = Node("a", "a", "step", S, ("c",), replace(chain().node("only").operator)), Node("c", "c", "step", S, ("a",), chain().node("only").operator)
    for nodes in ((), (a, c), (Node("i", "i", "input", S),), (Node("i", "i", "input", S), Node("i", "j", "output", S, ("i",))), (Node("i", "i", "input", S), Node("o", "o", "output", S, ("zz",)))):
        with pytest.raises(PlanError):
            Plan("p", nodes)


def test_fingerprints_ignore_ids():
    assert chain().fingerprint == chain().fingerprint == compile_plan(chain()).fingerprint
    b = PlanBuilder("p")
    b.output("o", b.limit("l", b.input("x", S), 1))
    assert b.build().fingerprint != chain().fingerprint


def test_optimizer_report(spark):
    report = Optimizer().optimize_with_report(chain())
    assert [n.name for n in report.plan.nodes][:2] == ["x", "only"]
    assert {a.rule for a in report.applied} == {"simplify", "push_filter", "narrow_select"} or {a.rule for a in report.applied} == {"simplify", "push_filter"}
    assert report.changed and any(d.code == "WEFT-OPT-HINT-001" for d in report.diagnostics)
    off = Optimizer(enabled=False).optimize_with_report(chain())
    assert not off.changed and off.diagnostics[0].code == "WEFT-OPT-000"
    df = spark.createDataFrame([(1, "A", 5), (2, "B", 6), (3, None, 7)], S.to_spark())
    go = lambda p: rows(Runtime(spark).execute(p, {"x": df}).output())
    assert go(chain()) == go(report.plan) == [(1,)]


numbers = st.one_of(st.integers(-50, 50), st.booleans(), st.none())
exprs = st.recursive(numbers.map(Lit) | st.sampled_from([col("p"), col("q")]), lambda x: st.one_of(st.tuples(st.sampled_from(["and", "or", "eq", "lt", "add", "mul", "div"]), x, x).map(lambda v: Op(v[0], v[1:])), st.tuples(st.sampled_from(["not", "neg", "is_null"]), x).map(lambda v: Op(v[0], v[1:]))), max_leaves=8)


def value(e, env):
    """Three-valued reference evaluation; raises where Spark would."""
    if isinstance(e, Lit):
        return e.value
    if not isinstance(e, Op):
        return env[e.path]
    a = [value(x, env) for x in e.args]
    if e.op == "is_null":
        return a[0] is None
    if e.op in ("and", "or"):
        stop = e.op == "or"
        return stop if stop in [x for x in a if isinstance(x, bool)] else None if None in a else not stop
    if None in a:
        return None
    return {"not": lambda x: not x, "neg": lambda x: -x, "eq": lambda x, y: x == y, "lt": lambda x, y: x < y, "add": lambda x, y: x + y, "mul": lambda x, y: x * y, "div": lambda x, y: x / y}[e.op](*a)


@settings(max_examples=300, deadline=None)
@given(exprs, st.sampled_from([True, False, None]), st.sampled_from([True, False, None]))
def test_simplification_keeps_every_value(e, p, q):
    boolean = lambda x: isinstance(x, Op) and x.op in ("and", "or", "not", "eq", "lt", "is_null") or isinstance(x, Lit) and (x.value is None or isinstance(x.value, bool)) or not isinstance(x, Op | Lit)
    number = lambda x: isinstance(x, Op) and x.op in ("add", "mul", "div", "neg") or isinstance(x, Lit) and (x.value is None or isinstance(x.value, int) and not isinstance(x.value, bool))
    ok = all(all(map(boolean if x.op in ("and", "or", "not") else number if x.op in ("add", "mul", "div", "neg", "lt", "eq") else lambda _: True, x.args)) for x in e.walk() if isinstance(x, Op))
    if not ok:
        return
    try:
        want = value(e, {"p": p, "q": q})
    except ArithmeticError:
        return
    got = value(simplify(e), {"p": p, "q": q})
    assert got == want and type(got) is type(want)


def test_simplification_leaves_errors_and_wide_numbers():
    for e in (lit(1) / 0, lit(2**62) * 4, lit("a") + 1):
        assert same(simplify(e), e)
    assert same(simplify(~~(col("p") == 1)), col("p") == 1)


def test_lineage():
    b = PlanBuilder("p")
    x, y = b.input("x", S), b.input("y", Schema.of(("id", t.INT64, False), ("amount", t.INT64)))
    f = b.filter("paid", x, col("status") == "PAID")
    g = b.aggregate("per", f, ["id"], {"total": fn.sum_(col("amount")), "n": fn.count()})
    j = b.join("both", g, y, "left", ["id"])
    d = b.derive("ranked", j, "r", w.rank().over(w.partition_by("id").order_by("total")))
    b.output("o", b.rename("named", d, {"total": "sum"}))
    got = analyse(b.build())
    kinds = {(e.source.step, e.source.field, e.target.step, e.target.field): e.kind for e in got.edges}
    assert kinds["paid", "amount", "per", "total"] == Derivation.AGGREGATED
    assert kinds["ranked", "total", "named", "sum"] == Derivation.RENAMED
    uses = {(u.source.step, u.source.field, u.step): u.kind for u in got.uses}
    assert uses["x", "status", "paid"] == Dependency.FILTER and uses["y", "id", "both"] == Dependency.JOIN and uses["both", "total", "ranked"] == Dependency.WINDOW_ORDERING
    up = got.upstream("output:o", "sum")
    assert FieldRef("x", "amount") in up and FieldRef("x", "status") in up
    assert FieldRef("x", "status") not in got.upstream("output:o", "sum", rows=False)
    assert FieldRef("output:o", "sum") in got.downstream("x", "amount", rows=False)
    assert got.datasets_upstream("output:o") >= {"x", "y", "paid"} and "output:o" in got.datasets_downstream("x")


def test_capabilities():
    b = PlanBuilder("p")
    x = b.input("x", S)
    b.output("o", b.derive("d", x, "r", w.sum_(col("id")).over(w.order_by("id").range_between(w.preceding(1), w.CURRENT_ROW))))
    plan = b.build()
    assert capabilities.required(plan)["d"] == {"derive", "window", "window_range"}
    capabilities.check(plan)
    with pytest.raises(CapabilityError):
        capabilities.check(plan, capabilities.SPARK - {"window_range"})
    b = PlanBuilder("p")
    b.output("o", b.input("x", Schema.of(("t", t.Timestamp("ns")))))
    with pytest.raises(CapabilityError):
        capabilities.check(b.build())
    assert set(capabilities.CONFORMANCE) == set(capabilities.Dimension)
