import json
from datetime import date, datetime, timezone
from decimal import Decimal as D

import pytest

from weftplan import Field, PlanBuilder, Resource, Schema, analyse, cli, col, compile_plan, lit, schema_yaml, wire
from weftplan import functions as fn
from weftplan import quality as q
from weftplan import types as t
from weftplan.errors import DeclarationError, ExtensionError, WireError
from weftplan.functions import window as w
from weftplan.functions.expr import describe
from weftplan.plugins import Extensions, FunctionExtension, Plugin, Plugins
from weftplan.runtime.evidence import Diagnostic, ExecutionStatus, Failure, FailureCategory, Manifest

S = Schema.of(("id", t.INT64, False), ("s", t.STRING), ("v", t.FLOAT64), ("tags", t.List(t.STRING)), ("p", t.Struct((t.Member("a", t.INT64),))))


def everything():
    b = PlanBuilder("all")
    x = b.input("x", S, order_key=["id"])
    y = b.flatten("flat", b.explode("exp", x, "tags"), "p")
    y = b.cast("cast", b.derive("der", y, "k", w.lag(col("v"), 2, 0.5).over(w.partition_by("s").order_by(w.desc("id")))), "id", t.Decimal(20, 0), "null")
    y = b.derive("sum", y, "m", w.sum_(col("v")).over(w.order_by("v").range_between(w.preceding(1), w.CURRENT_ROW)))
    y = b.validate("gate", y, q.ValidationSpec((q.not_null("id"), q.unique("id", "s"), q.range_("v", D("0.5"), 9), q.allowed_values("s", ["a", None]), q.regex("s", "a+"), q.row_count(1), q.expression(col("v") > 1.0, "pos"), q.schema(S, False)), q.Policy.WARN_ONLY))
    y = b.deduplicate("dd", b.sort("srt", b.filter("fil", y, (col("s") == "é") & ~col("v").is_null()), ["id"]), ["s"])
    a = b.aggregate("agg", b.limit("lim", b.distinct("dis", b.drop("drp", b.rename("ren", y, {"k": "kk"}), ["kk"])), 5), ["s", fn.lower(col("s"))], {"n": fn.count(), "t": fn.sum_(col("v"))})
    pv = b.pivot("piv", x, ["id"], "s", "v", ["a"], "count")
    j = b.join("join", b.select("sel", x, ["id"]), pv, "full", ["id"])
    b.output("o1", a)
    b.output("o2", b.unpivot("unp", b.union("uni", j, b.except_("exc", j, b.intersect("int", j, j)), all=True), ["id"], ["a"]))
    return b.build()


MANIFEST = Manifest("e", None, "p", "f", "spark", "lazy", ExecutionStatus.FAILED, datetime(2024, 1, 1, tzinfo=timezone.utc), None, (("x", "native"),), (), (Diagnostic("warning", "W", "m"),), Failure(FailureCategory.TIMEOUT, "retryable", "m"))
EXPRESSIONS = [lit(None), lit(1.5), lit(2**70), lit(D("1.20")), lit(date(2020, 1, 2)), lit(datetime(2020, 1, 2, tzinfo=timezone.utc)), lit(b"\x00", t.BINARY), lit("é́"), (col("a.b") + 1) / 2 >= lit(1, t.INT8), fn.count(), fn.normalize_timestamp(col("x"), "Europe/Paris")]


@pytest.mark.parametrize("value", [t.Decimal(5, 2), Field("a", t.STRING, False, "d"), S, everything(), compile_plan(everything()), analyse(everything()), MANIFEST, Diagnostic("info", "C", "m", "s"), Resource("x.csv", "text/csv", {"a": 1}), wire.ExecutionReference("e", "c")], ids=lambda v: type(v).__name__)
def test_round_trip_is_canonical(value):
    data = wire.dumps(value)
    back = wire.loads(data)
    assert type(back) is type(value) and wire.dumps(back) == data


@pytest.mark.parametrize("e", EXPRESSIONS, ids=range(len(EXPRESSIONS)))
def test_expressions(e):
    assert wire.dumps(wire.loads(wire.dumps(e))) == wire.dumps(e)


def test_plans_keep_their_fingerprint():
    p = everything()
    assert wire.loads(wire.dumps(p)).fingerprint == p.fingerprint
    assert wire.dumps(lit(1) + 2) == b'{"contract":"weftplan.expression","contract_version":1,"payload":{"args":[{"lit":{"int":"1"}},{"lit":{"int":"2"}}],"op":"add"}}'


E = {"contract": "weftplan.data_type", "contract_version": 1, "payload": "int64"}
BAD = ["{", "[]", "\"x\"", json.dumps(E | {"contract": "weftplan.zz"}), json.dumps(E | {"contract_version": 2}), json.dumps(E | {"contract_version": True}), json.dumps(E | {"payload": "int65"}), json.dumps(E | {"payload": float("nan")}), json.dumps(E | {"extra": 1}), '{"contract":"weftplan.data_type","contract":"x","contract_version":1,"payload":"int64"}', "[" * 70 + "]" * 70, b"\xff", " " * (1 << 20) + "1", json.dumps({"contract": "weftplan.plan", "contract_version": 1, "payload": {"name": "p", "nodes": [{"name": "o", "kind": "output", "inputs": [4], "schema": []}]}}), json.dumps({"contract": "weftplan.expression", "contract_version": 1, "payload": {"call_python": "x"}})]


@pytest.mark.parametrize("data", BAD, ids=range(len(BAD)))
def test_bad_documents(data):
    with pytest.raises(WireError):
        wire.loads(data)


def test_what_cannot_be_written():
    for bad in (object(), Manifest("e", None, "p", "f", "spark", "lazy", ExecutionStatus.FAILED, datetime(2024, 1, 1), None, (), ())):
        with pytest.raises(WireError):
            wire.dumps(bad)
    with pytest.raises(ExtensionError):
        wire.migration("weftplan.schema", 1, lambda x: x)
    with pytest.raises(WireError):
        wire.loads(wire.dumps(S), contract="weftplan.field")


ONE = """version: 1
schema:
  name: nested
  fields:
    - name: profiles
      type:
        list:
          element:
            type:
              struct:
                fields:
                  - name: customer_id
                    type: int64
                    nullable: false
          element_nullable: false
      nullable: false
    - {name: at, type: {timestamp: {unit: us, timezone: UTC}}, description: when}
"""


def test_yaml():
    pytest.importorskip("yaml")
    s = schema_yaml.loads_schema(ONE)
    assert s.field("at").type == t.Timestamp("us", "UTC") and not s.field("profiles").nullable
    assert schema_yaml.loads_schema(schema_yaml.dumps_schema(s, "nested")) == s
    many = schema_yaml.dumps_schemas({"a": s, "b": S})
    assert schema_yaml.loads_schemas(many) == {"a": s, "b": S} and schema_yaml.loads_schema(many, "b") == S
    with pytest.raises(DeclarationError):
        schema_yaml.loads_schema(many)


@pytest.mark.parametrize("text", ["x", "version: 2\nschema: {}", "version: 1", "version: 1\nschema: {name: a, fields: []}", "version: 1\nschema: {name: a, fields: [{name: x}]}", "version: 1\nschema: {name: a, fields: [{name: x, type: int64, z: 1}]}", "version: 1\nschema: {name: a, fields: [{name: x, type: int64}, {name: x, type: date}]}", "version: 1\nversion: 1\nschemas: {}", "version: 1\nschema: &a {name: a, fields: [{name: x, type: int64}]}", "version: 1\nschema: !!python/object:x {}", "a: *b", "version: 1\nschemas: {a: {fields: [{name: x, type: {decimal: {precision: 1, scale: 2}}}]}}", "version: 1\n---\nversion: 1", "[" * 80])
def test_bad_yaml(text):
    pytest.importorskip("yaml")
    with pytest.raises(DeclarationError):
        schema_yaml.loads_schemas(text)


def test_cli(tmp_path, capsys):
    pytest.importorskip("yaml")
    f = tmp_path / "s.yml"
    f.write_text(ONE)
    assert cli.main(["version"]) == 0 and cli.main(["--json", "doctor"]) == 0
    assert cli.main(["schema", "validate", str(f)]) == 0 and cli.main(["schema", "inspect", str(f)]) == 0
    assert cli.main(["schema", "format", str(f), "--check"]) == 1
    capsys.readouterr()
    assert cli.main(["schema", "format", str(f)]) == 0
    f.write_text(capsys.readouterr().out)
    assert cli.main(["schema", "format", str(f), "--check"]) == 0
    for to in ("spark", "ddl", "arrow"):
        assert cli.main(["schema", "convert", str(f), "--to", to]) == 0
    assert cli.main(["engines", "inspect", "spark"]) == 0 and cli.main(["engines", "list"]) == 0 and cli.main(["contract", "inspect"]) == 0
    assert cli.main(["engines", "inspect", "zz"]) == 13 and cli.main(["nope"]) == 2 and cli.main(["schema", "validate", str(tmp_path / "no.yml")]) == 12
    f.write_text("version: 3")
    assert cli.main(["schema", "validate", str(f)]) == 10


class Point:
    def __init__(self, name, plugin):
        self.name, self._plugin, self.loads = name, plugin, 0

    def load(self):
        self.loads += 1
        if isinstance(self._plugin, Exception):
            raise self._plugin
        return self._plugin


def test_plugins():
    def register(x: Extensions):
        x.add("function", "shout", FunctionExtension("shout", lambda e: fn.upper(fn.trim(e))))

    good = Point("good", Plugin("good", "1", ((1, 0), (2, 0)), register))
    p = Plugins(found=[good, Point("old", Plugin("old", "1", ((0, 1), (1, 0)), register)), Point("broken", ImportError("x"))])
    assert p.available == ("broken", "good", "old") and good.loads == 0
    p.activate("good")
    assert describe(p.extensions.function("shout")(col("s")))["call"] == "upper" and p.active == ("good",)
    for bad in ("good", "old", "broken", "none"):
        with pytest.raises(ExtensionError):
            p.activate(bad)
    with pytest.raises(ExtensionError):
        p.extensions.freeze().add("rule", "x", None)
    with pytest.raises(ExtensionError):
        FunctionExtension("f", lambda: 1)()
