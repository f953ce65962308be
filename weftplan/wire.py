"""Portable documents: an envelope with contract, version and payload, in canonical JSON, under strict limits."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields
from datetime import date, datetime
from decimal import Decimal as PyDecimal
from typing import Any

from . import types as t
from .errors import ExtensionError, WeftError, WireError
from .functions.expr import Agg, Call, Col, Expr, Lit, Op, describe
from .functions.window import Bound, Frame, Key, Over, WindowSpec
from .operators import OPERATORS, Aggregate, Cast, Derive, Filter, Join, QualityGate, Rename, Sort, SortKey
from .operators.base import Operator
from .operators.relational import JoinKind, NullMatch
from .operators.rows import CastPolicy, Deduplicate, Keep
from .plans.compile import LogicalPlan
from .plans.lineage import Dependency, Derivation, Edge, FieldRef, Lineage, Use
from .plans.plan import Node, Plan
from .quality import rules as q
from .runtime.evidence import Diagnostic, ExecutionStatus, Failure, FailureCategory, Manifest
from .schema import Field, Schema
from .sources.files import Resource

MAX_BYTES, MAX_DEPTH = 1 << 20, 64


def expr_from(x: dict) -> Expr:
    """The inverse of :func:`describe`."""
    match x:
        case {"col": str(p)}:
            return Col(p)
        case {"lit": v}:
            return Lit(_value(v), t.decode(x["type"]) if "type" in x else None)
        case {"op": o, "args": a}:
            return Op(o, tuple(map(expr_from, a)))
        case {"call": n, "args": a}:
            return Call(n, tuple(map(expr_from, a)))
        case {"agg": n, "args": a}:
            return Agg(n, expr_from(a[0]) if a else None)
        case {"over": n, "args": a, "window": w}:
            frame = None
            if "frame" in w:
                unit, u1, o1, u2, o2 = w["frame"]
                frame = Frame(unit, Bound(o1, u1), Bound(o2, u2))
            spec = WindowSpec(tuple(w["partition"]), tuple(Key(*k) for k in w["order"]), frame)
            return Over(n, tuple(map(expr_from, a)), spec, x.get("offset", 1), expr_from(x["default"]) if "default" in x else None)
    raise WireError("unknown expression")


def _value(v: Any) -> Any:
    match v:
        case None | bool() | str():
            return v
        case {"int": s}:
            return int(s)
        case {"float": s}:
            return float.fromhex(s)
        case {"decimal": s}:
            return PyDecimal(s)
        case {"datetime": s, "timezone": zone}:
            out = datetime.fromisoformat(s)
            if zone and "/" in zone:
                from zoneinfo import ZoneInfo

                out = out.astimezone(ZoneInfo(zone))
            return out
        case {"date": s}:
            return date.fromisoformat(s)
        case {"bytes": s}:
            return bytes.fromhex(s)
    raise WireError("unknown literal")


def rule_from(x: dict) -> q.Rule:
    limits: dict[str, Any] = {"threshold": q.Threshold(*x["threshold"]), "name": x.get("name")}
    f = x["fields"]
    plain = lambda d: expr_from(d).value  # type: ignore[attr-defined]
    match x["rule"]:
        case "notnull":
            return q.NotNull(f[0], **limits)
        case "unique":
            return q.Unique(tuple(f), **limits)
        case "range":
            return q.Range(f[0], plain(x["min"]), plain(x["max"]), *x["include"], **limits)
        case "allowedvalues":
            return q.AllowedValues(f[0], tuple(map(plain, x["values"])), **limits)
        case "regex":
            return q.Regex(f[0], x["pattern"], **limits)
        case "schemais":
            return q.SchemaIs(Schema.decode(x["expected"]), x["exact"], **limits)
        case "rowcount":
            return q.RowCount(x["min"], x["max"], **limits)
        case "condition":
            return q.Condition(expr_from(x["condition"]), **limits)
    raise WireError(f"unknown rule {x['rule']!r}")


def operator_from(x: dict) -> Operator:
    body = {k: v for k, v in x.items() if k != "id"}
    cls = OPERATORS.get(x["id"])
    if cls is None:
        raise WireError(f"unknown operator {x['id']!r}")
    pairs = lambda rows: tuple(tuple(r) for r in rows)
    if cls is Rename:
        return Rename(pairs(body["mapping"]))
    if cls is Filter:
        return Filter(expr_from(body["where"]))
    if cls is Cast:
        return Cast(body["field"], t.decode(body["target"]), CastPolicy(body["policy"]))
    if cls is Derive:
        return Derive(body["field"], expr_from(body["expression"]), body["replace_existing"])
    if cls is Sort:
        return Sort(tuple(SortKey(*k) for k in body["keys"]))
    if cls is Deduplicate:
        return Deduplicate(tuple(body["keys"]), Keep(body["keep"]))
    if cls is Aggregate:
        return Aggregate(tuple(map(expr_from, body["group_by"])), tuple((n, expr_from(m)) for n, m in body["metrics"]))  # type: ignore[misc]
    if cls is Join:
        return Join(JoinKind(body["kind"]), pairs(body["on"]), NullMatch(body["nulls"]), body["right_suffix"])
    if cls is QualityGate:
        return QualityGate(q.ValidationSpec(tuple(map(rule_from, body["rules"])), q.Policy(body["policy"])))
    known = {f.name for f in fields(cls)}
    if set(body) != known:
        raise WireError(f"{x['id']} has settings {', '.join(sorted(known)) or 'none'}")
    return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in body.items()})


def _nodes(plan: Plan | LogicalPlan) -> dict:
    place = {n.id: i for i, n in enumerate(plan.nodes)}
    return {"name": plan.name, "nodes": [{"name": n.name, "kind": n.kind, "inputs": [place[i] for i in n.inputs], "schema": n.schema.encode()} | ({"operator": {"id": n.operator.id} | n.operator.describe()} if n.operator else {}) | ({"order_key": list(n.order_key)} if n.order_key else {}) for n in plan.nodes]}


def _nodes_from(x: dict) -> tuple[Node, ...]:
    count = len(x["nodes"])
    for n in x["nodes"]:
        if any(not isinstance(i, int) or not 0 <= i < count for i in n["inputs"]):
            raise WireError("a step reads one that is not there")
    return tuple(Node(f"n{i}", n["name"], n["kind"], Schema.decode(n["schema"]), tuple(f"n{k}" for k in n["inputs"]), operator_from(n["operator"]) if "operator" in n else None, tuple(n.get("order_key", ()))) for i, n in enumerate(x["nodes"]))


def _moment(x: datetime) -> str:
    if x.tzinfo is None:
        raise WireError("a moment needs a time zone")
    return x.isoformat()


def _manifest(m: Manifest) -> dict:
    return asdict(m) | {"status": str(m.status), "started": _moment(m.started), "ended": None if m.ended is None else _moment(m.ended), "failure": None if m.failure is None else asdict(m.failure) | {"category": str(m.failure.category)}}


def _manifest_from(x: dict) -> Manifest:
    def moment(s: str) -> datetime:
        out = datetime.fromisoformat(s)
        _moment(out)
        return out

    pairs = lambda rows: tuple(tuple(r) for r in rows)
    return Manifest(**x | {"status": ExecutionStatus(x["status"]), "started": moment(x["started"]), "ended": None if x["ended"] is None else moment(x["ended"]), "inputs": pairs(x["inputs"]), "outputs": pairs(x["outputs"]), "diagnostics": tuple(Diagnostic(**d) for d in x["diagnostics"]), "failure": None if x["failure"] is None else Failure(FailureCategory(x["failure"]["category"]), x["failure"]["retryable"], x["failure"]["message"]), "retries": tuple(x["retries"])})


def _lineage(x: Lineage) -> dict:
    ref = lambda r: [r.step, r.field]
    return {"plan": x.plan, "edges": [[*ref(e.source), *ref(e.target), str(e.kind)] for e in x.edges], "uses": [[*ref(u.source), u.step, str(u.kind)] for u in x.uses], "datasets": [list(d) for d in x.datasets], "resources": [list(r) for r in x.resources]}


def _lineage_from(x: dict) -> Lineage:
    return Lineage(x["plan"], tuple(Edge(FieldRef(a, b), FieldRef(c, d), Derivation(k)) for a, b, c, d, k in x["edges"]), tuple(Use(FieldRef(a, b), s, Dependency(k)) for a, b, s, k in x["uses"]), tuple(tuple(d) for d in x["datasets"]), tuple(tuple(r) for r in x["resources"]))


@dataclass(frozen=True)
class ExecutionReference:
    execution: str
    correlation: str | None = None


@dataclass(frozen=True)
class Contract:
    name: str
    type: type
    encode: Callable[[Any], Any]
    decode: Callable[[Any], Any]
    version: int = 1


def _field(f: Field) -> dict:
    return Schema((f,)).encode()[0]


CONTRACTS: dict[str, Contract] = {
    c.name: c
    for c in (
        Contract("weftplan.data_type", t.DataType, t.encode, t.decode),
        Contract("weftplan.field", Field, _field, lambda x: Schema.decode([x]).fields[0]),
        Contract("weftplan.schema", Schema, lambda s: s.encode(), Schema.decode),
        Contract("weftplan.expression", Expr, describe, expr_from),
        Contract("weftplan.plan", Plan, _nodes, lambda x: Plan(x["name"], _nodes_from(x))),
        Contract("weftplan.logical_plan", LogicalPlan, _nodes, lambda x: LogicalPlan(x["name"], _nodes_from(x))),
        Contract("weftplan.lineage", Lineage, _lineage, _lineage_from),
        Contract("weftplan.manifest", Manifest, _manifest, _manifest_from),
        Contract("weftplan.diagnostic", Diagnostic, asdict, lambda x: Diagnostic(**x)),
        Contract("weftplan.resource", Resource, asdict, lambda x: Resource(**x)),
        Contract("weftplan.execution_reference", ExecutionReference, asdict, lambda x: ExecutionReference(**x)),
    )
}

_migrations: dict[tuple[str, int], Callable[[Any], Any]] = {}


def migration(contract: str, version: int, step: Callable[[Any], Any]) -> None:
    """``step`` turns a payload of an older ``version`` into one of the next."""
    if (contract, version) in _migrations or contract not in CONTRACTS or version >= CONTRACTS[contract].version:
        raise ExtensionError(f"no migration of {contract} from version {version} can be added")
    _migrations[contract, version] = step


def canonical(x: Any) -> bytes:
    """Sorted keys, no spaces, NFC texts, no NaN: equal documents have equal bytes."""

    def clean(v: Any, depth: int) -> Any:
        if depth > MAX_DEPTH:
            raise WireError(f"deeper than {MAX_DEPTH} levels")
        match v:
            case str():
                return unicodedata.normalize("NFC", v)
            case None | bool() | int():
                return v
            case float():
                if v != v or v in (float("inf"), float("-inf")):
                    raise WireError("a number must be finite")
                return v
            case dict():
                if any(not isinstance(k, str) for k in v):
                    raise WireError("keys are texts")
                return {unicodedata.normalize("NFC", k): clean(w, depth + 1) for k, w in v.items()}
            case list() | tuple():
                return [clean(w, depth + 1) for w in v]
        raise WireError(f"{type(v).__name__} cannot be written")

    out = json.dumps(clean(x, 0), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()
    if len(out) > MAX_BYTES:
        raise WireError(f"longer than {MAX_BYTES} bytes")
    return out


def dumps(value: Any) -> bytes:
    for c in CONTRACTS.values():
        if isinstance(value, c.type):
            try:
                payload = c.encode(value)
            except WireError:
                raise
            except WeftError as e:
                raise WireError(str(e)) from e
            return canonical({"contract": c.name, "contract_version": c.version, "payload": payload})
    raise WireError(f"{type(value).__name__} has no contract")


def loads(data: bytes | str, contract: str | None = None) -> Any:
    """Strict: size, depth, duplicate keys, NaN, unknown contracts and versions are errors."""
    raw = data.encode() if isinstance(data, str) else data
    if len(raw) > MAX_BYTES:
        raise WireError(f"longer than {MAX_BYTES} bytes")
    depth = most = 0
    text, inside, skip = raw.decode("utf-8", "strict") if _valid(raw) else "", False, False
    for ch in text:
        if skip:
            skip = False
        elif inside:
            skip, inside = ch == "\\", ch != '"'
        elif ch == '"':
            inside = True
        elif ch in "[{":
            depth += 1
            most = max(most, depth)
        elif ch in "]}":
            depth -= 1
    if most > MAX_DEPTH:
        raise WireError(f"deeper than {MAX_DEPTH} levels")

    def unique(rows: list[tuple[str, Any]]) -> dict:
        out = dict(rows)
        if len(out) < len(rows):
            raise WireError("a key occurs twice")
        return out

    def refuse(x: str) -> Any:
        raise WireError(f"{x} is no number here")

    try:
        doc = json.loads(text, object_pairs_hook=unique, parse_constant=refuse)
    except ValueError as e:
        raise WireError(f"not JSON: {e}") from e
    if not isinstance(doc, dict) or set(doc) != {"contract", "contract_version", "payload"}:
        raise WireError("an envelope has contract, contract_version and payload")
    c = CONTRACTS.get(doc["contract"])
    if c is None or contract is not None and c.name != contract:
        raise WireError(f"unexpected contract {doc['contract']!r}")
    version, payload = doc["contract_version"], doc["payload"]
    if isinstance(version, bool) or not isinstance(version, int) or version > c.version or version < 1:
        raise WireError(f"{c.name} has no version {version!r}")
    while version < c.version:
        if (c.name, version) not in _migrations:
            raise WireError(f"{c.name} cannot be read from version {version}")
        payload, version = _migrations[c.name, version](payload), version + 1
    try:
        return c.decode(payload)
    except WireError:
        raise
    except (WeftError, KeyError, TypeError, ValueError, IndexError, AttributeError) as e:
        raise WireError(f"{c.name}: {e}") from e


def _valid(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError as e:
        raise WireError("not UTF-8") from e
    return True
