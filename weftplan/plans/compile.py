"""From plan to logical plan to lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..errors import PlanError, SchemaError
from ..functions.lowering import quoted
from ..functions.window import Key
from ..operators import Frame, QualityGate, Sort
from ..schema import Schema
from .plan import Node, Plan, topological, validate


@dataclass(frozen=True)
class LogicalPlan:
    """A plan's nodes in the order of execution, with every schema resolved anew."""

    name: str
    nodes: tuple[Node, ...]

    @property
    def outputs(self) -> tuple[Node, ...]:
        return tuple(n for n in self.nodes if n.kind == "output")

    @property
    def inputs(self) -> tuple[Node, ...]:
        return tuple(n for n in self.nodes if n.kind == "input")

    @property
    def fingerprint(self) -> str:
        from .fingerprint import fingerprint

        return fingerprint(self)

    def consumers(self) -> dict[str, int]:
        out = {n.id: 0 for n in self.nodes}
        for n in self.nodes:
            for i in n.inputs:
                out[i] += 1
        return out


def resolve_all(nodes: list[Node]) -> tuple[Node, ...]:
    """Nodes in order, with schemas computed from the inputs' ones."""
    known: dict[str, Schema] = {}
    out = []
    for n in nodes:
        if n.kind == "output":
            n = replace(n, schema=known[n.inputs[0]])
        elif n.operator is not None:
            n = replace(n, schema=n.operator.resolve(*(known[i] for i in n.inputs)))
        known[n.id] = n.schema
        out.append(n)
    return tuple(out)


def compile_plan(plan: Plan | LogicalPlan) -> LogicalPlan:
    if isinstance(plan, LogicalPlan):
        return plan
    validate(plan.nodes)
    return LogicalPlan(plan.name, resolve_all(topological(plan.nodes)))


def order_needed(plan: LogicalPlan) -> set[str]:
    """Ids of the nodes whose rows must carry their order, as a later step's result depends on it."""
    out: set[str] = set()
    for n in reversed(plan.nodes):
        op = n.operator
        if op is None:
            passes = n.id in out
        else:
            passes = op.needs_order or n.id in out and op.keeps_order
        if passes:
            out.update(n.inputs)
    return out


def loose(t: S.DataType) -> S.DataType:
    """A Spark type with all that it holds nullable."""
    match t:
        case S.StructType():
            return S.StructType([S.StructField(f.name, loose(f.dataType), True, f.metadata) for f in t.fields])
        case S.ArrayType():
            return S.ArrayType(loose(t.elementType), True)
        case S.MapType():
            return S.MapType(loose(t.keyType), loose(t.valueType), True)
    return t


def bind(df: DataFrame, schema: Schema, name: str) -> DataFrame:
    """``df`` with the declared schema: columns by name, types widened where that is safe. Drift is an error."""
    want = schema.to_spark()
    have = {f.name: f for f in df.schema.fields}
    if missing := [f.name for f in want.fields if f.name not in have]:
        raise SchemaError(f"input {name!r} has no column {missing[0]!r}")
    if [(f.name, f.dataType) for f in df.schema.fields] == [(f.name, f.dataType) for f in want.fields]:
        return df
    if df.isStreaming or any(have[f.name].nullable and not f.nullable or have[f.name].dataType != f.dataType for f in want.fields):
        want = loose(want)  # a declared non-null column or member is trusted, as Spark's own readers call all nullable
    try:
        return df.select(*(F.col(quoted(f.name)) for f in want.fields)).to(want)
    except Exception as e:
        raise SchemaError(f"input {name!r} does not fit its schema: {str(e).splitlines()[0]}") from e


def lower(plan: LogicalPlan, inputs: Mapping[str, DataFrame], on_gate: Callable[[Node, Frame], None] | None = None, keep: Callable[[Node, DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """A lazy DataFrame for each output. ``on_gate`` sees each gate's frame; ``keep`` may persist a node's DataFrame."""
    need = order_needed(plan)
    frames: dict[str, Frame] = {}
    out: dict[str, DataFrame] = {}
    for n in plan.nodes:
        if n.kind == "input":
            if n.name not in inputs:
                raise PlanError(f"input {n.name!r} is not bound")
            frame = Frame(bind(inputs[n.name], n.schema, n.name), n.schema)
            if n.id in need:
                if n.order_key:
                    names = [f"__order{i}" for i in range(len(n.order_key))]
                    frame = Frame(frame.df.select(*frame.columns, *(F.col(quoted(k)).alias(h) for k, h in zip(n.order_key, names))), n.schema, tuple(map(Key, names)))
                else:
                    frame = frame.ordered()
        elif n.kind == "output":
            out[n.name] = frames[n.inputs[0]].output()
            continue
        else:
            sources = [frames[i] for i in n.inputs]
            if isinstance(n.operator, Sort) and n.id in need:
                sources = [s.ordered() for s in sources]
            frame = n.operator.lower(n.schema, *sources)
            if isinstance(n.operator, QualityGate) and on_gate is not None:
                frame = replace(frame, df=keep(n, frame.df)) if keep else frame
                on_gate(n, frame)
        if keep is not None and n.kind != "input" and not isinstance(n.operator, QualityGate):
            frame = replace(frame, df=keep(n, frame.df))
        frames[n.id] = frame
    return out
