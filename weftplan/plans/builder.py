"""Authoring: each call checks its step against the schemas so far."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from ..errors import PlanError
from ..functions.expr import Agg, Expr, as_expr, col
from ..operators import Aggregate, Cast, CastPolicy, Deduplicate, Derive, Distinct, Drop, Except, Explode, Filter, Flatten, Intersect, Join, JoinKind, Keep, Limit, NullMatch, Operator, Pivot, QualityGate, Rename, Select, Sort, SortKey, Union, Unpivot
from ..quality.rules import ValidationSpec
from ..schema import Schema
from ..types import DataType
from .plan import Node, Plan


@dataclass(frozen=True)
class Dataset:
    """A step's result while authoring: its identity and schema, never data."""

    id: str
    name: str
    schema: Schema
    builder: int


class PlanBuilder:
    def __init__(self, name: str):
        if not name.strip():
            raise PlanError("a plan needs a name")
        self.name, self._nodes, self._built = name, [], False

    def _add(self, name: str, kind: str, schema: Schema, inputs: tuple[Dataset, ...] = (), operator: Operator | None = None, order_key: tuple[str, ...] = ()) -> Dataset:
        if self._built:
            raise PlanError("the plan is built; start another one")
        if any(n.name == name and (n.kind == "output") == (kind == "output") for n in self._nodes):
            raise PlanError(f"there is a step {name!r} already")
        for d in inputs:
            if d.builder != id(self):
                raise PlanError(f"{d.name!r} belongs to another plan")
        node = Node(uuid.uuid4().hex, name, kind, schema, tuple(d.id for d in inputs), operator, order_key)
        self._nodes.append(node)
        return Dataset(node.id, name, schema, id(self))

    def input(self, name: str, schema: Schema, order_key: Iterable[str] = ()) -> Dataset:
        """``order_key``: fields that define the row order, for steps that depend on one. Without it the order in
        which Spark reads the rows counts, which is fixed for a fixed layout of files only."""
        return self._add(name, "input", schema, order_key=schema.select(order_key).names)

    def apply(self, name: str, source: Dataset | tuple[Dataset, ...], operator: Operator) -> Dataset:
        sources = source if isinstance(source, tuple) else (source,)
        if len(sources) != operator.arity:
            raise PlanError(f"{operator.id} takes {operator.arity} inputs")
        return self._add(name, "step", operator.resolve(*(s.schema for s in sources)), sources, operator)

    def output(self, name: str, dataset: Dataset) -> None:
        self._add(name, "output", dataset.schema, (dataset,))

    def build(self) -> Plan:
        plan = Plan(self.name, tuple(self._nodes))
        self._built = True
        return plan

    def select(self, name: str, source: Dataset, columns: Iterable[str]) -> Dataset:
        return self.apply(name, source, Select(tuple(columns)))

    def drop(self, name: str, source: Dataset, columns: Iterable[str]) -> Dataset:
        return self.apply(name, source, Drop(tuple(columns)))

    def rename(self, name: str, source: Dataset, mapping: Mapping[str, str]) -> Dataset:
        return self.apply(name, source, Rename(tuple(mapping.items())))

    def filter(self, name: str, source: Dataset, where: Expr) -> Dataset:
        return self.apply(name, source, Filter(where))

    def limit(self, name: str, source: Dataset, count: int) -> Dataset:
        return self.apply(name, source, Limit(count))

    def distinct(self, name: str, source: Dataset) -> Dataset:
        return self.apply(name, source, Distinct())

    def cast(self, name: str, source: Dataset, field: str, target_type: DataType, policy: CastPolicy = CastPolicy.RAISE) -> Dataset:
        return self.apply(name, source, Cast(field, target_type, CastPolicy(policy)))

    def derive(self, name: str, source: Dataset, field_name: str, expression: Expr, replace_existing: bool = False) -> Dataset:
        return self.apply(name, source, Derive(field_name, as_expr(expression), replace_existing))

    def sort(self, name: str, source: Dataset, by: Iterable[str | SortKey], descending: bool = False, nulls_first: bool = False) -> Dataset:
        return self.apply(name, source, Sort(tuple(k if isinstance(k, SortKey) else SortKey(k, descending, nulls_first) for k in by)))

    def deduplicate(self, name: str, source: Dataset, keys: Iterable[str], keep: Keep = Keep.FIRST) -> Dataset:
        return self.apply(name, source, Deduplicate(tuple(keys), Keep(keep)))

    def aggregate(self, name: str, source: Dataset, group_by: Iterable[str | Expr] = (), metrics: Mapping[str, Agg] = {}) -> Dataset:  # noqa: B006
        return self.apply(name, source, Aggregate(tuple(col(e) if isinstance(e, str) else e for e in group_by), tuple(metrics.items())))

    def pivot(self, name: str, source: Dataset, index: Iterable[str], columns: str, values: str, categories: Iterable[str], aggregation: str = "sum") -> Dataset:
        return self.apply(name, source, Pivot(tuple(index), columns, values, tuple(categories), aggregation))

    def unpivot(self, name: str, source: Dataset, id_vars: Iterable[str], value_vars: Iterable[str], variable_name: str = "variable", value_name: str = "value") -> Dataset:
        return self.apply(name, source, Unpivot(tuple(id_vars), tuple(value_vars), variable_name, value_name))

    def explode(self, name: str, source: Dataset, field: str) -> Dataset:
        return self.apply(name, source, Explode(field))

    def flatten(self, name: str, source: Dataset, field: str, prefix: str | None = None) -> Dataset:
        return self.apply(name, source, Flatten(field, prefix))

    def validate(self, name: str, source: Dataset, spec: ValidationSpec) -> Dataset:
        return self.apply(name, source, QualityGate(spec))

    def join(self, name: str, left: Dataset, right: Dataset, how: str = "inner", on: Iterable[str | tuple[str, str]] = (), nulls: NullMatch = NullMatch.MATCH, right_suffix: str = "_right") -> Dataset:
        keys = tuple((k, k) if isinstance(k, str) else tuple(k) for k in on)
        return self.apply(name, (left, right), Join(JoinKind(how), keys, NullMatch(nulls), right_suffix))

    def union(self, name: str, left: Dataset, right: Dataset, all: bool = False) -> Dataset:
        return self.apply(name, (left, right), Union(all))

    def intersect(self, name: str, left: Dataset, right: Dataset) -> Dataset:
        return self.apply(name, (left, right), Intersect())

    def except_(self, name: str, left: Dataset, right: Dataset) -> Dataset:
        return self.apply(name, (left, right), Except())
