"""Grouped aggregation."""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import functions as F

from ..errors import PlanError
from ..functions.expr import Agg, Col, Expr, describe
from ..functions.lowering import aggregate, column, quoted
from ..functions.typing import typed
from ..schema import Field, Schema
from .base import Frame, Operator
from .rows import no_maps


def key_name(e: Expr, i: int) -> str:
    return e.path if isinstance(e, Col) else f"group_{i}"


@dataclass(frozen=True)
class Aggregate(Operator):
    """Keys are row expressions (a column keeps its path as name, others are group_0, group_1, ...); NULL is a group."""

    group_by: tuple[Expr, ...]
    metrics: tuple[tuple[str, Agg], ...]
    id: ClassVar[str] = "core.aggregate"
    capability: ClassVar[str] = "aggregate"
    cardinality: ClassVar[str] = "reducing"

    def __post_init__(self) -> None:
        if not self.metrics:
            raise PlanError("aggregate needs a metric, one at least")
        for name, m in self.metrics:
            if not isinstance(m, Agg):
                raise PlanError(f"metric {name!r} must be an aggregate")
        names = [key_name(e, i) for i, e in enumerate(self.group_by)] + [n for n, _ in self.metrics]
        if len(set(names)) < len(names):
            raise PlanError("aggregate names an output twice")

    @property
    def keeps_order(self) -> bool:
        return False

    def expressions(self) -> tuple:
        return (*self.group_by, *(m for _, m in self.metrics))

    def resolve(self, schema: Schema) -> Schema:
        keys = Schema(tuple(Field(key_name(e, i), *typed(e, schema)) for i, e in enumerate(self.group_by)))
        no_maps(keys, "aggregate")
        return keys.append(*(Field(n, *typed(m, schema, aggregates=True)) for n, m in self.metrics))

    def lower(self, out: Schema, frame: Frame) -> Frame:
        metrics = [aggregate(m, frame.schema).alias(n) for n, m in self.metrics]
        keys = [column(e, frame.schema).alias(key_name(e, i)) for i, e in enumerate(self.group_by)]
        df = frame.df.groupBy(*keys).agg(*metrics) if keys else frame.df.agg(*metrics)
        return frame.unordered(df.select(*(F.col(quoted(n)) for n in out.names)), out)

    def describe(self) -> dict:
        return {"group_by": [describe(e) for e in self.group_by], "metrics": [[n, describe(m)] for n, m in self.metrics]}
