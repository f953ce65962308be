"""Pivot, unpivot, explode and flatten."""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import functions as F

from ..errors import PlanError, SchemaError
from ..functions.expr import Agg, Col
from ..functions.lowering import aggregate, quoted
from ..functions.typing import typed
from ..schema import Field, Schema
from ..types import STRING, List, String, Struct
from .base import Frame, Operator
from .rows import names_of, no_maps

PIVOTS = ("sum", "min", "max", "mean", "count")


@dataclass(frozen=True)
class Pivot(Operator):
    """One output column for each declared category; groups without any stay, with NULLs and zero counts."""

    index: tuple[str, ...]
    columns: str
    values: str
    categories: tuple[str, ...]
    aggregation: str
    id: ClassVar[str] = "core.pivot"
    capability: ClassVar[str] = "pivot"
    cardinality: ClassVar[str] = "reducing"

    def __post_init__(self) -> None:
        if self.aggregation not in PIVOTS:
            raise PlanError(f"pivot aggregates by {', '.join(PIVOTS)}")
        if any(not isinstance(c, str) or not c.strip() for c in self.categories):
            raise PlanError("pivot categories must not be blank")
        names_of(self.categories, "pivot")
        if len({*self.index, self.columns, self.values}) < len(self.index) + 2:
            raise PlanError("pivot names a column twice")

    @property
    def keeps_order(self) -> bool:
        return False

    @property
    def metric(self) -> Agg:
        return Agg(self.aggregation, Col(self.values))

    def resolve(self, schema: Schema) -> Schema:
        if not isinstance(schema.field(self.columns).type, String):
            raise SchemaError(f"pivot needs strings in {self.columns!r}")
        schema.field(self.values)
        keys = schema.select(self.index)
        no_maps(keys, "pivot")
        t, _ = typed(self.metric, schema, aggregates=True)
        return keys.append(*(Field(c, t, self.aggregation != "count") for c in self.categories))

    def lower(self, out: Schema, frame: Frame) -> Frame:
        cells = [aggregate(self.metric, frame.schema, F.col(quoted(self.columns)) == F.lit(c)).alias(c) for c in self.categories]
        keys = [F.col(quoted(k)) for k in self.index]
        return frame.unordered(frame.df.groupBy(*keys).agg(*cells) if keys else frame.df.agg(*cells), out)

    def describe(self) -> dict:
        return {"index": list(self.index), "columns": self.columns, "values": self.values, "categories": list(self.categories), "aggregation": self.aggregation}


@dataclass(frozen=True)
class Unpivot(Operator):
    """One row for each value column, NULL values too."""

    id_vars: tuple[str, ...]
    value_vars: tuple[str, ...]
    variable_name: str = "variable"
    value_name: str = "value"
    id: ClassVar[str] = "core.unpivot"
    capability: ClassVar[str] = "unpivot"
    cardinality: ClassVar[str] = "expanding"

    def __post_init__(self) -> None:
        names_of(self.value_vars, "unpivot")
        if set(self.id_vars) & set(self.value_vars) or len(set(self.id_vars)) < len(self.id_vars):
            raise PlanError("unpivot names a column twice")

    @property
    def keeps_order(self) -> bool:
        return False

    def resolve(self, schema: Schema) -> Schema:
        values = schema.select(self.value_vars).fields
        if len({f.type for f in values}) > 1:
            raise SchemaError("unpivot needs value columns of one type")
        return schema.select(self.id_vars).append(Field(self.variable_name, STRING, False), Field(self.value_name, values[0].type, any(f.nullable for f in values)))

    def lower(self, out: Schema, frame: Frame) -> Frame:
        df = frame.df.unpivot([F.col(quoted(c)) for c in self.id_vars], [F.col(quoted(c)) for c in self.value_vars], self.variable_name, self.value_name)
        return frame.unordered(df, out)

    def describe(self) -> dict:
        return {"id_vars": list(self.id_vars), "value_vars": list(self.value_vars), "variable_name": self.variable_name, "value_name": self.value_name}


@dataclass(frozen=True)
class Explode(Operator):
    """One row for each element; an empty or NULL list gives one row with NULL."""

    field: str
    id: ClassVar[str] = "core.explode"
    capability: ClassVar[str] = "explode"
    cardinality: ClassVar[str] = "expanding"
    streams: ClassVar[bool] = True

    def resolve(self, schema: Schema) -> Schema:
        f = schema.field(self.field)
        if not isinstance(f.type, List):
            raise SchemaError(f"explode needs a list in {self.field!r}")
        return schema.replace(Field(f.name, f.type.element, True, f.description))

    def lower(self, out: Schema, frame: Frame) -> Frame:
        return frame.with_columns([F.explode_outer(c).alias(n) if n == self.field else c for n, c in zip(out.names, frame.columns)], out)

    def describe(self) -> dict:
        return {"field": self.field}


@dataclass(frozen=True)
class Flatten(Operator):
    """A struct's members as columns in its place, named by prefix (``field_``) and member."""

    field: str
    prefix: str | None = None
    id: ClassVar[str] = "core.flatten"
    capability: ClassVar[str] = "flatten"
    streams: ClassVar[bool] = True

    def members(self, schema: Schema) -> list[tuple[str, str]]:
        f = schema.field(self.field)
        if not isinstance(f.type, Struct):
            raise SchemaError(f"flatten needs a struct in {self.field!r}")
        prefix = f"{self.field}_" if self.prefix is None else self.prefix
        return [(m.name, prefix + m.name) for m in f.type.members]

    def resolve(self, schema: Schema) -> Schema:
        out: list[Field] = []
        names = dict(self.members(schema))
        for f in schema:
            out += [Field(names[m.name], m.type, f.nullable or m.nullable) for m in f.type.members] if f.name == self.field else [f]
        return Schema(tuple(out))

    def lower(self, out: Schema, frame: Frame) -> Frame:
        columns = []
        for n, c in zip(frame.schema.names, frame.columns):
            columns += [c.getField(m).alias(o) for m, o in self.members(frame.schema)] if n == self.field else [c]
        return frame.with_columns(columns, out)

    def describe(self) -> dict:
        return {"field": self.field, "prefix": self.prefix}
