"""Projection, filtering, casting, derivation, sorting and row selection."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import StrEnum
from typing import ClassVar

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..errors import PlanError, SchemaError
from ..functions.expr import Expr, describe
from ..functions.lowering import column, conform, of_all_rows, order_column, quoted
from ..functions.typing import boolean, typed
from ..functions.window import Key, Over
from ..schema import Field, Schema
from ..types import DataType, Decimal, Float, Integer, List, Map, Struct, Unknown, encode, to_spark
from .base import Frame, Operator


def names_of(columns: object, what: str) -> tuple[str, ...]:
    out = tuple(columns)  # type: ignore[call-overload]
    if isinstance(columns, str) or not out or any(not isinstance(c, str) or not c for c in out):
        raise PlanError(f"{what} takes column names, one at least")
    if len(set(out)) < len(out):
        raise PlanError(f"{what} names a column twice")
    return out


def no_maps(schema: Schema, what: str) -> None:
    """Spark compares no maps, so neither do operators that compare whole rows or keys."""

    def has(t: DataType) -> bool:
        return isinstance(t, Map) or isinstance(t, List) and has(t.element) or isinstance(t, Struct) and any(has(m.type) for m in t.members)

    for f in schema:
        if has(f.type):
            raise SchemaError(f"{what} cannot compare {f.name!r}: {f.type}")


@dataclass(frozen=True)
class Select(Operator):
    columns: tuple[str, ...]
    id: ClassVar[str] = "core.select"
    capability: ClassVar[str] = "select"
    streams: ClassVar[bool] = True

    def __post_init__(self) -> None:
        names_of(self.columns, "select")

    def resolve(self, schema: Schema) -> Schema:
        return schema.select(self.columns)

    def lower(self, out: Schema, frame: Frame) -> Frame:
        return frame.with_columns([F.col(quoted(c)) for c in self.columns], out)

    def describe(self) -> dict:
        return {"columns": list(self.columns)}


@dataclass(frozen=True)
class Drop(Operator):
    columns: tuple[str, ...]
    id: ClassVar[str] = "core.drop"
    capability: ClassVar[str] = "drop"
    streams: ClassVar[bool] = True

    def __post_init__(self) -> None:
        names_of(self.columns, "drop")

    def resolve(self, schema: Schema) -> Schema:
        return schema.drop(self.columns)

    def lower(self, out: Schema, frame: Frame) -> Frame:
        return frame.with_columns([F.col(quoted(c)) for c in out.names], out)

    def describe(self) -> dict:
        return {"columns": list(self.columns)}


@dataclass(frozen=True)
class Rename(Operator):
    mapping: tuple[tuple[str, str], ...]
    id: ClassVar[str] = "core.rename"
    capability: ClassVar[str] = "rename"
    streams: ClassVar[bool] = True

    def __post_init__(self) -> None:
        names_of((a for a, _ in self.mapping), "rename")
        names_of((b for _, b in self.mapping), "rename")

    def resolve(self, schema: Schema) -> Schema:
        return schema.rename(dict(self.mapping))

    def lower(self, out: Schema, frame: Frame) -> Frame:
        return frame.with_columns([c.alias(n) for c, n in zip(frame.columns, out.names)], out)

    def describe(self) -> dict:
        return {"mapping": [list(m) for m in self.mapping]}


@dataclass(frozen=True)
class Filter(Operator):
    where: Expr
    id: ClassVar[str] = "core.filter"
    capability: ClassVar[str] = "filter"
    cardinality: ClassVar[str] = "filtering"
    streams: ClassVar[bool] = True

    def expressions(self) -> tuple:
        return (self.where,)

    def resolve(self, schema: Schema) -> Schema:
        boolean(self.where, schema, "a filter's condition")
        return schema

    def lower(self, out: Schema, frame: Frame) -> Frame:
        return frame.with_rows(frame.df.where(column(self.where, frame.schema)))

    def describe(self) -> dict:
        return {"where": describe(self.where)}


@dataclass(frozen=True)
class Limit(Operator):
    count: int
    id: ClassVar[str] = "core.limit"
    capability: ClassVar[str] = "limit"
    cardinality: ClassVar[str] = "filtering"

    def __post_init__(self) -> None:
        if isinstance(self.count, bool) or not isinstance(self.count, int) or self.count < 0:
            raise PlanError("limit takes a whole number, zero or more")

    @property
    def needs_order(self) -> bool:
        return True

    def resolve(self, schema: Schema) -> Schema:
        return schema

    def lower(self, out: Schema, frame: Frame) -> Frame:
        frame = frame.ordered()
        if not frame.settled:
            frame = replace(frame, df=frame.df.orderBy(*(order_column(k) for k in frame.order)), settled=True)
        return frame.with_rows(frame.df.limit(self.count))

    def describe(self) -> dict:
        return {"count": self.count}


@dataclass(frozen=True)
class Distinct(Operator):
    id: ClassVar[str] = "core.distinct"
    capability: ClassVar[str] = "distinct"
    cardinality: ClassVar[str] = "reducing"

    @property
    def keeps_order(self) -> bool:
        return False

    def resolve(self, schema: Schema) -> Schema:
        no_maps(schema, "distinct")
        return schema

    def lower(self, out: Schema, frame: Frame) -> Frame:
        return frame.unordered(frame.output().distinct(), out)

    def describe(self) -> dict:
        return {}


class CastPolicy(StrEnum):
    RAISE = "raise"
    NULL = "null"
    COERCE = "coerce"


@dataclass(frozen=True)
class Cast(Operator):
    field: str
    target: DataType
    policy: CastPolicy = CastPolicy.RAISE
    id: ClassVar[str] = "core.cast"
    capability: ClassVar[str] = "cast"
    streams: ClassVar[bool] = True

    def resolve(self, schema: Schema) -> Schema:
        f = schema.field(self.field)
        if isinstance(self.target, Unknown):
            raise SchemaError("a cast needs a known target type")
        return schema.replace(replace(f, type=self.target, nullable=f.nullable or self.policy == CastPolicy.NULL))

    def lower(self, out: Schema, frame: Frame) -> Frame:
        old, spark = frame.schema.field(self.field).type, to_spark(self.target)
        c = F.col(quoted(self.field))
        if isinstance(self.target, Decimal) and isinstance(old, Float | Decimal):
            # half-even where a digit is lost; a float counts as the decimal that its shortest text shows
            wide = f"decimal(38,{min(37, self.target.scale + 10)})"
            take = c.try_cast if self.policy == CastPolicy.NULL else c.cast
            c = F.bround(c if isinstance(old, Decimal) else take(wide), self.target.scale)
        if self.policy == CastPolicy.NULL:
            c = c.try_cast(spark)
            if isinstance(self.target, Integer) and not self.target.signed:
                c = F.when((c >= 0) & (c <= F.lit(str(2**self.target.bits - 1)).cast("decimal(20,0)")), c)
        else:
            c = conform(c, self.target)
        return frame.with_columns([c.alias(n) if n == self.field else F.col(quoted(n)) for n in out.names], out)

    def describe(self) -> dict:
        return {"field": self.field, "target": encode(self.target), "policy": str(self.policy)}


@dataclass(frozen=True)
class Derive(Operator):
    field: str
    expression: Expr
    replace_existing: bool = False
    id: ClassVar[str] = "core.derive"
    capability: ClassVar[str] = "derive"

    @property
    def streams(self) -> bool:  # type: ignore[override]
        return not isinstance(self.expression, Over)

    @property
    def needs_order(self) -> bool:
        return isinstance(self.expression, Over) and self.expression.by_row_order

    def expressions(self) -> tuple:
        return (self.expression,)

    def resolve(self, schema: Schema) -> Schema:
        t, nullable = typed(self.expression, schema, window=True)
        f = Field(self.field, t, nullable)
        if self.field in schema:
            if not self.replace_existing:
                raise SchemaError(f"{self.field!r} exists; replace_existing=True replaces it")
            return schema.replace(f)
        return schema.append(f)

    def lower(self, out: Schema, frame: Frame) -> Frame:
        if self.needs_order:
            frame = frame.ordered()
        e = self.expression
        if isinstance(e, Over) and e.whole_table:
            made = of_all_rows(e, frame.schema, frame.df).alias(self.field)
        else:
            made = column(e, frame.schema, tuple(order_column(k) for k in frame.order)).alias(self.field)
        frame = frame.with_columns([made if n == self.field else F.col(quoted(n)) for n in out.names], out)
        return replace(frame, settled=frame.settled and not isinstance(self.expression, Over))

    def describe(self) -> dict:
        return {"field": self.field, "expression": describe(self.expression), "replace_existing": self.replace_existing}


@dataclass(frozen=True)
class SortKey:
    field: str
    descending: bool = False
    nulls_first: bool = False


@dataclass(frozen=True)
class Sort(Operator):
    keys: tuple[SortKey, ...]
    id: ClassVar[str] = "core.sort"
    capability: ClassVar[str] = "sort"

    def __post_init__(self) -> None:
        names_of((k.field for k in self.keys), "sort")

    def resolve(self, schema: Schema) -> Schema:
        for k in self.keys:
            if isinstance(schema.field(k.field).type, Map):
                raise SchemaError(f"sort cannot order maps: {k.field!r}")
        return schema

    def lower(self, out: Schema, frame: Frame) -> Frame:
        keys = [Key(k.field, k.descending, k.nulls_first) for k in self.keys]
        if not frame.order:
            return replace(frame, df=frame.df.orderBy(*(order_column(k) for k in keys)))
        # a later step needs the order, so the keys stay as hidden columns before those of the order so far
        depth = len(frame.order)
        hidden = [Key(f"__key{depth}_{i}", k.descending, k.nulls_first) for i, k in enumerate(keys)]
        df = frame.df.select(*frame.columns, *(F.col(quoted(k.field)).alias(h.field) for k, h in zip(keys, hidden)), *frame.hidden)
        order = (*hidden, *frame.order)
        return Frame(df.orderBy(*(order_column(k) for k in order)), out, order, settled=True)

    def describe(self) -> dict:
        return {"keys": [[k.field, k.descending, k.nulls_first] for k in self.keys]}


class Keep(StrEnum):
    FIRST = "first"
    LAST = "last"


@dataclass(frozen=True)
class Deduplicate(Operator):
    """One row for each key, the first or last in row order; NULL keys are equal."""

    keys: tuple[str, ...]
    keep: Keep = Keep.FIRST
    id: ClassVar[str] = "core.deduplicate"
    capability: ClassVar[str] = "deduplicate"
    cardinality: ClassVar[str] = "reducing"

    def __post_init__(self) -> None:
        names_of(self.keys, "deduplicate")

    @property
    def needs_order(self) -> bool:
        return True

    def resolve(self, schema: Schema) -> Schema:
        no_maps(schema.select(self.keys), "deduplicate")
        return schema

    def lower(self, out: Schema, frame: Frame) -> Frame:
        frame = frame.ordered()
        flip = self.keep == Keep.LAST
        order = [order_column(Key(k.field, k.descending != flip, k.nulls_first != flip)) for k in frame.order]
        if any(isinstance(f.type, Map) for f in out):
            w = Window.partitionBy(*(F.col(quoted(k)) for k in self.keys)).orderBy(*order)
            df = frame.df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
            return replace(frame, df=df, settled=False)
        if all(not k.descending and not k.nulls_first for k in frame.order):
            # an aggregation combines before the shuffle, so a hot key costs one row for each task
            row = F.struct(*frame.hidden, *frame.columns)
            best = (F.max_by if flip else F.min_by)(row, F.struct(*frame.hidden))
            df = frame.df.groupBy(*(F.col(quoted(k)) for k in self.keys)).agg(best.alias("__best")).select("__best.*")
            return replace(frame, df=df.select(*frame.columns, *frame.hidden), settled=False)
        w = Window.partitionBy(*(F.col(quoted(k)) for k in self.keys)).orderBy(*order)
        return replace(frame, df=frame.df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n"), settled=False)

    def describe(self) -> dict:
        return {"keys": list(self.keys), "keep": str(self.keep)}


__all__ = ["Select", "Drop", "Rename", "Filter", "Limit", "Distinct", "Cast", "CastPolicy", "Derive", "Sort", "SortKey", "Deduplicate", "Keep", "names_of", "no_maps"]
