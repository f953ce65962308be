"""Joins and set operations."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import StrEnum
from functools import reduce
from typing import ClassVar

from pyspark.sql import functions as F

from ..errors import PlanError, SchemaError
from ..functions.lowering import quoted
from ..functions.window import Key
from ..schema import Field, Schema
from .base import Frame, Operator
from .rows import no_maps


class JoinKind(StrEnum):
    INNER = "inner"
    LEFT = "left"
    RIGHT = "right"
    FULL = "full"
    SEMI = "semi"
    ANTI = "anti"
    CROSS = "cross"


class NullMatch(StrEnum):
    MATCH = "match"
    NEVER_MATCH = "never_match"


@dataclass(frozen=True)
class Join(Operator):
    """Equal keys. Output: left fields, then right fields without right keys; a clash gets ``right_suffix``."""

    kind: JoinKind
    on: tuple[tuple[str, str], ...] = ()
    nulls: NullMatch = NullMatch.MATCH
    right_suffix: str = "_right"
    id: ClassVar[str] = "core.join"
    arity: ClassVar[int] = 2
    capability: ClassVar[str] = "join"
    cardinality: ClassVar[str] = "combining"

    def __post_init__(self) -> None:
        if (self.kind == JoinKind.CROSS) == bool(self.on):
            raise PlanError("a cross join takes no keys, any other join takes one at least")
        for side in (0, 1):
            names = [k[side] for k in self.on]
            if len(set(names)) < len(names):
                raise PlanError("a join names a key twice")
        if not self.right_suffix:
            raise PlanError("a join's suffix must not be empty")

    @property
    def keeps_order(self) -> bool:
        return self.kind not in (JoinKind.RIGHT, JoinKind.FULL)

    def capabilities(self, schemas: list[Schema]) -> set[str]:
        return {"join", f"join_{self.kind}"}

    @property
    def left_only(self) -> bool:
        return self.kind in (JoinKind.SEMI, JoinKind.ANTI)

    def right_names(self, left: Schema, right: Schema) -> list[tuple[str, str]]:
        """(right field, output name) of the right fields that stay."""
        keys = {b for _, b in self.on}
        return [(f.name, f.name + self.right_suffix if f.name in left else f.name) for f in right if f.name not in keys]

    def resolve(self, left: Schema, right: Schema) -> Schema:
        for a, b in self.on:
            if left.field(a).type != right.field(b).type:
                raise SchemaError(f"join keys {a!r} and {b!r} differ: {left.field(a).type} and {right.field(b).type}")
        if self.on:
            no_maps(left.select([a for a, _ in self.on]), "join")
        if self.left_only:
            return left
        fields = [replace(f, nullable=f.nullable or self.kind in (JoinKind.RIGHT, JoinKind.FULL)) for f in left]
        for name, out in self.right_names(left, right):
            f = right.field(name)
            fields.append(Field(out, f.type, f.nullable or self.kind in (JoinKind.LEFT, JoinKind.FULL), f.description))
        return Schema(tuple(fields))

    def lower(self, out: Schema, left: Frame, right: Frame) -> Frame:
        # names of the right side that no left or hidden column can have
        alias = {n: f"__right{i}" for i, n in enumerate(right.schema.names)}
        r = right.output().select(*(F.col(quoted(n)).alias(alias[n]) for n in right.schema.names))
        l, same = left.df, (lambda a, b: a.eqNullSafe(b)) if self.nulls == NullMatch.MATCH else (lambda a, b: a == b)
        if self.kind == JoinKind.CROSS:
            joined = l.crossJoin(r)
        else:
            on = reduce(lambda a, b: a & b, (same(F.col(quoted(a)), F.col(alias[b])) for a, b in self.on))
            joined = l.join(r, on, {JoinKind.SEMI: "left_semi", JoinKind.ANTI: "left_anti"}.get(self.kind, str(self.kind)))
        if self.left_only:
            return replace(left, df=joined, settled=False)
        other = dict(self.on)
        both = self.kind in (JoinKind.RIGHT, JoinKind.FULL)
        columns = [F.coalesce(F.col(quoted(n)), F.col(alias[other[n]])).alias(n) if both and n in other else F.col(quoted(n)) for n in left.schema.names]
        columns += [F.col(alias[name]).alias(o) for name, o in self.right_names(left.schema, right.schema)]
        if both:
            return Frame(joined.select(*columns), out)
        return Frame(joined.select(*columns, *left.hidden), out, left.order)

    def describe(self) -> dict:
        return {"kind": str(self.kind), "on": [list(k) for k in self.on], "nulls": str(self.nulls), "right_suffix": self.right_suffix}


@dataclass(frozen=True)
class SetOperator(Operator):
    """Base: both sides have the same fields: names in order, types and nullability."""

    arity: ClassVar[int] = 2
    cardinality: ClassVar[str] = "combining"

    @property
    def keeps_order(self) -> bool:
        return False

    def resolve(self, left: Schema, right: Schema) -> Schema:
        shape = lambda s: [(f.name, f.type, f.nullable) for f in s]
        if shape(left) != shape(right):
            raise SchemaError(f"{self.id} needs the same fields on either side")
        if not getattr(self, "all", False):
            no_maps(left, self.id)
        return left

    def describe(self) -> dict:
        return {}


@dataclass(frozen=True)
class Union(SetOperator):
    all: bool = False
    id: ClassVar[str] = "core.union"
    capability: ClassVar[str] = "union"

    @property
    def keeps_order(self) -> bool:
        return self.all

    @property
    def streams(self) -> bool:  # type: ignore[override]
        return self.all

    def lower(self, out: Schema, left: Frame, right: Frame) -> Frame:
        if not self.all:
            return left.unordered(left.output().union(right.output()).distinct(), out)
        if not (left.order and right.order and len(left.order) == len(right.order) == 1):
            return left.unordered(left.output().union(right.output()), out)
        # left rows first, either side in its own order
        side = [f.df.select(*f.columns, F.lit(i).alias("__side"), F.col(quoted(f.order[0].field)).alias("__row")) for i, f in enumerate((left, right))]
        return Frame(side[0].union(side[1]), out, (Key("__side"), Key("__row")))

    def describe(self) -> dict:
        return {"all": self.all}


@dataclass(frozen=True)
class Intersect(SetOperator):
    id: ClassVar[str] = "core.intersect"
    capability: ClassVar[str] = "intersect"

    def lower(self, out: Schema, left: Frame, right: Frame) -> Frame:
        return left.unordered(left.output().intersect(right.output()), out)


@dataclass(frozen=True)
class Except(SetOperator):
    id: ClassVar[str] = "core.except"
    capability: ClassVar[str] = "except"

    def lower(self, out: Schema, left: Frame, right: Frame) -> Frame:
        return left.unordered(left.output().subtract(right.output()), out)
