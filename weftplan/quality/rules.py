"""Quality rules: each says which fields it reads, checks itself against a schema and counts its violations.

A rule counts in one of three ways: ``violation`` is a condition on a row, summed with all others of the gate in one
aggregation; ``keys`` asks for distinct counting in a job of its own; ``static`` needs no data.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from enum import StrEnum

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PlanError, SchemaError
from ..functions.expr import Expr, as_expr, describe
from ..functions.lowering import column, literal, ref
from ..functions.typing import boolean
from ..schema import Schema
from ..types import Float, String


@dataclass(frozen=True)
class Threshold:
    """Both bounds must hold; None is no bound."""

    max_violations: int | None = 0
    max_violation_rate: float | None = None

    def __post_init__(self) -> None:
        if self.max_violations is not None and self.max_violations < 0 or self.max_violation_rate is not None and not 0 <= self.max_violation_rate <= 1:
            raise PlanError("a threshold is a count of zero or more, or a rate from 0 to 1")

    def holds(self, violations: int, evaluated: int) -> bool:
        rate = violations / evaluated if evaluated else 0.0
        return (self.max_violations is None or violations <= self.max_violations) and (self.max_violation_rate is None or rate <= self.max_violation_rate)


class Policy(StrEnum):
    FAIL_FAST = "fail_fast"
    FAIL_AT_END = "fail_at_end"
    WARN_ONLY = "warn_only"
    IGNORE = "ignore"


def missing(path: str, schema: Schema) -> Column:
    """NULL, or NaN in a float."""
    c = ref(path)
    return c.isNull() | F.isnan(c) if isinstance(schema.resolve(path)[0], Float) else c.isNull()


@dataclass(frozen=True, eq=False)
class Rule:
    threshold: Threshold = field(default_factory=Threshold, kw_only=True)
    name: str | None = field(default=None, kw_only=True)

    @property
    def kind(self) -> str:
        return type(self).__name__.lower()

    @property
    def label(self) -> str:
        return self.name or f"{self.kind}({', '.join(self.fields())})"

    def fields(self) -> tuple[str, ...]:
        return ()

    def check(self, schema: Schema) -> None:
        for f in self.fields():
            schema.resolve(f)

    def violation(self, schema: Schema) -> Column | None:
        """True on rows that break the rule."""
        return None

    def keys(self) -> tuple[str, ...]:
        """Fields to count distinctly."""
        return ()

    def on_count(self, rows: int) -> bool | None:
        """Whether a table of so many rows breaks the rule; None if rows are not its business."""
        return None

    def static(self, schema: Schema) -> bool | None:
        return None

    def settings(self) -> dict:
        return {}

    def describe(self) -> dict:
        return {"rule": self.kind, "fields": list(self.fields()), "threshold": [self.threshold.max_violations, self.threshold.max_violation_rate], "name": self.name} | self.settings()


@dataclass(frozen=True, eq=False)
class NotNull(Rule):
    field: str

    def fields(self) -> tuple[str, ...]:
        return (self.field,)

    def violation(self, schema: Schema) -> Column:
        return missing(self.field, schema)


@dataclass(frozen=True, eq=False)
class Unique(Rule):
    columns: tuple[str, ...]

    def __post_init__(self) -> None:
        if not self.columns or len(set(self.columns)) < len(self.columns):
            raise PlanError("unique takes different fields, one at least")

    def fields(self) -> tuple[str, ...]:
        return self.columns

    def keys(self) -> tuple[str, ...]:
        return self.columns


@dataclass(frozen=True, eq=False)
class Range(Rule):
    field: str
    min: object = None
    max: object = None
    include_min: bool = True
    include_max: bool = True

    def __post_init__(self) -> None:
        if self.min is None and self.max is None:
            raise PlanError("a range needs a bound")

    def fields(self) -> tuple[str, ...]:
        return (self.field,)

    def violation(self, schema: Schema) -> Column:
        c, bad = ref(self.field), F.lit(False)
        if self.min is not None:
            low = literal(as_expr(self.min))
            bad = bad | (c < low if self.include_min else c <= low)
        if self.max is not None:
            high = literal(as_expr(self.max))
            bad = bad | (c > high if self.include_max else c >= high)
        return ~missing(self.field, schema) & bad

    def settings(self) -> dict:
        return {"min": describe(as_expr(self.min)), "max": describe(as_expr(self.max)), "include": [self.include_min, self.include_max]}


@dataclass(frozen=True, eq=False)
class AllowedValues(Rule):
    field: str
    values: tuple

    def __post_init__(self) -> None:
        if not self.values:
            raise PlanError("allowed_values needs a value, one at least")

    def fields(self) -> tuple[str, ...]:
        return (self.field,)

    def violation(self, schema: Schema) -> Column:
        return ~missing(self.field, schema) & ~ref(self.field).isin(*self.values)

    def settings(self) -> dict:
        return {"values": [describe(as_expr(v)) for v in self.values]}


@dataclass(frozen=True, eq=False)
class Regex(Rule):
    """The whole value must match. Patterns are checked as Python's; Java's dialect runs them."""

    field: str
    pattern: str

    def __post_init__(self) -> None:
        try:
            re.compile(self.pattern)
        except re.error as e:
            raise PlanError(f"regex {self.pattern!r}: {e}") from e

    def fields(self) -> tuple[str, ...]:
        return (self.field,)

    def check(self, schema: Schema) -> None:
        if not isinstance(schema.resolve(self.field)[0], String):
            raise SchemaError(f"regex needs strings in {self.field!r}")

    def violation(self, schema: Schema) -> Column:
        c = ref(self.field)
        return c.isNotNull() & ~c.rlike(rf"\A(?:{self.pattern})\z")

    def settings(self) -> dict:
        return {"pattern": self.pattern}


@dataclass(frozen=True, eq=False)
class SchemaIs(Rule):
    expected: Schema
    exact: bool = True

    def static(self, schema: Schema) -> bool:
        shape = lambda s: [(f.name, f.type, f.nullable) for f in s]
        return shape(schema) == shape(self.expected) if self.exact else set(shape(self.expected)) <= set(shape(schema))

    def settings(self) -> dict:
        return {"expected": self.expected.encode(), "exact": self.exact}


@dataclass(frozen=True, eq=False)
class RowCount(Rule):
    min: int | None = None
    max: int | None = None

    def __post_init__(self) -> None:
        if self.min is None and self.max is None or any(b is not None and b < 0 for b in (self.min, self.max)) or None not in (self.min, self.max) and self.min > self.max:  # type: ignore[operator]
            raise PlanError("row_count needs bounds of zero or more, in order")

    def on_count(self, rows: int) -> bool:
        return self.min is not None and rows < self.min or self.max is not None and rows > self.max

    def settings(self) -> dict:
        return {"min": self.min, "max": self.max}


@dataclass(frozen=True, eq=False)
class Condition(Rule):
    """A boolean expression that must be TRUE; NULL breaks it."""

    condition: Expr

    def fields(self) -> tuple[str, ...]:
        return self.condition.columns()

    def check(self, schema: Schema) -> None:
        boolean(self.condition, schema, "a quality expression")

    def violation(self, schema: Schema) -> Column:
        return ~F.coalesce(column(self.condition, schema), F.lit(False))

    def settings(self) -> dict:
        return {"condition": describe(self.condition)}


@dataclass(frozen=True)
class ValidationSpec:
    rules: tuple[Rule, ...]
    policy: Policy = Policy.FAIL_FAST

    def __post_init__(self) -> None:
        if not self.rules:
            raise PlanError("a gate needs a rule, one at least")


def _limits(max_violations: int | None, max_violation_rate: float | None, name: str | None) -> dict:
    return {"threshold": Threshold(max_violations, max_violation_rate), "name": name}


def not_null(field: str, *, max_violations: int | None = 0, max_violation_rate: float | None = None, name: str | None = None) -> NotNull:
    return NotNull(field, **_limits(max_violations, max_violation_rate, name))


def unique(*fields: str, max_violations: int | None = 0, max_violation_rate: float | None = None, name: str | None = None) -> Unique:
    return Unique(fields, **_limits(max_violations, max_violation_rate, name))


def range_(field: str, min: object = None, max: object = None, *, include_min: bool = True, include_max: bool = True, max_violations: int | None = 0, max_violation_rate: float | None = None, name: str | None = None) -> Range:
    return Range(field, min, max, include_min, include_max, **_limits(max_violations, max_violation_rate, name))


def allowed_values(field: str, values: object, *, max_violations: int | None = 0, max_violation_rate: float | None = None, name: str | None = None) -> AllowedValues:
    return AllowedValues(field, tuple(values), **_limits(max_violations, max_violation_rate, name))  # type: ignore[call-overload]


def regex(field: str, pattern: str, *, max_violations: int | None = 0, max_violation_rate: float | None = None, name: str | None = None) -> Regex:
    return Regex(field, pattern, **_limits(max_violations, max_violation_rate, name))


def schema(expected: Schema, exact: bool = True, *, name: str | None = None) -> SchemaIs:
    return SchemaIs(expected, exact, name=name)


def row_count(min: int | None = None, max: int | None = None, *, name: str | None = None) -> RowCount:
    return RowCount(min, max, name=name)


def expression(condition: Expr, name: str | None = None, *, max_violations: int | None = 0, max_violation_rate: float | None = None) -> Condition:
    return Condition(condition, **_limits(max_violations, max_violation_rate, name))
