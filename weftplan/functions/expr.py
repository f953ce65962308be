"""The expression tree: immutable values, compared by :func:`same`, built with operators."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal as PyDecimal
from typing import Any

from ..errors import TypingError
from ..types import DataType, encode

COMPARISONS = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
ARITHMETIC = {"add": "+", "sub": "-", "mul": "*", "div": "/"}


class Expr:
    """Base of all expressions. ``==`` and its kind build expressions, so truth and hashing go by identity."""

    def _two(self, op: str, other: Any) -> Op:
        return Op(op, (self, other if isinstance(other, Expr) else Lit(other)))

    def __eq__(self, other: Any) -> Op:  # type: ignore[override]
        return self._two("eq", other)

    def __ne__(self, other: Any) -> Op:  # type: ignore[override]
        return self._two("ne", other)

    def __lt__(self, other: Any) -> Op:
        return self._two("lt", other)

    def __le__(self, other: Any) -> Op:
        return self._two("le", other)

    def __gt__(self, other: Any) -> Op:
        return self._two("gt", other)

    def __ge__(self, other: Any) -> Op:
        return self._two("ge", other)

    def __add__(self, other: Any) -> Op:
        return self._two("add", other)

    def __sub__(self, other: Any) -> Op:
        return self._two("sub", other)

    def __mul__(self, other: Any) -> Op:
        return self._two("mul", other)

    def __truediv__(self, other: Any) -> Op:
        return self._two("div", other)

    def __and__(self, other: Any) -> Op:
        return self._two("and", other)

    def __or__(self, other: Any) -> Op:
        return self._two("or", other)

    def __invert__(self) -> Op:
        return Op("not", (self,))

    def __neg__(self) -> Op:
        return Op("neg", (self,))

    def is_null(self) -> Op:
        return Op("is_null", (self,))

    def is_not_null(self) -> Op:
        return Op("not_null", (self,))

    def __bool__(self) -> bool:
        raise TypingError("an expression has no truth value; use &, | and ~")

    __hash__ = object.__hash__

    @property
    def children(self) -> tuple[Expr, ...]:
        return ()

    def walk(self) -> Iterator[Expr]:
        yield self
        for c in self.children:
            yield from c.walk()

    def columns(self) -> tuple[str, ...]:
        """Paths of all columns that it reads, each once, in order."""
        return tuple(dict.fromkeys(p for e in self.walk() for p in e._own_columns()))

    def _own_columns(self) -> tuple[str, ...]:
        return ()

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(describe(self), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def node(cls):  # noqa: ANN001, ANN201
    return dataclass(frozen=True, eq=False)(cls)


@node
class Col(Expr):
    path: str

    def __post_init__(self) -> None:
        if not isinstance(self.path, str) or any(not p.strip() for p in self.path.split(".")):
            raise TypingError(f"{self.path!r} is no column path")

    def _own_columns(self) -> tuple[str, ...]:
        return (self.path,)


@node
class Lit(Expr):
    value: Any
    type: DataType | None = None


@node
class Op(Expr):
    op: str
    args: tuple[Expr, ...]

    @property
    def children(self) -> tuple[Expr, ...]:
        return self.args


@node
class Call(Expr):
    name: str
    args: tuple[Expr, ...]

    @property
    def children(self) -> tuple[Expr, ...]:
        return self.args


@node
class Agg(Expr):
    name: str
    arg: Expr | None = None

    @property
    def children(self) -> tuple[Expr, ...]:
        return () if self.arg is None else (self.arg,)

    def over(self, spec) -> Expr:  # noqa: ANN001
        from .window import Over

        return Over(self.name, () if self.arg is None else (self.arg,), spec)


def col(path: str) -> Col:
    """A column; dots go into structs."""
    return Col(path)


def lit(value: Any, type: DataType | None = None) -> Lit:
    return Lit(value, type)


def as_expr(x: Any) -> Expr:
    return x if isinstance(x, Expr) else Lit(x)


def plain(value: Any) -> Any:
    """A literal's value as tagged plain data."""
    match value:
        case None | bool() | str():
            return value
        case int():
            return {"int": str(value)}
        case float():
            return {"float": value.hex()}
        case PyDecimal():
            return {"decimal": str(value)}
        case datetime():
            return {"datetime": value.isoformat(), "timezone": str(value.tzinfo) if value.tzinfo else None}
        case date():
            return {"date": value.isoformat()}
        case bytes():
            return {"bytes": value.hex()}
    raise TypingError(f"no literal of {type(value).__name__}")


def describe(e: Expr) -> dict:
    """An expression as plain data; equal data, equal meaning."""
    from .window import Over

    match e:
        case Col(path=p):
            return {"col": p}
        case Lit(value=v, type=t):
            return {"lit": plain(v)} | ({"type": encode(t)} if t else {})
        case Op(op=o, args=a):
            return {"op": o, "args": [describe(x) for x in a]}
        case Call(name=n, args=a):
            return {"call": n, "args": [describe(x) for x in a]}
        case Agg(name=n, arg=a):
            return {"agg": n, "args": [] if a is None else [describe(a)]}
        case Over(name=n, args=a, spec=s, offset=k, default=d):
            return {"over": n, "args": [describe(x) for x in a], "window": s.describe()} | ({"offset": k} if n in ("lag", "lead") else {}) | ({"default": describe(d)} if d is not None else {})
    raise TypingError(f"{type(e).__name__} is no expression")


def same(a: Expr, b: Expr) -> bool:
    return describe(a) == describe(b)
