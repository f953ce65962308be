"""Window specifications and window functions."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import TypingError
from .expr import Agg, Expr, as_expr, node


@dataclass(frozen=True)
class Key:
    """An order key of a window."""

    field: str
    descending: bool = False
    nulls_first: bool = False


def asc(field: str, nulls_first: bool = False) -> Key:
    return Key(field, False, nulls_first)


def desc(field: str, nulls_first: bool = False) -> Key:
    return Key(field, True, nulls_first)


@dataclass(frozen=True)
class Bound:
    """Rows (or key distance) from the current one; negative precedes; ``unbounded`` is -1 or 1 for either end."""

    offset: int = 0
    unbounded: int = 0

    @property
    def rank(self) -> tuple[int, int]:
        return self.unbounded, self.offset


CURRENT_ROW, UNBOUNDED_PRECEDING, UNBOUNDED_FOLLOWING = Bound(), Bound(unbounded=-1), Bound(unbounded=1)


def _distance(n: int) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise TypingError("a frame bound is a whole number, zero or more")
    return n


def preceding(n: int) -> Bound:
    return Bound(-_distance(n))


def following(n: int) -> Bound:
    return Bound(_distance(n))


@dataclass(frozen=True)
class Frame:
    unit: str  # "rows" or "range"
    start: Bound
    end: Bound

    def __post_init__(self) -> None:
        if self.unit not in ("rows", "range") or self.start.unbounded > 0 or self.end.unbounded < 0 or self.start.rank > self.end.rank:
            raise TypingError("a frame starts at or before its end")

    @property
    def kind(self) -> str:
        """cumulative, moving, arbitrary or range."""
        if self.unit == "range":
            return "range"
        if self.end == CURRENT_ROW and self.start == UNBOUNDED_PRECEDING:
            return "cumulative"
        if self.end == CURRENT_ROW and not self.start.unbounded:
            return "moving"
        return "arbitrary"


@dataclass(frozen=True)
class WindowSpec:
    partition: tuple[str, ...] = ()
    order: tuple[Key, ...] = ()
    frame: Frame | None = None

    def partition_by(self, *names: str) -> WindowSpec:
        return WindowSpec(names, self.order, self.frame)

    def order_by(self, *keys: str | Key) -> WindowSpec:
        return WindowSpec(self.partition, tuple(k if isinstance(k, Key) else Key(k) for k in keys), self.frame)

    def rows_between(self, start: Bound, end: Bound) -> WindowSpec:
        return WindowSpec(self.partition, self.order, Frame("rows", start, end))

    def range_between(self, start: Bound, end: Bound) -> WindowSpec:
        return WindowSpec(self.partition, self.order, Frame("range", start, end))

    def describe(self) -> dict:
        out: dict = {"partition": list(self.partition), "order": [[k.field, k.descending, k.nulls_first] for k in self.order]}
        if self.frame:
            out["frame"] = [self.frame.unit, *self.frame.start.rank, *self.frame.end.rank]
        return out


def partition_by(*names: str) -> WindowSpec:
    return WindowSpec().partition_by(*names)


def order_by(*keys: str | Key) -> WindowSpec:
    return WindowSpec().order_by(*keys)


RANKING, OFFSET, AGGREGATES = ("row_number", "rank", "dense_rank"), ("lag", "lead"), ("count", "sum", "min", "max", "mean")


@node
class Over(Expr):
    """A window function with its window."""

    name: str
    args: tuple[Expr, ...]
    spec: WindowSpec
    offset: int = 1
    default: Expr | None = None

    def __post_init__(self) -> None:
        if self.name not in RANKING + OFFSET + AGGREGATES:
            raise TypingError(f"{self.name} is no window function")
        if self.name in RANKING + OFFSET:
            if not self.spec.order:
                raise TypingError(f"{self.name} needs an order")
            if self.spec.frame and self.name in RANKING:
                raise TypingError(f"{self.name} takes no frame")
        if self.spec.frame and not self.spec.order:
            raise TypingError("a frame needs an order")

    @property
    def children(self) -> tuple[Expr, ...]:
        return self.args + (() if self.default is None else (self.default,))

    def _own_columns(self) -> tuple[str, ...]:
        return (*self.spec.partition, *(k.field for k in self.spec.order))

    @property
    def by_row_order(self) -> bool:
        """Whether rows with equal order keys can be told apart in its result."""
        return self.name in ("row_number", *OFFSET) or self.spec.frame is not None and self.spec.frame.unit == "rows"

    @property
    def whole_table(self) -> bool:
        """Whether it is one value for all rows: an aggregate of the one partition, ordered or not."""
        f = self.spec.frame
        return self.name in AGGREGATES and not self.spec.partition and (f is None or bool(f.start.unbounded and f.end.unbounded))


@dataclass(frozen=True)
class Unbound:
    """A ranking or offset function before ``.over``."""

    name: str
    args: tuple[Expr, ...] = ()
    offset: int = 1
    default: Expr | None = None

    def over(self, spec: WindowSpec) -> Over:
        return Over(self.name, self.args, spec, self.offset, self.default)


def row_number() -> Unbound:
    return Unbound("row_number")


def rank() -> Unbound:
    return Unbound("rank")


def dense_rank() -> Unbound:
    return Unbound("dense_rank")


def _offset(name: str, value: Expr, offset: int, default: object) -> Unbound:
    if isinstance(offset, bool) or not isinstance(offset, int) or offset < 1:
        raise TypingError(f"{name} needs an offset of one or more")
    return Unbound(name, (as_expr(value),), offset, None if default is None else as_expr(default))


def lag(value: Expr, offset: int = 1, default: object = None) -> Unbound:
    """The value ``offset`` rows before; ``default`` only outside the partition."""
    return _offset("lag", value, offset, default)


def lead(value: Expr, offset: int = 1, default: object = None) -> Unbound:
    return _offset("lead", value, offset, default)


def count(x: Expr | None = None) -> Agg:
    return Agg("count", None if x is None else as_expr(x))


def sum_(x: Expr) -> Agg:
    return Agg("sum", as_expr(x))


def min_(x: Expr) -> Agg:
    return Agg("min", as_expr(x))


def max_(x: Expr) -> Agg:
    return Agg("max", as_expr(x))


def mean(x: Expr) -> Agg:
    return Agg("mean", as_expr(x))


avg = mean
