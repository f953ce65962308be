"""Scalar functions: for each its builder, its static type and its Spark column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import TypingError
from ..types import DATE, INT32, STRING, UNITS, DataType, Date, Duration, String, Time, Timestamp
from .expr import Call, Expr, Lit, as_expr

Typed = tuple[DataType, bool]

#: White space that trim removes: Unicode's white space and the four separators of ASCII.
WHITESPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


@dataclass(frozen=True)
class Function:
    """``typing`` gets the argument expressions and their types; ``lower`` gets columns, expressions and types."""

    typing: Callable[[tuple[Expr, ...], list[Typed]], Typed]
    lower: Callable[[list[Column], tuple[Expr, ...], list[Typed]], Column]
    temporal: bool = False


FUNCTIONS: dict[str, Function] = {}


def _strings(name: str, least: int, most: int | None):  # noqa: ANN202
    def rule(args: tuple[Expr, ...], types: list[Typed]) -> Typed:
        if len(args) < least or most is not None and len(args) > most:
            raise TypingError(f"{name} takes {least}{'' if most == least else ' or more'} argument{'s' if least > 1 else ''}")
        for t, _ in types:
            if not isinstance(t, String):
                raise TypingError(f"{name} takes strings, not {t}")
        return STRING, any(n for _, n in types)

    return rule


FUNCTIONS["lower"] = Function(_strings("lower", 1, 1), lambda c, e, t: F.lower(c[0]))
FUNCTIONS["upper"] = Function(_strings("upper", 1, 1), lambda c, e, t: F.upper(c[0]))
FUNCTIONS["trim"] = Function(_strings("trim", 1, 1), lambda c, e, t: F.btrim(c[0], F.lit(WHITESPACE)))
FUNCTIONS["concat"] = Function(_strings("concat", 1, None), lambda c, e, t: F.concat(*c))


def wall_clock(c: Column, t: DataType) -> Column:
    """The local time that a timestamp column shows, in its own zone."""
    return F.from_utc_timestamp(c, t.timezone) if isinstance(t, Timestamp) and t.timezone else c


def _part(name: str, kinds: tuple[type, ...], take: Callable[[Column], Column]) -> None:
    def rule(args: tuple[Expr, ...], types: list[Typed]) -> Typed:
        if len(types) != 1 or not isinstance(types[0][0], kinds):
            raise TypingError(f"{name} takes one {' or '.join(k.__name__.lower() for k in kinds)}")
        return INT32, types[0][1]

    FUNCTIONS[name] = Function(rule, lambda c, e, t: take(wall_clock(c[0], t[0][0])).cast("int"), temporal=True)


for _name, _take in (("year", F.year), ("month", F.month), ("day", F.dayofmonth)):
    _part(_name, (Date, Timestamp), _take)
for _name, _take in (("hour", F.hour), ("minute", F.minute), ("second", F.second)):
    _part(_name, (Time, Timestamp), _take)


def _to_date(args: tuple[Expr, ...], types: list[Typed]) -> Typed:
    if len(types) != 1 or not isinstance(types[0][0], Date | Timestamp):
        raise TypingError("to_date takes one date or timestamp")
    return DATE, types[0][1]


FUNCTIONS["to_date"] = Function(_to_date, lambda c, e, t: F.to_date(wall_clock(c[0], t[0][0])), temporal=True)


def _word(e: Expr, what: str) -> str:
    if not isinstance(e, Lit) or not isinstance(e.value, str) or not e.value.strip():
        raise TypingError(f"{what} must be a string literal")
    return e.value


def _unit(e: Expr) -> str:
    unit = _word(e, "a unit")
    if unit not in UNITS:
        raise TypingError(f"unit {unit!r} is none of {', '.join(UNITS)}")
    return unit


def _normalize(args: tuple[Expr, ...], types: list[Typed]) -> Typed:
    if len(args) != 3 or not isinstance(types[0][0], Timestamp):
        raise TypingError("normalize_timestamp takes a timestamp, a zone and a unit")
    return Timestamp(_unit(args[2]), _word(args[1], "a time zone")), types[0][1]


FUNCTIONS["normalize_timestamp"] = Function(_normalize, lambda c, e, t: F.to_utc_timestamp(wall_clock(c[0], t[0][0]).cast("timestamp"), e[1].value), temporal=True)


def _convert(args: tuple[Expr, ...], types: list[Typed]) -> Typed:
    if len(args) != 2 or not isinstance(types[0][0], Timestamp) or not types[0][0].timezone:
        raise TypingError("convert_timezone takes a timestamp with a time zone, and a zone")
    return Timestamp(types[0][0].unit, _word(args[1], "a time zone")), types[0][1]


FUNCTIONS["convert_timezone"] = Function(_convert, lambda c, e, t: c[0], temporal=True)


def _between(args: tuple[Expr, ...], types: list[Typed]) -> Typed:
    if len(args) != 3 or not all(isinstance(t, Timestamp) for t, _ in types[:2]):
        raise TypingError("duration_between takes two timestamps and a unit")
    if bool(types[0][0].timezone) != bool(types[1][0].timezone):
        raise TypingError("duration_between takes timestamps with a zone or without, not both")
    return Duration(_unit(args[2])), types[0][1] or types[1][1]


FUNCTIONS["duration_between"] = Function(_between, lambda c, e, t: c[1] - c[0], temporal=True)


def _call(name: str, *args: object) -> Call:
    return Call(name, tuple(as_expr(a) for a in args))


def lower(x: Expr) -> Call:
    return _call("lower", x)


def upper(x: Expr) -> Call:
    return _call("upper", x)


def trim(x: Expr) -> Call:
    """Without white space at either end."""
    return _call("trim", x)


def concat(*xs: Expr) -> Call:
    """NULL if any part is."""
    return _call("concat", *xs)


def year(x: Expr) -> Call:
    return _call("year", x)


def month(x: Expr) -> Call:
    return _call("month", x)


def day(x: Expr) -> Call:
    return _call("day", x)


def hour(x: Expr) -> Call:
    return _call("hour", x)


def minute(x: Expr) -> Call:
    return _call("minute", x)


def second(x: Expr) -> Call:
    return _call("second", x)


def to_date(x: Expr) -> Call:
    return _call("to_date", x)


def normalize_timestamp(x: Expr, timezone: str = "UTC", unit: str = "us") -> Call:
    """Attach a zone to the wall clock, whatever zone it had."""
    return _call("normalize_timestamp", x, timezone, unit)


def convert_timezone(x: Expr, timezone: str) -> Call:
    """The same instant, shown in another zone."""
    return _call("convert_timezone", x, timezone)


def duration_between(start: Expr, end: Expr, unit: str = "us") -> Call:
    """``end`` less ``start``."""
    return _call("duration_between", start, end, unit)
