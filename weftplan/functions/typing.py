"""Static types of expressions under a schema."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal as PyDecimal

from ..errors import FunctionNotFoundError, SchemaError, TypingError
from ..schema import Schema
from ..types import BOOLEAN, DATE, FLOAT64, INT64, STRING, UNKNOWN, Boolean, DataType, Float, Integer, Timestamp, Unknown, decimal_of, is_numeric
from .expr import ARITHMETIC, COMPARISONS, Agg, Call, Col, Expr, Lit, Op
from .scalar import FUNCTIONS
from .window import AGGREGATES, RANKING, Over

Typed = tuple[DataType, bool]


def literal_type(e: Lit) -> Typed:
    if e.type is not None:
        return e.type, e.value is None
    match e.value:
        case None:
            return UNKNOWN, True
        case bool():
            return BOOLEAN, False
        case int():
            return INT64, False
        case float():
            return FLOAT64, False
        case str():
            return STRING, False
        case PyDecimal():
            return decimal_of(e.value), False
        case datetime():
            return Timestamp("us", str(e.value.tzinfo) if e.value.tzinfo else None), False
        case date():
            return DATE, False
    raise TypingError(f"a literal of {type(e.value).__name__} needs a type")


def arithmetic_type(op: str, a: DataType, b: DataType) -> DataType:
    for t in (a, b):
        if not isinstance(t, Integer | Float):
            raise TypingError(f"{ARITHMETIC[op]} takes integers and floats, not {t}")
    if op == "div":
        return FLOAT64
    if isinstance(a, Float) or isinstance(b, Float):
        return Float(max(t.bits if isinstance(t, Float) else 64 for t in (a, b)))
    return Integer(max(a.bits, b.bits), a.signed or b.signed)


def aggregate_type(name: str, arg: Typed | None) -> Typed:
    if name == "count":
        return INT64, False
    if arg is None:
        raise TypingError(f"{name} takes one argument")
    t = arg[0]
    match name:
        case "count_distinct":
            return INT64, False
        case "sum":
            if not is_numeric(t):
                raise TypingError(f"sum takes numbers, not {t}")
            return (Integer(64, t.signed) if isinstance(t, Integer) else t), True
        case "min" | "max":
            if isinstance(t, Unknown):
                raise TypingError(f"{name} of an untyped NULL")
            return t, True
        case "mean":
            if not is_numeric(t):
                raise TypingError(f"mean takes numbers, not {t}")
            return FLOAT64, True
    raise FunctionNotFoundError(f"no aggregate {name!r}")


def typed(e: Expr, schema: Schema, aggregates: bool = False, window: bool = False) -> Typed:
    """(type, nullable). Aggregates are allowed at the top of an aggregate step, windows at the top of a derive."""
    below = lambda x: typed(x, schema)
    match e:
        case Col(path=p):
            return schema.resolve(p)
        case Lit():
            return literal_type(e)
        case Op(op=op, args=args):
            types = [below(a) for a in args]
            nullable = any(n for _, n in types)
            if op in COMPARISONS:
                return BOOLEAN, nullable
            if op in ARITHMETIC:
                return arithmetic_type(op, types[0][0], types[1][0]), nullable
            if op in ("is_null", "not_null"):
                return BOOLEAN, False
            if op in ("and", "or", "not"):
                for t, _ in types:
                    if not isinstance(t, Boolean):
                        raise TypingError(f"{op} takes booleans, not {t}")
                return BOOLEAN, nullable
            if op == "neg":
                if not is_numeric(types[0][0]):
                    raise TypingError(f"- takes numbers, not {types[0][0]}")
                return types[0]
        case Call(name=name, args=args):
            if name not in FUNCTIONS:
                raise FunctionNotFoundError(f"no function {name!r}")
            return FUNCTIONS[name].typing(args, [below(a) for a in args])
        case Agg(name=name, arg=arg):
            if not aggregates:
                raise TypingError(f"{name} is an aggregate; it belongs in an aggregate step or over a window")
            return aggregate_type(name, None if arg is None else below(arg))
        case Over():
            if not window:
                raise TypingError(f"{e.name} over a window must be the whole expression of a derive")
            return window_type(e, schema)
    raise FunctionNotFoundError(f"no operator for {e!r}")


def window_type(e: Over, schema: Schema) -> Typed:
    for name in (*e.spec.partition, *(k.field for k in e.spec.order)):
        schema.field(name)
    frame = e.spec.frame
    if frame and frame.unit == "range" and any(not b.unbounded and b.offset for b in (frame.start, frame.end)):
        if len(e.spec.order) != 1 or not is_numeric(schema.field(e.spec.order[0].field).type):
            raise TypingError("a range frame with distances needs exactly one numeric order key")
    if e.name in RANKING:
        return INT64, False
    args = [typed(a, schema) for a in e.args]
    if e.name in AGGREGATES:
        return aggregate_type(e.name, args[0] if args else None)
    (t, nullable), = args
    if e.default is None:
        return t, True
    d, d_null = typed(e.default, schema)
    if not isinstance(d, Unknown) and d != t:
        raise TypingError(f"the default of {e.name} is {d}, its value {t}")
    return t, nullable or d_null


def boolean(e: Expr, schema: Schema, what: str) -> None:
    t, _ = typed(e, schema)
    if not isinstance(t, Boolean):
        raise SchemaError(f"{what} must be boolean, not {t}")


__all__ = ["typed", "window_type", "aggregate_type", "arithmetic_type", "literal_type", "boolean"]
