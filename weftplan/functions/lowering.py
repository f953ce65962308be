"""Expressions as Spark columns. All stay in the JVM; none is a Python function."""

from __future__ import annotations

from datetime import timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import Schema
from ..types import DataType, Integer, Timestamp, Unknown, to_spark
from .expr import Agg, Call, Col, Expr, Lit, Op
from .scalar import FUNCTIONS
from .typing import literal_type, typed
from .window import Bound, Key, Over


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ref(path: str) -> Column:
    root, *rest = path.split(".")
    c = F.col(quoted(root))
    for name in rest:
        c = c.getField(name)
    return c


def conform(c: Column, t: DataType) -> Column:
    """Cast to the type that the static rules promise; an unsigned one also checks its range."""
    if isinstance(t, Unknown):
        return c
    out = c.cast(to_spark(t))
    if isinstance(t, Integer) and not t.signed:
        top = str(2**t.bits - 1)
        low, high = F.lit(0), F.lit(top).cast("decimal(20,0)")
        out = F.when((out < low) | (out > high), F.raise_error(F.lit(f"value out of range of {t}"))).otherwise(out)
    return out


def literal(e: Lit) -> Column:
    t, _ = literal_type(e)
    if isinstance(t, Unknown):
        return F.lit(None)
    if isinstance(t, Timestamp) and t.timezone and getattr(e.value, "tzinfo", None) is not None:
        return F.lit(e.value.astimezone(timezone.utc).replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz").cast("timestamp")
    return conform(F.lit(e.value), t)


def division(a: Column, b: Column) -> Column:
    """IEEE division: a zero divisor gives an infinity or NaN, not an error."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(a.isNull(), None).when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def column(e: Expr, schema: Schema, tiebreak: tuple[Column, ...] = ()) -> Column:
    """``tiebreak``: what orders rows of equal keys, for windows whose result depends on it."""
    go = lambda x: column(x, schema)
    match e:
        case Col(path=p):
            return ref(p)
        case Lit():
            return literal(e)
        case Op(op=op, args=args):
            c = [go(a) for a in args]
            match op:
                case "eq":
                    return c[0] == c[1]
                case "ne":
                    return c[0] != c[1]
                case "lt":
                    return c[0] < c[1]
                case "le":
                    return c[0] <= c[1]
                case "gt":
                    return c[0] > c[1]
                case "ge":
                    return c[0] >= c[1]
                case "and":
                    return c[0] & c[1]
                case "or":
                    return c[0] | c[1]
                case "not":
                    return ~c[0]
                case "is_null":
                    return c[0].isNull()
                case "not_null":
                    return c[0].isNotNull()
                case "neg":
                    return conform(-c[0], typed(e, schema)[0])
                case "div":
                    return division(*c)
            t = typed(e, schema)[0]
            if isinstance(t, Integer) and not t.signed:  # wider than its range, so that the guard can see it
                a, b = (x.cast("decimal(20,0)") for x in c)
            else:
                a, b = (conform(x, t) for x in c)
            return conform({"add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b}[op](), t)
        case Call(name=name, args=args):
            return FUNCTIONS[name].lower([go(a) for a in args], args, [typed(a, schema) for a in args])
        case Agg():
            return aggregate(e, schema)
        case Over():
            return over(e, schema, tiebreak)
    raise TypeError(e)


def aggregate(e: Agg, schema: Schema, only: Column | None = None) -> Column:
    """An aggregate; ``only`` restricts it to rows where that is true."""
    t = typed(e, schema, aggregates=True)[0]
    x = F.lit(1) if e.arg is None else column(e.arg, schema)
    if only is not None:
        x = F.when(only, x)
    match e.name:
        case "count":
            return F.count(x)
        case "count_distinct":
            return F.count_distinct(x)
        case "sum":
            out = F.sum(x)
        case "min":
            out = F.min(x)
        case "max":
            out = F.max(x)
        case "mean":
            out = F.avg(x.cast("double"))
    return conform(out, t)


def order_column(k: Key, c: Column | None = None) -> Column:
    c = F.col(quoted(k.field)) if c is None else c
    if k.descending:
        return c.desc_nulls_first() if k.nulls_first else c.desc_nulls_last()
    return c.asc_nulls_first() if k.nulls_first else c.asc_nulls_last()


def over(e: Over, schema: Schema, tiebreak: tuple[Column, ...] = ()) -> Column:
    w = Window.partitionBy(*(F.col(quoted(n)) for n in e.spec.partition)) if e.spec.partition else Window.partitionBy()
    keys = [order_column(k) for k in e.spec.order]
    if keys:
        w = w.orderBy(*keys, *(tiebreak if e.by_row_order else ()))
    t = typed(e, schema, window=True)[0]
    if e.name in ("row_number", "rank", "dense_rank"):
        return getattr(F, e.name)().over(w).cast("long")
    if e.name in ("lag", "lead"):
        args = [column(e.args[0], schema), F.lit(e.offset)]
        if e.default is not None:
            args.append(conform(column(e.default, schema), t))
        return F.call_function(e.name, *args).over(w)

    def edge(b: Bound) -> int:
        return {-1: Window.unboundedPreceding, 0: b.offset, 1: Window.unboundedFollowing}[b.unbounded]

    if e.spec.frame is not None:
        w = (w.rowsBetween if e.spec.frame.unit == "rows" else w.rangeBetween)(edge(e.spec.frame.start), edge(e.spec.frame.end))
    elif keys:  # no frame: the whole partition, ordered or not
        w = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return conform(folded(e, schema).over(w), t)


def folded(e: Over, schema: Schema) -> Column:
    """The aggregate of a window aggregate."""
    x = F.lit(1) if not e.args else column(e.args[0], schema)
    f = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg}[e.name]
    return f(x.cast("double") if e.name == "mean" else x)


def of_all_rows(e: Over, schema: Schema, df: DataFrame) -> Column:
    """A window aggregate over the whole table as a subquery of one row: partial aggregates instead of one task for all rows."""
    whole = df.select(folded(e, schema).alias("x")).scalar()
    return conform(F.coalesce(whole, F.lit(0)) if e.name == "count" else whole, typed(e, schema, window=True)[0])


__all__ = ["aggregate", "column", "conform", "division", "literal", "of_all_rows", "order_column", "over", "quoted", "ref"]
