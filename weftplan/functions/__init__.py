"""Expressions and everything that builds them."""

from .aggregates import avg, count, count_distinct, max_, mean, min_, sum_
from .expr import Expr, col, lit
from .scalar import FUNCTIONS, concat, convert_timezone, day, duration_between, hour, lower, minute, month, normalize_timestamp, second, to_date, trim, upper, year

__all__ = ["Expr", "FUNCTIONS", "avg", "col", "concat", "convert_timezone", "count", "count_distinct", "day", "duration_between", "hour", "lit", "lower", "max_", "mean", "min_", "minute", "month", "normalize_timestamp", "second", "sum_", "to_date", "trim", "upper", "year"]
