"""Aggregates, for aggregate steps and (through ``.over``) windows."""

from __future__ import annotations

from .expr import Agg, Expr, as_expr


def count(x: Expr | None = None) -> Agg:
    """Rows, or non-null values of ``x``."""
    return Agg("count", None if x is None else as_expr(x))


def count_distinct(x: Expr) -> Agg:
    return Agg("count_distinct", as_expr(x))


def sum_(x: Expr) -> Agg:
    return Agg("sum", as_expr(x))


def min_(x: Expr) -> Agg:
    return Agg("min", as_expr(x))


def max_(x: Expr) -> Agg:
    return Agg("max", as_expr(x))


def mean(x: Expr) -> Agg:
    return Agg("mean", as_expr(x))


avg = mean
