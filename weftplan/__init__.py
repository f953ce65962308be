"""Typed transformation plans on Spark: declare, check, run as lazy DataFrames."""

from importlib import import_module
from typing import Any

__version__ = "0.1.0"

_EXPORTS = {
    "errors": ("WeftError",),
    "functions": ("Expr", "col", "lit"),
    "plans": ("Dataset", "LogicalPlan", "Optimizer", "Plan", "PlanBuilder", "analyse", "compile_plan"),
    "runtime": ("InputBinding", "OutputBinding", "Result", "Runtime"),
    "schema": ("Field", "Schema"),
    "sources": ("Resource",),
    "types": ("DataType",),
}
_HOME = {name: module for module, names in _EXPORTS.items() for name in names}

__all__ = sorted(_HOME)  # noqa: PLE0605


def __getattr__(name: str) -> Any:
    """Names load when they are first used, so that Python workers import no more than they need."""
    if name in _HOME:
        return getattr(import_module(f".{_HOME[name]}", __name__), name)
    raise AttributeError(name)
