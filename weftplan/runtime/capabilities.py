"""What a plan asks for and what Spark offers, compared before any job runs."""

from __future__ import annotations

from collections.abc import Iterable
from enum import StrEnum

from ..errors import CapabilityError, WeftError
from ..functions.expr import Call, Col, Expr
from ..functions.scalar import FUNCTIONS
from ..functions.typing import typed
from ..functions.window import Over
from ..schema import Schema
from ..types import DataType, Decimal, Duration, List, Map, Struct, Time, Timestamp


class Capability(StrEnum):
    # The logical capabilities of an engine.
    SELECT = "select"
    DROP = "drop"
    RENAME = "rename"
    FILTER = "filter"
    LIMIT = "limit"
    DISTINCT = "distinct"
    CAST = "cast"
    DERIVE = "derive"
    SORT = "sort"
    DEDUPLICATE = "deduplicate"
    JOIN = "join"
    JOIN_INNER = "join_inner"
    JOIN_LEFT = "join_left"
    JOIN_RIGHT = "join_right"
    JOIN_FULL = "join_full"
    JOIN_SEMI = "join_semi"
    JOIN_ANTI = "join_anti"
    JOIN_CROSS = "join_cross"
    UNION = "union"
    INTERSECT = "intersect"
    EXCEPT = "except"
    AGGREGATE = "aggregate"
    WINDOW = "window"
    WINDOW_ROWS_CUMULATIVE = "window_rows_cumulative"
    WINDOW_ROWS_MOVING = "window_rows_moving"
    WINDOW_ROWS_ARBITRARY = "window_rows_arbitrary"
    WINDOW_RANGE = "window_range"
    PIVOT = "pivot"
    UNPIVOT = "unpivot"
    EXPLODE = "explode"
    FLATTEN = "flatten"
    NESTED = "nested"
    TEMPORAL = "temporal"
    DURATION = "duration"
    QUALITY = "quality"
    LAZY = "lazy"
    STREAMING = "streaming"
    PYTHON_UDF = "python_udf"


#: What plans can use on Spark; streams are checked step by step.
SPARK = frozenset(Capability) - {Capability.PYTHON_UDF}


def of_expressions(expressions: Iterable[Expr], schema: Schema) -> set[str]:
    out: set[str] = set()
    for top in expressions:
        for e in top.walk():
            if isinstance(e, Col) and "." in e.path:
                out.add(Capability.NESTED)
            if isinstance(e, Call) and e.name in FUNCTIONS and FUNCTIONS[e.name].temporal:
                out.add(Capability.TEMPORAL)
                if isinstance(typed(e, schema)[0], Duration):
                    out.add(Capability.DURATION)
            if isinstance(e, Over):
                out.add(Capability.WINDOW)
                if e.spec.frame:
                    out.add({"cumulative": Capability.WINDOW_ROWS_CUMULATIVE, "moving": Capability.WINDOW_ROWS_MOVING, "arbitrary": Capability.WINDOW_ROWS_ARBITRARY, "range": Capability.WINDOW_RANGE}[e.spec.frame.kind])
    return out


def required(plan) -> dict[str, frozenset[str]]:  # noqa: ANN001
    """Capabilities by step."""
    from ..plans.compile import compile_plan

    plan = compile_plan(plan)
    ids = {n.id: n for n in plan.nodes}
    return {n.name: frozenset(n.operator.capabilities([ids[i].schema for i in n.inputs])) for n in plan.nodes if n.operator is not None}


def representable(t: DataType) -> str | None:
    """Why Spark cannot hold a type; None if it can."""
    match t:
        case Decimal(p, _) if p > 38:
            return f"{t} has over 38 digits"
        case Time(unit) | Duration(unit) | Timestamp(unit, _) if unit == "ns":
            return f"{t} needs nanoseconds"
        case List(e, _):
            return representable(e)
        case Map(k, v, _):
            return representable(k) or representable(v)
        case Struct(members):
            return next((r for m in members if (r := representable(m.type))), None)
    return None


def check(plan, offered: Iterable[str] = SPARK, streaming: frozenset[str] = frozenset()) -> None:  # noqa: ANN001
    """Raise CapabilityError at the first step that asks for more. ``streaming``: names of inputs that are streams."""
    from ..plans.compile import compile_plan

    plan, offered = compile_plan(plan), set(offered)
    flowing: set[str] = set()
    needs = required(plan)
    for n in plan.nodes:
        for f in n.schema:
            if why := representable(f.type):
                raise CapabilityError(f"{n.name!r}, field {f.name!r}: {why}")
        if n.kind == "input" and n.name in streaming or any(i in flowing for i in n.inputs):
            flowing.add(n.id)
            if n.operator is not None and not n.operator.streams:
                raise CapabilityError(f"{n.name!r}: {n.operator.id} does not run on a stream")
        if n.operator is not None and (lacking := sorted(needs[n.name] - offered)):
            raise CapabilityError(f"{n.name!r} needs {lacking[0]!r}, which is not offered")


class Dimension(StrEnum):
    # The semantic dimensions of conformance.
    NULL_NAN = "null_nan"
    NUMERIC_PROMOTION = "numeric_promotion"
    DECIMAL = "decimal"
    TIMEZONE = "timezone"
    NESTED = "nested"
    UNICODE = "unicode"
    ORDERING = "ordering"
    DUPLICATES = "duplicates"
    EMPTY_DATA = "empty_data"
    JOINS = "joins"
    AGGREGATES = "aggregates"
    WINDOWS = "windows"
    QUALITY = "quality"
    LINEAGE = "lineage"
    SERIALIZATION = "serialization"
    CAPABILITY_FAILURE = "capability_failure"
    NO_HIDDEN_FALLBACK = "no_hidden_fallback"


#: The tests that hold each dimension; one without any is not claimed.
EVIDENCE: dict[Dimension, tuple[str, ...]] = {
    Dimension.NULL_NAN: ("test_rows.py::test_nan_is_not_null", "test_queries.py::test_query_equals_sql"),
    Dimension.NUMERIC_PROMOTION: ("test_typing.py::test_static_types",),
    Dimension.DECIMAL: ("test_rows.py::test_casts",),
    Dimension.TIMEZONE: ("test_window_reshape_temporal.py::test_time_zones",),
    Dimension.NESTED: ("test_window_reshape_temporal.py::test_unpivot_explode_flatten",),
    Dimension.UNICODE: ("test_conformance.py::test_unicode",),
    Dimension.ORDERING: ("test_rows.py::test_sort_limit_and_null_order",),
    Dimension.DUPLICATES: ("test_rows.py::test_limit_and_dedup_follow_input_order",),
    Dimension.EMPTY_DATA: ("test_conformance.py::test_empty_data",),
    Dimension.JOINS: ("test_relational.py::test_joins_match_nulls_by_default", "test_relational.py::test_never_match",),
    Dimension.AGGREGATES: ("test_relational.py::test_aggregates",),
    Dimension.WINDOWS: ("test_window_reshape_temporal.py::test_windows",),
    Dimension.QUALITY: ("test_quality.py::test_policies",),
    Dimension.LINEAGE: ("test_plans.py::test_lineage",),
    Dimension.SERIALIZATION: ("test_wire_yaml_cli_plugins.py::test_round_trip_is_canonical",),
    Dimension.CAPABILITY_FAILURE: ("test_plans.py::test_capabilities",),
    Dimension.NO_HIDDEN_FALLBACK: ("test_queries.py::test_plans_stay_in_the_jvm_and_push_down",),
}

#: Spark's profile.
CONFORMANCE = {d: "qualified" if EVIDENCE.get(d) else "unclaimed" for d in Dimension}

__all__ = ["CONFORMANCE", "Capability", "Dimension", "EVIDENCE", "SPARK", "WeftError", "check", "of_expressions", "representable", "required"]
