"""The operators of a plan: what each computes, its static schema and its DataFrame."""

from .base import Frame, Operator
from .relational import Except, Intersect, Join, JoinKind, NullMatch, Union
from .reshape import Explode, Flatten, Pivot, Unpivot
from .rows import Cast, CastPolicy, Deduplicate, Derive, Distinct, Drop, Filter, Keep, Limit, Rename, Select, Sort, SortKey
from .summary import Aggregate
from .quality import QualityGate

OPERATORS: dict[str, type[Operator]] = {
    c.id: c for c in (Select, Drop, Rename, Filter, Limit, Distinct, Cast, Derive, Sort, Deduplicate, Aggregate, Pivot, Unpivot, Explode, Flatten, QualityGate, Join, Union, Intersect, Except)
}

__all__ = ["Aggregate", "Cast", "CastPolicy", "Deduplicate", "Derive", "Distinct", "Drop", "Except", "Explode", "Filter", "Flatten", "Frame", "Intersect", "Join", "JoinKind", "Keep", "Limit", "NullMatch", "OPERATORS", "Operator", "Pivot", "QualityGate", "Rename", "Select", "Sort", "SortKey", "Union", "Unpivot"]
