"""Data-quality rules and gates."""

from .rules import AllowedValues, Condition, NotNull, Policy, Range, Regex, RowCount, Rule, SchemaIs, Threshold, Unique, ValidationSpec, allowed_values, expression, not_null, range_, regex, row_count, schema, unique
from .evidence import GateResult, RuleResult

__all__ = ["AllowedValues", "Condition", "GateResult", "NotNull", "Policy", "Range", "Regex", "RowCount", "Rule", "RuleResult", "SchemaIs", "Threshold", "Unique", "ValidationSpec", "allowed_values", "expression", "not_null", "range_", "regex", "row_count", "schema", "unique"]
