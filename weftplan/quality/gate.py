"""Evaluation of a gate: one aggregation for all row rules, one more for each set of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lowering import ref
from ..schema import Schema
from .evidence import GateResult, RuleResult
from .rules import Policy, ValidationSpec


def evaluate(gate: str, spec: ValidationSpec, df: DataFrame, schema: Schema) -> GateResult:
    """Evidence of all rules; under FAIL_FAST, up to the first one that fails. IGNORE evaluates nothing."""
    if spec.policy == Policy.IGNORE:
        return GateResult(gate, str(spec.policy), (), ignored=True)
    by_row = {i: v for i, r in enumerate(spec.rules) if (v := r.violation(schema)) is not None}
    rows, counts = None, {}
    if by_row or any(r.keys() or r.on_count(0) is not None for r in spec.rules):
        got = df.agg(F.count(F.lit(1)).alias("rows"), *(F.count_if(v).alias(f"r{i}") for i, v in by_row.items())).first()
        rows, counts = got["rows"], {i: got[f"r{i}"] for i in by_row}
    out = []
    for i, r in enumerate(spec.rules):
        if i in counts:
            bad, seen = counts[i], rows
        elif r.keys():
            # grouping, unlike count_distinct of several columns, counts keys with NULLs; one row for each key and task is shuffled
            bad, seen = rows - df.groupBy(*(ref(k).alias(f"k{j}") for j, k in enumerate(r.keys()))).agg(F.lit(1).alias("one")).count(), rows
        elif (broken := r.on_count(rows or 0)) is not None:
            bad, seen = int(broken), 1
        else:
            bad, seen = int(not r.static(schema)), 1
        out.append(RuleResult(r.label, bad, seen, r.threshold.holds(bad, seen)))
        if spec.policy == Policy.FAIL_FAST and not out[-1].passed:
            break
    return GateResult(gate, str(spec.policy), tuple(out))
