"""A fluent facade for plans of one input, one chain of steps and one output."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..schema import Schema
from .builder import PlanBuilder
from .plan import Plan


class Pipeline:
    """``Pipeline("p", schema).filter(...).select([...]).run(spark, df)``: builder steps without names or sources."""

    STEPS = ("select", "drop", "rename", "filter", "limit", "distinct", "cast", "derive", "sort", "deduplicate", "aggregate", "pivot", "unpivot", "explode", "flatten", "validate")

    def __init__(self, name: str, schema: Schema, steps: tuple[tuple[str, tuple, dict], ...] = ()):
        self.name, self.schema, self.steps = name, schema, steps

    def __getattr__(self, step: str):  # noqa: ANN204
        if step not in self.STEPS:
            raise AttributeError(step)

        def add(*args: Any, **kw: Any) -> Pipeline:
            out = Pipeline(self.name, self.schema, (*self.steps, (step, args, kw)))
            out.plan()  # checks the step against the schema so far
            return out

        return add

    def plan(self) -> Plan:
        b = PlanBuilder(self.name)
        at = b.input("input", self.schema)
        for i, (step, args, kw) in enumerate(self.steps):
            at = getattr(b, step)(f"{i + 1}. {step}", at, *args, **kw)
        b.output("output", at)
        return b.build()

    def run(self, spark: SparkSession, df: DataFrame) -> DataFrame:
        from ..runtime import Runtime

        return Runtime(spark).execute(self.plan(), {"input": df}).output()
