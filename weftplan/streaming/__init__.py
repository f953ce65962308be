"""Plans on Structured Streaming: the steps that run on a stream, started as a query."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..plans.compile import compile_plan, lower
from ..plans.plan import Plan
from ..runtime.capabilities import check
from ..schema import Schema

__all__ = ["read_stream", "start", "transform"]


def read_stream(spark: SparkSession, path: str, schema: Schema, form: str = "parquet", **options: Any) -> DataFrame:
    """A stream of the files that arrive in a folder."""
    return spark.readStream.schema(schema.to_spark()).options(**options).format(form).load(path)


def transform(plan: Plan, inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Outputs of a plan over streams (and static frames); steps that cannot run on a stream are refused beforehand."""
    compiled = compile_plan(plan)
    check(compiled, streaming=frozenset(n for n, df in inputs.items() if df.isStreaming))
    return lower(compiled, inputs)


def start(plan: Plan, inputs: dict[str, DataFrame], output: str, form: str, checkpoint: str, mode: str = "append", **options: Any):  # noqa: ANN201
    """Start one output as a streaming query; ``checkpoint`` is a folder that all executors share."""
    df = transform(plan, inputs)[output]
    return df.writeStream.format(form).outputMode(mode).option("checkpointLocation", checkpoint).options(**options).start()
