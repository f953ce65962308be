"""DataFrames to and from Arrow and pandas, with a word on what a conversion can lose."""

from __future__ import annotations

from dataclasses import dataclass
from enum import StrEnum
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import SchemaError
from ..schema import Schema
from ..types import DataType, Date, Decimal, Duration, Integer, List, Map, Struct, Time


class Fidelity(StrEnum):
    STRICT = "strict"
    ALLOW_POTENTIALLY_LOSSY = "allow_potentially_lossy"


@dataclass(frozen=True)
class Loss:
    field: str
    reason: str


def losses_to_pandas(schema: Schema) -> tuple[Loss, ...]:
    """Fields that pandas holds as plain objects or by another type."""
    why: dict[type[DataType], str] = {Decimal: "decimals become objects", Date: "dates become objects", Time: "times become objects", List: "lists become objects", Struct: "structs become dictionaries", Map: "maps become dictionaries", Duration: "durations become nanoseconds"}
    out = [Loss(f.name, why[type(f.type)]) for f in schema if type(f.type) in why]
    out += [Loss(f.name, "NULL turns integers into floats") for f in schema if isinstance(f.type, Integer) and f.nullable]
    return tuple(out)


def to_arrow(df: DataFrame):  # noqa: ANN201
    """An Arrow table on the driver; meant for results of a size that fits there."""
    return df.toArrow()


def to_pandas(df: DataFrame, fidelity: Fidelity = Fidelity.STRICT) -> tuple[Any, tuple[Loss, ...]]:
    """(pandas frame, what it may have lost); STRICT refuses a conversion that can lose anything."""
    losses = losses_to_pandas(Schema.from_spark(df.schema))
    if losses and fidelity == Fidelity.STRICT:
        raise SchemaError(f"pandas cannot hold {losses[0].field!r} as it is: {losses[0].reason}")
    return df.toPandas(), losses


def from_arrow(spark: SparkSession, table: Any, schema: Schema | None = None) -> DataFrame:
    """A DataFrame of an Arrow table; nanosecond columns are refused unless a schema says otherwise."""
    import pyarrow as pa

    if schema is None:
        for f in table.schema:
            if pa.types.is_timestamp(f.type) and f.type.unit == "ns" or pa.types.is_time64(f.type) and f.type.unit == "ns" or pa.types.is_duration(f.type) and f.type.unit == "ns":
                raise SchemaError(f"{f.name!r} needs nanoseconds, Spark keeps microseconds")
    return spark.createDataFrame(table, schema.to_spark()) if schema else spark.createDataFrame(table)


def from_pandas(spark: SparkSession, frame: Any, schema: Schema) -> DataFrame:
    return spark.createDataFrame(frame, schema.to_spark())


__all__ = ["Fidelity", "Loss", "from_arrow", "from_pandas", "losses_to_pandas", "to_arrow", "to_pandas"]
