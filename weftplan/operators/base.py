"""What every operator is, and the lazily evaluated frame that flows between them."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lowering import quoted
from ..functions.window import Key
from ..schema import Schema


@dataclass(frozen=True)
class Frame:
    """A DataFrame with its logical schema and, where a later step asks for it, its row order.

    Spark keeps no row order, so order is data: ``order`` names hidden columns (and their direction) that come after
    the schema's. They travel with rows and go at the output. ``settled``: the DataFrame itself is sorted that way.
    """

    df: DataFrame
    schema: Schema
    order: tuple[Key, ...] = ()
    settled: bool = False

    @property
    def columns(self) -> list[Column]:
        return [F.col(quoted(n)) for n in self.schema.names]

    @property
    def hidden(self) -> list[Column]:
        return [F.col(quoted(k.field)) for k in self.order]

    def with_columns(self, columns: list[Column], schema: Schema) -> Frame:
        """Same rows in the same order, other columns."""
        return replace(self, df=self.df.select(*columns, *self.hidden), schema=schema)

    def with_rows(self, df: DataFrame) -> Frame:
        return replace(self, df=df)

    def unordered(self, df: DataFrame, schema: Schema) -> Frame:
        return Frame(df, schema)

    def ordered(self) -> Frame:
        """With an order: its own, or one given now, the order in which Spark happens to read the rows."""
        if self.order:
            return self
        name = "__row"
        return replace(self, df=self.df.withColumn(name, F.monotonically_increasing_id()), order=(Key(name),))

    def output(self) -> DataFrame:
        return self.df.select(*self.columns) if self.order else self.df


@dataclass(frozen=True)
class Operator:
    """Base. ``arity`` inputs; static properties; ``resolve`` gives the output schema, ``lower`` the frame."""

    id: ClassVar[str] = ""
    arity: ClassVar[int] = 1
    capability: ClassVar[str] = ""
    #: one_to_one, filtering, expanding, reducing or combining.
    cardinality: ClassVar[str] = "one_to_one"
    deterministic: ClassVar[bool] = True
    #: Whether it also runs on a streaming DataFrame.
    streams: ClassVar[bool] = False

    @property
    def needs_order(self) -> bool:
        """Whether its result depends on the order of its input rows."""
        return False

    @property
    def keeps_order(self) -> bool:
        """Whether output rows follow the order of input rows, so that a later step's need passes through."""
        return True

    def capabilities(self, schemas: list[Schema]) -> set[str]:
        from ..runtime.capabilities import of_expressions

        return {self.capability} | of_expressions(self.expressions(), schemas[0])

    def expressions(self) -> tuple:
        return ()

    def resolve(self, *schemas: Schema) -> Schema:
        raise NotImplementedError

    def lower(self, out: Schema, *frames: Frame) -> Frame:
        raise NotImplementedError

    def describe(self) -> dict:
        """Settings as plain data."""
        raise NotImplementedError
