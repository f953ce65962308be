import pyarrow as pa
import pytest
from helpers import rows

from weftplan import Schema, col
from weftplan import functions as fn
from weftplan import types as t
from weftplan.errors import SchemaError
from weftplan.plans import Pipeline
from weftplan.sources.interchange import Fidelity, from_arrow, from_pandas, losses_to_pandas, to_arrow, to_pandas


def test_arrow_and_pandas(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b")], "i long, s string")
    assert to_arrow(df).to_pylist() == [{"i": 1, "s": "a"}, {"i": None, "s": "b"}]
    assert rows(from_arrow(spark, to_arrow(df))) == rows(df)
    with pytest.raises(SchemaError):
        to_pandas(df)
    frame, losses = to_pandas(df, Fidelity.ALLOW_POTENTIALLY_LOSSY)
    assert len(frame) == 2 and [x.field for x in losses] == ["i"]
    assert rows(from_pandas(spark, frame[["s"]], Schema.of(("s", t.STRING)))) == [("a",), ("b",)]
    assert not losses_to_pandas(Schema.of(("i", t.INT64, False), ("s", t.STRING)))
    with pytest.raises(SchemaError):
        from_arrow(spark, pa.table({"x": pa.array([1], pa.timestamp("ns"))}))


def test_pipeline(spark):
    df = spark.createDataFrame([(1, " A "), (2, None), (3, "b")], "i long, s string")
    p = Pipeline("p", Schema.from_spark(df.schema)).filter(col("s").is_not_null()).derive("t", fn.lower(fn.trim(col("s")))).sort(["i"], descending=True).limit(1).select(["t"])
    assert rows(p.run(spark, df)) == [("b",)]
    with pytest.raises(SchemaError):
        p.select(["zz"])
    with pytest.raises(AttributeError):
        p.join
