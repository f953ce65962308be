import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from weftplan.runtime import configure

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return configure(s)


@pytest.fixture
def run(spark):
    """Run one-output plans: run(build, name=DataFrame...), where build(b, inputs...) returns the last dataset."""
    from weftplan import PlanBuilder, Runtime, Schema

    def go(build, **frames):
        b = PlanBuilder("test")
        datasets = [b.input(n, Schema.from_spark(df.schema)) for n, df in frames.items()]
        b.output("out", build(b, *datasets))
        return Runtime(spark).execute(b.build(), frames).output()

    return go

