"""Every query against its SQL on the smallest tables, and the driver contract."""

import decimal
import importlib
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[1]
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
duckdb = pytest.importorskip("duckdb")

from weftplan.queries import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def tidy(columns, rows):
    def text(v):
        return format(v.normalize(), "f") if isinstance(v, decimal.Decimal) else f"{v:.9g}" if isinstance(v, float) else str(v)

    places = [list(columns).index(c) for c in sorted(columns)]
    return sorted(tuple(text(r[i]) for i in places) for r in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in ORACLES:
        assert got
        return
    want = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert tidy(df.columns, got) == tidy(want.columns, want.fetchall())


def test_plans_stay_in_the_jvm_and_push_down(spark):
    for name in ("customer_360", "win_moving", "pivot_sum", "join_full", "dedup_after_sort"):
        text = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "Arrow" not in text
    text = QUERIES["parquet_pushdown"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in text and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in text


def test_entry(spark):
    sys.path.insert(0, str(ROOT))
    e = importlib.import_module("__spark_entry__")
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_everything_else_works_without_the_text_operators(tmp_path):
    for p in ("weftplan", "__spark_entry__.py"):
        (shutil.copytree if (ROOT / p).is_dir() else shutil.copy)(ROOT / p, tmp_path / p)
    shutil.rmtree(tmp_path / "weftplan" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'customer_360' in q and 'pipeline' not in q and not any(k.startswith('op1_') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    # what is there and cannot be imported is not passed over
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True).returncode
