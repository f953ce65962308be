import os
from collections import Counter
from pathlib import Path

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def test_stages_by_hand(spark):
    import corpus_pipeline as p

    from test_components_simhash import union_find
    from test_models import features
    from test_similar import alike
    from test_text_dedup import passages_by_hand
    from weftplan.llm import mixing, packing
    from weftplan.llm.common import materialise

    assert [n for n, _ in p.STAGES] == ["quality rules", "SimHash near-dedup", "substring dedup", "mixing", "best-fit packing"]
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for name, stage in p.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SF), "t")
        assert docs.columns == columns, name
        kept.append({r.doc_id: r.text for r in docs.collect()})
    start = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    quality, near, lines, mixed = kept
    passes = {i for i, t in start.items() if features(t)[0] >= 50 and 100 * features(t)[4] <= 50 * features(t)[0]}
    assert set(quality) <= passes and len(quality) > 0.7 * len(passes)  # few labels there
    ids = sorted(quality)
    groups = union_find([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if alike(quality[a], quality[b])])
    assert set(near) == {i for i in ids if groups.get(i, i) == i}
    order = sorted(near.items())
    by_hand = {i: words for (i, before), (words, _) in zip(order, passages_by_hand(order)) if words or not before.split()}
    assert {i: t.encode().lower().decode().split() for i, t in lines.items()} == by_hand
    counts = Counter(r.doc_id for r in docs.collect())
    want = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(list(lines.items()), "doc_id long, text string"), spark.read.parquet(f"{SF}/labels.parquet")).collect() if r.copies}
    assert counts == want and set(mixed) <= set(lines)
    got = p.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(counts) and Counter(r.doc_id for r in got if r.piece == 0) == counts
    assert len({r.sequence_id for r in got}) <= 1.05 * sum(r.length for r in got) / 1024 + 2
    assert packing.pack(docs.limit(0)).count() == 0


def test_sql_of_operators(spark):
    duckdb = pytest.importorskip("duckdb")
    from test_queries import tidy

    from weftplan.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    for name, sql in ORACLE_SQL.items():
        df, want = QUERIES[name](spark, SF), con.sql(sql)
        assert tidy(df.columns, df.collect()) == tidy(want.columns, want.fetchall()), name
    assert [k.split("_")[0] for k in QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_stages_on_hard_rows(spark, hard_docs):
    import corpus_pipeline as p

    docs = hard_docs.selectExpr("doc_id", "text", "'en' lang", "component_id source", "cast(length(text) as long) n_chars", "score", "'x' rate", "'y' removed", "'z' kept", "cast(1 as int) copies", "'q' n_words", "'w' _w")
    total = docs.count()
    out = dict(p.STAGES)
    kept = out["quality rules"](spark, docs, SF)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= {4, 5, 10, 11}
    near = out["SimHash near-dedup"](spark, docs, SF)
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} >= {1, 2, 4, 8, 9, 10, None}
    lines = out["substring dedup"](spark, docs, SF)
    got = lines.collect()
    assert lines.columns == docs.columns and len(got) == total - 1 and all(r.n_chars == len(r.text) for r in got if r.text is not None)
    mixed = out["mixing"](spark, docs, SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in docs.collect()}
    assert out["best-fit packing"](spark, docs, SF).where("piece = 0").count() == total
    for name, stage in p.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
