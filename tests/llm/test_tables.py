"""Intermediate tables go when an operator no longer needs them; what its result reads stays."""

import os

from weftplan.llm import embedding_dedup, line_dedup, similar, simhash, suffix_dedup
from weftplan.llm.common import materialise, scope, shared_dir


def tables(spark):
    return set(os.listdir(shared_dir(spark).removeprefix("file:")))


def test_scopes(spark):
    before = tables(spark)
    with scope():
        materialise(spark.range(3), "a")
        with scope():
            materialise(spark.range(3), "b")
            kept = materialise(spark.range(4), "c", keep=True)
        assert {x[0] for x in tables(spark) - before} == {"a", "c"} and kept.count() == 4
        last = materialise(spark.range(5), "d", keep=True)
    assert {x[0] for x in tables(spark) - before} == {"d"} and last.count() == 5


def test_operators_leave_what_they_need(spark, hard_docs):
    vectors = spark.createDataFrame([(i, [float(i % 3), 1.0], 0) for i in range(9)], "vec_id long, embedding array<double>, label int")
    for run, most in (
        (lambda: suffix_dedup.remove_repeated(hard_docs), 2),
        (lambda: line_dedup.remove_repeated(hard_docs), 2),
        (lambda: similar.near_duplicates(hard_docs), 3),
        (lambda: simhash.near_duplicates(hard_docs), 2),
        (lambda: embedding_dedup.near_duplicates(vectors), 1),
    ):
        before = tables(spark)
        out = run()
        assert len(tables(spark) - before) <= most and out.count()
