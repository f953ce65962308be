"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import drop_table, materialise

#: Far more than the logarithm of any number of nodes; beyond them an error is raised, never a part of the result given.
ROUNDS = 200


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links ``a[i]-b[i]`` of one task reduced to one link for each node, to the smallest node of its part."""
    nodes, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = idx[: len(a)], idx[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each node of a link, the smallest node that it reaches. Links are longs, any direction.

    Null ends and self-links are ignored; an empty table gives an empty result. Every half step is one aggregation
    with map-side combination and one join of plain exchanges, which adaptive execution can split on a hot node;
    its result is a table in the shared folder. Only a count and a checksum reach the driver.
    """
    edges = materialise(
        links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "edges",
    )

    def step(edges: DataFrame, large: bool, k: int) -> tuple[DataFrame, tuple]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        # coalesce() hides the aggregation's partitioning, so the join below gets an exchange of its own on either side
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(100_000)
        seen = both.join(low, "u")
        if large:
            out = seen.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = seen.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        out = out.where(F.col("u") != F.col("v")).distinct()
        seen = Observation(f"star-{k}-{large}")
        out = materialise(out.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")), "edges")
        got = seen.get
        return out, (got["n"], got["h"])

    was: tuple | None = None
    for k in range(ROUNDS):
        new, n = step(edges, True, k)
        drop_table(edges)
        if n[0] == 0:
            edges = new
            break
        edges, now = step(new, False, k)
        drop_table(new)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
