"""Embedding near-duplicates: int8 tile products with error bounds, full precision only where the bound leaves doubt.

Only vectors of one label meet. Equal vectors of a label are one class (its rows need no product). A unit vector u is
quantised to q = round(u / s), s = max|u| / 127, and e = ||u - s q|| is computed, not estimated. Then
|u.v - s t q.r| <= e_u ||t r|| + e_v ||u|| <= e_u (1 + e_v) + e_v, so a pair whose int8 product falls short of the
threshold by more than that (and a margin for rounding in double precision) cannot link. All other pairs are computed
in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scope, sorted_groups
from .components import components, forest
from .simhash import places

#: Rounding in double precision of sums of a few thousand products of numbers up to one.
SLACK = 1e-9


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows by powers of two, so that their largest component is between a half and one; cosines stay what they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q int8, scale, error norm) of unit row vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(unit - q * scale[:, None], axis=1)


def open_pairs(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that the bound leaves open, between two quantised sets of vectors, in blocks of rows."""
    (lq, ls, le), (rq, rs, re) = left, right
    exact32 = lq.shape[1] * 127 * 127 < 1 << 24  # products of int8 sum exactly in float32 up to there, 1,040 dimensions
    kind = np.float32 if exact32 else np.float64
    turned = rq.astype(kind).T
    step = max(1, (1 << 20) // max(1, len(rq)))
    for at in range(0, len(lq), step):
        a = slice(at, at + step)
        dot = lq[a].astype(kind) @ turned
        bound = le[a, None] * (1 + re[None, :]) + re[None, :] + SLACK
        i, j = places(dot * (ls[a, None] * rs[None, :]) + bound >= threshold)
        yield i + at, j


def linked_pairs(left: np.ndarray, right: np.ndarray, threshold: float, stats: dict | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine >= threshold between rows of two double matrices, in blocks of rows."""
    left, right = scaled(left), scaled(right)
    ln, rn = np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1)
    if stats is not None:
        stats["pairs"] = len(left) * len(right)
    for i, j in open_pairs(quantise(left / ln[:, None]), quantise(right / rn[:, None]), threshold):
        if stats is not None:
            stats["recomputed"] = stats.get("recomputed", 0) + len(i)
        for b in range(0, len(i), 1 << 16):
            x, y = i[b : b + (1 << 16)], j[b : b + (1 << 16)]
            cos = np.einsum("ij,ij->i", left[x], right[y]) / (ln[x] * rn[y])
            own = cos >= threshold
            yield x[own], y[own]


def _matrix(group: pa.Table, column: str) -> np.ndarray:
    return group.column(column).combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of a tile pair's two sides, and whether they are one tile."""
    side = group.column("side").to_numpy()
    alone = group.column("i")[0].as_py() == group.column("j")[0].as_py()
    left = np.flatnonzero(side == 0)
    return left, left if alone else np.flatnonzero(side == 1), alone


TILE = ["g", "label", "d", "i", "j"]


def tiled(rows: DataFrame) -> DataFrame:
    """Rows of one tile pair together."""
    return rows.withColumn("at", F.xxhash64(*TILE)).repartition("at").sortWithinPartitions(*TILE).drop("at")


def _classes(rows: DataFrame, threshold: float, tile: int) -> DataFrame:
    """(label, v, cn, links, component) of the distinct vectors of ``rows`` (id, label, v): rows, links to other classes' rows, smallest id reachable."""
    # ids may repeat, so classes get numbers of their own, fixed as the table is written
    classes = materialise(rows.where(F.col("v").isNotNull()).groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("c", F.monotonically_increasing_id()), "classes")

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column("v").offsets.to_numpy())
            out: list = [None] * batch.num_rows
            scale, error = np.empty(batch.num_rows), np.empty(batch.num_rows)
            for d in np.unique(size):
                own = np.flatnonzero(size == d)
                x = scaled(_matrix(pa.Table.from_batches([batch]).take(own), "v"))
                q, scale[own], error[own] = quantise(x / np.linalg.norm(x, axis=1)[:, None])
                for at, row in zip(own.tolist(), q):
                    out[at] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("c"), pa.array(out, pa.binary()), pa.array(scale), pa.array(error), pa.array(size, pa.int32())], ["label", "c", "q", "s", "e", "d"])

    kind = classes.schema["label"].dataType.simpleString()
    sizes = materialise(classes.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles")), "tiles")
    dealt = classes.select("label", "c", "v").mapInArrow(small, f"label {kind}, c long, q binary, s double, e double, d int").join(sizes, "label")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("c"), "tiles").cast("int")).withColumn("g", F.xxhash64("label")).withColumn("label", F.col("label").cast("string"))
    # a tile is the left side of the pairs with later tiles and the right side of those with earlier ones
    left = dealt.withColumn("j", F.explode(F.sequence("own", F.col("tiles") - 1))).select("g", "label", "d", F.col("own").alias("i"), "j", F.lit(0).cast("byte").alias("side"), "c", "q", "s", "e")
    right = dealt.withColumn("i", F.explode(F.sequence(F.lit(0), "own"))).where("i < own").select("g", "label", "d", "i", F.col("own").alias("j"), F.lit(1).cast("byte").alias("side"), "c", "q", "s", "e")

    def doubtful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, TILE):
            l, r, alone = _sides(group)
            q = np.frombuffer(b"".join(group.column("q").to_pylist()), dtype=np.int8).reshape(group.num_rows, -1)
            s, e = group.column("s").to_numpy(), group.column("e").to_numpy()
            hit = np.zeros(group.num_rows, dtype=bool)
            for a, b in open_pairs((q[l], s[l], e[l]), (q[r], s[r], e[r]), threshold):
                if alone:
                    a, b = a[a < b], b[a < b]
                hit[l[a]] = hit[r[b]] = True
            if hit.any():
                yield from group.filter(pa.array(hit)).select([*TILE, "side", "c"]).combine_chunks().to_batches()

    tiles = tiled(left.union(right)).mapInArrow(doubtful, "g long, label string, d int, i int, j int, side byte, c long")
    tiles = materialise(tiles, "doubtful").join(classes.select("c", "n", "v"), "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, TILE):
            n, x = group.num_rows, _matrix(group, "v")
            rep, count = group.column("c").to_numpy(), group.column("n").to_numpy()
            l, r, alone = _sides(group)
            links, trees = np.zeros(n, dtype=np.int64), [(np.empty(0, np.int64), np.empty(0, np.int64))]
            for a, b in linked_pairs(x[l], x[r], threshold):
                if alone:
                    a, b = a[a < b], b[a < b]
                if len(a):
                    links += np.bincount(l[a], weights=count[r[b]], minlength=n).astype(np.int64) + np.bincount(r[b], weights=count[l[a]], minlength=n).astype(np.int64)
                    trees.append(forest(rep[l[a]], rep[r[b]]))
            a, b = (np.concatenate(c) for c in zip(*trees))
            if len(a):
                a, b = forest(a, b)
            own = np.flatnonzero(links)
            kind = ["node", "links", "other"]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([rep[own], a])), pa.array(np.concatenate([links[own], np.zeros(len(a), np.int64)])), pa.array(np.concatenate([np.full(len(own), -1), b]), mask=np.concatenate([np.ones(len(own), bool), np.zeros(len(a), bool)]))], kind)

    found = materialise(tiled(tiles.select(*TILE, "side", "c", "n", "v")).mapInArrow(run, "node long, links long, other long"), "links")
    counts = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    parts = materialise(components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))), "parts")
    known = classes.join(counts, F.col("c") == counts.node, "left").drop("node").join(parts, F.col("c") == parts.node, "left").withColumn("part", F.coalesce("component", "c"))
    least = known.groupBy("part").agg(F.min("rep").alias("least"))
    return known.join(least, "part").select("label", "v", F.col("n").alias("cn"), F.coalesce("links", F.lit(0)).alias("links"), F.col("least").alias("component"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, tile: int = 2048, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of ``vectors``.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or id, link
    with nothing: no links, their own component, kept. Vectors of different lengths do not link. Rows that share an id
    count as vectors of their own. Extra columns are ignored; an empty table gives an empty result. Tiles travel as
    int8; double precision follows for the vectors that have an open pair in a tile pair.
    """
    v = F.col(vector).cast("array<double>")
    good = v.isNotNull() & (F.size(v) > 0) & F.col(label).isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    # -0.0 and 0.0 are one value
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), F.when(F.coalesce(good, F.lit(False)), F.transform(v, lambda x: x + F.lit(0.0))).alias("v"))
    with scope():
        known = materialise(_classes(rows, threshold, tile), "known", keep=True)
    own = rows.join(known, ["label", "v"], "left")
    component = F.coalesce("component", "id")
    return own.select(F.col("id").alias("vec_id"), F.coalesce(F.col("links") + F.col("cn") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
