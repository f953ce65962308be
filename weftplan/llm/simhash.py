"""SimHash near-duplicates: 64-bit fingerprints, compared exactly in tiles.

Fingerprints fall into cells by the population counts of their four 16-bit quarters. Two fingerprints within
``radius`` bits have counts whose differences sum to ``radius`` at most, so a tile of one cell meets only tiles of
the cells that near; all other tile pairs are skipped. Tiles that meet are compared with exclusive-or and bit counts,
exactly. Links leave a tile pair as a spanning forest, so a group of k copies gives k links, not k squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scope, sorted_groups
from .components import components, forest

QUARTERS, SIDE = 4, 17


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64 bits: each is set if set in over half the XXH64 of the text's word shingles; no words: zero."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    hashes = np.fromiter((xxh64_intdigest(line[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :])), dtype="<u8", count=len(words) - shingle + 1)
    n, counts = len(hashes), np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        counts += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long): one row for each row of ``docs``, nulls and repeated rows included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle, seed) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _quarter_counts(fp: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count((fp >> np.uint64(16 * k)) & np.uint64(0xFFFF)) for k in range(QUARTERS)]).astype(np.int64)


def near_cells(radius: int) -> list[tuple[int, ...]]:
    """Offsets between cells that can hold fingerprints within ``radius`` bits, one of each opposite pair."""
    span = range(-radius, radius + 1)
    return [d for d in product(span, repeat=QUARTERS) if sum(map(abs, d)) <= radius and d >= (0,) * QUARTERS]


def places(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is true in a matrix, most of which is not."""
    if not hit.any():
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.divmod(np.flatnonzero(hit), hit.shape[1])


def _pairs(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles, as a forest."""
    a, b = [], []
    step = max(1, (1 << 20) // max(1, len(right)))
    for at in range(0, len(left), step):
        i, j = places(np.bitwise_count(left[at : at + step, None] ^ right[None, :]) <= radius)
        own = left[at + i] != right[j]
        if own.any():
            x, y = forest(left[at + i][own], right[j][own])
            a.append(x)
            b.append(y)
    if not a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return forest(np.concatenate(a), np.concatenate(b))


def links(fps: DataFrame, radius: int = 2, tile: int = 4096) -> DataFrame:
    """(a, b): links that join exactly the distinct fingerprints ``fp`` within ``radius`` bits, as forests.

    Cells are at most 17^4 = 83,521, so their counts go to the driver and back as a small table. A cell with more
    rows than a tile is dealt over several tiles by hash, on either side.
    """
    spark = fps.sparkSession
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long"))) for k in range(QUARTERS)]
    cell = sum((q * SIDE**k for k, q in enumerate(quarter)), F.lit(0))
    counts = fps.groupBy(cell.cast("int").alias("cell")).count().toPandas()
    have = dict(zip(counts["cell"], counts["count"]))
    offsets = near_cells(radius)

    def shifted(c: int, d: tuple[int, ...]) -> int | None:
        p = [(c // SIDE**k) % SIDE + d[k] for k in range(QUARTERS)]
        return sum(x * SIDE**k for k, x in enumerate(p)) if all(0 <= x < SIDE for x in p) else None

    into: dict[int, int] = {}
    for c, n in have.items():
        for d in offsets:
            to = shifted(int(c), d)
            if to in have:
                into[to] = into.get(to, 0) + n
    nl = {c: -(-into[c] // (4 * tile)) for c in into}
    nr = {c: -(-have[c] // tile) for c in into}
    # a row for each cell, 83,521 at most
    cells = pd.DataFrame({"cell": list(into), "nl": [nl[c] for c in into], "nr": [nr[c] for c in into]}, dtype="int32") if into else []
    own_t = spark.createDataFrame(cells, "cell int, nl int, nr int")
    deal = F.xxhash64("fp")
    rows = fps.select("fp", cell.cast("int").alias("cell"), *(q.cast("int").alias(f"q{k}") for k, q in enumerate(quarter)))
    inside = [F.struct(*(F.col(f"q{k}") + d[k] for k in range(QUARTERS))) for d in offsets]
    near = F.filter(F.array(*inside), lambda x: reduce(lambda a, b: a & b, (x[f"col{k + 1}"].between(0, SIDE - 1) for k in range(QUARTERS))))
    left = rows.select("fp", F.explode(near).alias("x")).select("fp", sum((F.col(f"x.col{k + 1}") * SIDE**k for k in range(QUARTERS)), F.lit(0)).cast("int").alias("cell"))
    left = left.join(F.broadcast(own_t), "cell").select("cell", F.pmod(deal, "nl").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("j"), F.lit(0).cast("byte").alias("side"), "fp")
    right = rows.join(F.broadcast(own_t), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("i"), F.pmod(deal, "nr").cast("int").alias("j"), F.lit(1).cast("byte").alias("side"), "fp")
    both = left.union(right).select(F.xxhash64("cell", "i", "j").alias("at"), "cell", "i", "j", "side", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["cell", "i", "j"]):
            side, fp = group.column("side").to_numpy(), group.column("fp").to_numpy().view(np.uint64)
            a, b = _pairs(fp[side == 0], fp[side == 1], radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return both.repartition("at").sortWithinPartitions("cell", "i", "j").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, seed: int = 42, tile: int = 4096) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id): one row for each row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other. ``component_id`` is the smallest non-null
    doc_id reachable; rows with a null doc_id link too, and a component of such rows only has a null id. Extra
    columns are ignored; an empty table gives an empty result.
    """
    fps = materialise(fingerprints(docs, shingle, seed), "fingerprints")
    with scope():
        groups = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
        parts = materialise(components(links(groups.select("fp"), radius, tile)), "parts")
        linked = groups.join(parts, groups.fp == parts.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
        least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
        classes = materialise(linked.join(least, "component").select("fp", "component_id"), "classes", keep=True)
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


def deduplicate(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one with the smallest doc_id.

    Repeated rows with that doc_id stay as one row each; rows with a null doc_id stay.
    """
    keep = near_duplicates(docs, **kw).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))


