"""Vector best-fit packing of documents into training sequences.

A document (cut into pieces of the sequence length where longer) needs tokens, one document slot and attention cost
(its length squared); a sequence has a capacity of each. All three follow from the length, so pieces of one length
are alike and the driver packs the histogram of lengths, longest first: a group of alike open sequences is one state
(residual vector), and each step fills the group whose residual after placement is best, by its weighted norm or by
weighted dot product, among those where every constraint holds. Its work grows with the number of lengths and states,
not with the corpus. Executors then map (length, rank among pieces of that length) to sequence and offset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import default_tokenizer, encoded, materialise

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, rank long"


@dataclass(frozen=True)
class Segment:
    """Pieces of one length and ranks first..first+n-1 go to sequences bin..bin+n-1, at ``offset``."""

    length: int
    first: int
    n: int
    bin: int
    offset: int


def plan(histogram: dict[int, int], tokens: int = 1024, docs: int | None = None, attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm") -> list[Segment]:
    """Where the pieces of every length go. Zero-length pieces and pieces over a capacity are refused.

    ``docs`` and ``attention`` default to values that the token capacity implies (a slot for each token, tokens squared).
    """
    cap = np.array([tokens, docs or tokens, attention or tokens * tokens], dtype=np.int64)
    scale = np.asarray(weights, dtype=float) / cap.astype(float) ** (2 if rule == "norm" else 1)
    res = np.empty((0, 3), dtype=np.int64)
    mult, first, used = (np.empty(0, dtype=np.int64) for _ in range(3))
    out, bins = [], 0
    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        need, left, rank = np.array([length, 1, length * length], dtype=np.int64), int(histogram[length]), 0
        if length < 1 or (need > cap).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while left:
            fits = np.flatnonzero((res >= need).all(axis=1))
            if len(fits):
                after = (res[fits] - need).astype(float)
                score = (after**2 * scale).sum(axis=1) if rule == "norm" else -(res[fits] * need / cap * scale).sum(axis=1)
                g = fits[np.lexsort((first[fits], score))[0]]
                k = min(left, int(mult[g]))
                out.append(Segment(length, rank, k, int(first[g]), int(used[g])))
                if k < mult[g]:  # the rest stays as it was
                    res, mult = np.vstack([res, res[g]]), np.append(mult, mult[g] - k)
                    first, used = np.append(first, first[g] + k), np.append(used, used[g])
                    mult[g] = k
                res[g] -= need
                used[g] += length
                rank, left = rank + k, left - k
            else:
                each = int((cap // need).min())
                for n, m in ((each, left // each), (left % each, 1)):
                    if n and m:
                        for j in range(n):
                            out.append(Segment(length, rank, m, bins, j * length))
                            rank += m
                        res, mult = np.vstack([res, cap - n * need]), np.append(mult, m)
                        first, used = np.append(first, bins), np.append(used, n * length)
                        bins += m
                left = 0
            live = res[:, 0] > 0
            res, mult, first, used = res[live], mult[live], first[live], used[live]
    return out


def pieces(docs: DataFrame, tokens: int = 1024, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Pieces of every document, with their rank among those of the same length of the same input partition."""
    tokenizer = tokenizer or default_tokenizer()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, seen = TaskContext.get().partitionId(), np.zeros(tokens + 1, dtype=np.int64)
        for part, ids in encoded(batches, tokenizer):
            out = []
            for doc_id, x in zip(part.column("doc_id").to_pylist(), ids):
                x += end
                n = len(x) // 4
                cuts = [0, *range(n % tokens or min(n, tokens), n + 1, tokens)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    out.append((doc_id, k, a, b - a, zlib.crc32(x[4 * a : 4 * b]), pid, int(seen[b - a])))
                    seen[b - a] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "pid", "rank"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokens: int = 1024, max_docs: int | None = None, attention: int | None = None, rule: str = "norm", tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every row of ``docs``.

    Null and empty texts are one piece, the end id. Only documents over ``tokens`` are cut; their first piece takes
    the remainder. Rows that share a doc_id (or have none) are packed as documents of their own; extra columns are
    ignored; an empty table gives an empty result.
    """
    cut = materialise(pieces(docs, tokens, tokenizer, end_id), "pieces")
    by_part = cut.groupBy("length", "pid").agg(F.count(F.lit(1)).alias("n"))
    # one row for each length and input partition
    before = by_part.select("length", "pid", "n", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    before = materialise(before, "ranks")
    histogram = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length: `tokens` at most
    segments = plan(histogram, tokens, max_docs, attention, rule=rule)
    table: dict[int, tuple[np.ndarray, ...]] = {}
    for s in segments:
        table.setdefault(s.length, []).append((s.first, s.bin, s.offset))
    table = {k: tuple(np.array(c, dtype=np.int64) for c in zip(*sorted(v))) for k, v in table.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("global_rank").to_numpy()
            seq, off = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            for idx in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                first, bins, offsets = table[int(length[idx[0]])]
                at = np.searchsorted(first, rank[idx], side="right") - 1
                seq[idx], off[idx] = bins[at] + rank[idx] - first[at], offsets[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # a row for each length and partition grows with the corpus, so it is merged, never broadcast
    ranked = cut.join(before.drop("n").hint("merge"), ["length", "pid"]).withColumn("global_rank", F.col("before") + F.col("rank"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "global_rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
