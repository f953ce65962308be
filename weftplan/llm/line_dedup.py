"""Substring dedup by hashing lines, paragraphs or passages.

A unit's words, in lower case and by single spaces, have a 128-bit digest; digests are counted over all documents, the
earliest occurrence of a repeated one stays, all others go, with their offsets in the original text.

Lines and paragraphs are whole ones. Where repeated passages sit inside lines of their own, neither begins nor ends where
a passage does, so ``passage`` units are paragraphs that begin where the text itself says: at every word whose hash
(with the next word's) is the least among STEP neighbouring starts, and at either end of the text; SIZE words long, they
overlap. Equal passages of SIZE + STEP - 1 words or more hold an equal unit wherever their lines are cut, and at most
STEP - 1 words at either end of them stay; fewer than SIZE equal words never go.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, materialise, scope

SEPARATOR = {"line": "\n", "paragraph": "\n\n"}
#: Words of a passage unit, and neighbouring starts of which one is taken at least.
SIZE, STEP = 36, 14
SPACE = b" \t\n\x0b\x0c\r"
SPACES = np.isin(np.arange(256), np.frombuffer(SPACE, dtype=np.uint8))


class _WordHashes(dict):
    """The first eight bytes of a word's MD5 as a number, kept."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = int.from_bytes(md5(word, usedforsecurity=False).digest()[:8], "big")
        return out


_hashes = _WordHashes()


def starts(words: list[bytes], size: int = SIZE, step: int = STEP) -> np.ndarray:
    """The words at which a text's passage units begin: the first and the last place with ``size`` words to come, and in
    each ``step`` neighbouring ones between the first of those with the least pair of this and the next word's hash."""
    m = len(words) - size + 1
    if m < 1:
        return np.empty(0, dtype=np.int64)
    if len(_hashes) > 200_000:  # changes no result
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, words[: m + 1]), dtype=np.uint64, count=min(m + 1, len(words)))
    kinds, rank = np.unique(h, return_inverse=True)
    after = np.append(rank[1:], 0)[:m] if len(rank) == m else rank[1:]
    order = np.unique(rank[:m] * len(kinds) + after, return_inverse=True)[1] * m + np.arange(m)
    if m < step:
        return np.unique([0, m - 1])
    pad = -m % step
    rows = np.concatenate([order, np.full(pad, np.iinfo(np.int64).max)]).reshape(-1, step)
    ahead, behind = np.minimum.accumulate(rows, axis=1).ravel(), np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.unique(np.concatenate([[0, m - 1], np.minimum(behind[: m - step + 1], ahead[step - 1 : m]) % m]))


def _digest(raw: bytes) -> tuple[int, int]:
    from xxhash import xxh3_128_intdigest

    x = xxh3_128_intdigest(raw)
    return (x >> 64) - (1 << 63), (x & ((1 << 64) - 1)) - (1 << 63)


def text_units(text: str | None, unit: str, min_words: int) -> Iterator[tuple[int, tuple[int, int]]]:
    """(number, digest) of a text's units: the first word's number of a passage, the number of a line or paragraph."""
    if unit == "passage":
        words = (text or "").encode().lower().split()
        line, size = b" ".join(words), np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        ends = np.cumsum(size)
        for i in starts(words).tolist():
            yield i, _digest(line[ends[i] - size[i] : ends[i + SIZE - 1] - 1])
        return
    for i, u in enumerate((text or "").split(SEPARATOR[unit])):
        words = u.encode().lower().split()
        if len(words) >= min_words:
            yield i, _digest(b" ".join(words))


def units(docs: DataFrame, unit: str = "passage", min_words: int = 10) -> DataFrame:
    """(d1, d2, k, doc_id, i): digest, the row's key and the number of each unit of each text; ``docs`` has the key ``_k``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["d1", "d2", "k", "doc_id", "i"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        try:
            for batch in batches:
                out: list[tuple] = []
                for k, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("_k", "doc_id", "text"))):
                    out.extend((*d, k, doc_id, i) for i, d in text_units(text, unit, min_words))
                    if len(out) > 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
        finally:
            _hashes.clear()  # a worker that waits for its next task holds none

    return docs.select("_k", F.col("doc_id").cast("long"), "text").mapInArrow(run, "d1 long, d2 long, k long, doc_id long, i int")


def repeated_units(docs: DataFrame, unit: str = "passage", min_words: int = 10) -> DataFrame:
    """(k, i): every unit but the earliest of those that are equal; ``docs`` has the key ``_k``.

    Earliest: smallest doc_id (nulls last), then the row's key, then the place in the text.
    """
    every = materialise(units(docs, unit, min_words), "units")
    often = materialise(every.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d1", "d2"), "often")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "k", "i")
    found = materialise(every.join(often, ["d1", "d2"]).select("d1", "d2", rank.alias("rank")), "repeated")
    first = materialise(found.groupBy("d1", "d2").agg(F.min("rank").alias("first")), "firsts")
    return found.join(first, ["d1", "d2"]).where(~F.col("rank").eqNullSafe(F.col("first"))).select("rank.k", "rank.i")


def _characters(text: str, raw: bytes, at: np.ndarray) -> np.ndarray:
    """Places in characters of places in bytes."""
    if len(text) == len(raw):
        return at
    return np.concatenate([[0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)])[at]


def spans(text: str, numbers: np.ndarray, unit: str = "passage") -> list[tuple[int, int]]:
    """(start, end) in characters of the stretches that the units with these numbers cover, with the separator after each."""
    numbers = np.unique(numbers)
    if unit == "passage":
        raw = text.encode()
        space = SPACES[np.frombuffer(raw, dtype=np.uint8)]
        at = np.flatnonzero(np.diff(np.concatenate([[False], ~space])))  # first bytes of words
        at = at[~space[at]]
        runs = np.split(numbers, np.flatnonzero(np.diff(numbers) > SIZE) + 1)
        places = _characters(text, raw, np.append(at, len(raw)))
        return [(int(places[r[0]]), int(places[r[-1] + SIZE])) for r in runs]
    cut, out, start, gone = SEPARATOR[unit], [], 0, set(numbers.tolist())
    for i, u in enumerate(text.split(cut)):
        end = min(len(text), start + len(u) + len(cut))
        if i in gone:
            out.append((start, end))
        start = end
    return out


def cut_out(text: str, removed: list[tuple[int, int]], unit: str = "passage") -> str:
    """``text`` less the spans; where the end went, the separator before it goes too."""
    edges = [0, *(x for s in removed for x in s), len(text)]
    left = "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
    if removed and removed[-1][1] == len(text):
        return left.rstrip(SPACE.decode()) if unit == "passage" else left.removesuffix(SEPARATOR[unit])
    return left


def remove_repeated(docs: DataFrame, unit: str = "passage", min_words: int = 10) -> DataFrame:
    """``docs`` with ``text`` less its repeated units, and ``removed``: their merged spans (start, end) in characters, with
    the separators after them.

    Lines and paragraphs count from ``min_words`` words. Null and empty texts, and all that lose nothing, stay as they are
    (``removed`` is null). All rows count: of repeated rows the first keeps its units, and a unit that overlaps its own
    first occurrence takes what they share. Ties go by doc_id (nulls last), row and place. All columns are kept but a
    ``removed`` of the input, which the new one replaces. A text is held whole, with some 100 bytes for each of its words.
    """
    if unit not in (*SEPARATOR, "passage"):
        raise ValueError(f"no unit {unit!r}")
    rest = [c for c in docs.columns if c not in ("text", "removed")]
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row")))
    with scope():
        gone = repeated_units(rows, unit, min_words).groupBy(F.col("k").alias("_k")).agg(F.collect_list("i").alias("at"))
        gone = materialise(gone, "removed", keep=True)

    @F.pandas_udf("text string, removed array<struct<start:long,end:long>>")
    def less(text, at):  # noqa: ANN001
        import pandas as pd

        found = [None if a is None or t is None else spans(t, np.asarray(a, dtype=np.int64), unit) for t, a in zip(text, at)]
        out = [t if r is None else cut_out(t, r, unit) for t, r in zip(text, found)]
        return pd.DataFrame({"text": pd.Series(out, dtype=object), "removed": pd.Series([None if r is None else [{"start": a, "end": b} for a, b in r] for r in found], dtype=object)})

    # spans grow with the corpus, so they are merged, never broadcast
    cut = rows.join(gone.hint("merge"), "_k", "left").select("row", less("text", "at").alias("x"))
    kept = (F.col("x.text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "removed")
    return cut.select(*kept, "x.removed")
