"""Exact substring dedup by prefix-free parsing over a distributed corpus.

Parse. A rolling hash runs over every text's bytes, and in each stretch of ``length`` bytes the smallest hash of its
``k``-byte windows is a trigger. Equal stretches have equal triggers at equal places, so all stretches of one trigger,
taken together, are a phrase: the bytes from the first such stretch to the end of the last. A phrase carries the
``length`` bytes that decide the order of each suffix that starts in it, so no phrase needs the next one to be sorted.

Dictionary and parse. Phrases whose trigger occurs once cannot repeat and drop out in one aggregation of trigger hashes.
The rest form the dictionary (distinct phrases, with one place each) and the parse (how often each occurs). A phrase
that occurs twice is repeated as a whole: runs of copies, however long and many, end here. The others meet in a suffix
array of their trigger's part of the dictionary: suffixes are ranked by prefix doubling up to ``length`` bytes, and
equal ranks are repeats.

Hot triggers. A trigger with more than ``group`` phrases has its suffixes halved by how far before the trigger they
begin. All suffixes of such a half share a core around the trigger, so a phrase goes to one home for each half, keyed by
its core; phrases alike in a whole half are one class, repeated as a whole; homes with few classes are ranked, those
with many are halved again. Every suffix has one home, and after as many rounds as ``length`` has bits none is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, materialise, scope, sorted_groups

#: Any odd number with well-mixed bits; its inverse modulo 2^64 makes window hashes differences of running sums.
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
#: Bytes of a text that are parsed at a time; stretches do not depend on where such blocks begin.
BLOCK = 1 << 22
#: Low bits of a window's sort key that hold its place in a block, the same for every text.
PLACE_BITS = 23


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i up to n, at least."""
    if not _powers or len(_powers[0][0]) < n + 1:
        size = max(n + 1, 1 << 16)
        up, down = (np.full(size, x, dtype=np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers[0] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[0]


def triggers(raw: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, hash, place) for each phrase of a byte array: the starts of its first and last stretch, its trigger."""
    n = len(raw)
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    m, w = n - k + 1, length - k + 1
    up, down = _power_tables(n)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * down[:n], out=sums[1:])
    h = _mix((sums[k:] - sums[:m]) * up[:m])
    bits = np.uint64(PLACE_BITS)
    keys = (h >> bits << bits) | np.arange(m, dtype=np.uint64)  # ties go to the left
    # sliding minimum over w keys from running minima of blocks, forward and backward
    pad = -m % w
    padded = np.concatenate([keys, np.full(pad, MASK, dtype=np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(behind[: m - w + 1], ahead[w - 1 : m])
    at = low & ((np.uint64(1) << bits) - np.uint64(1))
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    last = np.concatenate([first[1:], [len(at)]]) - 1
    place = at[first].astype(np.int64)
    return first, last, h[place], place


def phrases(raw: bytes, length: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """:func:`triggers` of a whole text, in blocks; a phrase that a block's end cuts comes in two, which loses nothing."""
    data = np.frombuffer(raw, dtype=np.uint8)
    for at in range(0, max(1, len(data) - length + 1), BLOCK):
        first, last, h, place = triggers(data[at : at + BLOCK + length - 1], length, k)
        yield first + at, last + at, h, place + at


def runs(raw: bytes, length: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(t, c, lo, hi, g, n, end) of a text's phrases: hashes of trigger and phrase, first and last stretch, trigger's place.

    Equal phrases that follow each other, as in text of a short period, are one entry: the first of ``n``, the last of
    which has its last stretch at ``end``.
    """
    from xxhash import xxh3_64_intdigest

    for first, last, t, place in phrases(raw, length, k):
        if len(first):
            c = np.fromiter((xxh3_64_intdigest(raw[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())), dtype=np.uint64, count=len(first))
            begin = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])]))
            after = np.append(begin[1:], len(first))
            yield t[begin].view(np.int64), c[begin].view(np.int64), first[begin], last[begin], place[begin], after - begin, last[after - 1]


def parse(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(t, c, lo, hi, g, n, end, k): :func:`runs` of each text, and the row's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["t", "c", "lo", "hi", "g", "n", "end", "k"]
        for batch in batches:
            held, rows = [], 0
            for key, text in zip(batch.column("_k").to_pylist(), batch.column("text").to_pylist()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if len(raw) < length:
                    continue
                for found in runs(raw, length, k):
                    held.append((*found, np.full(len(found[0]), key)))
                    rows += len(found[0])
                if rows > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names)
                    held, rows = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names)

    return docs.select("_k", "text").mapInArrow(run, "t long, c long, lo long, hi long, g long, n long, end long, k long")


def suffix_ranks(raw: np.ndarray, part: np.ndarray, length: int) -> np.ndarray:
    """Ranks of all suffixes by their first ``length`` bytes, by prefix doubling; equal rank: equal bytes and part.

    Suffixes of different parts differ; bytes past the end count as zeros, so callers use suffixes that reach no end.
    """
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
    word = np.zeros(n, dtype=np.uint64)
    for i in range(4):
        word = (word << np.uint64(8)) | padded[i : n + i].astype(np.uint64)
    rank = np.unique(word | (part.astype(np.uint64) << np.uint64(32)), return_inverse=True)[1].astype(np.uint64)
    have = 4
    while have < length:
        shift = min(have, length - have)
        nxt = np.zeros(n, dtype=np.uint64)
        nxt[: n - shift] = rank[shift:]
        rank = np.unique((rank << np.uint64(32)) | nxt, return_inverse=True)[1].astype(np.uint64)
        have += shift
    return rank


def _repeats(groups: list[pa.Table], length: int) -> Iterator[tuple[int, list[int]]]:
    """(key, [first, end, first, end, ...]): the repeated bytes of each phrase that occurs once, among those of its group."""
    table = pa.concat_tables(groups)
    texts = table.column("bytes").to_pylist()
    sizes = np.array([len(t) for t in texts])
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    part = np.repeat(np.repeat(np.arange(len(groups)), [g.num_rows for g in groups]), sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    n = len(raw)
    rank = suffix_ranks(raw, part, length)
    whole = np.ones(n, dtype=bool)  # suffixes with `length` bytes of their own phrase
    for end in starts[1:]:
        whole[max(0, end - length + 1) : end] = False
    used = np.flatnonzero(whole)
    _, inverse, counts = np.unique(rank[used], return_inverse=True, return_counts=True)
    hit = np.zeros(n + 1, dtype=np.int8)
    hit[used] = counts[inverse] > 1
    once = table.column("m").to_numpy() == 1
    keys, los = table.column("k").to_numpy(), table.column("lo").to_numpy()
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit])))
    of = np.searchsorted(starts, edges[::2], side="right") - 1
    found: dict[int, list[int]] = {}
    for i, a, b in zip(of.tolist(), edges[::2].tolist(), edges[1::2].tolist()):
        if once[i]:
            found.setdefault(i, []).extend((int(los[i] + a - starts[i]), int(los[i] + b - 1 - starts[i]) + length))
    for i, spans in found.items():
        yield int(keys[i]), spans


def halved(rows: DataFrame, length: int) -> DataFrame:
    """Each phrase's part in both halves of its stretches: (home, a, b, u, m, k, lo, hi, g, bytes).

    ``rows`` have the range a..b-1 of the bytes between a stretch's start and the trigger, and the phrase's stretches
    lo..hi within it. ``home`` is the hash of what all stretches of a half share, ``u`` that of the phrase's own part.
    """
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    half = F.explode(F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b").alias("b"))))
    cut = rows.withColumn("x", half).drop("a", "b").select("*", "x.a", "x.b").drop("x").where("a < b")
    low, high = F.greatest("lo", F.col("g") - F.col("b") + 1), F.least("hi", F.col("g") - F.col("a"))
    cut = cut.withColumn("low", low).withColumn("high", high).where("low <= high")
    own = F.expr(f"substring(bytes, cast(low - lo + 1 as int), cast(high - low + {length} as int))")
    core = F.expr(f"substring(bytes, cast(g - a - lo + 1 as int), {length} - (b - 1 - a))")
    # the trigger's place in its part tells apart equal bytes that lie elsewhere in the half
    return cut.select(F.xxhash64("a", "b", core).alias("home"), "a", "b", F.md5(F.concat(F.encode((F.col("g") - F.col("low")).cast("string"), "utf-8"), F.lit(b":"), own)).alias("u"), "m", "k", F.col("low").alias("lo"), F.col("high").alias("hi"), "g", own.alias("bytes"))


def refined(hot: DataFrame, length: int, group: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(spans, small): repeated spans (k, spans) of classes, and homes (home, k, lo, m, bytes) of ``group`` classes at most.

    Each round reads what the last one wrote; rounds end when no home has more classes.
    """
    spans, small = [], []
    while hot.limit(1).count():
        parts = materialise(halved(hot, length), "halves")
        place = F.min(F.struct("k", "lo", "hi", "g", "bytes")).alias("at")
        classes = materialise(parts.groupBy("home", "a", "b", "u").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("m"), place), "classes")
        alike = parts.where("m = 1").join(classes.where("n > 1").select("home", "a", "b", "u"), ["home", "a", "b", "u"])
        spans.append(materialise(alike.select("k", F.array("lo", F.col("hi") + length).alias("spans")), "alike"))
        homes = materialise(classes.groupBy("home", "a", "b").agg(F.count(F.lit(1)).alias("d")).where("d > 1"), "homes")
        met = classes.join(homes, ["home", "a", "b"]).select("home", "a", "b", "m", "at.*", "d")
        small.append(materialise(met.where(F.col("d") <= group).select(F.xxhash64("home", "a", "b").alias("home"), "k", "lo", "m", "bytes"), "small"))
        hot = materialise(met.where(F.col("d") > group).drop("home", "d"), "hot")
    return spans, small


def repeated_spans(docs: DataFrame, length: int = 200, k: int = 64, group: int = 1024) -> DataFrame:
    """(k, spans): byte spans [start, end, ...] that cover every byte of a ``length``-byte string that starts elsewhere too. ``docs`` has the key ``_k``."""
    if not 8 <= k <= length < BLOCK:
        raise ValueError(f"a trigger's {k} bytes, eight at least, must lie within the {length} bytes of a match")
    parsed = parse(docs, length, k)
    often = materialise(parsed.groupBy("t").agg(F.sum("n").alias("n")).where("n > 1").select("t"), "triggers")
    found = materialise(parsed.join(often, "t"), "phrases")
    dictionary = materialise(found.groupBy("t", "c").agg(F.sum("n").alias("m"), F.min(F.struct("k", "lo", "hi", "g")).alias("at")), "dictionary")
    whole = found.join(dictionary.where("m > 1").select("t", "c"), ["t", "c"]).select("k", F.array("lo", F.col("end") + length).alias("spans"))

    shared = materialise(dictionary.groupBy("t").agg(F.count(F.lit(1)).alias("d")).where("d > 1"), "shared")
    mixed = dictionary.join(shared, "t").select("at.k", F.struct("at.lo", "at.hi", "at.g", "t", "m", (F.col("d") > group).alias("hot")).alias("p"))
    wanted = materialise(mixed.groupBy("k").agg(F.collect_list("p").alias("ps")), "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("t", pa.int64()), ("m", pa.int64()), ("k", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("g", pa.int64()), ("hot", pa.bool_()), ("bytes", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for key, text, ps in zip(*(part.column(c).to_pylist() for c in ("_k", "text", "ps"))):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    out += [(p["t"], p["m"], key, p["lo"], p["hi"], p["g"], p["hot"], raw[p["lo"] : p["hi"] + length]) for p in ps]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    bodies = docs.select("_k", "text").join(wanted.withColumnRenamed("k", "_k"), "_k").mapInArrow(cut, "t long, m long, k long, lo long, hi long, g long, hot boolean, bytes binary")
    bodies = materialise(bodies, "bodies")
    hot = bodies.where("hot").select(F.lit(0).alias("a"), F.lit(length - k + 1).alias("b"), "m", "k", "lo", "hi", "g", "bytes")
    spans, small = refined(materialise(hot, "hot"), length, group)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(groups: list[pa.Table]) -> pa.RecordBatch:
            rows = list(zip(*_repeats(groups, length))) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.list_(pa.int64()))], ["k", "spans"])

        held, size = [], 0
        for g in sorted_groups(batches, ["home"]):
            held.append(g)
            size += g.nbytes
            if size > 1 << 21:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    homes = reduce(DataFrame.union, small, bodies.where("not hot").select(F.col("t").alias("home"), "k", "lo", "m", "bytes"))
    ranked = homes.repartition("home").sortWithinPartitions("home").mapInArrow(rank, "k long, spans array<long>")
    return reduce(DataFrame.union, spans, whole.union(ranked))


def remove_repeated(docs: DataFrame, length: int = 200, k: int = 64) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, removed (merged byte spans), kept (the remaining bytes).

    Null and empty texts have no bytes and lose none. Matches never cross rows; rows that repeat (with the same
    doc_id or none) are texts of their own, so each loses its repeated bytes. Overlaps count, and strings are judged
    on the input. Extra columns are ignored.
    """
    docs_k = keyed(docs).select("_k", F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scope():
        spans = repeated_spans(docs_k, length, k)
        by_row = materialise(spans.groupBy("k").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans", keep=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for doc_id, text, ss in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                    raw, merged = (text or "").encode("utf-8", "surrogatepass"), []
                    for s, e in sorted(zip(ss[::2], ss[1::2])) if ss else ():
                        if merged and s <= merged[-1]["end"]:
                            merged[-1]["end"] = max(merged[-1]["end"], e)
                        else:
                            merged.append({"start": s, "end": e})
                    edges = [0, *(x for m in merged for x in (m["start"], m["end"])), len(raw)]
                    out.append((doc_id, len(raw), merged, b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), span, pa.binary()))], ["doc_id", "n_bytes", "removed", "kept"])

    return docs_k.join(by_row.withColumnRenamed("k", "_k"), "_k", "left").select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of the rows of :func:`remove_repeated`."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return removed.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

