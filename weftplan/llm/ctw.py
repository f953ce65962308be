"""Language-model scores by context-tree weighting over bytes, beside an add-one unigram base.

Each byte is eight binary decisions, and each decision has a context tree over the preceding bytes. A node (context of
0..depth bytes, bits decided so far) holds Krichevsky-Trofimov counts of zeros and ones; its weighted probability mixes
its own estimate, by one half, with the product of its children's, so every depth takes part. Counts come from all
training documents: tasks count byte strings of depth + 1, Spark sums them, and one aggregation for each level gives
nodes, estimates and mixing weights exactly. Strings that only other documents hold are counted zero times, which leaves
all estimates and weights as they are and gives each scored string a path of its own. For scoring, one join for each level
takes the mixture down to the strings; the most frequent strings, a fixed number, are looked up in memory, all others
meet their values in a join, so every counted node takes part whatever the size of the corpus.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise, read_table, written

#: The end of a text, coded as a byte that no word holds; it also stands before the first byte.
END = b"\n"
#: Bytes of text that are coded at a time.
CHUNK = 1 << 19
#: Distinct words, and strings, that a task holds before it passes on their counts.
HOLD_WORDS, HOLD_STRINGS = 1 << 17, 1 << 20


def in_training(doc_id: int | None) -> bool:
    """All but one in seven documents, by the checksum of the id as text (null: of the empty text)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 != 2


def text_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def coded(texts: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(strings, text): for each byte of each text (words by single spaces, then the end) it and the depth bytes
    before it, the byte itself lowest; and the number of its text."""
    pad = END * depth
    lines = [b" ".join(w) + END for w in texts]
    raw = END * 7 + pad.join(lines)
    # eight bytes at each place, read as one big-endian number
    out = np.ndarray(len(raw) - 7, dtype=">u8", buffer=raw, strides=(1,)).astype(np.uint64) & np.uint64((1 << (8 * depth + 8)) - 1)
    sizes = np.array([len(x) for x in lines])
    starts = np.concatenate([[0], np.cumsum(sizes + depth)[:-1]])
    own = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    return out[own], np.repeat(np.arange(len(lines)), sizes)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows in lists of about CHUNK bytes of text."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("r", "doc_id", "text"))):
            held.append(row)
            size += len(row[2] or "") + 64
            if size > CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def word_counts(rows: DataFrame) -> DataFrame:
    """(word binary, c): counts of the training documents' words and of their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "c"])

        seen: Counter = Counter()
        for chunk in _chunks(batches):
            for _, doc_id, text in chunk:
                if in_training(doc_id):
                    seen.update(text_words(text))
                    seen[END] += 1
            if len(seen) > HOLD_WORDS:
                yield out()
                seen = Counter()
        if seen:
            yield out()

    return rows.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def string_counts(rows: DataFrame, depth: int, every: bool = False) -> DataFrame:
    """(g, n, m): counts of strings of depth + 1 bytes, in the training documents and in all that are read.

    With ``every``, the other documents are read too, whose own strings have n = 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _, _ in held]), return_inverse=True)
            n, m = (np.bincount(at, weights=np.concatenate(x)).astype(np.int64) for x in list(zip(*held))[1:])
            return keys, n, m

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1]), pa.array(held[0][2])], ["g", "n", "m"])

        for chunk in _chunks(batches):
            for training in (True, False) if every else (True,):
                texts = [text_words(t) for _, d, t in chunk if in_training(d) == training]
                if texts:
                    keys, m = np.unique(coded(texts, depth)[0], return_counts=True)
                    held.append((keys, m if training else np.zeros_like(m), m))
                    size += len(keys)
            if size > HOLD_STRINGS:
                held = [merged()]
                size = len(held[0][0])
                if size > HOLD_STRINGS // 2:
                    yield out()
                    held, size = [], 0
        if held:
            held = [merged()]
            yield out()

    return rows.mapInArrow(run, "g long, n long, m long").groupBy("g").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def log_gamma(x: Column) -> Column:
    """ln Gamma for x >= 1/2, to about 1e-10: Stirling's series after a shift by six."""
    y = x + 6
    shift = F.log(x) + F.log(x + 1) + F.log(x + 2) + F.log(x + 3) + F.log(x + 4) + F.log(x + 5)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - shift


def tree(strings: DataFrame, depth: int) -> list[DataFrame]:
    """Nodes of each depth, root first: (key, a, b, stop, w). Key: context bytes, the latest lowest, above the bits so far."""
    prefix = F.expr("(1L << k) | shiftrightunsigned(g & 255L, 8 - k)")
    bit = F.expr("shiftrightunsigned(g & 255L, 7 - k) & 1L")
    bits = strings.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7)))).select((F.expr("shiftrightunsigned(g, 8) << 8").bitwiseOR(prefix)).alias("key"), (F.col("n") * (1 - bit)).alias("a"), (F.col("n") * bit).alias("b"))
    own = F.when(F.col("a") + F.col("b") > 0, log_gamma(F.col("a") + 0.5) + log_gamma(F.col("b") + 0.5) - log(np.pi) - log_gamma((F.col("a") + F.col("b") + 1).cast("double"))).otherwise(0.0)
    level = materialise(bits.groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).select("key", "a", "b", F.lit(1.0).alias("stop"), own.alias("w")), f"tree{depth}")
    out = [level]
    for d in range(depth - 1, -1, -1):
        up = F.col("key").bitwiseAND(F.lit((1 << (8 * d + 8)) - 1).cast("long"))
        sums = level.groupBy(up.alias("key")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("w").alias("s")).withColumn("e", own)
        high = F.greatest("e", "s")
        level = materialise(sums.select("key", "a", "b", (1 / (1 + F.exp(F.least(F.col("s") - F.col("e"), F.lit(700.0))))).alias("stop"), (high + F.log1p(F.exp(-F.abs(F.col("e") - F.col("s")))) - log(2)).alias("w")), f"tree{d}")
        out.append(level)
    return out[::-1]


def string_values(strings: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(g, m, v): log10 of the probability of each string's last byte after the others.

    ``strings`` are those that ``levels`` were made of. The mixture goes down the tree with one join for each level, of
    256 children to a node at most; a node that training never met repeats its parent's estimate.
    """
    p, seen = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1), F.col("a") + F.col("b") > 0
    path = levels[0].select("key", p.alias("said"), (F.col("stop") * p).alias("one"), (1 - F.col("stop")).alias("left"))
    for d, level in enumerate(levels[1:], 1):
        up = path.select(F.col("key").alias("up"), F.col("said").alias("was"), F.col("one").alias("one0"), F.col("left").alias("left0"))
        met = level.withColumn("up", F.col("key").bitwiseAND(F.lit((1 << (8 * d)) - 1).cast("long"))).join(up, "up")
        path = met.select("key", F.when(seen, F.col("one0") + F.col("left0") * p).otherwise(F.col("was")).alias("said"), (F.col("one0") + F.col("left0") * F.col("stop") * p).alias("one"), (F.col("left0") * (1 - F.col("stop"))).alias("left"))
    # a row for each whole context, with 255 estimates at most
    said = path.groupBy(F.shiftrightunsigned("key", 8).alias("context")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("key").bitwiseAND(F.lit(255).cast("long")).cast("int"), "said"))).alias("said"))
    met = strings.select("g", "m", F.shiftrightunsigned("g", 8).alias("context")).join(said, "context")
    value = F.lit(0.0)
    for k in range(8):
        one = F.col("said")[F.expr(f"cast((1L << {k}) | shiftrightunsigned(g & 255L, {8 - k}) as int)")]
        chance = F.when(F.expr(f"shiftrightunsigned(g & 255L, {7 - k}) & 1L") == 1, one).otherwise(1 - one)
        value += F.log10(chance)
    return met.select("g", "m", value.alias("v"))


class Held:
    """Values of the most frequent strings, in an open-addressing table; :meth:`log10` gives NaN for any other."""

    FREE = np.uint64((1 << 64) - 1)  # no string has so many bytes

    def __init__(self, strings: np.ndarray, values: np.ndarray):
        self.bits = max(1, (2 * len(strings)).bit_length())
        self.table = np.full((1 << self.bits, 2), self.FREE)  # a string and its value lie together
        names, numbers = self.table[:, 0], self.table.view(np.float64)[:, 1]
        at, left = self._place(strings), np.arange(len(strings))
        while len(left):
            free = names[at[left]] == self.FREE
            names[at[left[free]]] = strings[left[free]]  # of those that ask for one place the last stays
            there = names[at[left]] == strings[left]
            numbers[at[left[there]]] = values[left[there]]
            left = left[~there]
            at[left] = (at[left] + 1) & (len(names) - 1)

    def _place(self, strings: np.ndarray) -> np.ndarray:
        return (strings * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def log10(self, strings: np.ndarray) -> np.ndarray:
        at = self._place(strings)
        met = self.table.take(at, axis=0)
        out = np.where(met[:, 0] == strings, met.view(np.float64)[:, 1], np.nan)
        left = np.flatnonzero((met[:, 0] != strings) & (met[:, 0] != self.FREE))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.table) - 1)
            met = self.table.take(at[left], axis=0)
            here = met[:, 0] == strings[left]
            out[left[here]] = met.view(np.float64)[here, 1]
            left = left[~here & (met[:, 0] != self.FREE)]
        return out


_loaded: dict[str, tuple[dict[bytes, float], Held]] = {}


def loaded(words: str, strings: str) -> tuple[dict[bytes, float], Held]:
    """Frequent words with log10 of their count and one, and strings, once for each worker process; older ones go."""
    if words not in _loaded:
        _loaded.clear()
        got, own = read_table(words), read_table(strings)
        _loaded[words] = dict(zip(got.column("word").to_pylist(), np.log10(got.column("c").to_numpy() + 1).tolist())), Held(own.column("g").to_numpy().view(np.uint64), own.column("v").to_numpy())
    return _loaded[words]


def least_power(sizes: list, limit: int) -> int:
    """The least power ``p`` so that all entries of it and above, ``v`` of each, are ``limit`` at most."""
    held, least = 0, 1 << 20
    for x in sorted(sizes, key=lambda x: -x["p"]):
        if held + x["v"] > limit:
            break
        held, least = held + x["v"], x["p"]
    return least


def string_keys(strings: np.ndarray) -> pa.Array:
    """A key for each string that is no word and no row's: the end, an s and its eight bytes."""
    raw = np.empty((len(strings), 10), dtype=np.uint8)
    raw[:, 0], raw[:, 1] = END[0], ord("s")
    raw[:, 2:] = strings.astype(">u8").view(np.uint8).reshape(-1, 8)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(10), len(strings), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())


#: What a row's own entry holds beside its key.
MAIN = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())]


def score(docs: DataFrame, depth: int = 5, slots: int = 1 << 21, frequent: int = 100_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte): a row for each row.

    Null and empty texts are one token, the end. Rows with a null doc_id train; repeated rows train and are scored one
    by one; a text's words are held whole, its bytes are coded with those of its neighbours, some 50 bytes for each. With no training document all counts are zero and every bit has probability one half. Extra columns are ignored. ``frequent`` words
    and ``slots`` strings at most are looked up in memory; all others meet their counts and values in a join.
    """
    if not 0 <= depth <= 6:
        raise ValueError("contexts have six bytes at most")
    rows = docs.select(F.monotonically_increasing_id().alias("r"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    vocabulary = materialise(word_counts(rows), "words")
    power = F.floor(F.log2("c") * 8).cast("int")
    sizes = vocabulary.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).collect()  # 8 x 63 rows at most
    n_train, distinct = sum(x["n"] for x in sizes), sum(x["v"] for x in sizes)
    words = written(vocabulary.where((power >= least_power(sizes, frequent)) | (F.col("word") == F.lit(END))), "frequent")
    strings = materialise(string_counts(rows, depth, every=True), "strings")
    levels = tree(strings, depth)
    values = materialise(string_values(strings, levels), "values")
    for done in (strings, *levels):
        drop_table(done)
    often = F.floor(F.log2("m") * 8).cast("int")
    least = least_power(values.groupBy(often.alias("p")).agg(F.count(F.lit(1)).alias("v")).collect(), slots)  # 8 x 63 rows at most
    held = written(values.where(often >= least).select("g", "v"), "held")
    norm = np.log10(float(n_train + distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, tables = loaded(words, held)
        end = logs.get(END)

        def out(r: np.ndarray, keys: pa.Array, n: np.ndarray, main: list[pa.Array] | None = None) -> pa.RecordBatch:
            kinds = [pa.field(name, kind) for name, kind in MAIN]
            whole = pa.nulls(len(keys), pa.struct(kinds)) if main is None else pa.StructArray.from_arrays(main, fields=kinds)
            return pa.RecordBatch.from_arrays([pa.array(r), keys, pa.array(n), whole], ["r", "word", "tf", "main"])

        for chunk in _chunks(batches):
            texts, numbers = [text_words(t) for _, _, t in chunk], np.array([x[0] for x in chunk], dtype=np.int64)
            strings, owner = coded(texts, depth)
            found = tables.log10(strings)
            lost = np.isnan(found)
            scores = np.bincount(owner, weights=np.where(lost, 0, found), minlength=len(chunk))
            if lost.any():
                g, of = strings[lost], owner[lost]
                order = np.lexsort((g, of))
                g, of = g[order], of[order]
                first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (of[1:] != of[:-1])]))
                yield out(numbers[of[first]], string_keys(g[first]), np.diff(np.append(first, len(g))))
            bases, known = np.zeros(len(chunk)), np.zeros(len(chunk), dtype=np.int64)
            rare, times, sizes = [], [], []
            for i, said in enumerate(texts):
                got = np.fromiter(map(logs.get, said, repeat(np.nan)), dtype=float, count=len(said))
                gone = np.isnan(got)
                seen = Counter(said[k] for k in np.flatnonzero(gone).tolist())
                rare.extend(seen.keys())
                times.extend(seen.values())
                sizes.append(len(seen))
                known[i] = len(said) - gone.sum() + (end is not None)
                bases[i] = got[~gone].sum() + (end or 0.0) - norm * known[i] - (0 if end is not None else norm)
            if rare:
                yield out(np.repeat(numbers, sizes), pa.array(rare, pa.binary()), np.array(times, dtype=np.int64))
            # a key of its own, which is no word, deals the row out and meets nothing
            keys = pa.array([END + x[0].to_bytes(8, "little") for x in chunk], pa.binary())
            main = [[x[1] for x in chunk], [len(x) + 1 for x in texts], known, bases, scores, np.bincount(owner, minlength=len(chunk))]
            yield out(numbers, keys, np.zeros(len(chunk), dtype=np.int64), [pa.array(c, kind) for c, (_, kind) in zip(main, MAIN)])

    scored = rows.mapInArrow(run, "r long, word binary, tf long, main struct<doc_id:long,n_tokens:long,n_known:long,base:double,score:double,n_bytes:long>")
    c, string = F.coalesce("c", F.lit(0)), F.col("v").isNotNull()
    key = F.concat(F.lit(END + b"s"), F.unhex(F.lpad(F.hex("g"), 16, "0")))
    entries = vocabulary.select("word", "c", F.lit(None).cast("double").alias("v")).union(values.where(often < least).select(key.alias("word"), F.lit(0).cast("long").alias("c"), "v"))
    base = F.when(string, 0.0).otherwise((F.log10(c + 1) - float(norm)) * F.col("tf"))
    met = scored.join(entries, "word", "left").select("r", "main", F.when(c > 0, F.col("tf")).otherwise(0).alias("known"), base.alias("base"), (F.col("v") * F.col("tf")).alias("score"))
    whole = {name: F.max(f"main.{name}") for name, _ in MAIN}  # of one row
    none = F.lit(0.0)
    by_row = met.groupBy("r").agg(whole["doc_id"].alias("doc_id"), whole["n_tokens"].alias("n_tokens"), (whole["n_known"] + F.sum("known")).alias("n_known"), (whole["base"] + F.sum("base")).alias("base_score"), (whole["score"] + F.coalesce(F.sum("score"), none)).alias("score"), whole["n_bytes"].alias("n_bytes"))
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return by_row.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))
