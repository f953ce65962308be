"""What several operators share: shared-folder tables, row keys, group scans and a caching tokenizer."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only where it is unset and the master is
    local, as in tests. On a cluster without that setting it raises, as no folder of one machine would do."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weftplan-"))
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application, for clusters where it is not installed."""
    import os
    import zipfile
    from pathlib import Path

    sc, root = spark.sparkContext, Path(__file__).resolve().parents[1]
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":  # the default, tens of MB of text to a batch; texts are worth smaller ones
        spark.conf.set(rows, "1000")
    if getattr(sc, "_weftplan_shipped", False) or root.parent.suffix == ".zip":
        return
    path = os.path.realpath(os.path.join(tempfile.mkdtemp(), f"{root.name}.zip"))
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    sc._weftplan_shipped = True


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class _Scopes(threading.local):
    """Tables of each open :func:`scope` of a thread, innermost last."""

    def __init__(self) -> None:
        self.open: list[list[DataFrame]] = []


_scopes = _Scopes()


@contextmanager
def scope() -> Iterator[None]:
    """Tables that are materialised within go when it ends, but for those made with ``keep``, which the scope around it owns."""
    _scopes.open.append([])
    try:
        yield
    finally:
        for df in _scopes.open.pop():
            drop_table(df)


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, gives exact sizes."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.path = path  # for drop_table
    owner = _scopes.open[: -1 if keep else None]
    if owner:
        owner[-1].append(out)
    return out


def written(df: DataFrame, name: str) -> str:
    """Write ``df`` to the shared folder for :func:`read_table`, and return its URI."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return path


def file_system(uri: str):  # noqa: ANN201
    """(file system, path) of a URI, for files that a worker itself reads or writes: what pyarrow knows, ``s3a`` and
    ``s3n`` by its S3 client, and any other scheme through Hadoop's (libhdfs)."""
    from pyarrow import fs

    scheme, _, rest = uri.partition("://")
    if scheme in ("s3a", "s3n"):
        return fs.FileSystem.from_uri(f"s3://{rest}")
    try:
        return fs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid:
        if not rest:
            raise
        host, _, path = rest.partition("/")
        return fs.HadoopFileSystem(f"{scheme}://{host}"), f"/{path}"


def read_table(uri: str) -> pa.Table:
    """A table of bounded size from the shared folder, read by a worker itself."""
    from pyarrow import dataset

    system, path = file_system(uri)
    return dataset.dataset(path, format="parquet", filesystem=system).to_table()


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialise` that nothing needs any more."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(df.path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def keyed(docs: DataFrame, id_col: str = "doc_id", key: str = "_k") -> DataFrame:
    """Add a long ``key`` that is unique for each row and the same in every later read.

    A unique, non-null id is used as it is. Only where ids repeat or are null are rows numbered and written out
    once, as a number given on the fly could differ between two scans.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("i"))
    odd = ids.groupBy("i").count().where(F.col("i").isNull() | (F.col("count") > 1)).limit(1).count()
    if not odd:
        return docs.withColumn(key, F.col(id_col).cast("long"))
    return materialise(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")


#: Rows, at most, of the table that :func:`maybe_among` broadcasts.
BUCKETS = 1 << 18


def maybe_among(docs: DataFrame, ids: DataFrame, key: str = "_k") -> DataFrame:
    """``docs`` without most rows whose ``key`` is not in the column of ``ids``, before a join on it shuffles them.

    A semi-join on BUCKETS hashes at most, a broadcast of fixed size; the more ids there are, the more rows pass.
    """
    at = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(BUCKETS)).cast("int")
    held = ids.select(at(F.col(ids.columns[0])).alias("bucket")).distinct()
    return docs.join(F.broadcast(held), at(F.col(key)) == F.col("bucket"), "left_semi")


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows sorted by ``keys`` in, one table for each group out; holds one group and one batch at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), n]
        for a, b in zip(starts, starts[1:]):
            if a == b:
                continue
            now = tuple(c[a] for c in cols)
            if last is not None and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


class _Numbers(dict):
    """Numbers its keys as they are first asked for."""

    def __init__(self, known=()) -> None:  # noqa: ANN001
        super().__init__(known)
        self.new: list = []

    def __missing__(self, key):  # noqa: ANN001, ANN204
        i = self[key] = len(self)
        self.new.append(key)
        return i


class CachingEncoder:
    """The ``tokenizers`` library behind a cache of space- or newline-led pieces.

    A byte-level BPE with the usual split pattern never joins a non-space character with a following space or newline.
    So a text whose only white space is single spaces and newlines between other characters can be cut before each of
    them and its pieces encoded on their own; any other text goes to the library whole. New pieces are encoded many at
    a time, as one text, and told apart by the tokens that begin with a space or newline. Results equal
    ``encode(text, add_special_tokens=False)``.
    """

    #: Pieces kept at most; beyond that all but the first go, which changes no result.
    LIMIT = 600_000
    #: Pieces that are joined to one text.
    JOIN = 256
    #: Pieces that stay when others go, and in a worker that waits for its next task.
    keep = 100_000

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.starts[[i for token, i in vocabulary.items() if token[0] in "\u0120\u010a"]] = True  # how the vocabulary writes a space and a newline
        self.clear()

    def trim(self, keep: int | None = None) -> None:
        """Forget all but the first pieces, which are those that texts share most."""
        keep = keep or self.keep
        if len(self.numbers) != self.used:  # a task broke off while it learned
            self.clear()
        elif self.used > keep:
            first, self.used = islice(self.numbers.items(), keep), keep
            self.numbers = _Numbers(first)
            self.flat, self.begin = self.flat[: self.begin[keep]].copy(), self.begin[: keep + 1].copy()

    def clear(self) -> None:
        self.numbers, self.used = _Numbers(), 0
        self.flat = np.empty(1 << 16, dtype="<u4")  # the ids of all pieces, one after another
        self.begin = np.zeros((1 << 14) + 1, dtype=np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _store(self, ids: np.ndarray, ends: np.ndarray) -> None:
        """Append the ids of the next pieces, which end at ``ends`` of them."""
        size = self.begin[self.used]
        if size + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(len(self.flat) + len(ids), dtype="<u4")])
        if self.used + len(ends) >= len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros(len(self.begin) + len(ends), dtype=np.int64)])
        self.flat[size : size + len(ids)] = ids
        self.begin[self.used + 1 : self.used + 1 + len(ends)] = size + ends
        self.used += len(ends)

    def _learn(self) -> None:
        """Encode the pieces that are new; a tuple holds a piece with no space before it."""
        new, self.numbers.new = self.numbers.new, []
        for at in range(0, len(new), self.JOIN):
            part = new[at : at + self.JOIN]
            texts = [x[0] if isinstance(x, tuple) else x if x[0] == "\n" else " " + x for x in part]
            whole = [isinstance(x, tuple) for x in part]
            (ids,) = self._ids(["".join(t for t, w in zip(texts, whole) if not w)])
            cuts = np.flatnonzero(self.starts[ids])
            if len(cuts) == len(part) - sum(whole) and (not len(cuts) or cuts[0] == 0):
                if not any(whole):
                    self._store(ids, np.append(cuts[1:], len(ids)))
                    continue
                pieces = iter(np.split(ids, cuts[1:]))
                each = [self._ids([t])[0] if w else next(pieces) for t, w in zip(texts, whole)]
            else:  # a vocabulary of another kind
                each = self._ids(texts)
            self._store(np.concatenate(each), np.cumsum([len(x) for x in each]))

    @staticmethod
    def _plain(t: str, parts: list[str]) -> bool:
        """Whether single spaces and newlines, each between other characters, are the only white space."""
        if t[0].isspace() or t[-1].isspace() or "  " in t or " \n" in t or "\n " in t or "\n\n" in t:
            return False
        if t.isascii():
            return not any(c in t for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
        return len(t.split()) == len(parts)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null: none) as little-endian unsigned 32-bit integers."""
        if self.used > self.LIMIT:
            self.trim()
        get = self.numbers.__getitem__
        found: list[int] = []
        ends, odd = [], {}
        for i, t in enumerate(texts):
            if t:
                parts = (t.replace("\n", " \n") if "\n" in t else t).split(" ")
                if self._plain(t, parts):
                    parts[0] = (parts[0],)
                    found.extend(map(get, parts))
                else:
                    odd[i] = self._ids([t])[0].tobytes()
            ends.append(len(found))
        self._learn()
        at = np.fromiter(found, dtype=np.int64, count=len(found))
        first = self.begin[at]
        sizes = self.begin[at + 1] - first
        out = np.concatenate([[0], np.cumsum(sizes)])
        raw = self.flat[np.repeat(first - out[:-1], sizes) + np.arange(out[-1])].tobytes()
        edges = (out[[0, *ends]] * 4).tolist()
        return [odd[i] if i in odd else raw[a:b] for i, (a, b) in enumerate(zip(edges, edges[1:]))]


_encoders: dict[str, CachingEncoder] = {}


def encoder(path: str) -> CachingEncoder:
    """One encoder for each worker process and file, so that tasks share its cache."""
    if path not in _encoders:
        _encoders[path] = CachingEncoder(path)
    return _encoders[path]


def encoded(batches: Iterable[pa.RecordBatch], path: str, step: int = 256, keep: int = CachingEncoder.keep) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of each batch with the ids of their texts; ``keep`` pieces stay from task to task."""
    enc = encoder(path)
    enc.keep = keep
    try:
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                yield part, enc.encode(part.column("text").to_pylist())
    finally:
        enc.trim()  # a worker that waits for its next task holds a small cache


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
