"""Soft-membership mixing of documents to target weights of domains.

A classifier fitted on a bounded sample of the labelled table gives each document a posterior over domains (clean, low
quality, toxic). Nonnegative document rates are then fitted by projected-gradient least squares, so that the domains'
expected token totals, sum of rate x tokens x posterior, meet their targets. A step needs totals over all documents,
one small aggregation; a rate follows from the posterior and the few steps so far, so no table of rates is kept.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise

DOMAINS = ("clean", "low", "toxic")
#: Share of its own expected tokens that each domain keeps, before rounding to copies.
TARGETS = (1.05, 0.25, 0.25)
#: Strings of a text that are looked up at a time.
BLOCK = 1 << 20


def domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, F.lit(2)).when(quality == 0, F.lit(1)).when((quality == 1) & (toxic == 0), F.lit(0))


class Classifier:
    """Posteriors from hashed byte strings of ``width`` bytes: an array look-up and a sum, over the whole text.

    A string speaks for a domain by the log ratio of its share there to that in the others, beyond ``floor`` (so that
    common strings of long texts do not drown a few telling ones). A domain's evidence is the mean over a text's strings;
    its logit is -sharpness at the median of the other domains' labelled documents and +sharpness at that of its own.
    The first domain is what remains: logit zero.
    """

    def __init__(self, bits: int = 16, width: int = 5, sharpness: float = 8.0, floor: float = 1.5):
        self.bits, self.width, self.sharpness, self.floor = bits, width, sharpness, floor
        self.weights = np.zeros((len(DOMAINS), 1 << bits))
        self.centre, self.half, self.unseen = np.zeros(len(DOMAINS)), np.ones(len(DOMAINS)), np.zeros(len(DOMAINS))

    def buckets(self, text: str | None) -> Iterator[np.ndarray]:
        """The bucket of every string of a text, BLOCK of them at a time."""
        raw = b" " + (text or "").encode("utf-8", "surrogatepass").lower() + b" " * (self.width - 1)
        for at in range(0, len(raw) - self.width + 1, BLOCK):
            part = np.frombuffer(raw[at : at + BLOCK + self.width - 1], dtype=np.uint8)
            n = len(part) - self.width + 1
            h = np.zeros(n, dtype=np.uint64)
            for i in range(self.width):
                h *= np.uint64(0x100000001B3)
                h += part[i : i + n]
            h *= np.uint64(0x9E3779B97F4A7C15)
            yield (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def evidence(self, text: str | None) -> np.ndarray:
        """The mean weight of a text's strings for each domain."""
        total, n = np.zeros(len(DOMAINS)), 0
        for at in self.buckets(text):
            total[1:] += [w[at].sum() for w in self.weights[1:]]
            n += len(at)
        return total / n

    def posterior(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.empty((0, len(DOMAINS)))
        x = self.sharpness * (np.stack([self.evidence(t) for t in texts]) - self.centre) / self.half + self.unseen
        x = np.exp(np.clip(x, -30, 30))
        return x / x.sum(axis=1, keepdims=True)

    def weigh(self, counts: np.ndarray) -> None:
        """Set the weights from the number of each domain's strings in each bucket."""
        counts = counts + 0.5
        for d in range(1, len(DOMAINS)):
            others = counts.sum(axis=0) - counts[d]
            ratio = np.log(counts[d] / counts[d].sum()) - np.log(others / others.sum())
            self.weights[d] = np.maximum(0, ratio - self.floor)

    def place(self, e: np.ndarray, labels: np.ndarray) -> None:
        """Set centre and half-width from the labelled texts' evidence; a domain without a labelled text gets next to none."""
        for d in range(1, len(DOMAINS)):
            own, rest = e[labels == d, d], e[labels != d, d]
            if len(own) and len(rest) and np.median(own) > np.median(rest):
                self.centre[d], self.half[d] = (np.median(own) + np.median(rest)) / 2, (np.median(own) - np.median(rest)) / 2
            else:
                self.unseen[d] = -20.0


def sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(doc_id, domain, text): ``limit`` labelled documents of each domain at most, by the hash of their id, with whole texts.

    Of an id's labels the last domain counts, of its texts the least.
    """
    rows = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), domain(F.col("quality"), F.col("toxic")).alias("domain")).where("domain is not null").groupBy("doc_id").agg(F.max("domain").alias("domain"))
    picked = None
    for d in range(len(DOMAINS)):
        part = rows.where(F.col("domain") == d).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        picked = part if picked is None else picked.union(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")  # 3 x limit rows
    return texts.groupBy("doc_id").agg(F.max("domain").alias("domain"), F.min("text").alias("text"))


def fit(labelled: DataFrame, **kw) -> Classifier:
    """From (domain, text), read twice on the executors, so that no text goes to the driver.

    The driver gets a count for each domain and bucket, and each labelled text's evidence. Without labels posteriors are even.
    """
    model = Classifier(**kw)
    size = 1 << model.bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(DOMAINS) * size, dtype=np.int64)
        for batch in batches:
            for d, text in zip(batch.column("domain").to_pylist(), batch.column("text").to_pylist()):
                for found in model.buckets(text):
                    counts[d * size : (d + 1) * size] += np.bincount(found, minlength=size)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["at", "n"])

    # a row for each domain and bucket at most
    got = labelled.select("domain", "text").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    if not len(got):
        return model
    counts = np.zeros(len(DOMAINS) * size)
    counts[got["at"].to_numpy()] = got["n"].to_numpy()
    model.weigh(counts.reshape(len(DOMAINS), size))
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                e = np.stack([shared.value.evidence(t) for t in batch.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("domain"), *(pa.array(x) for x in e.T)], ["domain", *DOMAINS])

    got = labelled.select("domain", "text").mapInArrow(evidence, ", ".join(["domain int", *(f"{name} double" for name in DOMAINS)])).toPandas()
    model.place(got[list(DOMAINS)].to_numpy(), got["domain"].to_numpy())
    return model


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs`` with ``tokens`` (words, one at least) and ``p``, the posterior of each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column("text").to_pylist()
                # shares of 2^-20, so that sums are exact
                p = np.rint(shared.value.posterior(texts) * (1 << 20)).astype(np.int64)
                tokens = pa.array([max(1, len((t or "").split())) for t in texts], pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, tokens, lists], [*part.schema.names, "tokens", "p"])

    kind = T.StructType([*docs.schema.fields, T.StructField("tokens", T.LongType()), T.StructField("p", T.ArrayType(T.LongType()))])
    return docs.mapInArrow(run, kind)


def rate(p: Column, steps: list[list[float]]) -> Column:
    """Projected to nonnegative after each step, from one: the projected gradient's path of a document."""
    r = F.lit(1.0)
    for step in steps:
        r = F.greatest(F.lit(0.0), r - sum((F.get(p, d) * F.lit(float(g) / (1 << 20)) for d, g in enumerate(step)), F.lit(0.0)))
    return r


@dataclass(frozen=True)
class Fit:
    """The steps to the rates, the domains' expected totals and what they should be."""

    steps: list[list[float]]
    totals: list[float]
    goals: list[float]
    met: bool


def goals(now: np.ndarray, targets: tuple[float, ...], kind: str) -> np.ndarray:
    """Token totals that are asked for: ``shares`` of each domain's own, ``weights`` of all tokens, or ``totals`` as they are."""
    given = np.asarray(targets, dtype=float)
    if kind not in ("shares", "weights", "totals") or given.shape != (len(DOMAINS),) or (given < 0).any() or not given.any() and kind == "weights":
        raise ValueError(f"no targets: {targets} as {kind}")
    return given * now if kind == "shares" else given / given.sum() * now.sum() if kind == "weights" else given


def fit_rates(members: DataFrame, targets: tuple[float, ...] = TARGETS, kind: str = "shares", tolerance: float = 1e-3, rounds: int = 60) -> Fit:
    """Each round is one aggregation of D + D^2 sums.

    The gradient of the squared misses, in the metric of document tokens, is a combination of the posteriors; its
    coefficients solve the D x D Gram system over documents that can still move, so a step without projection is exact.
    A step that projection turned into a worse one is halved. The fit ends when every miss is within ``tolerance`` of all
    tokens, that is when the mixture's weights are met that closely (more would be had only by ever higher rates of ever
    fewer documents), or when five rounds bring the squared misses down by less than a hundredth: then ``met`` is false,
    as no nonnegative rates reach the goals. If neither comes in ``rounds``, it raises.
    """
    n, steps, goal, kept, best = len(targets), [], None, [], np.zeros(len(targets))
    seen: list[float] = []
    for _ in range(rounds):
        r = rate(F.col("p"), steps)
        weight, live = F.col("tokens") * r, F.when(r > 0, F.col("tokens")).otherwise(0)
        share = [F.get("p", d) / float(1 << 20) for d in range(n)]
        sums = [F.sum(weight * share[d]) for d in range(n)] + [F.sum(live * share[a] * share[b]) for a in range(n) for b in range(a, n)]
        got = [x or 0.0 for x in members.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()]
        totals = np.array(got[:n])
        if goal is None:
            goal = goals(totals, targets, kind)
        miss = totals - goal
        now = float(np.square(miss).sum())
        worse = bool(seen) and now > seen[-1]
        if not worse:
            seen.append(now)
            kept, best = list(steps), totals
        small = np.abs(best - goal).max() / max(1.0, best.sum(), goal.sum())
        stuck = worse and max(map(abs, steps[-1])) < 1e-12
        if small <= tolerance or stuck or len(seen) > 5 and seen[-1] > 0.99 * seen[-6]:
            return Fit(kept, best.tolist(), goal.tolist(), bool(small <= tolerance))
        if worse:
            steps = [*kept, [g / 2 for g in steps[-1]]]
            continue
        gram, it = np.zeros((n, n)), iter(got[n:])
        for a in range(n):
            for b in range(a, n):
                gram[a, b] = gram[b, a] = next(it)
        steps = [*kept, np.linalg.lstsq(gram + np.eye(n) * 1e-9 * max(1.0, np.trace(gram)), miss, rcond=None)[0].tolist()]
    raise RuntimeError(f"the rates did not settle in {rounds} rounds: totals {best.tolist()}, goals {goal.tolist()}")


def copies(r: Column, key: Column) -> Column:
    """A whole number of copies with mean ``r``: the fraction is decided by the hash of ``key``, the same at every run."""
    u = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1_000_003)) / 1_000_003.0
    return F.floor(r + u).cast("long")


def mix(docs: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS, kind: str = "shares", limit: int = 1500) -> DataFrame:
    """``docs``, every row and column, with tokens (long), p_clean, p_low, p_toxic, rate and copies (a clashing column goes).

    ``targets`` are a number for each domain, see :func:`goals`. Where no rates reach them, the nearest are given, with a
    warning; where the fit does not settle, it raises. Null and empty texts have one token and a posterior from the
    prior. Rows with a null doc_id share one decision; repeated rows have equal rates and copies. Very long texts are
    looked up in blocks. Without labels posteriors are even. An empty table gives an empty result.
    """
    model = fit(materialise(sample(docs, labels, limit), "labelled"))
    added = ("tokens", *(f"p_{name}" for name in DOMAINS), "rate", "copies")
    columns = [c for c in docs.columns if c not in added]
    rows = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in columns if c != "text")).alias("row"))
    members = materialise(memberships(rows, model), "members")
    found = fit_rates(members, targets, kind)
    if not found.met:
        warnings.warn(f"no rates reach the goals {found.goals}; the nearest totals are {found.totals}", stacklevel=2)
    r = rate(F.col("p"), found.steps)
    shares = ((F.get("p", d) / float(1 << 20)).alias(f"p_{name}") for d, name in enumerate(DOMAINS))
    return members.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in columns), F.col("tokens"), *shares, r.alias("rate"), copies(r, F.col("row.doc_id")).alias("copies"))


def apply_copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The ``columns`` of each row as often as ``copies`` says."""
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return mixed.where("copies > 0").select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), times).select("row.*")
