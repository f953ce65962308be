"""Quality rules with DataFrame functions only: fixed rules on a text, then a hashed n-gram log-likelihood ratio.

Words and word pairs of a text are hashed to ``buckets``. Two multinomials over them, one of trusted documents (a
bounded sample of labelled ones, smoothed towards the corpus by ``buckets`` n-grams of it) and one of the whole corpus,
give each bucket a weight, the logarithm of the ratio of its shares, in millionths. A document's score is the mean weight of its n-grams, so length does not count.
The threshold lies between the labelled sample's good and bad documents, ``margin`` of the way from the mean of good ones that
the weights did not see (every second one) to that of the bad ones; every document is held against it. All sums are of integers, so results do not depend on order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MILLION = 1_000_000


def let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of ``value``, which is evaluated once for a row however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Runs of other bytes than space, \\t, \\n, \\v, \\f and \\r; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


#: Low bits of a sort key that hold a place; longer texts take keys of two parts.
PLACE = 13


def repeat_words(h: Column, window: int = 3) -> Column:
    """Words that lie in a run of ``window`` words found twice or more in the text, the first included.

    ``h`` are the words' hashes; runs are told apart by 64-bit hashes of them.
    """
    mask = (1 << PLACE) - 1

    def run(h: Column, i: Column) -> Column:
        return F.xxhash64(*(F.get(h, i + k) for k in range(window)))

    def covered(places: Column) -> Column:
        steps = F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), lambda a, b: F.least(F.lit(window), F.coalesce(b - a, F.lit(window))))
        return F.aggregate(steps, F.lit(0), lambda n, x: n + x)

    def places(pairs: Column) -> Column:
        return let(pairs, lambda x: F.sort_array(F.array_union(x["a"], x["b"])))

    def short(h: Column) -> Column:
        """Keys of one number: the upper bits of the run's hash and its place; neighbours that agree are compared in full."""
        keys = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: run(h, i).bitwiseAND(F.lit(~mask).cast("long")).bitwiseOR(i.cast("long"))))
        place = lambda key: key.bitwiseAND(F.lit(mask).cast("long")).cast("int")

        def pairs(s: Column) -> Column:
            near = F.filter(F.sequence(F.lit(0), F.size(s) - 2), lambda j: F.get(s, j).bitwiseXOR(F.get(s, j + 1)).between(F.lit(0), F.lit(mask)))
            two = F.transform(near, lambda j: F.struct(place(F.get(s, j)).alias("a"), place(F.get(s, j + 1)).alias("b")))
            return F.filter(two, lambda x: run(h, x["a"]) == run(h, x["b"]))

        return let(keys, pairs)

    def long(h: Column) -> Column:
        runs = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.struct(run(h, i).alias("h"), i.alias("p"))))
        pairs = lambda r: F.filter(F.zip_with(r, F.slice(r, 2, F.size(r)), lambda a, b: F.struct((a["h"] == b["h"]).alias("same"), a["p"].alias("a"), b["p"].alias("b"))), lambda x: F.coalesce(x["same"], F.lit(False)))
        return F.transform(let(runs, pairs), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))

    def count(h: Column) -> Column:
        return let(places(F.when(F.size(h) <= mask, short(h)).otherwise(long(h))), covered)

    return F.when(F.size(h) > window, let(h, count)).otherwise(F.lit(0)).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with the array ``_h`` of the words' hashes and n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumn("_w", words(F.col("text"))).withColumns({"_h": hashes(F.col("_w")), "word_chars": F.char_length(F.array_join(F.col("_w"), "")).cast("long")}).drop("_w")
    return out.withColumns({
        "n_words": F.size("_h").cast("long"),
        "n_symbols": F.char_length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(F.col("_h")),
    })


def hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def grams(h: Column, buckets: int) -> Column:
    """Buckets of the words and word pairs, from the words' hashes."""

    def both(h: Column) -> Column:
        one = F.transform(h, lambda x: F.pmod(x, F.lit(buckets)).cast("int"))
        two = F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.when(b.isNotNull(), F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int")))
        return F.concat(one, F.filter(two, lambda x: x.isNotNull()))

    return let(h, both)  # where Catalyst moves the hashes into this expression, they are still made once


@dataclass(frozen=True)
class Model:
    """Weights of the buckets and the threshold on a document's mean weight, all in millionths."""

    weights: tuple[int, ...]
    threshold: int

    def total(self, h: Column) -> Column:
        table = F.expr(f"cast(split('{','.join(map(str, self.weights))}', ',') as array<int>)")
        return F.aggregate(grams(h, len(self.weights)), F.lit(0).cast("long"), lambda s, b: s + F.get(table, b))

    def passes(self, total: Column, n_words: Column) -> Column:
        return total >= self.threshold * F.greatest(2 * n_words - 1, F.lit(0))


def labelled_sample(labels: DataFrame, limit: int) -> DataFrame:
    """(doc_id, good): ``limit`` trusted documents (quality 1, toxic not 1) and as many of quality 0, by the hash of their id."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) != 1)
    rows = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), good.alias("good"), (F.col("quality") == 0).alias("bad"))
    pick = lambda df: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return pick(rows.where("good")).union(pick(rows.where("bad and not good"))).select("doc_id", "good")


def fit(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 14, limit: int = 10_000, margin: float = 0.15) -> Model:
    """Weights from all of ``docs`` and the labelled sample; at most ``buckets`` rows reach the driver.

    Without trusted documents every weight and the threshold are zero (all pass); without bad ones the threshold lies
    below any score (all pass). Labels of absent documents and null labels count for nothing.
    """
    sample = labelled_sample(labels, limit).groupBy("doc_id").agg(F.bool_and("good").alias("good"))
    part = F.when(~F.col("good"), F.lit("bad")).when(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, F.lit("trusted")).otherwise(F.lit("good"))
    sample = F.broadcast(sample.select("doc_id", part.alias("part")))  # 2 x limit rows at most
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), hashes(words(F.col("text"))).alias("_h")).join(sample, "doc_id", "left")
    counts = marked.select(F.explode(grams(F.col("_h"), buckets)).alias("bucket"), "part")
    rows = counts.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), *(F.count_if(F.col("part") == p).alias(p) for p in ("trusted", "good", "bad")))
    t, r = F.sum("trusted").over(everything()), F.sum("raw").over(everything())
    share = (F.col("raw") + 1) / (r + buckets)
    ratio = F.log((F.col("trusted") + buckets * share) / (t + buckets)) - F.log(share)
    got = rows.select("bucket", "trusted", "good", "bad", t.alias("t"), F.round(ratio * MILLION).cast("int").alias("weight")).collect()
    if not got or not got[0]["t"]:
        return Model((0,) * buckets, 0)
    from math import log

    weights = [round(log(buckets / (got[0]["t"] + buckets)) * MILLION)] * buckets  # of a bucket that no document has
    for x in got:
        weights[x["bucket"]] = x["weight"]

    def mean(part: str) -> int | None:
        n = sum(x[part] for x in got)
        return sum(x[part] * x["weight"] for x in got) // n if n else None

    good, bad = mean("good") if mean("good") is not None else mean("trusted"), mean("bad")
    if bad is None or bad >= good:
        return Model(tuple(weights), -(1 << 31))
    return Model(tuple(weights), good - int((good - bad) * margin))


def everything():  # noqa: ANN201
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))  # over rows of buckets, so `buckets` of them at most


#: Columns that :func:`judge` adds.
JUDGED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def judge(docs: DataFrame, model: Model, min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """``docs``, every row and column, with the counts of :func:`features`, base_failed, score (millionths) and kept; these
    replace columns of such names.

    Null and empty texts have no words and fail. Rows are judged one by one, repeated rows and null ids included. A very
    long text is held whole with its words and hashes, some 100 bytes for each word. An empty table gives an empty result.
    """
    n = F.col("n_words")
    failed = (n < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * n)
    columns = [c for c in docs.columns if c not in JUDGED]
    rest = [F.col(f"`{c}`") for c in columns if c != "text"]
    rows = docs.select("text", F.struct(*(rest or [F.lit(0).alias("none")])).alias("_row"))
    out = features(rows).withColumn("base_failed", failed).withColumn("_total", model.total(F.col("_h")))
    out = out.withColumn("score", F.when(n > 0, F.col("_total") / (2 * n - 1))).withColumn("kept", ~F.col("base_failed") & model.passes(F.col("_total"), n))
    return out.select(*(F.col("text") if c == "text" else F.col(f"_row.`{c}`") for c in columns), *JUDGED)
