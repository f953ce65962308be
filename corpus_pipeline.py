"""The corpus pipeline: quality rules, near-duplicates, repeated passages, mixing and packing, each stage on what the last one kept.

All stages but the last return the columns of their input, extra ones and names that clash with their own too. An empty
table passes through as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftplan.llm import line_dedup, mixing, packing, quality_rules, similar
from weftplan.llm.common import materialise, ship


def bundled(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns as one, out of the way of names that operators add."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("_row"))


def unbundled(docs: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The ``columns`` that :func:`bundled` put together, or new ones for them."""
    return docs.select(*(new[c].alias(c) if c in new else F.col("text") if c == "text" else F.col(f"_row.`{c}`") for c in columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the n-gram ratio.

    Null, empty and short texts fail. Rows are judged one by one: repeated rows and null ids stay or go by their text.
    """
    ship(spark)
    model = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return unbundled(quality_rules.judge(bundled(docs), model).where("kept"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: similarity of five-word shingles of 0.8 or more
    among those that SimHash finds.

    Texts without words are one group. Rows that repeat that id all stay, as do rows without an id, which no other
    document can stand for.
    """
    ship(spark)
    return similar.deduplicate(docs).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages that an earlier one holds; those of which no word stays go.

    Null and empty texts lose nothing and stay. Of repeated rows the first keeps its passages. ``n_chars``, where there
    is one, counts what stays.
    """
    ship(spark)
    out = line_dedup.remove_repeated(bundled(docs)).where(F.col("removed").isNull() | (F.col("text") != ""))
    n_chars = F.when(F.col("removed").isNull(), F.col("_row.n_chars")).otherwise(F.char_length("text")) if "n_chars" in docs.columns else None
    return unbundled(out, docs.columns, n_chars=n_chars)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says.

    Repeated rows have equal rates and copies; rows without an id share one rounding; null and empty texts count one token.
    """
    ship(spark)
    mixed = mixing.mix(bundled(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return unbundled(mixing.apply_copies(mixed, ["text", "_row"]), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1,024 tokens; null and empty texts are the end token alone.

    Repeated rows are packed one by one.
    """
    ship(spark)
    return packing.pack(docs, tokens=1024, end_id=2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing", mixture),
    ("best-fit packing", packed),
]

#: SQL can't express the hashes, fitted models and the packing; the test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
