"""A corpus pipeline of four stages over the documents table; each stage's rows are written and reread."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamline.llm import cotraining, jaccard, line_dedup, packing, queries
from loamline.llm.common import free_name, quoted, table
from loamline.session import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    name = free_name(docs, "quality_probability")
    scored = cotraining.score_documents(docs, table(spark, sf_dir, "labels"), name)
    return scored.filter(cotraining.accepted(name)).select(*map(quoted, docs.columns))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Template lines of a source go from its documents; ``n_chars`` follows the text."""
    lost = free_name(docs, "n_dropped")
    cut = line_dedup.drop_template_lines(docs, dropped=lost)
    chars = F.when(F.col(lost) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", chars).select(*map(quoted, docs.columns))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    return jaccard.one_per_component(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each remaining document lies in the packed sequences."""
    _, placed = packing.pack_documents(
        docs, queries.RANKS, queries.PATTERN, queries.CONTEXT, queries.END_ID, queries.SPECIAL
    )
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", drop_lines),
    ("ngram_jaccard", ngram_jaccard),
    ("packing", pack),
]

# Tokenizing and the classifier cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    *before, (_, last) = STAGES
    for _, stage in before:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return last(spark, docs, sf_dir)
