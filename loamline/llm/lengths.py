"""Token counts as an exact length histogram, and what follows from it for every context limit."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamline.llm.common import modest_batches, quoted
from loamline.llm.packing import library_encoder
from loamline.llm.spans import small_batches, text_bytes
from loamline.session import cut_lineage

# Lengths that share a block when sums run over the histogram.
BLOCK = 1024


def length_histogram(df: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """``n_tokens`` and ``n_docs``: how many documents have each encoded length.

    NULL and empty texts have length 0. Documents are counted inside the task that encodes them,
    so that what is shuffled is one row for each length and batch. No rows give no rows.
    """
    modest_batches(df.sparkSession)
    narrow = df.select(quoted(text).cast("string").alias("text_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = library_encoder(rank_file, pattern)
        for batch in small_batches(batches, 0):
            _, offsets = code.encode_bytes(*text_bytes(batch.column(0)))
            lengths, counts = np.unique(np.diff(offsets), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lengths, pa.int64()), pa.array(counts, pa.int64())], ["n_tokens", "n"]
            )

    counted = narrow.mapInArrow(run, "n_tokens long, n long")
    return counted.groupBy("n_tokens").agg(F.sum("n").alias("n_docs"))


def _running(df: DataFrame, value: Column, name: str, descending: bool) -> DataFrame:
    """Sums of ``value`` over the rows up to each one in order of ``n_tokens``, itself included.

    Sums run inside blocks of lengths and are shifted by the blocks before them: the table of
    blocks is as long as the longest document, divided by the block size.
    """
    order = F.col("n_tokens").desc() if descending else F.col("n_tokens").asc()
    block = F.col("block").desc() if descending else F.col("block").asc()
    before = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    shifts = df.groupBy("block").agg(F.sum(value).alias("all_")).select(
        "block", F.coalesce(F.sum("all_").over(before), F.lit(0)).alias("shift_")
    )
    inside = F.sum(value).over(Window.partitionBy("block").orderBy(order))
    return (
        df.withColumn("part_", inside)
        .join(shifts, "block")
        .withColumn(name, F.col("part_") + F.col("shift_"))
        .drop("part_", "shift_")
    )


def context_table(histogram: DataFrame, limits: Sequence[int] = (), shares: Sequence[float] = ()) -> DataFrame:
    """For every length that occurs and every one of ``limits``, taken as a context limit.

    From running and suffix sums of the histogram: ``n_docs`` of that length (0 for a limit that no
    document has); ``docs_up_to`` and ``docs_from``, ``tokens_from`` of documents at least that long;
    ``truncated_total``, all tokens when each document is cut at the limit; ``quantile_of``, those
    ``shares`` whose quantile this length is, the smallest one that at least that share of the
    documents do not exceed. Without documents there are the limits alone, with zeros.
    """
    if limits:
        stated = histogram.sparkSession.range(1).select(
            F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("n_tokens"),
            F.lit(0).cast("long").alias("n_docs"),
        )
        histogram = histogram.unionByName(stated).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    out = cut_lineage(histogram).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    tokens = F.col("n_tokens") * F.col("n_docs")
    out = _running(out, F.col("n_docs"), "docs_up_to", descending=False)
    out = _running(out, tokens, "tokens_up_to", descending=False)
    out = _running(out, F.col("n_docs"), "docs_from", descending=True)
    out = _running(out, tokens, "tokens_from", descending=True)
    above = F.col("docs_from") - F.col("n_docs")
    total = F.col("docs_up_to") + above
    asked = F.array(*[F.lit(float(x)) for x in shares]) if shares else F.array().cast("array<double>")

    def met(share: Column) -> Column:
        rank = F.greatest(F.lit(1), F.ceil(share * total))
        return (F.col("docs_up_to") - F.col("n_docs") < rank) & (rank <= F.col("docs_up_to"))

    return out.select(
        "n_tokens",
        "n_docs",
        "docs_up_to",
        "docs_from",
        "tokens_from",
        (F.col("tokens_up_to") + F.col("n_tokens") * above).alias("truncated_total"),
        F.filter(asked, met).alias("quantile_of"),
    )


def totals_at(context: DataFrame, limits: Sequence[int]) -> DataFrame:
    """Documents and tokens at each given limit, whether or not a document has that length.

    The sums of the next smaller length answer a limit: documents beyond it count as the limit.
    One pass over the table, one row out of it. No documents give zeros.
    """
    above = F.col("docs_from") - F.col("n_docs")
    held = F.struct(
        "n_tokens", above.alias("above"), (F.col("truncated_total") - F.col("n_tokens") * above).alias("inside")
    )
    floors = [
        F.max(F.when(F.col("n_tokens") <= limit, held)).alias(f"floor_{i}") for i, limit in enumerate(limits)
    ]
    found = context.agg(F.coalesce(F.max("docs_from"), F.lit(0)).alias("total"), *floors)

    def answer(i: int, limit: int) -> Column:
        beyond = F.coalesce(F.col(f"floor_{i}.above"), F.col("total"))
        inside = F.coalesce(F.col(f"floor_{i}.inside"), F.lit(0))
        return F.struct(
            F.lit(int(limit)).cast("long").alias("context_limit"),
            F.col("total").alias("n_docs"),
            beyond.alias("docs_cut"),
            (inside + beyond * int(limit)).alias("truncated_total"),
        )

    rows = F.array(*[answer(i, limit) for i, limit in enumerate(limits)])
    return found.select(F.explode(rows).alias("row")).select("row.*")


def quantiles(context: DataFrame, shares: Sequence[float]) -> DataFrame:
    """The smallest length that at least a share of the documents do not exceed."""
    total = F.col("docs_up_to") + F.col("docs_from") - F.col("n_docs")
    wanted = F.explode(F.array(*[F.lit(float(x)) for x in shares]))
    return (
        context.filter("n_docs > 0")
        .withColumn("share", wanted)
        .filter(F.col("docs_up_to") >= F.ceil(F.col("share") * total))
        .groupBy("share")
        .agg(F.min("n_tokens").alias("n_tokens"))
    )
