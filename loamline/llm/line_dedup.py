"""Site-relative line dedup with DataFrame functions only.

A line that stands on more than a given share of a host's pages is part of the site's template.
The pages with each line are counted by host, divided by the host's page total, and the lines
above the ratio are dropped from that host's pages. Pages of one text count once in both numbers,
so that a group of copies does not make its own lines a template.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import free_name, quoted
from loamline.session import cut_lineage

RATIO = 0.02
# A line on fewer pages is no template, however small the host.
MIN_PAGES = 5
EDGE = " \t\r"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def line_key(line: Column) -> Column:
    """Lines are told apart, within their host, by a 64-bit hash without surrounding blanks."""
    return F.xxhash64(F.btrim(line, F.lit(EDGE)))


def _keys(text: Column) -> Column:
    filled = F.filter(lines_of(text), lambda x: F.btrim(x, F.lit(EDGE)) != "")
    return F.array_distinct(F.transform(filled, line_key))


def template_lines(
    df: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``host_`` and ``keys_``, the hashes of its template lines.

    What is shuffled of a page is a hash of its text and those of its lines, combined map-side
    where pages are equal. Counts combine map-side too, so a host with any share of the pages is
    one row per line and task. A host has at most (mean lines a page) / ratio such lines, so its
    array is short.
    """
    pages = df.select(quoted(host).alias("host_"), quoted(text).alias("text_")).filter(F.col("host_").isNotNull())
    # A NULL among a page's lines counts the page itself.
    lines = F.concat(F.array(F.lit(None).cast("long")), F.coalesce(_keys(F.col("text_")), F.array().cast("array<bigint>")))
    single = pages.select("host_", F.xxhash64("text_").alias("page_"), lines.alias("lines_")).distinct()
    counted = (
        single.select("host_", F.explode("lines_").alias("key_"))
        .groupBy("host_", "key_")
        .agg(F.count(F.lit(1)).alias("pages_"))
        .filter(F.col("key_").isNull() | (F.col("pages_") >= min_pages))
    )
    counted = cut_lineage(counted)
    totals = counted.filter(F.col("key_").isNull()).select("host_", F.col("pages_").alias("all_"))
    frequent = counted.filter(F.col("key_").isNotNull()).join(totals, "host_")
    frequent = frequent.filter(F.col("pages_") > F.col("all_") * ratio)
    return frequent.groupBy("host_").agg(F.sort_array(F.collect_list("key_")).alias("keys_"))


def drop_template_lines(
    df: DataFrame,
    host: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    dropped: str = "n_dropped",
) -> DataFrame:
    """``df`` with template lines gone from ``text``, and the number of lines dropped.

    Lines that are blank stay; every other line above the ratio goes, however little of its page
    is left. Rows with NULL text or host stay as they are. Repeated rows count as one page. Near
    copies count as pages of their own. The table of template lines is written first, so that it
    is broadcast only if its files are small.
    """
    bad = cut_lineage(template_lines(df, host, text, ratio, min_pages))
    key, keys, kept = (free_name(df, n) for n in ("host_", "keys_", "kept_"))
    bad = bad.select(F.col("host_").alias(key), F.col("keys_").alias(keys))
    joined = df.join(bad, quoted(host) == F.col(key), "left")
    left = F.filter(
        lines_of(quoted(text)),
        lambda x: (F.btrim(x, F.lit(EDGE)) == "") | ~F.array_contains(F.col(keys), line_key(x)),
    )
    joined = joined.withColumn(kept, F.when(F.col(keys).isNotNull(), left))
    cut = F.col(kept).isNotNull()
    short = F.when(cut, F.array_join(kept, "\n")).otherwise(quoted(text))
    lost = F.when(cut, F.size(lines_of(quoted(text))) - F.size(kept)).otherwise(F.lit(0))
    columns = [short.alias(c) if c == text else quoted(c) for c in df.columns]
    return joined.select(*columns, lost.alias(free_name(df, dropped)))
