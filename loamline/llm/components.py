"""Connected components over a table of links, without bringing any of it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node of ``links`` (columns a, b).

    Each round every node points at its smallest neighbour, pointers are followed to their ends,
    and the links are contracted to those ends; at least half of the nodes with a link disappear
    each time. Minima combine map-side, and tables are written between joins, so that a node with
    any number of links is only ever a skewed side of a plain join.
    """
    links = cut_lineage(_contracted(links))
    mapping = None
    while not links.isEmpty():
        both = links.union(links.select("b", "a")).toDF("node", "other")
        up = F.least(F.col("node"), F.min("other"))
        parents = _ends(cut_lineage(both.groupBy("node").agg(up.alias("root"))))
        next_ = parents.toDF("root", "next")
        if mapping is None:
            mapping = parents
        else:
            moved = mapping.join(next_, "root", "left")
            mapping = cut_lineage(moved.select("node", F.coalesce("next", "root").alias("root")))
        a, b = parents.toDF("a", "a_root"), parents.toDF("b", "b_root")
        merged = links.join(a, "a").join(b, "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
        links = cut_lineage(_contracted(merged))
    if mapping is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return mapping


def _contracted(links: DataFrame) -> DataFrame:
    ordered = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return ordered.filter(F.col("a") < F.col("b")).distinct()


def _ends(parents: DataFrame) -> DataFrame:
    """Pointers followed to the end, doubling their reach in each step."""
    while True:
        above = parents.toDF("root", "next")
        step = parents.join(above, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
        step = cut_lineage(step)
        if step.filter("moved").isEmpty():
            return parents
        parents = step.select("node", "root")
