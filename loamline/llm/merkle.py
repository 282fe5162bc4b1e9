"""A Merkle manifest of a dataset whose witnesses grow while nodes are appended.

Leaves of a tree are appended in order. A node that joins an open run starts a witness there; when
the run is complete, its digest is appended one level up and every node below it has its witness
extended by its run's other digests. A block of consecutive leaves is folded by one task; the roots
of blocks are appended to the next block up, and so on, so no tree is bound to one task. Witnesses of
a block's root are handed down to the block's leaves in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamline.llm.common import quoted
from loamline.llm.spans import whole_groups
from loamline.operators.pairing import broadcast_if_small
from loamline.session import cut_lineage

ARITY = 16
# Levels that one task folds, and so 16 ** 3 nodes it holds.
DEPTH = 3
WITNESS = "array<struct<position:int,siblings:string>>"
WITNESS_ARROW = pa.list_(pa.struct([("position", pa.int32()), ("siblings", pa.string())]))
# Leaves whose witnesses are handed on together.
HANDED = 512


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def field(value: Column) -> Column:
    """A value with its UTF-8 byte count before it, or a dash for NULL."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


class Runs:
    """The open runs of a tree's right edge, with the witnesses of the nodes appended so far.

    ``height`` is the number of levels above the appended nodes. A witness is a list of
    (position in the run, the run's other digests), lowest level first. Nodes of one complete run
    share what comes above it.
    """

    def __init__(self, height: int):
        self.height = height
        self.open: list[list[str]] = [[] for _ in range(height)]
        self.below: list[list[int]] = [[] for _ in range(height)]
        self.witnesses: list[list[tuple[int, str]]] = []
        self.root: str | None = None

    def append(self, node: str) -> None:
        self.witnesses.append([])
        self._join(0, node, [len(self.witnesses) - 1])

    def close(self) -> str:
        """Complete the runs that are still open, and return the root."""
        for level in range(self.height):
            if self.open[level]:
                self._complete(level)
        if self.root is None:
            raise ValueError("a tree has at least one node")
        return self.root

    def _join(self, level: int, node: str, members: list[int]) -> None:
        if level == self.height:
            self.root = node
            return
        run = self.open[level]
        self.below[level].append(members)
        run.append(node)
        if len(run) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, groups = self.open[level], self.below[level]
        self.open[level], self.below[level] = [], []
        whole, size = "".join(run), len(run[0])
        members: list[int] = []
        for k, group in enumerate(groups):
            entry = (k, whole[: k * size] + whole[(k + 1) * size :])
            for member in group:
                self.witnesses[member].append(entry)
            members += group
        self._join(level + 1, digest(whole), members)


def height_of(count: Column) -> Column:
    """Levels above ``count`` nodes; exact, as powers of two are exact in doubles."""
    bits = F.length(F.bin(F.greatest(count, F.lit(1)) - 1))
    return F.when(count <= 1, F.lit(0)).otherwise(F.ceil(bits / 4)).cast("int")


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows``, written once, with ``index_`` gapless from 0 within each group, and ``count_``.

    Rows are range-partitioned over all groups together, so a group of any size spreads over tasks,
    and rows equal in ``order`` do too. Groups are told apart with NULL as a value of its own.
    """
    spark = rows.sparkSession
    keys = [*map(quoted, group), *map(quoted, order), F.col("tie_")]
    tied = rows.withColumn("tie_", F.monotonically_increasing_id())
    cut = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie_")
    placed = cut_lineage(cut.withColumn("at_", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("at_"), 33)
    first = placed.groupBy(*map(quoted, group), part.alias("part_")).agg(
        F.min("at_").alias("first_"), F.count(F.lit(1)).alias("held_")
    )
    # A group has at most one row per partition here.
    window = Window.partitionBy(*map(quoted, group))
    before = F.sum("held_").over(window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    starts = cut_lineage(
        first.select(
            *[quoted(g).alias(f"{g}_start_") for g in group],
            F.col("part_").alias("part_start_"),
            (F.coalesce(before, F.lit(0)) - F.col("first_")).alias("shift_"),
            F.sum("held_").over(window).alias("count_"),
        )
    )
    hit = part == F.col("part_start_")
    for g in group:
        hit = hit & quoted(g).eqNullSafe(quoted(f"{g}_start_"))
    joined = placed.join(broadcast_if_small(starts), hit)
    names = [quoted(c) for c in rows.columns]
    return joined.select(*names, (F.col("at_") + F.col("shift_")).alias("index_"), "count_")


def _block(index: Column) -> Column:
    return F.floor(index / ARITY**DEPTH).cast("long")


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "index")


def _fold(nodes: DataFrame) -> DataFrame:
    """Roots of all blocks of ``nodes`` (tree, index, height, node), as nodes one storey up."""
    rows = nodes.withColumn("block", _block(F.col("index"))).select("tree", "block", "index", "height", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["tree", "block"]):
            for tree, block, height, runs, _ in _trees(table):
                runs.close()
                made = [[tree], [block], [max(0, height - DEPTH)], [runs.root]]
                types = [pa.int64(), pa.int64(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m, t) for m, t in zip(made, types, strict=True)], ["tree", "index", "height", "node"]
                )

    return _grouped(rows).mapInArrow(run, "tree long, index long, height int, node string")


def _trees(table: pa.Table) -> Iterator[tuple]:
    """(tree, block, height, runs with all nodes appended, rows) of each group of a sorted table."""
    trees, blocks = table.column("tree").to_pylist(), table.column("block").to_pylist()
    heights, nodes = table.column("height").to_pylist(), table.column("node").to_pylist()
    start = 0
    for at in range(1, len(trees) + 1):
        if at < len(trees) and trees[at] == trees[start] and blocks[at] == blocks[start]:
            continue
        # A row before the nodes brings what lies above the block.
        first = start if nodes[start] is not None else start + 1
        if first < at:
            runs = Runs(min(DEPTH, heights[first]))
            for k in range(first, at):
                runs.append(nodes[k])
            yield trees[start], blocks[start], heights[first], runs, (start, first, at)
        start = at


def _hand_down(nodes: DataFrame, above: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``nodes`` with the witness of each up to the top, given those of the blocks' roots.

    ``above`` has (tree, index, root, top, witness). Every block gets one such row before its nodes.
    """
    kept = [F.col(c) for c in keep]
    mine = nodes.withColumn("block", _block(F.col("index"))).select(
        "tree", "block", "index", "height", "node", *kept,
        F.lit(None).cast("string").alias("root"),
        F.lit(None).cast("string").alias("top"),
        F.lit(None).cast(WITNESS).alias("witness"),
    )
    heads = above.select(
        "tree", F.col("index").alias("block"), F.lit(-1).cast("long").alias("index"), F.lit(0).alias("height"),
        F.lit(None).cast("string").alias("node"),
        *[F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in keep],
        "root", "top", "witness",
    )
    rows = mine.unionByName(heads)
    schema = mine.drop("block", "height").schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["tree", "block"], 2 * ARITY**DEPTH):
            for _, _, _, runs, (start, first, at) in _trees(table):
                runs.close()
                root, top = (table.column(c)[start].as_py() for c in ("root", "top"))
                outer = table.column("witness")[start].as_py()
                for k in range(first, at, HANDED):
                    part = table.slice(k, min(HANDED, at - k)).select([c for c in names if c not in ("root", "top", "witness")])
                    size = part.num_rows
                    inner = [
                        [{"position": p, "siblings": s} for p, s in w]
                        for w in runs.witnesses[k - first : k - first + size]
                    ]
                    columns = {c: part.column(c).combine_chunks() for c in part.column_names}
                    columns["root"] = pa.array([root] * size, pa.string())
                    columns["top"] = pa.array([top] * size, pa.string())
                    columns["witness"] = pa.array([w + outer for w in inner], WITNESS_ARROW)
                    yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return _grouped(rows).mapInArrow(run, schema)


def _storeys(nodes: DataFrame, height: int) -> list[DataFrame]:
    """``nodes`` and the written tables of block roots above them, up to one root per tree."""
    out = [nodes]
    while True:
        out.append(cut_lineage(_fold(out[-1])))
        height -= DEPTH
        if height <= 0:
            return out


def _tallest(nodes: DataFrame) -> int:
    return nodes.agg(F.max("height")).first()[0] or 0


def _no_witness() -> Column:
    return F.expr(f"CAST(array() AS {WITNESS})")


def manifest(
    rows: DataFrame, leaf: Column, group: str, order: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Columns ``order``, ``keep``, ``leaf``, ``subroot``, ``root`` and ``witness`` of every row.

    A row is a leaf of its group's tree, in ascending order of ``order`` and then of its digest; the
    groups' roots, in ascending order of the group, are the leaves of the top tree. NULL is a group
    and an order value like others and comes first. Repeated rows are leaves of their own. An empty
    table has no rows and no root. A witness lists, lowest level first, the node's position in its
    run and the run's other digests one after the other.

    Only digests are shuffled; what a task holds is one block of 4096 nodes and their witnesses.
    """
    taken = [F.col("value_"), *[quoted(c).alias(f"keep_{i}") for i, c in enumerate(keep)]]
    narrow = rows.select(
        quoted(group).alias("group_"), quoted(order).alias("value_"), *taken[1:], leaf.alias("node")
    )
    placed = numbered(narrow, ["group_"], ["value_", "node"])
    groups = cut_lineage(placed.groupBy("group_").agg(F.max("count_").alias("size_")))
    ranked = numbered(groups, [], ["group_"])
    trees = cut_lineage(ranked.select(F.col("group_").alias("tree_group_"), F.col("index_").alias("tree"), "count_"))
    # The group column is read off the leaves' side, so that a large group is joined by broadcast or,
    # with very many groups, by an adaptive join that splits it.
    kept = ["value_", *[f"keep_{i}" for i in range(len(keep))]]
    leaves = cut_lineage(
        placed.join(broadcast_if_small(trees.drop("count_")), F.col("group_").eqNullSafe(F.col("tree_group_"))).select(
            "tree", F.col("index_").alias("index"), height_of(F.col("count_")).alias("height"), "node", *kept
        )
    )
    storeys = _storeys(leaves, _tallest(leaves))
    subroots = storeys[-1].select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("index"), "node"
    )
    count = trees.agg(F.coalesce(F.max("count_"), F.lit(0)).alias("n")).first()["n"]
    top = subroots.withColumn("height", height_of(F.lit(count).cast("long")))
    top_storeys = _storeys(top, _tallest(top))
    summit = top_storeys[-1].select(
        "tree", "index", F.col("node").alias("root"), F.col("node").alias("top"), _no_witness().alias("witness")
    )
    for below in reversed(top_storeys[:-1]):
        summit = cut_lineage(_hand_down(below, summit, []).drop("root"))
        summit = summit.select("tree", "index", F.col("node").alias("root"), "top", "witness")
    # What was a leaf of the top tree is the root of a tree below.
    handed = summit.select(F.col("index").alias("tree"), F.lit(0).cast("long").alias("index"), "root", "top", "witness")
    for below in reversed(storeys[1:-1]):
        handed = cut_lineage(_hand_down(below, handed, [])).select("tree", "index", "root", "top", "witness")
    full = _hand_down(leaves, handed, kept)
    return full.select(
        F.col("value_").alias(order),
        *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)],
        F.col("node").alias("leaf"),
        F.col("root").alias("subroot"),
        F.col("top").alias("root"),
        "witness",
    )


def siblings_digest(witness: Column) -> Column:
    """The digest of all siblings of a witness, level by level and left to right."""
    return F.sha2(F.array_join(F.transform(witness, lambda x: x["siblings"]), ""), 256)


def folded(leaf: Column, witness: Column) -> Column:
    """The root that a leaf and its witness lead to."""

    def up(node: Column, entry: Column) -> Column:
        at = entry["position"] * 64
        before = F.substring(entry["siblings"], F.lit(1), at)
        after = F.substring(entry["siblings"], at + 1, F.length(entry["siblings"]))
        return F.sha2(F.concat(before, node, after), 256)

    return F.aggregate(witness, leaf, up)
