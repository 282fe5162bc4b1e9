"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by fast pseudo-random rotations (sign flips and Hadamard transforms) and
hashed to the nearest corner of the cross-polytope: its largest coordinate and that one's sign. A
bucket of a table joins several such hashes. Besides its own bucket each vector enters the next
best ones (multiprobe), and two vectors meet where at least one is in its own. Every pair that
meets is checked by its exact cosine.

How many hashes a bucket joins follows from the number of vectors, how many tables there are from
the recall wanted for pairs exactly at the threshold; neither depends on the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import quoted
from loamline.llm.components import components
from loamline.llm.spans import group_starts, mix, whole_groups
from loamline.llm.vectors import matrices, usable
from loamline.session import cut_lineage, shuffle_width

THRESHOLD = 0.95
RECALL = 0.9999
PROBES = 8
# Chance partners a vector may have in each table, and the pairs used to estimate recall.
CHANCE = 4
TRIALS = 2_000
SEED = 20_240_601
TILE = 1024
# Pairs of vectors multiplied at a time.
PAIRS = 50_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the number of columns is a power of two."""
    n, dim = x.shape
    step = 1
    while step < dim:
        x = x.reshape(n, dim // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
    return x.reshape(n, dim)


@dataclass(frozen=True)
class Plan:
    """How vectors of ``dim`` components are hashed."""

    dim: int
    tables: int
    hashes: int
    probes: int = PROBES

    @property
    def wide(self) -> int:
        return 1 << max(1, (self.dim - 1).bit_length())

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """Keys by vector, table and probe; the first probe is the vector's own bucket."""
        padded = np.zeros((len(unit), self.wide))
        padded[:, : self.dim] = unit
        signs, steps = _signs(self), _steps(self.hashes, min(3, self.wide))
        probes = min(self.probes, len(steps))
        out = np.empty((len(unit), self.tables, probes + 1), np.int64)
        for t in range(self.tables):
            codes, losses = [], []
            for h in range(self.hashes):
                y = padded
                for turn in range(3):
                    y = hadamard(y * signs[t, h, turn])
                size = np.abs(y)
                top = np.argsort(-size, axis=1, kind="stable")[:, : min(3, self.wide)]
                best = np.take_along_axis(size, top, 1) / self.wide**1.5
                codes.append(2 * top + (np.take_along_axis(y, top, 1) < 0))
                losses.append((best[:, :1] - best) ** 2)
            loss = sum(x[:, steps[:, h]] for h, x in enumerate(losses))
            chosen = np.argsort(loss, axis=1, kind="stable")[:, :probes]
            chosen = np.hstack([np.zeros((len(unit), 1), np.int64), chosen + 1])
            every = np.vstack([np.zeros((1, self.hashes), np.int64), steps])
            key = np.full(chosen.shape, t * 2 + 1, np.uint64)
            for h in range(self.hashes):
                key = mix(key) + np.take_along_axis(codes[h], every[chosen, h], 1).astype(np.uint64)
            out[:, t] = mix(key ^ np.uint64(self.dim)).view(np.int64)
        return out


@lru_cache(maxsize=8)
def _signs(plan: Plan) -> np.ndarray:
    draw = np.random.default_rng(SEED)
    return draw.choice([-1.0, 1.0], size=(plan.tables, plan.hashes, 3, plan.wide))


@lru_cache(maxsize=8)
def _steps(hashes: int, ranks: int) -> np.ndarray:
    """Which next best corners a probe may take, one column for each hash; not all the best."""
    return np.array([x for x in product(range(ranks), repeat=hashes) if any(x)], np.int64)


@lru_cache(maxsize=64)
def plan_for(dim: int, rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> Plan:
    """Hashes by the number of rows, tables by trial on random pairs exactly at the threshold.

    Where such pairs hardly ever meet, a bucket joins fewer hashes.
    """
    corners = 2 * (1 << max(1, (dim - 1).bit_length()))
    hashes = max(1, math.ceil(math.log(max(2.0, rows * (2 * PROBES + 1) / CHANCE)) / math.log(corners)))
    hashes = min(hashes, 6)
    draw = np.random.default_rng(SEED + 1)
    a = draw.standard_normal((TRIALS, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = draw.standard_normal((TRIALS, dim))
    b -= (a * b).sum(1, keepdims=True) * a
    norm = np.linalg.norm(b, axis=1, keepdims=True)
    b = threshold * a + math.sqrt(1 - threshold**2) * b / np.where(norm > 0, norm, 1)
    for hashes in range(hashes, 0, -1):
        one = Plan(dim, 1, hashes)
        x, y = one.buckets(a)[:, 0], one.buckets(b)[:, 0]
        met = ((x[:, :1] == y) | (y[:, :1] == x)).any(1).mean()
        if met >= 0.02:
            break
    tables = math.ceil(math.log(1 - recall) / math.log(1 - min(max(met, 0.02), 0.999)))
    return Plan(dim, max(2, tables), hashes)


def unit_rows(values: np.ndarray) -> np.ndarray:
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def bucket_rows(
    classes: DataFrame, rows: int, threshold: float = THRESHOLD, recall: float = RECALL
) -> DataFrame:
    """``key``, ``node`` and ``own`` for every vector, table and probe; written down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy()
            for at, values in matrices(batch.column("vector")):
                plan = plan_for(values.shape[1], rows, threshold, recall)
                for part in range(0, len(at), 2048):
                    keys = plan.buckets(unit_rows(values[part : part + 2048]))
                    own = np.zeros(keys.shape, bool)
                    own[:, :, 0] = True
                    each = keys.shape[1] * keys.shape[2]
                    columns = [keys.ravel(), np.repeat(node[at[part : part + 2048]], each), own.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "own"])

    width = max(shuffle_width(classes.sparkSession), math.ceil(rows / 20_000))
    return cut_lineage(classes.repartition(width, "node").mapInArrow(run, "key long, node long, own boolean"))


def busy_tiles(buckets: DataFrame) -> DataFrame:
    """Rows of buckets where pairs meet, a bucket with many vectors cut into pairs of blocks."""
    counts = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max("own").alias("any_own"))
    counts = cut_lineage(counts.filter("m > 1 AND any_own").select("key", F.ceil(F.col("m") / TILE).cast("int").alias("n")))
    cut = buckets.join(counts, "key").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return cut.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "own")


def tile_links(
    tiles: DataFrame, classes: DataFrame, rows: int, threshold: float, recall: float = RECALL
) -> DataFrame:
    """``node``, ``links`` and ``root`` from every tile.

    A pair that meets in several buckets counts in the first of them alone. What leaves a tile
    is not its pairs but, for each vector, how many others it is linked with (their copies
    included) and the smallest vector of the tile it is connected with.
    """
    full = tiles.join(classes, "node").repartition(shuffle_width(tiles.sparkSession), "key", "i", "j")
    full = full.sortWithinPartitions("key", "i", "j").select("key", "i", "j", "mine", "node", "own", "copies", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "i", "j"]):
            made = _links(table, rows, threshold, recall)
            if len(made[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], ["node", "links", "root"])

    return cut_lineage(full.mapInArrow(run, "node long, links long, root long"))


def _links(
    table: pa.Table, rows: int, threshold: float, recall: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = table.combine_chunks()
    starts = group_starts(table, ["key", "i", "j"])
    n = table.num_rows
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    key, i, j, mine, node, own, copies = (
        table.column(c).to_numpy() for c in ("key", "i", "j", "mine", "node", "own", "copies")
    )
    vectors, dims = {}, np.zeros(n, np.int64)
    place = np.zeros(n, np.int64)
    for at, values in matrices(table.column("vector").combine_chunks()):
        vectors[values.shape[1]] = unit_rows(values)
        dims[at], place[at] = values.shape[1], np.arange(len(at))
    later = ends - np.arange(n) - 1
    bounds = np.append(0, np.cumsum(later))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + PAIRS, "right")) - 1)
        u = np.repeat(np.arange(row, stop), later[row:stop])
        v = u + 1 + np.arange(len(u)) - (bounds[u] - bounds[row])
        row = stop
        good = (own[u] | own[v]) & (node[u] != node[v]) & (dims[u] == dims[v])
        good &= (i[u] == j[u]) | (mine[u] != mine[v])
        u, v = u[good], v[good]
        for dim, unit in vectors.items():
            x, y = u[dims[u] == dim], v[dims[u] == dim]
            near = np.einsum("ij,ij->i", unit[place[x]], unit[place[y]]) >= threshold
            x, y = x[near], y[near]
            if len(x):
                first = _first_meeting(plan_for(dim, rows, threshold, recall), unit, place[x], place[y], key[x])
                found.append((x[first], y[first]))
    if not found:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    u, v = (np.concatenate(c) for c in zip(*found, strict=True))
    nodes, at = np.unique(np.concatenate([node[u], node[v]]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    links = np.bincount(a, copies[v], len(nodes)) + np.bincount(b, copies[u], len(nodes))
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return nodes, links.astype(np.int64), nodes[root]


def _first_meeting(plan: Plan, unit: np.ndarray, u: np.ndarray, v: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether ``key`` is the first bucket, by table and then by key, in which u and v meet."""
    used, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    buckets = plan.buckets(unit[used])
    out = np.zeros(len(u), bool)
    for part in range(0, len(u), PAIRS):
        x, y = (buckets[a[part : part + PAIRS]] for a in (at[: len(u)], at[len(u) :]))
        best = np.full(len(x), np.iinfo(np.int64).max)
        open_ = np.ones(len(x), bool)
        for t in range(plan.tables):
            here = np.full(len(x), np.iinfo(np.int64).max)
            for one, other in ((x, y), (y, x)):
                meets = one[:, t, :1] == other[:, t]
                here = np.where(meets.any(1), np.minimum(here, one[:, t, 0]), here)
            new = open_ & (here < np.iinfo(np.int64).max)
            best[new] = here[new]
            open_ &= ~new
        out[part : part + PAIRS] = best == key[part : part + PAIRS]
    return out


def near_duplicates(
    df: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for every row of ``df``.

    Vectors that are NULL, empty, zero, or hold NULL or non-finite components are linked with
    nothing, as are vectors of different lengths. Equal vectors are one node with a number of
    copies, which are linked with each other; nodes are told apart by a 64-bit hash of the vector,
    so different vectors under one id are nodes of their own. A component's id is its smallest vector id; rows
    without an id may be linked but never name a component unless nothing else does (NULL). An
    empty table gives no rows.
    """
    named = df.select(quoted(vec_id).cast("long").alias("id_"), quoted(embedding).alias("vector"))
    good = usable(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    valid = named.filter(F.coalesce(good, F.lit(False)))
    classes = valid.groupBy("vector").agg(F.min("id_").alias("first_"), F.count(F.lit(1)).alias("copies"))
    classes = cut_lineage(classes.withColumn("node", F.xxhash64("vector")))
    rows = max(2, classes.count())
    vectors = classes.select("node", "vector", "copies")
    tiles = busy_tiles(bucket_rows(vectors.select("node", "vector"), rows, threshold, recall))
    links = tile_links(tiles, vectors, rows, threshold, recall)
    roots = components(links.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    degrees = links.groupBy("node").agg(F.sum("links").alias("links"))
    labelled = cut_lineage(
        classes.join(degrees, "node", "left")
        .join(roots, "node", "left")
        .select(
            "vector",
            "first_",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("root", "node").alias("root"),
        )
    )
    smallest = cut_lineage(labelled.groupBy("root").agg(F.min("first_").alias("component_id")))
    answers = cut_lineage(labelled.join(smallest, "root").select("vector", "n_links", "component_id"))
    linked = valid.join(answers, "vector").select("id_", "n_links", "component_id")
    alone = named.filter(~F.coalesce(good, F.lit(False))).select(
        "id_", F.lit(0).cast("long").alias("n_links"), F.col("id_").alias("component_id")
    )
    return linked.unionByName(alone).select(
        F.col("id_").alias(vec_id), "n_links", "component_id", F.coalesce(F.col("id_") == F.col("component_id"), F.lit(False)).alias("kept")
    )
