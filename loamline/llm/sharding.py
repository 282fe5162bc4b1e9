"""Sharding over fixed virtual slots and a versioned slot-to-shard map.

Rows are hashed into a fixed number of slots.  What is balanced is not the rows but the slots:
their bytes are aggregated, and the map (a few thousand rows, whatever the corpus holds) assigns
each slot to a shard.  Rebalancing writes a new version of the map that moves as few slots as it
can; rows never need to be hashed anew.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamline.llm.common import quoted, utf8_bytes

# Fixed for the life of a corpus: a row's slot never changes. It bounds all that the driver holds.
SLOTS = 4096
MAP_SCHEMA = "version int, slot int, shard int, bytes long, n_rows long, first_place long"


def size_of(text: Column) -> Column:
    """UTF-8 bytes and one for the row itself; a NULL text has none."""
    return utf8_bytes(text) + 1


def slot_of(*keys: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def slot_sizes(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows by slot, from columns ``slot`` and ``size``; at most one entry per slot."""
    found = rows.groupBy("slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    return {r["slot"]: (r["bytes"], r["n"]) for r in found}


def first_map(sizes: Mapping[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Slot to shard: largest slot first, each into the shard that holds fewest bytes."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, 0), s)):
        held, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (held + sizes.get(slot, 0), shard))
    return out


def rebalanced_map(old: Mapping[int, int], sizes: Mapping[int, int], shards: int) -> dict[int, int]:
    """An edit of ``old`` for new sizes or another shard count that moves few slots.

    Slots of shards that no longer exist are set free, then each shard above the mean gives its
    smallest-excess slots away; free slots go, largest first, to the emptiest shard.
    """
    mean = sum(sizes.get(s, 0) for s in old) / shards
    held = {k: [] for k in range(shards)}
    free = []
    for slot, shard in old.items():
        held[shard].append(slot) if shard < shards else free.append(slot)
    total = {k: sum(sizes.get(s, 0) for s in v) for k, v in held.items()}
    out = {s: k for s, k in old.items() if k < shards}
    for shard, own in held.items():
        for slot in sorted(own, key=lambda s: (-sizes.get(s, 0), s)):
            if 0 < sizes.get(slot, 0) <= total[shard] - mean:
                total[shard] -= sizes[slot]
                free.append(slot)
                del out[slot]
    heap = [(v, k) for k, v in total.items()]
    heapq.heapify(heap)
    for slot in sorted(free, key=lambda s: (-sizes.get(s, 0), s)):
        v, k = heapq.heappop(heap)
        out[slot] = k
        heapq.heappush(heap, (v + sizes.get(slot, 0), k))
    return out


def write_map(
    spark: SparkSession,
    path: str,
    version: int,
    shard_of: Mapping[int, int],
    sizes: Mapping[int, tuple[int, int]],
) -> None:
    """Add a version of the map. ``first_place`` is the slot's first place within its shard."""
    places: dict[int, int] = {}
    rows = []
    for slot in sorted(shard_of):
        shard = shard_of[slot]
        size, n = sizes.get(slot, (0, 0))
        rows.append((version, slot, shard, size, n, places.get(shard, 0)))
        places[shard] = places.get(shard, 0) + n
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the map, the latest by default."""
    stored = spark.read.schema(MAP_SCHEMA).parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.filter(F.col("version") == version)


def with_slots(df: DataFrame, keys: list[str], size: Column, slots: int = SLOTS) -> DataFrame:
    """All columns of ``df`` packed as ``row``, with ``slot`` and ``size``."""
    return df.select(
        F.struct(*[quoted(c) for c in df.columns]).alias("row"),
        slot_of(*[quoted(k) for k in keys], slots=slots).alias("slot"),
        size.alias("size"),
    )


def assign(placed: DataFrame, slot_map: DataFrame, order: list[Column]) -> DataFrame:
    """Attach ``shard`` and ``place``, gapless from 0 within a shard.

    The map is broadcast: it has one row per slot, thousands whatever the input. Ranks are taken
    inside a slot, one of thousands of equal hash ranges, and shifted by the slots before it.
    """
    in_slot = F.row_number().over(Window.partitionBy("slot").orderBy(*order)) - 1
    small = slot_map.select("slot", "shard", "first_place")
    return (
        placed.withColumn("in_slot", in_slot)
        .join(F.broadcast(small), "slot")
        .withColumn("place", F.col("first_place") + F.col("in_slot"))
        .drop("first_place", "in_slot")
    )


def shard_rows(
    df: DataFrame, shards: int, map_path: str, keys: list[str], size: Column, slots: int = SLOTS
) -> DataFrame:
    """Put every row into one of ``shards`` shards of nearly equal bytes, by a new map at ``map_path``.

    Returns ``row`` (the input's columns), ``size``, ``slot`` (the virtual one), ``shard`` and
    ``place``. ``keys`` decide the slot, NULLs included; equal keys share a slot, so name columns
    of which no single value holds much of the corpus. Rows equal in all keys are in arbitrary
    order among themselves. An empty table gives no rows and a map of empty slots.
    """
    placed = with_slots(df, keys, size, slots)
    sizes = slot_sizes(placed)
    shard_of = first_map({s: b for s, (b, _) in sizes.items()}, shards, slots)
    write_map(df.sparkSession, map_path, 0, shard_of, sizes)
    return assign(placed, read_map(df.sparkSession, map_path, 0), [F.col("row")[k] for k in keys])


def reshard_rows(df: DataFrame, shards: int, map_path: str, keys: list[str], size: Column) -> DataFrame:
    """As ``shard_rows``, after growth or for another shard count: edits the latest map.

    The edit is written as the next version; earlier ones stay readable.
    """
    spark = df.sparkSession
    stored = read_map(spark, map_path).select("version", "slot", "shard").collect()
    old = {r["slot"]: r["shard"] for r in stored}
    placed = with_slots(df, keys, size, len(old))
    sizes = slot_sizes(placed)
    version = stored[0]["version"] + 1
    write_map(spark, map_path, version, rebalanced_map(old, {s: b for s, (b, _) in sizes.items()}, shards), sizes)
    return assign(placed, read_map(spark, map_path, version), [F.col("row")[k] for k in keys])


def write_shards(assigned: DataFrame, path: str, files_per_shard: int = 8) -> None:
    """Write ``row`` below one folder per shard; each shard is dealt over several tasks."""
    spread = F.pmod(F.col("place"), F.lit(files_per_shard))
    assigned.repartition("shard", spread).select("row.*", "shard").write.partitionBy("shard").parquet(path)
