"""Exact Jaccard join of shingle sets in size-banded tiles.

Two sets can only reach the threshold if their sizes are close, so documents are put into bands
of sizes, and a tile compares documents of one band with those of the same band or the upper part
of the band below. Inside a band, tiles are cut further without losing a pair: the hash space is
divided into parts, more than two linked sets can differ in, so that linked sets agree in at
least one part that is not empty; only documents that agree in a part meet in a tile. As they
agree in more than one, each can leave some parts out before anything is shuffled, and of the
rest those tiles with most documents. Of tiles with the same documents one is compared.

In a tile every pair is bounded first: each shingle toggles one bit of a bitmap, every bit in
which two bitmaps differ needs a shingle that only one set has, and so the bit count bounds the
overlap from above. What passes is decided by intersecting the sorted sets.

Only components are asked for, hence documents that are known to be connected are not compared
again: probable near copies are first checked against one partner each, and no tile is made, and
no pair compared, inside a component found that way. A group of near copies so costs one
comparison a member, not one a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamline.llm.common import free_name, modest_batches, quoted
from loamline.llm.components import components
from loamline.llm.spans import binaries, group_starts, mix, small_batches, span_hashes, text_bytes, whole_groups
from loamline.session import cut_lineage, shuffle_width

WORDS = 5
# Linked when 100 * intersection >= 75 * union.
NEED, OF = 75, 100


def _tops() -> np.ndarray:
    """Largest sizes of the bands: a set's partners lie in its own band or next to it."""
    tops = [3]
    while tops[-1] < 1 << 40:
        tops.append(tops[-1] * OF // NEED)
    return np.array(tops, np.int64)


def _load(top: int) -> float:
    """How many shingles a part may hold on average in sets of size ``top``.

    As many as leave, with seven standard deviations to spare, more parts that are not empty than
    two linked sets of that size can differ in.
    """
    for load in np.arange(3.25, 0.2, -0.05):
        parts, empty = top / load, math.exp(-load)
        spread = math.sqrt(parts * empty * (1 - (1 + load) * empty))
        if parts * (1 - empty) - top * 2 * (OF - NEED) / (OF + NEED) >= 7 * spread:
            return float(load)
    return 0.001


TOPS = _tops()
LOADS = np.array([_load(int(t)) for t in TOPS])
# Keys one task sorts, about, and documents on a side of a tile.
SLOT_KEYS = 500_000
TILE = 512
# Pairs of a tile compared at a time.
PAIRS = 50_000
# From this power of two documents on a tile is large.
LARGE = 4
# Part keys by which probable near copies are found before any tile is made.
SKETCH = 4
# Share of a band's largest size in parts that are left out before the shuffle, where they can be spared.
EARLY = 0.06
# The finer division of bands in which every hash is a part of its own, so that no set is crowded.
FINEST = 12
# Bytes of a key that travel: its slot and these tell it apart. The lowest bit is ``own``.
KEY_BYTES = 5
# Bytes of a node that travel with its keys. Its lowest bits name it, and now and then another one as well.
NODE_BYTES = 5
NODE_BITS = (1 << 8 * NODE_BYTES) - 1
# Large tiles, the most crowded ones, in which a document looks for one to be linked with beforehand.
HUB_TILES = 4
# Row keys that may be broadcast, 8 bytes each and as much for a node.
BROADCAST_KEYS = 2_000_000

SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles, and the n + 1 offsets into them."""
    n = len(offsets) - 1
    low = LOWER[data]
    word = ~SPACE[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    begins = np.flatnonzero(word & np.append(True, ~word[:-1])[: len(low)] | word & edge[:-1])
    stop = word & (np.append(~word[1:], True)[: len(low)] | edge[1:])
    ends = np.flatnonzero(stop) + 1
    words = span_hashes(low, begins, ends)
    doc = np.searchsorted(offsets, begins, "right") - 1
    first = np.searchsorted(doc, np.arange(n))
    have = np.bincount(doc, minlength=n)
    out = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        out += mix(words[k : len(words) - WORDS + 1 + k]) * ODD[k] if len(out) else out
    same = doc[: len(out)] == doc[WORDS - 1 :] if len(out) else np.zeros(0, bool)
    values, owner = mix(out[same]), doc[: len(out)][same]
    few = np.flatnonzero((have > 0) & (have < WORDS))
    if len(few):
        whole = np.array(
            [_whole(words[first[d] : first[d] + have[d]]) for d in few], np.uint64
        )
        values, owner = np.concatenate([values, whole]), np.concatenate([owner, few])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.append(0, np.cumsum(np.bincount(owner, minlength=n)))


def _whole(words: np.ndarray) -> int:
    """A sequence of fewer words than a shingle has, as one element."""
    total = np.array([len(words)], np.uint64)
    for k in range(len(words)):
        total = mix(total * ODD[1] + words[k : k + 1])
    return int(total[0])


def fingerprints(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set; equal sets are one node."""
    sums = np.append(np.uint64(0), np.cumsum(mix(values ^ ODD[2]), dtype=np.uint64))
    sizes = np.diff(offsets).astype(np.uint64)
    return mix((sums[offsets[1:]] - sums[offsets[:-1]]) ^ mix(sizes + ODD[3])).view(np.int64)


def band_of(sizes: np.ndarray) -> np.ndarray:
    return np.searchsorted(TOPS, sizes)


def parts_of(band: np.ndarray, level: int) -> np.ndarray:
    """How many parts the hash space has for a band; each level doubles them."""
    return (np.ceil(TOPS[band] / LOADS[band]).astype(np.uint64) << np.uint64(level)).clip(max=np.uint64(1 << 30))


def may_differ(sizes: np.ndarray, own: bool = True) -> np.ndarray:
    """The most shingles in which a set and a linked one can differ, if both have keys of one band.

    In its own band a set's partner is at most that band's top; in the band above it is larger
    than the set, and at most by the threshold.
    """
    largest = sizes * OF // NEED
    if own:
        largest = np.minimum(largest, TOPS[band_of(sizes)])
    return (sizes + largest) * (OF - NEED) // (OF + NEED)


def part_keys(values: np.ndarray, offsets: np.ndarray, band: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, set number) of every part that is not empty, each set divided as for its ``band``."""
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    # Sets are sorted and parts are ranges of the hash space: a part is a run.
    part = values if level >= FINEST else ((values >> np.uint64(34)) * parts_of(band, level)[owner]) >> np.uint64(30)
    new = np.ones(len(values), bool)
    new[1:] = (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    sums = np.append(np.uint64(0), np.cumsum(mix(values ^ ODD[4]), dtype=np.uint64))
    content = sums[np.append(at[1:], len(values))] - sums[at]
    keys = mix(content ^ mix(part[at] * ODD[0] + (band[owner[at]] + 1).astype(np.uint64) * ODD[1]))
    return keys, owner[at]


def bitmaps(values: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """A bitmap of ``width`` bits for each set, in which each shingle toggles one."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    bit = (mix(values ^ ODD[1]) & np.uint64(width - 1)).astype(np.int64)
    hit, times = np.unique(owner * width + bit, return_counts=True)
    odd = np.zeros(n * width, np.uint8)
    odd[hit] = times & 1
    return np.packbits(odd.reshape(n, width), axis=1, bitorder="little").view(np.uint64)


def width_of(band: int) -> int:
    """Bits of a band's bitmaps: a power of two, two to four bits for each shingle of its largest sets.

    With one or two bits, pairs from a similarity of 0.65 on pass; with these, from 0.71 on.
    """
    return max(256, 2 << int(TOPS[band] - 1).bit_length())


def folded(bitmap: np.ndarray, width: int) -> np.ndarray:
    """The bitmap as it would be with fewer bits."""
    while len(bitmap) * 64 > width:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


def _texts(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Ids, texts, and a key of both, by which rows are found again; ids may be NULL or repeated."""
    named = df.select(quoted(doc_id).alias("id_"), quoted(text).cast("string").alias("text_"))
    return named.select("id_", F.xxhash64("id_", "text_").alias("key_"), "text_")


def spare_keys(values: np.ndarray, offsets: np.ndarray, level: int, own: bool) -> np.ndarray:
    """How many of its keys each set can do without.

    A set shares all its parts that are not empty with a linked one, but for those with a
    differing shingle. If every set leaves out as many keys as it can spare, and always the last
    ones by an order that is the same for all, one of those shared remains. Sets with a negative
    number are crowded: all their parts could differ. With the loads above that is very rare;
    their bands are divided more finely in a pass of their own.
    """
    sizes = np.diff(offsets)
    _, owner = part_keys(values, offsets, band_of(sizes) + (not own), level)
    return np.bincount(owner, minlength=len(sizes)) - may_differ(sizes, own) - 1


def early_out(spare: np.ndarray, tile_band: np.ndarray) -> np.ndarray:
    """How many of its last parts each set leaves out before the shuffle.

    The number is that of the band, or all that a set can spare if that is less. Of two linked sets
    the one that leaves out more so decides which shared parts are lost, and what it may leave out
    later is less by as many: together no more than it can spare.
    """
    return np.clip(np.minimum(spare, np.ceil(EARLY * TOPS[tile_band]).astype(np.int64)), 0, None)


def sketches(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The ``SKETCH`` least keys of each set's own parts."""
    sizes = np.diff(offsets)
    keys, owner = part_keys(values, offsets, band_of(sizes), 0)
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    least = rank < SKETCH
    ends = np.append(0, np.cumsum(np.bincount(owner[least], minlength=len(sizes))))
    kind = pa.list_(pa.field("element", pa.int64(), nullable=False))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[least].view(np.int64))).cast(kind)


def set_sizes(df: DataFrame, doc_id: str, text: str, level: int = 0) -> DataFrame:
    """``id_``, ``key_``, ``n_shingles``, ``node`` (the set's fingerprint), ``crowded_``, the set's band if it
    is crowded at this level, ``band``, ``spare`` and ``spare_up``, the keys that it can still spare in
    its own and the next band when it has left some out early, and ``sketch``, the least of its part
    keys; written down."""
    narrow = _texts(df, doc_id, text)
    zero = F.lit(0).cast("long")
    schema = narrow.select(
        "id_", "key_", zero.alias("n_shingles"), zero.alias("node"), zero.alias("crowded_"),
        zero.alias("band"), zero.alias("spare"), zero.alias("spare_up"), F.array(zero).alias("sketch"),
    ).schema
    schema["crowded_"].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2):
            values, offsets = shingle_sets(*text_bytes(batch.column(2)))
            sizes = np.diff(offsets)
            spare = [spare_keys(values, offsets, level, own) for own in (True, False)]
            band = band_of(sizes)
            crowd = pa.array(band, pa.int64(), mask=(spare[0] >= 0) | (sizes == 0))
            made = [pa.array(sizes, pa.int64()), pa.array(fingerprints(values, offsets)), crowd, pa.array(band, pa.int64())]
            made += [pa.array(np.maximum(x, 0) - early_out(x, band + up), pa.int64()) for up, x in enumerate(spare)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made, sketches(values, offsets)], schema.names)

    return cut_lineage(narrow.mapInArrow(run, schema))


def tile_members(texts: DataFrame, tasks: int, level: int = 0, bands: list[int] | None = None) -> DataFrame:
    """``key``, ``short``, ``own``, ``label`` and ``crowd`` (the power of two of the tile's size) of
    documents that agree in a part with one of another label.

    ``short`` and ``label`` are the last ``NODE_BYTES`` bytes of nodes: the more slots there are, the fewer
    keys of a document go to one, until its node travels with each of them.

    ``texts`` has ``text_`` and ``label``, NULL for the document's own node. Parts are those of
    ``level``, and of certain ``bands`` only if they are given. Keys leave a task packed by slot, ranges
    of the key space, as ``KEY_BYTES`` bytes and a place among the slot's nodes, without rows of their
    own; should two keys of a slot agree in these bytes, their documents share a tile. Copies inside a
    batch count once. Keys are hashes, so slots are even. ``own`` tells
    whether the document has its own band's key here or, being the smaller one, that of the band
    above.
    """
    wanted = np.isin(np.arange(len(TOPS) + 1), range(len(TOPS)) if bands is None else bands)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 0):
            values, offsets = shingle_sets(*text_bytes(batch.column(0)))
            nodes = fingerprints(values, offsets)
            label = pc.coalesce(batch.column(1), pa.array(nodes)).to_numpy()
            sizes = np.diff(offsets)
            once = np.zeros(len(nodes), bool)
            once[np.unique(nodes, return_index=True)[1]] = True
            once &= sizes > 0
            values, kept = values[np.repeat(once, sizes)], sizes[once]
            if not len(kept):
                continue
            nodes, label, band = nodes[once], label[once], band_of(kept)
            # Its larger partner may lie in the next band.
            low = kept * OF // NEED > TOPS[band]
            keys, member = [], []
            for own, chosen in ((1, wanted[band]), (0, low & wanted[band + 1])):
                part, ends = values[np.repeat(chosen, kept)], np.append(0, np.cumsum(kept[chosen]))
                tile_band = band[chosen] + 1 - own
                found, owner = part_keys(part, ends, tile_band, level)
                have = np.bincount(owner, minlength=len(tile_band))
                out = early_out(have - may_differ(kept[chosen], bool(own)) - 1, tile_band)
                # Keys of a set are in the order of their parts, which is the same for all.
                stays = np.arange(len(owner)) < (np.cumsum(have) - out)[owner]
                found, owner = found[stays], owner[stays]
                keys.append(found)
                member.append(2 * np.flatnonzero(chosen)[owner] + own)
            keys, member = np.concatenate(keys), np.concatenate(member).astype(np.uint32)
            slot = ((keys >> np.uint64(32)) * np.uint64(tasks) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(slot, kind="stable")
            there, at = np.unique(slot[order], return_index=True)
            at = np.append(at, len(order))
            columns: list[list[bytes]] = [[], [], [], [], []]
            short = (keys << np.uint64(1) | (member & 1).astype(np.uint64)).view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
            for a, b in zip(at[:-1], at[1:], strict=True):
                # Only the nodes that have a key in this slot travel with it.
                r = order[a:b]
                used, index = np.unique(member[r] >> 1, return_inverse=True)
                columns[0].append(short[r].tobytes())
                columns[1].append(index.astype(np.min_scalar_type(len(used))).tobytes())
                columns[2].append(_shortened(nodes[used]))
                moved = np.flatnonzero(label[used] != nodes[used])
                columns[3].append(moved.astype(np.uint32).tobytes())
                columns[4].append(_shortened(label[used][moved]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(there, pa.int32()), *[pa.array(c, pa.binary()) for c in columns]],
                ["slot", "keys", "members", "nodes", "moved", "labels"],
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                held.setdefault(row["slot"], []).append(row)
        for slot in list(held):
            found = _meet(slot, held.pop(slot))
            for at in range(0, len(found[0]), 50_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[at : at + 50_000]) for c in found], ["key", "short", "own", "label", "crowd"]
                )

    kinds = "slot int, keys binary, members binary, nodes binary, moved binary, labels binary"
    packed = texts.select("text_", "label").mapInArrow(pack, kinds)
    dealt = packed.repartition(tasks, "slot")
    return cut_lineage(dealt.mapInArrow(meet, "key long, short long, own boolean, label long, crowd int"))


def _shortened(nodes: np.ndarray) -> bytes:
    return nodes.view(np.uint8).reshape(-1, 8)[:, :NODE_BYTES].tobytes()


def _widened(data: bytes, width: int) -> np.ndarray:
    short = np.frombuffer(data, np.uint8).reshape(-1, width)
    wide = np.zeros((len(short), 8), np.uint8)
    wide[:, :width] = short
    return wide.view(np.int64).ravel()


def _meet(slot: int, rows: list[dict]) -> list[np.ndarray]:
    keys = np.concatenate([_widened(r["keys"], KEY_BYTES) for r in rows]).view(np.uint64)
    own = (keys & np.uint64(1)).astype(bool)
    keys = mix(keys >> np.uint64(1) ^ mix(np.full(1, slot, np.uint64)))
    whose, nodes, labels, base = [], [], [], 0
    for r in rows:
        nodes.append(_widened(r["nodes"], NODE_BYTES))
        labels.append(nodes[-1].copy())
        labels[-1][np.frombuffer(r["moved"], np.uint32)] = _widened(r["labels"], NODE_BYTES)
        whose.append(np.frombuffer(r["members"], np.min_scalar_type(len(nodes[-1]))).astype(np.int64) + base)
        base += len(nodes[-1])
    nodes, labels, whose = (np.concatenate(x) for x in (nodes, labels, whose))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    run = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    label, own = labels[whose[order]], own[order]
    several = np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)
    several &= np.logical_or.reduceat(own, starts)
    keep = np.flatnonzero(several[run])
    keys, own, node = keys[keep], own[keep], nodes[whose[order[keep]]]
    # Copies from different batches.
    order = order[keep[by := np.lexsort((own, node, keys))]]
    keys, own, node = keys[by], own[by], node[by]
    once = np.ones(len(keys), bool)
    once[1:] = (keys[1:] != keys[:-1]) | (node[1:] != node[:-1]) | (own[1:] != own[:-1])
    order, keys, own, node = order[once], keys[once], own[once], node[once]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    run = np.cumsum(new) - 1
    crowd = np.ceil(np.log2(np.bincount(run)))[run] if len(run) else np.zeros(0)
    return [keys.view(np.int64), node, own, labels[whose[order]], crowd.astype(np.int32)]


def without_spare(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """``members`` less those keys that a document can spare, keys of the largest tiles first, and
    with ``node`` for ``short`` and ``band``, that of the tile.

    What a common passage of moderate length brings about is all spared, and its documents never
    meet. Where two nodes are short for the same, each has the keys of both: they meet more documents
    than they have to, and each still leaves out no more keys than it can spare, its own last ones.
    """
    wanted = members.select("short").distinct()
    short = F.col("node").bitwiseAND(F.lit(NODE_BITS)).alias("short")
    spare = sizes.select("node", short, F.col("band").alias("band_"), "spare", "spare_up").join(wanted, "short", "left_semi").distinct()
    mine = Window.partitionBy("node", "own")
    counted = members.join(spare, "short").withColumn("place", F.row_number().over(mine.orderBy("crowd", "key")))
    counted = counted.withColumn("n", F.count(F.lit(1)).over(mine))
    left_out = F.when(F.col("own"), F.col("spare")).otherwise(F.col("spare_up"))
    band = (F.col("band_") + F.when(F.col("own"), 0).otherwise(1)).cast("int").alias("band")
    return cut_lineage(counted.filter(F.col("place") <= F.col("n") - left_out).select("key", "node", "own", "label", "crowd", band))


def _documents_of(df: DataFrame, sizes: DataFrame, nodes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``node`` and ``text_`` of one document for each of ``nodes``.

    Their keys are broadcast up to a checked number; beyond that the texts are joined by a shuffle.
    """
    wanted = nodes.select("node").distinct()
    chosen = cut_lineage(sizes.join(wanted, "node").groupBy("node").agg(F.min("key_").alias("key_")))
    if chosen.count() <= BROADCAST_KEYS:
        chosen = F.broadcast(chosen)
    return _texts(df, doc_id, text).join(chosen, "key_").select("node", "text_")


def _sets(texts: DataFrame) -> DataFrame:
    """``node`` and ``items``, its sorted shingle hashes, written down; repeated rows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            values, offsets = shingle_sets(*text_bytes(batch.column(1)))
            # Should two rows' keys be equal by chance, one is not the node's.
            right = fingerprints(values, offsets) == batch.column(0).to_numpy()
            made = binaries(values.view(np.uint8), 8 * offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), made], ["node", "items"]).filter(pa.array(right))

    return cut_lineage(texts.mapInArrow(run, "node long, items binary").dropDuplicates(["node"]))


def _bitmaps(texts: DataFrame) -> DataFrame:
    """``node``, its ``size`` and its ``bitmap``, wide enough for the band above its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            values, offsets = shingle_sets(*text_bytes(batch.column(1)))
            right = fingerprints(values, offsets) == batch.column(0).to_numpy()
            sizes = np.diff(offsets)
            maps = [
                bitmaps(values[a:b], np.array([0, b - a]), width_of(int(k) + 1))[0].tobytes()
                for a, b, k in zip(offsets[:-1], offsets[1:], band_of(sizes), strict=True)
            ]
            made = [pa.array(sizes, pa.int64()), pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["node", "size", "bitmap"]).filter(pa.array(right))

    return cut_lineage(texts.mapInArrow(run, "node long, size long, bitmap binary").dropDuplicates(["node"]))


def linked_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets reach the threshold, by exact intersection."""
    joined = (
        pairs.join(sets.toDF("a", "items_a"), "a")
        .join(sets.toDF("b", "items_b"), "b")
        .select("a", "b", "items_a", "items_b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(s) > len(t):
                    s, t = t, s
                at = np.searchsorted(t, s)
                both = int((t[np.minimum(at, len(t) - 1)] == s).sum())
                good.append(OF * both >= NEED * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def _relabelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` with the labels of ``roots``, without tiles that have one label only."""
    moved = members.drop("label").join(roots, "node", "left")
    moved = cut_lineage(moved.withColumn("label", F.coalesce("root", "node")).drop("root"))
    several = moved.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    return cut_lineage(moved.join(cut_lineage(several.filter("low < high").select("key")), "key"))


def hub_members(members: DataFrame) -> DataFrame:
    """``members`` of large tiles, each document in its ``HUB_TILES`` most crowded ones.

    The order is the same for all, so that documents of a large group meet in the same tiles. Which pairs
    are found here decides only how many comparisons are saved.
    """
    mine = Window.partitionBy("node").orderBy(F.desc("crowd"), "key", "own")
    large = members.filter(F.col("crowd") >= LARGE).withColumn("place", F.row_number().over(mine))
    return cut_lineage(large.filter(F.col("place") <= HUB_TILES).drop("place"))


def tile_survivors(members: DataFrame, maps: DataFrame, hubs: bool = False) -> DataFrame:
    """Pairs (a, b) of ``members`` (key, node, own, band, label) that pass the bit count bound.

    A tile with many documents is cut into blocks, and each pair of blocks is a tile of its own;
    every two documents meet once a tile. Of tiles with the same documents one is compared. Pairs with
    one label are known to be connected and skipped.
    With ``hubs`` a document names only two others in a tile, that with most passing pairs and that
    which is closest by the bound.
    """
    whose = F.bit_xor(F.xxhash64("node", "own", "band")).alias("whose")
    counts = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), whose)
    counts = cut_lineage(counts.groupBy("whose", "m").agg(F.min("key").alias("key")).select("key", "m"))
    blocks = F.ceil(F.col("m") / TILE).cast("int")
    cut = members.join(counts, "key").withColumn("n", blocks)
    cut = cut.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cut = cut.select(
        "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "own", "band", "label"
    )
    full = cut.join(maps, "node")
    tiles = full.repartition(shuffle_width(members.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tiles_ in whole_groups(batches, ["key", "i", "j"], 2_000):
            a, b = _compare(tiles_, hubs)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return tiles.mapInArrow(run, "a long, b long").distinct()


def _maps_of(tiles: pa.Table, rows: np.ndarray, band: int) -> np.ndarray:
    """Bitmaps of ``rows``, all as wide as their tiles' ``band`` asks for."""
    column = tiles.column("bitmap").combine_chunks().take(pa.array(rows))
    width = width_of(band)
    out = np.zeros((len(rows), width // 64), np.uint64)
    sizes = pc.binary_length(column).to_numpy()
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        data, _ = text_bytes(column.take(pa.array(at)))
        maps = data.view(np.uint64).reshape(len(at), -1).T
        out[at] = folded(maps, width).T
    return out


def _compare(tiles: pa.Table, hubs: bool) -> tuple[np.ndarray, np.ndarray]:
    node, own, label, size, mine, band, i, j = (
        tiles.column(c).to_numpy() for c in ("node", "own", "label", "size", "mine", "band", "i", "j")
    )
    starts = group_starts(tiles, ["key", "i", "j"])
    n = tiles.num_rows
    sizes = np.diff(np.append(starts, n))
    later = np.repeat(starts + sizes, sizes) - np.arange(n) - 1
    found = []
    for b in np.unique(band):
        rows = np.flatnonzero(band == b)
        maps = _maps_of(tiles, rows, int(b))
        # Most pairs already fail with few bits.
        few = folded(maps.T, max(64, width_of(int(b)) // 2)).T
        place = np.zeros(n, np.int64)
        place[rows] = np.arange(len(rows))
        bounds = np.append(0, np.cumsum(later[rows]))
        at = 0
        while at < len(rows):
            stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PAIRS, "right")) - 1)
            u = np.repeat(rows[at:stop], later[rows[at:stop]])
            v = u + 1 + np.arange(len(u)) - np.repeat(bounds[at:stop] - bounds[at], later[rows[at:stop]])
            at = stop
            good = (label[u] != label[v]) & (own[u] | own[v]) & ((i[u] == j[u]) | (mine[u] != mine[v]))
            good &= OF * np.minimum(size[u], size[v]) >= NEED * np.maximum(size[u], size[v])
            good &= band[u] == band[v]
            for bits in (few, maps):
                u, v = u[good], v[good]
                differ = np.zeros(len(u), np.int64)
                for w in range(bits.shape[1]):
                    differ += np.bitwise_count(bits[place[u], w] ^ bits[place[v], w])
                # Both sizes together less the differing shingles are twice the overlap.
                both = size[u] + size[v]
                most = (both - differ) // 2
                good = OF * most >= NEED * (both - most)
            found.append((u[good], v[good], (most / np.maximum(both - most, 1))[good]))
    u, v, close = (np.concatenate(x) for x in zip(*found, strict=True))
    if hubs and len(u):
        degree = np.bincount(u, minlength=n) + np.bincount(v, minlength=n)
        x, y, close = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([close, close])
        named = []
        for best in (degree[y], close):
            order = np.lexsort((y, -best, x))
            named.append(order[np.append(True, x[order][1:] != x[order][:-1])])
        u, v = x[np.concatenate(named)], y[np.concatenate(named)]
    a, b = node[u], node[v]
    pairs = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
    return pairs[:, 0], pairs[:, 1]


def first_partners(sizes: DataFrame) -> DataFrame:
    """One pair (a, b) a node at most, of sets that are probably near copies.

    Each key of the nodes' sketches points at the smallest node that has it; a node's partner is
    the one that most of its keys point at, if these are several. Which pairs are found decides
    only how many comparisons are saved.
    """
    nodes = sizes.filter("n_shingles > 0").select("node", "sketch").dropDuplicates(["node"])
    keys = cut_lineage(nodes.select("node", F.explode("sketch").alias("key")))
    pivots = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("m"))
    pivots = cut_lineage(pivots.filter("m > 1").select("key", "pivot"))
    times = keys.join(pivots, "key").groupBy("node", "pivot").agg(F.count(F.lit(1)).alias("n"))
    best = times.groupBy("node").agg(F.max(F.struct("n", F.expr("~pivot").alias("least"))).alias("top"))
    pairs = best.filter("top.n > 1").select(F.expr("~top.least").alias("a"), F.col("node").alias("b"))
    return cut_lineage(pairs.filter("a != b"))


def _nodes_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))


def labelled_texts(df: DataFrame, sizes: DataFrame, roots: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``text_`` of every row, and ``label``, its root if that is another node than its own."""
    moved = cut_lineage(sizes.join(roots.filter("node != root"), "node").select("key_", F.col("root").alias("label")).distinct())
    if moved.count() <= BROADCAST_KEYS:
        moved = F.broadcast(moved)
    return _texts(df, doc_id, text).join(moved, "key_", "left").select("text_", "label")


def _rooted(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``id_``, ``key_``, ``n_shingles`` and ``root``, the node of its component, of every row."""
    spark = df.sparkSession
    modest_batches(spark)
    sizes = set_sizes(df, doc_id, text)
    total = sizes.agg(F.sum("n_shingles")).first()[0] or 0
    tasks = max(shuffle_width(spark), math.ceil(total / SLOT_KEYS))

    def decided(pairs: DataFrame) -> DataFrame:
        sets = _sets(_documents_of(df, sizes, _nodes_of(pairs), doc_id, text))
        return cut_lineage(linked_pairs(pairs, sets))

    links = decided(first_partners(sizes))
    texts = labelled_texts(df, sizes, components(links), doc_id, text)
    bands = None
    for level in range(FINEST + 1):
        seen = sizes if level == 0 else set_sizes(df, doc_id, text, level)
        members = without_spare(tile_members(texts, tasks, level, bands), seen)
        if not members.isEmpty():
            maps = _bitmaps(_documents_of(df, sizes, members, doc_id, text))
            hot = hub_members(members)
            if not hot.isEmpty():
                # Large tiles first yield a pair a document, lest a group not found so far yields all.
                links = links.union(decided(cut_lineage(tile_survivors(hot, maps, hubs=True))))
                members = _relabelled(members, components(links))
            links = links.union(decided(cut_lineage(tile_survivors(members, maps))))
        # A number of bands, not of documents.
        bands = [r[0] for r in seen.select("crowded_").filter("crowded_ IS NOT NULL").distinct().collect()]
        if not bands:
            break
    roots = components(links)
    return cut_lineage(
        sizes.join(roots, "node", "left").select("id_", "key_", "n_shingles", F.coalesce("root", "node").alias("root"))
    )


def jaccard_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row.

    Words are runs of characters other than ASCII white space, A to Z taken as lower case.
    Documents without words are linked with nothing; NULL texts are such. Rows with equal sets,
    repeated rows among them, are one component. Its id is its smallest document id (a NULL id
    counts only where a component has no other). Shingles and sets are told apart by 64-bit
    hashes. An empty table gives no rows.
    """
    labelled = _rooted(df, doc_id, text)
    first = cut_lineage(labelled.filter("n_shingles > 0").groupBy("root").agg(F.min("id_").alias("first_")))
    return labelled.join(first, "root", "left").select(
        F.col("id_").alias(doc_id),
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.coalesce("first_", "id_")).otherwise(F.col("id_")).alias("component_id"),
    )


def one_per_component(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of ``df``: that with the smallest id, a NULL id only where no row has one.

    Rows are told apart by id and text: of texts with one id the one with the smallest hash stays,
    and repeated rows stay once. Documents without words stay, repeated rows once.
    """
    labelled = _rooted(df, doc_id, text)
    best = F.min(F.struct(F.col("id_").isNull().alias("nameless"), "id_", "key_"))
    headed = labelled.filter("n_shingles > 0").groupBy("root").agg(best.alias("best")).select("best.key_")
    kept = cut_lineage(headed.union(labelled.filter("n_shingles = 0").select("key_")).distinct())
    key, own = free_name(df, "key_"), [quoted(c) for c in df.columns]
    keyed = df.withColumn(key, F.xxhash64(quoted(doc_id), quoted(text).cast("string")))
    return keyed.join(kept.toDF(key), key, "left_semi").dropDuplicates([key]).select(*own)
