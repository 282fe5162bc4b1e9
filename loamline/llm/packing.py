"""Packing of token pieces into fixed-length sequences over their length histogram.

Documents are cut into pieces of at most the sequence length. Only the histogram of piece lengths
(one entry per length, however many documents) reaches the driver, where shortest-pack-first
turns it into packing patterns with counts. The patterns are joined back to the pieces by their
rank within a length.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamline.llm.bpe import Encoder, Vocabulary
from loamline.llm.common import modest_batches, quoted
from loamline.llm.spans import binaries, small_batches, text_bytes
from loamline.session import cut_lineage

# Pieces that share a length are ranked in cells of about so many.
CELL = 1_000_000


class LibraryEncoder(Encoder):
    """The same ids; chunks not seen before are encoded by the library, which is quicker."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        super().__init__(vocabulary, pattern)
        self.library = tiktoken.Encoding(
            "own", pat_str=pattern, mergeable_ranks=vocabulary.ranks, special_tokens={}
        ).encode_ordinary

    def _code(self, chunks: list[str]) -> list[bytes]:
        return [np.array(self.library(c), "<u4").tobytes() for c in chunks]


@lru_cache(maxsize=2)
def library_encoder(rank_file: str, pattern: str) -> LibraryEncoder:
    return LibraryEncoder(Vocabulary.read(rank_file), pattern)


def cut_documents(
    df: DataFrame,
    rank_file: str,
    pattern: str,
    limit: int,
    end_id: int,
    special: Mapping[str, int],
    text: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Columns ``keep``, ``start``, ``length``, ``ids`` and ``doc_tokens``, a row for each piece.

    A document's ids are those of its whole text and ``end_id``; pieces hold at most ``limit``.
    A NULL or empty text is the end alone. ``special`` strings inside a text become single ids.
    """
    modest_batches(df.sparkSession)
    columns = [quoted(c) for c in keep]
    narrow = df.select(*columns, quoted(text).cast("string").alias("text_"))
    more = [F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("length")]
    schema = df.select(*columns, *more, F.lit(b"").alias("ids"), F.lit(0).cast("long").alias("doc_tokens")).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = library_encoder(rank_file, pattern)
        for batch in small_batches(batches, len(keep)):
            ids, offsets = encode_special(code, *text_bytes(batch.column(len(keep))), special)
            whole = np.diff(offsets) + 1
            out = np.insert(ids, offsets[1:], np.uint32(end_id))
            offsets = offsets + np.arange(len(offsets))
            pieces = -(-whole // limit)
            doc = np.repeat(np.arange(len(whole)), pieces)
            start = limit * (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            length = np.minimum(limit, whole[doc] - start)
            ends = np.append(0, np.cumsum(length))
            kept = [c.take(pa.array(doc)) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(start), pa.array(length), binaries(out.view(np.uint8), 4 * ends), pa.array(whole[doc])],
                names,
            )

    return narrow.mapInArrow(run, schema)


def encode_special(
    code: Encoder, data: np.ndarray, offsets: np.ndarray, special: Mapping[str, int]
) -> tuple[np.ndarray, np.ndarray]:
    """Encode texts, cutting them at special strings, which become single ids."""
    raw = data.tobytes()
    table = {s.encode("utf-8"): i for s, i in special.items()}
    if not any(s in raw for s in table):
        return code.encode_bytes(data, offsets)
    marks = re.compile(b"(" + b"|".join(map(re.escape, sorted(table, key=len, reverse=True))) + b")")
    parts, sizes = [np.zeros(0, "<u4")], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        found = marks.split(raw[a:b])
        ids = [
            np.array([table[x]], "<u4")
            if k % 2
            else code.encode_bytes(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0]
            for k, x in enumerate(found)
        ]
        parts += ids
        sizes.append(sum(map(len, ids)))
    return np.concatenate(parts), np.append(0, np.cumsum(sizes, dtype=np.int64))


def pack_histogram(counts: Mapping[int, int], limit: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packing patterns: (number of sequences, [(length, how often), ...]).

    Lengths go longest first, each into the pack that is shortest so far if it fits there, into a
    new pack if not; packs with one content are one entry with a count. The number of patterns
    depends on ``limit``, not on how many pieces there are.
    """
    heap: list[tuple[int, int, int, tuple[tuple[int, int], ...]]] = []
    serial = 0
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left = counts[length]
        while left:
            if heap and -heap[0][0] >= length:
                space, _, packs, content = heapq.heappop(heap)
                took = min(left, packs)
                if took < packs:
                    heapq.heappush(heap, (space, serial, packs - took, content))
                    serial += 1
                if content[-1][0] == length:
                    content = (*content[:-1], (length, content[-1][1] + 1))
                else:
                    content = (*content, (length, 1))
                new = [(-space - length, took, content)]
                left -= took
            else:
                # Nothing has room: packs of this length alone, filled one after the other.
                each = limit // length
                full, rest = divmod(left, each)
                new = [(limit - each * length, full, ((length, each),))] if full else []
                if rest:
                    new.append((limit - rest * length, 1, ((length, rest),)))
                left = 0
            for space, packs, content in new:
                heapq.heappush(heap, (-space, serial, packs, content))
                serial += 1
    return [(packs, list(content)) for _, _, packs, content in sorted(heap, key=lambda x: x[1])]


def placement_table(patterns: Sequence[tuple[int, list[tuple[int, int]]]]) -> tuple[np.ndarray, ...]:
    """For runs of ranks within a length: (length, first rank, first sequence, offset), sorted."""
    rows, used, sequence = [], {}, 0
    for packs, content in patterns:
        offset = 0
        for length, times in content:
            for _ in range(times):
                rank = used.get(length, 0)
                rows.append((length, rank, sequence, offset))
                used[length] = rank + packs
                offset += length
        sequence += packs
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2], table[:, 3]


def ranked(pieces: DataFrame, keys: Sequence[str], total: int) -> DataFrame:
    """``pieces`` with ``rank``, gapless from 0 within a length.

    A length may hold any share of the pieces, so it is dealt into cells by a hash of ``keys``;
    cells are ranked on their own and shifted by the sizes of the cells before them.
    """
    cells = max(1, math.ceil(total / CELL))
    dealt = pieces.withColumn("cell", F.pmod(F.xxhash64(*[quoted(k) for k in keys]), F.lit(cells)))
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    shifts = dealt.groupBy("length", "cell").count().select(
        "length", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift")
    )
    own = Window.partitionBy("length", "cell").orderBy(*[quoted(k) for k in keys])
    return (
        dealt.withColumn("in_cell", F.row_number().over(own) - 1)
        .join(shifts, ["length", "cell"])
        .withColumn("rank", F.col("shift") + F.col("in_cell"))
        .drop("cell", "in_cell", "shift")
    )


def place_pieces(pieces: DataFrame, limit: int, keys: Sequence[str]) -> DataFrame:
    """``pieces`` (any columns, ``length`` among them) with ``sequence_id`` and ``offset``.

    ``keys`` should tell pieces apart; pieces equal in all of them are interchangeable. What is
    sent to the executors is the placement table: its size depends on ``limit`` alone.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    table = placement_table(pack_histogram(counts, limit))
    shared = spark.sparkContext.broadcast(table)
    order = ranked(pieces, keys, sum(counts.values()))
    names = [c for c in order.columns if c != "rank"]
    zero = F.lit(0).cast("long")
    schema = order.select(*[quoted(c) for c in names], zero.alias("sequence_id"), zero.alias("offset")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, sequences, offsets = shared.value
        keys_ = lengths << 44 | ranks
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys_, batch.column("length").to_numpy() << 44 | rank, "right") - 1
            made = [pa.array(sequences[at] + rank - ranks[at]), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *made], schema.names)

    return order.mapInArrow(run, schema)


def pack_documents(
    df: DataFrame,
    rank_file: str,
    pattern: str,
    limit: int = 2048,
    end_id: int = 1,
    special: Mapping[str, int] | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
) -> tuple[DataFrame, DataFrame]:
    """(pieces with their ids, where each piece lies).

    Pieces are tokenized once and written to the shared folder. Both tables have the document id
    and ``start``. NULL ids are allowed, repeated rows are packed as often as they occur, and an
    empty table packs into nothing.
    """
    pieces = cut_lineage(cut_documents(df, rank_file, pattern, limit, end_id, special or {}, text, [doc_id]))
    narrow = pieces.select(
        quoted(doc_id), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"
    )
    return pieces, place_pieces(narrow, limit, [doc_id, "start", "ids_crc32"])


def sequences(pieces: DataFrame, placed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``sequence_id`` and ``ids``: every sequence's ids in order. Document ids must be unique."""
    return (
        placed.join(pieces.select(quoted(doc_id), "start", "ids"), [doc_id, "start"])
        .groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        .select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
    )
