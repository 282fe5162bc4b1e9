"""Exact top-k by inner product over a bit-sliced index.

Every component is turned into an integer. A block of rows keeps, for each component and binary
place, one bitmap over its rows. A query's scores come about as bitmaps too: its components say
which slices are added at which place, and carry-save addition of whole bitmaps gives the slices
of all scores at once. Going from the most significant slice downward, rows are split into those
surely among the best k and those still tied; once few are left, these are scored exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loamline.llm.common import quoted
from loamline.llm.vectors import matrices, usable
from loamline.session import cut_lineage

BLOCK_ROWS = 32_768
CHUNK_QUERIES = 64
# Sums of products stay below 2**63 for up to a million components of this size.
LARGEST = 1 << 21
# Vectors that are scored one by one in integers of any size, in one cell.
PACK_ROWS = 512
NINES = str.maketrans("0123456789", "9876543210")
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)

BLOCK_SCHEMA = "block long, dim int, rows int, low long, width int, ids binary, slices binary"


def quantised(values: np.ndarray, scale: float) -> np.ndarray:
    out = np.floor(values * scale)
    if out.size and np.abs(out).max() > LARGEST:
        raise ValueError(f"a component exceeds {LARGEST} after scaling")
    return out.astype(np.int64)


def sliced(values: np.ndarray) -> tuple[int, int, np.ndarray]:
    """(smallest value, binary places, bitmaps of the values above it by component and place)."""
    low = int(values.min()) if values.size else 0
    above = (values - low).T
    width = max(1, int(above.max()).bit_length() if above.size else 1)
    words = -(-values.shape[0] // 64)
    out = np.zeros((values.shape[1], width, words * 8), np.uint8)
    for place in range(width):
        bits = np.packbits((above >> place & 1).astype(np.uint8), axis=1, bitorder="little")
        out[:, place, : bits.shape[1]] = bits
    return low, width, out.view(np.uint64)


def score_slices(slices: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
    """Slices of ``sum(|q| * y)``, least significant first; y is u, or its complement for q < 0.

    Among rows of one block this differs from the inner product by a constant.
    """
    width, words = slices.shape[1], slices.shape[2]
    size = np.abs(query)
    due: dict[int, list[np.ndarray]] = {}
    for place in range(int(size.max()).bit_length() if size.size else 0):
        dims = np.flatnonzero(size >> place & 1)
        if len(dims):
            flip = np.where(query[dims] < 0, FULL, np.uint64(0))[:, None]
            for b in range(width):
                due.setdefault(place + b, []).append(slices[dims, b] ^ flip)
    out, place = [], 0
    while due:
        stack = np.concatenate(due.pop(place, [np.zeros((1, words), np.uint64)]))
        while len(stack) > 1:
            if len(stack) == 2:
                a, b = stack[:1], stack[1:]
                carry, stack = a & b, a ^ b
            else:
                third = len(stack) // 3
                a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                odd = a ^ b
                carry = a & b | c & odd
                stack = np.concatenate([odd ^ c, stack[3 * third :]])
            due.setdefault(place + 1, []).append(carry)
        out.append(stack[0])
        place += 1
    return out


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def rows_of(bitmap: np.ndarray, most: int | None = None) -> np.ndarray:
    """Positions of set bits, the first ``most`` of them."""
    words = np.flatnonzero(bitmap)
    if most is not None:
        words = words[: most + 1]
    bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, bit = np.nonzero(bits)
    return (words[word] * 64 + bit)[:most]


def exact_values(slices: np.ndarray, low: int, rows: np.ndarray) -> np.ndarray:
    bits = slices[:, :, rows // 64] >> (rows % 64).astype(np.uint64) & np.uint64(1)
    weights = np.int64(1) << np.arange(slices.shape[1])
    return np.einsum("dbr,b->rd", bits.astype(np.int64), weights) + low


def best_rows(slices: np.ndarray, allowed: np.ndarray, query: np.ndarray, k: int) -> np.ndarray:
    """Rows that may be among the best ``k``: all better than the k-th, and of those tied with it
    as many of the first as are missing. Rows come in order of their ids."""
    sure, tied = np.zeros_like(allowed), allowed
    if count(tied) <= k:
        return rows_of(tied)
    for bits in reversed(score_slices(slices, query)):
        above = tied & bits
        n = count(sure) + count(above)
        if n > k:
            tied = above
        else:
            sure |= above
            tied = tied & ~bits
        if count(sure) + count(tied) <= 8 * k:
            return rows_of(sure | tied)
    return np.concatenate([rows_of(sure), rows_of(tied, k - count(sure))])


def build_index(df: DataFrame, vec_id: str, embedding: str, scale: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of bit slices over all usable rows with an id, written to the shared folder."""
    named = df.select(quoted(vec_id).cast("long").alias("id_"), quoted(embedding).alias("vector_"))
    good = named.filter(usable(F.col("vector_")) & F.col("id_").isNotNull())
    parts = max(1, math.ceil(good.count() / block_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, values in matrices(batch.column(1)):
                mine = held.setdefault(values.shape[1], [])
                mine.append((ids[rows], quantised(values, scale)))
                if sum(len(i) for i, _ in mine) >= block_rows:
                    yield made(values.shape[1], held.pop(values.shape[1]))
        for dim, mine in held.items():
            yield made(dim, mine)

    def made(dim: int, mine: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids = np.concatenate([i for i, _ in mine])
        order = np.argsort(ids, kind="stable")
        low, width, slices = sliced(np.concatenate([v for _, v in mine])[order])
        row = [[int(ids[order[0]])], [dim], [len(ids)], [low], [width], [ids[order].tobytes()], [slices.tobytes()]]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(row, kinds, strict=True)],
            ["block", "dim", "rows", "low", "width", "ids", "slices"],
        )

    return cut_lineage(good.repartition(parts, "id_").mapInArrow(run, BLOCK_SCHEMA))


def query_chunks(df: DataFrame, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """Queries packed into rows of a few each: ``dim``, ``query_ids`` and their ``values``."""
    named = df.select(quoted(vec_id).cast("long").alias("id_"), quoted(embedding).alias("vector_"))
    good = named.filter(usable(F.col("vector_")) & F.col("id_").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, values in matrices(batch.column(1)):
                values = quantised(values, scale)
                for at in range(0, len(rows), CHUNK_QUERIES):
                    part = slice(at, at + CHUNK_QUERIES)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([values.shape[1]], pa.int32()),
                            pa.array([ids[rows[part]].tobytes()], pa.binary()),
                            pa.array([values[part].tobytes()], pa.binary()),
                        ],
                        ["dim", "query_ids", "values"],
                    )

    return cut_lineage(good.mapInArrow(run, "dim int, query_ids binary, values binary"))


def candidates(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The best rows of each block for each query: ``query_id``, ``vec_id``, ``score``.

    Index blocks and query chunks meet
    in a grid of cells, each pair in exactly one, and each returns at most about 8 k rows a
    query. Vectors of other lengths than the query's are no candidates.
    """
    blocks, chunks = max(1, index.count()), max(1, queries.count())
    b = index.withColumn("b", F.pmod(F.xxhash64("block", "rows"), F.lit(blocks)))
    q = queries.withColumn("c", F.pmod(F.xxhash64("query_ids"), F.lit(chunks)))
    b = b.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)).cast("array<bigint>")))
    q = q.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    cells = b.join(q, ["b", "c", "dim"]).select("dim", "rows", "low", "width", "ids", "slices", "query_ids", "values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                slices = np.frombuffer(r["slices"], np.uint64).reshape(r["dim"], r["width"], -1)
                there = np.packbits(np.ones(r["rows"], np.uint8), bitorder="little")
                there = np.pad(there, (0, slices.shape[2] * 8 - len(there))).view(np.uint64)
                query_ids = np.frombuffer(r["query_ids"], np.int64)
                found = []
                for own, query in zip(
                    query_ids, np.frombuffer(r["values"], np.int64).reshape(-1, r["dim"]), strict=True
                ):
                    allowed = there.copy()
                    first, last = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
                    for row in range(first, last):
                        allowed[row // 64] &= ~(np.uint64(1) << np.uint64(row % 64))
                    rows = best_rows(slices, allowed, query, k)
                    scores = exact_values(slices, r["low"], rows) @ query
                    best = np.lexsort((ids[rows], -scores))[:k]
                    found.append((np.full(len(best), own), ids[rows][best], scores[best]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["query_id", "vec_id", "score"]
                )

    return cells.mapInArrow(run, "query_id long, vec_id long, score long")


def search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Each query's ``k`` best rows: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Ties go to the smaller id; a query's own id is left out. Vectors of other lengths than the
    query's are no candidates.
    """
    return _best(candidates(index, queries, k), k, F.col("score"))


def _best(found: DataFrame, k: int, score: Column) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(score.desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def is_large(vector: Column, scale: float) -> Column:
    """Whether a component is too large for sums of products in 64 bits."""
    return F.coalesce(F.exists(vector, lambda x: F.abs(x.cast("double") * scale) >= LARGEST), F.lit(False))


def whole(x: float, scale: float) -> int:
    """``floor(scale * x)``, also where the product is no finite double."""
    product = scale * x
    return math.floor(product if math.isfinite(product) else Fraction(scale) * Fraction(x))


def order_key(score: int) -> str:
    """Text that sorts as the integer does, whatever its size."""
    digits = str(abs(score))
    if score >= 0:
        return f"1{len(digits):05d}{digits}"
    return f"0{99999 - len(digits):05d}{digits.translate(NINES)}"


def _order_of(score: Column) -> Column:
    """``order_key`` of a long column."""
    digits = F.regexp_replace(score.cast("string"), "-", "")
    size = F.length(digits)
    above = F.concat(F.lit("1"), F.lpad(size.cast("string"), 5, "0"), digits)
    below = F.concat(F.lit("0"), F.lpad((99999 - size).cast("string"), 5, "0"), F.translate(digits, "0123456789", "9876543210"))
    return F.when(score >= 0, above).otherwise(below)


def _packs(df: DataFrame, vec_id: str, embedding: str, rows: int, number: str, vectors: str) -> tuple[DataFrame, int]:
    """Rows of about ``rows`` usable vectors each, and their number."""
    named = df.select(quoted(vec_id).cast("long").alias("id_"), quoted(embedding).cast("array<double>").alias("vector_"))
    good = named.filter(usable(F.col("vector_")) & F.col("id_").isNotNull())
    parts = max(1, math.ceil(good.count() / rows))
    pack = F.pmod(F.xxhash64("id_", F.monotonically_increasing_id()), F.lit(parts)).alias(number)
    packed = good.groupBy(pack).agg(F.collect_list(F.struct("id_", "vector_")).alias(vectors))
    return cut_lineage(packed), parts


def _exact_candidates(
    rows: DataFrame, queries: DataFrame, k: int, vec_id: str, embedding: str, scale: float
) -> DataFrame:
    """Each query's best rows by integers of any size: ids, ``score`` held to 64 bits, and ``order_``.

    For the few vectors that bit slices cannot hold; packs of rows and of queries meet in a grid.
    """
    left, lefts = _packs(rows, vec_id, embedding, PACK_ROWS, "b", "rows")
    right, rights = _packs(queries, vec_id, embedding, CHUNK_QUERIES, "c", "queries")
    left = left.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(rights - 1)).cast("array<bigint>")))
    right = right.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(lefts - 1)).cast("array<bigint>")))
    most = (1 << 63) - 1

    def integers(pack: list[dict]) -> list[tuple[int, list[int]]]:
        return [(r["id_"], [whole(x, scale) for x in r["vector_"]]) for r in pack]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.to_pylist():
                against, out = integers(cell["rows"]), []
                for own, query in integers(cell["queries"]):
                    scores = [
                        (sum(a * b for a, b in zip(query, row)), other)
                        for other, row in against
                        if other != own and len(row) == len(query)
                    ]
                    best = sorted(scores, key=lambda x: (-x[0], x[1]))[:k]
                    out += [(own, other, max(-most - 1, min(most, s)), order_key(s)) for s, other in best]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
                columns = zip(*out, strict=True) if out else ([], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)],
                    ["query_id", "vec_id", "score", "order_"],
                )

    cells = left.join(right, ["b", "c"]).select("rows", "queries")
    return cells.mapInArrow(run, "query_id long, vec_id long, score long, order_ string")


def top_k(df: DataFrame, queries: DataFrame, k: int, vec_id: str, embedding: str, scale: float = 256.0) -> DataFrame:
    """The best ``k`` rows of ``df`` for each row of ``queries``, by integer inner product.

    Components become ``floor(scale * x)``. Vectors that are NULL, empty, or hold NULL or
    non-finite components take no part, nor do rows without an id. Repeated rows are separate
    candidates. No rows, or no queries, give no rows. Vectors with components beyond 2**21 after
    scaling, which bit slices cannot hold, are ranked by integers of any size; a score beyond 64 bits
    is shown as the nearest that fits.
    """
    large = is_large(quoted(embedding), scale)
    small_rows, small_queries = df.filter(~large), queries.filter(~large)
    sliced_ = candidates(
        build_index(small_rows, vec_id, embedding, scale), query_chunks(small_queries, vec_id, embedding, scale), k
    )
    large_rows, large_queries = df.filter(large), queries.filter(large)
    parts = []
    if not large_rows.isEmpty():
        parts.append(_exact_candidates(large_rows, queries, k, vec_id, embedding, scale))
    if not large_queries.isEmpty():
        parts.append(_exact_candidates(small_rows, large_queries, k, vec_id, embedding, scale))
    if not parts:
        return _best(sliced_, k, F.col("score"))
    found = sliced_.withColumn("order_", _order_of(F.col("score")))
    for part in parts:
        found = found.unionByName(part)
    return _best(found, k, F.col("order_"))
