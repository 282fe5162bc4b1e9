"""Byte-level BPE by prefix dynamic programming.

Every byte prefix of a piece has exactly one token that can end its encoding. Once these last
tokens are known, the encoding of any prefix is read off backwards, one more byte costs one more
step, and an edit needs new steps only from where it happened on.

A token may end prefix ``i`` if it follows the last token of the prefix before it the way BPE
would leave them: merging the two, or their parts, must not have come first. Ranks are merge
order, so that is decided by ranks alone.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import quoted
from loamline.llm.spans import Lookup, binaries, ragged, small_batches, span_hashes, text_bytes

NO_LIMIT = 1 << 62
# Bytes that are, or may begin, white space in UTF-8.
MAYBE_SPACE = np.isin(np.arange(256), [*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3])
# Chunks a worker remembers between batches; only speed depends on it, as on what follows.
REMEMBERED = 150_000
# The same where encoding is all that a worker does, and the bytes of text it then takes at a time.
MANY = 500_000
BATCH_BYTES = 1 << 20
# Pair answers a worker remembers.
TRIED = 1_000_000
# Longer pieces are encoded one by one, shorter ones so many at a time.
BATCHED = 32
BATCH = 16_384


class Vocabulary:
    """Tokens, their ranks, and the two parts each was merged from."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        # Pairs tried so far, as left << 32 | right: a saved answer is several times cheaper.
        self.tried: dict[int, bool] = {}

    @cached_property
    def parts(self) -> dict[int, tuple[int, int]]:
        """The two tokens each one was merged from; a single byte is its own parts."""
        return {
            rank: (rank, rank) if len(token) == 1 else self._last_merge(token, rank)
            for token, rank in self.ranks.items()
        }

    @cached_property
    def merged(self) -> dict[tuple[int, int], int]:
        return {both: rank for rank, both in self.parts.items() if both[0] != rank}

    @cached_property
    def reversed_trie(self) -> tuple[dict[int, int], list[int | None]]:
        """Tokens read from their ends: ``node << 8 | byte`` leads to a node, and the token there."""
        steps: dict[int, int] = {}
        token_at: list[int | None] = [None]
        for token, rank in self.ranks.items():
            node = 0
            for byte in reversed(token):
                step = node << 8 | byte
                node = steps.get(step, 0)
                if not node:
                    node = steps[step] = len(token_at)
                    token_at.append(None)
            token_at[node] = rank
        return steps, token_at

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """From a rank file: a line for each token, base64 and rank."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int]:
        """The pair that merges to ``token`` when only earlier tokens exist."""
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:
            best, at = NO_LIMIT, -1
            for i in range(len(parts) - 1):
                found = self.ranks.get(parts[i] + parts[i + 1], NO_LIMIT)
                if found < best:
                    best, at = found, i
            if best >= rank:
                raise ValueError(f"token {rank} has no merge from earlier tokens")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE can leave ``right`` directly after ``left``.

        Both are taken apart from the seam outwards, latest merge first. If the two halves at the
        seam make a token that came before the merge which closed one of them, BPE would have
        taken that one instead.
        """
        bound, good = NO_LIMIT, True
        while True:
            if self.merged.get((left, right), NO_LIMIT) < bound:
                good = False
                break
            # The later of the two closing merges is undone; ties undo the right one, as the
            # leftmost pair of equal rank is merged first.
            if left > right:
                inner = self.parts[left][1]
                if inner != left:
                    bound, left = left, inner
                    continue
                inner = self.parts[right][0]
                if inner == right:
                    break
                bound, right = right + 1, inner
            else:
                inner = self.parts[right][0]
                if inner != right:
                    bound, right = right + 1, inner
                    continue
                inner = self.parts[left][1]
                if inner == left:
                    break
                bound, left = left, inner
        return good


class Prefixes:
    """The last token of every prefix of a growing byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = bytearray()
        self.last: list[int] = []
        self.append(data)

    def append(self, more: bytes) -> Prefixes:
        """Add bytes; what is known of earlier prefixes stays as it is."""
        self.data += more
        v, data, last = self.vocabulary, bytes(self.data), self.last
        steps, token_at = v.reversed_trie
        backward, tried = steps.get, v.tried
        for end in range(len(last), len(data)):
            node, start, found = 0, end, None
            while start >= 0:
                node = backward(node << 8 | data[start])
                if node is None:
                    break
                token = token_at[node]
                if token is not None:
                    if start == 0:
                        found = token
                        break
                    pair = last[start - 1] << 32 | token
                    good = tried.get(pair)
                    if good is None:
                        good = tried[pair] = v.fits(last[start - 1], token)
                    if good:
                        found = token
                        break
                start -= 1
            if found is None:
                raise ValueError(f"byte {data[end]} is not in the vocabulary")
            last.append(found)
        if len(tried) > TRIED:
            tried.clear()
        return self

    def replace(self, start: int, stop: int, new: bytes) -> Prefixes:
        """Put ``new`` in place of bytes ``start`` to ``stop``; prefixes before it are kept."""
        tail = bytes(self.data[stop:])
        del self.data[start:], self.last[start:]
        return self.append(new + tail)

    def ids(self) -> list[int]:
        """The encoding, read backwards from the end."""
        out, at = [], len(self.last)
        while at:
            token = self.last[at - 1]
            out.append(token)
            at -= len(self.vocabulary.tokens[token])
        return out[::-1]


class PrefixBatch:
    """The same last tokens for many short pieces at once, one end position at a time."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        steps, token_at = vocabulary.reversed_trie
        self.backward = Lookup(steps)
        self.token_at = np.array([-1 if t is None else t for t in token_at], np.int64)
        self.merged = Lookup({a << 32 | b: rank for (a, b), rank in vocabulary.merged.items()})
        self.parts = np.zeros((len(vocabulary.tokens), 2), np.int64)
        for rank, both in vocabulary.parts.items():
            self.parts[rank] = both
        self.sizes = np.array([len(t) for t in vocabulary.tokens], np.int64)

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``Vocabulary.fits`` for arrays."""
        good = np.ones(len(left), bool)
        open_ = np.arange(len(left))
        bound = np.full(len(left), NO_LIMIT, np.int64)
        left, right = left.copy(), right.copy()
        while len(open_):
            both = self.merged.get(left << 32 | right)
            bad = (both >= 0) & (both < bound)
            good[open_[bad]] = False
            inner_left, inner_right = self.parts[left, 1], self.parts[right, 0]
            can_left, can_right = inner_left != left, inner_right != right
            take_left = can_left & ((left > right) | ~can_right)
            take_right = can_right & ~take_left
            bound = np.where(take_left, left, np.where(take_right, right + 1, bound))
            left = np.where(take_left, inner_left, left)
            right = np.where(take_right, inner_right, right)
            on = ~bad & (take_left | take_right)
            open_, bound, left, right = open_[on], bound[on], left[on], right[on]
        return good

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece, packed; pieces have at least one byte.

        Pieces are sorted, so that those with a common prefix follow each other: the last token
        of a prefix is found once and copied to the other pieces that begin with it.
        """
        order = sorted(range(len(pieces)), key=pieces.__getitem__)
        sizes = np.fromiter((len(pieces[i]) for i in order), np.int64, len(pieces))
        width = int(sizes.max())
        data = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in order), np.uint8)
        data = data.reshape(-1, width).astype(np.int64)
        differ = np.ones((len(pieces), width), bool)
        differ[1:] = data[1:] != data[:-1]
        new = np.logical_or.accumulate(differ, axis=1)
        last = np.full((len(pieces), width + 1), -1, np.int64)
        for end in range(1, width + 1):
            here = np.flatnonzero(sizes >= end)
            first = new[here, end - 1]
            # A shorter piece may stand between two that share a prefix; it ends their run.
            first[1:] |= np.diff(here) > 1
            first[:1] = True
            rows = here[first]
            self._last_tokens(data, last, rows, end)
            last[here, end] = last[rows[np.cumsum(first) - 1], end]
        ids = np.zeros((len(pieces), width), "<u4")
        place, at, open_ = np.full(len(pieces), width), sizes.copy(), np.arange(len(pieces))
        while len(open_):
            token = last[open_, at[open_]]
            place[open_] -= 1
            ids[open_, place[open_]] = token
            at[open_] -= self.sizes[token]
            open_ = open_[at[open_] > 0]
        out: list[bytes] = [b""] * len(pieces)
        raw, row = ids.tobytes(), 4 * width
        for k, (i, p) in enumerate(zip(order, place.tolist(), strict=True)):
            out[i] = raw[k * row + 4 * p : (k + 1) * row]
        return out

    def _last_tokens(self, data: np.ndarray, last: np.ndarray, rows: np.ndarray, end: int) -> None:
        node = np.zeros(len(rows), np.int64)
        for start in range(end - 1, -1, -1):
            node = self.backward.get(node << 8 | data[rows, start])
            rows, node = rows[node >= 0], node[node >= 0]
            token = self.token_at[node]
            good = token >= 0
            if start:
                maybe = np.flatnonzero(good)
                good[maybe] = self.fits(last[rows[maybe], start], token[maybe])
            last[rows[good], end] = token[good]
            rows, node = rows[~good], node[~good]
            if not len(rows):
                return
        if len(rows):
            raise ValueError("a byte is not in the vocabulary")


class Encoder:
    """Whole texts to ids and back; each match of the pattern is encoded on its own.

    The pattern always cuts before a space that no white space follows. The chunks between such
    cuts are told apart by 64-bit hashes, and each distinct one is encoded once.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str, remembered: int = REMEMBERED):
        self.vocabulary = vocabulary
        self.pieces = regex.compile(pattern).findall
        self.remembered = remembered
        self.bytes_of = np.frombuffer(b"".join(vocabulary.tokens), np.uint8)
        self.byte_sizes = np.fromiter(map(len, vocabulary.tokens), np.int64, len(vocabulary.tokens))
        self.byte_starts = np.cumsum(self.byte_sizes) - self.byte_sizes
        self._forget()

    @cached_property
    def batch(self) -> PrefixBatch:
        return PrefixBatch(self.vocabulary)

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def _encode_pieces(self, lists: list[list[str]]) -> list[bytes]:
        """Ids of each list of pieces; every distinct piece is encoded once."""
        known: dict[str, bytes] = {}
        short: list[str] = []
        ranks = self.vocabulary.ranks
        for piece in {p for pieces in lists for p in pieces}:
            raw = piece.encode("utf-8")
            whole = ranks.get(raw)
            if whole is not None:
                known[piece] = whole.to_bytes(4, "little")
            elif len(raw) <= BATCHED:
                short.append(piece)
            else:
                known[piece] = np.array(Prefixes(self.vocabulary, raw).ids(), "<u4").tobytes()
        short.sort()
        for at in range(0, len(short), BATCH):
            part = short[at : at + BATCH]
            known.update(zip(part, self.batch.encode([p.encode("utf-8") for p in part]), strict=True))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in lists]

    def _code(self, chunks: list[str]) -> list[bytes]:
        return self._encode_pieces(
            [[c] if c.isalpha() or c[0] == " " and c[1:].isalpha() else self.pieces(c) for c in chunks]
        )

    def _learn(self, keys: np.ndarray, chunks: list[str]) -> None:
        """Add chunks, given by their hashes, which are new and in ascending order."""
        coded = self._code(chunks)
        sizes = np.fromiter((len(c) // 4 for c in coded), np.int64, len(coded))
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(coded), "<u4")])
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.starts = np.insert(self.starts, at, starts)
        self.sizes = np.insert(self.sizes, at, sizes)

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the n + 1 offsets of each text's ids."""
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        cut = np.zeros(len(data) + 1, bool)
        cut[:-2] = (data[:-1] == 0x20) & ~MAYBE_SPACE[data[1:]]
        # A space that ends a text belongs to what stands before it.
        cut[offsets[1:][offsets[1:] > 0] - 1] = False
        cut[offsets] = True
        starts = np.flatnonzero(cut[:-1])
        stops = np.append(starts[1:], len(data))
        unique, one, of = np.unique(span_hashes(data, starts, stops), return_index=True, return_inverse=True)
        if len(self.keys) > self.remembered:
            self._forget()
        new = np.flatnonzero(~np.isin(unique, self.keys, assume_unique=True))
        if len(new):
            raw = data.tobytes()
            spans = zip(starts[one[new]].tolist(), stops[one[new]].tolist(), strict=True)
            self._learn(unique[new], [raw[a:b].decode("utf-8") for a, b in spans])
        at = np.searchsorted(self.keys, unique)
        sizes = self.sizes[at][of]
        ids = ragged(self.ids, self.starts[at][of], sizes)
        ends = np.append(0, np.cumsum(sizes))
        return ids, ends[np.searchsorted(starts, offsets)]

    def encode(self, text: str) -> list[int]:
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        return self.encode_bytes(raw, np.array([0, len(raw)]))[0].tolist()

    def decode_ids(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts and the n + 1 offsets of each text's bytes; the inverse of the above."""
        sizes = self.byte_sizes[ids]
        return ragged(self.bytes_of, self.byte_starts[ids], sizes), np.append(0, np.cumsum(sizes))[offsets]


@lru_cache(maxsize=2)
def encoder(rank_file: str, pattern: str, remembered: int = REMEMBERED) -> Encoder:
    """One encoder for each worker process, read from the rank file on its own machine."""
    return Encoder(Vocabulary.read(rank_file), pattern, remembered)


def encode_texts(
    df: DataFrame, rank_file: str, pattern: str, text: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """Columns ``keep`` and ``ids``, the whole text's ids as little-endian unsigned 32-bit integers.

    NULL and empty texts give no ids. Row-wise: no shuffle, equal rows give equal rows.
    ``rank_file`` must exist on every executor, as an installed package does.
    """
    columns = [quoted(c) for c in keep]
    narrow = df.select(*columns, quoted(text).cast("string").alias("text_"))
    schema = df.select(*columns, F.lit(b"").alias("ids")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(rank_file, pattern, MANY)
        for batch in small_batches(batches, len(keep), BATCH_BYTES):
            ids, offsets = code.encode_bytes(*text_bytes(batch.column(len(keep))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], binaries(ids, 4 * offsets)], [*keep, "ids"])

    return narrow.mapInArrow(run, schema)


def decode_ids(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", keep: Sequence[str] = ()) -> DataFrame:
    """Columns ``keep`` and ``decoded``, the bytes of the ids' tokens; NULL ids give no bytes."""
    columns = [quoted(c) for c in keep]
    narrow = df.select(*columns, quoted(ids).alias("ids_"))
    schema = df.select(*columns, F.lit(b"").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(rank_file, pattern, MANY)
        for batch in small_batches(batches, len(keep)):
            raw, offsets = text_bytes(batch.column(len(keep)))
            data, ends = code.decode_ids(raw.view("<u4"), offsets // 4)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], binaries(data, ends)], [*keep, "decoded"])

    return narrow.mapInArrow(run, schema)
