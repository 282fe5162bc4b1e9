"""BPE as a streaming transducer with bounded lookahead, and decoding by a byte-to-text machine.

A text is read in blocks. What leaves the encoder is final, what it holds back has a bounded size:
a few characters that may still combine, one open piece, and inside a long piece as many bytes as
the merge list can look ahead.

Why the lookahead is bounded: let two words agree on their first ``n`` bytes, and apply the merges
of both in order. As long as both have a boundary at ``f`` and agree before it, only a merge across
``f`` in one of them alone can move ``f``, to where its left part began. The next such merge comes
later in the list, and its right part must begin with the token that now stands behind ``f``. So
``f`` moves by the left parts of a chain of merges, and the longest chain is found from the list.
"""

from __future__ import annotations

import bisect
import codecs
import json
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loamline.llm.common import carried, made_schema, modest_batches, quoted
from loamline.llm.spans import Lookup, ragged, small_batches, text_bytes

NONE = 1 << 62
# Characters of a text that are read at a time.
BLOCK = 1 << 16
# Characters held back at the end of a block, more than a special token has.
TAIL = 64
# Bytes by which a long piece moves on at a time, and the characters from which a piece is long.
STEP = 96
LONG = 64
# Separators that Python takes for white space and the splitting rules do not.
NO_SPACE = "\x1c\x1d\x1e\x1f"
# Bytes of pieces that are merged together.
CELLS = 1 << 19
# Chunks a worker remembers in each of two generations; only speed depends on it.
REMEMBERED = 250_000


class MergeList:
    """Merges in order over byte symbols; a piece's last byte is a symbol of its own."""

    def __init__(self, model: dict):
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        names = byte_names()
        self.plain = [vocab[c] for c in names]
        self.closing = [vocab[c + suffix] for c in names]
        self.sizes = {i: 1 for i in [*self.plain, *self.closing]}
        self.parts: dict[int, tuple[int, int]] = {}
        self.order: dict[int, int] = {}
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (left, right) in enumerate(merges):
            a, b, both = vocab[left], vocab[right], vocab[left + right]
            self.parts[both], self.order[both] = (a, b), rank
            self.sizes[both] = self.sizes[a] + self.sizes[b]
            self.rank[a << 32 | b] = rank
            self.made.append(both)
        self.pairs = Lookup(self.rank)
        self.plain_ids, self.closing_ids = np.array(self.plain, np.int64), np.array(self.closing, np.int64)
        self.made_ids = np.array(self.made, np.int64)
        self.longest = max(self.sizes.values())
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """The most bytes before a common end at which two words' tokens can differ.

        Merges are taken in order. A chain may go on from an earlier merge whose left part begins
        the right part of this one; what made the right part from it came no earlier than that merge.
        """
        chains: dict[int, tuple[list[int], list[int]]] = {}
        longest = 0
        for rank, both in enumerate(self.made):
            left, token = self.parts[both]
            reach, above = 0, rank - 1
            while True:
                ranks, lengths = chains.get(token, ((), ()))
                known = bisect.bisect_right(ranks, above)
                if known:
                    reach = max(reach, lengths[known - 1])
                if token not in self.parts:
                    break
                above, token = self.order[token], self.parts[token][0]
            reach += self.sizes[left]
            ranks, lengths = chains.setdefault(left, ([], []))
            ranks.append(rank)
            lengths.append(max(reach, lengths[-1]) if lengths else reach)
            longest = max(longest, reach)
        return longest

    def symbols(self, data: bytes, closed: bool) -> list[int]:
        out = list(map(self.plain.__getitem__, data))
        if closed and data:
            out[-1] = self.closing[data[-1]]
        return out

    def merge(self, tokens: list[int]) -> list[int]:
        """Merges earliest first, of equal ones the leftmost first, until none applies."""
        rank, made = self.rank.get, self.made
        ranks = [rank(a << 32 | b, NONE) for a, b in zip(tokens, tokens[1:])]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            at = ranks.index(best)
            tokens[at : at + 2] = [made[best]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(tokens[at - 1] << 32 | tokens[at], NONE)
            if at < len(ranks):
                ranks[at] = rank(tokens[at] << 32 | tokens[at + 1], NONE)
        return tokens


    def words(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of whole pieces; those of one length are merged together, a merge a step."""
        out = [b""] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for size in np.unique(sizes):
            which = np.flatnonzero(sizes == size)
            for part in np.array_split(which, 1 + len(which) * size // CELLS):
                self._words(part, np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(-1, size), out)
        return out

    def _words(self, which: np.ndarray, data: np.ndarray, out: list[bytes]) -> None:
        tokens = self.plain_ids[data]
        tokens[:, -1:] = self.closing_ids[data[:, -1:]]
        ranks = self.pairs.get(tokens[:, :-1] << 32 | tokens[:, 1:])
        ranks[ranks < 0] = NONE
        while True:
            width = tokens.shape[1]
            if width > 1:
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(at)), at]
                ready = best == NONE
            else:
                ready = np.ones(len(tokens), bool)
            if ready.any():
                raw = tokens[ready].astype("<u4").tobytes()
                for k, i in enumerate(which[ready].tolist()):
                    out[i] = raw[4 * width * k : 4 * width * (k + 1)]
            if ready.all():
                return
            on = ~ready
            which, at, best = which[on], at[on], best[on]
            row = np.arange(len(which))
            left = np.arange(width - 1) + (np.arange(width - 1) > at[:, None])
            tokens = np.take_along_axis(tokens[on], left, 1)
            tokens[row, at] = self.made_ids[best]
            # The pair that merged is gone; those on its two sides are looked up anew.
            ranks = np.take_along_axis(ranks[on], left[:, :-1] + (left[:, :-1] == at[:, None]), 1)
            for side in (at - 1, at):
                there = np.flatnonzero((side >= 0) & (side < width - 2))
                pair = tokens[there, side[there]] << 32 | tokens[there, side[there] + 1]
                found = self.pairs.get(pair)
                ranks[there, side[there]] = np.where(found < 0, NONE, found)


class TokenStream:
    """The tokens of one piece, whatever its length, given out as soon as they cannot change."""

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.held = b""
        self.window = merges.lookahead + merges.longest + STEP

    def feed(self, data: bytes, last: bool = False) -> list[int]:
        m, out = self.merges, []
        self.held += data
        while len(self.held) > self.window:
            stable = self.window - m.lookahead
            end = 0
            for token in m.merge(m.symbols(self.held[: self.window], closed=False)):
                if end + m.sizes[token] > stable:
                    break
                end += m.sizes[token]
                out.append(token)
            self.held = self.held[end:]
        if last:
            out += m.merge(m.symbols(self.held, closed=True))
            self.held = b""
        return out


class Language:
    """Normalizing and splitting rules of a tokenizer file.

    Python's own Unicode tables do the work; text with a character that they do not know goes
    through the library's rules, whose tables may be newer.
    """

    def __init__(self, spec: dict):
        rules = {**spec, "pre_tokenizer": _without_bytes(spec["pre_tokenizer"])}
        self.rules = Tokenizer.from_str(json.dumps(rules))
        pattern = _split_pattern(spec["pre_tokenizer"])
        self.find = regex.compile(pattern).findall
        names = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        if max(map(len, names), default=0) >= TAIL:
            raise ValueError(f"special tokens of {TAIL} characters or more are not supported")
        self.known: set[str] = set()

    def unknown(self, text: str) -> bool:
        """Whether ``text`` has a character without an entry in Python's Unicode tables."""
        new = set(text).difference(self.known)
        self.known.update(c for c in new if unicodedata.category(c) != "Cn")
        return not new <= self.known

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if self.unknown(text):
            return self.rules.normalizer.normalize_str(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pieces(self, text: str) -> list[str]:
        """The pieces of a normalized text."""
        if not text.isascii() and self.unknown(text):
            return [piece for piece, _ in self.rules.pre_tokenizer.pre_tokenize_str(text)]
        return self.find(text)

    @cached_property
    def joining(self) -> frozenset[str]:
        """Characters that may combine with one before them although they are no marks."""
        seconds = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
        found = {chr(int(d[1], 16)) for d in seconds if len(d) == 2 and d[0][0] != "<"}
        hangul = [chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))]
        return frozenset(found.union(hangul))

    def begins(self, char: str) -> bool:
        """Whether text may be cut before ``char`` without changing its normal form."""
        if char.isascii():
            return True
        if self.unknown(char):
            return False
        first = unicodedata.normalize("NFD", char)[0]
        return not unicodedata.combining(first) and first not in self.joining


class Splitter:
    """Chunks of a text that comes in blocks.

    A chunk has no white space and holds whole pieces; a special token is its own chunk. A piece of
    more than LONG characters comes as pairs (part, whether it ends there). Marks that follow each
    other without end are held until they end, as their order is part of the normal form; nothing
    else of unknown length is.
    """

    def __init__(self, language: Language):
        self.language = language
        self.raw = self.open = self.kind = ""
        self.streamed = False

    def feed(self, block: str, last: bool = False) -> list[str | tuple[str, bool]]:
        raw = self.raw + block
        cut = len(raw) if last else self._cut(raw)
        self.raw = raw[cut:]
        text, out = raw[:cut], []
        specials = self.language.specials
        parts = specials.split(text) if specials and "<" in text else [text]
        for k, part in enumerate(parts):
            if k % 2:
                self._close(out)
                out.append(part)
            elif part:
                self._split(self.language.normal(part), out)
        if last:
            self._close(out)
        return out

    def _cut(self, raw: str) -> int:
        cut = max(0, len(raw) - TAIL)
        specials = self.language.specials
        for found in specials.finditer(raw, max(0, cut - TAIL)) if specials else ():
            if found.start() < cut < found.end():
                cut = found.start()
        while cut > 0 and not self.language.begins(raw[cut]):
            cut -= 1
        return cut

    def _close(self, out: list) -> None:
        if self.kind:
            out.append(("", True))
        elif self.open:
            out.append(self.open)
        self.open = self.kind = ""

    def _split(self, text: str, out: list) -> None:
        if self.kind:
            more = self.language.pieces(self.kind + text)[0][1:]
            ended = len(more) < len(text)
            out.append((more, ended))
            if not ended:
                return
            self.kind, text = "", text[len(more) :]
        text = self.open + text
        if any(c in text for c in NO_SPACE):
            self.open = self._pieces(text, out, closed=False)
            return
        chunks = text.split()
        self.open = chunks.pop() if chunks and text.endswith(chunks[-1]) else ""
        if max(map(len, chunks), default=0) <= LONG:
            out += chunks
        else:
            for chunk in chunks:
                if len(chunk) <= LONG:
                    out.append(chunk)
                else:
                    self._pieces(chunk, out, closed=True)
        if len(self.open) > LONG:
            self.open = self._pieces(self.open, out, closed=False)

    def _pieces(self, text: str, out: list, closed: bool) -> str:
        """Append the pieces of ``text``; returned is what may still go on unless it is closed."""
        pieces, open_ = self.language.pieces(text), ""
        if not closed and pieces and text.endswith(pieces[-1]):
            open_ = pieces.pop()
            # A contraction may still be coming.
            if len(open_) == 1 and pieces and pieces[-1] == "'" and text.endswith("'" + open_):
                open_ = pieces.pop() + open_
        for piece in pieces:
            if len(piece) <= LONG:
                out.append(piece)
            else:
                out.append((piece, True))
                self.streamed = True
        if len(open_) > LONG:
            self.kind = "a" if len(self.language.pieces("a" + open_)) == 1 else "!"
            out.append((open_, False))
            self.streamed = True
            return ""
        return open_


class Transducer:
    """Texts to ids and back by a tokenizer file of byte-level BPE with word ends."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        with open(path, encoding="utf-8") as lines:
            spec = json.load(lines)
        self.merges = MergeList(spec["model"])
        self.language = Language(spec)
        self.remembered = remembered
        self.special = {t["content"]: _packed([t["id"]]) for t in spec["added_tokens"]}
        self.young: dict[str, bytes] = dict(self.special)
        self.old: dict[str, bytes] = {}
        names = {i: name for name, i in spec["model"]["vocab"].items()}
        names.update((t["id"], t["content"]) for t in spec["added_tokens"])
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.added = {t["id"] for t in spec["added_tokens"]}

    def _learn(self, chunks: Iterable[str]) -> None:
        """Have the ids of these chunks in the young generation."""
        if len(self.young) > self.remembered:
            self.old, self.young = self.young, dict(self.special)
        young, old = self.young, self.old.get
        new = {}
        for chunk in set(chunks).difference(young):
            known = old(chunk)
            if known is None:
                whole = chunk.isascii() and chunk.isalpha()
                new[chunk] = (chunk,) if whole else self.language.pieces(chunk)
            else:
                young[chunk] = known
        distinct = list(set(chain.from_iterable(new.values())))
        coded = dict(zip(distinct, self.merges.words([p.encode("utf-8") for p in distinct]), strict=True))
        for chunk, pieces in new.items():
            young[chunk] = coded[chunk] if len(pieces) == 1 else b"".join(map(coded.__getitem__, pieces))

    def stream(self, blocks: Iterable[str]) -> Iterator[bytes]:
        """Packed ids of one text, each as soon as it is final."""
        split, long_ = Splitter(self.language), None
        for block, last in _with_last(blocks):
            items = split.feed(block, last)
            self._learn(i for i in items if isinstance(i, str))
            out = []
            for item in items:
                if isinstance(item, str):
                    out.append(self.young[item])
                    continue
                long_ = long_ or TokenStream(self.merges)
                out.append(_packed(long_.feed(item[0].encode("utf-8"), item[1])))
                if item[1]:
                    long_ = None
            yield b"".join(out)

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Packed ids of each text."""
        whole = {}
        for i, text in enumerate(texts):
            if len(text) <= BLOCK:
                split = Splitter(self.language)
                items = split.feed(text, True)
                if not split.streamed:
                    whole[i] = items
        self._learn(chain.from_iterable(whole.values()))
        known = self.young.__getitem__
        return [
            b"".join(map(known, whole[i])) if i in whole else b"".join(self.stream(_blocks(text)))
            for i, text in enumerate(texts)
        ]

    @lru_cache(maxsize=2)
    def _spelling(self, form: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of all tokens one after the other, their starts and sizes."""
        if form == "tokens":
            spelt = [b" " + name.encode("utf-8") for name in self.names]
        elif form == "text":
            byte = {name: i for i, name in enumerate(byte_names())}
            spelt = []
            for i, name in enumerate(self.names):
                if i in self.added:
                    spelt.append(name.encode("utf-8") + b" ")
                    continue
                ends = bool(self.suffix) and name.endswith(self.suffix)
                body = name.removesuffix(self.suffix) if ends else name
                spelt.append(bytes(map(byte.__getitem__, body)) + (b" " if ends else b""))
        else:
            raise ValueError(f"no form {form}")
        sizes = np.fromiter(map(len, spelt), np.int64, len(spelt))
        return np.frombuffer(b"".join(spelt), np.uint8), np.cumsum(sizes) - sizes, sizes

    def read(self, blocks: Iterable[np.ndarray], form: str = "tokens") -> Iterator[str]:
        """Text of one sequence of ids that comes in blocks.

        The decoder's state is the unfinished character, at most three bytes, and whether a space
        is due; bytes that are no text become U+FFFD.
        """
        data, starts, sizes = self._spelling(form)
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        first, due = True, ""
        for block, last in _with_last(blocks):
            text = machine.decode(ragged(data, starts[block], sizes[block]).tobytes(), last)
            if form == "tokens":
                if first and text:
                    text, first = text[1:], False
            else:
                text, due = due + text, ""
                if text.endswith(" "):
                    text, due = text[:-1], " "
            yield text

    def decode(self, ids: np.ndarray, offsets: np.ndarray, form: str = "tokens") -> list[str]:
        """The text of each of several sequences, given as n + 1 offsets into ``ids``."""
        pairs = zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)
        return ["".join(self.read((ids[k : min(k + BLOCK, b)] for k in range(a, b, BLOCK)), form)) for a, b in pairs]


def byte_names() -> list[str]:
    """The character that stands for each byte: its own if printable, else the next after U+00FF."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _blocks(text: str) -> Iterator[str]:
    return (text[at : at + BLOCK] for at in range(0, len(text), BLOCK))


def _with_last(blocks: Iterable) -> Iterator[tuple]:
    """Each block, and whether it is the last; no block at all gives nothing."""
    held, some = None, False
    for block in blocks:
        if some:
            yield held, False
        held, some = block, True
    if some:
        yield held, True


def _steps(rule: dict) -> list[dict]:
    return rule["pretokenizers"] if rule["type"] == "Sequence" else [rule]


def _without_bytes(rule: dict) -> dict:
    """The splitting steps alone, so that pieces come as text."""
    return {"type": "Sequence", "pretokenizers": [s for s in _steps(rule) if s["type"] != "ByteLevel"]}


def _split_pattern(rule: dict) -> str:
    (split,) = [s for s in _steps(rule) if s["type"] == "Split"]
    if split["behavior"] != "Removed" or not split["invert"]:
        raise ValueError("pieces must be the matches of the pattern")
    return split["pattern"]["Regex"]


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One transducer for each worker process, read from the file on its own machine."""
    return Transducer(path)


def encode_texts(df: DataFrame, path: str, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Columns ``keep`` and ``ids``, the whole text's ids as little-endian unsigned 32-bit integers.

    NULL and empty texts give no ids, special tokens inside a text give theirs. Row-wise, without a
    shuffle; repeated rows stay repeated. Where ``keep`` has a column of a new one's name, the new name is
    lengthened. ``path`` must exist on every executor.
    """
    modest_batches(df.sparkSession)
    narrow = carried(df, keep, quoted(text).cast("string"))
    schema = made_schema(df, keep, ids=F.lit(b""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = transducer(path)
        for batch in small_batches(batches, len(keep), 1 << 20):
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            made = pa.array(code.encode(texts), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], schema.names)

    return narrow.mapInArrow(run, schema)


def decode_ids(
    df: DataFrame, path: str, ids: str = "ids", keep: Sequence[str] = (), form: str = "tokens"
) -> DataFrame:
    """Columns ``keep`` and ``decoded``; NULL ids give an empty text.

    ``form`` "tokens" joins the tokens by spaces as the library does for a file without a decoder;
    "text" gives the bytes' text, with a space after each piece but the last.
    """
    modest_batches(df.sparkSession)
    narrow = carried(df, keep, quoted(ids))
    schema = made_schema(df, keep, decoded=F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = transducer(path)
        for batch in small_batches(batches, len(keep), 1 << 20):
            raw, offsets = text_bytes(batch.column(len(keep)))
            texts = code.decode(raw.view("<u4"), offsets // 4, form)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], schema.names)

    return narrow.mapInArrow(run, schema)
