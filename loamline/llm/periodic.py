"""Periodic runs of words: a stretch that repeats itself with its smallest period four times or more.

Short periods are scanned lag by lag. For longer ones, each scale looks at periods from one power of
two to the next: grams of the larger length are hashed, and the minima of sliding windows of half
that length are kept. Inside a run the windows repeat at the period's distance and so do their
minima, while no gram as long as the period occurs twice within one. Neighbouring equal minima are
therefore one period apart; they seed the run, which is then extended and compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import carried, made_schema, modest_batches, quoted
from loamline.llm.spans import mix, ragged, small_batches, span_hashes, text_bytes

REPEATS = 4
LEAST = 6
# Longest period that is scanned lag by lag.
DIRECT = 8
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
STEP_A, STEP_B = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
# Cells of one comparison matrix.
CELLS = 1 << 20

RUN = "array<struct<start:long,length:long,period:long>>"
RUN_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the words of all texts, and the n + 1 offsets of each text's words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    blank = SPACE[data]
    begins, ends = ~blank, ~blank
    begins[1:] &= blank[:-1]
    ends[:-1] &= blank[1:]
    # Words do not go on from one text to the next.
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = ~blank[edges]
    ends[edges - 1] = ~blank[edges - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` of every window of ``width`` values: running bests of blocks from both sides meet."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    fill = np.uint64(0) if best is np.maximum else ~np.uint64(0)
    padded = np.full(-(-len(values) // width) * width, fill)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    back = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[:n], ahead[width - 1 : width - 1 + n])


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the smallest value of some window of ``width`` positions."""
    least = sliding(hashes, width, np.minimum)
    if not len(least):
        return np.zeros(0, np.int64)
    edge = np.zeros(width - 1, np.uint64)
    most = sliding(np.concatenate([edge, least, edge]), width, np.maximum)
    return np.flatnonzero(most == hashes)


def lag_runs(words: np.ndarray, lag: int, offset: int = 0) -> list[tuple[int, int, int]]:
    """(start, length, lag) of the stretches long enough in which words ``lag`` apart are equal."""
    same = np.zeros(max(0, len(words) - lag) + 2, np.int8)
    same[1:-1] = words[lag:] == words[: len(same) - 2]
    change = np.diff(same)
    starts, stops = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    sizes = stops - starts + lag
    long_ = sizes >= max(LEAST, REPEATS * lag)
    return [(offset + s, n, lag) for s, n in zip(starts[long_].tolist(), sizes[long_].tolist(), strict=True)]


def _reach(words: np.ndarray, at: np.ndarray, lag: np.ndarray, step: int, width: int) -> np.ndarray:
    """How many words from ``at`` on, in direction ``step``, equal those ``lag`` further on."""
    out = np.zeros(len(at), np.int64)
    open_ = np.arange(len(at))
    rows = max(1, CELLS // width)
    while len(open_):
        still = []
        for k in range(0, len(open_), rows):
            some = open_[k : k + rows]
            index = (at[some] + step * out[some])[:, None] + step * np.arange(width)
            other = index + lag[some][:, None]
            inside = (index >= 0) & (other < len(words))
            same = inside & (words[np.where(inside, index, 0)] == words[np.where(inside, other, 0)])
            whole = same.all(axis=1)
            out[some] += np.where(whole, width, same.argmin(axis=1))
            still.append(some[whole])
        open_ = np.concatenate(still)
    return out


def scale_runs(words: np.ndarray, hashes: np.ndarray, gram: int) -> list[tuple[int, int, int]]:
    """Runs with periods above half of ``gram`` up to ``gram``; ``hashes`` are of grams of that length."""
    places = minimizers(hashes, gram // 2)
    order = np.argsort(hashes[places], kind="stable")
    places = places[order]
    lag = places[1:] - places[:-1]
    near = (hashes[places[1:]] == hashes[places[:-1]]) & (lag > gram // 2) & (lag <= gram)
    lag, first = lag[near], places[:-1][near]
    if not len(lag):
        return []
    order = np.lexsort((first, lag))
    lag, first = lag[order], first[order]
    # Seeds of one lag whose grams touch lie in one stretch.
    new = np.ones(len(lag), bool)
    new[1:] = (lag[1:] != lag[:-1]) | (first[1:] > first[:-1] + gram)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(lag)) - 1
    lag, left, right = lag[heads], first[heads], first[tails] + gram
    left = left - _reach(words, left - 1, lag, -1, gram)
    right = right + _reach(words, right, lag, 1, gram)
    out = []
    for a, b, q in zip(left.tolist(), right.tolist(), lag.tolist(), strict=True):
        if b - a + q >= REPEATS * q:
            # Compared word by word; the same stretch may have been seeded more than once.
            out += lag_runs(words[a : b + q], q, a)
    return out


def find_runs(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs of several texts, sorted by start and period.

    ``words`` are 64-bit hashes, text after text, ``counts`` the words of each. Starts count from the
    first word of the first text.
    """
    # A value of its own after each text: no stretch goes on past it.
    place = np.arange(len(words)) + np.repeat(np.arange(len(counts)), counts)
    kept = np.zeros(len(words) + len(counts), np.uint64)
    kept[place] = words
    walls = np.cumsum(counts + 1) - 1
    kept[walls] = mix(np.arange(len(counts), dtype=np.uint64) ^ STEP_A)
    origin = np.zeros(len(kept), np.int64)
    origin[place] = np.arange(len(words))
    sizes = counts + 1
    found: list[tuple[int, int, int]] = []

    def add(runs: list[tuple[int, int, int]]) -> None:
        found.extend((int(origin[s]), n, q) for s, n, q in runs)

    for lag in range(1, DIRECT + 1):
        add(lag_runs(kept, lag))
    hashes, gram = kept, 1
    while True:
        # Texts too short for a period of this scale leave.
        least = REPEATS * (gram + 1)
        stay = sizes > least if gram >= DIRECT else np.ones(len(sizes), bool)
        if not stay.any():
            break
        if not stay.all():
            rows = np.repeat(stay, sizes)
            kept, hashes, origin, sizes = kept[rows], hashes[rows], origin[rows], sizes[stay]
        # A gram that leaves its text holds the wall behind it and equals no other.
        ahead = np.concatenate([hashes[gram:], mix(np.arange(min(gram, len(hashes)), dtype=np.uint64) ^ STEP_B)])
        hashes = mix(hashes * STEP_A + mix(ahead ^ STEP_B))
        gram *= 2
        if gram > DIRECT:
            add(scale_runs(kept, hashes, gram))
    if not found:
        return np.zeros((0, 3), np.int64)
    runs = np.array(found, np.int64)
    # A stretch found with a multiple of its period is the same stretch.
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[fresh]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def collapse(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, bounds: np.ndarray, runs: np.ndarray) -> list[bytes]:
    """Each text's words without those a run holds after its first period, joined by one space."""
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    stay = np.cumsum(change)[:-1] == 0
    before = np.append(0, np.cumsum(stay))
    bounds = before[bounds]
    starts, sizes = starts[stay], (stops - starts)[stay]
    ends = np.cumsum(sizes + 1)
    whole = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    place = np.repeat(ends - sizes - 1 - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    whole[place] = ragged(data, starts, sizes)
    cuts = np.append(0, ends)[bounds]
    raw = whole.tobytes()
    return [raw[a : max(a, b - 1)] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def periodic_runs(df: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Columns ``keep``, ``runs`` and ``collapsed``, the text without the repetitions.

    Words are what stands between ASCII white space, told apart by 64-bit hashes. A run is a stretch
    with smallest period q, of at least 6 and 4 * q words, that cannot be made longer; runs are
    sorted by start and period. NULL, empty and blank texts have no runs and an empty ``collapsed``.
    Row-wise, without a shuffle; repeated rows stay repeated. Where ``keep`` has a column of a new one's
    name, the new name is lengthened.
    """
    modest_batches(df.sparkSession)
    narrow = carried(df, keep, quoted(text).cast("string"))
    schema = made_schema(df, keep, runs=F.lit(None).cast(RUN), collapsed=F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, len(keep), 1 << 20):
            data, offsets = text_bytes(batch.column(len(keep)))
            starts, stops, bounds = word_spans(data, offsets)
            runs = find_runs(span_hashes(data, starts, stops), np.diff(bounds))
            short = collapse(data, starts, stops, bounds, runs)
            owner = np.searchsorted(bounds, runs[:, 0], "right") - 1
            fields = [pa.array(runs[:, 0] - bounds[owner]), pa.array(runs[:, 1]), pa.array(runs[:, 2])]
            edges = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
            made = pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            texts = pa.array(short, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made, texts], schema.names)

    return narrow.mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length over period, compared exactly; of equal ones the first."""

    def better(best: Column, run: Column) -> Column:
        beats = best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"])
        return F.when(beats, run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)
