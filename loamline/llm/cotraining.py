"""Quality by co-training: two classifiers on separate views teach each other.

One view is the text itself, the other the page's metadata. Both are fitted on all labelled rows
that are not kept back. In each round both views score every unlabelled document of the corpus,
and each labels those it is sure of for the other one. Fits are Newton steps whose gradient and
Hessian are summed inside tasks. Each view is calibrated on the rows kept back, the two are
combined, and every document is scored in a single pass without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamline.llm.common import modest_batches, quoted
from loamline.llm.spans import mix, small_batches, span_hashes, text_bytes
from loamline.session import cut_lineage

ROUNDS = 4
# How sure a view must be of a document to label it for the other one.
SURE = 0.95
# Every so manieth labelled row is kept back; what a row's category tells comes from other folds.
HELD_BACK = 4
FOLDS = 4
# Hash buckets of each category column. Only those that occur take memory.
BUCKETS = 1 << 20
# Rows a category counts for beforehand, in the labels' proportion.
PRIOR = 4.0
RIDGE = 1e-2
STEPS = 30
# The widest step of a weight, and the step below which a fit has ended.
WIDEST = 4.0
CLOSE = 1e-3
# Margins of rows kept back are told apart in these steps.
GRID = 1 / 16
# Rows of partial sums that reach the driver, at most.
PARTIALS = 32
# Documents at least this likely to be of good quality are kept.
ACCEPT = 0.5
# Bytes of text whose features are computed at a time.
SLICE = 1 << 20

CLASSES = ("lower", "upper", "digit", "space", "newline", "mark", "other")


def _class_table() -> np.ndarray:
    out = np.full(256, 6, np.int64)
    for k, chars in enumerate((range(97, 123), range(65, 91), range(48, 58), (32, 9, 13), (10,))):
        out[list(chars)] = k
    out[[c for c in range(33, 127) if out[c] == 6]] = 5
    return out


CLASS_OF = _class_table()


def text_features(column: pa.Array) -> np.ndarray:
    """A row of numbers for each text: what its characters and words are like.

    Shares of character classes and of single marks, how often classes follow each other, word
    lengths, and how often a word repeats the one before it. Empty texts give zeros.
    """
    data, offsets = text_bytes(column)
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(n), sizes)
    kind = CLASS_OF[data]
    k = len(CLASSES)
    shares = np.bincount(doc * k + kind, minlength=n * k).reshape(n, k)
    inside = doc[1:] == doc[:-1]
    pairs = np.bincount(
        (doc[1:] * k * k + kind[:-1] * k + kind[1:])[inside], minlength=n * k * k
    ).reshape(n, k * k)
    punct = np.where(kind == 5, data - 33, 94)
    marks = np.bincount(doc * 95 + punct, minlength=n * 95).reshape(n, 95)[:, :94]
    blank = (kind == 3) | (kind == 4)
    begins = np.flatnonzero(~blank & np.append(True, blank[:-1] | ~inside)) if len(data) else np.zeros(0, np.int64)
    word_of = doc[begins]
    words = np.bincount(word_of, minlength=n)
    letters = np.bincount(doc[~blank], minlength=n)
    ends = np.append(begins[1:], len(data))
    head = data[begins].astype(np.uint64) << np.uint64(8)
    head |= data[np.minimum(begins + 1, max(len(data) - 1, 0))].astype(np.uint64) if len(data) else head
    same = (word_of[1:] == word_of[:-1]) & (head[1:] == head[:-1]) & (np.diff(ends) == np.diff(begins))
    repeats = np.bincount(word_of[1:][same], minlength=n)
    per = np.maximum(sizes, 1)[:, None]
    some = np.maximum(words, 1)
    return np.hstack(
        [shares / per, pairs / per, marks / per, (letters / some / 10)[:, None], (repeats / some)[:, None]]
    )


def metadata_features(categories: list[pa.Array], sizes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The declared size on a log scale, and a bucket for each category (NULL is as empty text).

    Buckets come from a hash of the whole text and differ between columns.
    """
    n = len(sizes)
    at = np.zeros((n, len(categories)), np.int64)
    for salt, column in enumerate(categories):
        data, offsets = text_bytes(column.cast(pa.string()))
        keys = span_hashes(data, offsets[:-1], offsets[1:])
        at[:, salt] = (mix(keys + np.uint64(salt)) % np.uint64(BUCKETS)).astype(np.int64) + salt * BUCKETS
    known = pc.is_valid(sizes).to_numpy(zero_copy_only=False).astype(float)
    size = np.log1p(np.maximum(pc.fill_null(sizes.cast(pa.float64()), 0).to_numpy(zero_copy_only=False), 0)) / 10
    return np.column_stack([size, size**2, known]), at


@dataclass
class Logistic:
    """Logistic regression on standardised features; the last weight is the constant."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, count: np.ndarray, steps: int = 25) -> Logistic:
        """From points that stand for ``count`` rows each; both classes weigh the same."""
        mean = np.average(x, axis=0, weights=count)
        spread = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=count))
        spread[spread < 1e-9] = 1
        z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
        case = count * np.where(y > 0, 0.5 / count[y > 0].sum(), 0.5 / count[y <= 0].sum())
        w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = chance(z @ w)
            step = newton_step(w, z.T @ (case * (p - y)), (z * (case * bend(p))[:, None]).T @ z)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, spread, w)

    def standard(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.hstack([z, np.ones((len(x), 1))])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        return chance(self.margin(x))


def chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def bend(p: np.ndarray) -> np.ndarray:
    return np.maximum(p * (1 - p), 1e-6)


def newton_step(w: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> np.ndarray:
    penalty = np.full(len(w), RIDGE)
    penalty[-1] = 1e-9
    return np.linalg.solve(curve + np.diag(penalty), slope + penalty * w)


@dataclass
class Evidence:
    """What each bucket of a category says, as log odds against the labels' proportion.

    ``odds`` has a column for each fold, learned from the other folds, and a last one from all.
    """

    buckets: np.ndarray
    odds: np.ndarray

    @classmethod
    def of(cls, bucket: np.ndarray, fold: np.ndarray, label: np.ndarray, n: np.ndarray, share: float) -> Evidence:
        buckets, at = np.unique(bucket, return_inverse=True)
        counts = np.zeros((2, len(buckets), FOLDS + 1))
        np.add.at(counts, (label, at, fold), n)
        rest = counts[:, :, :FOLDS].sum(2)[:, :, None] - counts
        bad, good = rest[0] + PRIOR * (1 - share), rest[1] + PRIOR * share
        return cls(buckets, np.log(good / bad) - np.log(share / (1 - share)))

    def features(self, at: np.ndarray, fold: np.ndarray | int = FOLDS) -> np.ndarray:
        """A number for each row and category; 0 for one never seen."""
        if not len(self.buckets):
            return np.zeros(at.shape)
        place = np.minimum(np.searchsorted(self.buckets, at), len(self.buckets) - 1)
        fold = np.broadcast_to(np.asarray(fold).reshape(-1, 1), at.shape)
        return np.where(self.buckets[place] == at, self.odds[place, fold], 0.0)


@dataclass
class Views:
    """A model of the text, one of the metadata, and what its categories say."""

    text: Logistic
    metadata: Logistic
    evidence: Evidence

    def inputs(self, text: np.ndarray, numbers: np.ndarray, at: np.ndarray, fold: np.ndarray | int = FOLDS) -> tuple:
        return text, np.hstack([self.evidence.features(at, fold), numbers])

    def close_to(self, other: Views) -> bool:
        mine, its = self.evidence, other.evidence
        return (
            np.array_equal(mine.buckets, its.buckets)
            and np.abs(mine.odds - its.odds).max(initial=0) < CLOSE
            and np.abs(self.text.weights - other.text.weights).max() < CLOSE
            and np.abs(self.metadata.weights - other.metadata.weights).max() < CLOSE
        )

    def margins(self, text: np.ndarray, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        x, m = self.inputs(text, numbers, at)
        return np.column_stack([self.text.margin(x), self.metadata.margin(m)])


@dataclass
class Model:
    """Two fitted views and the calibrated combination of their margins."""

    views: Views
    combine: Logistic

    def probability(self, text: np.ndarray, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.combine.probability(self.views.margins(text, numbers, at))


@dataclass
class Teachers:
    """The views of a round and the calibration of each; what they are sure of is labelled."""

    views: Views
    sure: tuple[Logistic, Logistic]

    def labels(self, text: np.ndarray, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        """By row and view: 1 or 0 as that view says, NaN where it is not sure."""
        margins = self.views.margins(text, numbers, at)
        p = np.column_stack([s.probability(margins[:, [v]]) for v, s in enumerate(self.sure)])
        return np.where(p >= SURE, 1.0, np.where(p <= 1 - SURE, 0.0, np.nan))


@dataclass
class Rows:
    """A batch of the table of features."""

    y: np.ndarray
    held: np.ndarray
    fold: np.ndarray
    content: tuple[np.ndarray, np.ndarray, np.ndarray]

    @classmethod
    def read(cls, batch: pa.RecordBatch) -> Rows:
        y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
        part = batch.column("part").to_numpy()
        text, numbers, at = (
            np.frombuffer(text_bytes(batch.column(c))[0], kind).reshape(len(y), -1)
            for c, kind in (("text", "<f4"), ("numbers", "<f4"), ("at", "<i8"))
        )
        content = (text.astype(float), numbers.astype(float), at)
        return cls(y, ~np.isnan(y) & (part % HELD_BACK == 0), part // HELD_BACK, content)

    def targets(self, teachers: Teachers | None) -> np.ndarray:
        """By row and view: what the view is fitted to; what one view says goes to the other."""
        out = np.where(self.held, np.nan, self.y)[:, None].repeat(2, 1)
        pool = np.flatnonzero(np.isnan(self.y))
        if teachers is not None and len(pool):
            out[pool] = teachers.labels(*(c[pool] for c in self.content))[:, ::-1]
        return out


def _summed(rows: DataFrame, of: Callable[[Rows], np.ndarray]) -> np.ndarray | None:
    """The sum of ``of`` over all rows: inside tasks first, then in a tree, at last on the driver."""

    def added(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts:
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added(of(Rows.read(b)) for b in batches if b.num_rows)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added(np.frombuffer(x, float) for b in batches for x in b.column(0).to_pylist())

    sums = rows.mapInArrow(first, "s binary")
    tasks = rows.rdd.getNumPartitions()
    while tasks > PARTIALS:
        tasks = math.ceil(math.sqrt(tasks))
        sums = sums.repartition(tasks).mapInArrow(again, "s binary")
    parts = [np.frombuffer(r[0], float) for r in sums.collect()]
    return np.sum(parts, axis=0) if parts else None


def _evidence(rows: DataFrame, teachers: Teachers | None, share: float) -> Evidence:
    """Labels of each bucket and fold, counted over all labelled rows and all the text is sure of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            r = Rows.read(batch)
            target, at = r.targets(teachers)[:, 1], r.content[2]
            some = np.flatnonzero(~np.isnan(target))
            code = ((at[some] * FOLDS + r.fold[some, None]) * 2 + target[some, None].astype(np.int64)).ravel()
            codes, n = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["code", "n"])

    counted = rows.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    code, n = (counted[c].to_numpy(np.int64) for c in ("code", "n"))
    return Evidence.of(code // (2 * FOLDS), code // 2 % FOLDS, code % 2, n, share)


def _fitted(rows: DataFrame, views: Views, teachers: Teachers | None) -> Views:
    """Both views by Newton steps from where they are; both classes weigh the same.

    A step that does not lower the loss is halved. One pass over the rows serves both views.
    """
    models = [views.text, views.metadata]
    best = [m.weights for m in models]
    least, steps, open_ = [math.inf, math.inf], [None, None], [True, True]
    tried = list(best)
    for _ in range(STEPS):
        now, todo = [Logistic(m.mean, m.spread, w) for m, w in zip(models, tried, strict=True)], tuple(open_)

        def of(r: Rows, now: list[Logistic] = now, todo: tuple = todo) -> np.ndarray:
            target, out = r.targets(teachers), []
            inputs = views.inputs(*r.content, r.fold)
            for v, (model, x) in enumerate(zip(now, inputs, strict=True)):
                for label in (0, 1) if todo[v] else ():
                    z = model.standard(x[target[:, v] == label])
                    margin = z @ model.weights
                    p = chance(margin)
                    loss = np.logaddexp(0, -margin if label else margin).sum()
                    out += [[len(z), loss], z.T @ (p - label), ((z * bend(p)[:, None]).T @ z).ravel()]
            return np.concatenate(out)

        total, start = _summed(rows, of), 0
        for v in (0, 1):
            if not todo[v]:
                continue
            k = len(tried[v])
            mean = np.zeros(1 + k + k * k)
            for _label in (0, 1):
                part = total[start : start + 2 + k + k * k]
                start += len(part)
                mean += 0.5 / max(1.0, part[0]) * part[1:]
            loss = mean[0] + RIDGE / 2 * (tried[v][:-1] ** 2).sum()
            if loss <= least[v]:
                best[v], least[v] = tried[v], loss
                steps[v] = newton_step(best[v], mean[1 : 1 + k], mean[1 + k :].reshape(k, k))
                steps[v] *= min(1.0, WIDEST / max(np.abs(steps[v]).max(), 1e-9))
            else:
                steps[v] = steps[v] / 2
            tried[v] = best[v] - steps[v]
            open_[v] = bool(np.abs(steps[v]).max() >= CLOSE)
        if not any(open_):
            break
    made = [Logistic(m.mean, m.spread, w) for m, w in zip(models, best, strict=True)]
    return Views(*made, views.evidence)


def _held_margins(rows: DataFrame, views: Views) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Margins of the rows kept back on a grid, their labels, and how many rows are there."""
    widest = round(30 / GRID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            r = Rows.read(batch)
            margins = views.margins(*(c[r.held] for c in r.content))
            cell = np.clip(np.rint(margins / GRID), -widest, widest).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell[:, 0]), pa.array(cell[:, 1]), pa.array(r.y[r.held])], ["a", "b", "y"]
            )

    cells = rows.filter("y IS NOT NULL").mapInArrow(run, "a long, b long, y double")
    found = cells.groupBy("a", "b", "y").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["a", "b", "y"])
    return found[["a", "b"]].to_numpy(float) * GRID, found["y"].to_numpy(float), found["n"].to_numpy(float)


def cotrain(rows: DataFrame, rounds: int = ROUNDS) -> Model | None:
    """Fit both views on the table of features, exchanging labels; None if one class is labelled.

    What a view is sure of, among all unlabelled rows, goes to the other one, anew in each round.
    How sure a view is, and the combination, are calibrated on labelled rows that took no part in
    fitting, so that a view which tells little about them teaches nothing.
    """

    def moments(r: Rows) -> np.ndarray:
        known = [((r.y == label) & (r.held == held)).sum() for label in (0, 1) for held in (False, True)]
        x = np.hstack(r.content[:2])
        return np.concatenate([known, [len(x)], x.sum(0), (x * x).sum(0), [r.content[0].shape[1]]])

    total = _summed(rows, moments)
    if total is None or total[:4].min() < 1:
        return None
    share = total[2:4].sum() / total[:4].sum()
    mean, square = total[5:-1].reshape(2, -1) / total[4]
    spread = np.sqrt(np.maximum(square - mean * mean, 0))
    spread[spread < 1e-6] = 1
    width = len(mean) - 3
    evidence = _evidence(rows, None, share)
    kinds = len(rows.first()["at"]) // 8
    views = Views(
        Logistic(mean[:width], spread[:width], np.zeros(width + 1)),
        Logistic(np.append(np.zeros(kinds), mean[width:]), np.append(np.ones(kinds), spread[width:]), np.zeros(kinds + 4)),
        evidence,
    )
    teachers = None
    for round_ in range(rounds + 1):
        before = views
        if round_:
            evidence = _evidence(rows, teachers, share)
        views = _fitted(rows, Views(before.text, before.metadata, evidence), teachers)
        if round_ and views.close_to(before):
            views = before
            break  # later rounds would be as this one
        margins, y, n = _held_margins(rows, views)
        sure = tuple(Logistic.fit(margins[:, [v]], y, n) for v in (0, 1))
        teachers = Teachers(Views(views.text, views.metadata, views.evidence), sure)
    return Model(views, Logistic.fit(margins, y, n))


def _features(batch: pa.RecordBatch, text: int, categories: list[int], size: int) -> tuple:
    return (
        text_features(batch.column(text)),
        *metadata_features([batch.column(c) for c in categories], batch.column(size)),
    )


def train(
    df: DataFrame, labels: DataFrame, doc_id: str, text: str, categories: list[str], size: str, label: str
) -> Model | None:
    """A model from all labelled and all unlabelled rows.

    The features of every document are written once to the shared folder. To the driver come
    sums, counts of category buckets and of cells of a grid, whose number does not follow the rows.
    """
    modest_batches(df.sparkSession)
    wanted = labels.select(quoted(doc_id).cast("string").alias("k"), quoted(label).cast("double").alias("y"))
    wanted = wanted.filter(F.col("y").isNotNull() & F.col("k").isNotNull()).groupBy("k")
    wanted = wanted.agg((F.max("y") > 0).cast("double").alias("y"))
    key = quoted(doc_id).cast("string")
    named = df.select(
        key.alias("k"),
        quoted(text).cast("string").alias("text_"),
        *[quoted(c).cast("string").alias(f"c{i}_") for i, c in enumerate(categories)],
        quoted(size).cast("double").alias("size_"),
        F.pmod(F.xxhash64(key, F.lit(11)), F.lit(HELD_BACK * FOLDS)).alias("part"),
    )
    at = list(range(2, 2 + len(categories)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            made = _features(batch, 1, at, 2 + len(at))
            pack = lambda m, kind: pa.array([r.astype(kind).tobytes() for r in m], pa.binary())
            packed = [pack(m, kind) for m, kind in zip(made, ("<f4", "<f4", "<i8"), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(batch.num_columns - 1), *packed], ["k", "part", "text", "numbers", "at"]
            )

    features = named.mapInArrow(run, "k string, part long, text binary, numbers binary, at binary")
    rows = cut_lineage(features.join(wanted, "k", "left").select("y", "part", "text", "numbers", "at"))
    return cotrain(rows)


def score(
    df: DataFrame, model: Model | None, text: str, categories: list[str], size: str, name: str = "quality_probability"
) -> DataFrame:
    """All rows and columns of ``df`` and the probability of good quality; row-wise, no shuffle.

    Texts go to Python in batches and do not come back, only their probabilities do.
    ``name`` must not be a column of ``df`` yet.

    Without a model (labels of one class only, or none) every document gets NULL: nothing is
    known. NULL or empty texts are scored by what zeros and the metadata say.
    """
    if model is None:
        return df.withColumn(name, F.lit(None).cast("double"))

    @F.arrow_udf("double")
    def probability(content: pa.Array, declared: pa.Array, kinds: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays(
            [content, declared, *kinds.flatten()], ["text", "size", *map(str, range(len(categories)))]
        )
        at = list(range(2, 2 + len(categories)))
        parts = [model.probability(*_features(b, 0, at, 1)) for b in small_batches([batch], 0, SLICE)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    kinds = F.struct(*[quoted(c).cast("string").alias(f"k{i}") for i, c in enumerate(categories)])
    return df.withColumn(name, probability(quoted(text).cast("string"), quoted(size).cast("double"), kinds))


def score_documents(docs: DataFrame, labels: DataFrame, name: str = "quality_probability") -> DataFrame:
    """Train on ``labels`` (doc_id, quality) and score the whole ``documents`` table."""
    metadata = ["source", "lang"]
    model = train(docs, labels, "doc_id", "text", metadata, "n_chars", "quality")
    return score(docs, model, "text", metadata, "n_chars", name)


def accepted(name: str = "quality_probability", least: float = ACCEPT) -> Column:
    """Whether a document is kept; where nothing is known (NULL) it is."""
    return F.coalesce(quoted(name) >= least, F.lit(True))
