"""Document quality from a regularised quadratic discriminant over transformed statistics of the text.

Each text becomes ``len(NAMES)`` statistics: logarithms of counts and lengths, arc sines of the roots of shares, so that their
spread hardly depends on their size. Each class (label 0 or 1) is a Gaussian over them. Its covariance is shrunk towards the diagonal of
the pooled one by the intensity that gives one half of the class's rows the highest likelihood under the other half's
moments, both ways. The score is a sigmoid of the scaled difference of the two log densities, each
from the Mahalanobis distance through the Cholesky factor that the model holds; the scaling (Platt) is
fitted on a histogram of the differences that each half gets from the other half's model.

Nothing is sampled: all labelled rows count, as sums of moments and a histogram of fixed size, which tasks add up before they shuffle. Statistics are
staged (some 200 bytes a row) and read three times. Scoring is one pass without a shuffle.

NULL and empty texts have no words and are scored like any other text. Rows are neither merged nor lost, other columns of
the input are ignored. Rows without an id or label are not learned from; ids labelled twice count as good if every label says so.
Rows that share an id all get its label. Without two rows of both kinds every score is the share of label 1
(one of each added). A very long text costs its length; an empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from echoscore.llm import words
from echoscore.llm.quality import STOP_WORDS
from echoscore.sources.stage import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

THRESHOLD = 0.3
INTENSITIES = (0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 0.6, 1.0)
#: Differences of log densities beyond this count as this.
FAR, BINS = 60.0, 480

_LINES = np.zeros(256, bool)
_LINES[0x0A] = True


def _mask(characters: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(characters)] = True
    return found


_UPPER, _DIGIT = _mask(bytes(range(0x41, 0x5B))), _mask(b"0123456789")
_LETTER = _mask(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
#: Bytes whose share of all bytes is a statistic each.
SHARES = {
    "upper": _UPPER, "digits": _DIGIT, "marks": _mask(b".,;:?'\"()-"), "exclamations": _mask(b"!"), "bars": _mask(b"|"),
    "symbols": _mask(b"#*$%&<>@^~_=+\\/{}[]"), "lines": _LINES, "wide": _mask(bytes(range(0x80, 0x100))),
}
NAMES = (
    "n_words", "word_length", "length_spread", *SHARES, "stop_words", "distinct", "runs", "repeated_lines", "capitalised", "ends_odd",
)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.arcsin(np.sqrt(np.clip(part / np.maximum(whole, 1), 0, 1)))


def _distinct(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of different hashes of each text."""
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    keys = words.combine(hashes, text.astype(np.uint64))
    _, at = np.unique(keys, return_index=True)
    return np.bincount(text[at], minlength=len(n))


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of NAMES per text."""
    data, bounds = words.text_bytes(texts)
    hashes, first = words.word_hashes(texts)
    starts, ends, _ = words.spans(data, bounds, words.BLANKS)
    n, size = np.diff(first), np.diff(bounds)
    text = np.repeat(np.arange(len(n)), n)

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(text, values, len(n))

    length = (ends - starts).astype(float)
    mean = per_text(length) / np.maximum(n, 1)
    spread = np.sqrt(per_text((length - mean[text]) ** 2) / np.maximum(n, 1))
    columns = [np.log1p(n), np.log1p(mean), np.log1p(spread)]
    for mask in SHARES.values():
        total = np.concatenate([[0], np.cumsum(mask[data])])
        columns.append(_share(total[bounds[1:]] - total[bounds[:-1]], size))
    stop = np.sort(words.word_hashes(pa.array([" ".join(STOP_WORDS)]))[0])
    known = stop[np.minimum(np.searchsorted(stop, hashes), len(stop) - 1)] == hashes
    columns.append(_share(per_text(known), n))
    columns.append(_share(_distinct(hashes, first), n))
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    columns.append(_share(per_text(again), n))
    lines, line_first = words.word_hashes(texts, _LINES)
    count = np.diff(line_first)
    columns.append(_share(count - _distinct(lines, line_first), count))
    columns.append(_share(per_text(_UPPER[data[starts]]), n))
    last = data[ends - 1]
    columns.append(_share(per_text(~(_LETTER | _DIGIT)[last]), n))
    return np.stack(columns, 1)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<double>) for every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.pieces(batches, "text", 1 << 22):
            x = statistics(batch.column("text"))
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(at, pa.array(x.ravel()))], ["id", "x"])

    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(run, "id long, x array<double>")


class Gaussian(NamedTuple):
    """``whiten`` is the inverse of the Cholesky factor of the covariance, ``constant`` half its log determinant."""

    mean: np.ndarray
    whiten: np.ndarray
    constant: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Without the term that all classes share."""
        return -0.5 * (((x - self.mean) @ self.whiten.T) ** 2).sum(1) - self.constant


class Model(NamedTuple):
    """``classes`` are the Gaussians of label 0 and 1; without them every score is ``share``."""

    classes: tuple[Gaussian, Gaussian] | None
    scale: float
    shift: float
    share: float


class Moments(NamedTuple):
    n: float
    total: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:  # type: ignore[override]
        return Moments(self.n + other.n, self.total + other.total, self.products + other.products)

    def covariance(self) -> np.ndarray:
        mean = self.total / self.n
        return self.products / self.n - np.outer(mean, mean)


def gaussian(own: Moments, target: np.ndarray, intensity: float) -> Gaussian:
    """Class moments with the covariance shrunk to ``target``, a diagonal."""
    factor = np.linalg.cholesky((1 - intensity) * own.covariance() + intensity * np.diag(target))
    return Gaussian(own.total / own.n, np.linalg.inv(factor), float(np.log(np.diag(factor)).sum()))


def likelihood(moments: Moments, g: Gaussian) -> float:
    """Sum of the log densities of the rows behind ``moments``."""
    off = moments.total / moments.n - g.mean
    spread = g.whiten @ (moments.covariance() + np.outer(off, off)) @ g.whiten.T
    return -moments.n * (0.5 * float(np.trace(spread)) + g.constant)


def best_intensity(halves: list[Moments], target: np.ndarray) -> float:
    """The shrinkage under which each half is likeliest given the other."""
    if min(h.n for h in halves) < 2:
        return 1.0
    return max(INTENSITIES, key=lambda a: sum(likelihood(halves[1 - k], gaussian(halves[k], target, a)) for k in (0, 1)))


def platt(counts: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the differences from their histogram (2 x BINS) by Newton steps on the log loss."""
    n = counts.sum(1)
    d = np.tile((np.arange(BINS) + 0.5) / BINS * 2 * FAR - FAR, 2)
    weight = counts.ravel() / n.sum()
    # Platt's targets keep the fit finite when the classes are separated
    aim = np.repeat([1 / (n[0] + 2), (n[1] + 1) / (n[1] + 2)], BINS)
    design = np.stack([d, np.ones_like(d)], 1)
    fitted = np.array([0.1, float(np.log((n[1] + 1) / (n[0] + 1)))])

    def loss(b: np.ndarray) -> float:
        z = design @ b
        return float((weight * (np.logaddexp(0, z) - aim * z)).sum() + 1e-6 * b @ b)

    for _ in range(50):
        p = sigmoid(design @ fitted)
        gradient = design.T @ (weight * (p - aim)) + 2e-6 * fitted
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 2e-6 * np.eye(2)
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-6 and loss(fitted - size * step) > loss(fitted):
            size /= 2
        fitted = fitted - size * step
        if abs(size * step).max() < 1e-9:
            break
    return float(max(fitted[0], 1e-3)), float(fitted[1])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def differences(x: np.ndarray, classes: tuple[Gaussian, Gaussian]) -> np.ndarray:
    return np.clip(classes[1].log_density(x) - classes[0].log_density(x), -FAR, FAR)


def _matrix(arrays: pa.Array) -> np.ndarray:
    return np.asarray(arrays.flatten()).reshape(len(arrays), len(NAMES))


def _summed(rows: DataFrame, cells: int, counted) -> np.ndarray:
    """``counted(batch)`` gives ``cells`` numbers; their sum over all rows. Tasks add up their own before Spark does."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for batch in batches:
            total += counted(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "value"])

    out = np.zeros(cells)
    for r in rows.mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out[r["cell"]] = r["value"]
    return out


def fit(statistics_table: DataFrame, labelled: DataFrame) -> Model:
    """``statistics_table`` as ``measured`` gives it, read three times; ``labelled`` (id, label)."""
    d = len(NAMES)
    one = labelled.where("id is not null and label is not null").groupBy("id").agg(F.min("label").alias("label"))
    rows = statistics_table.join(one, "id").select(
        "x", (F.when(F.col("label") > 0, 2).otherwise(0) + F.abs(F.xxhash64("id") % 2)).cast("int").alias("part"))

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x, part = _matrix(batch.column("x")), np.asarray(batch.column("part"))
        out = []
        for k in range(4):
            own = x[part == k]
            out += [[len(own)], own.sum(0), (own.T @ own).ravel()]
        return np.concatenate(out)

    found = _summed(rows, 4 * (1 + d + d * d), moments).reshape(4, -1)
    parts = [Moments(p[0], p[1 : 1 + d], p[1 + d :].reshape(d, d)) for p in found]
    whole = [parts[0] + parts[1], parts[2] + parts[3]]
    share = (whole[1].n + 1) / (whole[0].n + whole[1].n + 2)
    if min(w.n for w in whole) < 2:
        return Model(None, 1.0, 0.0, float(share))
    # a floor keeps constant statistics from making the covariance singular
    target = np.maximum(np.diag((whole[0] + whole[1]).covariance()), 1e-6)
    chosen = [best_intensity(parts[2 * c : 2 * c + 2], target) for c in (0, 1)]
    classes = tuple(gaussian(whole[c], target, chosen[c]) for c in (0, 1))
    # each half is scored by the other half's model, or by the whole one where that half lacks rows
    crossed = [
        tuple(gaussian(parts[2 * c + 1 - h], target, chosen[c]) if parts[2 * c + 1 - h].n > 1 else classes[c] for c in (0, 1)) for h in (0, 1)
    ]
    # plain tuples need no package to be read
    plain = [[tuple(g) for g in pair] for pair in crossed]

    def histogram(batch: pa.RecordBatch) -> np.ndarray:
        x, part = _matrix(batch.column("x")), np.asarray(batch.column("part"))
        out = np.zeros((2, BINS))
        for k in range(4):
            models = tuple(Gaussian(*g) for g in plain[k % 2])
            place = (differences(x[part == k], models) + FAR) / (2 * FAR) * BINS
            out[k // 2] += np.bincount(np.minimum(place.astype(int), BINS - 1), minlength=BINS)
        return out.ravel()

    scale, shift = platt(_summed(rows, 2 * BINS, histogram).reshape(2, BINS))
    return Model(classes, scale, shift, float(share))


def scores(x: np.ndarray, model: Model) -> np.ndarray:
    if model.classes is None:
        return np.full(len(x), model.share)
    return sigmoid(model.scale * differences(x, model.classes) + model.shift)


def score(spark: SparkSession, model: Model, x: str = "x") -> Column:
    """Column of scores between 0 and 1 from the statistics."""
    plain = (model.classes and [tuple(g) for g in model.classes], *model[1:])
    shared = spark.sparkContext.broadcast(plain)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classes, scale, shift, share = shared.value
        held = Model(classes and tuple(Gaussian(*g) for g in classes), scale, shift, share)
        for arrays in batches:
            yield pa.array(scores(_matrix(arrays), held))

    return run(F.col(x))


def scored(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row of ``docs``, learned from ``labelled`` (id, label)."""
    table = staged(measured(docs, id_col, text_col), "statistics")
    return table.select("id", score(docs.sparkSession, fit(table, labelled)).alias("score"))
