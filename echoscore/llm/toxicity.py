"""Toxicity scores from a factorization machine over hashed terms.

score = sigmoid(bias + sum of term weights + sum over term pairs of <v_i, v_j>): the pair part, computed from sums in time
linear in the terms, lets an insult count more beside a group than alone. Terms are runs of letters and digits (A-Z
folded) and the first 4, 5 and 6 bytes of longer ones, which stand for inflected forms, hashed into 2^30 slots; a text has a
slot or not, so length does not dilute a term.

``fit`` takes a bounded sample: at most ``max_rows`` labelled rows, half of them toxic if there are as many, chosen by a hash
of the id. That makes toxic rows more common in the sample than among the labels if there are more clean ones than fit, so the
scores' log odds are moved back by the share of each class that was taken, counted over all labels: ``THRESHOLD`` means the
same for tables of any size. Only slots that the labels tell apart beyond chance over
all slots (chi-square of ``min_chi`` and more, ``min_rows`` rows and more) get weights, so that wrong labels aren't learned by heart. A fifth of the sample is held
out of the fit and scales the scores (Platt). Scoring is one pass without a shuffle; the model has a fixed size.

NULL and empty texts have no terms and get the bias. Rows without an id or label are not learned from; ids
labelled twice count as toxic if any label says so. Without labelled rows of both kinds every score is 0.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from echoscore.llm.words import PUNCTUATION, word_and_stem_hashes
from echoscore.sources.stage import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEMS = (4, 5, 6)
MAX_ROWS = 8000
THRESHOLD = 0.7


class Model(NamedTuple):
    """``slots`` in ascending order; ``weights`` and ``factors`` belong to them."""

    bias: float
    slots: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    scale: float
    shift: float


def _slots(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all terms, and the text each is in."""
    hashes, stems, first = word_and_stem_hashes(texts, PUNCTUATION, STEMS)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    slots = np.concatenate([hashes, *(h for _, h in stems)]) >> np.uint64(34)
    return slots.astype(np.int32), np.concatenate([text, *(text[at] for at, _ in stems)])


def term_slots(text: Column) -> Column:
    """The distinct slots of a text."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for i in range(len(texts)):
            rows.append(np.unique(_slots(texts.slice(i, 1))[0]))
        return pa.array(rows, pa.list_(pa.int32()))

    return run(text)


def sample(labelled: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """At most ``max_rows`` of (id, label) rows, the ids that hash lowest in each class. Narrow rows only."""
    one = labelled.where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    order = F.xxhash64(F.lit("toxicity"), "id"), F.col("id")
    halves = [one.where(c).orderBy(*order).limit(max_rows // 2) for c in (F.col("label") > 0, F.col("label") <= 0)]
    return halves[0].unionByName(halves[1])


def prior_shift(labelled: DataFrame, max_rows: int = MAX_ROWS) -> float:
    """Log odds of a toxic row among all labelled rows, less those in the ``sample``."""
    one = labelled.where("id is not null and label is not null").groupBy("id").agg(F.max("label").alias("label"))
    toxic = (F.col("label") > 0).cast("long")
    found = one.agg(F.sum(toxic), F.sum(1 - toxic)).first()
    shares = [n / min(n, max_rows // 2) if n else 1.0 for n in found]
    return float(np.log(shares[0] / shares[1]))


def _raw(x: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    sums = x @ v
    return bias + x @ w + 0.5 * (sums**2 - x @ (v**2)).sum(1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def train(rows: list[np.ndarray], labels: np.ndarray, held: np.ndarray, best: np.ndarray, rank: int = 4, steps: int = 300, decay: float = 1e-3, prior: float = 0.0) -> Model:
    """Fit on rows of slots, all among ``best`` (ascending); ``held`` marks those that only scale the scores. ``prior`` is added
    to the scaled log odds."""
    y = (np.asarray(labels) > 0).astype(np.float64)
    if not y.any() or y.all():
        return Model(-40.0, np.zeros(0, np.int32), np.zeros(0), np.zeros((0, rank)), 1.0, 0.0)
    held = np.asarray(held, bool)
    fit = ~held if _both(y[~held]) else np.ones(len(y), bool)
    n, n1 = fit.sum(), y[fit].sum()
    x = np.zeros((len(y), len(best)), np.float32)
    for r, own in enumerate(rows):
        x[r, np.searchsorted(best, own)] = 1
    xf, yf = x[fit], y[fit].astype(np.float32)
    # Both classes weigh as they do in the sample, which ``prior`` makes up for; factors start small so that pairs begin without effect.
    bias, w, v = float(np.log(n1 / (n - n1))), np.zeros(len(best), np.float32), np.random.default_rng(7).normal(0, 0.05, (len(best), rank)).astype(np.float32)
    moments = [np.zeros(1), np.zeros(1), np.zeros_like(w), np.zeros_like(w), np.zeros_like(v), np.zeros_like(v)]
    for step in range(1, steps + 1):
        sums = xf @ v
        z = bias + xf @ w + 0.5 * (sums**2 - xf @ (v**2)).sum(1)
        g = (_sigmoid(z) - yf) / np.float32(len(yf))
        grads = [np.array([g.sum()]), xf.T @ g + decay / 10 * w, xf.T @ (g[:, None] * sums) - (xf.T @ g)[:, None] * v + decay * v]
        moved = []
        for k, gradient in enumerate(grads):
            a, b = moments[2 * k], moments[2 * k + 1]
            a += 0.1 * (gradient - a)
            b += 0.01 * (gradient**2 - b)
            moved.append(0.05 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8))
        bias, w, v = bias - float(moved[0][0]), w - moved[1], v - moved[2]
    aside = ~fit if (~fit).any() else fit
    z, t = _raw(x[aside], bias, w, v), y[aside]
    # Platt's targets keep the fit finite when the classes are separated.
    t = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
    scale, shift = 1.0, 0.0
    for _ in range(400):
        g = _sigmoid(scale * z + shift) - t
        scale, shift = scale - 0.02 * (g * z).mean(), shift - 0.2 * g.mean()
    return Model(float(bias), best, w, v, float(max(scale, 0.05)), float(shift) + prior)


def _both(y: np.ndarray) -> bool:
    return bool(len(y)) and 0 < y.sum() < len(y)


def _chosen_terms(rows: DataFrame, terms: int, min_chi: float, min_rows: int) -> np.ndarray:
    """The slots that tell the labels of ``rows`` (label, slots) apart best, in ascending order."""
    y = (F.col("label") > 0).cast("double")
    n, n1 = rows.agg(F.count("*"), F.sum(y)).first()
    seen, toxic, share = F.col("seen"), F.col("toxic"), float(n1 or 0) / max(1, n)
    if not 0 < share < 1:
        return np.zeros(0, np.int32)
    counts = rows.select(y.alias("y"), F.explode("slots").alias("slot")).groupBy("slot").agg(F.count("*").alias("seen"), F.sum("y").alias("toxic"))
    chi = (toxic - seen * share) ** 2 / (seen * share * (1 - share) * (1 - seen / n))
    told = counts.where((seen >= min_rows) & (seen < n)).withColumn("chi", chi).where(F.col("chi") > min_chi)
    best = told.orderBy(F.desc("chi"), "slot").limit(terms).select("slot").collect()
    return np.sort(np.array([r["slot"] for r in best], np.int32))


def fit(docs: DataFrame, labelled: DataFrame, max_rows: int = MAX_ROWS, terms: int = 1024, min_chi: float = 24.0, min_rows: int = 5) -> Model:
    """``docs`` (id, text) and ``labelled`` (id, label); at most ``max_rows`` lists of at most ``terms`` slots reach the driver."""
    chosen = sample(labelled, max_rows)
    texts = docs.where("id is not null and text is not null").join(chosen, "id").groupBy(F.xxhash64("text").alias("text_hash"), "text").agg(F.min("id").alias("id"), F.max("label").alias("label"))
    # a fifth is held out by id, so equal data give equal models
    rows = staged(texts.select("id", "label", (F.col("id") % 5 == 0).alias("held"), term_slots(F.col("text")).alias("slots")), "toxicity")
    best = _chosen_terms(rows.where("not held"), terms, min_chi, min_rows)
    if not len(best):
        best = _chosen_terms(rows, terms, min_chi, min_rows)
    known = F.array_intersect("slots", F.array(*[F.lit(int(s)) for s in best]).cast("array<int>"))
    found = rows.select("id", "label", "held", known.alias("slots")).orderBy("id").collect()
    return train([np.array(r["slots"], np.int32) for r in found], np.array([r["label"] for r in found], float), np.array([r["held"] for r in found], bool), best, prior=prior_shift(labelled, max_rows))


def scores(texts: pa.Array, model: Model) -> np.ndarray:
    slots, text = _slots(texts)
    known = np.zeros(1 << 16, bool)
    known[model.slots & 0xFFFF] = True
    near = known[slots & 0xFFFF]
    slots, text = slots[near], text[near]
    exact = np.isin(slots, model.slots)
    pairs = np.unique(text[exact] * max(1, len(model.slots)) + np.searchsorted(model.slots, slots[exact]))
    text, place = np.divmod(pairs, max(1, len(model.slots)))
    z = model.bias + np.bincount(text, model.weights[place], len(texts))
    for k in range(model.factors.shape[1]):
        f = model.factors[place, k]
        z += 0.5 * (np.bincount(text, f, len(texts)) ** 2 - np.bincount(text, f * f, len(texts)))
    return _sigmoid(model.scale * z + model.shift)


def score(spark: SparkSession, model: Model, text: str = "text") -> Column:
    """Column of scores between 0 and 1."""
    shared = spark.sparkContext.broadcast(tuple(model))  # a plain value needs no package to be read

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = Model(*shared.value)
        for texts in batches:
            yield pa.array(np.concatenate([np.zeros(0), *(scores(texts.slice(i, 512), held) for i in range(0, len(texts), 512))]))

    return run(F.col(f"`{text}`"))
