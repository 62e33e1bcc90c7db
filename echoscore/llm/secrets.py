"""Secrets in texts: fixed patterns, plus a character convolutional network over every candidate.

Candidates are the pattern matches and all runs of 16 and more key characters. Each is read with its surroundings (24 characters
before, 40 of its own, 16 after): embedded characters, one convolution, the largest response of each filter in the three
regions, a logistic output. Longer candidates are read whole, 40 characters every 8, and the largest output counts. The network is trained in numpy on a bounded sample of labelled findings: candidates of at most
``max_docs`` documents, chosen by a hash of the id, where pattern matches are the positive ones; of each kind up to half the
findings the bound allows. A third of each kind is held out: it calibrates the scores (Platt, moved to the kinds' shares among all
findings of those documents) and gives the threshold, the highest one that still finds ``recall`` of its secrets.

``findings`` gives every text's spans: pattern matches always, and candidates above the threshold that touch no match, as
kind ``model``. Without findings of both kinds in the sample only the patterns count. NULL and empty texts have no
spans; rows are neither merged nor lost; whole texts are read. One pass, no shuffle, a model of fixed size.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from echoscore.sources.stage import staged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The base patterns. Matches that fail the length test are dropped, not shortened.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: No text without a match of this has a span.
ANY = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[A-Za-z0-9+/_=-]{16}"
KINDS = ("assign", "access", "hex", "model")
SPANS = "array<struct<kind: string, start: int, end: int, score: double>>"
MAX_DOCS, MAX_FINDINGS = 20_000, 6_000
BEFORE, OWN, AFTER = 24, 40, 16
SHORTEST, STEP = 16, 8
WIDTH, DEPTH, FILTERS = 5, 8, 24


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def candidates(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and runs that touch none of them."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    others, at = [], 0
    for m in RUN.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if not any(a < m.end() and b > m.start() for a, b in taken[at : at + 4]):
            others.append(("model", *m.span()))
    return base, others


def windows(text: str, start: int, end: int) -> Iterator[bytes]:
    """The characters the network sees, one byte each; 1 stands for all beyond ASCII, 0 for nothing. Each window has the
    candidate's surroundings; the first one begins with it, the last has its end."""
    before, after = _coded(text[max(0, start - BEFORE) : start]).rjust(BEFORE, b"\0"), _coded(text[end : end + AFTER])
    for at in range(start, max(start + 1, end - SHORTEST + 1) if end > start + OWN else start + 1, STEP):
        yield before + _coded(text[at : min(end, at + OWN)]).ljust(OWN, b"\0") + after.ljust(AFTER, b"\0")


def window(text: str, start: int, end: int) -> bytes:
    return next(windows(text, start, end))


def _coded(part: str) -> bytes:
    return part.encode() if part.isascii() else bytes(c if (c := ord(x)) < 128 else 1 for x in part)


class Network(NamedTuple):
    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float
    shift: float
    threshold: float


_STEPS = BEFORE + OWN + AFTER - WIDTH + 1
_REGIONS = ((0, BEFORE), (BEFORE, BEFORE + OWN - WIDTH + 1), (BEFORE + OWN - WIDTH + 1, _STEPS))


def _forward(net: Network, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Logits, pooled responses, their places, and the unrolled windows."""
    x = net.embed[chars]
    rolled = np.concatenate([x[:, k : k + _STEPS] for k in range(WIDTH)], axis=2)
    seen = np.maximum(rolled @ net.kernel + net.bias, 0)
    place = np.stack([a + seen[:, a:b].argmax(1) for a, b in _REGIONS], 1)
    pooled = np.take_along_axis(seen, place.reshape(len(chars), -1, seen.shape[2])[:, :, :], 1)
    return (pooled.reshape(len(chars), -1) @ net.out) + net.out_bias, pooled, place, rolled


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def probabilities(net: Network, windows: list[bytes]) -> np.ndarray:
    out = []
    for i in range(0, len(windows), 256):
        chars = np.frombuffer(b"".join(windows[i : i + 256]), np.uint8).reshape(-1, BEFORE + OWN + AFTER)
        out.append(_sigmoid(net.scale * _forward(net, chars)[0] + net.shift))
    return np.concatenate([np.zeros(0), *out])


def best_scores(net: Network, texts: list[str], spans: list[tuple[int, tuple[str, int, int]]]) -> np.ndarray:
    """The largest probability over the windows of each (place of the text, span). Few windows are held at a time."""
    out = np.zeros(len(spans))
    own, held = [], []
    for k, (i, s) in enumerate(spans):
        for w in windows(texts[i], s[1], s[2]):
            own.append(k)
            held.append(w)
            if len(held) == 4096:
                np.maximum.at(out, own, probabilities(net, held))
                own, held = [], []
    np.maximum.at(out, np.array(own, int), probabilities(net, held))
    return out


def train(windows: list[bytes], labels: np.ndarray, recall: float = 0.98, epochs: int = 12, prior: float = 0.0) -> Network | None:
    """None without findings of both kinds. Every third row of each kind is held out. ``prior`` is added to the scaled log odds."""
    labels = np.asarray(labels, np.float32)
    held = np.zeros(len(labels), bool)
    for kind in (labels > 0, labels <= 0):
        held[np.flatnonzero(kind)[2::3]] = True
    if min(labels[~held].sum(), (1 - labels[~held]).sum(), labels[held].sum(), (1 - labels[held]).sum()) < 1:
        return None
    chars = np.frombuffer(b"".join(windows), np.uint8).reshape(len(windows), -1)
    rng = np.random.default_rng(3)
    f32 = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
    p = [f32(128, DEPTH, s=0.5), f32(WIDTH * DEPTH, FILTERS, s=0.2), np.zeros(FILTERS, np.float32), f32(3 * FILTERS, s=0.1), np.zeros(1, np.float32)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    rows = np.flatnonzero(~held)
    # both kinds weigh the same in the fit
    share = labels[rows].mean()
    weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    for _ in range(epochs):
        rng.shuffle(rows)
        for i in range(0, len(rows), 64):
            own = rows[i : i + 64]
            net = Network(*p[:4], p[4][0], 1.0, 0.0, 0.5)
            z, pooled, place, rolled = _forward(net, chars[own])
            g = ((_sigmoid(z) - labels[own]) * weight[own] / len(own)).astype(np.float32)
            back = (g[:, None] * net.out).reshape(pooled.shape) * (pooled > 0)
            n, k, j = np.nonzero(back)
            grown, at = back[n, k, j], place[n, k, j]
            d_kernel, d_embed, d_bias = np.zeros_like(p[1]), np.zeros_like(p[0]), np.zeros_like(p[2])
            np.add.at(d_kernel.T, j, rolled[n, at] * grown[:, None])
            np.add.at(d_bias, j, grown)
            through = (net.kernel.T[j] * grown[:, None]).reshape(-1, WIDTH, DEPTH)
            np.add.at(d_embed, chars[own][n[:, None], at[:, None] + np.arange(WIDTH)], through)
            grads = [d_embed, d_kernel, d_bias, pooled.reshape(len(own), -1).T @ g, np.array([g.sum()], np.float32)]
            t += 1
            for q, d, a, b in zip(p, grads, m, v):
                a += 0.1 * (d - a)
                b += 0.01 * (d * d - b)
                q -= 4e-3 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-7)
    net = Network(*p[:4], float(p[4][0]), 1.0, 0.0, 0.5)
    z = np.concatenate([_forward(net, chars[held][i : i + 256])[0] for i in range(0, held.sum(), 256)])
    y = labels[held]
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    scale, shift = 1.0, 0.0
    for _ in range(300):
        d = _sigmoid(scale * z + shift) - target
        scale, shift = scale - 0.05 * (d * z).mean(), shift - 0.3 * d.mean()
    net = net._replace(scale=float(max(scale, 0.05)), shift=float(shift) + prior)
    secret = np.sort(_sigmoid(net.scale * z[y > 0] + net.shift))
    return net._replace(threshold=float(secret[int((1 - recall) * len(secret))]))


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, max_findings: int = MAX_FINDINGS) -> Network | None:
    """``docs`` (id, text). At most ``max_findings`` windows of some ``max_docs`` documents reach the driver, at most half of
    them of one kind. Runs jobs when called."""
    total = docs.count()
    share = min(1.0, max_docs / max(1, total))
    order = F.pmod(F.xxhash64(F.lit("secrets"), "id"), F.lit(1_000_003))
    chosen = docs.where(F.col("id").isNotNull() & (order <= int(share * 1_000_003)))
    found = staged(_labelled(chosen), "secrets")
    sizes = {r["label"]: r["count"] for r in found.groupBy("label").count().collect()}
    order = F.xxhash64("window"), F.col("window")
    halves = [found.where(F.col("label") == k).orderBy(*order).limit(max_findings // 2) for k in (0, 1)]
    rows = halves[0].unionByName(halves[1]).orderBy(*order).collect()
    shares = [n / min(n, max_findings // 2) if (n := sizes.get(k, 0)) else 1.0 for k in (0, 1)]
    return train([bytes(r["window"]) for r in rows], np.array([r["label"] for r in rows]), prior=float(np.log(shares[1] / shares[0])))


def _labelled(docs: DataFrame) -> DataFrame:
    """(window, label): distinct windows, the first one of each match and all of the other candidates."""

    def rows(seen: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int32())], ["window", "label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            seen = {}
            for text in texts.filter(pc.match_substring_regex(texts, ANY).fill_null(False)).to_pylist():
                base, others = candidates(text)
                for _, a, b in base:
                    seen[window(text, a, b)] = 1
                for _, a, b in others:
                    for w in windows(text, a, b):
                        seen.setdefault(w, 0)
                        if len(seen) == 65_536:
                            yield rows(seen)
                            seen = {}
            yield rows(seen)

    return docs.select("text").mapInArrow(run, "window binary, label int").groupBy("window").agg(F.max("label").alias("label"))


def text_spans(texts: list[str], net: Network | None) -> list[list[tuple[str, int, int, float]]]:
    """Spans by start, then kind, of each text."""
    order = {k: i for i, k in enumerate(KINDS)}
    found = [candidates(t) for t in texts]
    asked = [(i, s) for i, (base, others) in enumerate(found) for s in base + others] if net else []
    scores = best_scores(net, texts, asked) if net else []
    out = [[] if net else [(*s, 1.0) for s in base] for base, _ in found]
    for (i, s), p in zip(asked, scores):
        if s[0] != "model" or p >= net.threshold:
            out[i].append((*s, float(p)))
    for spans in out:
        spans.sort(key=lambda s: (s[1], order[s[0]], s[2]))
    return out


def _scan(texts: pa.Array, net: Network | None) -> Iterator[tuple[str | None, list]]:
    """(text, spans) of each row; texts without any candidate come as None."""
    near = pc.match_substring_regex(texts, ANY).fill_null(False).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(near)
    held = texts.take(pa.array(rows)).to_pylist()
    found = dict(zip(rows.tolist(), zip(held, text_spans(held, net))))
    for i in range(len(texts)):
        yield found.get(i, (None, []))


def findings(spark: SparkSession, net: Network | None, text: str = "text") -> Column:
    """Column of SPANS: code point offsets, end exclusive, the network's calibrated score."""
    shared = spark.sparkContext.broadcast(net and tuple(net))  # a plain value needs no package to be read

    @F.arrow_udf(SPANS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
        held = shared.value and Network(*shared.value)
        for texts in batches:
            yield pa.array([[dict(zip(("kind", "start", "end", "score"), s)) for s in spans] for _, spans in _scan(texts, held)], pa.list_(kind))

    return run(F.col(f"`{text}`"))


def redacted(spark: SparkSession, net: Network | None, text: str = "text", mark: str = "[SECRET]") -> Column:
    """The text with every span, or chain of overlapping spans, replaced by ``mark``; NULL stays NULL."""
    shared = spark.sparkContext.broadcast(net and tuple(net))  # a plain value needs no package to be read

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = shared.value and Network(*shared.value)
        for texts in batches:
            changed, where = [], np.zeros(len(texts), bool)
            for i, (value, spans) in enumerate(_scan(texts, held)):
                if spans:
                    where[i] = True
                    changed.append(replace(value, spans, mark))
            yield pc.replace_with_mask(texts, pa.array(where), pa.array(changed, texts.type)) if changed else texts

    return run(F.col(f"`{text}`"))


def replace(text: str, spans: list[tuple], mark: str) -> str:
    out, at = [], 0
    for _, a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]
