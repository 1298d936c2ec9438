"""Operator 4: document quality by attention-based multiple-instance learning (Ilse et al., 2018).

A document is a bag of passages of PASSAGE bytes. Each is described by what its characters
and neighbouring characters are and by how often words repeat within a few places; a layer
encodes it, gated attention (a tanh and a sigmoid branch) learns from document labels alone
which passages matter, and the weighted passage representation is scored.

The network is fitted on a bounded sample, PER_CLASS labelled ids of either class and
CLASS_BYTES bytes of their texts at most, in one task on an executor; every row is scored on
all its passages. Defined cases: null and empty texts are one blank passage; a null id counts
as fold 0; several labels of an id count as the largest; without labels of both classes every
score is the share of label 1 (0.5 without any); the passages of a text of any length are
encoded some at a time; an empty table gives no row; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, fold_of, remote, texts_of
from .ngrams import BLOCK, blocks, fitted, joined, labelled, longer

PASSAGE = 256
PER_CLASS = 2000
CLASS_BYTES = 4 << 20
HIDDEN, GATE = 16, 8
FOLDS, HELD = 3, 1
LAGS = 4

_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\v\f", "\n", ".", ",;:", "!?", "#*$%&", "|<>", "'\"()-"]
CLASSES = len(_GROUPS) + 2
_CLASS = np.full(256, CLASSES - 1, np.uint8)
_CLASS[128:] = CLASSES - 2
for _k, _group in enumerate(_GROUPS):
    for _c in _group:
        _CLASS[ord(_c)] = _k
INPUTS = CLASSES + CLASSES * CLASSES + LAGS + 2


def passages(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(passages, INPUTS) features, and the first passage of each text."""
    data, starts = joined(raw, 1)
    sizes = np.diff(starts)
    cuts = -(-sizes // PASSAGE)
    first = np.cumsum(cuts) - cuts
    doc = np.repeat(np.arange(len(raw)), sizes)
    of = first[doc] + (np.arange(len(data)) - starts[doc]) // PASSAGE
    n = int(cuts.sum())
    kind = _CLASS[data].astype(np.int64)
    size = np.bincount(of, minlength=n).astype(np.float64)
    ones = np.bincount(of * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES) / size[:, None]
    pairs = np.bincount(of[:-1] * CLASSES**2 + kind[:-1] * CLASSES + kind[1:], minlength=n * CLASSES**2).reshape(n, CLASSES**2) / size[:, None]
    # words as sums of byte weights by place; equal words have equal sums
    word = np.flatnonzero((data > 32) & (np.concatenate([[32], data[:-1]]) <= 32))
    same = np.zeros((n, LAGS))
    words = np.zeros(n)
    if len(word):
        number = np.cumsum(np.bincount(word, minlength=len(data))) - 1
        place = np.arange(len(data)) - word[np.maximum(number, 0)]
        value = (data.astype(np.uint64) + np.uint64(7)) * (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))
        value[data <= 32] = 0
        value ^= value >> np.uint64(29)
        hashed = np.add.reduceat(value, word)
        home, owner = of[word], doc[word]
        words = np.bincount(home, minlength=n).astype(np.float64)
        for lag in range(1, LAGS + 1):
            hit = (hashed[lag:] == hashed[:-lag]) & (owner[lag:] == owner[:-lag])
            same[:, lag - 1] = np.bincount(home[lag:][hit], minlength=n) / np.maximum(words, 1)
    return np.hstack([ones, pairs, same, np.log1p(size)[:, None] / 6, (words / size)[:, None]]).astype(np.float32), first


def encode_texts(texts: list[str]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def forward(x: np.ndarray, first: np.ndarray, net: dict) -> dict:
    sizes = np.diff(np.append(first, len(x)))
    of = np.repeat(np.arange(len(first)), sizes)
    h = np.tanh((x - net["mean"]) / net["scale"] @ net["V"] + net["v"])
    u, g = np.tanh(h @ net["U"]), 1 / (1 + np.exp(-(h @ net["G"])))
    raw = (u * g) @ net["w"]
    top = np.maximum.reduceat(raw, first)
    e = np.exp(raw - top[of])
    a = e / np.add.reduceat(e, first)[of]
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    y = 1 / (1 + np.exp(-np.clip(z @ net["c"] + net["b"], -50, 50)))
    return {"of": of, "h": h, "u": u, "g": g, "raw": raw, "top": top, "a": a, "z": z, "y": y}


def fit(texts: list[str], labels, epochs: int = 40, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> dict:
    labels = np.asarray(labels, np.int64)
    if not len(labels) or labels.min() == labels.max():
        return {"constant": float(labels.mean()) if len(labels) else 0.5}
    rng = np.random.default_rng(seed)
    parts, ends = [], [0]
    raw = encode_texts(texts)
    for a, b in blocks(raw):
        x, first = passages(raw[a:b])
        parts.append(x)
        ends += (ends[-1] + np.append(first[1:], len(x))).tolist()
    x = np.vstack(parts)
    ends = np.array(ends)
    net = {
        "mean": x.mean(0), "scale": x.std(0) + 1e-3,
        "V": rng.normal(0, INPUTS**-0.5, (INPUTS, HIDDEN)), "v": np.zeros(HIDDEN),
        "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "G": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)),
        "w": rng.normal(0, GATE**-0.5, GATE), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "b": np.zeros(1),
    }
    learned = ["V", "v", "U", "G", "w", "c", "b"]
    m1 = {k: np.zeros_like(net[k]) for k in learned}
    m2 = {k: np.zeros_like(net[k]) for k in learned}
    # the rarer class weighs as much as the other
    weight = np.where(labels == 1, 0.5 / (labels == 1).mean(), 0.5 / (labels == 0).mean())
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            rows = np.concatenate([np.arange(ends[d], ends[d + 1]) for d in docs])
            first = np.cumsum([0, *(ends[d + 1] - ends[d] for d in docs[:-1])])
            s = forward(x[rows], first, net)
            of, h, u, g, a = s["of"], s["h"], s["u"], s["g"], s["a"]
            dy = (s["y"] - labels[docs]) * weight[docs] / len(docs)
            grad = {"c": s["z"].T @ dy, "b": dy.sum(keepdims=True)}
            dz = dy[:, None] * net["c"]
            da = (dz[of] * h).sum(1)
            draw = a * (da - np.add.reduceat(a * da, first)[of])
            grad["w"] = (u * g).T @ draw
            du, dg = draw[:, None] * net["w"] * g * (1 - u**2), draw[:, None] * net["w"] * u * g * (1 - g)
            grad["U"], grad["G"] = h.T @ du, h.T @ dg
            dh = (a[:, None] * dz[of] + du @ net["U"].T + dg @ net["G"].T) * (1 - h**2)
            grad["V"], grad["v"] = ((x[rows] - net["mean"]) / net["scale"]).T @ dh, dh.sum(0)
            step += 1
            for k in learned:
                d = grad[k] + decay * net[k]
                m1[k] += 0.1 * (d - m1[k])
                m2[k] += 0.001 * (d**2 - m2[k])
                net[k] = net[k] - rate * (1 - epoch / epochs) * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return net


def score_texts(texts: list[str], net: dict) -> np.ndarray:
    if "constant" in net:
        return np.full(len(texts), net["constant"])
    raw, out = encode_texts(texts), np.zeros(len(texts))
    for a, b in blocks(raw):
        if len(raw[a]) > BLOCK:
            out[a] = score_long(raw[a], net)
            continue
        x, first = passages(raw[a:b])
        out[a:b] = forward(x, first, net)["y"]
    return out


def score_long(raw: bytes, net: dict) -> float:
    """The score of one text, a block of passages at a time: the weighted sums of the blocks are
    brought to one scale, as their attention is."""
    top, weight, z = -np.inf, 0.0, 0.0
    for at in range(0, len(raw), BLOCK):
        x, first = passages([raw[at : at + BLOCK]])
        s = forward(x, first, net)
        peak = s["top"][0]
        own = np.exp(s["raw"] - peak).sum()
        high = max(top, peak)
        z = z * np.exp(top - high) + s["z"][0] * own * np.exp(peak - high)
        weight = weight * np.exp(top - high) + own * np.exp(peak - high)
        top = high
    return float(1 / (1 + np.exp(-np.clip(z / weight @ net["c"] + net["b"][0], -50, 50))))


def score_batches(batches, net):
    known = net.value
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score_texts(texts_of(batch.column("text")), known))], [*batch.schema.names, "score"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> dict:
    """Learns from labels outside the held-out fold."""
    rows = labelled(docs, labels, "quality", fold_of("doc_id", FOLDS) != HELD, per_class, class_bytes)
    return fit([], []) if rows is None else fitted(rows, __name__, "_label")


def score(docs: DataFrame, net: dict) -> DataFrame:
    """``docs`` (doc_id, text, ..) with ``score``, the chance of label 1. One pass, no shuffle."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(net)  # a few thousand numbers
    return docs.mapInArrow(remote(__name__, "score_batches", net=shared), longer(docs.schema, ("score", T.DoubleType())))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", (fold_of("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
