"""Operator 10: toxicity by a linear classifier over character n-grams, scaled by naive Bayes
log-count ratios (Wang and Manning, 2012), trained on labelled text.

Features are the presence of hashed byte n-grams of the lower-cased text: all those that LEAST
documents of the sample or more have and whose shares among toxic and clean ones differ by
SIGNIFICANT standard errors (or, in small samples, by half of what the clearest one differs
by); the hundreds of thousands that differ by chance would let the model learn documents by
heart. The log ratio of a feature's smoothed shares scales it; logistic regression over the scaled
features gives the score.

The model is fitted on a bounded sample, PER_CLASS labelled ids of either class and
CLASS_BYTES bytes of their texts at most, in one task on an executor; every row is scored
on its whole text. Defined cases: null and empty texts get the score of a text without
features; a null id counts as fold 0; several labels of an id count as the largest; without
labels of both classes every score is the share of toxic labels (0 without any); texts
longer than a block are read in overlapping pieces; an empty table gives no row; extra
columns are not read, and ``drop_toxic`` keeps them whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import all_columns, bound_batches, fold_of, free_names, remote, texts_of
from .ngrams import BLOCK, blocks, fitted, gram_codes, joined, labelled, longer

GRAMS = (4, 5, 6, 7)
BITS = 20
PER_CLASS = 4000
CLASS_BYTES = 6 << 20
#: A feature must be in so many documents of the sample.
LEAST = 4
SIGNIFICANT = 4.0
FOLDS, HELD = 5, 0


def features(texts: list[bytes], alive: np.ndarray | None = None):
    """(first text, end, document, code) of every distinct feature of a block, sorted by document.
    alive: the codes that count."""
    for a, b in blocks(texts):
        if len(texts[a]) > BLOCK:  # alone in its block
            seen = np.zeros(1 << BITS, bool)
            for at in range(0, len(texts[a]), BLOCK):
                data = np.frombuffer(texts[a], np.uint8)[at : at + BLOCK + max(GRAMS) - 1]
                for n in GRAMS:
                    seen[gram_codes(data, n, BITS)] = True
            code = np.flatnonzero(seen if alive is None else seen & alive)
            yield a, b, np.zeros(len(code), np.int64), code
            continue
        data, starts = joined(texts[a:b], 1)
        doc = np.repeat(np.arange(b - a, dtype=np.uint32), np.diff(starts)) << np.uint32(BITS)
        left = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(data))  # bytes to the end, with the gap
        found = []
        for n in GRAMS:
            code = gram_codes(data, n, BITS)
            whole = left[: len(code)] >= n
            if alive is not None:
                whole &= alive[code]
            found.append(doc[: len(code)][whole] | code[whole].astype(np.uint32))
        keys = np.sort(np.concatenate(found))
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
        yield a, b, (keys >> np.uint32(BITS)).astype(np.int64), (keys & np.uint32((1 << BITS) - 1)).astype(np.int64)


#: Every ASCII byte that is no letter reads as a blank, so that a word's edges look alike.
_PLAIN = bytes(b if chr(b).isalpha() or b > 127 else 32 for b in range(256))


def low(texts: list[str]) -> list[bytes]:
    return [b" " + t.lower().encode("utf-8", "surrogatepass").translate(_PLAIN) for t in texts]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def log_ratios(counts: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """log((1 + c1) / |1 + c1|) - log((1 + c0) / |1 + c0|) of the features that count."""
    smooth = 1.0 + counts[:, alive]
    return np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())


def telling(counts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which features count: enough documents have them, and they tell the classes apart."""
    share, mean = counts / size[:, None], counts.sum(0) / size.sum()
    z = np.abs(share[1] - share[0]) / np.sqrt(np.maximum(mean * (1 - mean), 1e-9) * (1 / size).sum())
    z[counts.sum(0) < min(LEAST, size.min())] = 0
    return z >= max(min(SIGNIFICANT, z.max() / 2), 1e-9)


def fit(texts: list[str], labels, epochs: int = 60, batch: int = 64, rate: float = 0.1, decay: float = 1e-5) -> dict:
    """{weights: float32 by code, bias}: AdaGrad in small batches over all features that count."""
    labels = np.asarray(labels, np.int64)
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return {"weights": None, "bias": float(np.log(max(share, 1e-12) / max(1 - share, 1e-12)))}
    low_texts = low(texts)
    counts = np.zeros((2, 1 << BITS))
    for a, _, doc, code in features(low_texts):
        for k in (0, 1):
            counts[k] += np.bincount(code[labels[a + doc] == k], minlength=1 << BITS)
    size = np.array([(labels == 0).sum(), (labels == 1).sum()], float)
    alive = telling(counts, size)
    # a second reading costs a second or two; what features there are of all kinds, some hundreds of MB
    number = (np.cumsum(alive) - 1).astype(np.int32)
    sizes, parts = np.zeros(len(labels), np.int64), []
    for a, b, doc, code in features(low_texts, alive):
        sizes[a:b] = np.bincount(doc, minlength=b - a)
        parts.append(number[code])
    ends, code = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(parts)
    ratio = log_ratios(counts, alive)
    # classes weigh alike in the slope
    weight = np.where(labels == 1, 0.5 / size[1], 0.5 / size[0]) * len(labels)
    w, bias = np.zeros(len(ratio)), 0.0
    g2, b2 = np.full(len(ratio), 1e-8), 1e-8
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            sizes = ends[docs + 1] - ends[docs]
            of = np.repeat(np.arange(len(docs)), sizes)
            own = np.concatenate([code[ends[d] : ends[d + 1]] for d in docs])
            value = ratio[own]
            error = (sigmoid(bias + np.bincount(of, w[own] * value, len(docs))) - labels[docs]) * weight[docs] / len(docs)
            grad = np.bincount(own, error[of] * value, len(ratio)) + decay * w
            g2 += grad**2
            b2 += error.sum() ** 2
            w -= rate * grad / np.sqrt(g2)
            bias -= rate * error.sum() / np.sqrt(b2)
    weights = np.zeros(1 << BITS, np.float32)
    weights[alive] = w * ratio
    return {"weights": weights, "bias": float(bias)}


def score_texts(texts: list[str], model: dict) -> np.ndarray:
    out = np.full(len(texts), model["bias"])
    if model["weights"] is not None:
        for a, b, doc, code in features(low(texts), model["weights"] != 0):
            out[a:b] += np.bincount(doc, model["weights"][code], b - a)
    return sigmoid(out)


def score_batches(batches, model, text: str, name: str):
    known = model.value
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score_texts(texts_of(batch.column(text)), known))], [*batch.schema.names, name])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> dict:
    """Learns from labels outside the held-out fold."""
    rows = labelled(docs, labels, "toxic", fold_of("doc_id", FOLDS) != HELD, per_class, class_bytes)
    return fit([], []) if rows is None else fitted(rows, __name__, "_label")


def score(docs: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """``docs`` with the chance that a text is toxic. One pass, no shuffle."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # of a size fixed by BITS
    return docs.mapInArrow(remote(__name__, "score_batches", model=shared, text="text", name=name), longer(docs.schema, (name, T.DoubleType())))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", (fold_of("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``limit`` or more; its columns are kept."""
    (name,) = free_names(docs.columns, "toxicity_score")
    return score(docs, train(docs, labels), name).where(F.col(name) < limit).select(*all_columns(docs.columns))
