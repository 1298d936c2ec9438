"""Operator 9: language identification as inference of a mixture of languages.

Every language has a smoothed distribution of hashed byte trigrams. A text is a bag of
short segments, each written in one language; expectation-maximisation estimates the
proportions. The language set grows greedily from the best single language, and a language
joins only if the likelihood it adds exceeds its penalty (PENALTY times the logarithm of
the number of segments). The prediction is the language of the largest proportion.

Counts are fitted on a bounded sample, PER_LANGUAGE ids of each language and SAMPLE_BYTES
bytes of text over all languages (but LANGUAGE_BYTES a language) at most, in one task on an
executor; every text is read whole, in pieces if it is longer than a block. Every language
value is learned; more than MOST_LANGUAGES of them raise an error, for the model has a row
of 2^BITS numbers each. Defined cases: null texts and texts without a letter are ``und``
with score 0, as is everything when nothing could be learned; a null id counts as fold 0;
rows with a null language teach nothing, and an id with several languages teaches the least; an
empty table gives no row; extra columns are not read, and ``keep_identified`` keeps them
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import all_columns, bound_batches, fold_of, free_names, remote, texts_of
from .ngrams import blocks, fitted, gram_codes, joined, longer, sample

GRAM, BITS = 3, 16
SEGMENT = 64
PER_LANGUAGE = 3000
SAMPLE_BYTES, LANGUAGE_BYTES = 32 << 20, 4 << 20
MOST_LANGUAGES = 512
SMOOTH = 0.5
PENALTY = 4.0
STEPS = 12
FOLDS, HELD = 4, 2
UNKNOWN = "und"


def low(texts: list[str]) -> list[bytes]:
    return [t.lower().encode("utf-8", "surrogatepass") for t in texts]


def fit(texts: list[str], langs: list[str]) -> dict:
    """{languages, logs}: natural logarithms of the smoothed shares, a row a language."""
    names = sorted(set(langs))
    counts = np.zeros((len(names), 1 << BITS), np.float32)
    number = {x: k for k, x in enumerate(names)}
    of = np.array([number[x] for x in langs], np.int64)
    raw = low(texts)
    for a, b in blocks(raw):
        data, starts = joined(raw[a:b], GRAM)
        code = gram_codes(data, GRAM, BITS)
        lang = np.repeat(of[a:b], np.diff(starts))[: len(code)]
        for k in np.unique(lang):
            counts[k] += np.bincount(code[lang == k], minlength=1 << BITS)
    if names:
        total = counts.sum(1, keepdims=True, dtype=np.float64) + SMOOTH * (1 << BITS)
        counts += np.float32(SMOOTH)
        np.log(counts, out=counts)
        counts -= np.log(total).astype(np.float32)
    return {"languages": names, "logs": counts}


def mixture(like: np.ndarray, starts: np.ndarray, sets: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and gain in log-likelihood by document. like: (segments, languages), scaled
    so that the largest of a segment is 1; sets: (documents, languages), who may take part."""
    sizes = np.diff(np.append(starts, len(like)))
    doc = np.repeat(np.arange(len(starts)), sizes)
    share = sets / sets.sum(1, keepdims=True)
    for _ in range(steps):
        part = like * share[doc]
        total = part.sum(1, keepdims=True)
        share = np.add.reduceat(part / np.maximum(total, 1e-300), starts, axis=0) / sizes[:, None]
    total = (like * share[doc]).sum(1)
    return share, np.add.reduceat(np.log(np.maximum(total, 1e-300)), starts)


def predict_block(raw: list[bytes], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, languages): the proportions, 0 outside the chosen set; confidence of the largest."""
    data, starts = joined(raw, GRAM)
    code = gram_codes(np.append(data, np.zeros(GRAM - 1, np.uint8)), GRAM, BITS)
    # segments begin where a word begins first after each stretch of SEGMENT bytes, and at every text
    word = np.flatnonzero((data[1:] > 32) & (data[:-1] <= 32)) + 1
    begin = word[np.flatnonzero(np.diff(word // SEGMENT, prepend=-1))]
    begin = np.union1d(begin, starts[:-1])
    at = np.searchsorted(begin, starts[:-1])
    table = np.stack([np.add.reduceat(row[code], begin) for row in logs], axis=1).astype(np.float64)
    top = table.max(1, keepdims=True)
    like = np.exp(np.maximum(table - top, -700))
    single = np.add.reduceat(np.maximum(table - top, -700), at, axis=0)
    docs, langs = single.shape
    sizes = np.diff(np.append(at, len(table)))
    best = single.argmax(1)
    value = single[np.arange(docs), best]
    odds = np.exp(single - value[:, None])
    chosen = np.zeros((docs, langs))
    chosen[np.arange(docs), best] = 1
    share = chosen.copy()
    sure = 1 / odds.sum(1)
    penalty = PENALTY * np.log(sizes + 1.0)
    # value is at most 0, so no set can gain more than -value
    live = np.flatnonzero(-value > penalty) if langs > 1 else np.array([], np.int64)
    while len(live):
        pick = np.concatenate([np.arange(at[d], at[d] + sizes[d]) for d in live])
        part, first = like[pick], np.concatenate([[0], np.cumsum(sizes[live])[:-1]]).astype(np.int64)
        gain, which, shares = np.full(len(live), -np.inf), np.zeros(len(live), np.int64), np.zeros((len(live), langs))
        for lang in range(langs):
            sets = chosen[live].copy()
            new = sets[:, lang] == 0
            if not new.any():
                continue
            sets[:, lang] = 1
            got, total = mixture(part, first, sets)
            better = new & (total > gain)
            gain[better], which[better], shares[better] = total[better], lang, got[better]
        ok = gain - value[live] > penalty[live]
        grown = live[ok]
        chosen[grown, which[ok]] = 1
        share[grown], value[grown] = shares[ok], gain[ok]
        sure[grown] = 1.0
        live = grown[(chosen[grown].sum(1) < langs) & (-value[grown] > penalty[grown])]
    return share, sure


def predict(texts: list[str], model: dict) -> tuple[list[str], list[float], list[list[str]]]:
    """Main language, score, and the language set by falling proportion, for each text."""
    names, logs = model["languages"], model["logs"]
    out: tuple[list, list, list] = ([], [], [])
    raw = low(texts)
    for a, b in blocks(raw):
        if not names:
            share = None
        else:
            share, sure = predict_block(raw[a:b], logs)
        for k in range(b - a):
            if share is None or not any(map(str.isalpha, texts[a + k])):
                found = UNKNOWN, 0.0, []
            else:
                row = share[k]
                main = int(row.argmax())
                found = names[main], float(row[main] * sure[k]), [names[i] for i in np.argsort(-row, kind="stable") if row[i] > 0]
            for column, x in zip(out, found):
                column.append(x)
    return out


def predict_batches(batches, model, out: list[str]):
    known = model.value
    for batch in batches:
        lang, score, members = predict(texts_of(batch.column("text")), known)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(members, pa.list_(pa.string()))], [*batch.schema.names, *out])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, most: int = MOST_LANGUAGES) -> dict:
    """Learns from rows outside the held-out fold, drawn by hash of the id."""
    taught = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of("doc_id", FOLDS) != HELD))
    known = taught.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    found = known.groupBy("lang").count().limit(most + 1).collect()  # a row a language
    if len(found) > most:
        raise ValueError(f"more than {most} languages to learn; raise MOST_LANGUAGES if a worker can hold 2^{BITS} numbers for each")
    if not found:
        return fit([], [])
    share = min(LANGUAGE_BYTES, SAMPLE_BYTES // len(found))
    return fitted(sample(docs, known, "lang", {r[0]: r[1] for r in found}, per_language, share, "lang"), __name__, "lang")


def identify(docs: DataFrame, model: dict, out: tuple[str, str, str] = ("lang_pred", "lang_score", "lang_set")) -> DataFrame:
    """``docs`` with the main language, its score, and the set of languages. One pass, no shuffle."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 2^BITS numbers a language
    return docs.mapInArrow(remote(__name__, "predict_batches", model=shared, out=list(out)), longer(docs.schema, *zip(out, (T.StringType(), T.DoubleType(), T.ArrayType(T.StringType())))))


def languages(docs: DataFrame) -> DataFrame:
    found = identify(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", (fold_of("doc_id", FOLDS) == HELD).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "lang_set")


def keep_identified(docs: DataFrame, least: float = 0.25) -> DataFrame:
    """``docs`` without rows whose language can't be told (``und``) or whose main language
    scores under ``least``; its columns are kept."""
    lang, score, members = free_names(docs.columns, "lang_pred", "lang_score", "lang_set")
    found = identify(docs, train(docs.select("doc_id", "text", "lang")), (lang, score, members))
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).select(*all_columns(docs.columns))
