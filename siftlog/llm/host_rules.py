"""Operator 5: quality rules by host.

Each document is held against fixed rules. Failures are counted by host (the ``source``
column), and a host's failure rate is shrunk by a beta prior fitted to all hosts by
moments: few documents leave a host near the mean of all, many speak for themselves. A
host whose shrunken rate exceeds HOST_LIMIT takes its documents with it.

Defined cases: a null text has no word and fails; a document with a null source belongs to
no host, so only its own rules count; null ids and repeated rows are counted like others;
texts of any length are read whole; with no host or a single one the prior is flat
(one failure in two); extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, hot_key_join, remote, texts_of, written

LEAST_WORDS = 50
REPEAT_PERCENT = 50
WINDOW = 3
HOST_LIMIT = 0.5
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\v\f"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that occur twice or more, each word once."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    code = ids[: n - window + 1]
    for k in range(1, window):
        code = code * len(number) + ids[k : n - window + 1 + k]
        if k < window - 1:  # keeps the next product within 64 bits
            code = np.unique(code, return_inverse=True)[1]
    _, back, counts = np.unique(code, return_inverse=True, return_counts=True)
    again = counts[back] > 1
    covered = np.zeros(n, bool)
    for k in range(window):
        covered[k : n - window + 1 + k] |= again
    return int(covered.sum())


def measure(text: str) -> tuple[int, int, int, int, int]:
    words = text.encode("utf-8", "surrogatepass").split()  # ASCII white space alone
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def measure_batches(batches):
    for batch in batches:
        rows = [measure(t) for t in texts_of(batch.column("text"))]
        columns = zip(*rows) if rows else [()] * len(COUNTS)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "source", *COUNTS])


def measures(docs: DataFrame) -> DataFrame:
    """Counts of each document and base_failed. One pass, no shuffle."""
    bound_batches(docs.sparkSession)
    schema = "doc_id long, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    plain = docs.select("doc_id", "text", F.col("source").cast("string").alias("source"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return plain.mapInArrow(remote(__name__, "measure_batches"), schema).withColumn("base_failed", failed)


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Alpha and beta by moments of the hosts' rates, each host weighing alike. Where the rates
    spread no more than chance would let them, the prior is as strong as the mean host."""
    rate = F.col("failed") / F.col("rows")
    row = hosts.agg(F.count("*").alias("n"), F.avg(rate).alias("mean"), F.var_samp(rate).alias("var"), F.avg("rows").alias("rows")).first()
    if not row["n"] or row["n"] < 2 or not 0 < row["mean"] < 1:
        return 1.0, 1.0
    strength = row["rows"]
    if row["var"]:
        strength = min(strength, max(row["mean"] * (1 - row["mean"]) / row["var"] - 1, 1.0))
    return row["mean"] * strength, (1 - row["mean"]) * strength


def host_rates(measured: DataFrame) -> DataFrame:
    """(source, rows, failed, rate, rejected) of every host."""
    hosts = written(measured.where(F.col("source").isNotNull()).groupBy("source").agg(F.count("*").alias("rows"), F.sum(F.col("base_failed").cast("long")).alias("failed")), "hosts")
    alpha, beta = beta_prior(hosts)
    rate = (F.col("failed") + F.lit(alpha)) / (F.col("rows") + F.lit(alpha + beta))
    return hosts.withColumn("rate", rate).withColumn("rejected", F.col("rate") > HOST_LIMIT)


def apply_rules(docs: DataFrame) -> DataFrame:
    """Counts, base_failed, host_rate and kept of every document."""
    measured = written(measures(docs), "measures")
    hosts = host_rates(measured).select("source", "rows", F.col("rate").alias("host_rate"), "rejected")
    joined = hot_key_join(measured, hosts, "source", F.col("rows"), measured.count())
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))).select("doc_id", *COUNTS, "base_failed", "kept", "host_rate")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, unnest(generate_series(1, len(ws) - 2)) AS i, ws FROM w WHERE len(ws) > 2),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM h, (VALUES (0), (1), (2)) AS o(k) WHERE c > 1 GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT d.doc_id, d.source, CAST(len(w.ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(d.t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
hosts AS (SELECT source, count(*) AS n, sum(CAST(base_failed AS INT)) AS bad FROM f WHERE source IS NOT NULL GROUP BY source),
mo AS (SELECT count(*) AS k, avg(bad / n) AS mean, var_samp(bad / n) AS var, avg(n) AS size FROM hosts),
pr AS (SELECT CASE WHEN k < 2 OR NOT (mean > 0 AND mean < 1) THEN NULL WHEN var > 0 THEN least(size, greatest(mean * (1 - mean) / var - 1, 1)) ELSE size END AS s, mean FROM mo),
v AS (SELECT source, (bad + coalesce(mean * s, 1)) / (n + coalesce(s, 2)) AS host_rate FROM hosts, pr)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(host_rate > 0.5, FALSE) AS kept
FROM f LEFT JOIN v USING (source)
"""
