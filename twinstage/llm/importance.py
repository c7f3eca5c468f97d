"""Importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Two generative models are counted, one on all raw texts, one on the target texts: the
probability of each of ``buckets`` hash buckets of n-grams (words and pairs of words in
one family, runs of ``BYTES_N`` bytes in another, each family a distribution of its own).
A text's log weight is the log ratio of the two models per n-gram, times ``scale``: as if
every text were a sample of that many n-grams, so that length alone decides nothing. Adding
Gumbel noise and keeping the k largest samples without replacement in proportion to the
weights. Noise comes from a hash of seed and id: reruns agree.

The models are counted in the tasks that read the texts and added up by bucket, so what
reaches the driver is 2 × buckets numbers per model whatever the corpus, while every
text counts. The k-th largest key is found by histograms of a stored column of integer
keys; nothing is sorted and nothing limited.

Edge cases: a null or empty text has no n-grams and log weight ``EMPTY``, below all
others; rows that repeat id and weight have equal keys and stay or go together (so the
sample may exceed k by such rows); a null id is an id. An empty table gives an empty
result; without target texts all weights are 0 and the sample is uniform.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as X

BUCKETS = 1 << 14
BYTES_N = 3
EMPTY = -1e6
_UNIT = 1e9  # keys are integers of this many to 1


def _ngrams(col, buckets: int):
    """(bucket numbers, first of each row) for words and word pairs, and the same for byte runs."""
    data, offsets = X.text_bytes(col)
    starts, ends, first = X.word_spans(data, offsets)
    words = X.span_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inner = row[1:] == row[:-1]
    pairs = X.mix64(words[:-1] * np.uint64(0x9FB21C651E98DF25) + words[1:])[inner]
    grams = np.concatenate([words, pairs])
    rows = np.concatenate([row, row[1:][inner]])
    low = np.uint64(buckets - 1)
    yield (grams & low).astype(np.int64), rows
    n = len(data) - BYTES_N + 1
    if n > 0:
        code = np.zeros(n, np.uint32)
        for k in range(BYTES_N):
            code = (code << np.uint32(8)) | data[k:k + n]
        code = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - (buckets.bit_length() - 1))).astype(np.int64)
        at = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        ok = at[:n] == at[BYTES_N - 1:BYTES_N - 1 + n]
        yield buckets + code[ok], at[:n][ok]


def _parts(batch: pa.RecordBatch, size: int = 1 << 20):
    """Slices of a batch of about ``size`` bytes of text (a longer text alone)."""
    _, offsets = X.text_bytes(batch.column("text"))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def fit_log_ratio(docs: DataFrame, buckets: int = BUCKETS, smoothing: float = 1.0) -> np.ndarray:
    """From docs (text, target): log of target over raw probability of each bucket of both families."""
    def count(batches):
        total = np.zeros((2, 2 * buckets), np.int64)
        for b in batches:
            for part in _parts(b):
                chosen = part.column("target").to_numpy(zero_copy_only=False).astype(bool)
                for grams, rows in _ngrams(part.column("text"), buckets):
                    total[0] += np.bincount(grams, minlength=2 * buckets)
                    total[1] += np.bincount(grams[chosen[rows]], minlength=2 * buckets)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])],
                                         names=["bucket", "raw", "chosen"])

    got = (docs.select("text", "target").mapInArrow(count, "bucket long, raw long, chosen long")
           .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("chosen").alias("chosen")).collect())  # ≤ 2 · buckets
    counts = np.zeros((2, 2 * buckets))
    for r in got:
        counts[:, r["bucket"]] = r["raw"], r["chosen"]
    out = np.zeros(2 * buckets)
    for half in (slice(0, buckets), slice(buckets, 2 * buckets)):
        raw, chosen = counts[:, half]
        if chosen.sum() > 0:
            p = (chosen + smoothing) / (chosen.sum() + smoothing * buckets)
            q = (raw + smoothing) / (raw.sum() + smoothing * buckets)
            out[half] = np.log(p) - np.log(q)
    return out


def log_weights(docs: DataFrame, log_ratio: np.ndarray, scale: float) -> DataFrame:
    """docs (id, text) → (id, n_ngrams, log_weight)."""
    buckets = len(log_ratio) // 2
    sent = docs.sparkSession.sparkContext.broadcast(log_ratio)

    def run(batches):
        for b in batches:
            for part in _parts(b):
                n, total = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows)
                for grams, rows in _ngrams(part.column("text"), buckets):
                    m = np.bincount(rows, minlength=part.num_rows)
                    total += np.bincount(rows, sent.value[grams], part.num_rows) / np.maximum(m, 1)
                    n += m
                weight = np.where(n > 0, scale * total, EMPTY)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), pa.array(weight)],
                                                 names=["id", "n_ngrams", "log_weight"])

    return docs.select("id", "text").mapInArrow(run, T.StructType([
        docs.schema["id"], T.StructField("n_ngrams", T.LongType()), T.StructField("log_weight", T.DoubleType())]))


def kth_largest(df: DataFrame, key: Column, k: int, bins: int = 1024) -> tuple[int, int] | None:
    """(value, how many are above it) of the k-th largest integer key, by histograms; None if k < 1."""
    lo, hi, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if k < 1 or not n:
        return None
    k, above = min(k, n), 0
    while lo < hi:
        width = -(-(hi - lo + 1) // bins)
        bin_ = F.expr("0").cast("long") if width <= 0 else F.floor(
            (key.cast("decimal(38,0)") - F.lit(lo).cast("decimal(38,0)")) / F.lit(width).cast("decimal(38,0)")).cast("long")
        rows = df.where((key >= F.lit(lo)) & (key <= F.lit(hi))).groupBy(bin_.alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()  # ≤ bins
        for r in sorted(rows, key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                lo, hi = r["lo"], r["hi"]
                break
            above += r["n"]
    return lo, above


def importance_sample(docs: DataFrame, target_ids: DataFrame, fraction: float = 0.85, id_col: str = "doc_id",
                      text_col: str = "text", max_target: int = 20_000, buckets: int = BUCKETS, scale: float = 40.0,
                      seed: int = 20240229) -> DataFrame:
    """One row per document: id_col, n_ngrams, log_weight, gumbel_key, kept (among the k largest keys, where k
    is ``fraction`` of the rows).

    ``target_ids``: one column, ids of target documents. The target model is fitted on at most ``max_target``
    of them, those of the smallest hash, so their list is small enough to broadcast; the raw model and
    all weights cover every document.
    """
    X.ready(docs.sparkSession)
    if buckets & (buckets - 1):
        raise ValueError("buckets: a power of two")
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = target_ids.toDF("id").where(F.col("id").isNotNull()).distinct()
    chosen = ids.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(max_target).withColumn("target", F.lit(True))
    marked = d.join(F.broadcast(chosen), "id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    ratio = fit_log_ratio(marked, buckets)
    u = (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    scored = X.stored(log_weights(d, ratio, scale).withColumn(
        "key", ((F.col("log_weight") - F.log(-F.log(u))) * _UNIT).cast("long")), "weights")
    k = int(round(fraction * scored.count()))
    cut = kth_largest(scored, F.col("key"), k)
    kept = F.lit(False)
    if cut:
        tie = F.xxhash64("id", F.lit(seed + 1))
        equal = scored.where(F.col("key") == F.lit(cut[0]))
        last = kth_largest(equal, tie, k - cut[1])
        kept = (F.col("key") > F.lit(cut[0])) | ((F.col("key") == F.lit(cut[0])) & (tie >= F.lit(last[0])))
    return scored.select(F.col("id").alias(id_col), "n_ngrams", "log_weight", (F.col("key") / F.lit(_UNIT)).alias("gumbel_key"),
                         kept.alias("kept"))
