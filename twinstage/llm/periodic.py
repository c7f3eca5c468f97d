r"""Periodic runs of words: enhanced suffix array and the branching-tandem test.

A run is a stretch of words with smallest period q and at least ``min_exponent`` · q and
``min_length`` words that no neighbouring word extends keeping period q. Per document:

1. Suffix array of the word numbers by prefix doubling (only groups that are still tied are
   sorted again). The rank of every 2^k words at every place is kept: equal ranks are equal
   words, so a common prefix or a common stretch to the left is found by halving steps.
2. LCP of neighbours, and for each place with LCP ℓ the interval of suffixes around it. The place cuts
   its interval into one child and the other children; every suffix i of the smaller side asks
   through the inverse array whether i + ℓ or i − ℓ stands on the other side. If so, the words
   of length 2ℓ there are a square that cannot be moved on by a word (a branching tandem
   repeat). No tree nodes are made: intervals are two numbers per place, from range minima.
3. Each square is rotated to the left as far as its words allow. A run has exactly one such
   square for its period, and one for some multiples of it, with the same two ends: squares are
   merged by their ends, keeping the smallest period.

Short texts are worked on together: words of different documents have different numbers, so
no interval, square or rotation crosses documents. Everything stays inside the row: no
shuffle, so neither copies nor frequent words meet anywhere. Time is O(n log² n) for n words
whatever they repeat, memory some 100 bytes a word of one batch of ``batch_words`` or of the longest document.

Words are ``[^\x20\x09-\x0D]+``, compared as they are. A word is dropped from ``kept`` if a run
contains it after that run's first q words; the others are joined by one space.

Edge cases: a null, empty or blank text has no words, no runs and an empty ``kept``; rows that
repeat, and rows with a null or repeated id, are answered each; an empty table gives an empty
result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as X

BATCH_WORDS = 1 << 18


def rank_levels(codes: np.ndarray) -> list[np.ndarray]:
    """Ranks of the 2^k words from each place, k = 0, 1, …, until all differ; one place past the end has rank −1.

    Ranks are places in sorted order (of the first of equals), so those of the last level are the
    inverse suffix array.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    head = np.r_[True, codes[order][1:] != codes[order][:-1]] if n else np.zeros(0, bool)
    rank = np.full(n + 1, -1, np.int64)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    levels, width = [rank], 1
    active = order[~(head & np.r_[head[1:], True])] if n else order
    while len(active):
        second = rank[np.minimum(active + width, n)]
        by = np.lexsort((second, rank[active]))
        active, second = active[by], second[by]
        first = rank[active]
        group = np.r_[True, first[1:] != first[:-1]]
        head = group | np.r_[True, second[1:] != second[:-1]]
        at = np.arange(len(active))
        rank = rank.copy()
        rank[active] = first + at[head][np.cumsum(head) - 1] - at[group][np.cumsum(group) - 1]
        levels.append(rank)
        active = active[~(head & np.r_[head[1:], True])]
        width *= 2
    return levels


def common_right(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes a and b (a ≠ b)."""
    n, out = len(levels[0]) - 1, np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = levels[k][np.minimum(a + out, n)], levels[k][np.minimum(b + out, n)]
        out += ((x == y) & (x >= 0)).astype(np.int64) << k
    return out


def common_left(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of words before a that equal those before b (a < b)."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a - out - (1 << k), b - out - (1 << k)
        same = (x >= 0) & (levels[k][np.maximum(x, 0)] == levels[k][np.maximum(y, 0)])
        out += same.astype(np.int64) << k
    return out


def interval_ends(lcp: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place k of ``places`` the ends [a, b): suffixes a … k−1 are joined by LCPs above lcp[k] (one child),
    k … b−1 by LCPs of at least lcp[k] (the other children). lcp[0] and a virtual lcp[n] are −1."""
    table = [np.r_[lcp, -1]]  # minima of 2^k LCPs from each place on
    need = lcp[places]
    while True:
        last = table[-1]
        step = 1 << (len(table) - 1)
        if step >= len(last):
            break
        wider = np.minimum(last[:-step], last[step:])
        if not (wider > 0).any():
            break
        table.append(wider)
    left, right = places.copy(), places + 1
    for k in range(len(table) - 1, -1, -1):
        step, mins = 1 << k, table[k]
        at = left - step
        ok = (at >= 0) & (mins[np.maximum(at, 0)] > need)
        left = np.where(ok, at, left)
        ok = (right < len(mins)) & (mins[np.minimum(right, len(mins) - 1)] >= need)
        right = np.where(ok, right + step, right)
    return left - 1, right


def branching_squares(levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(start, ℓ) of the squares of 2ℓ words whose next word is not the one ℓ before it."""
    inverse = levels[-1]
    n = len(inverse) - 1
    suffix = np.empty(n, np.int64)
    suffix[inverse[:n]] = np.arange(n)
    lcp = np.full(n, -1, np.int64)
    tied = np.flatnonzero(levels[0][suffix[1:]] == levels[0][suffix[:-1]]) + 1
    lcp[1:] = 0
    lcp[tied] = common_right(levels, suffix[tied - 1], suffix[tied])
    a, b = interval_ends(lcp, tied)
    small_left = tied - a <= b - tied
    lo, hi = np.where(small_left, a, tied), np.where(small_left, tied, b)
    other_lo, other_hi = np.where(small_left, tied, a), np.where(small_left, b, tied)
    starts, periods = [], []
    sizes = hi - lo
    ends = np.cumsum(sizes)
    s = 0
    while s < len(tied):  # blocks of bounded size
        e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + (1 << 20), "right")))
        at = np.repeat(np.arange(s, e), sizes[s:e])
        inside = np.arange(len(at)) - np.repeat(ends[s:e] - sizes[s:e] - (ends[s - 1] if s else 0), sizes[s:e])
        i = suffix[lo[at] + inside]
        depth = lcp[tied[at]]
        for place, start in ((i + depth, i), (i - depth, i - depth)):
            r = np.where((place >= 0) & (place < n), inverse[np.clip(place, 0, n)], -1)
            hit = (r >= other_lo[at]) & (r < other_hi[at])
            starts.append(start[hit])
            periods.append(depth[hit])
        s = e
    return (np.concatenate(starts), np.concatenate(periods)) if starts else (np.zeros(0, np.int64),) * 2


def runs_of(codes: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs, by start, then period."""
    levels = rank_levels(codes)
    start, period = branching_squares(levels)
    turned = common_left(levels, start, start + period)
    start, length = start - turned, turned + 2 * period
    ok = (length >= min_length) & (length >= min_exponent * period)
    start, length, period = start[ok], length[ok], period[ok]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])] if len(start) else np.zeros(0, bool)
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def word_numbers(words: list[bytes], base: int) -> tuple[np.ndarray, int]:
    """Numbers of words from ``base`` on, equal for equal words, and the first unused number."""
    known = dict(zip(dict.fromkeys(words), range(base, base + len(words))))
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words)), base + len(known)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _batch(texts: list[list[bytes]], min_length: int, min_exponent: int):
    """(runs, kept) of each document of a batch of word lists."""
    base, parts, bounds = 0, [], [0]
    for words in texts:
        numbers, base = word_numbers(words, base)
        parts.append(numbers)
        bounds.append(bounds[-1] + len(words))
    start, length, period = runs_of(np.concatenate(parts), min_length, min_exponent)
    cuts = np.searchsorted(start, bounds)
    out = []
    for d, words in enumerate(texts):
        own = slice(cuts[d], cuts[d + 1])
        s = start[own] - bounds[d]
        if not len(s):
            out.append(([], b" ".join(words)))
            continue
        drop = np.zeros(len(words) + 1, np.int64)
        np.add.at(drop, s + period[own], 1)
        np.add.at(drop, s + length[own], -1)
        stay = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
        found = [{"start": int(x), "length": int(y), "period": int(z)} for x, y, z in zip(s, length[own], period[own])]
        out.append((found, b" ".join([words[i] for i in stay])))
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_exponent: int = 4,
                  batch_words: int = BATCH_WORDS) -> DataFrame:
    """One row per document: id_col, n_words, runs (array of start, length, period by start, then period; words from 0),
    kept (the text without the words that repeat inside runs)."""
    if min_exponent < 2:
        raise ValueError("a run repeats its period at least twice")
    X.ready(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))

    def batches(it):
        for b in it:
            ids, texts = b.column("id"), b.column("text")
            at, held, n = 0, [], 0
            for i, raw in enumerate(texts):
                words = raw.as_buffer().to_pybytes().split()  # bytes.split cuts at exactly 0x20 and 0x09–0x0D
                held.append(words)
                n += len(words)
                if n >= batch_words or i + 1 == len(texts):
                    res = _batch(held, min_length, min_exponent)
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(at, len(held)), pa.array([len(w) for w in held], pa.int64()),
                         pa.array([r for r, _ in res], pa.list_(_RUN)), pa.array([k for _, k in res], pa.binary()).cast(pa.string())],
                        names=["id", "n_words", "runs", "kept"])
                    at, held, n = i + 1, [], 0

    kind = docs.schema[id_col].dataType.simpleString()
    out = src.mapInArrow(batches, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, kept string")
    return out.select(F.col("id").alias(id_col), "n_words", "runs", "kept")


def longest(runs: Column) -> Column:
    """The run of greatest length (ties: smallest start, then period); null without one."""
    key = F.transform(runs, lambda r: F.struct((-r["length"]).alias("back"), r["start"].alias("start"), r["period"].alias("period")))
    top = F.array_min(key)
    return F.when(top.isNotNull(), F.struct(top["start"].alias("start"), (-top["back"]).alias("length"), top["period"].alias("period")))
