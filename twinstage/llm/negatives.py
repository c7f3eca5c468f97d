"""Hard negatives by angular triangle filtering and integer scoring.

Components become ⌊scale · x⌋; a row's score is its integer inner product with the anchor.
For every row its norm and its angles to a few fixed reference directions are stored. From
the triangle inequality on the sphere, with θ the angles to a direction r,

    |θ_r(a) − θ_r(x)| ≤ angle(a, x) ≤ min(θ_r(a) + θ_r(x), 2π − θ_r(a) − θ_r(x)),

so the directions together give a cosine interval, and the norms times it, widened by what
float32 can round away, a score interval. Only pairs whose interval overlaps a window that
is still wanted are scored, with exact integers.

1. *Positives*: the window of an anchor reaches from the last of its best scores found so far
   (its label, other rows) upwards.
2. *Negatives*: each positive gives the window [⌈low · score / 100⌉, ⌊high · score / 100⌋] for rows of
   other labels; its lower end rises with the last of the best scores found in it.

Rows and anchors are dealt by a hash into blocks of at most about ``block`` (rows into as many as the
cluster has cores, if these are not too small), every pair of blocks of one dimension is one group, and groups return at most ``positives`` or ``negatives`` rows for
an anchor or window; these meet in a ranking by (anchor, window). So labels, copies and
frequent vectors split evenly, no pair leaves its task, and a task holds two blocks. The
search is exact: the work grows with anchors × rows, the rows shuffled with
anchors × rows / block.

Edge cases: rows with a null label, a null vector or any null or non-finite component take no
part, nor do rows whose squared integer norm reaches 2^62 (their scores need not fit a long).
Vectors of different length never meet; empty vectors score 0 with each other, as zero vectors
do. Rows that repeat an id or a vector are rows of their own; a null id is no anchor and comes
last among equal scores. Ties go to the smaller id. Anchors without a positive and positives
without a negative give no rows; an empty table gives an empty result. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as X

BLOCK, SMALL_BLOCK = 1 << 15, 1 << 12
DIRECTIONS = 8
ROW_TILE, ANCHOR_TILE = 2048, 256
_LOW, _HIGH = -(1 << 62), 1 << 62
_DIRECTIONS: dict[tuple[int, int], np.ndarray] = {}


# ---------------------------------------------------------------------------
# stored rows: integers, norms, angles
# ---------------------------------------------------------------------------

def directions(dim: int, count: int = DIRECTIONS) -> np.ndarray:
    """``count`` unit vectors of length ``dim``, orthogonal as far as the dimension allows; always the same."""
    if (dim, count) not in _DIRECTIONS:
        _DIRECTIONS.clear()
        raw = np.random.default_rng(dim).standard_normal((count, dim))
        for k in range(0, count, max(dim, 1)):
            part = raw[k:k + max(dim, 1)]
            raw[k:k + max(dim, 1)] = np.linalg.qr(part.T)[0].T[:len(part)] if dim else part
        _DIRECTIONS[dim, count] = raw
    return _DIRECTIONS[dim, count]


def angles_to(q: np.ndarray, norm: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Angles of integer rows to the directions; 0 for zero rows (whose bounds are 0 whatever they say)."""
    cos = (q @ refs.T) / np.where(norm > 0, norm, 1.0)[:, None]
    return np.where(norm[:, None] > 0, np.arccos(np.clip(cos, -1.0, 1.0)), 0.0).astype(np.float32)


def integers(v, scale: float) -> np.ndarray | None:
    """⌊scale · x⌋ of a list scalar as long integers; None where the row takes no part."""
    if not v.is_valid or v.values.null_count:
        return None
    x = np.floor(np.asarray(v.values, dtype=np.float64) * scale)
    if not np.isfinite(x).all() or (len(x) and np.abs(x).max() >= 2.0 ** 31) or np.dot(x, x) >= 2.0 ** 62:
        return None
    return x.astype(np.int64)


_ROW = "key long, id long, label string, anchor boolean, dim int, q binary, norm double, angles binary"


def _rows(rows: DataFrame, id_col: str, vec_col: str, label_col: str, anchor: Column, scale: float) -> DataFrame:
    src = rows.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"),
                      F.col(label_col).cast("string").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"),
                      F.col(vec_col).cast("array<double>").alias("v")).where("label IS NOT NULL AND v IS NOT NULL")

    def batches(it):
        for b in it:
            qs = [integers(v, scale) for v in b.column("v")]
            own = pa.array([i for i, q in enumerate(qs) if q is not None], pa.int64())
            qs = [q for q in qs if q is not None]
            dims = np.array([len(q) for q in qs], np.int32)
            norm, angles = np.zeros(len(qs)), np.zeros((len(qs), DIRECTIONS), np.float32)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                m = np.array([qs[i] for i in at], np.float64).reshape(len(at), d)
                norm[at] = np.sqrt(np.einsum("ij,ij->i", m, m))
                angles[at] = angles_to(m, norm[at], directions(int(d)))
            narrow = [q.astype(np.int16 if not len(q) or np.abs(q).max() < 1 << 15 else np.int32).tobytes() for q in qs]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(own) for c in ("key", "id", "label", "anchor")), pa.array(dims), pa.array(narrow, pa.binary()),
                 pa.array(norm), pa.array([a.tobytes() for a in angles], pa.binary())],
                names=["key", "id", "label", "anchor", "dim", "q", "norm", "angles"])

    return src.mapInArrow(batches, _ROW)


# ---------------------------------------------------------------------------
# one pair of blocks
# ---------------------------------------------------------------------------

class Block:
    """Arrays of the rows of an Arrow table: integers, norms, angles, ids, labels."""

    def __init__(self, t: pa.Table, dim: int):
        wide = [x.as_py() for x in t.column("q")]
        self.q = np.empty((t.num_rows, dim), np.int64)
        for i, raw in enumerate(wide):
            self.q[i] = np.frombuffer(raw, np.int16 if len(raw) == 2 * dim else np.int32)
        self.real = self.q.astype(np.float64)
        self.norm = t.column("norm").to_numpy()
        self.angles = np.frombuffer(b"".join(t.column("angles").to_pylist()), np.float32).reshape(t.num_rows, DIRECTIONS)
        self.key = t.column("key").to_numpy()
        self.order = t.column("id").fill_null(np.iinfo(np.int64).max).to_numpy()
        self.table = t


def score_bounds(anchor_angles, anchor_norm, row_angles, row_norm) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) of the scores of all pairs, rounded outwards."""
    low = np.zeros((len(anchor_norm), len(row_norm)), np.float32)
    high = np.full_like(low, np.pi)
    for r in range(anchor_angles.shape[1]):
        a, x = anchor_angles[:, r][:, None], row_angles[:, r]
        np.maximum(low, np.abs(a - x), out=low)
        s = a + x
        np.minimum(high, np.minimum(s, np.float32(2 * np.pi) - s), out=high)
    both = anchor_norm[:, None] * row_norm
    slack = 1e-5 * both + 2.0  # float32 angles, sums and cosines are good to some 2e-6
    return np.floor(both * np.cos(high) - slack), np.ceil(both * np.cos(low) + slack)


def exact_scores(a: Block, b: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs (i, j)."""
    out = np.empty(len(i), np.int64)
    safe = bool(len(i)) and float(a.norm[i].max()) * float(b.norm[j].max()) < 2.0 ** 52
    left, right = (a.real, b.real) if safe else (a.q, b.q)  # doubles are exact below 2^53
    for k in range(0, len(i), 1 << 15):
        x, y = i[k:k + (1 << 15)], j[k:k + (1 << 15)]
        out[k:k + (1 << 15)] = np.einsum("ij,ij->i", left[x], right[y])
    return out


def best_in_windows(a: Block, b: Block, same: np.ndarray, low: np.ndarray, high: np.ndarray, keep: int, like: bool):
    """The ``keep`` best rows of each window: (anchor, window, row, score), by score, then smaller id.

    ``same``: function of index arrays, true where labels are equal; ``like`` picks rows of the same
    label other than the anchor, else rows of another. Window w of anchor i is low[i, w] … high[i, w].
    """
    n_windows = low.shape[1]
    out = []
    for s in range(0, len(a.norm), ANCHOR_TILE):
        at = np.arange(s, min(s + ANCHOR_TILE, len(a.norm)))
        lo, hi = low[at].copy(), high[at]
        best = [np.zeros(0, np.int64) for _ in range(4)]  # anchor, window, row, score
        for t in range(0, len(b.norm), ROW_TILE):
            rows = np.arange(t, min(t + ROW_TILE, len(b.norm)))
            below, above = score_bounds(a.angles[at], a.norm[at], b.angles[rows], b.norm[rows])
            label_ok = same(at, rows) if like else ~same(at, rows)
            wanted = np.zeros_like(label_ok)
            for w in range(n_windows):
                wanted |= (above >= lo[:, w][:, None]) & (below <= hi[:, w][:, None])
            i, j = np.nonzero(wanted & label_ok)
            if like:
                other = a.key[at[i]] != b.key[rows[j]]
                i, j = i[other], j[other]
            score = exact_scores(a, b, at[i], rows[j])
            for w in range(n_windows):
                hit = (score >= lo[i, w]) & (score <= hi[i, w])
                new = (i[hit], np.full(int(hit.sum()), w), rows[j[hit]], score[hit])
                best = [np.concatenate(x) for x in zip(best, new)]
            best, lo = _cut(best, b, keep, lo)
        out.append((at[best[0]], *best[1:]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4


def _cut(best, b: Block, keep: int, lo: np.ndarray):
    """Keep the first ``keep`` of each (anchor, window); a full window starts at its last score."""
    anchor, window, row, score = best
    order = np.lexsort((b.order[row], -score, window, anchor))
    anchor, window, row, score = (x[order] for x in best)
    group = anchor * lo.shape[1] + window
    first = np.searchsorted(group, group)
    place = np.arange(len(group)) - first
    full = np.flatnonzero(place == keep - 1)
    lo = lo.copy()
    lo[anchor[full], window[full]] = np.maximum(lo[anchor[full], window[full]], score[full])
    stay = place < keep
    return [x[stay] for x in (anchor, window, row, score)], lo


# ---------------------------------------------------------------------------
# the operator
# ---------------------------------------------------------------------------

def hard_negatives(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                   scale: float = 256.0, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank) for the rows where ``anchor``
    holds: for each of the first ``positives`` other rows of the anchor's label the first ``negatives`` rows of
    other labels with low · positive_score ≤ 100 · negative_score ≤ high · positive_score."""
    X.ready(rows.sparkSession)
    is_anchor = anchor & F.col(id_col).isNotNull()
    members = X.stored(_rows(rows, id_col, vec_col, label_col, is_anchor, scale), "scored")
    cores, n = rows.sparkSession.sparkContext.defaultParallelism, F.count(F.lit(1))
    spread = F.greatest(F.ceil(n / block), F.least(F.ceil(n / min(block, SMALL_BLOCK)), F.lit(cores)))
    sizes = members.groupBy("dim").agg(spread.cast("long").alias("row_blocks"),
                                       F.ceil(F.count(F.when(F.col("anchor"), 1)) / block).cast("long").alias("anchor_blocks"))
    sized = members.join(sizes.where("anchor_blocks > 0"), "dim")
    mine = F.xxhash64("key")
    cols = ["dim", "key", "id", "label", "q", "norm", "angles"]

    def upto(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    no_windows = F.lit(None).cast("array<bigint>")
    as_rows = sized.select(*cols, F.pmod(mine, F.col("row_blocks")).alias("rb"), upto("anchor_blocks").alias("ab"),
                           F.lit(False).alias("asks"), no_windows.alias("low"), no_windows.alias("high"))
    asking = sized.where("anchor").select(*cols, F.pmod(mine, F.col("anchor_blocks")).alias("ab"), "row_blocks")

    def compare(keep: int, like: bool):
        def one(key, t):
            dim = key[0].as_py()
            asks = t.column("asks").to_numpy()
            ta, tb = t.take(np.flatnonzero(asks)), t.take(np.flatnonzero(~asks))
            a, b = Block(ta, dim), Block(tb, dim)
            codes = {x: i for i, x in enumerate(dict.fromkeys(t.column("label").to_pylist()))}
            la, lb = (np.array([codes[x] for x in u.column("label").to_pylist()], np.int64) for u in (ta, tb))
            wide = max([len(x) for x in ta.column("low").to_pylist()], default=1)
            lo, hi = np.full((len(la), wide), _HIGH), np.full((len(la), wide), _LOW)  # windows that nothing fits
            for side, at in (("low", lo), ("high", hi)):
                for i, x in enumerate(ta.column(side).to_pylist()):
                    at[i, :len(x)] = x
            i, w, j, s = best_in_windows(a, b, lambda x, y: la[x][:, None] == lb[y], lo, hi, keep, like)
            return pa.table({"anchor": pa.array(a.key[i], pa.int64()), "window": pa.array(w, pa.int64()),
                             "row": pa.array(b.key[j], pa.int64()), "id": tb.column("id").take(pa.array(j)),
                             "score": pa.array(s, pa.int64())})
        return one

    def search(anchors: DataFrame, keep: int, like: bool, name: str) -> DataFrame:
        a = anchors.select(*cols, upto("row_blocks").alias("rb"), "ab", F.lit(True).alias("asks"), "low", "high")
        parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number: small groups are not put together
        found = (as_rows.unionByName(a).repartition(parts, "dim", "ab", "rb").groupBy("dim", "ab", "rb")
                 .applyInArrow(compare(keep, like), "anchor long, window long, row long, id long, score long"))
        order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
        return X.stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep), name)

    everything = asking.withColumn("low", F.array(F.lit(_LOW))).withColumn("high", F.array(F.lit(_HIGH)))
    pos = search(everything, positives, True, "positives")
    # longs all the way: scores stay below 2^62, so the quotient and the rest are scaled apart
    score = F.col("score")
    quotient, rest = F.expr("score div 100"), F.expr("score % 100")
    pos = pos.select(F.col("anchor").alias("key"), (F.col("rank") - 1).cast("long").alias("window"), F.col("id").alias("positive_id"),
                     score.alias("positive_score"), (quotient * low + F.ceil(rest * low / 100)).cast("long").alias("lo"),
                     (quotient * high + F.floor(rest * high / 100)).cast("long").alias("hi"))
    windows = pos.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("window", "lo", "hi"))).alias("w"))
    asking2 = asking.join(windows, "key").withColumn("low", F.col("w.lo")).withColumn("high", F.col("w.hi"))
    neg = search(asking2, negatives, False, "negatives")
    named = members.where("anchor").select("key", F.col("id").alias("anchor_id"))
    return (neg.select(F.col("anchor").alias("key"), "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(pos.drop("lo", "hi"), ["key", "window"]).join(named, "key")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score",
                    (F.col("window") + 1).cast("int").alias("positive_rank")))
