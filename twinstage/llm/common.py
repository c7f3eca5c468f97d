"""Shared helpers: stored tables, connected components, and words of UTF-8 batches.

Texts reach the numpy code as the offsets and bytes of an Arrow string array, so
no per-row Python strings are made. Words are maximal runs of bytes other than
the ASCII white space 0x20 and 0x09–0x0D.
"""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root, ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"


# ---------------------------------------------------------------------------
# tables in the shared folder
# ---------------------------------------------------------------------------

def ready(spark: SparkSession) -> None:
    """Checkpoint folder set, and this package on the Python workers' path where it lies at the same
    place on every node (elsewhere submit it with ``--py-files``)."""
    ensure_checkpoint_dir(spark)
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (home, env.get("PYTHONPATH", "")) if x)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage: a lost executor costs no more than the tasks after it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{checkpoint_root(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def releasing(batches: Iterator, forget: Callable[[], None]) -> Iterator:
    """The batches; after the last one, or where the task stops before, ``forget`` runs and unused memory goes
    back to the system, as the Python worker stays for later tasks."""
    try:
        yield from batches
    finally:
        forget()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)


# ---------------------------------------------------------------------------
# connected components
# ---------------------------------------------------------------------------

def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reachable.

    Alternating large-star and small-star rounds (joins and aggregates only); each
    round is stored, the driver sees one count and one checksum per round. Nodes
    may be of any orderable type. Needs O(log² n) rounds at most; star-shaped
    edges, as the operators here give, settle in two or three.
    """
    def signed(d: DataFrame):
        return tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    cur = stored(edges.where(F.col("a") != F.col("b"))
                 .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = signed(cur)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.where(F.col("b") > F.col("a")).join(low, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = large.union(low.where(F.col("m") < F.col("a")).select("a", F.col("m").alias("b"))).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = (small.where(F.col("a") != F.col("b"))
                 .union(low2.select("a", F.col("m").alias("b")))).distinct()
        cur = stored(small, "edges")
        now = signed(cur)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


# ---------------------------------------------------------------------------
# bytes and words of an Arrow string column
# ---------------------------------------------------------------------------

def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string column: row i is ``data[offsets[i]:offsets[i+1]]``; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        if col.num_chunks == 1:
            col = col.chunk(0)
        else:
            col = pa.chunked_array([c.cast(pa.large_string()) for c in col.chunks], pa.large_string()).combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset: col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): words never cross rows; row i has words first[i]:first[i+1]."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    finish = word.copy()
    finish[:-1] &= ~word[1:]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]  # first bytes of rows that have any
    begins[edge] = word[edge]
    last = edge[1:] - 1
    finish[last] = word[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, offsets)


_MIX1, _MIX2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
_SEED = np.random.RandomState(20240229)
BYTE_CODES = _SEED.randint(0, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed invertible scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse, at least ``n`` of each."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, 1 << 18)
        _POWERS["up"] = np.cumprod(np.r_[1, np.full(size - 1, _BASE, np.uint64)].astype(np.uint64), dtype=np.uint64)
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS["down"] = np.cumprod(np.r_[1, np.full(size - 1, inverse, np.uint64)].astype(np.uint64), dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """64-bit hash of each span (spans ascending, not overlapping), in blocks of bounded size."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + block, "right")))
        s, e = starts[i:j] - base, ends[i:j] - base
        n = int(e[-1])
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODES[data[base:base + n]] * up[:n], out=total[1:])
        out[i:j] = mix64((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; with fewer words the whole sequence; without words none."""
    if len(words) == 0:
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    h = words[:n].copy()
    for j in range(1, k):
        h = mix64(h * np.uint64(0x9FB21C651E98DF25) + words[j:j + n])
    return mix64(h + np.uint64(k))


# ---------------------------------------------------------------------------
# arrays inside a row, in DataFrame functions
# ---------------------------------------------------------------------------

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op: Callable[[Column, Column], Column], start: int = 0, block: int = 512) -> Column:
    """For each element of an integer array the ``op`` of all elements before it (the first: ``start``).

    Done in blocks, and over the blocks, as an array that grows by one is copied: n · block steps
    and not n² for n elements.
    """
    zero = F.lit(start).cast("int")

    def folded(a: Column) -> Column:  # one element more than a
        return F.aggregate(a, F.array(zero), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))

    def joined(parts: Column) -> Column:
        heads = folded(F.transform(parts, lambda p: F.element_at(p, -1)))
        return F.flatten(F.zip_with(parts, F.slice(heads, F.lit(1), F.size(parts)),
                                    lambda p, h: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x: op(h, x))))

    return let(values.cast("array<int>"), lambda v: let(
        F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / block).cast("int")),
                    lambda k: folded(F.slice(v, k * block + 1, F.lit(block)))), joined))


def matches_of(text: Column, pattern: str) -> Column:
    """All matches of a regex with their places, in time linear in the text: an array of (start, end, value,
    before, after), in code points; ``before`` and ``after`` are the text up to the neighbouring matches."""
    def placed(z: Column) -> Column:
        steps = F.transform(z, lambda x: F.length(x["before"]) + F.length(x["value"]))
        return F.zip_with(z, running(steps, lambda a, b: a + b), lambda x, at: F.struct(
            (at + F.length(x["before"])).alias("start"), (at + F.length(x["before"]) + F.length(x["value"])).alias("end"),
            x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after")))

    def zipped(value: Column) -> Column:
        return let(F.split(text, pattern, -1), lambda gaps: F.arrays_zip(
            F.slice(gaps, F.lit(1), F.size(value)).alias("before"), value.alias("value"),
            F.slice(gaps, F.lit(2), F.size(value)).alias("after")))

    return let(let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), zipped), placed)
