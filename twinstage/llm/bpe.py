"""Byte-level BPE encoding and decoding with a given rank file, on padded numpy matrices.

A text is cut by the pattern; each distinct piece that a task has not met before is
encoded once. New pieces are dealt into length buckets and become rows of padded
matrices of token ids. Each round looks up the rank of every adjacent pair (an
open-addressing hash table over (left id, right id)), merges each row's leftmost pair
of smallest rank, closes the gap, and drops the rows that have no pair left. A piece
that is itself a token is that token. Pieces beyond the widest bucket are merged by the
same rule with a heap, as a matrix would move the whole row for each single merge.

Known pieces are remembered within a task, up to some ``CACHE`` bytes; then the memory
is emptied and filled anew, which changes the time and nothing else. At the end of a task
they go: Python workers outlive their tasks. Texts stay in the
task that scans them: no shuffle. Ids are kept as little-endian unsigned 32-bit integers.

Edge cases: a null text counts as empty and has no ids; very long texts and pieces are
encoded whole; rows that repeat are encoded each. Empty tables give empty results.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as X

WIDTHS = (4, 6, 8, 10, 12, 16, 24, 32, 64, 128)
ROWS = 4096       # rows of one matrix
CACHE = 48 << 20  # bytes of pieces of at most the widest bucket, with some 200 for each entry
_NONE = np.int32(2**31 - 1)


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes → rank from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_BUCKET = [next(k for k, w in enumerate(WIDTHS) if n <= w) for n in range(WIDTHS[-1] + 1)]


def _ascii_findall(pattern: str):
    """The pattern for texts of ASCII only, on the faster ``re``; None if it has parts not known here."""
    for a, b in (("\\s\\p{L}\\p{N}", "\t-\r A-Za-z0-9"), ("\\p{L}", "[A-Za-z]"), ("\\p{N}", "[0-9]"),
                 ("\\s", "[\t-\r ]"), ("\\S", "[^\t-\r ]")):
        pattern = pattern.replace(a, b)
    return None if "\\" in pattern else re.compile(pattern).findall


class PairTable:
    """(left id, right id) → merged id, by open addressing; misses give ``_NONE``."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2.5).bit_length())
        size = 1 << self.bits
        self.mask = np.int64(size - 1)
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, _NONE, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.keys[slot] < 0
            at, who = slot[free], left[free]
            self.keys[at] = keys[who]  # of several for one slot the last stays
            self.values[at] = values[who]
            lost = self.keys[slot] != keys[left]
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], _NONE)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] >= 0))
        slot = slot[open_]
        for _ in range(self.probes):
            if not len(open_):
                break
            slot = (slot + 1) & self.mask
            hit = self.keys[slot] == keys[open_]
            out[open_[hit]] = self.values[slot[hit]]
            go = ~hit & (self.keys[slot] >= 0)
            open_, slot = open_[go], slot[go]
        return out


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE):
        self.ranks, self.limit = ranks, cache
        self._any, self._ascii = regex.compile(pattern).findall, _ascii_findall(pattern)
        self.tokens: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self._size = np.array([len(x or b"") for x in self.tokens], np.int32)
        self._place = np.cumsum(self._size, dtype=np.int64) - self._size
        self._flat = np.frombuffer(b"".join(x or b"" for x in self.tokens), np.uint8)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.shift = len(self.tokens).bit_length()
        keys = (np.array(left, np.int64) << self.shift) | np.array(right, np.int64)
        self.pairs = PairTable(keys, np.array(merged, np.int32))
        self.known: dict[str, bytes] = {}
        self.held = 0

    def find(self, text: str) -> list[str]:
        return self._ascii(text) if self._ascii and text.isascii() else self._any(text)

    def _key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.int64) << self.shift) | b

    def _merge_rows(self, ids: np.ndarray, length: np.ndarray) -> list[bytes]:
        """Merge all rows to the end; ``ids`` is padded with -1."""
        final, ends = np.full(ids.shape, -1, np.int32), np.zeros(len(ids), np.int64)
        who = np.arange(len(ids))
        rank = self._ranks(ids)
        while len(who):
            at = rank.argmin(axis=1)  # the leftmost of the smallest
            best = rank[np.arange(len(who)), at]
            done = best == _NONE
            if done.any():
                final[who[done], :ids.shape[1]] = ids[done]
                ends[who[done]] = length[done]
                go = ~done
                who, ids, rank, length, at, best = who[go], ids[go], rank[go], length[go], at[go], best[go]
                if not len(who):
                    break
            length = length - 1
            width = max(int(length.max()), 2)
            col = np.arange(width, dtype=np.int32)
            behind = col > at[:, None]
            pick = ids[:, :width + 1] if ids.shape[1] > width else np.pad(ids, ((0, 0), (0, 1)), constant_values=-1)
            ids = np.where(behind, pick[:, 1:], pick[:, :-1])  # closes the gap behind the merged pair
            ids[np.arange(len(who)), at] = best
            pick = rank[:, :width] if rank.shape[1] >= width else np.pad(rank, ((0, 0), (0, 1)), constant_values=_NONE)
            rank = np.where(behind[:, :-1], pick[:, 1:], pick[:, :-1])
            for side in (-1, 0):  # only the two pairs around the new token change
                p = at + side
                inside = (p >= 0) & (p < length - 1)
                ok = np.flatnonzero(inside)
                rank[ok, p[ok]] = self.pairs.find(self._key(ids[ok, p[ok]], ids[ok, p[ok] + 1]))
            gone = np.flatnonzero(at == length - 1)  # the merged pair was the row's last
            gone = gone[at[gone] < rank.shape[1]]
            rank[gone, at[gone]] = _NONE
        flat = final[final >= 0].astype("<u4").tobytes()
        cuts = (4 * np.cumsum(ends)).tolist()
        return [flat[i:j] for i, j in zip([0, *cuts], cuts)]

    def _ranks(self, ids: np.ndarray) -> np.ndarray:
        a, b = ids[:, :-1], ids[:, 1:]
        there = b >= 0
        rank = np.full(a.shape, _NONE)
        rank[there] = self.pairs.find(self._key(a[there], b[there]))
        return rank

    def _merge_long(self, piece: bytes) -> bytes:
        """One long piece by the same rule: heap of (rank, place) over a linked list."""
        ids = [int(x) for x in self.first[np.frombuffer(piece, np.uint8)]]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        start = np.array(ids, np.int32)
        heap = [(r, i) for i, r in enumerate(self.pairs.find(self._key(start[:-1], start[1:])).tolist()) if r != _NONE]
        heapq.heapify(heap)
        alive = [True] * n

        def rank(i: int) -> int | None:
            j = after[i]
            return self.ranks.get(self.tokens[ids[i]] + self.tokens[ids[j]]) if j < n else None

        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or rank(i) != r:
                continue
            j = after[i]
            alive[j], ids[i], after[i] = False, r, after[j]
            if after[i] < n:
                before[after[i]] = i
            for p in (before[i], i):
                if p >= 0 and (x := rank(p)) is not None:
                    heapq.heappush(heap, (x, p))
        return np.array([x for x, a in zip(ids, alive) if a], "<u4").tobytes()

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """ids of new pieces, as bytes."""
        out: dict[str, bytes] = {}
        buckets: list[list[tuple[str, bytes]]] = [[] for _ in WIDTHS]
        for piece in pieces:
            raw = piece.encode("utf-8")
            if (i := self.ranks.get(raw)) is not None:
                out[piece] = i.to_bytes(4, "little")
            elif len(raw) > WIDTHS[-1]:
                out[piece] = self._merge_long(raw)
            else:
                buckets[_BUCKET[len(raw)]].append((piece, raw))
        for width, rows in zip(WIDTHS, buckets):
            for k in range(0, len(rows), ROWS):
                part = rows[k:k + ROWS]
                length = np.array([len(raw) for _, raw in part])
                ids = np.full((len(part), width), -1, np.int32)
                ids[np.arange(width) < length[:, None]] = self.first[np.frombuffer(b"".join(raw for _, raw in part), np.uint8)]
                out.update(zip((p for p, _ in part), self._merge_rows(ids, length)))
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """ids of whole texts as little-endian unsigned 32-bit integers."""
        cut = [self.find(t) if t else [] for t in texts]
        new = set().union(*cut).difference(self.known)
        got = self.learn(new)
        self.held += sum(200 + 2 * len(p) for p in got)
        if self.held > self.limit:
            now = set().union(*cut)
            self.known = {p: v for p, v in self.known.items() if p in now}
        self.known.update(got)
        out = [b"".join(map(self.known.__getitem__, pieces)) for pieces in cut]
        if self.held > self.limit:
            self.forget()
        for p in got:
            if len(p) > WIDTHS[-1]:
                self.known.pop(p, None)
        return out

    def forget(self) -> None:
        self.known, self.held = {}, 0

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode_all(self, texts: list[bytes]) -> list[bytes]:
        """The bytes of encoded texts: token bytes gathered from one flat vocabulary."""
        ids = np.frombuffer(b"".join(texts), "<u4")
        size = self._size[ids]
        ends = np.cumsum(size)
        out = np.empty(int(ends[-1]) if len(ids) else 0, np.uint8)
        for i in range(0, len(ids), 1 << 16):
            n = size[i:i + (1 << 16)]
            to = int(ends[i] - size[i])
            total = int(n.sum())
            place = np.repeat(self._place[ids[i:i + (1 << 16)]] - (np.cumsum(n) - n), n)
            out[to:to + total] = self._flat[place + np.arange(total)]
        cuts = np.r_[0, ends][np.cumsum([0, *[len(t) // 4 for t in texts]])].tolist()
        return [out[i:j].tobytes() for i, j in zip(cuts, cuts[1:])]

    def decode(self, ids: bytes) -> bytes:
        return self.decode_all([ids])[0]


_CODECS: dict[str, Codec] = {}


def _codec(mark: str, load) -> Codec:
    """The worker's codec of one rank file and pattern."""
    if mark not in _CODECS:
        _CODECS.clear()
        _CODECS[mark] = load()
    return _CODECS[mark]


def _parts(batch: pa.RecordBatch, size: int = 1 << 22):
    """Slices of a batch of some 4 MB of text (a longer text alone)."""
    _, offsets = X.text_bytes(batch.column("text"))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                 with_ids: bool = False) -> DataFrame:
    """One row per document: id_col, n_tokens, ids_sha256, decoded_sha256 (of the ids decoded again);
    ``with_ids`` adds input_ids (array of int). The rank file is read by the driver and broadcast:
    its size is that of the vocabulary, whatever the documents."""
    spark = docs.sparkSession
    X.ready(spark)
    ranks = load_ranks(ranks_path)
    if len(ranks) > 1_000_000:
        raise ValueError("a vocabulary of over a million tokens isn't broadcast")
    mark = hashlib.sha256(repr((sorted(ranks.items())[:1000], len(ranks), sum(ranks.values()), pattern, ranks_path)).encode()).hexdigest()
    sent = spark.sparkContext.broadcast(ranks)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = [rows.schema["id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("input_ids", T.ArrayType(T.IntegerType())))

    def run(batches):
        codec = _codec(mark, lambda: Codec(sent.value, pattern))
        for b in X.releasing(batches, codec.forget):
            for part in _parts(b):
                ids = codec.encode_all(part.column("text").to_pylist())
                cols = [part.column("id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in codec.decode_all(ids)], pa.string())]
                if with_ids:
                    ends = np.cumsum([0, *[len(x) // 4 for x in ids]]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields)).withColumnRenamed("id", id_col)


def decode_ids(rows: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "input_ids") -> DataFrame:
    """One row per row: id_col, decoded (binary). Unknown ids raise; null ids decode to no bytes."""
    spark = rows.sparkSession
    X.ready(spark)
    sent = spark.sparkContext.broadcast({i: b for b, i in load_ranks(ranks_path).items()})
    rows = rows.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<long>").alias("ids"))

    def run(batches):
        for b in batches:
            out = [b"".join(map(sent.value.__getitem__, x)) if x else b"" for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary())], names=["id", "decoded"])

    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("decoded", T.BinaryType())])).withColumnRenamed("id", id_col)
