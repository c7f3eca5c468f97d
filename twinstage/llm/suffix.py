"""Suffix-array dedup by bucket-pointer refinement: bytes of repeated strings are removed.

A byte goes if a string of ``length`` bytes that covers it also starts in a document
with a smaller id. Strings are bytes of UTF-8, judged on the input, and never cross
documents. Only suffixes that can matter are bucketed, and only to the depth asked for:

1. *Initial q-gram buckets.* Every string of ``length`` bytes belongs to the smallest
   hash among its q-grams (q = length / 2; leftmost on ties), its anchor; equal strings
   have equal anchors at equal places. One anchor serves some 13 neighbouring strings of
   50 bytes. Each group of documents sends its distinct anchors to the bucket's task,
   which answers with one bit each: does the bucket hold more than one document?
2. *Refinement.* For anchors that do, a group sends what stands left and right of the
   anchor (distinct records only, with the smallest id). The task sorts each bucket on
   the words at later offsets, 8 bytes at a time; the bucket numbers so made are the
   key of the next, and buckets of one are done. Longest common prefixes of neighbours
   then give the bucket of every shorter prefix, so each string's bucket is a pair of
   numbers, and its smallest id one reduction. Comparisons are on the bytes; only the
   q-gram of the anchor itself is represented by 64 bits.
   *Hot anchors*, of more than some ``hot`` places in all texts, have as many records as
   documents where what stands around them differs (edges of a passage, phrases of 25 to
   49 bytes), so they are split: a group sends their strings of ``length`` bytes instead,
   distinct ones as 128 bits of hash with the smallest id, dealt out by that hash.
3. Answers (a bit per string) return to the documents, which drop the covered bytes.

What is shuffled: the texts once, 8 bytes for about every 13 bytes of text, and some 66
bytes for each anchor of repeated text. Groups hold about ``group_bytes`` of text and
send each anchor, record and string once however often they hold it. So the inside of a
passage adds one record a group, and so does each string of a hot anchor; anchors with
differing neighbours add one record a document until they are hot. What meets in one task
for a single key is at most about ``hot`` records, or for one anchor (9 bytes) or one string
(24 bytes) an entry a group. Groups are dealt by id and text, so rows of a null or repeated id
meet only where their texts are equal too. No task sees more than one group of documents or one bucket
range; texts longer than a block are cut into
overlapping blocks.

Edge cases: a null text counts as empty; texts shorter than ``length`` stay whole; rows
with the same id do not remove each other's bytes; a null id counts as larger than all
others (but not larger than another null). Empty tables give empty results. Where a cut
leaves part of a UTF-8 character, ``kept_text`` leaves that part out, the digest does not.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as X

GROUP_BYTES = 2 << 20
BLOCK = 1 << 17
HOT = 1 << 16  # places of an anchor from which its strings are dealt out
_NO_ID = np.iinfo(np.int64).max


# ---------------------------------------------------------------------------
# anchors of one group of documents
# ---------------------------------------------------------------------------

def _blocks(offsets: np.ndarray) -> list[int]:
    """Cuts of a group's bytes: at starts of documents, and inside documents longer than a block at
    multiples of it, so that they do not depend on the order of the documents."""
    cuts = [0]
    for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if j - cuts[-1] > BLOCK:
            if i > cuts[-1]:
                cuts.append(i)
            cuts += range(i + BLOCK, j, BLOCK)
    return [*cuts, int(offsets[-1])]


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """(at, low, high, hash): strings starting at low..high have their anchor q-gram at ``at``."""
    q = length // 2
    span = length - q + 1
    up, down = X.powers(BLOCK + 2 * length)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    parts = []
    cuts = _blocks(offsets)
    for s, e in zip(cuts, cuts[1:]):
        n = min(e, len(data) - length + 1) - s  # strings that start in this block
        if n <= 0:
            break
        seg = data[s:s + n + length - 1]
        total = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(X.BYTE_CODES[seg] * up[:len(seg)], out=total[1:])
        h = X.mix64((total[q:] - total[:-q]) * down[:len(seg) - q + 1])
        key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        low, width = key, 1
        while width < span:  # sliding minimum by doubling
            step = min(width, span - width)
            low = np.minimum(low[:-step], low[step:])
            width += step
        at = (low[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ok = np.arange(s, s + n) + length <= ends[s:s + n]
        new = np.ones(n, bool)
        new[1:] = (at[1:] != at[:-1]) | ~ok[:-1]
        first = np.flatnonzero(new & ok)
        stop = np.ones(n, bool)
        stop[:-1] = (at[1:] != at[:-1]) | ~ok[1:]
        last = np.flatnonzero(stop & ok)
        # an anchor's hash is a minimum, so small: mixed again, its leading bits deal buckets out evenly
        parts.append((at[first] + s, first + s, last + s, X.mix64(h[at[first]] + np.uint64(0x9E3779B97F4A7C15))))
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _group(table: pa.Table, length: int):
    data, offsets = X.text_bytes(table.column("text"))
    ids = table.column("id").fill_null(_NO_ID).to_numpy()
    at, low, high, h = _anchors(data, offsets, length)
    rows = np.searchsorted(offsets, at, "right") - 1
    order = np.argsort(h, kind="stable")
    return data, offsets, ids, at[order], low[order], high[order], h[order], ids[rows[order]]


def _first_of_runs(x: np.ndarray) -> np.ndarray:
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new)


def _slices(h: np.ndarray, bits: int):
    """(bucket, from, to) of sorted hashes, by their leading bits."""
    if not len(h):
        return
    bucket = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    cuts = _first_of_runs(bucket)
    for i, j in zip(cuts, np.r_[cuts[1:], len(h)]):
        yield int(bucket[i]), int(i), int(j)


def _records(data, at, low, high, h, ids, length: int):
    """Distinct records of shared anchors, sorted by hash: (rep, record of each anchor, words, smallest id).

    A record is q left and q right bytes (those that the strings need, else 0) and the range of
    offsets of the anchor in its strings, as 64-bit words.
    """
    q, right = length // 2, length - length // 2
    width = length + (0 if length % 2 == 0 else 1) + 2
    width += -width % 8
    pad = np.concatenate([np.zeros(right, np.uint8), data, np.zeros(length, np.uint8)])
    rel = np.r_[np.arange(-right, 0), np.arange(q, q + right)]
    body = np.zeros((len(at), width), np.uint8)
    for i in range(0, len(at), 1 << 15):
        pos = at[i:i + (1 << 15), None] + rel
        got = pad[pos + right]
        got[(pos < low[i:i + (1 << 15), None]) | (pos >= high[i:i + (1 << 15), None] + length)] = 0
        body[i:i + (1 << 15), :2 * right] = got
    body[:, 2 * right] = at - high
    body[:, 2 * right + 1] = at - low
    words = body.view(np.uint64)
    rep, record = _distinct(h, words)
    least = np.full(len(rep), _NO_ID)
    np.minimum.at(least, record, ids)
    return rep, record, words, least


def _distinct(h: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each distinct (hash, words), number of that for each row), in the order of hash, words."""
    mark = h.copy()
    for j in range(words.shape[1]):
        mark = X.mix64(mark * np.uint64(0x9FB21C651E98DF25) + words[:, j])
    order = np.lexsort((mark, h))
    hs, ws = h[order], words[order]
    new = np.ones(len(order), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1]).any(axis=1)
    number = np.cumsum(new) - 1
    record = np.empty(len(order), np.int64)
    record[order] = number
    return order[new], record


def _strings(data, low, high, ids, length: int):
    """Strings of hot anchors: (start of each, its number among the distinct ones, and of these two hashes
    and the smallest id), distinct ones sorted by hash."""
    many = high - low + 1
    starts = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    one, two = np.zeros(len(starts), np.uint64), np.ones(len(starts), np.uint64)
    width = length + (-length % 8)
    for i in range(0, len(starts), 1 << 15):
        at = starts[i:i + (1 << 15)]
        body = np.zeros((len(at), width), np.uint8)
        body[:, :length] = data[at[:, None] + np.arange(length)]
        for w in body.view(np.uint64).T:
            one[i:i + (1 << 15)] = X.mix64(one[i:i + (1 << 15)] * np.uint64(0x9FB21C651E98DF25) + w)
            two[i:i + (1 << 15)] = X.mix64(two[i:i + (1 << 15)] * np.uint64(0xC2B2AE3D27D4EB4F) ^ w)
    rep, number, least = _least(one, two, np.repeat(ids, many))
    return starts, number, one[rep], two[rep], least


def _least(one, two, ids):
    """(first row of each distinct pair, number of the pair of each row, its smallest id), sorted by pair."""
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new)) if len(order) else ids
    return order[new], number, least


# ---------------------------------------------------------------------------
# one range of buckets
# ---------------------------------------------------------------------------

def refine(bucket: np.ndarray, later: np.ndarray, active: np.ndarray) -> np.ndarray:
    """New bucket numbers: rows of one bucket are told apart by ``later``. Numbers keep the order, and
    each is the place of its bucket's first row, so untouched buckets keep theirs. Only rows of
    ``active`` (in buckets of two or more) are sorted."""
    out = bucket.copy()
    order = active[np.lexsort((later[active], bucket[active]))]
    b, w = bucket[order], later[order]
    place = np.arange(len(order))
    fresh = np.ones(len(order), bool)
    fresh[1:] = b[1:] != b[:-1]
    begin = np.maximum.accumulate(np.where(fresh, place, 0))  # first row of the old bucket
    split = fresh.copy()
    split[1:] |= w[1:] != w[:-1]
    out[order] = b + (np.maximum.accumulate(np.where(split, place, 0)) - begin)
    return out


def _prefix_order(first: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows by (first, bytes of side) by refinement; (order, common prefix with the row before)."""
    n, m = side.shape
    _, start, inverse = np.unique(first, return_index=True, return_inverse=True)
    size = np.bincount(inverse)
    bucket = (np.cumsum(size) - size)[inverse]
    wide = np.zeros((n, m + (-m % 8)), np.uint8)
    wide[:, :m] = side
    words = wide.view(">u8").astype(np.uint64)
    for j in range(words.shape[1]):
        held = np.bincount(bucket, minlength=n)
        active = np.flatnonzero(held[bucket] > 1)
        if not len(active):
            break
        bucket = refine(bucket, words[:, j], active)
    order = np.argsort(bucket, kind="stable")
    same = side[order[1:]] == side[order[:-1]]
    common = np.where(same.all(axis=1), m, np.argmin(same, axis=1))
    common[first[order[1:]] != first[order[:-1]]] = -1
    return order, np.r_[-1, common]


def _smallest_ids(h: np.ndarray, words: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """For distinct records: smallest id of each string, by the anchor's offset in it (columns)."""
    q, right = length // 2, length - length // 2
    body = words.view(np.uint8).reshape(len(h), -1)
    lo, hi = body[:, 2 * right].astype(np.int64), body[:, 2 * right + 1].astype(np.int64)
    out = np.repeat(least[:, None], length - q + 1, axis=1)
    _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(count[inverse] > 1)
    if not len(mixed):
        return out
    h, lo, hi, least = inverse[mixed], lo[mixed], hi[mixed], least[mixed]
    r_order, r_common = _prefix_order(h, body[mixed, right:2 * right])
    l_order, l_common = _prefix_order(h, body[mixed, right - 1::-1] if right else body[mixed, :0])
    number = np.empty(len(mixed), np.int64)
    other = np.empty(len(mixed), np.int64)
    for t in range(length - q + 1):  # t bytes of the string stand before the anchor
        use = np.flatnonzero((lo <= t) & (t <= hi))
        if not len(use):
            continue
        number[r_order] = np.cumsum(r_common < length - q - t)
        other[l_order] = np.cumsum(l_common < t)
        order = use[np.lexsort((other[use], number[use]))]
        new = np.ones(len(order), bool)
        new[1:] = (number[order[1:]] != number[order[:-1]]) | (other[order[1:]] != other[order[:-1]])
        cuts = np.flatnonzero(new)
        low = np.minimum.reduceat(least[order], cuts)
        out[mixed[order], t] = np.repeat(low, np.diff(np.r_[cuts, len(order)]))
    return out


# ---------------------------------------------------------------------------
# the Spark job
# ---------------------------------------------------------------------------

_ROW1 = "bucket long, grp long, hashes binary, many binary"
_ROW2 = "bucket long, grp long, hashes binary, ids binary, words binary"
_REPLY = "grp long, kind int, bucket long, bits binary"


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, cols, types)})


def _joined(col, dtype) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), dtype) for x in col]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _shared(h: np.ndarray, replies: dict[int, bytes], bits: int) -> np.ndarray:
    """For sorted hashes: the bits of the replies (kind 1: is the anchor in more than one document? 3: is it
    hot?); none where a bucket gave no reply."""
    first = _first_of_runs(h)
    return np.repeat(_bits(h[first], replies, bits), np.diff(np.r_[first, len(h)]))


def _bits(u: np.ndarray, replies: dict[int, bytes], bits: int) -> np.ndarray:
    """A bit for each entry of ``u``, in the order in which they were sent."""
    flag = np.zeros(len(u), bool)
    for bucket, i, j in _slices(u, bits):
        if bucket in replies:
            flag[i:j] = np.unpackbits(np.frombuffer(replies[bucket], np.uint8), count=j - i).astype(bool)
    return flag


def _replies(table: pa.Table, kind: int) -> dict[int, bytes]:
    return {b: v for k, b, v in zip(*(table.column(c).to_pylist() for c in ("kind", "bucket", "bits"))) if k == kind}


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50,
                   group_bytes: int = GROUP_BYTES, with_text: bool = False, hot: int = HOT) -> DataFrame:
    """One row per document: id_col, n_bytes, n_removed, n_spans, kept_sha256; with ``with_text``
    also kept_text (null for a null text) and row, a struct of the document's own columns without the text."""
    if not 8 <= length <= 62:
        raise ValueError("length: 8 to 62 bytes")
    X.ready(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    groups = max(1, round(total / group_bytes))
    bits = max(0, min(40, int(total / group_bytes / 2).bit_length()))
    span = length - length // 2 + 1
    every = np.int64(1) << np.arange(span, dtype=np.int64)
    others = [F.col(c) for c in docs.columns if c != text_col]
    rows = docs.select(
        F.pmod(F.xxhash64(id_col, text_col, F.lit(3)), F.lit(groups)).alias("grp"), F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([F.col(text_col).isNull().alias("none"), F.struct(*others).alias("row")] if with_text else []))
    binary = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def anchors(key, table):
        _, _, _, _, _, _, h, ids = _group(table, length)
        first = _first_of_runs(h)
        many = (np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)) if len(h) else first
        u = h[first]
        # one byte: places in this group as a power of two (at least as many), and whether in several documents
        places = np.ceil(np.log2(np.diff(np.r_[first, len(h)]))).astype(np.uint8) | (many.astype(np.uint8) << np.uint8(7))
        return _table([(b, key[0].as_py(), u[i:j].tobytes(), places[i:j].tobytes())
                       for b, i, j in _slices(u, bits)], ["bucket", "grp", "hashes", "many"], binary)

    def repeated(key, table):
        sizes = [len(x.as_buffer()) // 8 for x in table.column("hashes")]
        h = _joined(table.column("hashes"), np.uint64)
        places = _joined(table.column("many"), np.uint8)
        _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        flag = (count > 1) | (np.bincount(inverse, weights=places >> np.uint8(7)) > 0)
        burning = np.bincount(inverse, weights=np.exp2(places & np.uint8(127))) > hot
        cuts = np.cumsum([0, *sizes])
        out = [(g, 1, key[0].as_py(), np.packbits(flag[inverse[i:j]]).tobytes())
               for g, i, j in zip(table.column("grp").to_pylist(), cuts[:-1], cuts[1:])]
        out += [(g, 3, key[0].as_py(), np.packbits(burning[inverse[i:j]]).tobytes())
                for g, i, j in zip(table.column("grp").to_pylist(), cuts[:-1], cuts[1:]) if burning[inverse[i:j]].any()]
        return _table(out, ["grp", "kind", "bucket", "bits"], [pa.int64(), pa.int32(), pa.int64(), pa.binary()])

    def records(key, table, answers):
        names = ["bucket", "grp", "hashes", "ids", "words"]
        if not table.num_rows:
            return _table([], names, [*binary, pa.binary()])
        data, _, _, at, low, high, h, ids = _group(table, length)
        use, burning = (_shared(h, _replies(answers, kind), bits) for kind in (1, 3))
        _, _, one, two, first = _strings(data, *(x[use & burning] for x in (low, high, ids)), length)
        at, low, high, h, ids = (x[use & ~burning] for x in (at, low, high, h, ids))
        rep, _, words, least = _records(data, at, low, high, h, ids, length)
        h, words = h[rep], words[rep]
        out = [(b, key[0].as_py(), h[i:j].tobytes(), least[i:j].tobytes(), words[i:j].tobytes()) for b, i, j in _slices(h, bits)]
        out += [(b + (1 << bits), key[0].as_py(), one[i:j].tobytes(), first[i:j].tobytes(), two[i:j].tobytes())
                for b, i, j in _slices(one, bits)]  # buckets of strings have numbers of their own
        return _table(out, names, [*binary, pa.binary()])

    def refined(key, table):
        sizes = [len(x.as_buffer()) // 8 for x in table.column("hashes")]
        h, ids = _joined(table.column("hashes"), np.uint64), _joined(table.column("ids"), np.int64)
        cuts = np.cumsum([0, *sizes])
        if key[0].as_py() >= 1 << bits:
            _, number, first = _least(h, _joined(table.column("words"), np.uint64), ids)
            out = [(g, 4, key[0].as_py() - (1 << bits), np.packbits(first[number[i:j]] < ids[i:j]).tobytes())
                   for g, i, j in zip(table.column("grp").to_pylist(), cuts[:-1], cuts[1:])]
            return _table(out, ["grp", "kind", "bucket", "bits"], [pa.int64(), pa.int32(), pa.int64(), pa.binary()])
        words = _joined(table.column("words"), np.uint64).reshape(len(h), -1)
        rep, record = _distinct(h, words)
        least = np.full(len(rep), _NO_ID)
        np.minimum.at(least, record, ids)
        low = _smallest_ids(h[rep], words[rep], least, length)
        mask = np.zeros(len(h), np.int64)
        for t in range(span):
            mask |= np.where(low[record, t] < ids, every[t], 0)
        out = [(g, 2, key[0].as_py(), mask[i:j].astype("<u4" if span <= 32 else "<i8").tobytes())
               for g, i, j in zip(table.column("grp").to_pylist(), cuts[:-1], cuts[1:])]
        return _table(out, ["grp", "kind", "bucket", "bits"], [pa.int64(), pa.int32(), pa.int64(), pa.binary()])

    out_types = [T.StructField("id", T.LongType()), T.StructField("n_bytes", T.LongType()),
                 T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
                 T.StructField("kept_sha256", T.StringType())]
    if with_text:
        out_types += [T.StructField("kept_text", T.StringType()), rows.schema["row"]]

    def cut(key, table, answers):
        data, offsets, _, at, low, high, h, ids = _group(table, length)
        n = table.num_rows
        taken = np.zeros(len(data), bool)  # where a string that goes starts
        if len(h):
            use, burning = (_shared(h, _replies(answers, kind), bits) for kind in (1, 3))
            starts, number, one, _, first = _strings(data, *(x[use & burning] for x in (low, high, ids)), length)
            gone = _bits(one, _replies(answers, 4), bits)
            own = np.repeat(ids[use & burning], (high - low + 1)[use & burning])
            taken[starts[gone[number] | (own > first[number])]] = True
            at, low, high, h, ids = (x[use & ~burning] for x in (at, low, high, h, ids))
            rep, record, _, least = _records(data, at, low, high, h, ids, length)
            got, verdict = _replies(answers, 2), np.zeros(len(rep), np.int64)
            for b, i, j in _slices(h[rep], bits):
                verdict[i:j] = np.frombuffer(got[b], "<u4" if span <= 32 else "<i8")
            mask = np.where(ids > least[record], every.sum(), verdict[record])
            for t in range(span):
                p = at - t
                taken[p[(mask & every[t] != 0) & (p >= low) & (p <= high)]] = True
        count = np.r_[np.zeros(length, np.int64), np.cumsum(taken)]
        gone = count[length:] > count[:-length]
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        edge = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[edge] = gone[edge]
        cum_gone, cum_runs = np.r_[0, np.cumsum(gone)], np.r_[0, np.cumsum(begins)]
        kept = data[~gone]
        at_kept = offsets - cum_gone[offsets]
        texts = [kept[i:j].tobytes() for i, j in zip(at_kept[:-1], at_kept[1:])]
        cols = [table.column("id"), pa.array(np.diff(offsets)), pa.array(np.diff(cum_gone[offsets])),
                pa.array(np.diff(cum_runs[offsets])), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
        if with_text:
            none = table.column("none").to_pylist()
            cols += [pa.array([None if z else x.decode("utf-8", "ignore") for x, z in zip(texts, none)], pa.string()),
                     table.column("row")]
        return pa.table(cols, names=[f.name for f in out_types])

    by_group = rows.groupBy("grp")
    found = by_group.applyInArrow(anchors, _ROW1).groupBy("bucket").applyInArrow(repeated, _REPLY)
    sent = by_group.cogroup(found.groupBy("grp")).applyInArrow(records, _ROW2)
    told = found.union(sent.groupBy("bucket").applyInArrow(refined, _REPLY))
    out = by_group.cogroup(told.groupBy("grp")).applyInArrow(cut, T.StructType(out_types))
    return out.withColumnRenamed("id", id_col)
