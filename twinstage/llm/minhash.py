"""MinHash near-duplicates by a signature-coordinate inverted join.

Texts with the same set of shingles form one class; all further work is on classes,
so exact copies cost one aggregate and never meet each other. Every class posts
itself under its (coordinate, value) pairs, rarest value first. Two classes that
agree on at least ``threshold`` of ``lanes`` coordinates must share one of the
first ``lanes - threshold + 1`` values in that order (the prefix); the values
behind it are skipped, and so is every class whose prefix holds only values of its
own. Collisions are then counted over the whole signatures, pairs below the
threshold, or whose set sizes rule the similarity out, are dropped, and what is left is
confirmed on the full shingle sets.

Components need no pair twice. A first round pairs each posting with the first
class of its list (linear in the postings). A second round pairs, inside a list,
only classes that are still in different components, and only if one of the two is
outside the list's largest component. Who meets anyone is found by semi-joins; then the
sets travel with the postings, and a pair is confirmed inside the join, at its first
common value: a group of near copies never expands into its pairs, only links leave
the join. Both rounds are plain equi-joins, which Spark splits at hot keys.

A pair at a similarity of exactly 0.8 agrees on fewer than 13 of 32 coordinates
with a probability of 2e-7; above 0.8 it is less. Nothing else can lose a link.

Edge cases: a null, empty or blank text has no shingles, is linked with nothing and
is its own component; a text with fewer words than the shingle length has its whole
word sequence as its one shingle; rows that repeat a text share a component, rows
that repeat an id too; a null id is no candidate for the smallest id, and such a row
is kept only if its component has no other id. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as X

LANES, THRESHOLD = 32, 13
_RAND = np.random.RandomState(77)
_MUL = _RAND.randint(0, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RAND.randint(0, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64)


def shingle_sets(col, shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row of an Arrow string column."""
    data, offsets = X.text_bytes(col)
    data = X.lower_ascii(data)
    starts, ends, first = X.word_spans(data, offsets)
    words = X.span_hashes(data, starts, ends)
    for i, j in zip(first[:-1], first[1:]):
        yield np.unique(X.shingle_hashes(words[i:j], shingle))


def signature(hashes: np.ndarray, lanes: int) -> np.ndarray:
    low = np.full(lanes, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(hashes), 4096):
        h = hashes[i:i + 4096, None] * _MUL[:lanes] + _ADD[:lanes]
        np.minimum(low, (h >> np.uint64(32)).min(axis=0), out=low)
    return low.astype(np.uint32).view(np.int32)


def fingerprints(rows: DataFrame, text: str, shingle: int, lanes: int | None) -> DataFrame:
    """``rows`` (its other columns kept) with n_shingles, cls (digest of the set, null without words)
    and, if ``lanes`` is given, sig in place of the text."""
    keep = [f for f in rows.schema.fields if lanes is None or f.name != text]
    extra = [T.StructField("n_shingles", T.LongType()), T.StructField("cls", T.BinaryType())]
    if lanes is not None:
        extra.append(T.StructField("sig", T.ArrayType(T.IntegerType())))

    def run(batches):
        for b in batches:
            n, cls, sig = [], [], []
            for s in shingle_sets(b.column(text), shingle):
                n.append(len(s))
                cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if lanes is not None:
                    sig.append(signature(s, lanes) if len(s) else None)
            cols = [b.column(f.name) for f in keep]
            cols += [pa.array(n, pa.int64()), pa.array(cls, pa.binary())]
            if lanes is not None:
                cols.append(pa.array(sig, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in keep] + [f.name for f in extra])

    return rows.mapInArrow(run, T.StructType(keep + extra))


def _postings(classes: DataFrame, lanes: int, threshold: int) -> DataFrame:
    """(key, cls, rep, n, sig): the prefix postings of every class that shares a value with another."""
    coords = classes.select("cls", F.posexplode("sig").alias("lane", "value")).select(
        "cls", F.xxhash64("lane", "value").alias("key"))
    shared = coords.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = coords.join(shared, "key").groupBy("cls").agg(
        F.sort_array(F.collect_list(F.struct("df", "key"))).alias("held"))  # at most `lanes` entries
    room = F.lit(lanes - threshold + 1) - (F.lit(lanes) - F.size("held"))  # values of its own come first
    prefix = F.slice("held", F.lit(1), F.greatest(room, F.lit(0)))
    return (held.select("cls", prefix.alias("held")).where(F.size("held") > 0)
            .join(classes.select("cls", "rep", "n", "sig"), "cls")
            .select(F.explode("held.key").alias("key"), "cls", "rep", "n", "sig"))


def _near_sizes(x: str, y: str, percent: int):
    """Sets of such sizes can reach the similarity at all."""
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _collisions(a: str, b: str):
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))


def _sets(wanted: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """(cls, hashes): the full shingle set of each wanted class, made anew from the text of one member."""
    wanted = wanted.distinct().join(classes.select("cls", "rep", "mark"), "cls")

    def sets(batches):
        for b in batches:
            got = list(shingle_sets(b.column("text"), shingle))
            cls = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in got]
            keep = pa.array([c == w for c, w in zip(cls, b.column("cls").to_pylist())], pa.bool_())
            out = pa.RecordBatch.from_arrays([b.column("cls"), pa.array([s.view(np.int64) for s in got], pa.list_(pa.int64()))],
                                             names=["cls", "hashes"])
            yield out.filter(keep)

    # by id and text: rows of a null or repeated id meet the class of their own text only
    rows = docs.select("id", "text", F.xxhash64("text").alias("own"))
    full = (rows.join(wanted, rows["id"].eqNullSafe(wanted["rep"]) & (rows["own"] == wanted["mark"])).select("cls", "text")
            .mapInArrow(sets, "cls binary, hashes array<long>").groupBy("cls").agg(F.first("hashes").alias("hashes")))
    return X.stored(full, "sets")


def _similar(x, y, percent: int):
    """100 * intersection >= percent * union, on full sets."""
    both = F.size(F.array_intersect(x, y))
    return 100 * both >= percent * (F.size(x) + F.size(y) - both)


def _semi(rows: DataFrame, others: DataFrame, cond) -> DataFrame:
    return rows.join(others.withColumnRenamed("key", "o_key"), (F.col("key") == F.col("o_key")) & cond, "left_semi")


def near_duplicate_classes(docs: DataFrame, shingle: int = 5, percent: int = 80, lanes: int = LANES,
                           threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """From docs (id, text): (members: id, n_shingles, cls; classes: cls, rep, root, component_id). ``mark``: a hash
    of the text of the class's row of the smallest id."""
    X.ready(docs.sparkSession)
    members = X.stored(fingerprints(docs.select("id", "text", F.xxhash64("text").alias("mark")), "text", shingle, lanes), "signatures")
    head = F.min(F.struct(F.col("id").isNull(), "id", "mark")).alias("m")  # a null id only where there is no other
    classes = members.where(F.col("cls").isNotNull()).groupBy("cls").agg(
        head, F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = X.stored(classes.select("cls", F.col("m.id").alias("rep"), F.col("m.mark").alias("mark"), "n", "sig"), "classes")
    posted = X.stored(_postings(classes, lanes, threshold), "postings")

    pivot = posted.groupBy("key").agg(F.min(F.struct("rep", "cls", "n", "sig")).alias("p"))
    first = (posted.join(pivot, "key").where((F.col("cls") != F.col("p.cls")) & _near_sizes("n", "p.n", percent))
             .where(_collisions("sig", "p.sig") >= threshold)
             .select(F.greatest("cls", "p.cls").alias("a"), F.least("cls", "p.cls").alias("b")).distinct())
    first = X.stored(first, "pairs")
    full = _sets(first.select(F.explode(F.array("a", "b")).alias("cls")), docs, classes, shingle)
    x, y = full.toDF("a", "x"), full.toDF("b", "y")
    links = X.stored(first.join(y, "b").join(x, "a").where(_similar("x", "y", percent)).select("a", "b"), "links")
    found = X.components(links)

    now = (posted.join(found.withColumnRenamed("node", "cls"), "cls", "left")
           .withColumn("root", F.coalesce("root", "cls")))
    sizes = now.groupBy("key", "root").agg(F.count(F.lit(1)).alias("members"))
    largest = (sizes.groupBy("key").agg(F.max(F.struct("members", "root")).alias("m"), F.count(F.lit(1)).alias("k"))
               .where("k > 1").select("key", F.col("m.root").alias("top")))
    open_ = X.stored(now.join(largest, "key").select("key", "cls", "root", "n", "sig", (F.col("root") == F.col("top")).alias("main")), "open")

    # who meets anyone of another component at all (no pairs yet), then the meeting itself: the sets come along,
    # so that a pair is confirmed where it arises, at its first common value, and only links leave the join
    def other(d: DataFrame) -> DataFrame:
        return d.select("key", *[F.col(c).alias(f"o_{c}") for c in d.columns if c != "key"])

    apart = (F.col("root") != F.col("o_root")) & _near_sizes("n", "o_n", percent) & (_collisions("sig", "o_sig") >= threshold)
    outside = X.stored(_semi(open_.where(~F.col("main")), other(open_), apart), "outside")
    inside = _semi(open_.where("main"), other(outside), apart)
    both = X.stored(outside.union(inside), "meeting")
    full = _sets(both.select("cls"), docs, classes, shingle)
    keys = both.groupBy("cls").agg(F.collect_set("key").alias("keys"))  # at most `lanes` of them
    both = both.join(keys, "cls").join(full, "cls").withColumn("before", F.filter("keys", lambda k: k < F.col("key"))).drop("keys")
    once = ~F.arrays_overlap("before", "o_before")  # the cheap conditions stand first
    more = (both.where(~F.col("main")).join(other(both), "key")
            .where((F.col("o_main") | (F.col("cls") < F.col("o_cls"))) & (F.col("root") != F.col("o_root"))
                   & _near_sizes("n", "o_n", percent) & once & (_collisions("sig", "o_sig") >= threshold)
                   & _similar("hashes", "o_hashes", percent))
            .select(F.col("cls").alias("a"), F.col("o_cls").alias("b")))
    more = X.stored(more, "links")
    # the second round's links join components of the first: only their roots are worked on
    ends = more.select(F.struct("a", "b").alias("link"), F.explode(F.array("a", "b")).alias("node"))
    ends = ends.join(found, "node", "left").groupBy("link").agg(F.min(F.coalesce("root", "node")).alias("a"),
                                                                 F.max(F.coalesce("root", "node")).alias("b"))
    merged = X.components(ends.select("a", "b")).select(F.col("node").alias("root"), F.col("root").alias("top"))
    found = found.withColumnRenamed("node", "cls")

    labelled = classes.select("cls", "rep").join(found, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    labelled = labelled.join(merged, "root", "left").select("cls", "rep", F.coalesce("top", "root").alias("root"))
    lowest = labelled.groupBy("root").agg(F.min("rep").alias("component_id"))
    return members.select("id", "n_shingles", "cls"), X.stored(labelled.join(lowest, "root"), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    percent: int = 80, lanes: int = LANES, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id, kept."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    members, classes = near_duplicate_classes(rows, shingle, percent, lanes, threshold)
    out = members.join(classes.select("cls", "component_id"), "cls", "left")
    lowest = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", lowest.alias("component_id"),
                      F.col("id").eqNullSafe(lowest).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                         percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each near-duplicate group: one of its smallest
    id. Rows without words all stay."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    _, classes = near_duplicate_classes(rows, shingle, percent)
    chosen = (classes.where(F.col("rep").eqNullSafe(F.col("component_id"))).groupBy("root")
              .agg(F.min(F.struct("cls", "rep")).alias("c")).select("c.cls", _text_key("c.rep").alias("key"), F.lit(True).alias("pick")))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), _text_key(docs[id_col]).alias("key"),
                        docs[text_col].alias("text"))
    tagged = fingerprints(whole, "text", shingle, None)
    nth = F.row_number().over(Window.partitionBy("key", "cls").orderBy("key"))  # 2 and more: rows that repeat id and text
    kept = tagged.join(chosen, ["key", "cls"], "left").where(F.col("cls").isNull() | F.col("pick")).withColumn("nth", nth)
    return kept.where(F.col("cls").isNull() | (F.col("nth") == 1)).select("row.*")


def _text_key(c):
    """An id as text, null as a text that no integer has: a key for plain joins."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("null"))
