"""Embedding near-duplicates by int8 tile products with proven error bounds.

Equal vectors of a label form one class with a count, so copies are never compared.
Classes of one (label, dimension) are dealt by a hash into blocks of about ``block``
rows; each pair of blocks is one task group, so a label with most rows is as many
groups as its size asks for and no task holds more than two blocks. In a group, unit
vectors are quantised to int8 with a scale of their own. Writing x = s·q + e, the norm
of e is known exactly for each vector, and

    |x·y − s_x s_y q_x·q_y| ≤ |e_x|·|s_y q_y| + |x|·|e_y|,

so a tile product of the int8 matrices (exact: sums stay far below 2^24 in float32,
longer vectors are summed in slices) leaves only the pairs that may reach the
threshold. These are computed in double precision, with norms and products as the
definition has them. No pair leaves the task: a group returns, per class, the number of
vectors it links with and one edge to a class of the same local component.

All rows of a label are compared, as asked: the number of tile products grows with the
square of a label's size, the rows shuffled with blocks × rows.

Edge cases: a null label, a null vector, one of norm 0 or with null or non-finite
components links with nothing and is its own component; vectors of different length
never link. Rows that repeat an id or a vector are vectors of their own; a null id is
no candidate for the smallest id. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as X

BLOCK = 2048
TILE = 512


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(q as float32 of int8 values, scale, norm of the error, norm of scale · q) of unit row vectors."""
    scale = np.abs(unit).max(axis=1) / 127.0
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    slack = 1e-12  # rounding of these norms themselves
    return (q.astype(np.float32), scale, np.linalg.norm(unit - back, axis=1) + slack,
            np.linalg.norm(back, axis=1) + slack)


def _exact(v: np.ndarray, norm: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for k in range(0, len(i), 1 << 14):
        a, b = i[k:k + (1 << 14)], j[k:k + (1 << 14)]
        out[k:k + (1 << 14)] = np.einsum("ij,ij->i", v[a], v[b]) / (norm[a] * norm[b])
    return out


def tile_links(v: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, tile: int = TILE):
    """Index pairs (i in left, j in right; each unordered pair once) with cosine ≥ threshold, tile by tile."""
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    q, scale, err, back = quantise(v / norm[:, None])
    same = left is right
    for a in range(0, len(left), tile):
        x = left[a:a + tile]
        for b in range(a if same else 0, len(right), tile):
            y = right[b:b + tile]
            dot = np.zeros((len(x), len(y)))
            for k in range(0, v.shape[1], 1024):  # 1024 · 127² < 2^24: each slice is exact
                dot += q[x, k:k + 1024] @ q[y, k:k + 1024].T
            dot *= scale[x][:, None] * scale[y]
            bound = err[x][:, None] * back[y] + err[y] * (1 + 1e-9) + 1e-9
            i, j = np.nonzero(dot + bound >= threshold)
            i, j = x[i], y[j]
            if same:
                i, j = i[i < j], j[i < j]
            hit = _exact(v, norm, i, j) >= threshold
            if hit.any():
                yield i[hit], j[hit]


def _local_roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index of each one's component."""
    root = np.arange(n)
    while pairs:
        before = root.copy()
        for i, j in pairs:
            low = np.minimum(root[i], root[j])
            np.minimum.at(root, root[i], low)
            np.minimum.at(root, root[j], low)
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def embedding_duplicates(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                         threshold: float = 0.93, block: int = BLOCK) -> DataFrame:
    """One row per vector: id_col, n_links, component_id, kept."""
    X.ready(rows.sparkSession)
    src = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"),
                      F.col(label_col).cast("string").alias("label"))

    def classes_of(batches):
        for b in batches:
            cls, vec = [], []
            for label, v in zip(b.column("label").to_pylist(), b.column("v")):
                x = None
                if label is not None and v.is_valid and len(v) and v.values.null_count == 0:
                    x = v.values.to_numpy() + 0.0
                    if not np.isfinite(x).all() or not 0 < (n := np.dot(x, x)) < np.inf:
                        x = None
                raw = None if x is None else x.tobytes()
                vec.append(raw)
                cls.append(None if raw is None else hashlib.blake2b(label.encode() + b"\0" + raw, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(cls, pa.binary()), pa.array(vec, pa.binary())],
                                             names=["id", "label", "cls", "vec"])

    members = X.stored(src.mapInArrow(classes_of, "id long, label string, cls binary, vec binary"), "vectors")
    usable = members.where(F.col("cls").isNotNull())
    classes = X.stored(usable.groupBy("cls").agg(F.first("label").alias("label"), F.first("vec").alias("vec"),
                                                 F.count(F.lit(1)).alias("n"), F.min("id").alias("low")), "classes")
    kinds = ["label", "dim"]
    sized = classes.withColumn("dim", F.octet_length("vec"))
    blocks = sized.groupBy(*kinds).agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks"))
    dealt = (sized.join(blocks, kinds)
             .withColumn("blk", F.pmod(F.xxhash64("cls"), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select(*kinds, F.least("blk", "other").alias("b1"), F.greatest("blk", "other").alias("b2"), "blk", "cls", "vec", "n"))

    def compare(key, table):
        v = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float64).reshape(table.num_rows, -1)
        blk, n = table.column("blk").to_numpy(), table.column("n").to_numpy()
        left = np.flatnonzero(blk == key[2].as_py())
        right = left if key[2].as_py() == key[3].as_py() else np.flatnonzero(blk == key[3].as_py())
        links, edges = np.zeros(len(v), np.int64), []
        for i, j in tile_links(v, left, right, threshold):
            links += np.bincount(i, n[j], len(v)).astype(np.int64) + np.bincount(j, n[i], len(v)).astype(np.int64)
            edges.append((i, j))
        root = _local_roots(len(v), edges)
        cls = table.column("cls")
        some = np.flatnonzero(links)
        return pa.table({"cls": cls.take(pa.array(some)), "links": pa.array(links[some]), "root": cls.take(pa.array(root[some]))})

    found = X.stored(dealt.groupBy(*kinds, "b1", "b2").applyInArrow(compare, "cls binary, links long, root binary"), "links")
    linked = found.groupBy("cls").agg(F.sum("links").alias("links"))
    comp = X.components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cls")
    own = (classes.select("cls", "n", "low").join(linked, "cls", "left").join(comp, "cls", "left")
           .select("cls", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), "low",
                   F.coalesce("root", "cls").alias("root")))
    lowest = own.groupBy("root").agg(F.min("low").alias("component"))
    own = own.join(lowest, "root").select("cls", "n_links", "component")
    out = members.select("id", "cls").join(own, "cls", "left")
    smallest = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      smallest.alias("component_id"), F.col("id").eqNullSafe(smallest).alias("kept"))
