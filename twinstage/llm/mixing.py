"""Mixing sources to target weights by pivotal dependent rounding.

A document's size is its number of words. Sources share 100 % of all sizes by weight; a
target stops at ``max_copies`` times its source's size and the excess is shared again
by weight among the rest until none is above. A document of a source wants
target / source size copies: the whole part is certain, the fraction is rounded.

Rounding is pivotal: two documents of a source with a fraction each meet, and mass
(fraction × size) moves from one to the other, in a random direction with the
probabilities that keep both expectations, until one of them is 0 or 1. The sum of
fraction × size never changes, so what a source takes misses its target by less than
one document. The pairs form a reduction tree: documents of one source are dealt by a
hash of their id into leaves, each leaf leaves one residual document, ``FAN_IN``
residuals meet in the next node, until one per source is left, which a last draw
rounds. So a source with most rows is as many leaves as it needs. Random numbers come
from hashes of seed, source and id: reruns agree, whatever the partitioning.

Nothing about single sources comes to the driver: their order is a distributed sort
with offsets, the resharing a loop of one-row aggregates.

Edge cases: a null or empty text has size 0 and is taken 0 times; a null source is a
source of its own, last; rows that repeat an id are rounded each; a null id is allowed.
An empty table gives an empty result. If all sizes are 0 all targets are 0.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as X

LEAF_ROWS = 1_000
FAN_IN = 64
BROADCAST = 10_000  # keys of the mix that are sent to all tasks, by count; more are met by a shuffle


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_copies: float = 3.0) -> DataFrame:
    """From (source, size) per document: (source, n_rows, source_size, target) per source.

    Weights repeat over the sources in the order of their code points, null last.
    """
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    ordered = totals.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex().map(
        lambda x: (x[0].source, x[0].source_size, x[0].n_rows, float(weights[x[1] % len(weights)])))
    s = X.stored(spark.createDataFrame(ordered, T.StructType([
        sizes.schema["source"], T.StructField("source_size", T.LongType()), T.StructField("n_rows", T.LongType()),
        T.StructField("weight", T.DoubleType())])), "sources")
    limit = F.lit(float(max_copies)) * F.col("source_size")
    whole = s.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # words per unit of weight for sources below their limit; only ever rises
    while True:
        above = F.lit(level) * F.col("weight") > limit
        got = s.agg(F.sum(F.when(above, limit).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))),
                    F.sum(above.cast("long"))).first()
        stopped, open_weight, n = got[0] or 0.0, got[1] or 0.0, got[2] or 0
        new = (whole - stopped) / open_weight if open_weight > 0 else level
        if new == level or (level > 0 and n == n_before):
            break
        level, n_before = new, n
    return s.select("source", "n_rows", "source_size",
                    F.when(above, limit).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def _draw(seed: int, source: str | None, key: str) -> float:
    """A number in [0, 1) that depends on nothing else."""
    h = hashlib.blake2b(f"{seed}|{source!r}|{key}".encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(h, "little") / 2.0**64


def _pivot(rows: list[tuple], seed: int, source: str | None, level: int) -> tuple[list[tuple], tuple | None]:
    """Round (key, size, fraction) rows of one node: (decided (key, copies 0 or 1), the residual row or None)."""
    out, held = [], None
    for row in rows:
        key, size, p = row
        if p <= 0.0 or p >= 1.0:
            out.append((key, int(p >= 1.0)))
        elif held is None:
            held = row
        else:
            k2, s2, p2 = held
            up = min((1.0 - p) * size, p2 * s2)    # mass that can move to this row
            down = min(p * size, (1.0 - p2) * s2)  # and from it
            if _draw(seed, source, f"{level}|{key}|{k2}") * (up + down) < down:
                a, b = (1.0, p2 - up / s2) if up == (1.0 - p) * size else (p + up / size, 0.0)
                if a == 1.0 and up == p2 * s2:
                    b = 0.0
            else:
                a, b = (0.0, p2 + down / s2) if down == p * size else (p - down / size, 1.0)
                if a == 0.0 and down == (1.0 - p2) * s2:
                    b = 1.0
            held = None
            for k, s, x in ((key, size, a), (k2, s2, b)):
                if 0.0 < x < 1.0 and held is None:
                    held = (k, s, x)
                else:
                    out.append((k, int(x >= 0.5)))
    return out, held


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[float, ...] = (1, 2, 3), max_copies: float = 3.0, seed: int = 20240229,
                leaf_rows: int = LEAF_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: id_col, nth (number among the rows with this id, source and size), source_size,
    size, target, copies, taken."""
    X.ready(docs.sparkSession)
    size = F.when(F.col(text_col).isNull(), 0).otherwise(F.regexp_count(F.col(text_col), F.lit(X.WORD)))
    sizes = X.stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.cast("long").alias("size"))
                     .groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    one = sizes.select("id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("nth"))
    targets = X.stored(source_targets(one.select("source", "size"), weights, max_copies), "targets")
    # pandas and Arrow see the source as hex of its bytes, so that null and any text stay what they are
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    leaves = F.greatest(F.ceil(F.col("n_rows") / leaf_rows), F.lit(1)).cast("long")
    t = targets.select(F.col("source").alias("t_source"), rate.alias("rate"), leaves.alias("leaves"))
    items = one.join(t, F.col("source").eqNullSafe(F.col("t_source"))).select(
        "id", "source", "size", "nth", "rate", F.coalesce(F.hex("source"), F.lit("-")).alias("src"),
        F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("-")), "size", "nth").alias("key"),
        F.pmod(F.xxhash64(F.lit(seed), "id", "size", "nth"), F.col("leaves")).alias("node"),
        F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(F.lit(0.0)).alias("p"))
    schema = "src string, node long, key string, size long, p double, copies int"

    def reducer(level: int):
        def run(key, table):
            d = table.sort_by("key")
            rows = list(zip(d.column("key").to_pylist(), d.column("size").to_pylist(), d.column("p").to_pylist()))
            src, node = key[0].as_py(), key[1].as_py()
            rows.sort(key=lambda r: _draw(seed, src, f"order|{level}|{r[0]}"))
            done, held = _pivot(rows, seed, src, level)
            n = len(done)
            cols = {"key": [k for k, _ in done], "size": [None] * n, "p": [None] * n, "copies": [c for _, c in done]}
            if held:
                for c, v in zip(("key", "size", "p", "copies"), (*held, None)):
                    cols[c].append(v)
            m = len(cols["key"])
            return pa.table({"src": pa.array([src] * m, pa.string()), "node": pa.array([node // fan_in] * m, pa.int64()),
                             "key": pa.array(cols["key"], pa.string()), "size": pa.array(cols["size"], pa.int64()),
                             "p": pa.array(cols["p"], pa.float64()), "copies": pa.array(cols["copies"], pa.int32())})
        return run

    most = targets.agg(F.max(leaves)).first()[0] or 1
    step = X.stored(items.select("src", "node", "key", "size", "p").groupBy("src", "node")
                    .applyInArrow(reducer(0), schema), "round")
    decided, level = step.where(F.col("copies").isNotNull()).select("src", "key", "copies"), 0
    while most > 1:
        most, level = -(-most // fan_in), level + 1
        step = X.stored(step.where(F.col("copies").isNull()).select("src", "node", "key", "size", "p")
                        .groupBy("src", "node").applyInArrow(reducer(level), schema), "round")
        decided = decided.union(step.where(F.col("copies").isNotNull()).select("src", "key", "copies"))
    draw = F.pmod(F.xxhash64(F.lit(seed + 1), "src", "key"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    last = step.where(F.col("copies").isNull()).select("src", "key", (draw < F.col("p")).cast("int").alias("copies"))
    decided = decided.union(last)

    extra = decided.withColumnRenamed("copies", "more")
    got = items.join(extra, ["src", "key"]).join(targets.select(F.col("source").alias("s2"), "source_size", "target"),
                                                  F.col("source").eqNullSafe(F.col("s2")))
    copies = F.when(F.col("size") > 0, F.floor("rate") + F.col("more")).otherwise(0).cast("long")
    return got.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "nth", "size", "source_size", "target",
                      copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (0 to ``max_copies`` times).

    The mix is written once. A row that is alone with its id and source finds its copies by these: whole rows are
    neither sorted nor counted again. Only rows that share both are counted and numbered as in the mix.
    """
    mix = X.stored(mix_sources(docs, id_col, text_col, source_col, **options).select(
        F.col(id_col).alias("m_id"), F.col(source_col).alias("m_source"), F.col("size").alias("m_size"),
        F.col("nth").alias("m_nth"), "copies"), "mix")
    keys = X.stored(mix.groupBy("m_id", "m_source").agg(F.count(F.lit(1)).alias("m_rows"), F.min("copies").alias("copies")), "mix-keys")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("id"), docs[source_col].alias("source"))
    own = F.col("id").eqNullSafe(F.col("m_id")) & F.col("source").eqNullSafe(F.col("m_source"))
    alone = keys.where("m_rows = 1 and copies > 0")
    both = rows.join(alone.hint("shuffle_hash") if alone.count() > BROADCAST else F.broadcast(alone), own).select("row", "copies")
    shared = keys.where("m_rows > 1").select("m_id", "m_source")
    if not shared.isEmpty():
        size = F.when(F.col(f"row.`{text_col}`").isNull(), 0).otherwise(F.regexp_count(F.col(f"row.`{text_col}`"), F.lit(X.WORD))).cast("long")
        same = Window.partitionBy("id", "source", "size").orderBy("id")
        again = rows.join(shared, own, "left_semi").withColumn("size", size).withColumn("nth", F.row_number().over(same).cast("long"))
        both = both.union(again.join(mix.where("copies > 0"), own & (F.col("size") == F.col("m_size")) & (F.col("nth") == F.col("m_nth")))
                          .select("row", "copies"))
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
