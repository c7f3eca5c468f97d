"""Aggregations (A1–A10). Each is one hash aggregate with map-side partial
aggregation, so a hot class costs one row per map task, never a hot reducer."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .small import class_sized


def _all() -> Window:
    """Window over a whole class-sized table (never applied to row-sized data)."""
    return Window.partitionBy()


def class_counts(df: DataFrame, y: str) -> DataFrame:
    """A1: ``value_counts`` — (y, count) sorted by count desc, then class."""
    return (df.groupBy(y).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc(y)))


def class_shares(df: DataFrame, y: str) -> DataFrame:
    """A2: ``value_counts(normalize=True)``; the total comes from the k-row table."""
    c = df.groupBy(y).agg(F.count(F.lit(1)).alias("count"))
    return c.withColumn("share", F.col("count") / F.sum("count").over(_all()))


def top_classes(df: DataFrame, y: str, k: int) -> DataFrame:
    """A3: k most frequent classes, ties broken by name."""
    return class_counts(df, y).limit(k)


def balanced_weights(df: DataFrame, y: str) -> DataFrame:
    """A4: w_c = n / (k · n_c) (sklearn 'balanced')."""
    c = df.groupBy(y).agg(F.count(F.lit(1)).alias("count"))
    return c.withColumn(
        "weight",
        F.sum("count").over(_all()) / (F.count(F.lit(1)).over(_all()) * F.col("count")),
    )


def attach_weights(df: DataFrame, y: str, weights: DataFrame | None = None,
                   weight_col: str = "weight") -> DataFrame:
    """A5: per-row weight by a null-safe join on the class (a null class has its weight too).
    The class table is broadcast if it is small, by count; Spark splits hot classes if not."""
    w = weights if weights is not None else balanced_weights(df, y)
    w = class_sized(w.select(F.col(y).alias("_class"), F.col("weight").alias(weight_col)))
    return df.join(w, df[y].eqNullSafe(w["_class"]), "left").drop("_class")


def positive_weight(df: DataFrame, label: str) -> DataFrame:
    """n_neg / max(n_pos, 1)."""
    pos = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    neg = F.sum(F.when(F.col(label) == 1, 0).otherwise(1))
    return df.agg(pos.cast("long").alias("n_pos"), neg.cast("long").alias("n_neg"),
                  (neg / F.greatest(pos, F.lit(1))).alias("pos_weight"))


def medians(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Every column's interpolated median (as numpy / sklearn) — one row.

    Exact selection of the middle ranks of all columns together in a few scans. Null, NaN and ±inf are missing; a
    column without values has a null median.
    """
    from .rank import middle_values
    cols = list(cols)
    med = {c: (pair[0] + pair[1]) / 2.0 for c, pair in middle_values(df, cols).items() if pair}
    return df.sparkSession.range(1).select(*[F.lit(med.get(c)).cast("double").alias(c) for c in cols])


def modes(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Most frequent non-null value per column, ties → smallest — one row.

    Distributed: values of all columns are stacked as (column, value), counted by
    a hash aggregate, and the winner per column is a ``min_by`` over
    (−count, value), which also aggregates partially. No task holds a column's
    distinct values (``F.mode`` would, in its final merge).
    """
    cols = list(cols)
    if not cols:
        return df.sparkSession.range(1).select()
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(cols)])).alias("e")) \
        .where(F.col("e.v").isNotNull())
    counts = stacked.groupBy("e.i", "e.v").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("i").agg(F.min_by("v", F.struct((-F.col("n")).alias("m"), F.col("v").alias("v"))).alias("v"))
    wide = best.agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(c) for i, c in enumerate(cols)])
    return wide


def mean_std(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Mean and population std per column, one pass, long format (column, mean, std)."""
    cols = list(cols)
    wide = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("std"))
        for c in cols])).alias("r")).select("r.*")


def score_summary(scores: DataFrame, keys=("dataset", "model"), score: str = "macro_f1") -> DataFrame:
    """Mean and both spreads of fold scores per (dataset, model)."""
    return scores.groupBy(*keys).agg(
        F.count(score).cast("long").alias("n"),
        F.avg(score).alias("mean"),
        F.stddev_pop(score).alias("std_pop"),
        F.stddev_samp(score).alias("std_samp"),
    )


def profile(df: DataFrame) -> DataFrame:
    """Per column row count, nulls, min and max — in ONE pass (no distinct
    counts: several exact distincts would make Spark expand every row).

    Numeric min/max are reported as double, text min/max as string, so no
    engine-specific number formatting is involved.
    """
    from pyspark.sql import types as T

    structs = []
    aggs = [F.count(F.lit(1)).alias("__n")]
    for f in df.schema.fields:
        c, i = f.name, len(structs)
        numeric = isinstance(f.dataType, T.NumericType)
        aggs += [
            F.count(F.when(F.col(c).isNull(), 1)).alias(f"__null{i}"),
            F.min(c).alias(f"__min{i}"),
            F.max(c).alias(f"__max{i}"),
        ]
        num = lambda x: F.col(x).cast("double") if numeric else F.lit(None).cast("double")
        txt = lambda x: F.lit(None).cast("string") if numeric else F.col(x).cast("string")
        structs.append(F.struct(
            F.lit(c).alias("column"), F.lit(i).alias("position"), F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col("__n").cast("long").alias("n_rows"), F.col(f"__null{i}").cast("long").alias("n_null"),
            num(f"__min{i}").alias("min_num"), num(f"__max{i}").alias("max_num"),
            txt(f"__min{i}").alias("min_str"), txt(f"__max{i}").alias("max_str"),
        ))
    return df.agg(*aggs).select(F.explode(F.array(*structs)).alias("r")).select("r.*")
