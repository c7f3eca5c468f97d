"""Exact, deterministic splits (R1–R6) — the "window functions" of this project.

A split is a column on the data (``is_test``, ``fold``, ``run``), never a
positional index: Spark rows have no order, so every split is keyed on a stable
id column and on ``md5('<seed>:<id>')``. ``randomSplit`` / ``sampleBy`` are not
used: neither is exact per class.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import epoch_micros, parse_timestamp
from .rank import ACCURACY, cut_at_quota, hashed_rank, kth_in_order


def test_quotas(df: DataFrame, y: str, test_size: float) -> DataFrame:
    """(class, quota): largest-remainder allocation of ⌈test_size·n⌉ rows over classes (sklearn's
    approximate mode); ties in the remainder go to the smaller class name, null first.

    A table of one row per class; only the row count reaches the driver, so any number of classes will do.
    """
    counts = df.groupBy(F.col(y).alias("_class")).agg(F.count(F.lit(1)).alias("_m"))
    n = df.count()
    n_test = F.lit(math.ceil(test_size * n)).cast("decimal(38,0)")
    whole = (n_test * F.col("_m")).cast("decimal(38,0)")
    base = F.floor(whole / F.lit(max(n, 1))).cast("long")
    quotas = counts.withColumn("_base", base).withColumn("_rem", (whole - F.col("_base") * F.lit(max(n, 1))).cast("decimal(38,0)"))
    nth = F.row_number().over(Window.orderBy(F.desc("_rem"), F.coalesce(F.col("_class").cast("string"), F.lit(""))))
    left = F.lit(math.ceil(test_size * n)) - F.sum("_base").over(Window.partitionBy())
    return quotas.select("_class", (F.col("_base") + (nth <= left).cast("int")).alias("_quota"))


def holdout_split(df: DataFrame, y: str, id_col: str, test_size: float = 0.2, seed: int = 42,
                  out: str = "is_test") -> DataFrame:
    """Stratified hold-out. The first n_c rows of each class (in md5 order) are test."""
    return cut_at_quota(df, id_col, seed, y, test_quotas(df, y, test_size), out)


def stratified_folds(df: DataFrame, y: str, id_col: str, k: int = 5, seed: int = 42,
                     out: str = "fold") -> DataFrame:
    """R2: fold = (rank − 1) mod k over the order (class, md5, id).

    Each class is contiguous in that order, so per-class fold sizes differ by at
    most one, and the class boundaries rotate the remainders across folds.
    """
    ranked = hashed_rank(df, id_col, seed, partition=[], lead=[y])
    return ranked.withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def repeated_folds(df: DataFrame, y: str, id_col: str, k: int = 5, runs: int = 5, seed: int = 42) -> DataFrame:
    """R2 repeated with seed = base + run. Rows are replicated once per run by a
    generator (no join); output carries (run, fold)."""
    rep = df.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    ranked = hashed_rank(rep, id_col, F.col("run") + F.lit(seed), partition=["run"], lead=[y])
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def time_split(df: DataFrame, ts: str, id_col: str, train_frac: float = 0.7,
               out: str = "is_train") -> DataFrame:
    """Sort by (ts nulls last, id), the first ⌊n·frac⌋ rows are train.

    The cut key is found by exact distributed selection (a sketch over one scan, then
    ranges of ``ts`` whose ends are pushed to the file reader); the split itself is
    then a per-row comparison (no global sort, no shuffle). A text ``ts`` is
    parsed first (unparseable → null → last, like pandas' NaT) and prunes nothing.
    """
    if dict(df.dtypes)[ts] not in ("timestamp", "timestamp_ntz"):
        parsed = f"__{ts}_parsed"
        out_df = time_split(df.withColumn(parsed, parse_timestamp(ts)), parsed, id_col, train_frac, out)
        return out_df.drop(parsed)
    us = epoch_micros(ts, dict(df.dtypes)[ts])
    last = F.lit(1 << 62)  # stands for null, the last
    probs = [min(1.0, max(0.0, train_frac + side * 2.0 / ACCURACY)) for side in (-1, 1)]
    near = F.percentile_approx(F.coalesce(us, last), probs, ACCURACY)
    stat = df.agg(F.count(F.lit(1)).alias("n"), F.count(F.col(ts)).alias("nn"), near.alias("q")).first()
    n = stat["n"]
    cut = int(n * train_frac)
    if cut <= 0:
        return df.withColumn(out, F.lit(0))
    if cut >= n:
        return df.withColumn(out, F.lit(1))
    t_us, id_k = kth_in_order(df, ts, id_col, cut - 1, stat["nn"], tuple(stat["q"]))
    i = F.col(id_col)
    if t_us is None:
        train = us.isNotNull() | (i <= F.lit(id_k))
    else:
        train = us.isNotNull() & ((us < F.lit(t_us)) | ((us == F.lit(t_us)) & (i <= F.lit(id_k))))
    return df.withColumn(out, F.coalesce(train, F.lit(False)).cast("int"))


def official_split(train: DataFrame, test: DataFrame, col: str = "split") -> DataFrame:
    """Tag the given train and test tables and stack them by name."""
    return (train.withColumn(col, F.lit("train"))
            .unionByName(test.withColumn(col, F.lit("test")), allowMissingColumns=True))


def fold_rows(df: DataFrame, fold: int, fold_col: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(train, test) rows of fold ``fold`` — two pushed-down filters."""
    return df.filter(F.col(fold_col) != fold), df.filter(F.col(fold_col) == fold)
