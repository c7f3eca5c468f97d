"""Statistics over runs (T1–T7) and the run-time summary.

Score tables are keyed by (dataset, model, run, fold). Pairing is by (run, fold)
— never by position — so a paired test compares the same split of the data.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def t_two_sided_p(t: Column, dof: Column) -> Column:
    """Two-sided p-value of Student's t for integer dof, exact finite series
    (Abramowitz & Stegun 26.7.3 / 26.7.4) — built-in expressions only.

    θ = atan(|t|/√ν), c = cos²θ. Odd ν: A = (2/π)(θ + sinθ cosθ Σ_{j<(ν-1)/2} a_j c^j),
    a_j = Π 2i/(2i+1); ν = 1: A = 2θ/π. Even ν: A = sinθ Σ_{j<ν/2} b_j c^j,
    b_j = Π (2i-1)/(2i). p = 1 − A.
    """
    th = F.atan(F.abs(t) / F.sqrt(dof.cast("double")))
    c2 = F.pow(F.cos(th), 2)

    def series(m: Column, ratio) -> Column:
        js = F.filter(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), lambda j: j <= m)
        acc0 = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

        def step(acc, j):
            nxt = acc["t"] * ratio(j) * c2
            return F.struct(nxt.alias("t"), (acc["s"] + nxt).alias("s"))
        return F.aggregate(js, acc0, step, lambda acc: acc["s"])

    odd_sum = series(((dof - 3) / 2).cast("int"), lambda j: (2.0 * j) / (2.0 * j + 1.0))
    even_sum = series(((dof - 2) / 2).cast("int"), lambda j: (2.0 * j - 1.0) / (2.0 * j))
    a_odd = F.when(dof == 1, 2.0 * th / math.pi).otherwise(
        (2.0 / math.pi) * (th + F.sin(th) * F.cos(th) * odd_sum))
    a_even = F.sin(th) * even_sum
    a = F.when(dof % 2 == 1, a_odd).otherwise(a_even)
    return F.when(t.isNotNull() & (dof >= 1), F.greatest(F.lit(0.0), F.lit(1.0) - a))


def _pair_stats(d: Column, a: Column, b: Column) -> list[Column]:
    n = F.count(d)
    sd = F.stddev_samp(d)
    return [n.cast("long").alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
            F.avg(d).alias("mean_diff"), sd.alias("sd_diff"), F.stddev_pop(d).alias("sd_diff_pop")]


def _finish(df: DataFrame, alpha: float) -> DataFrame:
    t = F.try_divide(F.col("mean_diff"), F.col("sd_diff") / F.sqrt(F.col("n").cast("double")))
    t = F.when(F.col("sd_diff") > 0, t)  # zero variance → null t (scipy gives nan)
    dof = F.col("n") - 1
    p = t_two_sided_p(F.col("t"), dof)
    return (df.withColumn("t", t).withColumn("dof", dof.cast("long"))
            .withColumn("p_value", p)
            .withColumn("cohens_d", F.when(F.col("sd_diff_pop") > 0,
                                           F.try_divide(F.col("mean_diff"), F.col("sd_diff_pop"))))
            .withColumn("significant", F.coalesce((F.col("p_value") < alpha).cast("int"), F.lit(0))))


def one_score_each(scores: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Scores by key; several rows of one (model, run, fold) count as their mean."""
    return scores.groupBy(*keys).agg(F.avg(score).alias(score))


def paired_tests(scores: DataFrame, pairs: Sequence[tuple[str, str]] | None = None,
                 keys: Sequence[str] = ("run", "fold"), group: Sequence[str] = ("dataset",),
                 model: str = "model", score: str = "macro_f1", alpha: float = 0.05) -> DataFrame:
    """Paired t, p, Cohen's d and verdict for model pairs (a − b).

    Without ``pairs`` every pair a < b (T6, whose feature that is): the models of one split meet
    in an equi-join on (group, run, fold). Repeated scores of a model on a split count as their mean.
    """
    one = one_score_each(scores, [*group, *keys, model], score)
    on = [*group, *keys]
    a = one.select(*on, F.col(model).alias("model_a"), F.col(score).alias("a"))
    b = one.select(*on, F.col(model).alias("model_b"), F.col(score).alias("b"))
    if pairs is None:
        j = a.join(b, on).where(F.col("model_a") < F.col("model_b"))
        every = None
    else:
        every = scores.sparkSession.createDataFrame([tuple(p) for p in pairs], "model_a string, model_b string").distinct()
        j = a.join(every, "model_a").join(b, [*on, "model_b"])
    j = j.where(F.col("a").isNotNull() & F.col("b").isNotNull()).withColumn("d", F.col("a") - F.col("b"))
    agg = j.groupBy(*group, "model_a", "model_b").agg(*_pair_stats(F.col("d"), F.col("a"), F.col("b")))
    return _finish(agg, alpha)


def ci95(scores: DataFrame, keys: Sequence[str] = ("dataset", "model"), score: str = "macro_f1",
         z: float = 1.96) -> DataFrame:
    """T5: mean ± z · s / √n with the sample std."""
    half = F.lit(z) * F.stddev_samp(score) / F.sqrt(F.count(score).cast("double"))
    return scores.groupBy(*keys).agg(F.count(score).cast("long").alias("n"), F.avg(score).alias("mean"),
                                     half.alias("half_width")) \
        .withColumn("lower", F.col("mean") - F.col("half_width")) \
        .withColumn("upper", F.col("mean") + F.col("half_width"))


def five_numbers(scores: DataFrame, keys: Sequence[str] = ("dataset", "model"), score: str = "macro_f1") -> DataFrame:
    """Min, q1, median, q3, max per model (linear interpolation) — box-plot data.
    Score tables are fold-sized, so the exact percentile buffer is bounded."""
    q = F.percentile(score, F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return scores.groupBy(*keys).agg(q.alias("_q")).select(
        *keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(("min", "q1", "median", "q3", "max"))])


# ---------------------------------------------------------------------------
# run-time summary
# ---------------------------------------------------------------------------

def throughput(timings: DataFrame, keys: Sequence[str] = ("dataset", "model"),
               seconds: str = "seconds", rows: str = "rows") -> DataFrame:
    """B1: mean, population std of time and rows/s per (dataset, model)."""
    return timings.groupBy(*keys).agg(
        F.count(seconds).cast("long").alias("repeats"),
        F.avg(seconds).alias("time_mean_s"),
        F.stddev_pop(seconds).alias("time_std_s"),
        F.max(rows).cast("long").alias("rows"),
    ).withColumn("rows_per_sec", F.try_divide(F.col("rows").cast("double"), F.col("time_mean_s")))


def speedup(summary: DataFrame, baseline: str, candidate: str, key: str = "dataset",
            model: str = "model") -> DataFrame:
    """B2: rows/s of ``candidate`` over ``baseline`` per dataset (pivot on two fixed values)."""
    w = summary.groupBy(key).pivot(model, [baseline, candidate]).agg(F.first("rows_per_sec"))
    return w.select(key, F.col(baseline).alias("baseline_rows_per_sec"),
                    F.col(candidate).alias("candidate_rows_per_sec"),
                    F.try_divide(F.col(candidate), F.col(baseline)).alias("speedup"))


def stage_totals(fit_times: DataFrame, keys: Sequence[str] = ("dataset", "model"),
                 seconds: str = "seconds") -> DataFrame:
    """Total fit time of a cascade = sum over its stages."""
    return fit_times.groupBy(*keys).agg(F.sum(seconds).alias("fit_time_s"),
                                        F.count(seconds).cast("long").alias("stages"))


def published_layout(fits: DataFrame, predicts: DataFrame) -> DataFrame:
    """B2: the run-time table in the reference's published column layout.

    ``fits``: (dataset, model, stage, rows, seconds) — one row per fitted stage,
    summed per cascade (B3). ``predicts``: timed predict repeats as for B1.
    """
    fit = fits.groupBy("dataset", "model").agg(
        F.sum("seconds").alias("fit_time_s"), F.max("rows").cast("long").alias("train_rows"),
        F.concat_ws("; ", F.sort_array(F.collect_list(
            F.concat(F.lit("fit_"), F.col("stage"), F.lit("="), F.format_number("seconds", 2), F.lit("s"))))
        ).alias("notes"))
    pred = throughput(predicts)
    return fit.join(pred, ["dataset", "model"], "inner").select(
        "dataset", "model", "train_rows", F.col("rows").alias("test_rows"), "fit_time_s",
        F.col("time_mean_s").alias("pred_time_mean_s"), F.col("time_std_s").alias("pred_time_std_s"),
        "rows_per_sec", "notes")
