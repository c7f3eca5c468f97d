"""Evaluation metrics and run statistics, incl. golden values."""
import itertools

import pytest
from pyspark.sql import functions as F

from twinstage.operators import metrics as E
from twinstage.operators import runstats as RS


def preds(spark, pairs):
    return spark.createDataFrame(pairs, "y_true string, y_pred string")


def hand_macro_f1(pairs):
    labels = sorted({a for a, _ in pairs} | {b for _, b in pairs})
    f1s = []
    for c in labels:
        tp = sum(1 for a, b in pairs if a == c and b == c)
        fp = sum(1 for a, b in pairs if a != c and b == c)
        fn = sum(1 for a, b in pairs if a == c and b != c)
        f1s.append(0.0 if 2 * tp + fp + fn == 0 else 2 * tp / (2 * tp + fp + fn))
    return sum(f1s) / len(f1s)


CASES = [
    [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a"), ("c", "c"), ("a", "a")],
    [("a", "a"), ("b", "a"), ("b", "a")],                      # class absent from predictions
    [("a", "a"), ("a", "z"), ("b", "b")],                      # predicted class absent from truth
]


@pytest.mark.parametrize("pairs", CASES)
def test_macro_f1_and_confusion(spark, pairs):
    df = preds(spark, pairs)
    assert abs(E.macro_f1(df, "y_true", "y_pred").first().macro_f1 - hand_macro_f1(pairs)) < 1e-12
    cm = E.confusion(df, "y_true", "y_pred")
    labels = {a for a, _ in pairs} | {b for _, b in pairs}
    assert cm.count() == len(labels) ** 2
    assert cm.agg(F.sum("count")).first()[0] == len(pairs)
    rep = {r["class"]: r for r in E.class_report(df, "y_true", "y_pred").collect()}
    assert abs(rep["macro avg"].f1 - hand_macro_f1(pairs)) < 1e-12
    acc = sum(a == b for a, b in pairs) / len(pairs)
    assert abs(rep["accuracy"].f1 - acc) < 1e-12
    assert rep["accuracy"].support == len(pairs)


def test_confusion_normalized_rows_sum_to_one(spark):
    df = preds(spark, CASES[2])
    rows = E.confusion_normalized(df, "y_true", "y_pred").collect()
    by_true = {}
    for r in rows:
        by_true.setdefault(r.y_true, []).append(r.share)
    assert abs(sum(by_true["a"]) - 1) < 1e-12
    assert all(s is None for s in by_true["z"])  # empty truth row


def brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def test_auc_with_ties_and_roc(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (1, 0.5), (0, 0.5), (1, 0.2), (0, 0.0)]
    df = spark.createDataFrame(rows, "y int, s double")
    assert abs(E.roc_auc(df, "y", "s").first().auc - brute_auc(rows)) < 1e-12
    pts = sorted((r.threshold, r.tpr, r.fpr) for r in E.roc_points(df, "y", "s").collect())
    assert pts[-1] == (float("inf"), 0.0, 0.0) and pts[0][1:] == (1.0, 1.0)
    sweep = {r.threshold: r for r in E.threshold_sweep(df, "y", "s", [0.3, 0.9]).collect()}
    assert (sweep[0.3].tp, sweep[0.3].fp, sweep[0.9].tp) == (3, 2, 0)


def test_running_totals_match_window(spark):
    import random
    rnd = random.Random(1)
    rows = [(round(rnd.random(), 3), rnd.randint(0, 5)) for _ in range(500)]
    g = spark.createDataFrame(rows, "k double, v long").groupBy("k").agg(F.sum("v").alias("v"))
    got = {r.k: r.cum_v for r in E.running_totals(g, "k", ["v"], descending=True, rows_per_bucket=20).collect()}
    acc, exp = 0, {}
    for k, v in sorted(((r.k, r.v) for r in g.collect()), reverse=True):
        acc += v
        exp[k] = acc
    assert got == exp


# The published fold scores of three model pairs, and the statistics they give.
GOLDEN = [  # (a, b, t, p, d)
    ([0.6050, 0.5289, 0.5308, 0.5337, 0.5381], [0.5429, 0.4410, 0.4579, 0.3933, 0.4297], 6.790942, 0.002455, 3.395471),
    ([0.5347, 0.5438, 0.5536, 0.5445, 0.5408],
     [0.5759446276458929, 0.5758872751844017, 0.5761369495433784, 0.5756521449898522, 0.5737510003708511],
     -10.765657, 0.000422, -5.382828),
    ([0.6453, 0.6559, 0.6411, 0.6347, 0.6611], [0.5951, 0.5964, 0.6022, 0.6001, 0.5853], 6.984393, 0.002211, 3.492197),
    ([0.8277, 0.9096, 0.9689, 0.8521, 0.9334], [0.9161, 0.8130, 0.8327, 0.7335, 0.8004], 1.864476, 0.135696, 0.932238),
]


@pytest.mark.parametrize("a,b,t,p,d", GOLDEN)
def test_paired_t_golden(spark, a, b, t, p, d):
    rows = [("x", "a", 0, i, v) for i, v in enumerate(a)] + [("x", "b", 0, i, v) for i, v in enumerate(b)]
    sc = spark.createDataFrame(rows, "dataset string, model string, run int, fold int, macro_f1 double")
    r = RS.paired_tests(sc).first()
    assert round(r.t, 6) == t and round(r.p_value, 6) == p and round(r.cohens_d, 6) == d
    assert r.significant == (1 if p < 0.05 else 0)


def test_zero_variance_t_is_null(spark):
    rows = [("x", m, 0, i, 0.5 + i / 10) for m in ("a", "b") for i in range(5)]
    sc = spark.createDataFrame(rows, "dataset string, model string, run int, fold int, macro_f1 double")
    r = RS.paired_tests(sc).first()
    assert r.t is None and r.p_value is None and r.cohens_d is None and r.significant == 0


def test_ci_and_five_numbers(spark):
    rows = [("x", "m", 0, i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5])]
    sc = spark.createDataFrame(rows, "dataset string, model string, run int, fold int, macro_f1 double")
    c = RS.ci95(sc).first()
    assert abs(c.half_width - 1.96 * (2.5 ** 0.5) / 5 ** 0.5) < 1e-12
    f = RS.five_numbers(sc).first()
    assert (f["min"], f.q1, f.median, f.q3, f["max"]) == (1.0, 2.0, 3.0, 4.0, 5.0)


def test_speedup_golden(spark):
    rows = [("UNSW", "single_stage", 0, 175341, 2.985329039953649), ("UNSW", "two_stage", 0, 175341, 1.2551748200319708),
            ("SIEM", "single_stage", 0, 3000, 0.02491268582109894), ("SIEM", "two_stage", 0, 3000, 0.01873012851657612)]
    t = spark.createDataFrame(rows, "dataset string, model string, repeat int, rows long, seconds double")
    sp = {r.dataset: round(r.speedup, 2) for r in RS.speedup(RS.throughput(t), "single_stage", "two_stage").collect()}
    assert sp == {"UNSW": 2.38, "SIEM": 1.33}


def test_roc_drop_intermediate_matches_rule(spark):
    import random
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 1), float(rnd.randint(0, 40))) for _ in range(400)]
    df = spark.createDataFrame(rows, "y int, s double")
    full = sorted(((r.threshold, r.tp, r.fp) for r in E.roc_points(df, "y", "s").collect()
                   if r.threshold != float("inf")), reverse=True)
    tps, fps = [x[1] for x in full], [x[2] for x in full]
    keep = [0] + [i for i in range(1, len(full) - 1)
                  if tps[i + 1] - 2 * tps[i] + tps[i - 1] or fps[i + 1] - 2 * fps[i] + fps[i - 1]] + [len(full) - 1]
    exp = sorted(full[i] for i in keep)
    got = sorted((r.threshold, r.tp, r.fp) for r in E.roc_points(df, "y", "s", drop_intermediate=True).collect()
                 if r.threshold != float("inf"))
    assert got == exp and len(got) < len(full)


def test_published_layout_golden(spark):
    fits = spark.createDataFrame([("UNSW_official", "two_stage", "stage1", 82332, 3.85),
                                  ("UNSW_official", "two_stage", "stage2", 82332, 27.16)],
                                 "dataset string, model string, stage string, rows long, seconds double")
    preds = spark.createDataFrame([("UNSW_official", "two_stage", "predict", 0, 175341, 1.2551748200319708)],
                                  "dataset string, model string, stage string, repeat int, rows long, seconds double")
    r = RS.published_layout(fits, preds).first()
    assert (r.train_rows, r.test_rows) == (82332, 175341)
    assert abs(r.fit_time_s - 31.01) < 1e-9 and round(r.rows_per_sec) == 139694
    assert r.notes == "fit_stage1=3.85s; fit_stage2=27.16s"


def test_many_labels(spark):
    df = spark.range(1200).select(F.col("id").cast("string").alias("y_true"), F.lit("0").alias("y_pred"))
    assert E.confusion(df, "y_true", "y_pred").count() == 1200 * 1200


def test_f1_compare_keeps_null_and_odd_names(spark):
    df = preds(spark, [(None, None), ("accuracy", "accuracy"), ("a", "b")])
    rep = E.class_report(df, "y_true", "y_pred", with_kind=True)
    got = {r["class"]: r.improvement for r in E.f1_compare(rep, rep).collect()}
    assert got == {None: 0.0, "accuracy": 0.0, "a": 0.0, "b": 0.0}


def test_roc_of_unusable_scores(spark):
    df = spark.createDataFrame([(1, float("inf")), (0, float("-inf")), (1, float("nan"))], "y int, s double")
    assert E.roc_auc(df, "y", "s").first().auc == 1.0


def test_repeated_scores_count_as_their_mean(spark):
    rows = [("x", "a", 0, i, v) for i, v in enumerate([0.5, 0.9, 0.7])] + [("x", "a", 0, 0, 0.9)] \
        + [("x", "b", 0, i, v) for i, v in enumerate([0.4, 0.5, 0.9])]
    sc = spark.createDataFrame(rows, "dataset string, model string, run int, fold int, macro_f1 double")
    r = RS.paired_tests(sc).first()
    assert r.n == 3 and abs(r.mean_a - (0.7 + 0.9 + 0.7) / 3) < 1e-12
    assert RS.paired_tests(sc, pairs=[("b", "a")]).first().mean_diff == -r.mean_diff
