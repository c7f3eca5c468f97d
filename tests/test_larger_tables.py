"""Steps that grew faster than their table: medians, hold-out, class joins, preparation shared by learners, scoring of many rounds."""
import random

import pytest
from pyspark.sql import functions as F

from twinstage.operators import boosting as B
from twinstage.operators import cascade as C
from twinstage.operators import models as D
from twinstage.operators import prep as P
from twinstage.operators import rank as RK
from twinstage.operators import split as R
from twinstage.operators import stats as A


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    kinds = ["benign"] * 5 + ["scan", "scan", "ddos"]
    made = []
    for i in range(900):
        k = rnd.choice(kinds)
        x = rnd.gauss({"benign": 0.0, "scan": 2.0, "ddos": 4.0}[k], 1.2)
        made.append((i, None if i % 19 == 0 else x, float(i % 3), float("nan") if i % 7 else float(i), rnd.choice(["tcp", "udp", None]), k, i % 2))
    return D.stable_order(spark.createDataFrame(made, "id long, x double, z double, w double, proto string, y string, fold int"), "id", 2)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def spec(**kw):
    base = dict(num_cols=["x", "z", "w"], cat_cols=["proto"], label_col="y", benign="benign",
                stage1_params=dict(maxIter=3, maxDepth=3), stage2_params=dict(numTrees=4, maxDepth=4))
    return C.CascadeSpec(**{**base, **kw})


@pytest.mark.parametrize("sketched, collected", [(500_000, 50_000), (200, 50_000), (200, 0), (30, 50_000)])
def test_medians_from_ends_of_a_few_rows_are_exact(spark, monkeypatch, sketched, collected):
    monkeypatch.setattr(RK, "SKETCHED", sketched)
    monkeypatch.setattr(RK, "COLLECTED", collected)
    rnd = random.Random(5)
    made = [(rnd.gauss(0, 1), float(i % 2), None if i % 5 else float(i), float("nan"), 7.0) for i in range(4000)]
    d = spark.createDataFrame(made, "a double, b double, c double, d double, e double")

    def middle(i):
        v = sorted(r[i] for r in made if r[i] is not None and r[i] == r[i])
        return (v[(len(v) - 1) // 2], v[len(v) // 2]) if v else None
    assert RK.middle_values(d, d.columns) == {c: middle(i) for i, c in enumerate(d.columns)}


@pytest.mark.parametrize("copies", [1, 3])
def test_holdout_tells_rows_by_their_key(spark, copies):
    made = [(None if i % 40 == 0 else i // copies, None if i % 6 == 0 else "ab"[i % 2 * (i % 3 > 0)]) for i in range(1200)] + [(5000, "solo")]
    d = spark.createDataFrame(made, "id long, y string")
    for size in (0.0, 0.3, 1.0):
        quotas, ranked = R.test_quotas(d, "y", size), RK.hashed_rank(d, "id", 42, ["y"], [])
        want = ranked.join(quotas, ranked["y"].eqNullSafe(quotas["_class"])).select("id", "y", (F.col("_rank") <= F.col("_quota")).cast("int"))
        assert sorted(map(tuple, R.holdout_split(d, "y", "id", size).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    alone = plan(R.holdout_split(d.where("id is not null").dropDuplicates(["id"]).localCheckpoint(), "y", "id", 0.3))
    assert "Window" not in alone and "hashpartitioning" not in alone  # no row is shuffled by its class


def test_weights_do_not_move_the_rows(spark, rows):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "hashpartitioning" not in plan(A.attach_weights(rows, "y"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_learner_reads_written_vectors(spark, rows):
    """A tree learner scans its table three times or more: it is given the vectors, not the expressions behind them."""
    from pyspark.ml.classification import DecisionTreeClassifier
    seen = []

    class Watched(DecisionTreeClassifier):
        def _fit(self, df):
            seen.append(plan(df))
            return super()._fit(df)
    t = rows.withColumn("l", (F.col("y") != "benign").cast("double"))
    D.fit_learner(P.build_preprocessor(["x", "z"], ["proto"], features_col="f"), Watched(featuresCol="f", labelCol="l", maxDepth=2), t)
    assert "UDF" not in seen[0] and "Scan ExistingRDD" in seen[0]


def test_folds_are_prepared_once(spark, rows, monkeypatch):
    fits, own = [], P.MedianImputer._fit

    def counted(self, df):
        fits.append(self.getInputCols())
        return own(self, df)
    monkeypatch.setattr(P.MedianImputer, "_fit", counted)
    got = C.ablation(rows, spec(), {"some": (["z", "x"], []), "all": (["x", "z", "w"], ["proto"])}, "d").collect()
    assert len(fits) == 2  # one a fold, not one a fold and mode
    fits.clear()
    scores = C.cv_compare(rows, spec(), "d", run_col=None).collect()
    assert len(fits) == 4  # all rows and attacks of each fold
    train, test = R.fold_rows(rows, 1)
    from twinstage.operators.metrics import macro_f1
    some = C.fit_single_stage(train, spec(num_cols=["z", "x"], cat_cols=[])).predict(test)
    assert [r.macro_f1 for r in got if (r.model, r.fold) == ("some", 1)] == [macro_f1(some, "y", "y_pred").first().macro_f1]
    two = C.fit_two_stage(train, spec()).predict(test)
    assert [r.macro_f1 for r in scores if (r.model, r.fold) == ("two_stage", 1)] == [macro_f1(two, "y", "y_pred").first().macro_f1]


def test_plan_of_joint_boosting_does_not_grow_with_the_rounds(spark, rows):
    prep = P.build_preprocessor(["x", "z", "w"], ["proto"], features_col="jb_features", tag="jb")
    m = B.fit_joint_boosting(rows, prep, "y", rounds=4, depth=3, store_every=3)
    one, four = (plan(m.predict(rows, rounds=n)).count("\n") for n in (1, 4))
    assert one == four and plan(m.confusion_curve(rows, "y")).count("ArrowEvalPython") == 1
    by_tree = m.prep.transform(rows).withColumn("m", F.array(*[F.lit(x) for x in m.start]))
    for r in m.rounds:
        by_tree = B.add_round(by_tree, r, m.step, "jb_features", "m")
    want = {r.id: r.m for r in by_tree.select("id", "m").collect()}
    assert {r.id: r.margins for r in m.margins(rows, 4).collect()} == want
    assert m.margins(rows.limit(0)).count() == 0 and not spark.sparkContext._jsc.getPersistentRDDs()
