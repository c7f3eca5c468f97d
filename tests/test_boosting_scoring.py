"""Flat scoring against the library's transformers; joint boosting, its stop and its curves."""
import random

import pytest
from pyspark.sql import functions as F

from twinstage.operators import boosting as B
from twinstage.operators import cascade as C
from twinstage.operators import metrics as E
from twinstage.operators import models as D
from twinstage.operators import scoring as S
from twinstage.operators.prep import build_preprocessor


@pytest.fixture(scope="module")
def flows(spark):
    """Classes that overlap, missing and non-finite values, unseen categories in the second half."""
    rnd = random.Random(4)
    rows = []
    for i in range(1600):
        cls = rnd.choice(["benign"] * 5 + ["scan", "scan", "inject", "ddos"])
        base = {"benign": 0.0, "scan": 2.0, "inject": 3.5, "ddos": 5.0}[cls]
        x = rnd.gauss(base, 1.5)
        x = None if i % 17 == 0 else float("nan") if i % 29 == 0 else float("inf") if i % 41 == 0 else x
        proto = None if i % 13 == 0 else rnd.choice(["tcp", "udp"] + (["icmp", "sctp"] if i >= 800 else [])) if cls != "ddos" else "udp"
        rows.append((i, x, rnd.gauss(-base, 2.0), float(i % 5), None, proto, cls if i % 97 else None))
    d = spark.createDataFrame(rows, "id long, x double, z double, k double, never double, proto string, y string")
    return d.where("id < 800"), d.where("id >= 800")


def spec(**kw):
    base = dict(num_cols=["x", "z", "k"], cat_cols=["proto"], label_col="y", benign="benign",
                stage1_params=dict(maxIter=6, maxDepth=4), stage2_params=dict(numTrees=7, maxDepth=7))
    return C.CascadeSpec(**{**base, **kw})


@pytest.mark.parametrize("kw", [{}, {"encode": "index"}, {"threshold": 0.2}, {"stage1": "rf", "stage1_params": dict(numTrees=5, maxDepth=3)}])
def test_flat_scoring_equals_the_transformers(spark, flows, kw):
    train, test = flows
    train = D.stable_order(train, "id", 3)
    two, one = C.fit_two_stage(train, spec(**kw)), C.fit_single_stage(train, spec(**kw))
    got = {r.id: (r.y_pred, r.p_attack) for r in two.predict(test).collect()}
    want = {r.id: (r.y_pred, r.p_attack) for r in two.transform(test).collect()}
    assert {i: v[0] for i, v in got.items()} == {i: v[0] for i, v in want.items()} and len(got) == 800
    assert all(abs(got[i][1] - want[i][1]) < 1e-12 for i in got)
    assert {r.id: r.y_pred for r in one.predict(test).collect()} == {r.id: r.y_pred for r in one.transform(test).collect()}
    assert set(two.predict(test).columns) == set(test.columns) | {"p_attack", "y_pred"}
    plan = two.predict(test)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Union" not in plan  # one pass, nothing stored between the stages
    assert two.predict(test.limit(0)).count() == 0 and one.predict(test.limit(0)).count() == 0


def test_flat_scoring_without_attacks(spark, flows):
    benign = flows[0].where("y = 'benign'")
    m = C.fit_two_stage(benign, spec())
    assert m.stage2 is None and {r.y_pred for r in m.predict(flows[1]).collect()} == {"benign"}


def prep():
    return build_preprocessor(["x", "z", "k"], ["proto"], features_col="jb_features", tag="jb")


def test_joint_boosting(spark, flows):
    """The loss falls every round; equal numbers of trees do better than one-vs-rest; every prefix of the curve
    is what that prefix predicts."""
    train, test = (D.materialize(d.where("y is not null")) for d in flows)
    m = B.fit_joint_boosting(train, prep(), "y", rounds=6, depth=3, step=0.7, store_every=2)
    assert m.labels == ["benign", "ddos", "inject", "scan"] and m.best == len(m.rounds) == 6
    loss = [r.loss for r in B.curve_table(spark, m).where("part = 'train'").orderBy("iteration").collect()]
    assert len(loss) == 7 and all(b < a for a, b in zip(loss, loss[1:]))
    curve = m.confusion_curve(test, "y").collect()
    for n in (0, 2, 6):
        want = {(r.y, r.y_pred): r["count"] for r in m.predict(test, rounds=n).groupBy("y", "y_pred").count().collect()}
        assert {(r.y_true, r.y_pred): r["count"] for r in curve if r.iteration == n} == want
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IndexToString, StringIndexer
    idx = StringIndexer(inputCol="y", outputCol="yi", stringOrderType="alphabetAsc").fit(train)
    ovr = Pipeline(stages=[idx, *prep().getStages(), D.learner("ovr_gbt", "yi", "jb_features", maxIter=6, maxDepth=3)]).fit(train)
    rest = IndexToString(inputCol="prediction", outputCol="y_pred", labels=idx.labels).transform(ovr.transform(train))
    joint = E.macro_f1(m.predict(train), "y", "y_pred").first().macro_f1
    assert joint > E.macro_f1(rest, "y", "y_pred").first().macro_f1
    again = B.fit_joint_boosting(train, prep(), "y", rounds=1, depth=3, step=0.7)
    assert again.curve == [c for c in m.curve if c[0] <= 1]


def test_joint_boosting_stops_and_keeps_the_best(spark):
    """Labels of the fitted rows say nothing about those of the validation rows: the best prefix is an early one."""
    rnd = random.Random(1)
    rows = [(i, rnd.random(), "t", rnd.choice(["a", "b", "b"]), i % 3 == 0) for i in range(600)]
    d = D.stable_order(spark.createDataFrame(rows, "id long, x double, proto string, y string, v boolean"), "id", 2)
    m = B.fit_joint_boosting(d, build_preprocessor(["x"], ["proto"], features_col="jb_features", tag="jb"), "y", rounds=12, depth=4,
                             step=1.0, validation=F.col("v"), patience=2)
    assert len(m.rounds) < 12 and len(m.rounds) - m.best == 2
    t = {r.iteration: r for r in B.curve_table(spark, m).where("part = 'validation'").collect()}
    assert [i for i, r in t.items() if r.is_best] == [m.best] and t[m.best].macro_f1 == max(r.macro_f1 for r in t.values())
    held = m.predict(d.where("v"))
    assert abs(E.macro_f1(held, "y", "y_pred").first().macro_f1 - t[m.best].macro_f1) < 1e-12


def test_macro_f1_of_cells(spark):
    cells = {("a", "a"): 5, ("a", "b"): 2, ("c", "a"): 1, ("b", "b"): 4}
    d = spark.createDataFrame([(a, b) for (a, b), n in cells.items() for _ in range(n)], "y string, p string")
    assert abs(E.macro_f1_of(cells) - E.macro_f1(d, "y", "p").first().macro_f1) < 1e-12 and E.macro_f1_of({}) == 0.0
