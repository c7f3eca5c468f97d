"""Cascade routing properties and trained-model properties (§5.2 item 4)."""
import pytest
from pyspark.sql import functions as F

from twinstage.operators import cascade as C
from twinstage.operators import models as D
from twinstage.operators.prep import build_preprocessor


def test_rule_cascade_routes_all_rows(spark):
    df = spark.createDataFrame([(i, i / 10.0) for i in range(10)], "id int, s double")
    out = C.rule_cascade(df, F.col("s"), F.lit("attack"), 0.45, "benign")
    got = {r.id: r.y_pred for r in out.collect()}
    assert len(got) == 10 and sum(v == "attack" for v in got.values()) == 5
    none = C.rule_cascade(df, F.col("s"), F.lit("attack"), 5.0, "benign")
    assert {r.y_pred for r in none.collect()} == {"benign"}
    everything = C.rule_cascade(df, F.col("s"), F.lit("attack"), -1.0, "benign")
    assert {r.y_pred for r in everything.collect()} == {"attack"}


@pytest.fixture(scope="module")
def separable(spark):
    rows = []
    for i in range(600):
        cls = ["benign", "benign", "benign", "scan", "inject", "ddos"][i % 6]
        x = {"benign": 0.0, "scan": 5.0, "inject": 10.0, "ddos": 15.0}[cls] + (i % 7) * 0.1
        rows.append((i, x, float(i % 3), "tcp" if i % 2 else "udp", cls))
    return spark.createDataFrame(rows, "id long, x double, z double, proto string, y string")


def spec():
    return C.CascadeSpec(num_cols=["x", "z"], cat_cols=["proto"], label_col="y", benign="benign",
                         stage1_params=dict(maxIter=5, maxDepth=3), stage2_params=dict(numTrees=5, maxDepth=4))


def test_two_stage_properties(spark, separable):
    train = D.stable_order(separable, "id", 4)
    m = C.fit_two_stage(train, spec())
    assert "benign" not in m.attack_labels
    out = m.predict(separable)
    rows = out.select("id", "y", "y_pred", "p_attack").collect()
    assert len(rows) == 600
    acc = sum(r.y == r.y_pred for r in rows) / 600
    assert acc > 0.9  # beats the majority class (0.5) on a separable table
    routed = [r for r in rows if r.p_attack > 0.5]
    assert all(r.y_pred != "benign" for r in routed)  # stage 2 never predicts benign
    again = C.fit_two_stage(train, spec()).predict(separable)
    assert {r.id: r.y_pred for r in again.collect()} == {r.id: r.y_pred for r in rows}  # seeded refit


def test_single_stage_and_save_load(spark, separable, tmp_path):
    from pyspark.ml import Pipeline
    from twinstage.sources import io
    s = C.fit_single_stage(D.stable_order(separable, "id", 4), spec())
    out = s.predict(separable)
    assert out.where("y = y_pred").count() / 600 > 0.9
    prep = build_preprocessor(["x", "z"], ["proto"], tag="t")
    from pyspark.ml.feature import StringIndexer
    pm = Pipeline(stages=[StringIndexer(inputCol="y", outputCol="yi"), *prep.getStages(),
                          D.learner("rf", "yi", "features", numTrees=3, maxDepth=3)]).fit(separable)
    path = str(tmp_path / "model")
    io.save_model(pm, path, ["x", "z", "proto"])
    back = io.load_model(path)
    a = [r.prediction for r in pm.transform(separable).orderBy("id").collect()]
    b = [r.prediction for r in back.transform(separable).orderBy("id").collect()]
    assert a == b


def test_one_hot_unseen_is_zero(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    from twinstage.operators.prep import one_hot_stages
    train = spark.createDataFrame([("F",), ("O",), ("F",)], "s string")
    test = spark.createDataFrame([("F",), ("O",), ("P",)], "s string")
    m = Pipeline(stages=one_hot_stages(["s"], ["v"])).fit(train)
    got = [list(r.a) for r in m.transform(test).select(vector_to_array("v").alias("a")).collect()]
    assert got == [[1.0, 0.0], [0.0, 1.0], [0.0, 0.0]]


def test_replication_matches_weights(spark):
    df = spark.range(0, 4000).withColumn("w", F.when(F.col("id") % 2 == 0, 2.5).otherwise(0.25))
    rep = D.replicate_by_weight(df, "w", "id")
    assert rep.select("id").distinct().count() == 4000  # relative to the smallest weight: nobody is lost
    per = {r["even"]: r["n"] for r in rep.groupBy((F.col("id") % 2 == 0).alias("even")).agg(F.count("*").alias("n")).collect()}
    assert per[False] == 2000 and per[True] == 20_000
    part = D.replicate_by_weight(df.withColumn("w", F.when(F.col("id") % 2 == 0, 1.5).otherwise(1.0)), "w", "id")
    assert abs(part.count() - 5000) < 150


def test_compare_models_records_failure(spark, separable):
    from pyspark.ml import Pipeline

    def bad():
        return Pipeline(stages=[D.learner("gbt", "missing_label", "features")])
    res = D.compare_models({"bad": bad}, separable, separable, lambda p: 1.0)
    assert res[0][:2] == ("bad", None) and res[0][2]


def test_roles_fill_and_index_encoding(spark):
    from twinstage.operators.clean import column_roles, drop_present, fill_constants
    df = spark.createDataFrame([(1, "a", True, None)], "n int, c string, b boolean, s string")
    assert column_roles(df) == (["n", "b"], ["c", "s"])
    assert column_roles(df, cat_cols=["c"]) == (["n", "b", "s"], ["c"])
    assert fill_constants(df, {"s": "missing", "zz": 0}).first().s == "missing"
    assert drop_present(df, ["c", "absent"]).columns == ["n", "b", "s"]
    train = spark.createDataFrame([(1.0, "x"), (2.0, "y")], "v double, c string")
    pm = build_preprocessor(["v"], ["c"], encode="index", tag="ix").fit(train)
    assert [list(r.features) for r in pm.transform(train).collect()] == [[1.0, 0.0], [2.0, 1.0]]


def test_one_vs_rest_boosted_trees(spark, separable):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer
    prep = build_preprocessor(["x", "z"], ["proto"], tag="ov")
    ovr = D.learner("ovr_gbt", "yi", "features", maxIter=3, maxDepth=2)
    pm = Pipeline(stages=[StringIndexer(inputCol="y", outputCol="yi"), *prep.getStages(), ovr]).fit(separable)
    out = pm.transform(separable)
    assert out.where("yi = prediction").count() / 600 > 0.9


def test_stage_weights_differ(spark, separable, monkeypatch):
    """A6 weights the attacks of stage 1, A4 balances the attacks of stage 2."""
    seen = []
    fit = C.fit_learner
    monkeypatch.setattr(C, "fit_learner", lambda prep, lrn, train, first=None: seen.append(
        {r.y: r.w for r in train.groupBy("y").agg(F.max("stage_weight").alias("w")).collect()}) or fit(prep, lrn, train, first))
    rows = separable.where("y <> 'ddos' or id % 4 = 1")
    C.fit_two_stage(rows, C.CascadeSpec(**{**spec().__dict__, "stage_weights": True}))
    stage1, stage2 = seen
    assert stage1["benign"] == 1.0 and stage1["scan"] == stage1["ddos"] != 1.0
    assert "benign" not in stage2 and stage2["ddos"] > stage2["scan"] > 0


def test_cascade_save_and_load(spark, separable, tmp_path):
    from twinstage.sources import io
    m = C.fit_two_stage(D.stable_order(separable, "id", 4), spec())
    io.save_cascade(m, str(tmp_path / "c"))
    back = io.load_cascade(str(tmp_path / "c"))
    a, b = (sorted((r.id, r.y_pred) for r in x.predict(separable).collect()) for x in (m, back))
    assert a == b and back.spec == m.spec


def test_many_categories_by_index(spark):
    """M6: a column of 100 values, more than the default number of bins."""
    rows = [(i, f"p{i % 100}", "a" if i % 100 < 30 else "b") for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, proto string, y string")
    s = C.CascadeSpec(num_cols=[], cat_cols=["proto"], label_col="y", benign="a", encode="index", stage2_params=dict(numTrees=3, maxDepth=5))
    assert C.fit_single_stage(df, s).predict(df).where("y = y_pred").count() > 900


def test_macro_f1_curve(spark, separable):
    from twinstage.functions.labels import binary_label
    rows = build_preprocessor(["x", "z"], ["proto"], tag="mc").fit(separable).transform(separable) \
        .withColumn("l", binary_label("y", "benign").cast("double")).withColumn("part", F.when(F.col("id") % 4 == 0, "validation").otherwise("train"))
    gbt = D.learner("gbt", "l", "features", maxIter=4, maxDepth=2).fit(rows.where("part = 'train'"))
    got = D.macro_f1_curve(gbt, rows, "l", "part").collect()
    assert len(got) == 8 and sum(r.best for r in got) == 2
    from twinstage.operators import metrics as E
    last = E.macro_f1(gbt.transform(rows.where("part = 'train'")), "l", "prediction").first().macro_f1
    assert abs([r for r in got if r.part == "train" and r.iteration == 4][0].macro_f1 - last) < 1e-12
