"""Registered queries with trained MLlib models on the SIEM stand-in.

What a model learns has no SQL twin; the SQL here states the facts that hold whatever it
learned: which rows are scored and their true class, how routing follows the score, the
support of a class, that a saved model predicts as before. The ensembles are smaller than
the published ones (iterations and trees are parameters), so scores are not comparable.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import boosting as B
from ..operators import cascade as C
from ..operators import metrics as E
from ..operators import models as D
from ..operators import split as R
from ..operators import stats as A
from ..operators.features import BASE_COLS, PORT_COLS, TIME_COLS, UA_COLS, URL_COLS, feature_group_columns
from ..operators.prep import build_preprocessor, reuse_fits
from ..session import checkpoint_root
from ..sources import io
from .catalog import _MD5, SIEM, _case_map, r6, register, siem_features

NUM_COLS = list(dict.fromkeys([*BASE_COLS, *PORT_COLS, *TIME_COLS, *URL_COLS, *UA_COLS]))
CAT_COLS = ["protocol"]
LABEL = "attack_group"
BENIGN = "benign"

# the 30 % hold-out of `events` by class (largest remainder), in md5 order
HOLDOUT = f"""{SIEM}, lab AS (SELECT event_id, {_case_map('trim(attack_type)', L.ATTACK_GROUPS, "'other_attack'")} AS attack_group FROM siem),
c AS (SELECT attack_group, count(*) AS n FROM lab GROUP BY attack_group),
t AS (SELECT CAST(ceil(0.3 * sum(n)) AS BIGINT) AS nt, sum(n) AS tot FROM c),
a AS (SELECT attack_group, (nt * n) // tot AS base, (nt * n) % tot AS rem, nt FROM c, t),
q AS (SELECT attack_group, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, attack_group) <= nt - sum(base) OVER ()
                                       THEN 1 ELSE 0 END AS quota FROM a),
held AS (SELECT l.event_id, l.attack_group, CAST(row_number() OVER (PARTITION BY l.attack_group
           ORDER BY {_MD5.format(seed=42, id='l.event_id')}, l.event_id) <= q.quota AS INTEGER) AS is_test
         FROM lab l JOIN q ON l.attack_group = q.attack_group)"""

STAGE1 = dict(maxIter=10, maxDepth=4)
STAGE2 = dict(numTrees=20, maxDepth=6)
CURVE_ROUNDS, CURVE_WAIT = 5000, 200  # the reference's: iterations at most, and iterations without a better score before it stops


def spec(**kw) -> C.CascadeSpec:
    base = dict(num_cols=NUM_COLS, cat_cols=CAT_COLS, label_col=LABEL, benign=BENIGN, stage1="gbt",
                stage2="rf", stage1_params=STAGE1, stage2_params=STAGE2, threshold=0.5)
    base.update(kw)
    return C.CascadeSpec(**base)


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """SIEM stand-in with features and the grouped label (L1); raw text dropped."""
    from ..functions.labels import attack_group
    f = siem_features(spark, d).withColumn(LABEL, attack_group("attack_type"))
    return f.drop("timestamp", "src_ip", "dst_ip", "url", "user_agent", "attack_type")


def labelled_signal(spark: SparkSession, d: str) -> DataFrame:
    """The log with a noisy signal and a benign majority: features and grouped label."""
    from ..operators.features import add_features
    from . import fixtures as X
    f = add_features(X.signal_log(spark, d)).withColumn(LABEL, L.attack_group("attack_type"))
    return f.drop("timestamp", "src_ip", "dst_ip", "url", "user_agent", "attack_type")


def signal_holdout(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = D.materialize(R.holdout_split(labelled_signal(spark, d), LABEL, "event_id", test_size=0.3, seed=42))
    return s.where("is_test = 0"), s.where("is_test = 1")


def holdout(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = D.materialize(R.holdout_split(labelled(spark, d), LABEL, "event_id", test_size=0.3, seed=42))
    return s.filter(F.col("is_test") == 0), s.filter(F.col("is_test") == 1)


@register("two_stage_predict", f"WITH {HOLDOUT} SELECT event_id, attack_group AS y_true, 1 AS benign_iff_not_routed FROM held WHERE is_test = 1")
def two_stage_predict(spark: SparkSession, d: str) -> DataFrame:
    """C1–C4 trained: stage 1 GBT (benign vs attack), stage 2 RF on routed rows only."""
    train, test = holdout(spark, d)
    model = C.fit_two_stage(D.stable_order(train, "event_id"), spec())
    out = model.predict(test)
    routed = (F.col("p_attack") > F.lit(model.spec.threshold)) & F.lit(model.stage2 is not None)
    follows = (F.col("y_pred") != F.lit(BENIGN)) == routed
    return out.select("event_id", F.col(LABEL).alias("y_true"), follows.cast("int").alias("benign_iff_not_routed"))


@register("single_stage_predict", f"""
WITH {HOLDOUT} SELECT event_id, attack_group AS y_true, 1 AS known_class FROM held WHERE is_test = 1""")
def single_stage_predict(spark: SparkSession, d: str) -> DataFrame:
    """One multi-class random forest on the same split, class-weighted (A4/A5)."""
    train, test = holdout(spark, d)
    train = A.attach_weights(train, LABEL)
    model = C.fit_single_stage(D.stable_order(train, "event_id"), spec(weight_col="weight"))
    return model.predict(test).select("event_id", F.col(LABEL).alias("y_true"),
                                      F.col("y_pred").isin(model.labels).cast("int").alias("known_class"))


def by_fold(folded: DataFrame, keys: list[str]) -> DataFrame:
    """Rows written to shared storage as a table partitioned by fold: each fit reads its folders only,
    in an order that is the same every time."""
    path = f"{checkpoint_root(folded.sparkSession)}/folds/{uuid.uuid4().hex}"
    folded.repartition(*keys, F.pmod(F.xxhash64("event_id"), F.lit(4))).sortWithinPartitions(*keys, "event_id") \
        .write.partitionBy(*keys).parquet(path)
    return folded.sparkSession.read.parquet(path)


@register("cv_scores")
def cv_scores(spark: SparkSession, d: str) -> DataFrame:
    """Single vs two-stage on the SAME repeated stratified folds → scores table."""
    lab = labelled(spark, d)
    folds = R.repeated_folds(lab.select("event_id", LABEL), LABEL, "event_id", k=5, runs=5, seed=42)
    folded = by_fold(lab.drop(LABEL).join(folds, "event_id"), ["run", "fold"])
    return C.cv_compare(folded, spec(), "siem_events")


@register("ablation_scores")
def ablation_scores(spark: SparkSession, d: str) -> DataFrame:
    """CV macro-F1 per feature-group mode."""
    lab = labelled(spark, d)
    folds = R.stratified_folds(lab.select("event_id", LABEL), LABEL, "event_id", k=5, seed=42)
    folded = by_fold(lab.drop(LABEL).join(folds, "event_id"), ["fold"])
    groups = {}
    for mode in ("BASE", "BASE+TIME", "BASE+URL", "BASE+UA", "ALL"):
        cols = feature_group_columns(lab.columns, mode)
        groups[mode] = ([c for c in cols if c not in CAT_COLS], [c for c in cols if c in CAT_COLS])
    return C.ablation(folded, spec(), groups, "siem_events")


@register("learning_curve")
def learning_curve(spark: SparkSession, d: str) -> DataFrame:
    """Stage-1 boosted trees with a validation slice cut from TRAIN;
    loss per iteration on that slice."""
    from pyspark.ml import Pipeline
    from ..functions.labels import binary_label
    train, _ = holdout(spark, d)
    t = train.withColumn("y", binary_label(LABEL, BENIGN).cast("double")) \
        .withColumn("is_val", D.validation_flag("event_id", 0.15))
    prep = build_preprocessor(NUM_COLS, CAT_COLS, features_col="features", tag="lc")
    gbt = D.learner("gbt", "y", "features", seed=42, maxIter=15, maxDepth=4,
                    validationIndicatorCol="is_val", validationTol=0.0)
    pm = Pipeline(stages=[*prep.getStages(), gbt]).fit(D.stable_order(t, "event_id"))
    val = pm.transform(t.filter(F.col("is_val")))
    return D.learning_curve(pm.stages[-1], val).withColumn("loss", r6("loss"))


def joint_model(train: DataFrame, rounds: int, depth: int, patience: int = 3) -> B.JointBoosting:
    """D2 + D6: joint boosting with a validation slice cut from the training rows."""
    prep = build_preprocessor(NUM_COLS, CAT_COLS, features_col="jb_features", tag="jb")
    return B.fit_joint_boosting(train, prep, LABEL, rounds=rounds, depth=depth, step=0.3,
                                validation=D.validation_flag("event_id", 0.15), patience=patience)


@register("joint_boosting_curve")
def joint_boosting_curve(spark: SparkSession, d: str) -> DataFrame:
    """D2 + D6 + D7: up to 5,000 rounds of a tree of depth 6 a class, stopped by validation macro-F1 (200 rounds without a
    better one): loss (training and validation rows) and macro-F1 (held-out test rows too) after every round, and the
    round that is kept."""
    train, test = signal_holdout(spark, d)
    model = joint_model(D.stable_order(train, "event_id"), CURVE_ROUNDS, 6, CURVE_WAIT)
    seen = B.curve_table(spark, model)
    cells = model.confusion_curve(test, LABEL).withColumn("part", F.lit("test"))
    tested = E.macro_f1_by(cells, ["part", "iteration"]).withColumn("loss", F.lit(None).cast("double")) \
        .withColumn("is_best", (F.col("iteration") == model.best).cast("int"))
    return seen.unionByName(tested).withColumn("loss", r6("loss")).withColumn("macro_f1", r6("macro_f1"))


@register("joint_boosting_report")
def joint_boosting_report(spark: SparkSession, d: str) -> DataFrame:
    """D2 as the main learner against the cascade: F1 of each class on the held-out rows, both fitted on the same rows
    (8 rounds of a tree of depth 6 a class; the cascade as the other registered queries fit it)."""
    train, test = signal_holdout(spark, d)
    train = D.stable_order(train, "event_id")
    joint = joint_model(train, 8, 6).predict(test)
    two = C.fit_two_stage(train, spec()).predict(test)
    reports = [E.class_report(D.materialize(m.select(LABEL, "y_pred")), LABEL, "y_pred", with_kind=True) for m in (joint, two)]
    return E.f1_compare(*reports, name_a="joint_f1")


@register("official_split_f1")
def official_split_f1(spark: SparkSession, d: str) -> DataFrame:
    """E6 on the given training and test part: F1 of each class, single stage and cascade (cut 0.3), and their difference."""
    lab = labelled_signal(spark, d)
    both = D.materialize(R.official_split(lab.where("event_id % 3 <> 1"), lab.where("event_id % 3 = 1")))
    train, test = D.stable_order(both.where("split = 'train'"), "event_id"), both.where("split = 'test'")
    prepared = C.fit_preparation(train, spec())
    reports = [E.class_report(D.materialize(m.predict(test).select(LABEL, "y_pred")), LABEL, "y_pred", with_kind=True)
               for m in (C.fit_single_stage(train, spec(), prepared=prepared), C.fit_two_stage(train, spec(threshold=0.3), prepared))]
    return E.f1_compare(*reports)


@register("mlp_weighted", f"""
WITH {HOLDOUT} SELECT attack_group AS class, CAST(count(*) AS BIGINT) AS support FROM held WHERE is_test = 1 GROUP BY attack_group""")
def mlp_weighted(spark: SparkSession, d: str) -> DataFrame:
    """D4 + D5: multi-class perceptron (no weightCol in MLlib) trained on rows
    replicated by their balanced class weight; report per class."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IndexToString, StringIndexer
    train, test = holdout(spark, d)
    rep = D.replicate_by_weight(A.attach_weights(train, LABEL), "weight", "event_id")
    idx = StringIndexer(inputCol=LABEL, outputCol="y", stringOrderType="alphabetAsc").fit(train)
    prep = build_preprocessor(NUM_COLS, CAT_COLS, scale=True, features_col="features", tag="mp").fit(rep)
    n_feat = len(prep.transform(rep.limit(1)).first()["features"])
    mlp = D.learner("mlp", "y", "features", seed=42, layers=D.mlp_layers(n_feat, len(idx.labels), (32, 16)),
                    maxIter=30)
    fitted = Pipeline(stages=[idx, mlp]).fit(D.stable_order(prep.transform(rep), "event_id"))
    pred = IndexToString(inputCol="prediction", outputCol="y_pred", labels=idx.labels) \
        .transform(fitted.transform(prep.transform(test)))
    return E.per_class(pred, LABEL, "y_pred").where("support > 0").select(F.col("label").alias("class"), "support")


@register("model_compare")
def model_compare(spark: SparkSession, d: str) -> DataFrame:
    """Several learners on one split; a failing one scores null and the loop goes on."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IndexToString, StringIndexer
    train, test = holdout(spark, d)
    train = D.stable_order(train, "event_id")
    idx = StringIndexer(inputCol=LABEL, outputCol="y", stringOrderType="alphabetAsc").fit(train)
    prepared = C.fit_preparation(train, spec())  # fills and encoders are the same for all learners

    def builder(kind, **p):
        def build():
            prep = build_preprocessor(NUM_COLS, CAT_COLS, scale=kind == "lr", features_col="features", tag="mc")
            return Pipeline(stages=[idx, *reuse_fits(prep, prepared).getStages(), D.learner(kind, "y", "features", **p)])
        return build

    def score(pred):
        pred = IndexToString(inputCol="prediction", outputCol="y_pred", labels=idx.labels).transform(pred)
        return E.macro_f1_values(pred, LABEL, ["y_pred"])[0]

    builders = {"rf": builder("rf", numTrees=20, maxDepth=6), "lr": builder("lr", maxIter=30),
                "ovr_gbt": builder("ovr_gbt", maxIter=3, maxDepth=4)}  # D2: boosted trees, several classes
    rows = D.compare_models(builders, train, test, score)
    return spark.createDataFrame([("siem_events", n, 0, 0, s, e) for n, s, e in rows],
                                 "dataset string, model string, run int, fold int, macro_f1 double, error string")


@register("save_load", f"WITH {HOLDOUT} SELECT event_id, 1 AS same FROM held WHERE is_test = 1")
def save_load(spark: SparkSession, d: str) -> DataFrame:
    """A fitted pipeline written to the shared checkpoint folder and read
    back predicts exactly as before."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer
    train, test = holdout(spark, d)
    idx = StringIndexer(inputCol=LABEL, outputCol="y", stringOrderType="alphabetAsc")
    prep = build_preprocessor(NUM_COLS, CAT_COLS, features_col="features", tag="sl")
    pm = Pipeline(stages=[idx, *prep.getStages(), D.learner("rf", "y", "features", numTrees=10, maxDepth=5)]) \
        .fit(D.stable_order(train, "event_id"))
    path = f"{checkpoint_root(spark)}/models/{uuid.uuid4().hex}"
    io.save_model(pm, path, NUM_COLS + CAT_COLS)
    back = io.load_model(path)
    a = pm.transform(test).select("event_id", F.col("prediction").alias("p_before"))
    b = back.transform(test).select("event_id", F.col("prediction").alias("p_after"))
    return a.join(b, "event_id").select("event_id", (F.col("p_before") == F.col("p_after")).cast("int").alias("same"))


@register("stream_model_alerts")
def stream_model_alerts(spark: SparkSession, d: str) -> DataFrame:
    """X1 with a trained cascade: fitted on the batch hold-out train rows, applied
    to the events log read as a stream; alerts per (day, predicted class)."""
    from ..functions.labels import attack_group
    from ..functions.scalar import parse_timestamp
    from ..operators.features import add_features
    from ..session import table
    from ..streaming.scoring import alert_counts, count_available, read_log_stream
    from . import fixtures as X
    from .catalog import scattered
    train, _ = holdout(spark, d)
    model = C.fit_two_stage(D.stable_order(train, "event_id"), spec())
    ev = read_log_stream(spark, scattered(spark, d, "events", 3), table(spark, d, "events").schema, max_files_per_trigger=1)

    def alerts(batch: DataFrame) -> DataFrame:
        feats = add_features(batch.selectExpr(*X.SIEM_EXPRS)).withColumn(LABEL, attack_group("attack_type"))
        return alert_counts(model.predict(feats.withColumn("_ts", parse_timestamp("timestamp"))), "_ts")

    return count_available(ev, alerts)


@register("cascade_save_load", f"WITH {HOLDOUT} SELECT event_id, 1 AS same FROM held WHERE is_test = 1")
def cascade_save_load(spark: SparkSession, d: str) -> DataFrame:
    """S9–S10 for a cascade with stage-specific weights (A6; A4 among attacks): both stages, labels and
    settings written and read back predict as before."""
    train, test = holdout(spark, d)
    model = C.fit_two_stage(D.stable_order(train, "event_id"), spec(stage_weights=True))
    path = f"{checkpoint_root(spark)}/models/{uuid.uuid4().hex}"
    io.save_cascade(model, path)
    a = model.predict(test).select("event_id", F.col("y_pred").alias("before"))
    b = io.load_cascade(path).predict(test).select("event_id", F.col("y_pred").alias("after"))
    return a.join(b, "event_id").select("event_id", (F.col("before") == F.col("after")).cast("int").alias("same"))


@register("official_split_report", f"""
WITH {SIEM}, lab AS (SELECT event_id, {_case_map('trim(attack_type)', L.ATTACK_GROUPS, "'other_attack'")} AS attack_group FROM siem)
SELECT attack_group AS class, CAST(count(*) AS BIGINT) AS support FROM lab WHERE event_id % 3 = 1 GROUP BY attack_group""")
def official_split_report(spark: SparkSession, d: str) -> DataFrame:
    """R5 used to train: fit on the given training part, per-class F1 of the single stage and of the
    cascade (cut 0.3) on the given test part."""
    lab = labelled(spark, d)
    both = D.materialize(R.official_split(lab.where("event_id % 3 <> 1"), lab.where("event_id % 3 = 1")))
    train, test = both.where("split = 'train'"), both.where("split = 'test'")
    train = D.stable_order(train, "event_id")
    prepared = C.fit_preparation(train, spec())
    single, two = (D.materialize(m.predict(test).select(LABEL, "y_pred")) for m in (
        C.fit_single_stage(train, spec(), prepared=prepared), C.fit_two_stage(train, spec(threshold=0.3), prepared)))
    f1 = E.f1_compare(E.class_report(single, LABEL, "y_pred", with_kind=True), E.class_report(two, LABEL, "y_pred", with_kind=True))
    support = E.per_class(two, LABEL, "y_pred").select(F.col("label").alias("class"), "support")
    return f1.join(support, "class").where("support > 0").select("class", "support")


@register("time_split_scores", f"""
WITH {SIEM}, lab AS (SELECT event_id, TRY_CAST(timestamp AS TIMESTAMP) AS t,
                            {_case_map('trim(attack_type)', L.ATTACK_GROUPS, "'other_attack'")} AS attack_group FROM siem),
o AS (SELECT event_id, attack_group, row_number() OVER (ORDER BY t NULLS LAST, event_id) AS r, count(*) OVER () AS n FROM lab)
SELECT event_id, attack_group AS y_true, 1 AS known_class FROM o WHERE r > floor(n * 0.7)""")
def time_split_scores(spark: SparkSession, d: str) -> DataFrame:
    """R4 used to train: time split → balanced weights → index-encoded trees (M6) → scores of the later rows."""
    f = siem_features(spark, d).withColumn(LABEL, L.attack_group("attack_type"))
    s = D.materialize(R.time_split(f, "timestamp", "event_id", 0.7).drop("timestamp", "src_ip", "dst_ip", "url", "user_agent"))
    train = D.stable_order(A.attach_weights(s.where("is_train = 1"), LABEL), "event_id")
    model = C.fit_single_stage(train, spec(weight_col="weight", encode="index"))
    return model.predict(s.where("is_train = 0")).select(
        "event_id", F.col(LABEL).alias("y_true"), F.col("y_pred").isin(model.labels).cast("int").alias("known_class"))


@register("learning_curve_f1")
def learning_curve_f1(spark: SparkSession, d: str) -> DataFrame:
    """Macro-F1 after each boosting iteration on train and validation rows, best iteration by the latter."""
    from pyspark.ml import Pipeline
    from ..functions.labels import binary_label
    train, _ = holdout(spark, d)
    t = D.stable_order(train.withColumn("y", binary_label(LABEL, BENIGN).cast("double"))
                       .withColumn("is_val", D.validation_flag("event_id", 0.15)), "event_id")
    prep = build_preprocessor(NUM_COLS, CAT_COLS, features_col="features", tag="lf").fit(t)
    rows = prep.transform(t)
    gbt = D.learner("gbt", "y", "features", seed=42, maxIter=8, maxDepth=4).fit(rows.where("not is_val"))
    return D.macro_f1_curve(gbt, rows.withColumn("part", F.when(F.col("is_val"), "validation").otherwise("train")), "y", "part")


@register("stage1_roc_auc")
def stage1_roc_auc(spark: SparkSession, d: str) -> DataFrame:
    """C1 + E5 + E8: the binary stage alone — its ROC AUC (ties half) and
    accuracy at the routing cut on held-out rows, as the reference reports for
    its benign-vs-attack stage."""
    from ..functions.labels import binary_label
    train, test = holdout(spark, d)
    model = C.fit_two_stage(D.stable_order(train, "event_id"), spec())
    scored = D.positive_probability(model.stage1.transform(test), "s1_probability", "p_attack") \
        .withColumn("y", binary_label(LABEL, BENIGN)) \
        .withColumn("y_hat", (F.col("p_attack") > F.lit(model.spec.threshold)).cast("int"))
    scored = D.materialize(scored.select("y", "y_hat", "p_attack"))
    auc = E.roc_auc(scored, "y", "p_attack")
    acc = E.accuracy(scored, "y", "y_hat")
    return auc.withColumn("accuracy", F.lit(acc.first()["accuracy"]))  # one-row result
