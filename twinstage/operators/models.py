"""Learners re-aimed at MLlib.

The reference trains XGBoost / CatBoost / sklearn / torch models on one machine.
Here every learner is an MLlib estimator: trees aggregate split statistics
per partition (``treeAggregate``), so training is distributed and the model is
broadcast at ``transform``. Boosting internals are not re-implemented.
"""

from __future__ import annotations

import traceback
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       OneVsRest, RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .small import checkpointed


def learner(kind: str, label_col: str, features_col: str = "features", weight_col: str | None = None,
            seed: int = 42, prefix: str = "", **params):
    """D1–D4. ``kind``: gbt (binary boosted trees), ovr_gbt (multi-class boosted trees),
    rf (random forest), lr (logistic regression), mlp (perceptron; needs ``layers``)."""
    out = dict(featuresCol=features_col, labelCol=label_col, predictionCol=f"{prefix}prediction")
    prob = dict(probabilityCol=f"{prefix}probability", rawPredictionCol=f"{prefix}rawPrediction")
    w = {"weightCol": weight_col} if weight_col else {}
    if kind == "gbt":
        p = dict(maxIter=20, maxDepth=5, stepSize=0.1, subsamplingRate=0.9, featureSubsetStrategy="0.9")
        p.update(params)
        g = GBTClassifier(seed=seed, **out, **w, **p)
        return g.setProbabilityCol(prob["probabilityCol"]).setRawPredictionCol(prob["rawPredictionCol"])
    if kind == "ovr_gbt":
        p = dict(maxIter=10, maxDepth=5, stepSize=0.1, subsamplingRate=0.9)
        p.update(params)
        base = GBTClassifier(seed=seed, featuresCol=features_col, **p)
        return OneVsRest(classifier=base, rawPredictionCol=f"{prefix}rawPrediction", parallelism=4, **out, **w)
    if kind == "rf":
        # deep forests: cache each row's node id between levels (checkpointed
        # every checkpointInterval into spark.checkpoint.dir) and give node
        # groups 1 GB of aggregation buffer, so fewer passes over the data
        p = dict(numTrees=50, maxDepth=8, maxBins=64, cacheNodeIds=True, maxMemoryInMB=1024)
        p.update(params)
        return RandomForestClassifier(seed=seed, **out, **prob, **w, **p)
    if kind == "lr":
        p = dict(maxIter=50, regParam=0.0)
        p.update(params)
        return LogisticRegression(**out, **prob, **w, **p)
    if kind == "mlp":
        p = dict(maxIter=50, blockSize=128)
        p.update(params)
        return MultilayerPerceptronClassifier(seed=seed, **out, **prob, **p)
    raise ValueError(f"unknown learner: {kind}")


def fit_learner(prep: Pipeline, estimator, train: DataFrame, first: list | None = None) -> PipelineModel:
    """Fit preparation, then the learner. Trees need as many bins as an index-encoded column (M6) has
    values: ``maxBins`` follows the fitted indexers. The assembled vectors, with label and weight, are written once: a
    tree learner reads its table several times."""
    from pyspark.ml.feature import OneHotEncoderModel, StringIndexerModel
    fitted = Pipeline(stages=[*(first or []), *prep.getStages()]).fit(train)
    encoded = {c for s in fitted.stages if isinstance(s, OneHotEncoderModel) for c in s.getInputCols()}
    sizes = [len(labels) + 1 for s in fitted.stages if isinstance(s, StringIndexerModel) and s.isSet(s.outputCols)
             for labels, out in zip(s.labelsArray, s.getOutputCols()) if out not in encoded]
    if estimator.hasParam("maxBins") and max(sizes, default=0) > estimator.getMaxBins():
        estimator = estimator.copy({estimator.maxBins: max(sizes)})
    model = estimator.fit(vectors(fitted.transform(train), estimator))
    return PipelineModel(stages=[*fitted.stages, model])


def fit_stored(pipeline: Pipeline, train: DataFrame) -> PipelineModel:
    """``pipeline.fit(train)``; a learner at its end reads vectors that are written once."""
    *prep, last = pipeline.getStages()
    if not all(hasattr(last, x) for x in ("fit", "getLabelCol", "getFeaturesCol")):
        return pipeline.fit(train)
    fitted = Pipeline(stages=prep).fit(train)
    return PipelineModel(stages=[*fitted.stages, last.fit(vectors(fitted.transform(train), last))])


def vectors(prepared: DataFrame, estimator) -> DataFrame:
    """What ``estimator`` reads of a prepared table, written once, rows and partitions as they were."""
    weight = [estimator.getWeightCol()] if estimator.hasParam("weightCol") and estimator.isSet("weightCol") else []
    return checkpointed(prepared.select(estimator.getLabelCol(), estimator.getFeaturesCol(), *weight))


def replicate_by_weight(df: DataFrame, weight_col: str, id_col: str, seed: int = 42,
                        copy_col: str = "copy") -> DataFrame:
    """Class weighting for a learner without ``weightCol`` (the perceptron).

    Weights are taken relative to the smallest positive one, so every row appears at least
    once: a row of relative weight w appears ⌊w⌋ times plus once more when its hash fraction
    is below frac(w). Deterministic, expected count exactly w, done by a generator (no
    shuffle of rows; the smallest weight is a one-row aggregate). Rows of weight 0 or null are left out.
    """
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))), 1, 8), 16, 10)
    u = h.cast("double") / F.lit(float(1 << 32))
    w = F.col(weight_col).cast("double")
    least = df.where(w > 0).agg(F.min(w)).first()[0] or 1.0
    w = w / F.lit(least)
    n = (F.floor(w) + (u < (w - F.floor(w))).cast("int")).cast("int")
    return df.where(w > 0).withColumn(copy_col, F.explode(F.sequence(F.lit(1), n)))


def materialize(df: DataFrame) -> DataFrame:
    """A split reused by every fit, written once to the shared checkpoint folder."""
    return checkpointed(df)


def stable_order(df: DataFrame, id_col: str, partitions: int | None = None) -> DataFrame:
    """Repeatable MLlib training: tree learners sample per partition, so fix the
    partitioning (hash of the id) and the order inside each partition — and
    write it once to the checkpoint folder, so the many fitting jobs (imputers,
    indexers, every tree level) read it instead of re-running the shuffle."""
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    return checkpointed(df.repartition(n, id_col).sortWithinPartitions(id_col))


def validation_flag(id_col: str, frac: float = 0.1, seed: int = 7) -> F.Column:
    """A validation slice cut from train by hash (never the test rows)."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"v{seed}:"), F.col(id_col).cast("string"))), 1, 8), 16, 10)
    return (h.cast("double") / F.lit(float(1 << 32))) < F.lit(frac)


def positive_probability(df: DataFrame, prob_col: str = "probability", out: str = "p_attack") -> DataFrame:
    """P(class 1) from the probability vector (no Python: ``vector_to_array``)."""
    return df.withColumn(out, vector_to_array(F.col(prob_col))[1])


def learning_curve(gbt_model, df: DataFrame) -> DataFrame:
    """Loss after each boosting iteration on ``df`` (MLlib evaluates all
    prefixes in one distributed pass)."""
    losses = gbt_model.evaluateEachIteration(df)
    spark = df.sparkSession
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(losses)],
                                 "iteration int, loss double")


def macro_f1_curve(gbt_model, rows: DataFrame, label: str, part: str, features: str = "features") -> DataFrame:
    """(part, iteration, macro_f1, best) of boosted binary trees, all iterations in one pass.

    The margin after i trees is the weighted sum of the first i tree predictions: each tree scores the
    rows once, running sums give every prefix, and one aggregate counts tp, fp, fn, tn per prefix.
    ``best`` marks the iteration of the highest macro-F1 on the part ``validation`` (the earliest of equals).
    """
    trees, weights = gbt_model.trees, list(gbt_model.treeWeights)
    scored = rows
    for i, tree in enumerate(trees):
        scored = tree.setPredictionCol(f"_t{i}").setFeaturesCol(features).transform(scored)
    total, steps = F.lit(0.0), []
    for i, w in enumerate(weights):
        total = total + F.lit(float(w)) * F.col(f"_t{i}")
        steps.append(F.struct(F.lit(i + 1).alias("iteration"), (total > 0).alias("hit")))
    long = scored.select(F.col(part).alias("part"), (F.col(label) == 1).alias("y"), F.explode(F.array(*steps)).alias("s"))

    def n(cond):
        return F.sum(F.when(cond, 1).otherwise(0))
    y, hit = F.col("y"), F.col("s.hit")
    c = long.groupBy("part", F.col("s.iteration").alias("iteration")).agg(
        n(y & hit).alias("tp"), n(~y & hit).alias("fp"), n(y & ~hit).alias("fn"), n(~y & ~hit).alias("tn"))
    f1 = [F.coalesce(F.try_divide(2.0 * F.col(a), 2 * F.col(a) + F.col("fp") + F.col("fn")), F.lit(0.0)) for a in ("tp", "tn")]
    c = checkpointed(c.select("part", "iteration", ((f1[0] + f1[1]) / 2).alias("macro_f1")))
    top = c.where("part = 'validation'").agg(F.min_by("iteration", F.struct((-F.col("macro_f1")).alias("m"), "iteration")).alias("i"))
    best = top.first()["i"]
    return c.withColumn("best", (F.col("iteration") == F.lit(best)).cast("int"))


def compare_models(builders: dict[str, Callable[[], Pipeline]], train: DataFrame, test: DataFrame,
                   score: Callable[[DataFrame], float], log=None) -> list[tuple[str, float | None, str | None]]:
    """Fit each named pipeline → (name, score, error); a failure records a null score with its
    message and the loop goes on."""
    results = []
    for name, build in builders.items():
        try:
            model = fit_stored(build(), train)
            results.append((name, float(score(model.transform(test))), None))
        except Exception:  # noqa: BLE001 — the reference's "NaN for that fold" behaviour
            if log:
                log(traceback.format_exc())
            results.append((name, None, traceback.format_exc(limit=1).strip().splitlines()[-1][:500]))
    return results


def mlp_layers(n_features: int, n_classes: int, hidden=(256, 128, 64)) -> list[int]:
    return [n_features, *hidden, max(n_classes, 2)]
