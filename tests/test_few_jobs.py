"""Steps of folds and comparisons that took a job, a file or a scan too many."""
import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from twinstage.operators import metrics as E
from twinstage.operators import models as D
from twinstage.operators import scoring as S
from twinstage.operators.prep import build_preprocessor


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(6)
    made = [(i, rnd.gauss(i % 3, 0.7), rnd.choice(["t", "u"]), "abc"[i % 3] if i % 31 else None, "abc"[i % 3 if i % 5 else 0], "abd"[i % 3]) for i in range(600)]
    return D.stable_order(spark.createDataFrame(made, "id long, x double, p string, y string, one string, two string"), "id", 2)


def jobs(spark) -> int:
    return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()


@pytest.mark.parametrize("kind, kw", [("rf", dict(numTrees=3, maxDepth=4)), ("gbt", dict(maxIter=2, maxDepth=3))])
def test_flat_form_of_a_model_takes_no_job(spark, rows, kind, kw):
    t = rows.withColumn("l", (F.col("y") == "a").cast("double")).where("y is not null")
    m = D.fit_learner(build_preprocessor(["x"], ["p"], features_col="f"), D.learner(kind, "l", "f", **kw), t)
    before = jobs(spark)
    flat = S.flat_pipeline(m)
    assert jobs(spark) == before
    assert len(flat.ensemble.cut) == sum(tree.numNodes for tree in m.stages[-1].trees)


def test_macro_f1_of_two_columns_in_one_shuffle(spark, rows):
    want = [E.macro_f1(rows, "y", c).first().macro_f1 for c in ("one", "two")]
    before = jobs(spark)
    got = E.macro_f1_values(rows, "y", ["one", "two"])
    assert jobs(spark) - before <= 2
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, want)) and E.macro_f1_values(rows.limit(0), "y", ["one"]) == [0.0]


def test_compared_learners_read_written_vectors(spark, rows):
    seen = []

    class Watched(DecisionTreeClassifier):
        def _fit(self, df):
            seen.append((df.columns, df._jdf.queryExecution().executedPlan().toString()))
            return super()._fit(df)

    def build():
        return Pipeline(stages=[StringIndexer(inputCol="y", outputCol="l", handleInvalid="skip"), *build_preprocessor(["x"], ["p"], features_col="f").getStages(),
                                Watched(featuresCol="f", labelCol="l", maxDepth=2)])
    got = D.compare_models({"tree": build, "none": lambda: 1 / 0}, rows, rows.where("y is not null"), lambda p: p.count())
    assert [(n, s) for n, s, _ in got] == [("tree", float(rows.where("y is not null").count())), ("none", None)]
    assert seen[0][0] == ["l", "f"] and "Scan ExistingRDD" in seen[0][1] and "UDF" not in seen[0][1]
