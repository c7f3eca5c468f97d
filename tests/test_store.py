"""The model store: parallel fits, a writer that dies, equal scores."""
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler

from twinstage.operators import models as D
from twinstage.sources import io
from twinstage.sources.store import ModelStore


def fit(spark, depth):
    d = spark.createDataFrame([(float(i), float(i // 10 % 2)) for i in range(80)], "x double, y double")
    return Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"),
                            D.learner("rf", "y", "features", numTrees=2, maxDepth=depth)]).fit(d)


def store(spark, path, save=io.save_model):
    return ModelStore(spark, str(path), save, io.load_model)


def test_parallel_fits_leave_the_best(spark, tmp_path):
    s = store(spark, tmp_path / "m")
    with pytest.raises(LookupError):
        s.best()
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda k: s.put(fit(spark, k + 1), [0.2, 0.9, 0.5, 0.9][k], f"v{k}"), range(4)))
    assert versions == ["v0", "v1", "v2", "v3"] and s.best() == ("v1", 0.9)  # equal scores: the smallest version
    back = s.load_best()
    assert isinstance(back, PipelineModel) and back.stages[-1].trees[0].depth <= 2
    assert {r.version: r.score for r in s.entries().collect()} == {"v0": 0.2, "v1": 0.9, "v2": 0.5, "v3": 0.9}


def test_a_writer_that_dies_leaves_no_candidate(spark, tmp_path):
    good = store(spark, tmp_path / "m")
    good.put(fit(spark, 1), 0.4, "a")

    def dies(model, path):
        io.save_model(model, path)
        raise OSError("killed while writing")

    with pytest.raises(OSError):
        store(spark, tmp_path / "m", dies).put(fit(spark, 2), 0.99, "b")
    half = tmp_path / "m" / "entries" / "c"  # killed while the entry was written: not moved to its place yet, or cut off
    (half / "_temporary" / "0").mkdir(parents=True)
    (half / "_temporary" / "0" / "part-0.json").write_text('{"version": "c", "score": 5.0, "fitted_at": 1.0}\n')
    (tmp_path / "m" / "entries" / "d").mkdir()
    (tmp_path / "m" / "entries" / "d" / "part-0.json").write_text('{"version": "d", "score": 5.0, "fit')
    assert good.best() == ("a", 0.4) and good.load_best().stages[-1].getNumTrees == 2
    with pytest.raises(Exception):
        good.put(fit(spark, 1), 0.5, "a")  # a version is put once
    with pytest.raises(ValueError):
        good.put(None, float("nan"))
