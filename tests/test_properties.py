"""Property tests (hypothesis) for split allocation and exact ranking."""
import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinstage.operators import rank as RK
from twinstage.operators import split as R


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 4), min_size=1, max_size=200), st.floats(0.05, 0.95))
def test_quotas_are_exact_and_proportional(spark, labels, frac):
    df = spark.createDataFrame([(f"c{v}" if v else None,) for v in labels], "y string")
    got = {r["_class"]: r["_quota"] for r in R.test_quotas(df, "y", frac).collect()}
    n, n_test = len(labels), math.ceil(frac * len(labels))
    assert sum(got.values()) == n_test
    for c, q in got.items():
        m = labels.count(int(c[1:]) if c else 0)
        assert 0 <= q <= m and abs(q - n_test * m / n) < 1.0 + 1e-9


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 3), min_size=5, max_size=300), st.integers(2, 6), st.integers(1, 64))
def test_folds_balanced_for_any_class_mix(spark, labels, k, rows_per_bucket):
    df = spark.createDataFrame([(i, f"c{v}") for i, v in enumerate(labels)], "id long, y string")
    ranked = RK.hashed_rank(df, "id", 7, [], ["y"], rows_per_bucket=rows_per_bucket)
    got = sorted(r._rank for r in ranked.collect())
    assert got == list(range(1, len(labels) + 1))
    f = R.stratified_folds(df, "y", "id", k, 7)
    per = {}
    for r in f.groupBy("y", "fold").count().collect():
        per.setdefault(r.y, {})[r.fold] = r["count"]
    for y, m in per.items():
        sizes = [m.get(i, 0) for i in range(k)]
        assert max(sizes) - min(sizes) <= 1


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=200), st.data())
def test_kth_smallest_any_multiset(spark, values, data):
    k = data.draw(st.integers(0, len(values) - 1))
    df = spark.createDataFrame([(v,) for v in values], "x long")
    v, j = RK.kth_smallest(df, "x", k, pivots=4)
    s = sorted(values)
    assert v == s[k] and j == k - s.index(s[k])
    w = RK.kth_smallest_many(df.withColumn("x", F.col("x").cast("double")), [("x", k)])
    assert w == [float(s[k])]
