"""Dictionaries as tables: numbering, unseen and null values, hot values, sparse vectors."""
import pytest
from pyspark.sql import functions as F

from twinstage.operators import dictionary as D


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_numbers_follow_the_order_of_values(spark):
    values = ["b", "a", "", "é", "z", "b", None, "Z", "\U0001F600", "￿"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    d = D.fit_dictionary(df, "v")
    want = {v: k for k, v in enumerate(sorted(set(values) - {None}))}  # code points
    assert {r.value: r.idx for r in d.collect()} == want
    assert {r.value: r.n for r in d.collect()}["b"] == 2
    got = D.encode(df, d, "v", "i")
    assert rows(got, "v", "i") == sorted(((v, want.get(v)) for v in values), key=repr)
    assert rows(D.decode(got, d, "i", "back"), "v", "back") == sorted(((v, v) for v in values), key=repr)


def test_unseen_null_and_names(spark):
    d = D.fit_dictionary(spark.createDataFrame([("x",), ("y",)], "v string"), "v")
    df = spark.createDataFrame([("x", 1, 5, 7), ("q", 2, 6, 8), (None, 3, 7, 9), ("y", 4, 8, 9), ("y", 4, 8, 9)],
                               "`v.1` string, value int, idx int, _dhk int")
    assert rows(D.encode(df, d, "v.1", "n"), "v.1", "value", "idx", "_dhk", "n") == sorted(
        [("x", 1, 5, 7, 0), ("q", 2, 6, 8, None), (None, 3, 7, 9, None), ("y", 4, 8, 9, 1), ("y", 4, 8, 9, 1)], key=repr)
    assert rows(D.encode(df, d, "v.1", "idx", unseen="keep"), "value", "idx") == [(1, 0), (2, 2), (3, 2), (4, 1), (4, 1)]
    assert [r.w for r in D.decode(spark.createDataFrame([(9,), (None,)], "i long"), d, "i", "w").collect()] == [None, None]
    with pytest.raises(ValueError):
        D.encode(df, d, "value", "n", unseen="drop")


def test_empty_dictionary_and_table(spark):
    empty = spark.createDataFrame([], "v string")
    d = D.fit_dictionary(empty, "v")
    assert d.collect() == [] and D.encode(empty, d, "v", "i").collect() == []
    df = spark.createDataFrame([("a",), (None,)], "v string")
    assert [r.i for r in D.encode(df, d, "v", "i").collect()] == [None, None]
    assert all(r.oh_v.numNonzeros() == 0 for r in D.one_hot(df, {"v": d}).collect())


def test_sparse_vectors(spark):
    train = spark.createDataFrame([("a", 3), ("c", 1), ("b", 1)], "s string, k int")
    both = {c: D.fit_dictionary(train, c) for c in ("s", "k")}
    df = spark.createDataFrame([("c", 3), ("q", None), (None, 1)], "s string, k int")
    got = {(r.s, r.k): (r.oh_s, r.oh_k) for r in D.one_hot(df, both).collect()}
    assert {k: [(v.size, list(v.indices)) for v in vs] for k, vs in got.items()} == {
        ("c", 3): [(3, [2]), (2, [1])], ("q", None): [(3, []), (2, [])], (None, 1): [(3, []), (2, [0])]}


def test_million_values_and_a_hot_one(spark):
    n = 1_000_000
    wide = spark.range(0, 2 * n, 1, 8).select(
        "id", F.when(F.col("id") < n, F.format_string("%07d", F.col("id"))).otherwise(F.lit("hot")).alias("v"))
    d = D.fit_dictionary(wide, "v")
    hot = d.where("hot").collect()
    assert [(r.value, r.idx, r.n) for r in hot] == [("hot", n, n)] and d.count() == n + 1
    coded = D.encode(wide, d, "v", "i")
    assert coded.where("i IS NULL OR i <> least(id, 1000000)").count() == 0 and coded.count() == 2 * n
    plan = coded._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and plan.count("Join LeftOuter") == 2
