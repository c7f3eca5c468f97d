"""Hard negatives and periodic runs: against brute force."""

import random

import numpy as np
import pytest
from brute import WORD, hard_negatives, plant, sha, without_repeats, word_runs
from pyspark.sql import functions as F

from twinstage.llm import catalog, negatives, periodic

SMALL = "/root/testdata/sf0.001"
VEC = "vec_id long, embedding array<double>, label int"


def found(df):
    return sorted(((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect()), key=str)


# --- hard negatives ---------------------------------------------------------

def vectors(spark):
    """The small table and planted cases: nulls, other lengths, zeros, repeats of rows and ids, ties, huge values."""
    d = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>"), "label")
    nan, inf = float("nan"), float("inf")
    one, two = [0.5, 0.25, -0.125], [0.4, 0.3, -0.1]
    more = [(9000, one, 1), (9000, one, 1), (9050, two, 2), (9051, two, 1), (9052, [0.5, 0.26, 0.0], 2), (9053, [0.3, 0.2, 0.0], 2),
            (9053, [0.3, 0.2, 0.0], 2), (None, [0.3, 0.2, 0.0], 2), (None, one, 1), (9100, None, 1), (9150, [nan, 1.0], 1), (9151, [inf, 1.0], 1),
            (9200, [1.0, None], 1), (9250, [0.0, 0.0], 1), (9251, [0.0, 0.0], 1), (9252, [0.0, 0.0], 2), (9253, [1.0, 0.0], 2),
            (9300, [], 1), (9301, [], 1), (9302, [], 2), (9350, one, None), (9400, [3e5] * 5, 1), (9401, [2.9e5] * 5, 1),
            (9402, [2.6e5, 2.7e5, 2.5e5, 2.4e5, 1e5], 2), (9403, [2.5e5] * 5, 3), (-50, [-1.0, 0.5], 1), (-51, [-1.0, 0.4], 1), (-52, [-0.7, 0.4], 2)]
    return d.union(spark.createDataFrame(more, VEC))


@pytest.mark.parametrize("block", [negatives.BLOCK, 60])
def test_hard_negatives(spark, block, monkeypatch):
    monkeypatch.setattr(negatives, "ROW_TILE", 50)
    d = vectors(spark)
    got = negatives.hard_negatives(d.repartition(4), F.col("vec_id") % 50 == 0, block=block)
    want = hard_negatives([tuple(r) for r in d.collect()], lambda i: i % 50 == 0)
    assert found(got) == want
    assert {9000, 9250, 9300, 9400} <= {r[0] for r in want} and any(r[3] is None for r in want)
    assert [f.dataType.simpleString() for f in got.schema][:6] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]


def test_hard_negatives_other_numbers_and_columns(spark):
    rnd = np.random.RandomState(4)
    rows = [(i, [float(x) for x in rnd.normal(size=6)], int(rnd.randint(3)), "q", 1, 2) for i in range(120)]
    d = spark.createDataFrame(rows, "id long, v array<double>, key int, q string, anchor int, dim int")
    got = negatives.hard_negatives(d, F.col("id") < 9, "id", "v", "key", scale=10.0, positives=2, negatives=4, low=10, high=80, block=50)
    assert found(got) == hard_negatives([r[:3] for r in rows], lambda i: i < 9, 10, 2, 4, 10, 80)
    empty = negatives.hard_negatives(d.limit(0), F.col("id") < 9, "id", "v", "key")
    assert empty.count() == 0 and empty.columns[:4] == ["anchor_id", "positive_id", "rank", "negative_id"]
    assert negatives.hard_negatives(d, F.col("id") < 0, "id", "v", "key").count() == 0


def test_bounds_hold_for_every_pair():
    """Also for parallel, opposite, tiny and very long vectors."""
    rnd = np.random.RandomState(7)
    q = np.concatenate([rnd.randint(-300, 300, (150, 24)), rnd.randint(-2, 3, (50, 24)), np.eye(24, dtype=int)[:9] * 10**6, np.zeros((2, 24), int)])
    q = np.concatenate([q, 3 * q[:40], -q[:40], q[:40] + rnd.randint(0, 2, (40, 24))]).astype(float)
    norm = np.linalg.norm(q, axis=1)
    angles = negatives.angles_to(q, norm, negatives.directions(24))
    low, high = negatives.score_bounds(angles, norm, angles, norm)
    assert (low <= q @ q.T).all() and (q @ q.T <= high).all()
    tight = (high - low)[200:209, 200:209]  # axes: the interval is no trivial one
    assert (tight < 2 * norm[200] ** 2).any()


# --- periodic runs ----------------------------------------------------------

def texts(spark):
    rnd = random.Random(8)
    d = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    more = [(-1, None), (-2, ""), (-3, " \n\t "), (-4, "a " * 70_000), (-5, "a b " * 30_000 + "c"), (-6, "one two " * 9), (-7, "x x x x x"),
            (-7, "x x x x x x"), (-7, "x x x x x x"), (None, "a b a b a b a b"), (None, None), (-8, "a b c a b c a b c a b c a")]
    for k in range(300):
        w = [rnd.choice("abcde"[:rnd.randint(1, 5)]) for _ in range(rnd.randint(0, 80))]
        s, n = rnd.randrange(len(w) + 1), rnd.randint(1, 7)
        more.append((10_000 + k, "  ".join(w[:s] + w[s:s + n] * rnd.randint(1, 9) + w[s:])))
    return d.union(spark.createDataFrame(more, "doc_id long, text string"))


@pytest.mark.parametrize("batch_words", [periodic.BATCH_WORDS, 100])
def test_runs(spark, batch_words):
    d = texts(spark)
    got = periodic.periodic_runs(d.repartition(3), batch_words=batch_words).collect()
    want = []
    for i, t in (tuple(r) for r in d.collect()):
        w = WORD.findall(t or "")
        if len(w) < 40_000:
            runs = word_runs(w)
        else:
            runs = [(0, 70_000, 1)] if i == -4 else [(0, 60_000, 2)]
        want.append((i, len(w), runs, without_repeats(w, runs)))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.kept) for r in got), key=str) == sorted(want, key=str)


def test_runs_of_other_sizes():
    """Squares upwards, on words of one, two and three letters, periodic and Fibonacci words."""
    rnd = random.Random(9)
    a, b = "a", "ab"
    for _ in range(8):
        a, b = b, b + a
    words = [b, "abaab" * 9, "a" * 50, *("".join(rnd.choice("ab" + "c" * (k % 2)) for _ in range(k % 90)) for k in range(400))]
    for w in words:
        codes = np.frombuffer(w.encode(), np.uint8).astype(np.int64)
        for length, exponent in ((2, 2), (6, 4), (9, 3)):
            got = list(zip(*(x.tolist() for x in periodic.runs_of(codes, length, exponent))))
            assert got == word_runs(w, length, exponent), w


def test_runs_query(spark, tmp_path):
    texts(spark).withColumn("n", F.lit(1)).withColumn("w", F.lit("x")).write.parquet(str(tmp_path / "documents.parquet"))
    rows = [tuple(r) for r in spark.read.parquet(str(tmp_path / "documents.parquet")).select("doc_id", "text").collect()]
    got = catalog.queries()["op13_runs"](spark, str(tmp_path)).drop("n_words").collect()
    want = []
    for i, t in rows:
        w = plant(i, WORD.findall(t or ""))
        runs = word_runs(w) if len(w) < 40_000 else [(0, 70_000, 1)] if i == -4 else [(0, 60_000, 2)]
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        want.append((i, len(runs), s, n, q, 1000 * n // q if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs).encode()),
                     sha(without_repeats(w, runs).encode())))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    assert sum(plant(i, WORD.findall(t or "")) != WORD.findall(t or "") for i, t in rows) > 10


def test_runs_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, runs string")
    assert [r.runs for r in periodic.periodic_runs(d).collect()] == [[]]
    assert periodic.periodic_runs(d.limit(0)).count() == 0
