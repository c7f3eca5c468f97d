"""Aggregates, exact selection and split properties (§5.2 item 3)."""
import random

from pyspark.sql import functions as F

from twinstage.operators import rank as RK
from twinstage.operators import split as R
from twinstage.operators import stats as A
from twinstage.operators.prep import MedianImputer, ModeImputer, PopStandardScaler


def test_median_is_interpolated(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (10.0,), (20.0,), (None,)], "x double")
    assert A.medians(df, ["x"]).first().x == 6.0
    m = MedianImputer(inputCols=["x"]).fit(df)
    assert float(m.getOrDefault(m.surrogates)[0]) == 6.0
    assert [r.x for r in m.transform(df).collect()][-1] == 6.0


def test_mode_ties_smallest_and_all_null(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert A.modes(df, ["c"]).first().c == "a"
    m = ModeImputer(inputCols=["c"]).fit(df)
    assert [r.c for r in m.transform(df).collect()] == ["b", "a", "b", "a", "a"]
    empty = spark.createDataFrame([(None,), (None,)], "x double")
    mi = MedianImputer(inputCols=["x"]).fit(empty)
    assert [r.x for r in mi.transform(empty).collect()] == [None, None]


def test_scaler_population_std_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, c double")
    m = PopStandardScaler(inputCols=["a", "c"]).fit(df)
    out = m.transform(df).collect()
    assert [r.a for r in out] == [-1.0, 1.0] and [r.c for r in out] == [0.0, 0.0]


def test_class_weights_sum_to_n(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 3 + [("c",)], "y string")
    w = A.attach_weights(df, "y")
    assert abs(w.agg(F.sum("weight")).first()[0] - 10.0) < 1e-9
    shares = {r.y: r.share for r in A.class_shares(df, "y").collect()}
    assert shares == {"a": 0.6, "b": 0.3, "c": 0.1}
    assert [r.y for r in A.top_classes(df, "y", 2).collect()] == ["a", "b"]
    pw = A.positive_weight(spark.createDataFrame([(1,), (0,), (0,)], "l int"), "l").first()
    assert (pw.n_pos, pw.n_neg, pw.pos_weight) == (1, 2, 2.0)


def test_kth_smallest_matches_sort(spark):
    rnd = random.Random(3)
    vals = [rnd.choice([0.0, 1.5, 1e6, -3.25, rnd.random()]) for _ in range(3000)] + [None] * 7
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    srt = sorted(v for v in vals if v is not None)
    for k in (0, 1, 1499, 2998, 2999):
        v, _ = RK.kth_smallest(df, "x", k, pivots=10)
        assert v == srt[k]
    ids = spark.range(0, 100000).withColumn("g", (F.col("id") % 3).cast("long"))
    assert RK.kth_smallest(ids, "id", 77777, pivots=64)[0] == 77777


def _docs(spark, n=2000):
    rnd = random.Random(7)
    rows = [(i, rnd.choices(["big", "mid", "tiny"], [0.8, 0.17, 0.03])[0]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, y string")


def test_two_level_rank_equals_plain_rank(spark):
    df = _docs(spark)
    fast = RK.hashed_rank(df, "id", 42, [], ["y"], rows_per_bucket=20)  # forces many buckets
    from pyspark.sql import Window
    h = F.md5(F.concat(F.lit("42:"), F.col("id").cast("string")))
    plain = df.withColumn("r", F.row_number().over(Window.orderBy("y", h, "id")))
    a = {r.id: r._rank for r in fast.collect()}
    b = {r.id: r.r for r in plain.collect()}
    assert a == b


def test_folds_partition_and_balance(spark):
    df = _docs(spark)
    f = R.stratified_folds(df, "y", "id", 5, 42)
    assert f.count() == 2000 and f.select("id").distinct().count() == 2000
    per = f.groupBy("y", "fold").count().collect()
    for y in ("big", "mid", "tiny"):
        sizes = [r["count"] for r in per if r.y == y]
        assert max(sizes) - min(sizes) <= 1
    totals = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert max(totals) - min(totals) <= 1


def test_holdout_sizes_exact(spark):
    df = _docs(spark)
    h = R.holdout_split(df, "y", "id", 0.2, 42)
    assert h.agg(F.sum("is_test")).first()[0] == 400
    alloc = {r["_class"]: r["_quota"] for r in R.test_quotas(df, "y", 0.2).collect()}
    got = {r.y: r.t for r in h.groupBy("y").agg(F.sum("is_test").alias("t")).collect()}
    assert got == alloc


def test_repeated_folds_each_run_is_a_partition(spark):
    df = _docs(spark, 300)
    rf = R.repeated_folds(df, "y", "id", 3, 4, 42)
    assert rf.count() == 1200
    assert rf.groupBy("run", "id").count().where("count > 1").count() == 0
    a = {r.id: r.fold for r in rf.where("run = 0").collect()}
    b = {r.id: r.fold for r in rf.where("run = 1").collect()}
    assert a != b  # different seeds give different folds


def test_time_split_order_and_nulls(spark):
    import datetime as dt
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=(i * 37) % 500) if i % 9 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, ts timestamp")
    s = R.time_split(df, "ts", "id", 0.7)
    assert s.agg(F.sum("is_train")).first()[0] == 700
    tr = s.where("is_train = 1").agg(F.max("ts")).first()[0]
    te = s.where("is_train = 0 AND ts IS NOT NULL").agg(F.min("ts")).first()[0]
    assert tr <= te
    s95 = R.time_split(df, "ts", "id", 0.95)  # cut falls among the null timestamps
    assert s95.agg(F.sum("is_train")).first()[0] == 950
    assert s95.where("is_train = 0 AND ts IS NOT NULL").count() == 0


def test_selection_of_any_type_and_size(spark):
    """70,000 tied rows, text ids, full-range 64-bit ids: one method, one answer."""
    n = 70_000
    df = spark.range(n).select(F.lit(None).cast("timestamp").alias("ts"), F.col("id"), F.xxhash64("id").alias("h"),
                               F.concat(F.lit("e"), F.col("id").cast("string")).alias("t"))
    assert R.time_split(df, "ts", "t", 0.7).agg(F.sum("is_train")).first()[0] == 49_000
    assert R.time_split(df, "ts", "h", 0.7).agg(F.sum("is_train")).first()[0] == 49_000
    text = sorted(f"e{i}" for i in range(n))
    assert RK.kth_smallest(df, "t", 12_345)[0] == text[12_345]
    ends = spark.createDataFrame([(-2**63,), (2**63 - 1,), (0,)], "x long")
    assert [RK.kth_smallest(ends, "x", k)[0] for k in range(3)] == [-2**63, 0, 2**63 - 1]
    ties = spark.range(n).select((F.col("id") % 2).alias("x"))
    assert RK.kth_smallest(ties, "x", n // 2 + 5) == (1, 5)


def test_median_with_nan_and_infinities(spark):
    """A third NaN: missing, at every size."""
    for n in (1000, 90_000):
        df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).when(F.col("id") == 1, F.lit(float("inf")))
                                   .otherwise(F.col("id").cast("double")).alias("x"))
        m = MedianImputer(inputCols=["x"]).fit(df)
        vals = sorted(float(i) for i in range(n) if i % 3 and i != 1)
        k = len(vals)
        assert float(m.getOrDefault(m.surrogates)[0]) == (vals[(k - 1) // 2] + vals[k // 2]) / 2
        assert m.transform(df.where("isnan(x)")).limit(3).collect()[0].x == (vals[(k - 1) // 2] + vals[k // 2]) / 2


def test_null_class_has_a_weight(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "y string")
    assert sorted(r.weight for r in A.attach_weights(df, "y").collect()) == [0.75, 0.75, 1.5]


def test_kth_smallest_many_matches_sort(spark):
    rnd = random.Random(11)
    rows = [(rnd.random() * 100, float(rnd.randint(0, 5)), rnd.choice([None, 1.0, 2.0, 2.0, 1e9])) for _ in range(5000)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    targets = [("a", 0), ("a", 2499), ("a", 2500), ("b", 4999), ("b", 1234), ("c", 0), ("c", 100)]
    got = RK.kth_smallest_many(df, targets, accuracy=50)
    for (c, k), v in zip(targets, got):
        col = sorted(r[["a", "b", "c"].index(c)] for r in rows if r[["a", "b", "c"].index(c)] is not None)
        assert v == col[k], (c, k)


def test_select_median_equals_numpy(spark):
    rnd = random.Random(5)
    rows = [(rnd.gauss(0, 1), rnd.choice([None, 3, 4, 4])) for _ in range(3001)]
    df = spark.createDataFrame(rows, "x double, y int")
    import statistics
    row = A.medians(df, ["x", "y"]).first()
    assert row.x == statistics.median(r[0] for r in rows) and row.y == statistics.median(r[1] for r in rows if r[1] is not None)


def test_hot_class_is_spread_over_buckets(spark):
    """A class holding over a third of all rows still yields window partitions
    near the bucket target, and ranks stay exact."""
    n = 30000
    df = spark.range(0, n).withColumn("y", F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("c"), (F.col("id") % 50).cast("string"))))
    target = 500
    h = F.md5(F.concat(F.lit("42:"), F.col("id").cast("string")))
    counts = df.groupBy("y").count().withColumn("bits", RK.bucket_bits(F.col("count"), target))
    sizes = df.join(counts, "y").groupBy("y", RK.hash_bucket(h, F.col("bits")).alias("b")).count()
    assert sizes.agg(F.max("count")).first()[0] <= 2 * target
    assert sizes.where("y <> 'hot'").groupBy("y").count().agg(F.max("count")).first()[0] <= 2  # small classes aren't cut up
    ranked = RK.hashed_rank(df, "id", 42, ["y"], [], rows_per_bucket=target)
    per = ranked.groupBy("y").agg(F.min("_rank").alias("lo"), F.max("_rank").alias("hi"), F.count("*").alias("n"))
    assert all(r.lo == 1 and r.hi == r.n for r in per.collect())
    assert ranked.select("y", "_rank").distinct().count() == n


def test_time_split_on_text_timestamps(spark):
    rows = [(i, f"2024-01-{1 + i % 28:02d} 00:00:{i % 60:02d}" if i % 7 else "bad") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, t string")
    s = R.time_split(df, "t", "id", 0.7)
    assert s.columns == ["id", "t", "is_train"]
    assert s.agg(F.sum("is_train")).first()[0] == 210
    assert s.where("t = 'bad' AND is_train = 1").count() == 0  # unparseable sorts last


def test_middle_values_with_ties_and_empty_columns(spark):
    """One value on half of the rows, spread values, no values: the two middle ranks, also with a coarse sketch."""
    n = 20_001
    df = spark.range(n).select(F.when(F.col("id") % 2 == 0, F.lit(7.0)).otherwise(F.col("id") - 10_000.5).alias("ties"),
                               F.pmod(F.xxhash64("id"), F.lit(10**15)).alias("wide"), F.lit(None).cast("double").alias("none"),
                               F.when(F.col("id") < 4, F.col("id")).alias("few"))
    rows = df.toPandas()
    for accuracy in (50, 10_000):
        got = RK.middle_values(df, df.columns, accuracy)
        assert got["none"] is None
        for c in ("ties", "wide", "few"):
            v = sorted(rows[c].dropna().astype(float))
            assert got[c] == (v[(len(v) - 1) // 2], v[len(v) // 2]), (accuracy, c)


def test_time_split_reads_ranges_of_the_raw_column(spark):
    """Half of the rows share a time; any cut, both timestamp types, in a zone with clock changes."""
    n = 4000
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        for kind in ("timestamp", "timestamp_ntz"):
            base = F.lit("2024-03-10 01:30:00").cast(kind)
            step = F.when(F.col("id") % 2 == 0, 1000).otherwise(F.col("id")).cast("long")
            df = spark.range(n).select("id", F.when(F.col("id") % 10 < 9, base + F.make_dt_interval(mins=step.cast("int"))).alias("ts"))
            order = {r.id: r.k for r in df.selectExpr("id", "row_number() over (order by ts nulls last, id) as k").collect()}
            for frac in (0.001, 0.3, 0.7, 0.9, 0.95):
                train = {r.id for r in R.time_split(df, "ts", "id", frac).where("is_train = 1").select("id").collect()}
                assert train == {i for i, k in order.items() if k <= int(n * frac)}, (kind, frac)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_wrong_ends_do_not_matter(spark):
    df = spark.range(1000).select("id", F.timestamp_seconds("id").alias("ts"))
    for near in ((0, 5_000_000), (990_000_000, 1 << 62), (None, None)):
        assert RK.kth_in_order(df, "ts", "id", 500, 1000, near) == (500_000_000, 500)
