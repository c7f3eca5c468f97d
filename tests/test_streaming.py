"""The cascade on a stream gives the batch answer."""
from pyspark.sql import functions as F

from conftest import SF_SMALL

import __spark_entry__ as ENTRY
from twinstage.operators import cascade as C
from twinstage.streaming import scoring as ST


def test_stream_alerts_equal_batch(spark):
    got = {(r.window_start, r.y_pred): r.alerts for r in ENTRY.queries()["stream_alerts"](spark, SF_SMALL).collect()}
    from twinstage.plans import catalog as K
    from twinstage.plans import fixtures as X
    from twinstage.operators.features import add_features
    from twinstage.functions import scalar as S
    from twinstage.session import table
    feats = add_features(table(spark, SF_SMALL, "events").selectExpr(*X.SIEM_EXPRS))
    feats = feats.withColumn("_ts", S.parse_timestamp("timestamp"))
    batch = C.rule_cascade(feats, K._risk_score(), K._risk_class(), 0.1, "benign")
    exp = {(r.w.start.replace(tzinfo=None), r.y_pred): r.n for r in batch.where("_ts is not null")
           .groupBy(F.window("_ts", "1 day").alias("w"), "y_pred").agg(F.count("*").alias("n")).collect()}
    exp |= {(None, r.y_pred): r["count"] for r in batch.where("_ts is null").groupBy("y_pred").count().collect()}
    assert got == exp and sum(got.values()) == feats.count() and any(w is None for w, _ in got)


def test_trained_cascade_on_stream(spark, tmp_path):
    rows = [(i, float(i % 4), ["benign", "benign", "scan", "ddos"][i % 4], f"2024-01-0{1 + i % 3} 00:00:00")
            for i in range(200)]
    schema = "id long, x double, y string, ts string"
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "in"))
    spec = C.CascadeSpec(num_cols=["x"], cat_cols=[], label_col="y", benign="benign",
                         stage1_params=dict(maxIter=3, maxDepth=2), stage2_params=dict(numTrees=3, maxDepth=2))
    model = C.fit_two_stage(df, spec)
    stream = ST.read_log_stream(spark, str(tmp_path / "in"), df.schema)
    counts = ST.count_available(stream, lambda b: ST.alert_counts(model.predict(b), "ts"), base_dir=str(tmp_path / "ckpt"))
    total = counts.agg(F.sum("alerts")).first()[0]
    assert total == 200
    batch = model.predict(df).groupBy("y_pred").count().collect()
    per_class = {r.y_pred: r["sum(alerts)"] for r in counts.groupBy("y_pred").agg(F.sum("alerts")).collect()}
    assert per_class == {r.y_pred: r["count"] for r in batch}


def test_stream_reads_table_folders(spark, tmp_path):
    """The same stream query over events written as a folder of parts."""
    spark.read.parquet(f"{SF_SMALL}/events.parquet").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    q = ENTRY.queries()["stream_alerts"]
    a = sorted(map(str, q(spark, SF_SMALL).collect()))
    b = sorted(map(str, q(spark, str(tmp_path)).collect()))
    assert a == b and len(a) > 0


def test_nothing_is_late(spark, tmp_path):
    """Hourly files that arrive out of order, one per trigger, weeks apart: every row counts, undated ones too."""
    rows = [(i, f"2024-0{1 + i % 9}-01 0{i % 10}:00:00" if i % 7 else None, "x" if i % 2 else "y") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, ts string, y_pred string")
    for k in (3, 0, 2, 1):
        df.where(F.col("id") % 4 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ST.read_log_stream(spark, str(tmp_path / "in"), df.schema, max_files_per_trigger=1)
    got = ST.count_available(stream, lambda b: ST.alert_counts(b, "ts"), base_dir=str(tmp_path / "ckpt")).collect()
    assert sum(r.alerts for r in got) == 400
    assert sum(r.alerts for r in got if r.window_start is None) == len([r for r in rows if r[1] is None])


def test_empty_stream(spark, tmp_path):
    df = spark.createDataFrame([], "id long, ts string, y_pred string")
    (tmp_path / "in").mkdir()
    stream = ST.read_log_stream(spark, str(tmp_path / "in"), df.schema)
    assert ST.count_available(stream, lambda b: ST.alert_counts(b, "ts"), base_dir=str(tmp_path / "c")).count() == 0
