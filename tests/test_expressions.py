"""Row-wise features and labels on hand-written edge-case frames (V1–V9)."""
import datetime as dt

from pyspark.sql import functions as F

from twinstage.functions import labels as L
from twinstage.functions import scalar as S
from twinstage.operators.features import FeatureOptions, add_features, feature_group_columns


def one(spark, rows, schema, *cols):
    return spark.createDataFrame(rows, schema).select(*cols).collect()


def test_time_features_bad_and_weekend(spark):
    rows = [("2024-01-06 10:00:00",), ("2024-01-07 23:59:59",), ("2024-01-08 01:00:00",), ("garbage",), (None,)]
    ts = S.parse_timestamp("t")
    out = one(spark, rows, "t string", S.hour_of(ts).alias("h"), S.day_of_week(ts).alias("d"),
              S.is_weekend(ts).alias("w"), S.hour_of(ts, "zero").alias("hz"))
    assert [(r.h, r.d, r.w, r.hz) for r in out] == [
        (10, 5, 1, 10), (23, 6, 1, 23), (1, 0, 0, 1), (None, None, 0, 0), (None, None, 0, 0)]


def test_url_param_modes_differ_on_double_question_mark(spark):
    rows = [("?a=1?b=2&c=3",), ("",), (None,), ("/x?y=1",)]
    out = one(spark, rows, "u string", S.url_num_params("u", "all").alias("a"),
              S.url_num_params("u", "capped").alias("c"), S.text_len("u").alias("n"))
    assert [(r.a, r.c, r.n) for r in out] == [(3, 2, 12), (0, 0, 0), (0, 0, 0), (1, 1, 6)]


def test_command_variants(spark):
    rows = [("$(id)",), ("$()",), ("a||b",), ("a&&b",), ("plain",)]
    out = one(spark, rows, "u string", *[S.has_cmd_chars("u", v).alias(v) for v in ("open", "star", "plus")])
    assert [(r.open, r.star, r.plus) for r in out] == [(1, 1, 1), (1, 1, 0), (1, 1, 1), (1, 1, 1), (0, 0, 0)]


def test_xss_sql_ip(spark):
    rows = [("<SCRIPT>alert(1)",), ("%3Cscript",), ("x onload=y",), ("id=1'--",), ("http://10.1.2.3/a",), ("ok",)]
    out = one(spark, rows, "u string", S.has_xss("u").alias("x"), S.has_sql_chars("u").alias("s"),
              S.has_ip("u").alias("i"))
    assert [(r.x, r.s, r.i) for r in out] == [(1, 0, 0), (1, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0)]


def test_user_agent_flags(spark):
    rows = [("curl/8",), ("Wget",), ("python-requests",), ("Mozilla/5.0",), (None,)]
    flags = S.ua_flags("ua")
    out = one(spark, rows, "ua string", *[v.alias(k) for k, v in flags.items()])
    got = [(r.ua_len, r.ua_is_curl, r.ua_is_wget, r.ua_is_python, r.ua_is_browser) for r in out]
    assert got == [(6, 1, 0, 0, 0), (4, 0, 1, 0, 0), (15, 0, 0, 1, 0), (11, 0, 0, 0, 1), (0, 0, 0, 0, 0)]
    narrow = one(spark, [("urllib3",)], "ua string", S.ua_flags("ua", "python")["ua_is_python"].alias("p"))
    assert narrow[0].p == 0


def test_private_ip(spark):
    ips = ["10.0.0.1", "172.15.0.1", "172.16.0.1", "172.31.9.9", "172.32.0.1", "192.168.1.1", " 192.168.1.1 ",
           None, "8.8.8.8"]
    out = one(spark, [(i,) for i in ips], "ip string", S.is_private_ip("ip").alias("p"))
    assert [r.p for r in out] == [True, False, True, True, False, True, True, False, False]


def test_ports_and_bytes(spark):
    rows = [("80", 10.0, 0.0), ("22", 1.0, None), ("5432", 4.0, -1.0), ("abc", None, 3.0), (None, 2.0, 1.0)]
    ports = S.port_flags("p", "dst_port")
    b = S.byte_features("s", "r")
    out = one(spark, rows, "p string, s double, r double", *[v.alias(k) for k, v in {**ports, **b}.items()])
    assert [(r.dst_port_is_web, r.dst_port_is_ssh, r.dst_port_is_db) for r in out] == [
        (1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0), (0, 0, 0)]
    assert out[1].bytes_total == 1.0 and out[1].bytes_ratio_sent_recv == 1.0
    assert out[2].bytes_ratio_sent_recv is None  # -1 received: no ANSI division error
    assert abs(out[4].log_bytes_total - 1.3862943611198906) < 1e-12


def test_to_numeric_and_finite(spark):
    rows = [(" 12 ",), ("1e3",), ("inf",), ("abc",), ("",), ("1d",), ("2.5f",), (None,), ("nan",)]
    out = one(spark, rows, "t string", S.to_numeric("t").alias("x"))
    vals = [r.x for r in out]
    assert vals[:2] == [12.0, 1000.0] and vals[2] == float("inf") and vals[3:8] == [None] * 5
    fin = one(spark, rows, "t string", S.finite_or_null(S.to_numeric("t")).alias("x"))
    assert [r.x for r in fin] == [12.0, 1000.0, None, None, None, None, None, None, None]


def test_bool_text(spark):
    out = one(spark, [("TRUE",), ("false",), ("yes",), (None,)], "b string", S.bool_text_to_int("b").alias("v"))
    assert [r.v for r in out] == [1, 0, None, None]


def test_attack_groups_and_default(spark):
    rows = [(" port-scan ",), ("xss",), ("exploit-attempt",), ("zero-day",), (None,), ("benign",)]
    out = one(spark, rows, "a string", L.attack_group("a").alias("g"), L.attack_group("a", other="other").alias("o"))
    assert [r.g for r in out] == ["scanning", "injection", "malware_c2", "other_attack", "other_attack", "benign"]
    assert out[3].o == "other"


def test_label_repair_and_binary(spark):
    rows = [("Web Attack – XSS",), (" Web Attack � Sql Injection ",), ("Web Attack - Brute Force",), ("BENIGN",),
            (None,)]
    out = one(spark, rows, "l string", L.repair_label("l").alias("r"), L.binary_label("l", "BENIGN").alias("b"))
    assert [r.r for r in out] == ["Web Attack XSS", "Web Attack Sql Injection", "Web Attack Brute Force", "BENIGN",
                                  None]
    assert [r.b for r in out] == [1, 1, 1, 0, 1]


def test_add_features_missing_sources_and_groups(spark):
    df = spark.createDataFrame([(1, "tcp", 80, 22, 5.0, 3.0, "10.0.0.1", "10.0.0.2")],
                               "id int, protocol string, src_port int, dst_port int, bytes_sent double, "
                               "bytes_received double, src_ip string, dst_ip string")
    f = add_features(df, FeatureOptions(on_missing="skip"))
    assert "hour" not in f.columns and f.first().is_internal_traffic == 1
    g = add_features(df, FeatureOptions(on_missing="null"))
    assert g.first().hour is None and g.first().url_len == 0
    assert feature_group_columns(g.columns, "BASE")[0] == "protocol"
    assert feature_group_columns(g.columns, "BASE+TIME")[-3:] == ["hour", "dayofweek", "is_weekend"]
    all_cols = feature_group_columns(g.columns, "ALL")
    assert len(all_cols) == len(set(all_cols))
    import pytest
    with pytest.raises(ValueError):
        feature_group_columns(g.columns, "NOPE")
    with pytest.raises(ValueError):
        add_features(df, FeatureOptions(on_missing="error"))
    assert spark.range(1).select(S.sigmoid(F.lit(0.0))).first()[0] == 0.5


def test_flag_to_int_operator(spark):
    from twinstage.operators.clean import flag_to_int
    df = spark.createDataFrame([("True", 1), ("false", 2)], "is_internal string, x int")
    assert [r.is_internal for r in flag_to_int(df, ["is_internal", "absent"]).collect()] == [1, 0]


def test_label_operators_and_format_list(spark):
    from twinstage.operators import labels as LO
    df = spark.createDataFrame([(" Normal ",), ("DoS",), ("Exploits",), ("DoS",)], "c string")
    assert LO.find_label(df, "c", "normal") == " Normal "
    assert [r.c for r in LO.distinct_labels(df, "c").collect()] == [" Normal ", "DoS", "Exploits"]
    enc = LO.fit_label_encoder(df, "c", "i")
    back = LO.decode_labels(enc.transform(df), enc, "i", "c2").collect()
    assert [r.c for r in back] == [r.c2 for r in back]
    ts = S.parse_timestamp("t", ["dd/MM/yyyy HH:mm", "yyyy-MM-dd HH:mm:ss"])
    out = one(spark, [("06/01/2024 10:30",), ("2024-01-07 23:00:00",), ("nope",)], "t string",
              S.hour_of(ts).alias("h"), S.day_of_week(ts).alias("d"))
    assert [(r.h, r.d) for r in out] == [(10, 5), (23, 6), (None, None)]
