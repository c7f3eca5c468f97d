"""Registered queries: one per operator group of the inventory, each with an
independently written DuckDB twin where SQL can express it.

Every query reads whole driver tables (or projections Spark derives from them),
so its work grows with the data. Doubles are rounded to 6 places on both sides;
counts are BIGINT and flags INTEGER on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels as L
from ..functions import scalar as S
from ..operators import cascade as C
from ..operators import clean as P
from ..operators import metrics as E
from ..operators import runstats as RS
from ..operators import split as R
from ..operators import stats as A
from ..operators.features import FeatureOptions, add_features, select_features
from ..operators.models import replicate_by_weight
from ..operators.prep import MedianImputer, ModeImputer, PopStandardScaler, one_hot_stages
from ..session import checkpoint_root, table
from ..sources import io as IO
from . import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn
    return deco


def r6(c) -> Column:
    """6-decimal rounding of the IEEE product x·1e6, half away from zero — the
    same arithmetic DuckDB's ``round(x, 6)`` does, so exact ties agree."""
    return F.round(S.col_of(c) * F.lit(1e6), 0) / F.lit(1e6)


SIEM = X.cte("siem", X.SIEM_EXPRS, "events")
DIRTY = X.cte("dirty", X.DIRTY_VALUE_EXPRS, "events")
PRIO = X.cte("prio", X.PRIORITY_EXPRS, "orders")
TIMINGS = X.cte("timings", X.TIMINGS_EXPRS, "orders")
SCORES = f"scores AS ({X.SCORES_SQL})"

# ---------------------------------------------------------------------------
# F1–F4 time features
# ---------------------------------------------------------------------------


@register("time_features", f"""
WITH {SIEM}, p AS (SELECT event_id, TRY_CAST(timestamp AS TIMESTAMP) AS t FROM siem)
SELECT event_id, CAST(hour(t) AS INTEGER) AS hour, CAST(isodow(t) - 1 AS INTEGER) AS dayofweek,
       CAST(COALESCE(isodow(t) - 1 >= 5, false) AS INTEGER) AS is_weekend,
       CAST(COALESCE(hour(t), 0) AS INTEGER) AS hour_or_zero
FROM p""")
def time_features(spark: SparkSession, d: str) -> DataFrame:
    s = X.siem(spark, d)
    ts = S.parse_timestamp("timestamp")
    return s.select("event_id", S.hour_of(ts).alias("hour"), S.day_of_week(ts).alias("dayofweek"),
                    S.is_weekend(ts).alias("is_weekend"), S.hour_of(ts, "zero").alias("hour_or_zero"))


# ---------------------------------------------------------------------------
# F5–F10 URL features, F7–F12 text flags
# ---------------------------------------------------------------------------

_IP, _SQLC, _XSS = S.IP_PATTERN, S.SQL_CHARS_PATTERN, S.XSS_PATTERN
_CMD, _CMDP = S.CMD_PATTERNS["open"], S.CMD_PATTERNS["plus"]


@register("url_features", rf"""
WITH u AS (SELECT page_id, COALESCE(url, '') AS u FROM pages)
SELECT page_id, CAST(length(u) AS INTEGER) AS url_len,
       CAST(len(regexp_extract_all(u, '[?&]')) AS INTEGER) AS url_num_params,
       CAST(len(regexp_extract_all(u, '&')) + CAST(contains(u, '?') AS INTEGER) AS INTEGER) AS url_num_params_capped,
       CAST(regexp_matches(u, '{_IP}') AS INTEGER) AS url_has_ip,
       CAST(regexp_matches(u, '{_SQLC.replace("'", "''")}') AS INTEGER) AS url_has_sql_chars,
       CAST(regexp_matches(u, '{_CMD}') AS INTEGER) AS url_has_cmd_chars,
       CAST(regexp_matches(u, '{_XSS}') AS INTEGER) AS url_has_xss
FROM u""")
def url_features(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select("page_id", S.text_len("url").alias("url_len"),
                    S.url_num_params("url", "all").alias("url_num_params"),
                    S.url_num_params("url", "capped").alias("url_num_params_capped"),
                    S.has_ip("url").alias("url_has_ip"), S.has_sql_chars("url").alias("url_has_sql_chars"),
                    S.has_cmd_chars("url").alias("url_has_cmd_chars"), S.has_xss("url").alias("url_has_xss"))


@register("text_attack_flags", rf"""
WITH t AS (SELECT doc_id, COALESCE(text, '') AS t FROM documents), l AS (SELECT doc_id, t, lower(t) AS lt FROM t)
SELECT doc_id,
       CAST(regexp_matches(t, '{_IP}') AS INTEGER) AS has_ip,
       CAST(regexp_matches(t, '{_SQLC.replace("'", "''")}') AS INTEGER) AS has_sql_chars,
       CAST(regexp_matches(t, '{_CMD}') AS INTEGER) AS has_cmd_chars,
       CAST(regexp_matches(t, '{_CMDP}') AS INTEGER) AS has_cmd_subst,
       CAST(regexp_matches(t, '{_XSS}') AS INTEGER) AS has_xss,
       CAST(length(t) AS INTEGER) AS ua_len,
       CAST(contains(lt, 'curl') AS INTEGER) AS ua_is_curl,
       CAST(contains(lt, 'wget') AS INTEGER) AS ua_is_wget,
       CAST(regexp_matches(lt, '{S.UA_PYTHON_PATTERNS["broad"]}') AS INTEGER) AS ua_is_python,
       CAST(regexp_matches(lt, '{S.UA_BROWSER_PATTERN}') AS INTEGER) AS ua_is_browser
FROM l""")
def text_attack_flags(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    ua = S.ua_flags("text")
    return t.select("doc_id", S.has_ip("text").alias("has_ip"), S.has_sql_chars("text").alias("has_sql_chars"),
                    S.has_cmd_chars("text").alias("has_cmd_chars"),
                    S.has_cmd_chars("text", "plus").alias("has_cmd_subst"),
                    S.has_xss("text").alias("has_xss"), *[v.alias(k) for k, v in ua.items()])


# ---------------------------------------------------------------------------
# F13–F16 ports and bytes, F17–F18 private IPs
# ---------------------------------------------------------------------------

def _port_sql(col: str, prefix: str) -> str:
    sets = {"web": S.WEB_PORTS, "ssh": S.SSH_PORTS, "db": S.DB_PORTS}
    return ", ".join(f"CAST(COALESCE({col} IN ({', '.join(map(str, v))}), false) AS INTEGER) AS {prefix}_is_{k}"
                     for k, v in sets.items())


@register("port_flags", f"""
SELECT l_orderkey, l_linenumber, {_port_sql('l_suppkey', 'src_port')}, {_port_sql('l_partkey', 'dst_port')}
FROM lineitem""")
def port_flags(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    cols = {**S.port_flags("l_suppkey", "src_port", "bigint"), **S.port_flags("l_partkey", "dst_port", "bigint")}
    return li.select("l_orderkey", "l_linenumber", *[v.alias(k) for k, v in cols.items()])


@register("byte_features", """
WITH b AS (SELECT l_orderkey, l_linenumber, COALESCE(l_extendedprice, 0) AS s, COALESCE(l_quantity, 0) AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, round(s + r, 6) AS bytes_total, round(s / (r + 1.0), 6) AS bytes_ratio_sent_recv,
       round(ln(1 + s + r), 6) AS log_bytes_total
FROM b""")
def byte_features(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    cols = S.byte_features("l_extendedprice", "l_quantity", "double", "double")
    return li.select("l_orderkey", "l_linenumber", *[r6(v).alias(k) for k, v in cols.items()])


_PRIV = S.PRIVATE_IP_PATTERN


@register("private_ip", f"""
WITH {SIEM}
SELECT event_id, CAST(COALESCE(regexp_matches(trim(src_ip), '{_PRIV}'), false) AS INTEGER) AS src_private,
       CAST(COALESCE(regexp_matches(trim(dst_ip), '{_PRIV}'), false) AS INTEGER) AS dst_private,
       CAST(COALESCE(regexp_matches(trim(src_ip), '{_PRIV}') AND regexp_matches(trim(dst_ip), '{_PRIV}'), false)
            AS INTEGER) AS is_internal_traffic
FROM siem""")
def private_ip(spark: SparkSession, d: str) -> DataFrame:
    s = X.siem(spark, d)
    return s.select("event_id", S.is_private_ip("src_ip").cast("int").alias("src_private"),
                    S.is_private_ip("dst_ip").cast("int").alias("dst_private"),
                    S.is_internal_traffic("src_ip", "dst_ip").alias("is_internal_traffic"))


# ---------------------------------------------------------------------------
# P4–P6, P8 cleaning
# ---------------------------------------------------------------------------

_SUFFIX = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[dDfF]\s*$"


@register("coerce_numeric", rf"""
WITH p AS (SELECT page_id, regexp_extract(url, '[^/]*$') AS piece FROM pages),
c AS (SELECT page_id, piece, CASE WHEN regexp_matches(piece, '{_SUFFIX}') THEN NULL
                                  ELSE TRY_CAST(piece AS DOUBLE) END AS num FROM p)
SELECT page_id, piece, round(num, 6) AS num, CAST(num IS NOT NULL AS INTEGER) AS is_num FROM c""")
def coerce_numeric(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.substring_index("url", "/", -1).alias("piece"))
    c = P.coerce_numeric(p.withColumn("num", F.col("piece")), ["num"])
    return c.select("page_id", "piece", r6("num").alias("num"), F.col("num").isNotNull().cast("int").alias("is_num"))


@register("finite_complete", f"""
WITH {DIRTY}, v AS (SELECT event_id, user_id, TRY_CAST(value_txt AS DOUBLE) AS value FROM dirty),
f AS (SELECT event_id, user_id, CASE WHEN isfinite(value) THEN value END AS value FROM v)
SELECT event_id, user_id, round(value, 6) AS value FROM f WHERE value IS NOT NULL AND user_id IS NOT NULL""")
def finite_complete(spark: SparkSession, d: str) -> DataFrame:
    v = X.dirty_values(spark, d).withColumnRenamed("value_txt", "value")
    v = P.nonfinite_to_null(P.coerce_numeric(v, ["value"]), ["value"])
    v = P.complete_rows(v, ["value", "user_id"])
    return v.select("event_id", "user_id", r6("value").alias("value"))


def _siem_feature_sql() -> str:
    ts = "TRY_CAST(timestamp AS TIMESTAMP)"
    u, lt = "COALESCE(url, '')", "lower(COALESCE(user_agent, ''))"
    priv = lambda c: f"COALESCE(regexp_matches(trim({c}), '{_PRIV}'), false)"
    return f"""
WITH {SIEM}
SELECT event_id, protocol, src_port, dst_port, round(bytes_sent, 6) AS bytes_sent,
       round(CAST(bytes_received AS DOUBLE), 6) AS bytes_received,
       CAST({priv('src_ip')} AND {priv('dst_ip')} AS INTEGER) AS is_internal_traffic,
       round(COALESCE(bytes_sent, 0) + COALESCE(bytes_received, 0), 6) AS bytes_total,
       round(COALESCE(bytes_sent, 0) / (COALESCE(bytes_received, 0) + 1.0), 6) AS bytes_ratio_sent_recv,
       round(ln(1 + COALESCE(bytes_sent, 0) + COALESCE(bytes_received, 0)), 6) AS log_bytes_total,
       {_port_sql('src_port', 'src_port')}, {_port_sql('dst_port', 'dst_port')},
       CAST(hour({ts}) AS INTEGER) AS hour, CAST(isodow({ts}) - 1 AS INTEGER) AS dayofweek,
       CAST(COALESCE(isodow({ts}) - 1 >= 5, false) AS INTEGER) AS is_weekend,
       CAST(length({u}) AS INTEGER) AS url_len,
       CAST(len(regexp_extract_all({u}, '[?&]')) AS INTEGER) AS url_num_params,
       CAST(regexp_matches({u}, '{_IP}') AS INTEGER) AS url_has_ip,
       CAST(regexp_matches({u}, '{_SQLC.replace("'", "''")}') AS INTEGER) AS url_has_sql_chars,
       CAST(regexp_matches({u}, '{_CMD}') AS INTEGER) AS url_has_cmd_chars,
       CAST(regexp_matches({u}, '{_XSS}') AS INTEGER) AS url_has_xss,
       CAST(length(COALESCE(user_agent, '')) AS INTEGER) AS ua_len,
       CAST(contains({lt}, 'curl') AS INTEGER) AS ua_is_curl,
       CAST(contains({lt}, 'wget') AS INTEGER) AS ua_is_wget,
       CAST(regexp_matches({lt}, '{S.UA_PYTHON_PATTERNS["broad"]}') AS INTEGER) AS ua_is_python,
       CAST(regexp_matches({lt}, '{S.UA_BROWSER_PATTERN}') AS INTEGER) AS ua_is_browser
FROM siem"""


def siem_features(spark: SparkSession, d: str, opts: FeatureOptions = FeatureOptions()) -> DataFrame:
    """The SIEM stand-in with every engineered column (used by the trained queries too)."""
    return add_features(X.siem(spark, d), opts)


@register("feature_groups", _siem_feature_sql())
def feature_groups(spark: SparkSession, d: str) -> DataFrame:
    f = select_features(siem_features(spark, d), "ALL", keep=["event_id"])
    dbl = [c for c, t in f.dtypes if t == "double"]
    return f.withColumns({c: r6(F.col(c).cast("double")) for c in dbl + ["bytes_received"]})


@register("trim_names", """
SELECT c_custkey, c_name, c_mktsegment FROM customer""")
def trim_names(spark: SparkSession, d: str) -> DataFrame:
    """Names padded as in the headers of published flow files."""
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    padded = c.toDF(*[f" {name}  " for name in c.columns])
    return P.trim_column_names(padded).select("c_custkey", "c_name", "c_mktsegment")


_ROLES = [("o_custkey", "numeric"), ("o_totalprice", "numeric"), ("o_orderstatus", "categorical"),
          ("o_orderdate", "categorical"), ("o_orderpriority", "categorical")]


@register("column_roles", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{role}' AS role, count({c}) AS n_present, count(DISTINCT {c}) AS n_values FROM orders"
    for c, role in _ROLES) + ")")
def column_roles(spark: SparkSession, d: str) -> DataFrame:
    """P3 by type, the key left out: each column's role, rows with a value, and distinct values."""
    o = table(spark, d, "orders")
    nums, cats = P.column_roles(o, exclude=["o_orderkey"])
    long = o.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit("numeric" if c in nums else "categorical").alias("role"),
                                                 F.col(c).cast("string").alias("v")) for c in [*nums, *cats]])).alias("x"))
    return long.groupBy("x.column_name", "x.role").agg(F.count("x.v").alias("n_present"), F.count_distinct("x.v").alias("n_values"))


@register("drop_raw_columns", f"""
WITH {SIEM} SELECT event_id, src_port, dst_port, round(bytes_sent, 6) AS bytes_sent, bytes_received FROM siem""")
def drop_raw_columns(spark: SparkSession, d: str) -> DataFrame:
    """P1 + P11: targets, raw text and raw IPs dropped when present (absent names
    ignored), then the categorical columns dropped by the ablation switch."""
    s = X.siem(spark, d)
    s = P.drop_present(s, ["attack_type", "label", "timestamp", "src_ip", "dst_ip", "url", "user_agent", "id"])
    s = P.drop_present(s, ["protocol"])
    return s.withColumn("bytes_sent", r6("bytes_sent"))


@register("attack_rows", "SELECT doc_id, lang FROM documents WHERE lang IS NULL OR lang <> 'en'")
def attack_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows stage 2 trains on (null class kept, as pandas ``!=`` does)."""
    return P.filter_attacks(table(spark, d, "documents").select("doc_id", "lang"), "lang", "en")


_FLAG_TXT = "CASE user_id % 3 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'false' ELSE 'maybe' END"


@register("flag_text", f"""
SELECT event_id, CASE lower({_FLAG_TXT}) WHEN 'true' THEN 1 WHEN 'false' THEN 0 END AS is_internal FROM events""")
def flag_text(spark: SparkSession, d: str) -> DataFrame:
    """A text flag column ('TRUE' / 'false' / other) → 1 / 0 / null."""
    ev = table(spark, d, "events").selectExpr("event_id", f"{_FLAG_TXT} AS is_internal")
    return P.flag_to_int(ev, ["is_internal"])


@register("fill_constants", f"""
WITH {PRIO} SELECT o_orderkey, COALESCE(priority, 'missing') AS priority FROM prio""")
def fill_constants(spark: SparkSession, d: str) -> DataFrame:
    """P10: constant null fill of a text column."""
    return P.fill_constants(X.priorities(spark, d), {"priority": "missing"}).select("o_orderkey", "priority")


# ---------------------------------------------------------------------------
# S2–S6 sources and profile
# ---------------------------------------------------------------------------

@register("profile", """
SELECT 'c_custkey' AS "column", 0 AS position, count(*) AS n_rows, count(*) - count(c_custkey) AS n_null,
       CAST(min(c_custkey) AS DOUBLE) AS min_num, CAST(max(c_custkey) AS DOUBLE) AS max_num,
       CAST(NULL AS VARCHAR) AS min_str, CAST(NULL AS VARCHAR) AS max_str FROM customer
UNION ALL SELECT 'c_name', 1, count(*), count(*) - count(c_name), NULL, NULL, min(c_name), max(c_name) FROM customer
UNION ALL SELECT 'c_nationkey', 2, count(*), count(*) - count(c_nationkey), min(c_nationkey), max(c_nationkey),
       NULL, NULL FROM customer
UNION ALL SELECT 'c_acctbal', 3, count(*), count(*) - count(c_acctbal), round(min(c_acctbal), 6),
       round(max(c_acctbal), 6), NULL, NULL FROM customer
UNION ALL SELECT 'c_mktsegment', 4, count(*), count(*) - count(c_mktsegment), NULL, NULL, min(c_mktsegment),
       max(c_mktsegment) FROM customer""")
def profile(spark: SparkSession, d: str) -> DataFrame:
    p = A.profile(table(spark, d, "customer"))
    return p.select("column", "position", "n_rows", "n_null", r6("min_num").alias("min_num"),
                    r6("max_num").alias("max_num"), "min_str", "max_str")


@register("union_sources", """
SELECT event_id, 'part0' AS source, 'train' AS split, event_type, CAST(NULL AS BIGINT) AS user_id,
       round(value, 6) AS value FROM events WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 'part1', 'train', event_type, user_id, round(value, 6) FROM events WHERE event_id % 3 = 1
UNION ALL SELECT event_id, 'part2', 'test', event_type, user_id, NULL FROM events WHERE event_id % 3 = 2""")
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    # three "files" of one log with different headers (the fixture's cut by event_id % 3)
    p0 = ev.where(F.col("event_id") % 3 == 0).select("event_id", "value", "event_type") \
        .withColumn("source", F.lit("part0"))
    p1 = ev.where(F.col("event_id") % 3 == 1).select("event_type", "user_id", "event_id", "value") \
        .withColumn("source", F.lit("part1"))
    p2 = ev.where(F.col("event_id") % 3 == 2).select("user_id", "event_id", "event_type") \
        .withColumn("source", F.lit("part2"))
    train = p0.unionByName(p1, allowMissingColumns=True)
    both = R.official_split(train, p2)
    return both.select("event_id", "source", "split", "event_type", "user_id", r6("value").alias("value"))


def _csv_parts(spark: SparkSession, d: str) -> str:
    """`events` written to shared storage as CSV folders whose headers differ in order and in columns."""
    import uuid
    root = f"{checkpoint_root(spark)}/csv/{uuid.uuid4().hex}"
    ev = table(spark, d, "events")
    for k, cols in enumerate((["event_id", "value", "event_type"], ["event_type", "user_id", "event_id", "value"],
                              ["user_id", "event_id", "event_type"])):
        ev.where(F.col("event_id") % 3 == k).select(*cols).write.option("header", True).csv(f"{root}/part{k}")
    return root


@register("csv_folder", """
SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN user_id END AS user_id, event_type,
       round(CASE WHEN event_id % 3 <> 2 THEN value END, 6) AS value FROM events""")
def csv_folder(spark: SparkSession, d: str) -> DataFrame:
    """A folder of CSV files with differing headers, bound by name, typed afterwards."""
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
                           T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
    got = IO.read_folder(spark, f"{_csv_parts(spark, d)}/*", "*.csv", schema)
    return got.select("event_id", "user_id", "event_type", r6("value").alias("value"))


@register("csv_rejected", """
SELECT event_id % 3 AS part, CASE WHEN event_id % 11 = 0 THEN 'fields' WHEN event_id % 13 = 0 AND event_id % 3 <> 2 THEN 'value' ELSE 'good' END AS reason,
       count(*) AS n, CAST(sum(CASE WHEN event_id % 11 <> 0 THEN event_id END) AS BIGINT) AS ids FROM events GROUP BY ALL""")
def csv_rejected(spark: SparkSession, d: str) -> DataFrame:
    """S1–S2 with the channel of rejected rows: broken lines of each file are told apart and add up with the good ones."""
    import uuid
    root = f"{checkpoint_root(spark)}/csv/{uuid.uuid4().hex}"
    ev = table(spark, d, "events")
    odd, wrong = F.col("event_id") % 11 == 0, F.col("event_id") % 13 == 0
    value = F.when(wrong, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    for k, cols in enumerate(({"event_id": None, "value": value}, {"value": value, "user_id": None, "event_id": None}, {"user_id": None, "event_id": None})):
        cells = F.concat_ws(",", *[F.col(c) if e is None else e for c, e in cols.items()])
        lines = ev.where(F.col("event_id") % 3 == k).select(F.when(odd, F.concat(F.lit("1,2,"), cells)).otherwise(cells).alias(",".join(cols)))
        # one column whose name is the header, unquoted
        lines.write.option("header", True).option("quote", "").option("sep", "\t").csv(f"{root}/part{k}")
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("value", T.DoubleType())])
    good, bad = IO.read_folder_checked(spark, f"{root}/*", "*.csv", schema)
    part = F.regexp_extract("file", "/part([0-9])/", 1).cast("long")
    both = good.select(part.alias("part"), F.lit("good").alias("reason"), "event_id").unionByName(
        bad.select(part.alias("part"), "reason", F.when(F.col("reason") != "fields", F.element_at(F.split("line", ","), -1).try_cast("long")).alias("last"),
                   F.element_at(F.split("line", ","), 1).try_cast("long").alias("first"))
        .select("part", "reason", F.when(F.col("reason") != "fields", F.when(F.col("part") == 0, F.col("first")).otherwise(F.col("last"))).alias("event_id")))
    return both.groupBy("part", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@register("csv_pair", """
SELECT event_id, 'train' AS split, event_type, round(value, 6) AS value FROM events WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 'test', event_type, round(value, 6) FROM events WHERE event_id % 3 = 1""")
def csv_pair(spark: SparkSession, d: str) -> DataFrame:
    """The train and test files of a data set, headers in different order."""
    root = _csv_parts(spark, d)
    both = IO.read_pair(spark, f"{root}/part0", f"{root}/part1", required=["event_id", "value", "event_type"])
    typed = P.coerce_numeric(both, ["event_id", "value"])
    return typed.select(F.col("event_id").cast("long").alias("event_id"), "split", "event_type", r6("value").alias("value"))


@register("scores_roundtrip", f"""
WITH {SCORES} SELECT dataset, model, run, fold, round(macro_f1, 6) AS macro_f1 FROM scores""")
def scores_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Fold scores written as JSON and read back, through a Parquet table."""
    import uuid
    root = f"{checkpoint_root(spark)}/scores/{uuid.uuid4().hex}"
    IO.write_scores(X.fold_scores(spark, d), f"{root}/json")
    IO.write_table(IO.read_scores(spark, f"{root}/json"), f"{root}/table", partition_by=["dataset"])
    back = spark.read.parquet(f"{root}/table")
    return back.select("dataset", "model", "run", "fold", r6("macro_f1").alias("macro_f1"))


# ---------------------------------------------------------------------------
# L1–L6 labels
# ---------------------------------------------------------------------------

def _case_map(expr: str, mapping: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {default} END"


@register("attack_groups", f"""
WITH {SIEM}
SELECT event_id, attack_type, {_case_map('trim(attack_type)', L.ATTACK_GROUPS, "'other_attack'")} AS attack_group
FROM siem""")
def attack_groups(spark: SparkSession, d: str) -> DataFrame:
    s = X.siem(spark, d)
    return s.select("event_id", "attack_type", L.attack_group("attack_type").alias("attack_group"))


_RAW_LABEL = ("CASE lang WHEN 'en' THEN 'BENIGN' "
              "WHEN 'fr' THEN 'Web Attack ' || CASE doc_id % 3 WHEN 0 THEN '–' WHEN 1 THEN '-' ELSE '�' END || ' Brute Force' "
              "WHEN 'de' THEN ' Web Attack ' || CASE doc_id % 3 WHEN 0 THEN '–' WHEN 1 THEN '-' ELSE '�' END || ' XSS ' "
              "ELSE 'Web Attack ' || CASE doc_id % 3 WHEN 0 THEN '–' WHEN 1 THEN '-' ELSE '�' END || ' Sql Injection' END")


@register("label_repair", f"""
WITH r AS (SELECT doc_id, {_RAW_LABEL} AS raw_label FROM documents)
SELECT doc_id, raw_label, {_case_map('trim(raw_label)', L.WEB_ATTACK_SPELLINGS, 'trim(raw_label)')} AS label FROM r""")
def label_repair(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "documents").selectExpr("doc_id", f"{_RAW_LABEL} AS raw_label")
    return r.select("doc_id", "raw_label", L.repair_label("raw_label").alias("label"))


@register("binary_label", """
WITH b AS (SELECT min(lang) AS benign FROM documents WHERE lower(trim(lang)) = 'en')
SELECT doc_id, lang, CAST(COALESCE(lang <> (SELECT benign FROM b), true) AS INTEGER) AS is_attack FROM documents""")
def binary_label(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.labels import find_label
    docs = table(spark, d, "documents")
    benign = find_label(docs, "lang", "en")  # L4: ignoring case and padding
    return docs.select("doc_id", "lang", L.binary_label("lang", benign or "en").alias("is_attack"))


@register("label_encode", """
SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS lang_idx FROM documents""")
def label_encode(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.labels import fit_label_encoder
    docs = table(spark, d, "documents").select("doc_id", "lang")
    m = fit_label_encoder(docs, "lang", "lang_idx")
    return m.transform(docs).withColumn("lang_idx", F.col("lang_idx").cast("int"))


@register("dictionary_encode", """
WITH d AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS v FROM orders))
SELECT c_custkey, CAST(i AS BIGINT) AS idx, CAST(COALESCE(i, (SELECT count(*) FROM d)) AS BIGINT) AS kept_idx
FROM customer LEFT JOIN d ON v = CAST(c_custkey AS VARCHAR)""")
def dictionary_encode(spark: SparkSession, d: str) -> DataFrame:
    """Customers by the dictionary of those with orders; the others are unseen."""
    from ..operators import dictionary as D
    keys = D.fit_dictionary(table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("v")), "v")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("v"))
    return D.encode(D.encode(c, keys, "v", "idx"), keys, "v", "kept_idx", unseen="keep").drop("v")


@register("dictionary_decode", """
SELECT event_id, event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS BIGINT) AS idx, event_type AS decoded FROM events""")
def dictionary_decode(spark: SparkSession, d: str) -> DataFrame:
    """There and back; a value of ``event_type`` may be hot, its rows are then spread."""
    from ..operators import dictionary as D
    e = table(spark, d, "events").select("event_id", "event_type")
    types = D.fit_dictionary(e, "event_type")
    return D.decode(D.encode(e, types, "event_type", "idx"), types, "idx", "decoded")


@register("distinct_labels", """
SELECT lang, CAST(count(*) OVER () AS BIGINT) AS n_classes FROM (SELECT DISTINCT lang FROM documents)""")
def distinct_labels(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.labels import distinct_labels as labels_of
    u = labels_of(table(spark, d, "documents"), "lang")
    return u.withColumn("n_classes", F.count(F.lit(1)).over(Window.partitionBy()).cast("long"))  # class-sized


# ---------------------------------------------------------------------------
# A1–A6 class aggregates
# ---------------------------------------------------------------------------

@register("class_counts", "SELECT lang, CAST(count(*) AS BIGINT) AS count FROM documents GROUP BY lang")
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.class_counts(table(spark, d, "documents"), "lang")


@register("class_shares", """
SELECT lang, CAST(count(*) AS BIGINT) AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM documents GROUP BY lang""")
def class_shares(spark: SparkSession, d: str) -> DataFrame:
    s = A.class_shares(table(spark, d, "documents"), "lang")
    return s.select("lang", "count", r6("share").alias("share"))


@register("top_classes", """
SELECT lang, CAST(count(*) AS BIGINT) AS count FROM documents GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 2""")
def top_classes(spark: SparkSession, d: str) -> DataFrame:
    return A.top_classes(table(spark, d, "documents"), "lang", 2)


_BW = """bw AS (SELECT lang, CAST(count(*) AS BIGINT) AS count,
  sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM documents GROUP BY lang)"""


@register("balanced_weights", f"WITH {_BW} SELECT lang, count, round(weight, 6) AS weight FROM bw")
def balanced_weights(spark: SparkSession, d: str) -> DataFrame:
    w = A.balanced_weights(table(spark, d, "documents"), "lang")
    return w.select("lang", "count", r6("weight").alias("weight"))


@register("row_weights", f"""
WITH {_BW} SELECT d.doc_id, d.lang, round(bw.weight, 6) AS weight FROM documents d JOIN bw ON d.lang = bw.lang""")
def row_weights(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return A.attach_weights(docs, "lang").select("doc_id", "lang", r6("weight").alias("weight"))


@register("pos_weight", """
SELECT CAST(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos,
       CAST(sum(CASE WHEN toxic = 1 THEN 0 ELSE 1 END) AS BIGINT) AS n_neg,
       round(sum(CASE WHEN toxic = 1 THEN 0 ELSE 1 END) / greatest(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END), 1), 6)
         AS pos_weight
FROM labels""")
def pos_weight(spark: SparkSession, d: str) -> DataFrame:
    w = A.positive_weight(table(spark, d, "labels"), "toxic")
    return w.select("n_pos", "n_neg", r6("pos_weight").alias("pos_weight"))


# ---------------------------------------------------------------------------
# M1–M4 preparation (fit, then apply)
# ---------------------------------------------------------------------------

_VALS = f"""{DIRTY}, v AS (SELECT event_id, CASE WHEN isfinite(TRY_CAST(value_txt AS DOUBLE))
  THEN TRY_CAST(value_txt AS DOUBLE) END AS value FROM dirty)"""


def _clean_values(spark: SparkSession, d: str) -> DataFrame:
    v = X.dirty_values(spark, d).withColumnRenamed("value_txt", "value")
    return P.nonfinite_to_null(P.coerce_numeric(v, ["value"]), ["value"]).select("event_id", "value")


@register("median_impute", f"""
WITH {_VALS} SELECT event_id, round(COALESCE(value, (SELECT median(value) FROM v)), 6) AS value FROM v""")
def median_impute(spark: SparkSession, d: str) -> DataFrame:
    v = _clean_values(spark, d)
    m = MedianImputer(inputCols=["value"]).fit(v)
    return m.transform(v).select("event_id", r6("value").alias("value"))


@register("median_select", f"""
WITH {_VALS} SELECT round(median(value), 6) AS median, CAST(count(value) AS BIGINT) AS n FROM v""")
def median_select(spark: SparkSession, d: str) -> DataFrame:
    """Exact median by distributed selection (bounded memory) — must equal ``median``."""
    v = _clean_values(spark, d)
    m = MedianImputer(inputCols=["value"]).fit(v)
    med = float(m.getOrDefault(m.surrogates)[0])
    return v.agg(F.count("value").cast("long").alias("n")).select(r6(F.lit(med)).alias("median"), "n")


@register("mode_impute", f"""
WITH {PRIO}, m AS (SELECT priority FROM prio WHERE priority IS NOT NULL GROUP BY priority
                   ORDER BY count(*) DESC, priority LIMIT 1)
SELECT o_orderkey, COALESCE(priority, (SELECT priority FROM m)) AS priority FROM prio""")
def mode_impute(spark: SparkSession, d: str) -> DataFrame:
    p = X.priorities(spark, d)
    m = ModeImputer(inputCols=["priority"]).fit(p)
    return m.transform(p).select("o_orderkey", "priority")


@register("one_hot", """
SELECT o_orderkey, o_orderstatus, CAST(o_orderstatus = 'F' AS INTEGER) AS oh_F, CAST(o_orderstatus = 'O' AS INTEGER) AS oh_O
FROM orders""")
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    train = o.where(F.col("o_orderstatus").isin("F", "O"))  # fit without 'P': P is unseen → zeros
    model = Pipeline(stages=one_hot_stages(["o_orderstatus"], ["oh"])).fit(train)
    arr = vector_to_array(F.col("oh"))
    return model.transform(o).select("o_orderkey", "o_orderstatus", arr[0].cast("int").alias("oh_F"),
                                     arr[1].cast("int").alias("oh_O"))


@register("standard_scale", """
WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd FROM orders)
SELECT o_orderkey, round((o_totalprice - s.m) / CASE WHEN s.sd = 0 THEN 1 ELSE s.sd END, 6) AS z
FROM orders, s""")
def standard_scale(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    m = PopStandardScaler(inputCols=["o_totalprice"], outputCols=["z"]).fit(o)
    return m.transform(o).select("o_orderkey", r6("z").alias("z"))


@register("column_stats", """
WITH s AS (SELECT avg(o_totalprice) AS m1, stddev_pop(o_totalprice) AS s1, avg(o_custkey) AS m2,
                  stddev_pop(o_custkey) AS s2 FROM orders)
SELECT 'o_totalprice' AS "column", round(m1, 6) AS mean, round(s1, 6) AS std FROM s
UNION ALL SELECT 'o_custkey', round(m2, 6), round(s2, 6) FROM s""")
def column_stats(spark: SparkSession, d: str) -> DataFrame:
    """Mean and population std of several columns in ONE aggregate pass."""
    st = A.mean_std(table(spark, d, "orders"), ["o_totalprice", "o_custkey"])
    return st.select("column", r6("mean").alias("mean"), r6("std").alias("std"))


# ---------------------------------------------------------------------------
# R1–R4 splits, D5 replication
# ---------------------------------------------------------------------------

_MD5 = "md5('{seed}:' || CAST({id} AS VARCHAR))"


@register("holdout_split", f"""
WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
t AS (SELECT CAST(ceil(0.2 * sum(n)) AS BIGINT) AS nt, sum(n) AS tot FROM c),
a AS (SELECT lang, (nt * n) // tot AS base, (nt * n) % tot AS rem, nt FROM c, t),
q AS (SELECT lang, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, lang) <= nt - sum(base) OVER ()
                               THEN 1 ELSE 0 END AS quota FROM a)
SELECT d.doc_id, d.lang,
       CAST(row_number() OVER (PARTITION BY d.lang ORDER BY {_MD5.format(seed=42, id='d.doc_id')}, d.doc_id) <= q.quota
            AS INTEGER) AS is_test
FROM documents d JOIN q ON d.lang = q.lang""")
def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return R.holdout_split(docs, "lang", "doc_id", 0.2, 42)


@register("stratified_folds", f"""
SELECT doc_id, lang, CAST((row_number() OVER (ORDER BY lang, {_MD5.format(seed=42, id='doc_id')}, doc_id) - 1) % 5
                          AS INTEGER) AS fold
FROM documents""")
def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return R.stratified_folds(docs, "lang", "doc_id", 5, 42)


@register("repeated_folds", """
SELECT doc_id, lang, CAST(run AS INTEGER) AS run,
       CAST((row_number() OVER (PARTITION BY run ORDER BY lang,
             md5(CAST(42 + run AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5 AS INTEGER) AS fold
FROM documents, range(5) r(run)""")
def repeated_folds(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return R.repeated_folds(docs, "lang", "doc_id", 5, 5, 42).select("doc_id", "lang", "run", "fold")


@register("fold_rows", f"""
WITH f AS (SELECT doc_id, CAST((row_number() OVER (ORDER BY lang, {_MD5.format(seed=42, id='doc_id')}, doc_id) - 1)
                               % 5 AS INTEGER) AS fold FROM documents)
SELECT doc_id, CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS part FROM f""")
def fold_rows(spark: SparkSession, d: str) -> DataFrame:
    """Train and test rows of fold 0 (two filters on the fold column)."""
    folds = R.stratified_folds(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 5, 42)
    train, test = R.fold_rows(folds, 0)
    return train.select("doc_id", F.lit("train").alias("part")).unionByName(
        test.select("doc_id", F.lit("test").alias("part")))


@register("time_split", """
SELECT event_id, CAST(row_number() OVER (ORDER BY ts NULLS LAST, event_id) <= floor(count(*) OVER () * 0.7)
                      AS INTEGER) AS is_train
FROM events""")
def time_split(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select("event_id", "ts")
    return R.time_split(ev, "ts", "event_id", 0.7).select("event_id", "is_train")


@register("time_split_text_id", """
SELECT 'e' || CAST(event_id AS VARCHAR) AS id,
       CAST(row_number() OVER (ORDER BY ts NULLS LAST, 'e' || CAST(event_id AS VARCHAR)) <= floor(count(*) OVER () * 0.7)
            AS INTEGER) AS is_train
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ts END AS ts FROM events)""")
def time_split_text_id(spark: SparkSession, d: str) -> DataFrame:
    """R4 with text ids and most times missing: the cut falls among ties, where the id decides."""
    ev = table(spark, d, "events").select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"),
                                          F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("ts"))
    return R.time_split(ev, "ts", "id", 0.7).select("id", "is_train")


@register("cv_fold_sizes", """
WITH r AS (SELECT unnest(range(5)) AS run),
f AS (SELECT run, lang, (row_number() OVER (PARTITION BY run ORDER BY lang, md5(CAST(42 + run AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5 AS fold
      FROM documents, r)
SELECT CAST(run AS INTEGER) AS run, CAST(fold AS INTEGER) AS fold, lang, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY run, fold, lang""")
def cv_fold_sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    f = R.repeated_folds(docs, "lang", "doc_id", k=5, runs=5, seed=42)
    return f.groupBy("run", "fold", "lang").agg(F.count(F.lit(1)).cast("long").alias("n"))


@register("replicate_weighted", """
WITH w AS (SELECT toxic, count(*) OVER () * 1.0 / (count(*) OVER (PARTITION BY toxic) * 2) AS weight, doc_id
           FROM labels),
u AS (SELECT doc_id, toxic, weight / min(weight) OVER () AS weight,
             CAST(('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM w),
n AS (SELECT doc_id, toxic, CAST(floor(weight) + CASE WHEN u < weight - floor(weight) THEN 1 ELSE 0 END AS INTEGER) AS n
      FROM u)
SELECT doc_id, toxic, CAST(c AS INTEGER) AS copy FROM n, range(1, n + 1) r(c)""")
def replicate_weighted(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "labels").select("doc_id", "toxic")
    w = A.attach_weights(lab, "toxic")
    return replicate_by_weight(w, "weight", "doc_id", 42).select("doc_id", "toxic", "copy")


# ---------------------------------------------------------------------------
# C3–C4 rule cascade and E1–E6 evaluation on it
# ---------------------------------------------------------------------------

# Rule stages on `documents` (en = benign): stage 1 = share of non-ASCII
# characters; stage 2 = which accent family the text uses.
_NON_ASCII = r"[^\x00-\x7F]"
_ES, _DE, _FR = "[ñ¿¡]", "[äöüß]", "[éèêç]"
RULE_THRESHOLD = 0.01

_PRED = rf"""pred AS (
  SELECT doc_id, lang AS y_true,
         len(regexp_extract_all(text, '{_NON_ASCII}')) / greatest(length(text), 1) AS p_attack,
         CASE WHEN regexp_matches(text, '{_ES}') THEN 'es' WHEN regexp_matches(text, '{_DE}') THEN 'de'
              ELSE 'fr' END AS stage2,
         CASE WHEN regexp_matches(text, '{_ES}') THEN 'es' WHEN regexp_matches(text, '{_DE}') THEN 'de'
              WHEN regexp_matches(text, '{_FR}') THEN 'fr' ELSE 'en' END AS y_single
  FROM documents),
casc AS (SELECT doc_id, y_true, p_attack, y_single,
                CASE WHEN p_attack > {RULE_THRESHOLD} THEN stage2 ELSE 'en' END AS y_pred FROM pred)"""


def _stage1_score() -> Column:
    t = F.coalesce(F.col("text"), F.lit(""))
    return F.regexp_count(t, F.lit(_NON_ASCII)) / F.greatest(F.length(t), F.lit(1))


def _stage2_rule() -> Column:
    t = F.col("text")
    return F.when(t.rlike(_ES), "es").when(t.rlike(_DE), "de").otherwise("fr")


def _single_rule() -> Column:
    t = F.col("text")
    return F.when(t.rlike(_ES), "es").when(t.rlike(_DE), "de").when(t.rlike(_FR), "fr").otherwise("en")


def cascade_predictions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("y_true"), "text")
    out = C.rule_cascade(docs, _stage1_score(), _stage2_rule(), RULE_THRESHOLD, "en")
    return out.drop("text")


def single_predictions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("y_true"), "text")
    return docs.select("doc_id", "y_true", _single_rule().alias("y_pred"))


@register("rule_cascade", f"""
WITH {_PRED} SELECT doc_id, y_true, y_pred, round(p_attack, 6) AS p_attack FROM casc""")
def rule_cascade(spark: SparkSession, d: str) -> DataFrame:
    c = cascade_predictions(spark, d)
    return c.select("doc_id", "y_true", "y_pred", r6("p_attack").alias("p_attack"))


_LABELS = "lab AS (SELECT y_true AS label FROM casc UNION SELECT y_pred FROM casc)"
_PAIRS = "pc AS (SELECT y_true, y_pred, count(*) AS n FROM casc GROUP BY y_true, y_pred)"
_GRID = f"""{_LABELS}, {_PAIRS}, grid AS (
  SELECT a.label AS y_true, b.label AS y_pred, CAST(COALESCE(pc.n, 0) AS BIGINT) AS count
  FROM lab a CROSS JOIN lab b LEFT JOIN pc ON pc.y_true = a.label AND pc.y_pred = b.label)"""


@register("cascade_sweep", f"""
WITH {_PRED}, cuts AS (SELECT DISTINCT p_attack AS t FROM pred UNION ALL SELECT CAST(NULL AS DOUBLE)),
f AS (SELECT t, y_true, CASE WHEN t IS NULL OR p_attack > t THEN stage2 ELSE 'en' END AS y_pred, t IS NULL OR p_attack > t AS up FROM cuts, pred),
l AS (SELECT t, y_true AS c, 1 AS s, CAST(y_true = y_pred AS INTEGER) AS tp, CAST(up AS INTEGER) AS up FROM f
      UNION ALL SELECT t, y_pred, 1, 0, 0 FROM f),
k AS (SELECT t, c, sum(s) AS s, sum(tp) AS tp, sum(up) AS up FROM l GROUP BY t, c)
SELECT round(t, 6) AS threshold, CAST(sum(up) AS BIGINT) AS routed, round(avg(2.0 * tp / s), 6) AS macro_f1 FROM k GROUP BY t""")
def cascade_sweep(spark: SparkSession, d: str) -> DataFrame:
    """C3 + E9: macro-F1 of the cascade's final labels at every cut of its score."""
    docs = table(spark, d, "documents").select(F.col("lang").alias("y_true"), "text")
    rows = docs.select("y_true", _stage1_score().alias("p_attack"), _stage2_rule().alias("stage2"))
    s = E.cascade_sweep(rows, "y_true", "p_attack", "stage2", "en")
    return s.select(r6("threshold").alias("threshold"), "routed", r6("macro_f1").alias("macro_f1"))


@register("confusion", f"WITH {_PRED}, {_GRID} SELECT y_true, y_pred, count FROM grid")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return E.confusion(cascade_predictions(spark, d), "y_true", "y_pred")


@register("confusion_norm", f"""
WITH {_PRED}, {_GRID}
SELECT y_true, y_pred, count,
       round(CASE WHEN sum(count) OVER (PARTITION BY y_true) = 0 THEN NULL
                  ELSE count / sum(count) OVER (PARTITION BY y_true) END, 6) AS share
FROM grid""")
def confusion_norm(spark: SparkSession, d: str) -> DataFrame:
    c = E.confusion_normalized(cascade_predictions(spark, d), "y_true", "y_pred")
    return c.select("y_true", "y_pred", "count", r6("share").alias("share"))


def _per_class_sql(src: str, pred: str, name: str) -> str:
    return f"""{name} AS (
  SELECT l.label AS class,
         CAST(COALESCE(sum(CASE WHEN s.y_true = l.label AND s.{pred} = l.label THEN 1 ELSE 0 END), 0) AS BIGINT) AS tp,
         CAST(COALESCE(sum(CASE WHEN s.y_true <> l.label AND s.{pred} = l.label THEN 1 ELSE 0 END), 0) AS BIGINT) AS fp,
         CAST(COALESCE(sum(CASE WHEN s.y_true = l.label AND s.{pred} <> l.label THEN 1 ELSE 0 END), 0) AS BIGINT) AS fn
  FROM (SELECT y_true AS label FROM {src} UNION SELECT {pred} FROM {src}) l CROSS JOIN {src} s
  GROUP BY l.label)"""


_PC = _per_class_sql("casc", "y_pred", "pcl")
_F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END"
_PREC = "CASE WHEN tp + fp = 0 THEN 0 ELSE tp * 1.0 / (tp + fp) END"
_REC = "CASE WHEN tp + fn = 0 THEN 0 ELSE tp * 1.0 / (tp + fn) END"


@register("class_report", f"""
WITH {_PRED}, {_PC},
r AS (SELECT class, {_PREC} AS precision, {_REC} AS recall, {_F1} AS f1, tp + fn AS support, tp FROM pcl)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM r
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) * 1.0 / sum(support), 6), CAST(sum(support) AS BIGINT) FROM r
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
                 CAST(sum(support) AS BIGINT) FROM r
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
                 round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
                 CAST(sum(support) AS BIGINT) FROM r""")
def class_report(spark: SparkSession, d: str) -> DataFrame:
    rep = E.class_report(cascade_predictions(spark, d), "y_true", "y_pred")
    return rep.select("class", r6("precision").alias("precision"), r6("recall").alias("recall"),
                      r6("f1").alias("f1"), "support")


@register("macro_f1", f"""
WITH {_PRED}, {_PC} SELECT round(avg({_F1}), 6) AS macro_f1, CAST(count(*) AS BIGINT) AS n_labels FROM pcl""")
def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    m = E.macro_f1(cascade_predictions(spark, d), "y_true", "y_pred")
    return m.select(r6("macro_f1").alias("macro_f1"), "n_labels")


@register("accuracy", f"""
WITH {_PRED} SELECT round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM casc""")
def accuracy(spark: SparkSession, d: str) -> DataFrame:
    return E.accuracy(cascade_predictions(spark, d), "y_true", "y_pred").select(r6("accuracy").alias("accuracy"))


_PCS = _per_class_sql("casc", "y_single", "pcs")


@register("f1_compare", f"""
WITH {_PRED}, {_PC}, {_PCS},
a AS (SELECT class, {_F1} AS f FROM pcs), b AS (SELECT class, {_F1} AS f FROM pcl)
SELECT COALESCE(a.class, b.class) AS class, round(COALESCE(a.f, 0), 6) AS single_f1,
       round(COALESCE(b.f, 0), 6) AS two_stage_f1, round(COALESCE(b.f, 0) - COALESCE(a.f, 0), 6) AS improvement
FROM a FULL JOIN b ON a.class = b.class""")
def f1_compare(spark: SparkSession, d: str) -> DataFrame:
    single = E.class_report(single_predictions(spark, d), "y_true", "y_pred", with_kind=True)
    two = E.class_report(cascade_predictions(spark, d), "y_true", "y_pred", with_kind=True)
    c = E.f1_compare(single, two)
    return c.select("class", r6("single_f1").alias("single_f1"), r6("two_stage_f1").alias("two_stage_f1"),
                    r6("improvement").alias("improvement"))


# ---------------------------------------------------------------------------
# E7–E9 score metrics: quality (labels) scored by n_chars (documents)
# ---------------------------------------------------------------------------

_SC = """sc AS (SELECT l.quality AS y, CAST(d.n_chars AS DOUBLE) AS score FROM labels l JOIN documents d
              ON l.doc_id = d.doc_id WHERE d.n_chars IS NOT NULL),
g AS (SELECT score, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS neg
      FROM sc GROUP BY score)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    lab = table(spark, d, "labels").select("doc_id", F.col("quality").alias("y"))
    docs = table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return lab.join(docs, "doc_id")


@register("roc_points", f"""
WITH {_SC}, c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp
                 FROM g),
t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM g)
SELECT score AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / P, 6) AS tpr,
       round(fp / N, 6) AS fpr FROM c, t
UNION ALL SELECT 'inf'::DOUBLE, 0, 0, 0.0, 0.0""")
def roc_points(spark: SparkSession, d: str) -> DataFrame:
    r = E.roc_points(_scored(spark, d), "y", "score")
    return r.select("threshold", "tp", "fp", r6("tpr").alias("tpr"), r6("fpr").alias("fpr"))


@register("roc_points_compact", f"""
WITH {_SC}, c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp
                 FROM g),
n AS (SELECT score, tp, fp, lag(tp) OVER (ORDER BY score DESC) AS tp_p, lead(tp) OVER (ORDER BY score DESC) AS tp_n,
             lag(fp) OVER (ORDER BY score DESC) AS fp_p, lead(fp) OVER (ORDER BY score DESC) AS fp_n FROM c),
t AS (SELECT sum(pos) AS P, sum(neg) AS N FROM g)
SELECT score AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / P, 6) AS tpr,
       round(fp / N, 6) AS fpr FROM n, t
WHERE tp_p IS NULL OR tp_n IS NULL OR tp_n - 2 * tp + tp_p <> 0 OR fp_n - 2 * fp + fp_p <> 0
UNION ALL SELECT 'inf'::DOUBLE, 0, 0, 0.0, 0.0""")
def roc_points_compact(spark: SparkSession, d: str) -> DataFrame:
    """E7 as ``roc_curve`` returns it by default (collinear points dropped)."""
    r = E.roc_points(_scored(spark, d), "y", "score", drop_intermediate=True)
    return r.select("threshold", "tp", "fp", r6("tpr").alias("tpr"), r6("fpr").alias("fpr"))


@register("roc_auc", f"""
WITH {_SC}, c AS (SELECT pos, neg, COALESCE(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING
                                                            AND 1 PRECEDING), 0) AS below FROM g)
SELECT round(sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)), 6) AS auc,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM c""")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    a = E.roc_auc(_scored(spark, d), "y", "score")
    return a.select(r6("auc").alias("auc"), "n_pos", "n_neg")


@register("sigmoid_scores", f"""
WITH {_SC} SELECT y, score, round(1 / (1 + exp(-((score - 1000.0) / 1000.0))), 6) AS p FROM sc""")
def sigmoid_scores(spark: SparkSession, d: str) -> DataFrame:
    """a logit (centred, scaled n_chars) turned into a probability."""
    s = _scored(spark, d)
    return s.select("y", "score", r6(S.sigmoid((F.col("score") - 1000.0) / 1000.0)).alias("p"))


SWEEP = [500.0, 2000.0, 10000.0, 50000.0]


@register("threshold_sweep", f"""
WITH {_SC}, th AS (SELECT CAST(unnest([{', '.join(map(str, SWEEP))}]) AS DOUBLE) AS threshold),
k AS (SELECT threshold, CAST(sum(CASE WHEN y = 1 AND score > threshold THEN 1 ELSE 0 END) AS BIGINT) AS tp,
             CAST(sum(CASE WHEN y <> 1 AND score > threshold THEN 1 ELSE 0 END) AS BIGINT) AS fp,
             CAST(sum(CASE WHEN y = 1 AND NOT score > threshold THEN 1 ELSE 0 END) AS BIGINT) AS fn
      FROM th, sc GROUP BY threshold)
SELECT threshold, tp, fp, fn,
       round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp * 1.0 / (tp + fp) END, 6) AS precision,
       round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp * 1.0 / (tp + fn) END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1
FROM k""")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    s = E.threshold_sweep(_scored(spark, d), "y", "score", SWEEP)
    return s.select("threshold", "tp", "fp", "fn", r6("precision").alias("precision"),
                    r6("recall").alias("recall"), r6("f1").alias("f1"))


# ---------------------------------------------------------------------------
# T1–T7, A10 statistics over runs (scores derived from events)
# ---------------------------------------------------------------------------

def _pvalue_sql(t: str, dof: str) -> str:
    th = f"atan(abs({t}) / sqrt({dof}))"
    c2 = f"pow(cos({th}), 2)"
    even = (f"sin({th}) * list_sum(list_transform(range(0, CAST(({dof} - 2) // 2 + 1 AS BIGINT)), "
            f"lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1) - 0.5 * ln(pi())) * pow({c2}, j)))")
    odd = (f"2 / pi() * ({th} + sin({th}) * cos({th}) * list_sum(list_transform(range(0, "
           f"CAST(({dof} - 3) // 2 + 1 AS BIGINT)), lambda j: exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) "
           f"* pow({c2}, j))))")
    a = f"CASE WHEN {dof} = 1 THEN 2 * {th} / pi() WHEN {dof} % 2 = 1 THEN {odd} ELSE {even} END"
    return f"CASE WHEN {t} IS NULL OR {dof} < 1 THEN NULL ELSE greatest(0.0, 1 - ({a})) END"


def _pairs_sql(pairs: list[tuple[str, str]] | None) -> str:
    cond = "a.model < b.model" if pairs is None else \
        "(" + " OR ".join(f"(a.model = '{x}' AND b.model = '{y}')" for x, y in pairs) + ")"
    return f"""{SCORES},
d AS (SELECT a.dataset, a.model AS model_a, b.model AS model_b, a.macro_f1 AS a, b.macro_f1 AS b,
             a.macro_f1 - b.macro_f1 AS d
      FROM scores a JOIN scores b ON a.dataset = b.dataset AND a.run = b.run AND a.fold = b.fold AND {cond}),
s AS (SELECT dataset, model_a, model_b, count(d) AS n, avg(a) AS mean_a, avg(b) AS mean_b, avg(d) AS mean_diff,
             stddev_samp(d) AS sd_diff, stddev_pop(d) AS sd_diff_pop FROM d GROUP BY dataset, model_a, model_b),
tt AS (SELECT *, CASE WHEN sd_diff > 0 THEN mean_diff / (sd_diff / sqrt(n)) END AS t, n - 1 AS dof FROM s),
pp AS (SELECT *, {_pvalue_sql('t', 'dof')} AS p_value FROM tt)
SELECT dataset, model_a, model_b, CAST(n AS BIGINT) AS n, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b,
       round(mean_diff, 6) AS mean_diff, round(sd_diff, 6) AS sd_diff, round(t, 6) AS t, CAST(dof AS BIGINT) AS dof,
       round(p_value, 6) AS p_value,
       round(CASE WHEN sd_diff_pop > 0 THEN mean_diff / sd_diff_pop END, 6) AS cohens_d,
       CAST(COALESCE(p_value < 0.05, false) AS INTEGER) AS significant
FROM pp"""


def _tests_df(spark: SparkSession, d: str, pairs) -> DataFrame:
    t = RS.paired_tests(X.fold_scores(spark, d), pairs=pairs)
    return t.select("dataset", "model_a", "model_b", "n", *[r6(c).alias(c) for c in
                                                          ("mean_a", "mean_b", "mean_diff", "sd_diff", "t")],
                    "dof", r6("p_value").alias("p_value"), r6("cohens_d").alias("cohens_d"), "significant")


PAIR = [("click", "view")]


@register("paired_ttest", "WITH " + _pairs_sql(PAIR))
def paired_ttest(spark: SparkSession, d: str) -> DataFrame:
    return _tests_df(spark, d, PAIR)


@register("model_pairs", "WITH " + _pairs_sql(None))
def model_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _tests_df(spark, d, None)


@register("cohens_d", f"""
WITH {SCORES}, d AS (SELECT a.dataset, a.macro_f1 - b.macro_f1 AS d FROM scores a JOIN scores b
  ON a.dataset = b.dataset AND a.run = b.run AND a.fold = b.fold AND a.model = 'purchase' AND b.model = 'signup')
SELECT dataset, round(avg(d), 6) AS mean_diff, round(stddev_pop(d), 6) AS sd_diff_pop,
       round(CASE WHEN stddev_pop(d) > 0 THEN avg(d) / stddev_pop(d) END, 6) AS cohens_d FROM d GROUP BY dataset""")
def cohens_d(spark: SparkSession, d: str) -> DataFrame:
    t = RS.paired_tests(X.fold_scores(spark, d), pairs=[("purchase", "signup")])
    return t.select("dataset", r6("mean_diff").alias("mean_diff"), r6("sd_diff_pop").alias("sd_diff_pop"),
                    r6("cohens_d").alias("cohens_d"))


@register("ci95", f"""
WITH {SCORES}, s AS (SELECT dataset, model, count(macro_f1) AS n, avg(macro_f1) AS mean,
                            1.96 * stddev_samp(macro_f1) / sqrt(count(macro_f1)) AS h FROM scores GROUP BY dataset, model)
SELECT dataset, model, CAST(n AS BIGINT) AS n, round(mean, 6) AS mean, round(h, 6) AS half_width,
       round(mean - h, 6) AS lower, round(mean + h, 6) AS upper FROM s""")
def ci95(spark: SparkSession, d: str) -> DataFrame:
    c = RS.ci95(X.fold_scores(spark, d))
    return c.select("dataset", "model", "n", *[r6(x).alias(x) for x in ("mean", "half_width", "lower", "upper")])


@register("score_summary", f"""
WITH {SCORES}
SELECT dataset, model, CAST(count(macro_f1) AS BIGINT) AS n, round(avg(macro_f1), 6) AS mean,
       round(stddev_pop(macro_f1), 6) AS std_pop, round(stddev_samp(macro_f1), 6) AS std_samp,
       round(min(macro_f1), 6) AS min, round(quantile_cont(macro_f1, 0.25), 6) AS q1,
       round(quantile_cont(macro_f1, 0.5), 6) AS median, round(quantile_cont(macro_f1, 0.75), 6) AS q3,
       round(max(macro_f1), 6) AS max
FROM scores GROUP BY dataset, model""")
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    sc = X.fold_scores(spark, d)
    s = A.score_summary(sc)
    f = RS.five_numbers(sc)
    j = s.join(f, ["dataset", "model"])
    return j.select("dataset", "model", "n", *[r6(c).alias(c) for c in
                                               ("mean", "std_pop", "std_samp", "min", "q1", "median", "q3", "max")])


# ---------------------------------------------------------------------------
# B1–B3 run-time summary (timings derived from orders)
# ---------------------------------------------------------------------------

_TP = f"""{TIMINGS}, tp AS (SELECT dataset, model, count(seconds) AS repeats, avg(seconds) AS m,
  stddev_pop(seconds) AS sd, max(rows) AS rows FROM timings GROUP BY dataset, model)"""


@register("throughput_summary", f"""
WITH {_TP}
SELECT dataset, model, CAST(repeats AS BIGINT) AS repeats, round(m, 6) AS time_mean_s, round(sd, 6) AS time_std_s,
       CAST(rows AS BIGINT) AS rows, round(rows / m, 6) AS rows_per_sec FROM tp""")
def throughput_summary(spark: SparkSession, d: str) -> DataFrame:
    t = RS.throughput(X.timings(spark, d))
    return t.select("dataset", "model", "repeats", r6("time_mean_s").alias("time_mean_s"),
                    r6("time_std_s").alias("time_std_s"), "rows", r6("rows_per_sec").alias("rows_per_sec"))


@register("speedup", f"""
WITH {_TP}, r AS (SELECT dataset, model, rows / m AS rps FROM tp)
SELECT dataset, round(max(CASE WHEN model = 'F' THEN rps END), 6) AS baseline_rows_per_sec,
       round(max(CASE WHEN model = 'O' THEN rps END), 6) AS candidate_rows_per_sec,
       round(max(CASE WHEN model = 'O' THEN rps END) / max(CASE WHEN model = 'F' THEN rps END), 6) AS speedup
FROM r GROUP BY dataset""")
def speedup(spark: SparkSession, d: str) -> DataFrame:
    s = RS.speedup(RS.throughput(X.timings(spark, d)), "F", "O")
    return s.select("dataset", *[r6(c).alias(c) for c in ("baseline_rows_per_sec", "candidate_rows_per_sec",
                                                           "speedup")])


@register("stage_totals", f"""
WITH {TIMINGS} SELECT dataset, round(sum(seconds), 6) AS fit_time_s, CAST(count(seconds) AS BIGINT) AS stages
FROM timings GROUP BY dataset""")
def stage_totals(spark: SparkSession, d: str) -> DataFrame:
    t = RS.stage_totals(X.timings(spark, d), keys=["dataset"])
    return t.select("dataset", r6("fit_time_s").alias("fit_time_s"), "stages")


def all_queries() -> dict[str, Query]:
    from . import trained  # noqa: F401  (registers the rows-only model queries)
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)


__all__ = ["QUERIES", "SQL", "all_queries", "all_sql", "siem_features", "cascade_predictions"]


# ---------------------------------------------------------------------------
# X1 stream scoring: the SIEM stand-in read as a stream, rule cascade, alerts
# per (1-day window, class). Stage 1 = share of five risk flags; stage 2 = the
# flag family. Same rows, same windows as the batch SQL below.
# ---------------------------------------------------------------------------

def _risk_score() -> Column:
    flags = ["ua_is_curl", "ua_is_wget", "ua_is_python", "dst_port_is_db", "dst_port_is_ssh"]
    return sum((F.col(c) for c in flags), F.lit(0)) / F.lit(float(len(flags)))


def _risk_class() -> Column:
    return (F.when(F.col("dst_port_is_db") == 1, "injection")
            .when(F.col("dst_port_is_ssh") == 1, "credential_attack").otherwise("scanning"))


def scattered(spark: SparkSession, d: str, name: str, parts: int = 6) -> str:
    """A table written to shared storage as files that hold rows of all times: its path."""
    import uuid
    path = f"{checkpoint_root(spark)}/scattered/{name}-{uuid.uuid4().hex}"
    t = table(spark, d, name)
    t.repartition(parts, F.xxhash64(t.columns[0])).write.parquet(path)
    return path


@register("stream_alerts", f"""
WITH {SIEM}, f AS (
  SELECT event_id, TRY_CAST(timestamp AS TIMESTAMP) AS t, lower(COALESCE(user_agent, '')) AS ua,
         CAST(COALESCE(dst_port IN (3306, 5432, 1433), false) AS INTEGER) AS db,
         CAST(COALESCE(dst_port IN (22), false) AS INTEGER) AS ssh FROM siem),
s AS (SELECT t, db, ssh, (CAST(contains(ua, 'curl') AS INTEGER) + CAST(contains(ua, 'wget') AS INTEGER)
         + CAST(regexp_matches(ua, 'python|requests|urllib') AS INTEGER) + db + ssh) / 5.0 AS p FROM f),
c AS (SELECT t, CASE WHEN p > 0.1 THEN CASE WHEN db = 1 THEN 'injection' WHEN ssh = 1 THEN 'credential_attack'
                                            ELSE 'scanning' END ELSE 'benign' END AS y_pred FROM s)
SELECT time_bucket(INTERVAL '1 day', t) AS window_start, y_pred, CAST(count(*) AS BIGINT) AS alerts
FROM c GROUP BY 1, 2""")
def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.features import add_features
    from ..streaming.scoring import alert_counts, count_available, read_log_stream, score_stream_rules
    schema = table(spark, d, "events").schema
    ev = read_log_stream(spark, scattered(spark, d, "events"), schema, max_files_per_trigger=1)

    def alerts(batch: DataFrame) -> DataFrame:
        feats = add_features(batch.selectExpr(*X.SIEM_EXPRS)).withColumn("_ts", S.parse_timestamp("timestamp"))
        return alert_counts(score_stream_rules(feats, _risk_score(), _risk_class(), 0.1, "benign"), "_ts", "1 day")

    return count_available(ev, alerts).select("window_start", "y_pred", "alerts")
