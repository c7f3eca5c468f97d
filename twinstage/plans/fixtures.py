"""Stand-in tables derived from the driver's tables (see FIXTURES.md).

The reference's inputs (SIEM-like logs, flow tables) do not ship. Each role is
played by a driver table, re-shaped by a deterministic projection. The same
projection text runs in Spark (``selectExpr``) and in DuckDB (a CTE), so both
engines see identical inputs; the operators under test are then written
independently on each side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table

# SIEM-like log from `events`: event_type plays the attack type, view = benign.
SIEM_EXPRS = [
    "event_id",
    "CASE WHEN event_id % 13 = 0 THEN 'not a time' ELSE CAST(ts AS STRING) END AS timestamp",
    "CASE user_id % 4 WHEN 0 THEN '10.' || CAST(user_id % 256 AS STRING) || '.0.1' "
    "WHEN 1 THEN '172.' || CAST(10 + user_id % 30 AS STRING) || '.1.1' "
    "WHEN 2 THEN ' 192.168.' || CAST(user_id % 256 AS STRING) || '.7 ' "
    "ELSE '8.8.' || CAST(user_id % 256 AS STRING) || '.8' END AS src_ip",
    "CASE event_id % 4 WHEN 0 THEN '10.0.0.1' WHEN 1 THEN '172.16.0.' || CAST(event_id % 256 AS STRING) "
    "WHEN 2 THEN '192.168.1.1' ELSE '1.1.1.' || CAST(event_id % 256 AS STRING) END AS dst_ip",
    "1024 + (event_id * 7) % 60000 AS src_port",
    "CASE event_id % 8 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 22 WHEN 3 THEN 5432 "
    "WHEN 4 THEN 3306 WHEN 5 THEN 8080 ELSE 1000 + user_id END AS dst_port",
    "CASE event_id % 3 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' ELSE 'icmp' END AS protocol",
    "value AS bytes_sent",
    "user_id * 10 AS bytes_received",
    "'/page' || CAST(user_id % 17 AS STRING) || '?id=' || CAST(event_id AS STRING) || "
    "CASE WHEN event_id % 5 = 0 THEN '&q=1' ELSE '' END AS url",
    "CASE user_id % 5 WHEN 0 THEN 'curl/8.0' WHEN 1 THEN 'Wget/1.21' WHEN 2 THEN 'python-requests/2.31' "
    "WHEN 3 THEN 'Mozilla/5.0 Firefox/120' ELSE NULL END AS user_agent",
    "CASE event_type WHEN 'view' THEN 'benign' WHEN 'click' THEN 'port-scan' "
    "WHEN 'signup' THEN 'credential-stuffing' WHEN 'purchase' THEN 'sql-injection' "
    "ELSE 'beaconing' END AS attack_type",
]

# The same log with a benign majority (seven in ten) and a noisy signal in several features: bytes, destination
# port and URL of an attack look like it most of the time, those of benign rows some of the time.
_SIGNAL = {
    "bytes_sent": "value * CASE WHEN event_type = 'purchase' THEN 3.0 WHEN event_type = 'error' THEN 0.4 ELSE 1.0 END",
    "dst_port": "CASE WHEN event_type = 'error' AND event_id % 10 < 7 THEN 4444 WHEN event_id % 23 = 0 THEN 4444 "
                "WHEN event_id % 8 = 0 THEN 80 WHEN event_id % 8 = 1 THEN 443 ELSE 1000 + user_id END",
    "url": "'/page' || CAST(user_id % 17 AS STRING) || '?id=' || CAST(event_id AS STRING) || "
           "CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 AND user_id % 10 < 7 THEN '&q=1 union select 2' ELSE '' END",
    "attack_type": "CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'sql-injection' WHEN event_type = 'purchase' THEN 'ddos' "
                   "WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'port-scan' ELSE 'benign' END",
}
SIGNAL_EXPRS = [next((f"{e} AS {c}" for c, e in _SIGNAL.items() if x.endswith(f" AS {c}")), x) for x in SIEM_EXPRS]

# flow log from `lineitem` (ports, bytes per FIXTURES.md) in the SIEM log schema:
# a large table to score with models trained on the SIEM stand-in
FLOW_EXPRS = [
    "l_orderkey * 8 + l_linenumber AS event_id",
    "CAST(l_shipdate AS STRING) AS timestamp",
    "'10.0.' || CAST(l_suppkey % 256 AS STRING) || '.1' AS src_ip",
    "CASE WHEN l_partkey % 5 = 0 THEN '8.8.8.8' ELSE '192.168.0.' || CAST(l_partkey % 256 AS STRING) END AS dst_ip",
    "l_suppkey AS src_port", "l_partkey AS dst_port",
    "CASE l_linestatus WHEN 'F' THEN 'tcp' ELSE 'udp' END AS protocol",
    "l_extendedprice AS bytes_sent", "l_quantity AS bytes_received",
    "'/page' || CAST(l_suppkey % 17 AS STRING) || '?q=' || CAST(l_linenumber AS STRING) AS url",
    "CASE l_linenumber % 4 WHEN 0 THEN 'curl/8.0' WHEN 1 THEN 'Mozilla/5.0' ELSE NULL END AS user_agent",
    "CASE l_returnflag WHEN 'N' THEN 'benign' WHEN 'A' THEN 'port-scan' ELSE 'ddos' END AS attack_type",
]

# events.value as text with ±inf / NaN and nulls put in (non-finite and missing roles)
DIRTY_VALUE_EXPRS = [
    "event_id", "user_id", "event_type",
    "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 97 = 0 THEN 'inf' "
    "WHEN event_id % 97 = 1 THEN '-inf' WHEN event_id % 97 = 2 THEN 'nan' "
    "ELSE CAST(value AS STRING) END AS value_txt",
]

# orders.o_orderpriority with nulls (mode-impute role)
PRIORITY_EXPRS = [
    "o_orderkey", "o_orderstatus", "o_totalprice",
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority",
]

# fold scores: mean value per (user_id % 5, event_id % 5), one "model" per event type
SCORES_SQL = (
    "SELECT 'events' AS dataset, event_type AS model, CAST(user_id % 5 AS INTEGER) AS run, "
    "CAST(event_id % 5 AS INTEGER) AS fold, avg(value) AS macro_f1 FROM events "
    "GROUP BY event_type, CAST(user_id % 5 AS INTEGER), CAST(event_id % 5 AS INTEGER)"
)

# timed runs: o_totalprice as seconds, o_orderstatus as model, o_orderpriority as dataset
TIMINGS_EXPRS = [
    "o_orderpriority AS dataset", "o_orderstatus AS model", "o_orderkey AS repeat",
    "o_totalprice / 100000.0 AS seconds", "o_custkey AS rows",
]


def cte(name: str, exprs: list[str], source: str) -> str:
    return f"{name} AS (SELECT {', '.join(exprs)} FROM {source})"


def siem(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(*SIEM_EXPRS)


def signal_log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(*SIGNAL_EXPRS)


def flows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(*FLOW_EXPRS)


def dirty_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(*DIRTY_VALUE_EXPRS)


def priorities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr(*PRIORITY_EXPRS)


def fold_scores(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F
    ev = table(spark, d, "events")
    return ev.groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 5).cast("int").alias("run"),
                      (F.col("event_id") % 5).cast("int").alias("fold")) \
        .agg(F.avg("value").alias("macro_f1")).withColumn("dataset", F.lit("events")) \
        .select("dataset", "model", "run", "fold", "macro_f1")


def timings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr(*TIMINGS_EXPRS)
