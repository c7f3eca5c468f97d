"""URL filter: host-suffix and path-prefix expressions joined to rules by hash prefix.

Each URL is expanded into the expressions a rule could be written as: every suffix of
its host at a label boundary, with every prefix of its path. Only expressions that have
the shape (number of labels, path length) of some rule are made, so their number is
bounded by the shapes among the rules and not by the URL. Expressions meet the rules in
an equi-join on the first four bytes of a SHA-256; a full digest then confirms each
match, and the longest rule wins (ties: the longer host, then block before allow).

The list of shapes comes to the driver and goes into the plan as one literal; it is bounded
by the label counts of hosts (127 in the DNS) and ``KEY_PATH`` path lengths whatever the
number of rules. A rule with a longer path is looked up by its first ``KEY_PATH`` code points,
and where these agree a digest of its whole path decides. Rules are matched once per distinct
(host, path), so repeated URLs cost one aggregate; the join to the pages is on the URL
and Spark splits it where one URL is frequent.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A–Z lower-cased; path:
from there up to ``?``, ``#`` or the end; both empty if the URL is null or has no ``://``.
A rule fits its host and all subdomains if the path starts with the rule's path, code
point by code point. No match gives a null rule and ``default``.

Edge cases: rules with a null host, path or verdict are refused; paths of rules and URLs
may be of any length; rules that repeat (host, path) count once, block before allow. Rows
that repeat a page, and null pages, are judged each. Empty tables give empty results.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as X

KEY_PATH = 2048  # code points of a rule's path that are looked up; the rest is compared where these agree
RULE_COLUMNS = "host string, path string, verdict string"
# The rules of the registered query (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _AZ, _AZ.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _expression(host: Column, path: Column) -> Column:
    """The text that is hashed; a space cannot be mistaken for a label or path boundary by length alone,
    so the host's length leads."""
    return F.concat(F.length(host).cast("string"), F.lit(":"), host, path)


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULE_COLUMNS)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """One row per page: id_col, host, path, rule, verdict."""
    bad = rules.where(F.col("host").isNull() | F.col("path").isNull() | F.col("verdict").isNull()
                      | ~F.col("verdict").isin("allow", "block")).limit(1).collect()
    if bad:
        raise ValueError(f"not a rule: {bad[0]}")
    head = F.substring("path", 1, KEY_PATH)
    known = (rules.groupBy("host", "path").agg(F.max("verdict").alias("rule_verdict"))  # 'block' > 'allow'
             .select(_digest(_expression(F.col("host"), head)).alias("rule_digest"),
                     F.when(F.length("path") > KEY_PATH, _digest(F.col("path"))).alias("whole_digest"),
                     F.length("path").alias("path_len"), F.concat("host", "path").alias("rule"),
                     F.length("host").alias("host_len"), "rule_verdict")
             .withColumn("prefix", F.substring("rule_digest", 1, 8)))
    shapes = sorted(tuple(r) for r in rules.select(F.size(F.split("host", r"\.")), F.length(head)).distinct().collect())
    shape = F.from_json(F.lit(json.dumps([{"k": k, "m": m} for k, m in shapes])), "array<struct<k:int,m:int>>")  # one literal

    seen = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    seen = seen.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    urls = seen.select("host", "path").distinct().withColumn("labels", F.split("host", r"\."))
    n = F.size("labels")
    fitting = F.filter(shape, lambda s: (s["k"] <= n) & (s["m"] <= F.length("path")))
    expression = _expression(F.array_join(F.slice("labels", n - F.col("s.k") + 1, F.col("s.k")), "."),
                             F.substring(F.col("path"), F.lit(1), F.col("s.m")))
    tried = (urls.select("host", "path", "labels", F.explode(fitting).alias("s"))
             .select("host", "path", _digest(expression).alias("digest"))
             .withColumn("prefix", F.substring("digest", 1, 8)))
    whole = _digest(F.substring(F.col("path"), F.lit(1), F.col("path_len")))
    fits = tried.join(known, "prefix").where((F.col("digest") == F.col("rule_digest"))
                                             & F.when(F.col("whole_digest").isNull(), True).otherwise(whole == F.col("whole_digest")))
    order = F.struct(F.length("rule").alias("n"), "host_len", "rule_verdict", "rule")
    best = fits.groupBy("host", "path").agg(F.max(order).alias("best"))
    return (seen.join(best, ["host", "path"], "left")
            .select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")))


def oracle(rules: list[tuple[str, str, str]], default: str = "allow") -> str:
    """The same judgement in SQL, one condition per rule."""
    parts = reduce(lambda a, b: f"{a} UNION ALL {b}", [
        f"SELECT page_id, host, path, url, '{h}{p}' AS rule, '{v}' AS verdict, {len(h + p)} AS n, {len(h)} AS m FROM parts "
        f"WHERE (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, v in rules])
    return f"""
WITH raw AS (SELECT page_id, url, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN ''
                    ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
cut AS (SELECT page_id, url, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM raw),
parts AS (SELECT page_id, url, translate(h, '{_AZ}', '{_AZ.lower()}') AS host,
                 regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM cut),
fits AS ({parts}),
best AS (SELECT DISTINCT host, path, first_value(rule) OVER w AS rule, first_value(verdict) OVER w AS verdict
         FROM fits WINDOW w AS (PARTITION BY host, path ORDER BY n DESC, m DESC, verdict DESC))
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, '{default}') AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path"""
