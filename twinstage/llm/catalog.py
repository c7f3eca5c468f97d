"""Registered queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed, html, importance, licenses, minhash, mixing, negatives, oracles, periodic, pii, quality, suffix, urls
from .common import WORD, read_table, ready

RANKS = "byte_bpe_50k.tiktoken"


def op1_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = read_table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return importance.importance_sample(read_table(spark, sf_dir, "documents"), good)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(read_table(spark, sf_dir, "pages"))


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(read_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(read_table(spark, sf_dir, "documents")).drop("mark")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read_table(spark, sf_dir, "pages"), urls.rules_frame(spark, urls.RULES))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(read_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(read_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents")).drop("found")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.embedding_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the ids divisible by 50; ids divisible by 7 first move to the next of ten labels."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(read_table(spark, sf_dir, "documents"))
    listed = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    d = found.select("doc_id", "spans", listed.alias("listed"))

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("listed", lambda x: ~x.startswith("term:"))
    return d.select("doc_id", *[number(k) for k in pii.KINDS], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
                    F.array_join("listed", ",").alias("spans"), number("term"))


def planted(docs: DataFrame) -> DataFrame:
    """The contract's input: a tenth of the documents, by the CRC of their id, repeat p words from word a on.
    A document without an id stays as it is."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    d = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    d = d.withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10))
    a = F.expr("CAST(g % n AS INT)")
    d = d.withColumn("a", F.when(F.col("n") > 0, a))
    d = d.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    turns = F.ceil(rest / F.col("p")).cast("int")
    periodic_part = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), turns)), F.lit(1), rest)
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), periodic_part), " ")
    return d.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(planted(read_table(spark, sf_dir, "documents")))
    top = periodic.longest(F.col("runs"))
    each = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(each, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *[top[c].alias(c) for c in ("start", "length", "period")],
                        F.floor(1000 * top["length"] / top["period"]).cast("long").alias("exponent_milli"),
                        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"), "n_words")


def _registered() -> list[Callable[[SparkSession, str], DataFrame]]:
    return [op1_importance, op2_html, op3_suffix, op4_quality, op5_urls, op6_bpe, op7_mixing, op8_licenses, op9_minhash,
            op10_embeddings, op11_hard_negatives, op12_pii, op13_runs]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ready(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        return run
    return {fn.__name__: wrap(fn) for fn in _registered()}


def sql() -> dict[str, str]:
    return {"op3_suffix": oracles.REPEATS, "op5_urls": urls.oracle(urls.RULES), "op9_minhash": oracles.NEAR_DUPLICATES,
            "op10_embeddings": oracles.EMBEDDINGS, "op11_hard_negatives": oracles.HARD_NEGATIVES}
