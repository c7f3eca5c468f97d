"""Sources and sinks.

Reads are lazy scans with an explicit schema where one is known (no inference
pass over the data); folders of CSVs whose headers differ are unioned by name.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.small import checkpointed

SCORES_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("run", T.IntegerType()), T.StructField("fold", T.IntegerType()),
    T.StructField("macro_f1", T.DoubleType()),
])
TIMINGS_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType()), T.StructField("model", T.StringType()),
    T.StructField("stage", T.StringType()), T.StructField("repeat", T.IntegerType()),
    T.StructField("rows", T.LongType()), T.StructField("seconds", T.DoubleType()),
])


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """One CSV with a header. With no schema every column is read as text and
    typed later by ``to_numeric`` (as the reference coerces after reading)."""
    r = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def read_folder(spark: SparkSession, folder: str, pattern: str = "*.csv",
                schema: T.StructType | None = None, source_col: str | None = None) -> DataFrame:
    """Every matching file, concatenated by column NAME; error when none match.

    Files are listed by Spark (any file system it can read), headers are parsed by Spark's CSV
    reader, and files that share a header are one multi-file scan. All columns are read as text and
    bound by name; a schema's types are applied afterwards, its missing columns are null.
    """
    base = folder.rstrip("/")
    try:
        listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(base).select("path")
        paths = sorted(r["path"] for r in listed.collect())  # one name per file
    except AnalysisException as e:
        raise FileNotFoundError(f"no folder {folder}") from e
    if not paths:
        raise FileNotFoundError(f"no files match {pattern} in {folder}")
    headers: dict[tuple, list[str]] = {}
    for p in paths:
        headers.setdefault(tuple(read_csv(spark, p).columns), []).append(p)
    parts = []
    for names, ps in headers.items():
        part = read_csv(spark, ps, T.StructType([T.StructField(n, T.StringType()) for n in names]))
        parts.append(part.withColumn(source_col, F.input_file_name()) if source_col else part)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    if schema is None:
        return out
    typed = [(F.col(f.name).try_cast(f.dataType) if f.name in out.columns else F.lit(None).cast(f.dataType)).alias(f.name)
             for f in schema.fields]
    return out.select(*typed, *([source_col] if source_col else []))


def read_folder_checked(spark: SparkSession, folder: str, pattern: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """S1–S2 with a channel for what can't be read: (good, rejected) of every matching file.

    good: ``schema``'s columns, bound by name, and ``file``; columns a file doesn't have are null. rejected: (file, line,
    reason), the reason ``fields`` for a line of too few or too many fields or broken quotes, else the name of the
    first column of ``schema`` whose text isn't empty and isn't of its type. The headers of all files are found in one
    pass, as the first line of each; blank lines and that line are no rows, every other line is in exactly
    one of the two. A line is a row: quoted line breaks are not supported. The distinct headers come to the driver, the
    files do not. No matching file is an error.
    """
    if {"file", "line", "reason"} & {f.name for f in schema.fields}:
        raise ValueError("file, line and reason name the result's own columns")
    try:
        lines = spark.read.option("pathGlobFilter", pattern).text(folder.rstrip("/")).select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    except AnalysisException as e:
        raise FileNotFoundError(f"no folder {folder}") from e
    first = lines.where("start = 0").groupBy("file").agg(F.min_by("line", "at").alias("header"))
    first = checkpointed(first)  # a row a file
    headers = [r.header for r in first.select("header").distinct().collect()]
    if not headers:
        raise FileNotFoundError(f"no files match {pattern} in {folder}")
    rows = lines.join(first, "file").where((F.trim("line") != "") & (F.col("line") != F.col("header")))
    parts = []
    for h in headers:
        names = [x.strip().strip('"') for x in h.split(",")]
        kind = ", ".join(f"`_{k}` STRING" for k in range(len(names)))
        cells = F.from_csv("line", f"{kind}, `_bad` STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
        own = rows.where(F.col("header") == h).select("file", "line", cells.alias("c"))
        place = {n: f"c._{k}" for k, n in enumerate(names)}
        texts = {f.name: F.col(place[f.name]) if f.name in place else F.lit(None).cast("string") for f in schema.fields}
        typed = {f.name: texts[f.name].try_cast(f.dataType) for f in schema.fields}
        wrong = F.coalesce(*[F.when((F.trim(texts[n]) != "") & typed[n].isNull(), F.lit(n)) for n in typed])
        reason = F.when(F.col("c._bad").isNotNull(), "fields").otherwise(wrong)
        parts.append(own.select("file", "line", reason.alias("reason"), *[c.alias(n) for n, c in typed.items()]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return (out.where("reason IS NULL").select(*[f.name for f in schema.fields], "file"),
            out.where("reason IS NOT NULL").select("file", "line", "reason"))


def read_pair(spark: SparkSession, train_path: str, test_path: str, schema: T.StructType | None = None,
              required: Iterable[str] = ()) -> DataFrame:
    """S3 + S4 + S5: the official train/test files, tagged and stacked by name."""
    from ..operators.clean import require_columns
    from ..operators.split import official_split
    try:
        tr, te = read_csv(spark, train_path, schema), read_csv(spark, test_path, schema)
    except AnalysisException as e:
        raise FileNotFoundError(f"{train_path} or {test_path}") from e
    require_columns(tr, *required)
    require_columns(te, *required)
    return official_split(tr, te)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Iterable[str] = (),
                mode: str = "overwrite") -> None:
    """Write a result table (parquet by default; csv with a header)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Fold scores as JSON lines, partitioned by dataset."""
    scores.select(*[f.name for f in SCORES_SCHEMA.fields]).write.mode("overwrite").json(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORES_SCHEMA).json(path)


def save_model(model: PipelineModel, path: str, feature_cols: list[str] | None = None) -> None:
    """A fitted pipeline; the feature-column list rides along as a one-column table."""
    model.write().overwrite().save(path)
    if feature_cols is not None:
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(c, i) for i, c in enumerate(feature_cols)], "column string, position int") \
            .coalesce(1).write.mode("overwrite").json(f"{path}/_feature_columns")


def load_model(path: str) -> PipelineModel:
    """S10."""
    return PipelineModel.load(path)


def save_cascade(model, path: str) -> None:
    """S9 for a fitted ``TwoStageModel``: both stages, the attack labels and the settings."""
    spark = SparkSession.getActiveSession()
    model.stage1.write().overwrite().save(f"{path}/stage1")
    if model.stage2 is not None:
        model.stage2.write().overwrite().save(f"{path}/stage2")
    about = json.dumps({"labels": model.attack_labels, "spec": asdict(model.spec), "stage2": model.stage2 is not None})
    spark.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_cascade(path: str):
    """S10 for a cascade: predicts as the saved one does."""
    from ..operators.cascade import CascadeSpec, TwoStageModel
    about = json.loads(SparkSession.getActiveSession().read.text(f"{path}/about").first()[0])
    stage2 = PipelineModel.load(f"{path}/stage2") if about["stage2"] else None
    return TwoStageModel(PipelineModel.load(f"{path}/stage1"), stage2, about["labels"], CascadeSpec(**about["spec"]))
