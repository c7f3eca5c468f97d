"""Stream scoring (extension X1): apply a cascade to a stream of log rows and count alerts per
class in event-time tumbling windows.

The stream is read once and handled in micro-batches (``foreachBatch``): a batch is scored with
the batch functions, its rows are counted per (window, class), and the counts are written to a
folder of that batch in shared storage. Counts of batches add up, so nothing is late: a row that
arrives days after its window counts in its window, and a row without a usable time counts under
a null window. No state is kept between batches, and a batch that is run again after a failure
overwrites its own folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cascade import rule_cascade


def read_log_stream(spark: SparkSession, folder: str, schema: T.StructType, file_glob: str | None = None,
                    max_files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(folder)


def score_stream_rules(stream: DataFrame, score: Column, stage2: Column, threshold: float, benign: str,
                       pred_col: str = "y_pred") -> DataFrame:
    """C3–C4 on a stream: one pass, stage 2 evaluated only for routed rows (lazy CASE)."""
    return rule_cascade(stream, score, stage2, threshold, benign, pred_col)


def alert_counts(scored: DataFrame, ts_col: str, window: str = "1 day", pred_col: str = "y_pred") -> DataFrame:
    """Alerts per (tumbling window, predicted class) of a batch; rows without a time under a null window.

    Wall-clock (TIMESTAMP_NTZ) times are cut zone-free, via the instant with the same digits in UTC.
    """
    from ..functions.scalar import epoch_micros
    dtype = dict(scored.dtypes)[ts_col]
    if dtype == "timestamp":
        evt, back = F.col(ts_col), (lambda c: c)
    else:
        ntz = F.col(ts_col) if dtype == "timestamp_ntz" else F.col(ts_col).cast("string").try_cast("timestamp_ntz")
        evt = F.timestamp_micros(epoch_micros(ntz, "timestamp_ntz"))
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        back = lambda c: F.timestamp_add("MICROSECOND", F.unix_micros(c), epoch)
    timed = scored.select(evt.alias("_evt"), F.col(pred_col))
    dated = (timed.where(F.col("_evt").isNotNull()).groupBy(F.window("_evt", window).alias("w"), F.col(pred_col))
             .agg(F.count(F.lit(1)).alias("alerts")).select(back(F.col("w.start")).alias("window_start"), F.col(pred_col), "alerts"))
    undated = timed.where(F.col("_evt").isNull()).groupBy(F.col(pred_col)).agg(F.count(F.lit(1)).alias("alerts"))
    return dated.unionByName(undated, allowMissingColumns=True)


def count_available(stream: DataFrame, alerts: Callable[[DataFrame], DataFrame], base_dir: str | None = None,
                    name: str | None = None) -> DataFrame:
    """Run ``alerts`` (batch → (window_start, class, alerts)) over everything available now, batch by
    batch, and return the sums. Counts and the stream's checkpoint live below ``spark.checkpoint.dir``."""
    from ..session import checkpoint_root
    spark = stream.sparkSession
    tag = name or uuid.uuid4().hex
    home = f"{base_dir or checkpoint_root(spark)}/streams/{tag}"
    shape = alerts(spark.createDataFrame([], stream.schema)).schema

    spark.createDataFrame([], shape).write.mode("overwrite").parquet(f"{home}/out/batch=-1")  # there is a table without batches too

    def sink(batch: DataFrame, batch_id: int) -> None:
        alerts(batch).write.mode("overwrite").parquet(f"{home}/out/batch={batch_id}")

    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{home}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    res = spark.read.schema(shape).parquet(f"{home}/out")
    keys = [c for c in shape.names if c != "alerts"]
    return res.groupBy(*keys).agg(F.sum("alerts").cast("long").alias("alerts"))
