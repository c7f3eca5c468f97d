"""The best of several fitted models, kept in shared storage.

A store is a folder: ``candidates/<version>`` holds a model, ``entries/<version>`` one JSON row
(version, score, fit time) that is written last; it is a single file that Spark's committer moves to
its place. A candidate counts from that moment, so there is no pointer to move and no lock:
writers never touch each other's files, and one that dies half way leaves files that no
complete entry names. The best model is the entry of the highest score; of equal scores the smallest
version, so every reader picks the same one.

Everything goes through Spark's readers and writers and runs on any file system they reach. The
entries are one row a fit; candidates that are no longer wanted are the store's owner's to delete.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "version string, score double, fitted_at double"


class ModelStore:
    """``save(model, path)`` and ``load(path)`` say how a model is written and read."""

    def __init__(self, spark: SparkSession, path: str, save: Callable, load: Callable):
        self.spark, self.path, self._save, self._load = spark, path.rstrip("/"), save, load

    def put(self, model, score: float, version: str | None = None) -> str:
        """Write a candidate, then its entry; the version (new unless given: a given one may be put once)."""
        version = version or f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        if "/" in version or score != score:
            raise ValueError("a version is a folder name, a score is a number")
        self._save(model, f"{self.path}/candidates/{version}")
        entry = self.spark.createDataFrame([(version, float(score), time.time())], ENTRY).coalesce(1)
        entry.write.mode("error").json(f"{self.path}/entries/{version}")
        return version

    def entries(self) -> DataFrame:
        """(version, score, fitted_at) of the complete candidates."""
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        try:
            rows = self.spark.read.schema(ENTRY).option("mode", "PERMISSIVE").json(f"{self.path}/entries/*")
        except AnalysisException:  # nothing was put yet
            return self.spark.createDataFrame([], ENTRY)
        return rows.where((F.col("version") == folder) & F.col("score").isNotNull() & F.col("fitted_at").isNotNull())

    def best(self) -> tuple[str, float]:
        """Version and score of the best candidate."""
        top = self.entries().agg(F.min(F.struct((-F.col("score")).alias("back"), "version")).alias("t")).first().t
        if top is None:
            raise LookupError(f"no complete model in {self.path}")
        return top.version, -top.back

    def load_best(self):
        return self._load(f"{self.path}/candidates/{self.best()[0]}")
