"""Label operators on DataFrames (L4–L6); row-wise label expressions live in
``functions/labels.py``."""

from __future__ import annotations

from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def find_label(df: DataFrame, col: str, name: str) -> str | None:
    """L4: the spelling of ``name`` actually used in ``col``, ignoring case and
    padding (e.g. ' Normal ' for 'normal'); smallest if several. One-row result."""
    return df.where(F.lower(F.trim(F.col(col))) == F.lit(name.strip().lower())).agg(F.min(col)).first()[0]


def fit_label_encoder(df: DataFrame, col: str, out: str = "label_idx") -> StringIndexerModel:
    """Alphabetical 0…k-1 encoding (``LabelEncoder`` order)."""
    return StringIndexer(inputCol=col, outputCol=out, stringOrderType="alphabetAsc").fit(df)


def decode_labels(df: DataFrame, encoder: StringIndexerModel, idx_col: str, out: str) -> DataFrame:
    """L5 inverse: index → label text."""
    return IndexToString(inputCol=idx_col, outputCol=out, labels=encoder.labels).transform(df)


def distinct_labels(df: DataFrame, col: str) -> DataFrame:
    """The distinct labels, sorted, null last (a table: any number of classes)."""
    return df.select(col).distinct().orderBy(F.col(col).asc_nulls_last())
