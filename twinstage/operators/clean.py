"""Projections, filters and cleaning (P1–P11). All are narrow: no shuffle."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import bool_text_to_int, finite_or_null, to_numeric


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail at plan-build time (no job) if a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def drop_present(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop the named columns that exist (``DataFrame.drop`` ignores absent names)."""
    return df.drop(*list(names))


def trim_column_names(df: DataFrame) -> DataFrame:
    """``' Label'`` → ``'Label'``."""
    return df.toDF(*[c.strip() for c in df.columns])


def column_roles(df: DataFrame, cat_cols: Iterable[str] | None = None,
                 exclude: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical). By name if ``cat_cols`` is given, else by type
    (anything non-numeric is categorical; booleans count as numeric, as in pandas)."""
    excl = set(exclude)
    cols = [f for f in df.schema.fields if f.name not in excl]
    if cat_cols is not None:
        cats = [c for c in cat_cols if c in {f.name for f in cols}]
    else:
        cats = [f.name for f in cols
                if not isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    nums = [f.name for f in cols if f.name not in cats]
    return nums, cats


def coerce_numeric(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Text → double, bad → null."""
    return df.withColumns({c: to_numeric(c) for c in cols})


def nonfinite_to_null(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """P5."""
    return df.withColumns({c: finite_or_null(c) for c in cols})


def complete_rows(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Keep rows with no null in ``cols`` (run after P5 so ±inf/NaN count as missing)."""
    return df.dropna(how="any", subset=list(cols))


def filter_attacks(df: DataFrame, label_col: str, benign: str) -> DataFrame:
    """Rows whose class is not benign (null class is kept, as pandas ``!=`` does)."""
    c = F.col(label_col)
    return df.filter(c.isNull() | (c != F.lit(benign)))


def flag_to_int(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """P9."""
    return df.withColumns({c: bool_text_to_int(c) for c in cols if c in df.columns})


def fill_constants(df: DataFrame, values: dict) -> DataFrame:
    """P10: constant fill per column (``"missing"``, 0, …)."""
    return df.fillna({k: v for k, v in values.items() if k in df.columns})
