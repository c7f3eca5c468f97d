"""Distributed dictionaries: value ↔ number as a table (L5, M3, M6 for any number of values).

MLlib's ``StringIndexer`` brings its vocabulary to the driver and sends it to every task.
Here a dictionary is a DataFrame (value, idx, n, hot): the distinct non-null values of the
fitting column numbered 0…k-1 in their order, with the rows each has. It is written and
read like any table.

* ``fit_dictionary`` counts the values (map-side combined), ranges them over partitions and
  numbers each partition on its own; offsets come from a table of one row per partition.
* ``encode`` and ``decode`` are equi-joins. Values with over a ``HOT``-th of the fitted rows
  are fewer than ``HOT`` by counting, so they are broadcast and their rows never meet in one
  task; the others are joined by value. Rows that cannot match there (null, or already found) are spread.
* ``one_hot`` gives sparse vectors; what reaches the driver is one size per column.

Null stays null, or takes the number of the unseen. A value that is not in the dictionary
is null, or k with ``unseen="keep"``. Repeated rows are encoded each, an empty table fits an
empty dictionary, and other columns of a table keep their names whatever these are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT = 1000  # a value with more than 1/HOT of the fitted rows is hot: fewer than HOT values are


def _named(c: str) -> Column:
    return F.col("`" + c.replace("`", "``") + "`")


def fit_dictionary(df: DataFrame, col: str) -> DataFrame:
    """(value, idx, n, hot) of the non-null values of ``col``, idx in ascending order of the values from 0."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.select(_named(col).alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    placed = counts.repartitionByRange(parts, "value").withColumn("part", F.spark_partition_id()).checkpoint()
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"),
                           F.sum("rows").over(Window.partitionBy()).alias("rows"))
    inside = Window.partitionBy("part").orderBy("value")
    return placed.join(offsets, "part").select(
        "value", (F.col("offset") + F.row_number().over(inside) - 1).cast("long").alias("idx"), "n",
        (F.col("n") * HOT > F.col("rows")).alias("hot")).checkpoint()


def _lookup(df: DataFrame, dictionary: DataFrame, col: str, key: str, give: str, out: str) -> DataFrame:
    """``df`` with ``out``: the dictionary's ``give`` where its ``key`` equals ``col``, else null."""
    pre = "_d"
    while any(c.lower().startswith(pre) for c in df.columns):
        pre += "_"
    hot = dictionary.where("hot").select(F.col(key).alias(f"{pre}hk"), F.col(give).alias(f"{pre}hv"))
    rest = dictionary.where("NOT hot").select(F.col(key).alias(f"{pre}rk"), F.col(give).alias(f"{pre}rv"), F.lit(-1).alias(f"{pre}rs"))
    t = df.join(F.broadcast(hot), _named(col) == F.col(f"{pre}hk"), "left")  # fewer than HOT rows
    t = t.withColumn(f"{pre}k", F.when(F.col(f"{pre}hk").isNull(), _named(col)))
    t = t.withColumn(f"{pre}s", F.when(F.col(f"{pre}k").isNotNull(), -1).otherwise(F.spark_partition_id()))
    t = t.join(rest, (F.col(f"{pre}k") == F.col(f"{pre}rk")) & (F.col(f"{pre}s") == F.col(f"{pre}rs")), "left")
    found = F.coalesce(f"{pre}hv", f"{pre}rv")
    kept = [c for c in df.columns if c.lower() != out.lower()]
    return t.select(*[_named(c) for c in kept], found.alias(out))


def size_of(dictionary: DataFrame) -> int:
    """Number of values."""
    return dictionary.count()


def encode(df: DataFrame, dictionary: DataFrame, col: str, out: str, unseen: str = "null") -> DataFrame:
    """``df`` with ``out`` (long): the number of ``col``'s value. ``unseen``: "null", or "keep" for
    the number k (at least 1) of values that are null or not in the dictionary."""
    if unseen not in ("null", "keep"):
        raise ValueError(f"unknown rule for unseen values: {unseen}")
    coded = _lookup(df, dictionary, col, "value", "idx", out)
    if unseen == "null":
        return coded
    return coded.withColumn(out, F.coalesce(_named(out), F.lit(max(size_of(dictionary), 1)).cast("long")))


def decode(df: DataFrame, dictionary: DataFrame, col: str, out: str) -> DataFrame:
    """``df`` with ``out``: the value of the number in ``col``; null for null and numbers without a value."""
    return _lookup(df, dictionary, col, "idx", "value", out)


def one_hot(df: DataFrame, dictionaries: dict[str, DataFrame], tag: str = "oh") -> DataFrame:
    """``df`` with a sparse vector ``<tag>_<column>`` for each column, all zero for null and unseen values."""
    from pyspark.ml.feature import OneHotEncoder
    if not dictionaries:
        return df
    sizes, codes = {}, {c: f"{tag}_{c}_idx" for c in dictionaries}
    for c, d in dictionaries.items():
        sizes[c] = max(size_of(d), 1)
        df = _lookup(df, d, c, "value", "idx", codes[c])
        df = df.withColumn(codes[c], F.coalesce(_named(codes[c]), F.lit(sizes[c])).cast("double"))
    largest = df.sparkSession.range(1).select(*[F.lit(float(sizes[c] - 1)).alias(codes[c]) for c in dictionaries])
    model = OneHotEncoder(inputCols=list(codes.values()), outputCols=[f"{tag}_{c}" for c in dictionaries],
                          handleInvalid="keep", dropLast=True).fit(largest)  # drops the slot of the unseen
    return model.transform(df).drop(*codes.values())
