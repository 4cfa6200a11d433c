"""Ranks over a whole table without sending it to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.graph import cut


def global_rank(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with its rows numbered from 1 in this order. Rows are dealt by ranges of the order and written once, so that
    the ranges stay; the counts of the ranges, one row each, are summed, and rows are numbered within a range."""
    ranges = cut(df.repartitionByRange(*order).withColumn("range__", F.spark_partition_id()))
    sizes = ranges.groupBy("range__").agg(F.count("*").alias("n__"))
    before = sizes.withColumn("before__", F.coalesce(F.sum("n__").over(Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = ranges.join(F.broadcast(before.select("range__", "before__")), "range__")  # a row a partition
    rank = F.col("before__") + F.row_number().over(Window.partitionBy("range__").orderBy(*order))
    return numbered.withColumn(out, rank).drop("range__", "before__")


def evenly_spaced(df: DataFrame, order: list[str], most: int = 200) -> DataFrame:
    """Every n-th row of the order, at most ``most`` rows: a probe of the whole table."""
    n = df.count()
    step = max(1, n // most)
    return global_rank(df, order, "r__").where((F.col("r__") - 1) % step == 0).orderBy("r__").limit(most).drop("r__")


def shuffled(df: DataFrame, key: str, seed: str) -> DataFrame:
    """df in the order of a seeded hash of its key."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key)


def stratified(df: DataFrame, kind: str, key: str, total: int, seed: str) -> DataFrame:
    """About ``total`` rows, from each kind in proportion (rounded, one at least), first in hash order."""
    n = df.count()
    counts = df.groupBy(kind).agg(F.count("*").alias("n__"))
    share = F.greatest(F.lit(1), F.round(F.lit(float(total)) * F.col("n__") / F.lit(max(1, n)))).cast("int")
    h = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    ranked = df.withColumn("r__", F.row_number().over(Window.partitionBy(kind).orderBy(h, key))).where(F.col("r__") <= total + 1)
    return ranked.join(counts.select(kind, share.alias("take__")), kind).where("r__ <= take__").drop("r__", "take__")


def only(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows of the named kinds, all of them where no kind is named."""
    return df.where(F.col(column).isin(names)) if names else df
