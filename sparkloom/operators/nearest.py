"""Nearest rows on both sides within a bound, from one sorted union; each row once, if wanted, the closest pairs first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.graph import cut, forget

#: Cells of positions are so many bounds wide.
WIDE = 16


def within(left: DataFrame, right: DataFrame, by: list[str], at: str, left_key: str, right_key: str, bound: float, wide: int = WIDE) -> DataFrame:
    """left_key, right_key, distance: for each left row the right row of the same ``by`` whose position is nearest, at most bound
    away; ties go to the lesser right key. Left rows without one have nulls; so have those without a position.

    Positions are cut into cells of ``wide`` bounds and right rows go to every cell that they can be near to, so a window holds the
    rows of one cell, not of a whole group; the last right row before a left row and the first one after it are carried
    along the sorted union of both sides, and no pairs are made."""
    width = bound * wide if bound > 0 else 1
    cell = lambda p: F.floor(p / F.lit(width))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType)
    l_side = left.select(*by, F.col(at).alias("pos"), F.col(left_key).alias("l"), none(right, right_key).alias("r"), cell(F.col(at)).alias("cell"), F.lit(1).alias("side"))
    r_rows = right.where(F.col(at).isNotNull()).select(*by, F.col(at).alias("pos"), none(left, left_key).alias("l"), F.col(right_key).alias("r"))
    r_side = r_rows.withColumn("cell", F.explode(F.sequence(cell(F.col("pos") - F.lit(bound)), cell(F.col("pos") + F.lit(bound))))).withColumn("side", F.lit(0))
    near = F.when(F.col("side") == 0, F.struct("pos", "r"))

    def carried(order: Column) -> Column:
        # right rows first, the lesser key last: the row that is carried on
        w = Window.partitionBy(*by, "cell").orderBy(order, "side", F.desc("r")).rowsBetween(Window.unboundedPreceding, 0)
        return F.last(near, ignorenulls=True).over(w)

    met = l_side.unionByName(r_side).select("*", carried(F.asc("pos")).alias("before"), carried(F.desc("pos")).alias("after")).where("side = 1")
    gap = lambda c: F.when(F.abs(F.col("pos") - F.col(c)["pos"]) <= bound, F.struct(F.abs(F.col("pos") - F.col(c)["pos"]).alias("distance"), F.col(c)["r"].alias("r")))
    best = F.least(gap("before"), gap("after"))
    return met.select(F.col("l").alias(left_key), best["r"].alias(right_key), best["distance"].alias("distance"))


def once(left: DataFrame, right: DataFrame, by: list[str], at: str, left_key: str, right_key: str, bound: float, wide: int = WIDE) -> DataFrame:
    """left_key, right_key, distance of pairs in which every row stands once, as if all pairs within the bound were taken by
    distance, left key and right key, each if both rows are still free. A round takes the pairs in which each row is the
    other's nearest; the closest pair that is left always is one. Keys name one row."""
    lefts, rights = (cut(df.where(F.col(at).isNotNull()).select(*by, at, k)) for df, k in ((left, left_key), (right, right_key)))
    out = []
    while True:
        there = within(lefts, rights, by, at, left_key, right_key, bound, wide).where(F.col(right_key).isNotNull())
        back = within(rights, lefts, by, at, right_key, left_key, bound, wide).where(F.col(left_key).isNotNull())
        there = cut(there)
        pairs = cut(there.join(back.drop("distance"), [left_key, right_key]))
        if pairs.isEmpty():
            return reduce(DataFrame.unionByName, out) if out else pairs
        out.append(pairs)
        open_ = cut(lefts.join(there.select(left_key), left_key, "left_semi").join(pairs, left_key, "left_anti"))
        free = cut(rights.join(pairs, right_key, "left_anti"))
        forget(lefts, rights, there)
        lefts, rights = open_, free
