"""Stratified splits of groups: a walk that weighs each choice, and classes of like groups that are settled side by side."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.graph import cut, greedy_assign
from sparkloom.operators.ranks import global_rank

#: Groups of a class from which its rows meet it by broadcast, and rows of a broadcast table.
HUB, SMALL = 10_000, 100_000


def assigned(counts: DataFrame, shares: dict[str, float] | None = None, most: int = 1_000_000) -> DataFrame:
    """grp, split by ``greedy_assign`` from counts (grp, qa_type, n). Each choice rests on all before it, so up to ``most`` counts
    go through one task. Of more, most groups are settled side by side (``settled_by_class``) and the walk sees the rest."""
    shares = shares or {"train": 0.85, "val": 0.10, "test": 0.05}
    counts = cut(counts)  # counted, then walked or settled
    if counts.count() <= most:
        return _walked(counts, shares, {})
    settled = settled_by_class(counts, shares, most)
    held: dict[str, dict[str, int]] = {s: {} for s in shares}
    for r in settled.where("split is not null").groupBy("split", "qa_type").agg(F.sum("n").alias("n")).collect():  # splits times kinds
        held[r["split"]][r["qa_type"]] = r["n"]
    rest = settled.where("split is null").select("grp", "qa_type", "n")
    return settled.where("split is not null").select("grp", "split").distinct().unionByName(_walked(rest, shares, held))


def settled_by_class(counts: DataFrame, shares: dict[str, float], most: int) -> DataFrame:
    """counts with split: groups of the same rows by kind are one class. Of a class of m groups the first floor(m * share) in
    hash order go to each split in turn; what is left of it, fewer groups than there are splits, has no split yet. Where
    there are so many classes that their rests are more than ``most``, numbers of rows count as one if they have as many binary
    digits, then only kinds count."""
    kinds = counts.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("qa_type", "n"))).alias("v"))  # a row a kind
    levels = [F.col("v").cast("string"), F.transform("v", lambda x: F.struct(x["qa_type"], F.length(F.bin(x["n"])))).cast("string"), F.transform("v", lambda x: x["qa_type"]).cast("string")]
    for level in levels:
        sizes = kinds.groupBy(F.md5(level).alias("class")).agg(F.count("*").alias("m"))
        if sizes.count() * (len(shares) - 1) <= most:
            break
    dealt = kinds.select("grp", F.md5(level).alias("class"), F.md5(F.concat(F.lit("class"), F.col("grp").cast("string"))).alias("h"))
    placed = global_rank(dealt, ["class", "h", "grp"], "at")
    starts = sizes.join(placed.groupBy("class").agg(F.min("at").alias("start")), "class")
    hubs = F.broadcast(starts.where(F.col("m") > HUB)) if starts.where(F.col("m") > HUB).count() <= SMALL else None
    met = placed.join(starts, "class") if hubs is None else placed.join(hubs, "class").unionByName(placed.join(starts.where(F.col("m") <= HUB), "class"))
    split, edge = F.lit(None).cast("string"), F.lit(0)
    rank = F.col("at") - F.col("start")
    for name, part in shares.items():
        upto = edge + F.floor(F.col("m") * F.lit(part))
        split = F.when(split.isNull() & (rank >= edge) & (rank < upto), name).otherwise(split)
        edge = upto
    return counts.join(cut(met.select("grp", split.alias("split"))), "grp")


def _walked(counts: DataFrame, shares: dict[str, float], settled: dict[str, dict[str, int]]) -> DataFrame:
    kind = counts.schema["grp"].dataType.simpleString()

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        groups: dict = {}
        for g, k, c in zip(part["grp"], part["qa_type"], part["n"], strict=True):
            groups.setdefault(g, {})[k] = int(c)
        out = greedy_assign(list(groups.items()), shares, settled)
        return pd.DataFrame(list(out.items()), columns=["grp", "split"])

    return counts.select("grp", "qa_type", "n", F.lit(0).alias("all")).groupBy("all").applyInPandas(walk, f"grp {kind}, split string")
