"""Concordances: many-to-many edges between two numberings (old, new), typed and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classify(edges: DataFrame, old_all: DataFrame, new_all: DataFrame) -> DataFrame:
    """old, new, mapping_type: split before merged before direct; removed and new_provision where a side is missing."""
    out = F.count("*").over(Window.partitionBy("old"))
    into = F.count("*").over(Window.partitionBy("new"))
    typed = edges.distinct().select("old", "new", F.when(out > 1, "split").when(into > 1, "merged").otherwise("direct").alias("mapping_type"))
    removed = old_all.join(edges, "old", "left_anti").select("old", F.lit(None).cast("long").alias("new"), F.lit("removed").alias("mapping_type"))
    fresh = new_all.join(edges, "new", "left_anti").select(F.lit(None).cast("long").alias("old"), "new", F.lit("new_provision").alias("mapping_type"))
    return typed.unionByName(removed).unionByName(fresh)


def adjacency(edges: DataFrame, key: str, value: str) -> DataFrame:
    return edges.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("refs"))


def crosscheck(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that both sources have and where they differ: kind is partial_overlap or no_overlap."""
    x, y = adjacency(a, key, value).withColumnRenamed("refs", "ours"), adjacency(b, key, value).withColumnRenamed("refs", "theirs")
    kind = F.when(F.col("ours") == F.col("theirs"), "equal").when(F.arrays_overlap("ours", "theirs"), "partial_overlap").otherwise("no_overlap")
    return x.join(y, key).withColumn("kind", kind)


def collisions(edges: DataFrame, old_all: DataFrame, new_all: DataFrame) -> DataFrame:
    """Numbers that both numberings use although they are not counterparts, with the true counterparts."""
    both = old_all.join(new_all, F.col("old") == F.col("new"))
    return both.join(edges, ["old", "new"], "left_anti").join(adjacency(edges, "old", "new"), "old")


def typed(pairs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """old_act, old_section, old_title, new_act, new_section, new_title, mapping_type, row: the pairs with the titles
    of both sides, sections without a counterpart as removed or new_provision. old and new: act, section, title."""
    o = old.select(F.col("act").alias("old_act"), F.col("section").alias("old_section"), F.col("title").alias("old_title"))
    n = new.select(F.col("act").alias("new_act"), F.col("section").alias("new_section"), F.col("title").alias("new_title"))
    out = F.count("*").over(Window.partitionBy("old_act", "old_section"))
    into = F.count("*").over(Window.partitionBy("new_act", "new_section"))
    kind = F.when(out > 1, "split").when(into > 1, "merged").otherwise("direct")
    both = pairs.withColumn("mapping_type", kind).join(o, ["old_act", "old_section"]).join(n, ["new_act", "new_section"])
    gone = o.join(pairs, ["old_act", "old_section"], "left_anti").withColumn("mapping_type", F.lit("removed"))
    fresh = n.join(pairs, ["new_act", "new_section"], "left_anti").withColumn("mapping_type", F.lit("new_provision"))
    columns = ["old_act", "old_section", "old_title", "new_act", "new_section", "new_title", "mapping_type", "row"]
    return both.select(columns).unionByName(gone, allowMissingColumns=True).unionByName(fresh, allowMissingColumns=True)


def ordered_distinct(df: DataFrame, keys: list[str], value: str, order: str, out: str) -> DataFrame:
    """keys and the distinct values of each, in the order in which they come first."""
    first = df.groupBy(*keys, value).agg(F.min(order).alias("o__"))
    listed = F.array_sort(F.collect_list(F.struct("o__", F.col(value).alias("v"))))
    return first.groupBy(*keys).agg(F.transform(listed, lambda x: x["v"]).alias(out))


def prioritised(first: DataFrame, second: DataFrame, key: str, text: str, name: str, other: str) -> DataFrame:
    """All rows of the first source, and of the second those whose key the first lacks and whose text says something."""
    more = second.join(first.select(key).distinct(), key, "left_anti").where(F.trim(text) != "")
    return first.withColumn("provenance", F.lit(name)).unionByName(more.withColumn("provenance", F.lit(other)))
