"""Which of many items stand whole in which of many texts, without a pass of every item over every text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a run, and neighbouring runs of a window that gives its least hash as a fingerprint.
RUN, WINDOW = 5, 4
#: Letters of the pieces by which items of one or two words are looked up among the words of all texts.
PIECE = 3


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def words_of(c: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")


def _hashes(w: Column, run: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(w) - (run - 1)), lambda i: F.xxhash64(F.slice(w, i, run)))


def winnowed(w: Column, run: int = RUN, window: int = WINDOW) -> Column:
    """The least hash of every window of neighbouring runs of words, each once: any two lists of words that share
    run + window - 1 neighbours share a fingerprint. An empty list where there are fewer words."""
    least = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.array_min(F.slice(h, i, window)))
    return F.when(F.size(w) >= run + window - 1, F.array_distinct(_let(_hashes(w, run), least))).otherwise(F.array().cast("array<bigint>"))


def contained(items: DataFrame, item_key: str, item: str, texts: DataFrame, text_key: str, text: str) -> DataFrame:
    """(item_key, text_key) of every item that stands in a text, letter for letter; keys name one row.

    All words of an item but its first and its last stand whole in such a text. If these are enough for a window, one
    fingerprint of theirs is among the winnowed ones of the text; if there are fewer, the run that they make is looked up, at
    most seven lengths of them. The first word of an item of one or two stands in some word of the text: its first
    letters are looked up among the pieces of the distinct words of all texts. Ids alone meet; a text is fetched and read
    for the items that are looked up with success. Items without a word meet the texts themselves, once for each distinct
    item. Null items and texts contain nothing."""
    known = items.where(F.col(item).isNotNull()).select(F.col(item_key).alias("i"), F.col(item).alias("item"))
    known = known.withColumn("w", words_of(F.col("item"))).withColumn("m", F.size("w") - 2)
    rows = texts.where(F.col(text).isNotNull()).select(F.col(text_key).alias("t"), F.col(text).alias("text"))
    listed = rows.select("t", words_of(F.col("text")).alias("w"))
    enough = RUN + WINDOW - 1
    inner = F.slice("w", F.lit(2), F.greatest(F.lit(0), F.col("m")))
    kinds = known.groupBy(F.when(F.col("m") >= enough, enough).when(F.col("m") > 0, F.col("m")).when(F.trim(F.regexp_replace("item", r"\s+", " ")) == "", -1).otherwise(0).alias("kind")).count().collect()  # at most ten
    hits = []
    for kind in sorted(r["kind"] for r in kinds):
        if kind == enough:
            keyed = known.where(F.col("m") >= enough).select("i", F.array_min(winnowed(inner)).alias("k"))
            hits.append(listed.select("t", F.explode(winnowed(F.col("w"))).alias("k")).join(keyed, "k").select("t", "i"))
        elif kind > 0:
            keyed = known.where(F.col("m") == kind).select("i", F.xxhash64(inner).alias("k"))
            runs = listed.where(F.size("w") >= kind).select("t", F.explode(F.array_distinct(_hashes(F.col("w"), kind))).alias("k"))
            hits.append(runs.join(keyed, "k").select("t", "i"))
        elif kind == 0:
            short = known.where((F.col("m") <= 0) & (F.trim(F.regexp_replace("item", r"\s+", " ")) != "")).select("i", F.col("w")[0].alias("first"))
            keyed = short.withColumn("k", F.substring("first", 1, PIECE))
            places = listed.select("t", F.explode(F.array_distinct("w")).alias("word"))
            sizes = F.array(*(F.lit(n) for n in range(1, PIECE + 1)))
            pieces = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("word") - n + 1)), lambda i: F.substring(F.col("word"), i, n))))
            met = places.select("word").distinct().select("word", F.explode(F.array_distinct(pieces)).alias("k")).join(keyed, "k").where(F.contains("word", F.col("first"))).select("word", "i")
            hits.append(places.join(met, "word").select("t", "i"))
    found = []
    if hits:
        met = reduce(DataFrame.unionByName, hits).distinct().join(known.select("i", "item"), "i").join(rows, "t")
        found.append(met.where(F.contains("text", F.col("item"))).select("i", "t"))
    if any(r["kind"] == -1 for r in kinds):
        bare = known.where(F.trim(F.regexp_replace("item", r"\s+", " ")) == "")
        some = rows.join(bare.select("item").distinct(), F.contains("text", F.col("item"))).select("t", "item")
        found.append(some.join(bare.select("i", "item"), "item").select("i", "t"))
    if not found:
        found.append(known.join(rows, F.lit(False)).select("i", "t"))
    return reduce(DataFrame.unionByName, found).select(F.col("i").alias(item_key), F.col("t").alias(text_key))
