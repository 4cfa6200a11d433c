"""Connected components, and splits that keep a component together."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where the session names none, one of this process
    if it runs in this process alone, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (folder or _own_dir()).rstrip("/")


@cache
def _own_dir() -> str:
    found = tempfile.mkdtemp(prefix="tables-")
    atexit.register(shutil.rmtree, found, True)
    return found


#: Spark's setting by which the shuffle files of a write go when it ends, not when the driver's memory is next cleared.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a table in the shared folder; it goes when the process ends. What was shuffled for it goes at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    was = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(FREED) if was is None else spark.conf.set(FREED, was)
    atexit.register(drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``cut`` whose last reader has been written."""
    for df in tables:
        drop(df.sparkSession, df.kept_at)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table that no reader needs any more."""
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has ended: the cluster's own clean-up takes the folder
        pass


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, grp): grp is the least node connected with node. Each round halves long chains. Joins are told to shuffle: tables of
    a round are small files that hold many rows, and would go through the driver to be broadcast, several of them a round."""
    arcs = cut(edges.select(F.col(a).alias("x"), F.col(b).alias("y")).union(edges.select(F.col(b), F.col(a))).distinct())
    kept = label = cut(arcs.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.min("x")).alias("grp")))
    while True:
        near = arcs.join(label.withColumnRenamed("node", "y").hint("merge"), "y").groupBy(F.col("x").alias("node")).agg(F.min("grp").alias("near"))
        step = label.join(near.hint("merge"), "node").select("node", F.col("grp").alias("was"), F.least("grp", "near").alias("grp"))
        far = label.select(F.col("node").alias("grp"), F.col("grp").alias("far"))
        new = cut(step.join(far.hint("merge"), "grp", "left").select("node", "was", F.least("grp", F.coalesce("far", "grp")).alias("grp")))
        moved = new.where("was <> grp").limit(1).count()
        forget(kept)
        kept, label = new, new.select("node", "grp")
        if not moved:
            forget(arcs)
            return label


def _least_neighbours(arcs: DataFrame, heavy: int) -> DataFrame:
    """arcs (x, y) with low: the least of x and of its neighbours. Neighbours are reduced before the shuffle; arcs of nodes with
    more than ``heavy`` of them meet their node's row by broadcast (there are fewer such nodes than arcs / heavy), so no
    task gathers them."""
    low = cut(arcs.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("low"), F.count("*").alias("n")))
    hubs = F.broadcast(low.where(F.col("n") > heavy).select("x", F.col("low").alias("hub_low")))
    marked = arcs.join(hubs, "x", "left")
    light = marked.where("hub_low is null").join(low.where(F.col("n") <= heavy).select("x", "low"), "x").select("x", "y", "low")
    return light.unionByName(marked.where("hub_low is not null").select("x", "y", F.col("hub_low").alias("low")))


def star_components(edges: DataFrame, a: str, b: str, heavy: int = 100_000) -> DataFrame:
    """(node, grp): grp is the least node connected with node, by alternating large-star and small-star rounds: first every
    node hands its larger neighbours to the least node that it knows, then its smaller ones, until all hang on their least
    node. Rounds grow with the square of the logarithm of the nodes at most, on chains too; a node's arcs are spread over the
    tasks, however many it has. Loops name a node, nulls none."""
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    nodes = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct()
    state = cut(pairs.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    mark = _mark(state)
    while True:
        both = state.unionByName(state.select(F.col("y").alias("x"), F.col("x").alias("y")))
        large = cut(_least_neighbours(both, heavy).where("y > x").select(F.col("y").alias("x"), F.col("low").alias("y")).distinct())
        small = _least_neighbours(large, heavy)
        new = cut(small.where("y <> low").select(F.col("y").alias("x"), F.col("low").alias("y")).unionByName(small.select("x", F.col("low").alias("y"))).distinct())
        forget(state, large)
        state, was, mark = new, mark, _mark(new)
        if mark == was:
            return nodes.join(state.withColumnRenamed("x", "node"), "node", "left").select("node", F.coalesce("y", "node").alias("grp"))


def _mark(arcs: DataFrame) -> tuple:
    return tuple(arcs.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())


def hash_split(df: DataFrame, grp: str, seed: str, train: float = 0.85, val: float = 0.10) -> DataFrame:
    """split by the hash of the group: no group lies in two splits, at any size and without a driver step."""
    share = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(grp).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return df.withColumn("split", F.when(share < train, "train").when(share < train + val, "val").otherwise("test"))


def leaks(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that lie in more than one split."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("n_splits")).where("n_splits > 1")


def greedy_assign(groups: list[tuple[str, dict[str, int]]], shares: dict[str, float], settled: dict[str, dict[str, int]] | None = None) -> dict[str, str]:
    """Stratified assignment of a bounded list of (group, rows by kind), the largest first: each goes to the
    split that it fills least, by its kinds and by rows; ties go to the first split. settled: rows by kind that the splits
    already hold."""
    filled = {s: dict((settled or {}).get(s, {})) for s in shares}
    total: dict[str, int] = {}
    for kinds in [*(k for _, k in groups), *filled.values()]:
        for k, n in kinds.items():
            total[k] = total.get(k, 0) + n
    rows = sum(total.values()) or 1
    held = {s: sum(filled[s].values()) for s in shares}
    out = {}
    for name, kinds in sorted(groups, key=lambda g: (-sum(g[1].values()), g[0])):
        size = sum(kinds.values())

        def cost(s: str, kinds: dict[str, int] = kinds, size: int = size) -> float:
            worst = max((filled[s].get(k, 0) + n) / max(1e-9, total[k] * shares[s]) for k, n in kinds.items())
            return worst + 0.25 * (held[s] + size) / max(1e-9, rows * shares[s])

        best = min(shares, key=cost)
        out[name] = best
        held[best] += size
        for k, n in kinds.items():
            filled[best][k] = filled[best].get(k, 0) + n
    return out


def deal(df: DataFrame, key: str, seed: str, first: float = 0.7, second: float = 0.2) -> DataFrame:
    """Conditions positive, distractor and none in fixed shares of the rows in hash order.

    Ranks come from percentiles of the hash within buckets of it, so no task sorts the whole table.
    """
    h = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    bucketed = df.withColumn("h", h).withColumn("bucket", F.substring("h", 1, 3))
    sizes = bucketed.groupBy("bucket").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))
    placed = bucketed.join(before, "bucket").withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("bucket").orderBy("h", key)))
    cut = F.floor(F.col("total") * F.lit(first)), F.floor(F.col("total") * F.lit(second))
    kind = F.when(F.col("rank") <= cut[0], "positive").when(F.col("rank") <= cut[0] + cut[1], "distractor").otherwise("none")
    return placed.select(*df.columns, kind.alias("condition"))


def balance(df: DataFrame, kind: str, split: str = "split") -> DataFrame:
    """kind, train, val, test, val_off, test_off: a split is off where the kind's share is over twice or under half of that in
    train (one percent there at least), or where it lacks a rarer kind that train has."""
    names = ["train", "val", "test"]
    wide = df.groupBy(kind).pivot(split, names).count().na.fill(0)
    totals = wide.agg(*(F.greatest(F.sum(n), F.lit(1)).alias(f"{n}__") for n in names))
    share = {n: 100.0 * F.col(n) / F.col(f"{n}__") for n in names}
    base = share["train"]
    off = lambda n: F.when((base >= 1) & ((share[n] > 2 * base) | (share[n] < 0.5 * base)), True).when((base < 1) & (F.col(n) == 0) & (F.col("train") > 0), True).otherwise(False)
    return wide.join(F.broadcast(totals)).select(kind, *names, off("val").alias("val_off"), off("test").alias("test_off"))  # one row of totals
