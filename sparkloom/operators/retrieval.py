"""Exact dense and hybrid retrieval over vectors, context assembly and recall."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.operators.answers import truncated

BOOST = 10.0
#: Query vectors that are sent to every task at a time, similarities that a task holds at a time.
BLOCK, CELLS = 4096, 1_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def normalised(df: DataFrame, vector: str) -> DataFrame:
    """df with the vector at length one; a zero vector stays."""
    n = F.sqrt(dot(F.col(vector), F.col(vector)))
    return df.withColumn(vector, F.when(n > 0, F.transform(vector, lambda x: (x.cast("double") / n).cast("float"))).otherwise(F.col(vector)))


def encode(df: DataFrame, text: str, encoder: Callable[[], Callable[[list[str]], np.ndarray]], prefix: str = "", out: str = "embedding") -> DataFrame:
    """df with the vectors of a text; ``encoder`` runs once a task and gives a function from texts to a matrix, so any model
    can stand behind it. Questions take a prefix, passages none."""
    schema = StructType([*df.schema.fields, *StructType.fromDDL(f"{out} array<float>")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work = encoder()
        for batch in batches:
            vectors = work([prefix + (t or "") for t in batch[text]])
            yield batch.assign(**{out: [v.astype("float32").tolist() for v in np.asarray(vectors)]})

    return df.mapInPandas(run, schema)


def _best(queries: list[tuple], k: int, boost: float, spark: SparkSession) -> Callable:
    """Rows (pid, vector, key) of a batch to the k best (qid, pid, sim) of each query: a matrix product for every ``CELLS`` similarities."""
    sent = spark.sparkContext.broadcast(([q[0] for q in queries], np.array([q[1] for q in queries], np.float64), [q[2] for q in queries]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix, keys = sent.value
        codes = {key: i for i, key in enumerate(dict.fromkeys(k for k in keys if k is not None))}
        wanted = np.array([codes.get(k, -1) for k in keys])
        for batch in batches:
            pids = batch.column(0).to_pylist()
            if not pids:
                continue
            vectors = np.array(batch.column(1).to_pylist(), np.float64)
            own = np.array([codes.get(x, -2) for x in batch.column(2).to_pylist()])
            order = np.argsort(np.array(pids), kind="stable")  # ties go to the lesser id
            found: tuple[list, list, list] = ([], [], [])
            some_queries = max(1, CELLS // len(pids))
            for j, name in enumerate(names):
                if j % some_queries == 0:
                    part = slice(j, j + some_queries)
                    sims = np.round(vectors @ matrix[part].T, 6)
                    if boost:
                        sims = np.round(sims + boost * (own[:, None] == wanted[None, part]), 6)
                line = sims[order, j % some_queries]
                if len(line) > k:
                    some = np.flatnonzero(line >= np.partition(line, len(line) - k)[len(line) - k])
                else:
                    some = np.arange(len(line))
                some = some[np.argsort(-line[some], kind="stable")][:k]
                found[0].extend([name] * len(some))
                found[1].extend(pids[x] for x in order[some])
                found[2].extend(line[some].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["qid", "pid", "sim"])

    return run


def dense(queries: DataFrame, passages: DataFrame, k: int, boost: float = 0.0) -> DataFrame:
    """qid, pid, sim, rank (from 0): the k best passages of each query by inner product. queries: qid, q (and key);
    passages: pid, p (and key); with a boost, passages whose key is the query's score so much more.

    Queries go in blocks of about ``BLOCK`` to the tasks, whatever their number; a batch of passages meets a block in
    matrix products of bounded size and hands on k rows a query, so the last ranking sees k rows a batch, not all passages."""
    spark = queries.sparkSession
    keyed = [df.withColumn("key", F.col("key") if "key" in df.columns else F.lit(None).cast("string")) for df in (queries, passages)]
    blocks = max(1, -(-queries.count() // BLOCK))
    out = None
    rows = keyed[1].where("p is not null").select(F.col("pid").cast("long"), "p", F.col("key").cast("string"))
    for b in range(blocks):
        some = [(r[0], r[1], r[2]) for r in keyed[0].where("q is not null").where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).select("qid", "q", F.col("key").cast("string")).collect()]  # a bounded block
        if some:
            part = rows.mapInArrow(_best(some, k, boost, spark), "qid long, pid long, sim double")
            out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "qid long, pid long, sim double, rank int")
    return ranked(out, k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("sim"), "pid")
    return scored.withColumn("rank", F.row_number().over(w).cast("int") - 1).where(F.col("rank") < k)


def hybrid(queries: DataFrame, passages: DataFrame, cited: DataFrame, k: int, exclude: DataFrame | None = None) -> DataFrame:
    """Dense results joined by the passages that a query cites (qid, pid; a few a query), which score similarity + BOOST;
    pairs of exclude (qid, pid) are left out, however many: so many more are fetched."""
    most = 0 if exclude is None else exclude.groupBy("qid").count().agg(F.max("count")).first()[0] or 0
    named = cited.join(queries, "qid").join(passages, "pid").select("qid", "pid", F.round(dot(F.col("q"), F.col("p")) + BOOST, 6).alias("sim"))
    both = dense(queries, passages, k + 10 + most).select("qid", "pid", "sim").unionByName(named)
    best = both.groupBy("qid", "pid").agg(F.max("sim").alias("sim"))
    return ranked(best if exclude is None else best.join(exclude, ["qid", "pid"], "left_anti"), k)


def passed(found: DataFrame, kinds: list[str], least: float = 80.0, column: str = "r3") -> DataFrame:
    """found (of recall), or an error if a kind stays below the least percent."""
    if bad := [f"{r.kind} {r[column]}" for r in found.where(F.col("kind").isin(kinds) & (F.col(column) < least)).collect()]:
        raise ValueError(f"recall too low: {', '.join(bad)}")
    return found


def recall(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Percent of queries whose gold passage is among the first k, by kind and overall (kind null)."""
    at = gold.join(hits.select("qid", "pid", "rank"), ["qid", "pid"], "left").withColumn("pos", F.coalesce(F.col("rank") + 1, F.lit(99)))
    return at.rollup("kind").agg(*(F.round(100 * F.avg((F.col("pos") <= k).cast("double")), 4).alias(f"r{k}") for k in ks), F.count("*").alias("n"))


def assemble(chunks: DataFrame, most: int = 4, budget: int = 430, written: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """qid, n, context: chunks (qid, pid, priority, seq, text), each once, best first, sharing a budget of 4 letters a token.
    ``written`` makes the text out of that column, which may be a key of the same order, for the chosen chunks alone. Rows are
    shuffled once."""
    one = chunks.repartition("qid").groupBy("qid", "pid").agg(F.min("priority").alias("priority"), F.min("seq").alias("seq"), F.min("text").alias("text"))
    first = one.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("priority", "seq", "pid"))).where(F.col("r") <= most)
    listed = first.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("r", "text"))).alias("c"))
    share = F.greatest(F.lit(60), F.floor(F.lit(budget) / F.size("c"))).cast("int") * 4
    return listed.select("qid", F.size("c").alias("n"), F.array_join(F.transform("c", lambda x: truncated(written(x["text"]), share)), "\n\n---\n\n").alias("context"))


def truncated_tokens(df: DataFrame, text: str, budget: int, tokenizer: Callable[[], object], out: str) -> DataFrame:
    """df with a text cut to a budget of tokens, at the last sentence or clause end past the middle, and marked. ``tokenizer``
    runs once a task and gives an object with encode(text) -> ids and decode(ids) -> text."""
    schema = StructType([*df.schema.fields, *StructType.fromDDL(f"{out} string")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = tokenizer()

        def cut(t: str | None) -> str | None:
            if t is None or len(ids := tool.encode(t)) <= budget:
                return t
            head = tool.decode(ids[:budget])
            stop = max(head.rfind(". "), head.rfind("; "))
            return (head[: stop + 1] if stop > len(head) * 0.5 else head).rstrip() + " [...]"

        for batch in batches:
            yield batch.assign(**{out: batch[text].map(cut, na_action="ignore")})

    return df.mapInPandas(run, schema)
