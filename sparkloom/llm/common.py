"""What the corpus operators share: tables, Arrow maps over texts, tables kept in the shared folder."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.operators import graph
from sparkloom.operators.graph import drop, shared_dir

#: The white space that separates words in most operators (fixed set): space and \x09 to \x0D.
SPACES = " \t\n\x0b\x0c\r"
#: Rows an Arrow batch may hold; texts can be long, so it is small.
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once a row, however often body names it."""
    return F.transform(F.array(value), body)[0]


#: Caches of operators in a Python worker; one is emptied when a task of another operator begins.
CACHES: list[dict] = []


def release() -> None:
    """Hands memory that a worker no longer needs back to the system: workers are used again by later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU allocator
        pass


def stretches(texts: list, letters: int) -> Iterator[tuple[int, int]]:
    """(first, end) of neighbours that hold about so many letters; one longer text stands alone."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < letters):
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


def small_batches(spark: SparkSession) -> None:
    """Long texts: keep Arrow batches small unless the session asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_columns(df: DataFrame, columns: list[Column], schema: str, make: Callable[[], Callable[..., Iterable[tuple]]]) -> DataFrame:
    """make() runs once a task and gives a function from lists, one a column, to result rows; if that function
    has an attribute finish, its rows come last."""
    small_batches(df.sparkSession)
    rows = df.select(*(c.alias(f"c{i}") for i, c in enumerate(columns)))
    kind = StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cache in CACHES:
            if cache is not getattr(make, "cache", None):
                cache.clear()
        work = make()

        def parts() -> Iterator[Iterable[tuple]]:
            for batch in batches:
                yield work(*(c.to_pylist() for c in batch.columns))
            if hasattr(work, "finish"):
                yield work.finish()

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        for part in parts():
            out: list[tuple] = []
            for row in part:
                out.append(row)
                if len(out) == 20_000:
                    yield packed(out)
                    out = []
            if out:
                yield packed(out)
        del work
        release()

    return rows.mapInArrow(run, kind)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors and gives the planner true
    sizes. ``graph.forget`` deletes the table once its last reader has been written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    del df
    gc.collect()
    spark._jvm.System.gc()  # shuffle files that nothing refers to any more go now
    atexit.register(drop, spark, path)
    out = spark.read.schema(schema).parquet(path)
    out.kept_at = path
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with an edge to another one; root is the least node it is connected with."""
    return graph.components(edges.where(F.col(a) != F.col(b)), a, b).withColumnRenamed("grp", "root")
