"""Sharding by a two-pass external shuffle: a uniform order of all rows, cut into shards of equal length.

First pass: a seeded hash of the whole row scatters rows over as many buckets as hold ``BUCKET_BYTES`` of text each; the
scatter is one shuffle, whose files are the buckets on disk. Second pass: a task takes one bucket into memory, puts
its rows into the order of their hashes (so that it does not matter in which order they arrived), runs a
Fisher-Yates shuffle seeded with the bucket's number over it and writes it. Buckets in their order, and rows in their
order within a bucket, are the uniform order. A row's place in it follows from the counts of the buckets before its own,
one number a bucket. Shard s holds the s-th stretch of the order, so a task that writes shards opens few files.

The same rows and seed give the same shards, however the input is split over files, but for rows that are equal in every
column: where copies of one such row would overfill a bucket by themselves (twice a bucket's mean number of rows),
they are scattered by where they stand in the input instead. There are fewer than half as many such keys as
buckets, so their table is broadcast. Maps are not hashed.

Null texts count no bytes; one text longer than a bucket makes its bucket longer; repeated rows are dealt one by one; an empty
table gives an empty result. Columns of the caller that are called ``shard`` or ``slot`` are replaced, others of any name pass
through: inside, a row travels as one struct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StructField, StructType, VariantType

from sparkloom.llm.common import keep, release, small_batches

#: Bytes of text that a bucket holds on average; a task holds about three times as much.
BUCKET_BYTES = 32 << 20
#: Rows of a batch that goes back to Spark.
OUT_ROWS = 512


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform order of n rows: from the last row down, each is swapped with one of those up to itself."""
    draws = np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), bucket])).integers(0, np.arange(n, 0, -1)).tolist()
    order = list(range(n))
    for i, j in zip(range(n - 1, 0, -1), draws, strict=False):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def row_hash(df: DataFrame, seed: int) -> Column:
    """A seeded hash of all columns but maps and variants."""
    columns = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (MapType, VariantType))]
    return F.xxhash64(F.lit(seed), *columns)


def shuffle_rows(df: DataFrame, text: str = "text", seed: int = 1, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """row (all columns of df as a struct), bucket, place: the uniform order, written bucket by bucket in the shared folder."""
    spark = df.sparkSession
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    hashed = df.select(whole, row_hash(df, seed).alias("h"), F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).alias("size"))
    total = hashed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("size").cast("long") + 1), F.lit(0)).alias("b")).first()
    buckets = max(1, -(-total["b"] // bucket_bytes))
    key = F.col("h")
    rows = hashed.select("row", "h", F.monotonically_increasing_id().alias("at"))
    if buckets > 1:
        often = hashed.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > 2 * total["n"] / buckets).select("h", F.lit(True).alias("often"))
        rows = rows.join(F.broadcast(often), "h", "left")  # fewer than buckets / 2 keys of eight bytes
        key = F.when(F.col("often"), F.xxhash64("h", "at")).otherwise(F.col("h"))
    scattered = rows.select("row", key.alias("h")).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int")).repartitionById(buckets, "bucket")
    small_batches(spark)
    schema = StructType([*scattered.schema.fields, StructField("place", LongType())])

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            del held
            bucket = table["bucket"][0].as_py()
            order = np.argsort(table["h"].to_numpy(), kind="stable")[fisher_yates(table.num_rows, seed, bucket)]
            for at in range(0, len(order), OUT_ROWS):
                some = table.take(order[at : at + OUT_ROWS]).append_column("place", pa.array(np.arange(at, min(at + OUT_ROWS, len(order)))))
                yield from some.combine_chunks().to_batches()
            del table
        release()

    return keep(scattered.mapInArrow(shuffle, schema).drop("h"), "buckets")


def deal_shards(df: DataFrame, shards: int = 16, text: str = "text", seed: int = 1, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """df with shard (from 0) and slot (from 0, without gaps, in the uniform order); shards differ by one row at most,
    the first ones are the longer ones."""
    ordered = shuffle_rows(df, text, seed, bucket_bytes)
    sizes = ordered.groupBy("bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))  # a row a bucket
    starts = sizes.select("bucket", F.coalesce(before, F.lit(0)).alias("start"))
    n = ordered.count()
    least, longer = divmod(n, shards)
    edge, least = longer * (least + 1), max(1, least)  # up to the edge, shards are a row longer
    shard = F.expr(f"cast(if(at < {edge}, at div {least + 1}, {longer} + (at - {edge}) div {least}) as int)")
    slot = F.expr(f"if(at < {edge}, at % {least + 1}, (at - {edge}) % {least})")
    own = [F.col("row")[c].alias(c) for c in df.columns if c not in ("shard", "slot")]
    placed = ordered.join(F.broadcast(starts), "bucket").select("row", (F.col("start") + F.col("place")).alias("at"))
    return placed.select(*own, shard.alias("shard"), slot.alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int = 16, text: str = "text", seed: int = 1) -> DataFrame:
    """Writes shard=0 .. as Parquet folders below path, each file a stretch of the shard's slots, and gives what was
    written: shard, n_rows, n_bytes (of texts)."""
    dealt = deal_shards(df, shards, text, seed)
    dealt.write.partitionBy("shard").parquet(path)
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")).cast("long"), F.lit(0))
    return df.sparkSession.read.parquet(path).groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum(size).alias("n_bytes"))


def shard_places(df: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, under the law ``rows``."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    size = F.octet_length(text).cast("long") + 1
    return deal_shards(df, shards).select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
