"""Registration of queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.graph import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one folder by attribute."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self._folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What ``make`` gives, worked out and written once a query however many of its parts read it."""
        if name not in self._made:
            self._made[name] = cut(make())
        return self._made[name]

    @property
    def edges(self) -> DataFrame:
        """The concordance: part (old) to supplier (new) of the small orders without discount."""
        return self.lineitem.where("l_quantity <= 2 and l_discount = 0").select(F.col("l_partkey").alias("old"), F.col("l_suppkey").alias("new")).distinct()

    @property
    def old_all(self) -> DataFrame:
        return self.part.select(F.col("p_partkey").alias("old"))

    @property
    def new_all(self) -> DataFrame:
        return self.supplier.select(F.col("s_suppkey").alias("new"))


EDGES = "e as (select distinct l_partkey as old, l_suppkey as new from lineitem where l_quantity <= 2 and l_discount = 0)"


def register(sql: str | None = None) -> Callable:
    def put(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[make.__name__] = lambda spark, folder: make(Tables(spark, folder))
        if sql:
            ORACLES[make.__name__] = sql
        return make

    return put
