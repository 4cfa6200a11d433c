"""Stages that are written one after the other and need not be run again: each leaves a marker of what it was made of."""

from __future__ import annotations

import json
from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.files import empty_if_missing

Stage = tuple[str, Callable[..., DataFrame], dict]
_MARKER = "made_of string, rows long, parameters string, columns string"


def fingerprint(*parts: object) -> str:
    return sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def input_marks(spark: SparkSession, paths: list[str]) -> list[list]:
    """[path, files, bytes, last change] of every input, without reading it."""
    out = []
    for path in paths:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("length", "modificationTime")
        m = files.agg(F.count("*").alias("n"), F.sum("length").alias("b"), F.max("modificationTime").cast("string").alias("t")).first()
        out.append([path, m["n"], m["b"], m["t"]])
    return out


def marker(spark: SparkSession, path: str) -> DataFrame:
    """The marker of a stage's folder, empty where the stage did not end."""
    return empty_if_missing(spark, lambda: spark.read.schema(_MARKER).json(f"{path}/marker"), _MARKER)


def run_stages(spark: SparkSession, source: DataFrame, inputs: list[str], stages: list[Stage], folder: str, force: bool = False) -> DataFrame:
    """Runs (name, function, parameters) in turn: function(rows, **parameters) gets what the stage before wrote. A stage's rows
    go to folder/name/rows and, once they are whole, a marker with the hash of the inputs, of all stages up to this one and
    of its parameters, and with its counts, to folder/name/marker. A stage whose marker still fits is not run: a run that was
    killed goes on after its last whole stage, and a changed parameter or input runs its stage and all after it."""
    made_of, rows = fingerprint(input_marks(spark, inputs)), source
    for name, work, parameters in stages:
        made_of = fingerprint(made_of, name, work.__qualname__, parameters)
        path = f"{folder}/{name}"
        found = marker(spark, path).select("made_of").take(1)
        if force or not found or found[0]["made_of"] != made_of:
            spark.createDataFrame([], _MARKER).write.mode("overwrite").json(f"{path}/marker")  # what stands there is no whole stage any more
            seen = Observation()
            out = work(rows, **parameters)
            out.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/rows")
            facts = [(made_of, seen.get["n"], json.dumps(parameters, sort_keys=True, default=str), ",".join(out.columns))]
            spark.createDataFrame(facts, _MARKER).coalesce(1).write.mode("overwrite").json(f"{path}/marker")
        rows = spark.read.parquet(f"{path}/rows")
    return rows


def report(spark: SparkSession, folder: str, stages: list[Stage]) -> DataFrame:
    """stage, rows, parameters, columns of every stage that ended."""
    out = None
    for name, *_ in stages:
        one = marker(spark, f"{folder}/{name}").select(F.lit(name).alias("stage"), "rows", "parameters", "columns")
        out = one if out is None else out.unionByName(one)
    return out
