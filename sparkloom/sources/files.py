"""Readers and writers of the file formats of a text corpus; every reader takes its schema from the caller."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators.ranks import global_rank


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_json_items(spark: SparkSession, path: str, field: str, item_schema: str) -> DataFrame:
    """The objects in one array field of JSON documents."""
    return spark.read.schema(f"{field} array<struct<{item_schema}>>").option("multiLine", True).json(path).select(F.inline(field))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of every file: what to compare with to load only what is new."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def not_yet_loaded(files: DataFrame, known: DataFrame) -> DataFrame:
    return files.join(known, ["path", "sha256"], "left_anti")


def robots_rules(robots: DataFrame, agent: str = "*") -> DataFrame:
    """host, prefix, allow of the groups of robots files (host, body) that name the agent; an empty path is no rule. A group is
    a run of agent lines and the rules up to the next one."""
    lines = robots.select("host", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("i", "line")).withColumn("line", F.regexp_replace("line", r"#.*$", ""))
    field, value = F.lower(F.trim(F.split_part("line", F.lit(":"), F.lit(1)))), F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1))
    known = lines.select("host", "i", field.alias("field"), value.alias("value")).where(F.col("field").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("host").orderBy("i")
    opens = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(order), F.lit("")) != "user-agent")
    grouped = known.withColumn("g", F.sum(opens.cast("int")).over(order))
    named = F.max((F.col("field") == "user-agent") & (F.lower("value") == agent.lower())).over(Window.partitionBy("host", "g"))
    return grouped.withColumn("named", named).where("named and g > 0 and field <> 'user-agent' and value <> ''").select("host", F.regexp_replace("value", r"\*$", "").alias("prefix"), (F.col("field") == "allow").alias("allow")).distinct()


def allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url) without those that their host's rules (host, prefix and, if there are any that allow, allow) forbid: the longest
    prefix of the path decides, of equal ones the one that allows. A host without rules allows everything, and so does a
    text that is no URL. A URL meets only rules of its host whose length some rule has, by equality of the prefix."""
    rules = rules if "allow" in rules.columns else rules.withColumn("allow", F.lit(False))
    best = rules.where("prefix <> ''").groupBy("host", "prefix").agg(F.max("allow").alias("allow"))
    lengths = best.groupBy("host").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    path, query = (F.expr(f"try_parse_url(url, '{part}')") for part in ("PATH", "QUERY"))
    whole = F.concat(F.when(F.coalesce(path, F.lit("")) == "", "/").otherwise(path), F.coalesce(F.concat(F.lit("?"), query), F.lit("")))
    asked = urls.select("url").distinct().select("url", F.expr("try_parse_url(url, 'HOST')").alias("host"), whole.alias("path")).join(lengths, "host")
    tried = asked.select("url", "host", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"), "path").select("url", "host", F.substring(F.col("path"), F.lit(1), F.col("n")).alias("prefix"))
    verdict = tried.join(best, ["host", "prefix"]).groupBy("url").agg(F.max_by("allow", F.struct(F.length("prefix"), "allow")).alias("allow"))
    return urls.join(verdict.where("not allow").select("url"), "url", "left_anti")


def write_jsonl(df: DataFrame, path: str, **options: str) -> None:
    df.write.options(**options).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, columns: list[str], path: str) -> None:
    df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns)).write.option("header", True).option("escape", "\"").csv(path)


def write_splits(df: DataFrame, path: str, column: str = "split") -> None:
    df.write.partitionBy(column).parquet(path)


def write_index_files(df: DataFrame, path: str, row: list[str], index: list[str], order: str, split: str = "split") -> None:
    """For each split a folder of rows and one of their index, aligned by the row number in both."""
    numbered = global_rank(df, [split, order], "row_id")
    for name, columns in (("rows", row), ("index", index)):
        numbered.select("row_id", split, *columns).write.partitionBy(split).json(f"{path}/{name}")


def prompts(df: DataFrame, number: str, text: str, n: int, batches: int, head: str) -> DataFrame:
    """batch (from 0), prompt: rows numbered from 1, in batches of the same size, under one instruction."""
    size = max(1, -(-n // batches))
    batch = F.floor((F.col(number) - 1) / size)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(number).alias("i"), F.col(text).alias("t")))), lambda x: F.concat(x["i"].cast("string"), F.lit(". "), x["t"]))
    return df.groupBy(batch.alias("batch")).agg(F.concat(F.lit(head + "\n"), F.array_join(lines, "\n")).alias("prompt"))


def write_prompts(df: DataFrame, path: str) -> None:
    """A text file for each batch (batch, prompt): path/batch=0 and so on."""
    df.select("batch", F.col("prompt").alias("value")).repartition("batch").write.partitionBy("batch").option("lineSep", "\u0000").text(path)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """batch, prompt of the files of ``write_prompts``."""
    files = spark.read.schema("value string, batch long").text(path, wholetext=True)
    return files.select("batch", F.regexp_replace("value", "\u0000$", "").alias("prompt"))


def to_fetch(urls: DataFrame, landed: DataFrame, force: bool = False) -> DataFrame:
    """urls (url, path) whose file has not landed or is empty; all of them if forced. landed: path, bytes."""
    return urls if force else urls.join(landed.where("bytes > 0").select("path"), "path", "left_anti")


def merged_manifest(*parts: DataFrame) -> DataFrame:
    """path, url, retrieved, bytes, sha256 of the last retrieval of each path, whatever manifest has it."""
    rows = reduce(DataFrame.unionByName, parts)
    fields = ["url", "retrieved", "bytes", "sha256"]
    return rows.groupBy("path").agg(F.max_by(F.struct(*fields), F.struct("retrieved", "sha256")).alias("m")).select("path", "m.*")


def write_json(rows: list[dict] | dict, path: str) -> None:
    """A small report as indented JSON; it is one file for people to read, not a table."""
    Path(path).write_text(json.dumps(rows, ensure_ascii=False, indent=2), encoding="utf-8")


def write_vectors(df: DataFrame, path: str, key: str, vector: str, parts: int = 16) -> None:
    """A vector index: rows dealt by the hash of their key, vectors beside what describes them."""
    df.where(F.col(vector).isNotNull()).repartition(parts, key).write.parquet(path)


def read_vectors(spark: SparkSession, path: str, expected: int) -> DataFrame:
    """The index at path, or an error if it does not hold as many rows as its description says."""
    found = spark.read.parquet(path)
    if (n := found.count()) != expected:
        raise ValueError(f"the index holds {n} rows, its description {expected}")
    return found


def counted(df: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Writes df and gives the number of rows written, counted on the way."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get["n"]


def empty_if_missing(spark: SparkSession, read: Callable[[], DataFrame], schema: str) -> DataFrame:
    """What read gives, or a table without rows where its path does not exist."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
