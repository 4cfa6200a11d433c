"""Line dedup by log templates, in DataFrame functions alone.

A line's words that hold a digit become a field. A tree of fixed depth puts lines of the same number of words
and the same leading words into one leaf. Within a leaf, a word that ``min_docs`` documents have at its place
is fixed, any other becomes a field too; a line of which at least ``fixed_share`` of the words stay fixed takes
that template, any other keeps its own words. A template is found in every line of its leaf that holds its
fixed words at their places, lines that recur by themselves among them, and also counts with the words fixed
by the other lines alone. Templates found in ``min_docs`` documents are dropped wherever they occur. Documents are counted by their whole text: exact copies count once however many there are, texts
that differ anywhere are different documents.

Templates and leaves are counted with partial sums on two 64-bit hashes, texts join only by document. Null
texts stay null and empty ones empty; blank lines are never dropped; repeated rows lose the same lines;
columns of the input stay (names that end in __ are the operator's own); no row is dropped; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import SPACES, keep, let
from sparkloom.operators.graph import forget

FIELD = "<*>"
MIN_DOCS = 20
DEPTH = 3
FIXED_SHARE = 0.7


def _split(line: Column) -> Column:
    return F.split(line, r"[\x20\x09-\x0D]+")


def lines_of(df: DataFrame, text: str, key: str, depth: int) -> DataFrame:
    """A row for each line with a word: d, h (document), pos, leaf, line (hashes) and the masked line."""
    lines = F.split(F.col(text), "\n")
    docs = df.where(F.col(text).isNotNull()).select(F.col(key).alias("d"), F.xxhash64(F.col(text)).alias("h"), lines.alias("lines"))
    rows = docs.select("d", "h", F.posexplode("lines").alias("pos", "raw"))
    rows = rows.withColumn("raw", F.btrim("raw", F.lit(SPACES))).where("raw <> ''")
    masked = F.when(F.col("raw").rlike("[0-9]"), F.regexp_replace("raw", r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*", F.lit(FIELD))).otherwise(F.col("raw"))
    rows = rows.withColumn("masked", masked)
    n = F.size(_split(F.col("masked")))
    leaf = F.xxhash64(n, F.substring_index(F.regexp_replace("masked", r"[\x20\x09-\x0D]+", F.lit(" ")), " ", depth))
    return rows.select("d", "h", "pos", leaf.alias("leaf"), F.xxhash64("masked", F.lit(1)).alias("line"), "masked")


def recurring(lines: DataFrame, min_docs: int, fixed_share: float) -> DataFrame:
    """(leaf, line) of every line whose template recurs."""
    seen = keep(lines.select("leaf", "line", "h").distinct(), "line-docs")
    counted = seen.groupBy("leaf", "line").agg(F.count("*").alias("docs"))
    crowded = counted.groupBy("leaf").agg(F.sum("docs").alias("n"), F.count("*").alias("kinds")).where((F.col("n") >= min_docs) & (F.col("kinds") > 1)).select("leaf")
    crowded = keep(crowded, "crowded")  # its true size decides whether lines must move to meet it
    texts = keep(lines.join(crowded, "leaf", "left_semi").groupBy("leaf", "line").agg(F.min("masked").alias("masked")).join(counted, ["leaf", "line"]), "leaf-lines")
    words = texts.select("leaf", "line", "docs", F.posexplode(_split(F.col("masked"))).alias("at", "word"))
    # fixed by all lines of the leaf; rare: by those alone that do not recur by themselves
    rare = F.sum(F.when(F.col("docs") < min_docs, F.col("docs")).otherwise(0)) >= min_docs
    fixed = words.groupBy("leaf", "at", "word").agg(F.sum("docs").alias("n"), rare.alias("rare")).where((F.col("n") >= min_docs) & (F.col("word") != FIELD)).select("leaf", "at", "word", "n", "rare")
    place = F.struct("n", F.xxhash64("at", "word").alias("x"), "rare")
    parts = words.join(fixed, ["leaf", "at", "word"], "left").groupBy("leaf", "line", "docs").agg(F.array_sort(F.collect_list(F.when(F.col("rare").isNotNull(), place))).alias("has"), F.count("*").alias("size"))
    parts = parts.where(F.size("has") >= F.ceil(F.lit(fixed_share) * F.col("size")))
    # a line's templates, rarest word first: all its fixed words, and those that rare lines fix alone
    own = F.filter("has", lambda x: x["rare"])
    own = F.when((F.col("docs") < min_docs) & (F.size(own) >= F.ceil(F.lit(fixed_share) * F.col("size"))), own)
    has, own = F.transform("has", lambda x: x["x"]), F.transform(own, lambda x: x["x"])
    parts = keep(parts.select("leaf", "line", "docs", "size", has.alias("has"), own.alias("own"), F.xxhash64(has).alias("kind")), "leaf-parts")
    templates = parts.select("leaf", "size", F.explode(F.array_compact(F.array("has", "own"))).alias("template")).where(F.size("template") < F.col("size"))
    templates = templates.select("leaf", "template", F.xxhash64("template").alias("t"), F.col("template")[0].alias("x")).distinct()
    # a line has every template whose words it holds; they meet at the template's rarest word
    kinds = parts.groupBy("leaf", "kind").agg(F.first("has").alias("has"), F.max("docs").alias("most"))
    pairs = kinds.select("leaf", "kind", "has", "most", F.explode("has").alias("x")).join(templates, ["leaf", "x"]).where(F.size(F.array_except("template", "has")) == 0)
    pairs = keep(pairs.select("leaf", "t", "kind", "most"), "leaf-templates")
    sure = pairs.groupBy("leaf", "t").agg(F.max("most").alias("most"))
    open_ = pairs.join(sure.where(F.col("most") < min_docs).select("leaf", "t"), ["leaf", "t"], "left_semi")
    docs = open_.join(parts.select("leaf", "kind", "line"), ["leaf", "kind"]).join(seen, ["leaf", "line"]).groupBy("leaf", "t").agg(F.count_distinct("h").alias("docs"))
    grown = sure.where(F.col("most") >= min_docs).select("leaf", "t").unionByName(docs.where(F.col("docs") >= min_docs).select("leaf", "t"))
    found = pairs.join(grown, ["leaf", "t"], "left_semi").select("leaf", "kind").distinct()
    more = parts.where(F.col("docs") < min_docs).join(found, ["leaf", "kind"], "left_semi").select("leaf", "line")
    out = keep(counted.where(F.col("docs") >= min_docs).select("leaf", "line").unionByName(more), "templates")
    forget(seen, crowded, texts, parts, pairs)
    return out


def drop_recurring_lines(df: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, fixed_share: float = FIXED_SHARE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """df with the recurring lines taken out of the text, and n_lines_dropped (added to a column of that name, if df has it)."""
    lines = keep(lines_of(df, text, key, depth), "lines")
    out = recurring(lines, min_docs, fixed_share)
    # both sides are tables, so that a frequent line's side can be split (AQE)
    gone = lines.select("d", "h", "pos", "leaf", "line").join(out, ["leaf", "line"], "left_semi").groupBy("d", "h").agg(F.collect_set("pos").alias("gone__"))
    gone = keep(gone.withColumnRenamed("d", "d__").withColumnRenamed("h", "h__"), "gone")
    forget(lines, out)
    joined = df.join(gone, F.col(key).eqNullSafe(F.col("d__")) & (F.xxhash64(F.col(text)) == F.col("h__")), "left")
    left = let(F.split(F.col(text), "\n"), lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone__")), lambda i: F.get(x, i)))
    new = F.when(F.col("gone__").isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    before = F.coalesce(F.col("n_lines_dropped"), F.lit(0)) if "n_lines_dropped" in df.columns else F.lit(0)
    dropped = (before + F.coalesce(F.size("gone__"), F.lit(0))).cast("long")
    return joined.withColumn(text, new).withColumn("n_lines_dropped", dropped).select(*(c for c in df.columns if c != "n_lines_dropped"), "n_lines_dropped")
