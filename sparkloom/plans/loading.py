"""What is fetched, written and read back: rules of hosts, files of every format, stages that go on where they stopped."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import ranks, stages
from sparkloom.operators.graph import drop, hash_split, shared_dir
from sparkloom.plans.base import Tables, register
from sparkloom.sources import files


def _folder(t: Tables, name: str) -> str:
    path = f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(drop, t.spark, path)
    return path


_URL = r"""u as (select page_id, url, regexp_extract(url, '^https?://([^/?#:]+)', 1) host, case when regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' then '/' else regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) end || case when contains(url, '?') then '?' || regexp_extract(url, '\?([^#]*)', 1) else '' end path from pages where url is not null)"""


@register(
    f"""with {_URL}, raw as (select host, substr(path, 1, 1) prefix, false allow from u where page_id % 3 = 0 union all select host, substr(path, 1, 4), page_id % 2 = 0 from u where page_id % 3 < 2
  union all select host, substr(path, 1, 4), true from u where page_id % 5 = 0 union all select host, path, page_id % 4 > 0 from u),
rules as (select distinct host, prefix, allow from raw), best as (select u.page_id, arg_max(allow, (length(prefix), allow::int)) allow from u join rules on rules.host = u.host and starts_with(u.path, rules.prefix) group by 1)
select u.page_id, u.url from u left join best using (page_id) where coalesce(allow, true)"""
)
def robots_allowed(t: Tables) -> DataFrame:
    """Pages that the robots file of their host lets in; the files are made of the pages' own paths."""
    host, path, query = (F.expr(f"try_parse_url(url, '{p}')") for p in ("HOST", "PATH", "QUERY"))
    whole = F.concat(F.when(F.coalesce(path, F.lit("")) == "", "/").otherwise(path), F.coalesce(F.concat(F.lit("?"), query), F.lit("")))
    pages = t.pages.where("url is not null").select("page_id", "url", host.alias("host"), whole.alias("path"))
    k = F.col("page_id")
    line = lambda allow, prefix: F.concat(F.when(allow, "Allow: ").otherwise("disallow : "), prefix, F.lit("  # a rule"))
    made = F.array(F.when(k % 3 == 0, line(F.lit(False), F.substring("path", 1, 1))), F.when(k % 3 < 2, line(k % 2 == 0, F.substring("path", 1, 4))), F.when(k % 5 == 0, line(F.lit(True), F.substring("path", 1, 4))), line(k % 4 > 0, F.col("path")))
    lines = F.array_sort(F.flatten(F.collect_list(F.array_compact(made))))
    robots = pages.groupBy("host").agg(F.concat(F.lit("# rules\nUser-agent: other\nDisallow: /\n\nUser-agent: first\nUSER-AGENT: *\nCrawl-delay: 2\nDisallow:\n"), F.array_join(lines, "\r\n"), F.lit("\nUser-agent: last\nAllow: /\n")).alias("body"))
    return files.allowed(pages.select("page_id", "url"), files.robots_rules(robots))


@register("select doc_id, text, lang, source, n_chars from documents")
def jsonl_round_trip(t: Tables) -> DataFrame:
    """Documents written as one JSON object a line and read by their schema."""
    path = _folder(t, "jsonl")
    files.write_jsonl(t.documents, path)
    return files.read_jsonl(t.spark, path, "doc_id long, text string, lang string, source string, n_chars long")


@register("select c_custkey::varchar as c_custkey, c_name, c_mktsegment, replace(text, chr(13), '') as text from customer join (select doc_id, coalesce(text, '') text from documents) on doc_id = c_custkey")
def csv_round_trip(t: Tables) -> DataFrame:
    """A table of strings, some with quotes and line ends, written as CSV and read back; a missing value is an empty one."""
    path = _folder(t, "csv")
    rows = t.customer.join(t.documents, F.col("doc_id") == F.col("c_custkey"))
    files.write_csv(rows.withColumn("text", F.regexp_replace("text", "\r", "")), ["c_custkey", "c_name", "c_mktsegment", "text"], path)
    return files.read_csv(t.spark, path, "c_custkey string, c_name string, c_mktsegment string, text string").na.fill("")


@register("select vec_id, label, round(embedding[1]::double, 6) as first_part, len(embedding)::int as width from embeddings")
def vectors_round_trip(t: Tables) -> DataFrame:
    """The vector index written, and read under its expected number of rows."""
    path = _folder(t, "vectors")
    n = files.counted(t.embeddings, lambda df: files.write_vectors(df, path, "vec_id", "embedding"))
    return files.read_vectors(t.spark, path, n).select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first_part"), F.size("embedding").alias("width"))


_SPLIT = "case when ('0x' || substr(md5('7' || doc_id), 1, 8))::bigint / 4294967296.0 < 0.85 then 'train' when ('0x' || substr(md5('7' || doc_id), 1, 8))::bigint / 4294967296.0 < 0.95 then 'val' else 'test' end"


@register(f"select split, row_number() over (order by split, doc_id) as row_id, doc_id, source, lang from (select *, {_SPLIT} split from documents)")
def index_files_round_trip(t: Tables) -> DataFrame:
    """Splits written as rows and index, aligned by the row number in both, and joined again."""
    path = _folder(t, "splits")
    files.write_index_files(hash_split(t.documents, "doc_id", "7"), path, ["doc_id", "text"], ["source", "lang"], "doc_id")
    rows, index = (t.spark.read.schema(s).json(f"{path}/{n}") for n, s in (("rows", "row_id long, doc_id long, split string"), ("index", "row_id long, source string, lang string, split string")))
    return rows.join(index, ["split", "row_id"]).select("split", "row_id", "doc_id", "source", "lang")


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.explode(F.split("text", "\n")).alias("line"))


def _long(lines: DataFrame, least: int) -> DataFrame:
    return lines.where(F.length("line") >= least)


def _by_source(lines: DataFrame) -> DataFrame:
    return lines.groupBy("source").agg(F.count("*").alias("n"))


@register(
    """with l as (select source, unnest(string_split(text, chr(10))) line from documents), k as (select * from l where length(line) >= 40)
select 'lines' as stage, (select count(*) from l) as rows union all select 'long', (select count(*) from k) union all select 'sources', (select count(distinct coalesce(source, '')) from k)"""
)
def stage_report(t: Tables) -> DataFrame:
    """Rows of the stages of a small pipeline; the second call finds their markers and runs none again."""
    path = _folder(t, "stages")
    steps = [("lines", _lines, {}), ("long", _long, {"least": 40}), ("sources", _by_source, {})]
    for _ in range(2):
        stages.run_stages(t.spark, t.documents, [f"{t._folder}/documents.parquet"], steps, path)
    return stages.report(t.spark, path, steps).select("stage", "rows")


@register(
    "with n as (select item_id, text, row_number() over (order by item_id) i, count(*) over () c from benchmark) select ((i - 1) // greatest(1, ceil(c / 4.0)::bigint))::bigint as batch, 'Answer each.' || chr(10) || string_agg(i || '. ' || text, chr(10) order by i) as prompt from n group by 1"
)
def prompt_files(t: Tables) -> DataFrame:
    """Prompts of numbered questions, written as one file a batch and read back."""
    path = _folder(t, "prompts")
    numbered = ranks.global_rank(t.benchmark, ["item_id"], "i")
    files.write_prompts(files.prompts(numbered, "i", "text", t.benchmark.count(), 4, "Answer each."), path)
    return files.read_prompts(t.spark, path)

