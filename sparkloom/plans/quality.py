"""Validation as data: one row a check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import concordance, overlap
from sparkloom.operators.ranks import global_rank
from sparkloom.plans.base import Tables, register


def checks(df: DataFrame, tests: dict[str, tuple[str, Column]]) -> DataFrame:
    """check, level (FAIL, WARN or OK), n_bad: all tests of a table in one pass."""
    counts = df.agg(*(F.count_if(bad).alias(name) for name, (_, bad) in tests.items()))
    rows = F.array(*(F.struct(F.lit(name).alias("check"), F.when(F.col(name) == 0, "OK").otherwise(level).alias("level"), F.col(name).alias("n_bad")) for name, (level, _) in tests.items()))
    return counts.select(F.inline(rows))


def gate(found: DataFrame) -> DataFrame:
    """found, or an error if any check failed."""
    if bad := [r.check for r in found.where("level = 'FAIL'").select("check").collect()]:
        raise ValueError(f"failed checks: {', '.join(bad)}")
    return found


def _sql(table: str, tests: dict[str, tuple[str, str]]) -> str:
    return " union all ".join(f"select '{name}' as \"check\", case when count_if({bad}) = 0 then 'OK' else '{level}' end as level, count_if({bad}) as n_bad from {table}" for name, (level, bad) in tests.items())


_DOCS = {"empty_text": ("FAIL", "trim(text) = ''"), "short_text": ("WARN", "length(text) < 80"), "long_text": ("WARN", "length(text) > 20000"), "no_source": ("FAIL", "source is null"), "wrong_length": ("FAIL", "n_chars <> length(text)")}
_ORDERS = {"no_customer": ("FAIL", "o_custkey is null"), "bad_status": ("FAIL", "o_orderstatus not in ('O', 'F', 'P')"), "no_price": ("WARN", "o_totalprice <= 0")}
_TURNS = {"empty_turn": ("FAIL", "trim(text) = ''"), "bad_role": ("FAIL", "role not in ('user', 'assistant', 'system')"), "negative_turn": ("FAIL", "turn < 0")}
_PAGES = {"no_url": ("FAIL", "url is null"), "no_article": ("WARN", "html not like '%<article>%'"), "no_title": ("WARN", "html not like '%<title>%'")}


def _run(df: DataFrame, tests: dict[str, tuple[str, str]]) -> DataFrame:
    return checks(df, {name: (level, F.expr(bad)) for name, (level, bad) in tests.items()})


@register(_sql("documents", _DOCS))
def validate_documents(t: Tables) -> DataFrame:
    return _run(t.documents, _DOCS)


@register(_sql("orders", _ORDERS))
def validate_orders(t: Tables) -> DataFrame:
    return _run(t.orders, _ORDERS)


@register(_sql("conversations", _TURNS))
def validate_conversations(t: Tables) -> DataFrame:
    return _run(t.conversations, _TURNS)


@register(_sql("pages", _PAGES))
def validate_pages(t: Tables) -> DataFrame:
    return _run(t.pages, _PAGES)


@register("select 'orders_without_customer' as \"check\", count(*) as n_bad from orders where o_custkey not in (select c_custkey from customer) union all select 'lines_without_order', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders) union all select 'lines_without_part', count(*) from lineitem where l_partkey not in (select p_partkey from part)")
def referential_integrity(t: Tables) -> DataFrame:
    pairs = [("orders_without_customer", t.orders, "o_custkey", t.customer, "c_custkey"), ("lines_without_order", t.lineitem, "l_orderkey", t.orders, "o_orderkey"), ("lines_without_part", t.lineitem, "l_partkey", t.part, "p_partkey")]
    parts = [a.select(k).join(b.select(F.col(j).alias(k)), k, "left_anti").agg(F.lit(name).alias("check"), F.count("*").alias("n_bad")) for name, a, k, b, j in pairs]
    return reduce(DataFrame.unionByName, parts)


@register("with r as (select max(o_orderkey) m from orders), s as (select unnest(range(1, m + 1)) k from r) select k from s where k not in (select o_orderkey from orders)")
def completeness_range(t: Tables) -> DataFrame:
    """Numbers missing between 1 and the greatest; the sequence is made by range, in parallel."""
    most = t.orders.agg(F.max("o_orderkey")).first()[0] or 0
    return t.spark.range(1, most + 1).withColumnRenamed("id", "k").join(t.orders.select(F.col("o_orderkey").alias("k")), "k", "left_anti")


@register("select text_hash, n from (select md5(text) text_hash, count(*) n from documents group by 1) where n > 1")
def duplicates(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.md5(F.col("text").cast("binary")).alias("text_hash")).agg(F.count("*").alias("n")).where("n > 1")


_UNION = """with a as (select (p_partkey // 3 + 1)::varchar || case when p_partkey % 7 = 0 then 'A' else '' end k, 'one' s from part where p_partkey % 9 <> 0), b as (select (p_partkey // 3 + 1)::varchar || case when p_partkey % 7 = 0 then 'A' else '' end k, p_partkey % 8 = 0 as bare from part)"""


@register(f"{_UNION}, u as (select k, 'one' provenance from a group by 1 union all select k, 'two' from b where k not in (select k from a) and not bare group by 1) select k as section, provenance, row_number() over (order by regexp_extract(k, '^[0-9]+')::int, k) as place from u")
def prioritised_union(t: Tables) -> DataFrame:
    """The first source's keys, then those that it lacks from the second where that has a text, in natural order."""
    k = F.col("p_partkey")
    number = F.concat((F.floor(k / 3) + 1).cast("string"), F.when(k % 7 == 0, "A").otherwise("")).alias("section")
    first = t.part.where("p_partkey % 9 <> 0").select(number, F.col("p_name").alias("text"))
    second = t.part.select(number, F.when(k % 8 == 0, " ").otherwise(F.col("p_name")).alias("text"))
    rows = concordance.prioritised(first, second, "section", "text", "one", "two").select("section", "provenance").distinct()
    n = F.regexp_extract("section", "^([0-9]+)", 1).cast("int")
    return global_rank(rows.withColumn("n", n), ["n", "section"], "place").drop("n")


@register(f"{_UNION}, c as (select distinct k from b where not bare), d as (select distinct k from a) select count(*) filter (where c.k is not null and d.k is not null) as both, count(*) filter (where c.k is null) as only_first, count(*) filter (where d.k is null) as only_second, round(100.0 * count(*) filter (where c.k is not null and d.k is not null) / count(*), 6) as pct_of_union from d full join c on c.k = d.k")
def source_overlap(t: Tables) -> DataFrame:
    """How far two sources agree on their section numbers."""
    k = F.col("p_partkey")
    number = F.concat((F.floor(k / 3) + 1).cast("string"), F.when(k % 7 == 0, "A").otherwise("")).alias("k")
    a, b = t.part.where("p_partkey % 9 <> 0").select(number).distinct().withColumn("a", F.lit(1)), t.part.where("p_partkey % 8 <> 0").select(number).distinct().withColumn("b", F.lit(1))
    both = F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull())
    return a.join(b, "k", "full_outer").agg(both.alias("both"), F.count_if(F.col("b").isNull()).alias("only_first"), F.count_if(F.col("a").isNull()).alias("only_second"), F.round(100.0 * both / F.count("*"), 6).alias("pct_of_union"))


@register("select item_id, count(*) as n_docs from benchmark b join documents d on contains(d.text, b.text) group by 1")
def contamination_check(t: Tables) -> DataFrame:
    """In how many documents each benchmark item stands whole."""
    return overlap.contained(t.benchmark, "item_id", "text", t.documents, "doc_id", "text").groupBy("item_id").agg(F.count("*").alias("n_docs"))


@register("select 'both' as side, count(*) as n from (select c_nationkey from customer intersect select s_nationkey from supplier) union all select 'only_customers', count(*) from (select c_nationkey from customer except select s_nationkey from supplier) union all select 'either', count(*) from (select c_nationkey from customer union select s_nationkey from supplier)")
def set_operations(t: Tables) -> DataFrame:
    a, b = t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k"))
    sides = {"both": a.intersect(b), "only_customers": a.subtract(b), "either": a.union(b).distinct()}
    return reduce(DataFrame.unionByName, (x.agg(F.lit(name).alias("side"), F.count("*").alias("n")) for name, x in sides.items()))
