"""Pages, tables and replies rendered from the code, parsed again; the SQL gives the rows that went in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import parsing
from sparkloom.operators.qa import say
from sparkloom.plans import code
from sparkloom.plans.base import Tables, register
from sparkloom.plans.code import CODE

ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"]


def _joined(df: DataFrame, keys: list[str], order: str, piece) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct(order, piece.alias("s"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["s"]), "\n").alias("html"))


def _chapter_pages(t: Tables) -> DataFrame:
    """Sections of ten chapters; every tenth section carries the anchor of the one before it, and shows its own number."""
    s = t.supplier.withColumns({"n": F.col("s_suppkey") + 1, "chapter_no": F.floor(F.col("s_suppkey") / 10).cast("int")})
    part = {"anchor": F.when(F.col("n") % 10 == 0, F.col("n") - 1).otherwise(F.col("n")), "n": F.col("n"), "name": F.col("s_name"), "x": F.col("s_nationkey"), "mark": F.when(F.col("n") % 4 == 0, F.lit(":-")).otherwise("&ndash;")}
    link = F.when(F.col("n") % 3 == 0, say("<span class=\"caps\">IPC</span> Section <a href=\"/old/ipc/section/{x}/\">{x}</a>", **part)).otherwise("")
    html = say("<h2 class=\"subClose\">Section <a name=\"s{anchor}\">{n}</a> {mark} Rule on <b>{name}</b>.</h2><div class='sectxt'>{link}<p>Whoever holds {x} &lt; {n}</p><script>no()</script></div>", link=link, **part)
    pages = _joined(s.withColumn("piece", html), ["chapter_no"], "n", F.col("piece"))
    return pages.select(F.lit("BNS").alias("act"), "chapter_no", F.concat(F.lit("<h1>Chapter IV</h1><h2>Of things &amp; men</h2>"), "html").alias("html"))


@register(
    """select 'BNS' as act, (s_suppkey + 1)::varchar as section, 'Rule on ' || s_name as title, (s_suppkey // 10)::int as chapter_no, 'Of things & men' as chapter_title,
case when (s_suppkey + 1) % 3 = 0 then 'IPC Section ' || s_nationkey else '' end || 'Whoever holds ' || s_nationkey || ' < ' || (s_suppkey + 1) as text, case when (s_suppkey + 1) % 3 = 0 then 'IPC' end as xref_act, case when (s_suppkey + 1) % 3 = 0 then s_nationkey::varchar end as xref_section from supplier"""
)
def anchor_sections(t: Tables) -> DataFrame:
    return parsing.anchor_sections(_chapter_pages(t))


@register("select p_partkey as k, (p_partkey + 1)::varchar as section, trim(p_name) as title, case when p_partkey % 4 = 3 then '' else p_brand || ' text' end as text from part where p_partkey % 6 < 5")
def json_sections(t: Tables) -> DataFrame:
    """The same fields under several names; objects without a section go."""
    k = F.col("p_partkey")
    n = (k + 1).cast("string")
    kinds = F.when(k % 6 == 5, F.to_json(F.struct(F.lit("").alias("Section"), F.col("p_name").alias("title")))).when(k % 2 == 0, F.to_json(F.struct(n.alias("Section"), F.col("p_name").alias("section_title"), F.concat("p_brand", F.lit("  text")).alias("section_desc"))))
    other = F.to_json(F.struct(F.lit("").alias("Section"), n.alias("section"), F.col("p_name").alias("title"), F.when(k % 4 == 3, F.lit(None).cast("string")).otherwise(F.concat("p_brand", F.lit(" text"))).alias("description")))
    raw = t.part.select(k.alias("k"), F.coalesce(kinds, other).alias("json"))
    return parsing.aliased(raw, {"section": ["Section", "section"], "title": ["section_title", "title"], "text": ["section_desc", "description"]})


@register("select o_custkey as q, (l_partkey)::varchar as doc_id, 'Case <' || min_by(l_linenumber, l_orderkey * 10 + l_linenumber) || '>' as title from lineitem join orders on l_orderkey = o_orderkey group by 1, 2")
def search_results(t: Tables) -> DataFrame:
    """Result pages of each customer; a document listed again keeps its first place's title."""
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    html = say("<article class=\"result\"><a class=\"x\" href=\"/docfragment/{d}/?q=1\">Case <b>&lt;{n}&gt;</b></a></article>", d=F.col("l_partkey"), n=F.col("l_linenumber"))
    pages = _joined(rows.withColumn("piece", html), ["o_custkey"], "o", F.col("piece")).withColumnRenamed("o_custkey", "q")
    return parsing.search_results(pages, "q").withColumn("title", F.replace("title", F.lit("< "), F.lit("<")))


@register("select c_custkey as k, 'https://example.org/search/?formInput=' || replace(replace(replace(c_mktsegment || ' & ' || c_custkey || ' doctypes: supremecourt', '&', '%26'), ' ', '%20'), ':', '%3A') as url from customer")
def search_urls(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("k"), parsing.search_url("https://example.org", F.concat("c_mktsegment", F.lit(" & "), F.col("c_custkey").cast("string")), F.lit("supremecourt")).alias("url"))


@register(
    f"""select o_orderkey as k, 'State v. ' || o_custkey || ' & Ors' as case_name, 'High Court of ' || o_orderstatus as court, 'Justice ' || o_custkey as bench, year(o_orderdate)::int as year, array_to_string(list_sort(list_distinct(['BNS ' || (o_custkey % 90), 'IPC ' || (o_custkey % 90 + 1) || 'A'])), ',') as cited
from orders"""
)
def judgment_fields(t: Tables) -> DataFrame:
    part = {"c": F.col("o_custkey"), "s": F.col("o_orderstatus"), "d": F.date_format("o_orderdate", "d MMMM, yyyy"), "a": F.col("o_custkey") % 90, "b": F.col("o_custkey") % 90 + 1}
    html = say("<h2 class=\"doc_title\">State <i>v.</i> {c} &amp; Ors on {d}</h2><h3 class=\"docsource_main\">High Court of {s}</h3><h3 class=\"doc_bench\">Bench: Justice {c}</h3><div class=\"judgments\"><p>Under section {a} of the BNS</p> and sections {b}A (2) Indian Penal Code. Page 3 of 9</div>", **part)
    rows = parsing.judgment(t.orders.select(F.col("o_orderkey").alias("k"), html.alias("html")))
    return rows.select("k", "case_name", "court", "bench", "year", F.array_join(parsing.cited_sections(F.col("text")), ",").alias("cited"))



@register(
    """with d as (select o_custkey k, list(o_orderkey order by o_orderkey) o from orders group by 1), s as (select k, unnest(o) o, unnest(range(len(o))) as pos, len(o) n from d),
u as (select *, 'In this case we hold that the appeal on section ' || (o % 7) || ' must be dismissed with costs for order number ' || o || '.' s, 'Xx ' || o || '.' as noise from s),
q as (select k, o, pos, s, sum(length(s) + length(noise) + 2) over (partition by k order by pos rows between unbounded preceding and 1 preceding) before, sum(length(s) + length(noise) + 2) over (partition by k) - 1 as total from u),
r as (select *, coalesce(before, 0) b, total // 3 as cut from q), t as (select * from r where b >= cut),
f as (select *, row_number() over (partition by k order by (case when o % 7 = 3 then 3 else 1 end) desc, pos) x from t),
j as (select k, string_agg(s, ' ' order by pos) t from f where x <= 3 group by 1)
select k, case when length(t) > 150 then regexp_replace(t[1:150], ' [^ ]*$', '') || ' ...' else t end as summary from j"""
)
def holding_summaries(t: Tables) -> DataFrame:
    """Texts of sentences that decide and of noise; the sentence that the last two thirds cut into counts only if whole."""
    o = F.col("o_orderkey")
    s = say("In this case we hold that the appeal on section {x} must be dismissed with costs for order number {o}. Xx {o}.", x=o % 7, o=o)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", s.alias("s")))), lambda x: x["s"])
    docs = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.array_join(listed, " ").alias("t"))
    # a sentence that the cut goes through has lost its opening words
    return parsing.holding_summary(docs, "k", "t", F.array(F.lit("3")), most=150, markers=r"^In this case we hold")


@register(
    """select p_partkey as k, 'row' as kind, (p_partkey + 1)::varchar as new_section, case when p_partkey % 5 = 0 then '' else (p_size) || ',' || (p_size + 1) || 'A' end as olds, case when p_partkey % 3 = 0 then '' else p_type end as summary from part where p_partkey % 7 <> 6
union all select p_partkey, 'rejected', null, null, null from part where p_partkey % 7 = 6 and p_partkey % 2 = 0"""
)
def table_rows(t: Tables) -> DataFrame:
    """Cells of concordance tables: blanks dropped, a missing summary padded, headings passed over, the rest rejected."""
    k, size = F.col("p_partkey"), F.col("p_size")
    old = F.when(k % 5 == 0, "New provision").otherwise(say("{a}(1), {b} A & {a}", a=size, b=size + 1))
    good = F.array(say("{n}(2)", n=k + 1), F.lit(None).cast("string"), old, F.lit(" "), F.col("p_name"), F.when(k % 3 > 0, F.col("p_type")))
    bad = F.when(k % 2 == 0, F.array(say("{n}", n=k + 1), F.lit("subject"), F.lit("summary only"), F.lit("x"))).otherwise(F.array(F.lit("BNS"), F.lit("IPC"), F.lit(""), F.lit("Subject")))
    kept, rejected = parsing.table_rows(t.part.select(k.alias("k"), F.when(k % 7 != 6, good).otherwise(bad).alias("cells")), "cells", ["new", "old", "subject", "summary"])
    rows = kept.select("k", F.lit("row").alias("kind"), "new_section", F.array_join("old_sections", ",").alias("olds"), "summary")
    return rows.unionByName(rejected.select("k", F.lit("rejected").alias("kind")), allowMissingColumns=True)


_THEIRS = "case when c_custkey % 100 % 2 = 0 then 'cognizable' else 'non-cognizable' end"


@register(
    f"""with {CODE}, p as (select regexp_extract(section_ref, '^([0-9]+[A-Z]?)', 1) section, * from schedule where part = 'I'),
u as (select section, array_to_string(list_sort(list(distinct cognizable)), '; ') c, array_to_string(list_sort(list(distinct bailable)), '; ') b, array_to_string(list_sort(list(distinct triable_by)), '; ') t from p group by 1),
o as (select s_suppkey + 1 n, (s_suppkey + 1)::varchar section, case when s_suppkey % 2 = 0 then 'non-cognizable' else 'cognizable' end c, case s_suppkey % 3 when 0 then 'bailable' when 1 then 'non-bailable' else '' end b, case s_suppkey % 4 when 0 then 'session' when 1 then 'first class' when 2 then 'second class' else '' end t from supplier),
x as (select u.section, 'cognizable' field, o.c theirs, u.c ours from u join o using (section) union all select u.section, 'bailable', o.b, u.b from u join o using (section) union all select u.section, 'triable_by', o.t, u.t from u join o using (section))
select * from x where theirs <> '' and not contains(lower(ours), theirs)"""
)
def class_check(t: Tables) -> DataFrame:
    """The schedule against words read from another source's markup."""
    k = F.col("s_suppkey")
    html = F.concat(F.lit("<li>It is <b>"), F.when(k % 2 == 0, "Non-cognizable").otherwise("Cognizable"), F.lit("</b></li><li>"), F.when(k % 3 == 0, "Bailable").when(k % 3 == 1, "Non-Bailable").otherwise(""), F.lit("</li><li>"), F.when(k % 4 == 0, "Court of Session or Magistrate of the first class").when(k % 4 == 1, "Magistrate of the First Class").when(k % 4 == 2, "Second class").otherwise(""), F.lit("</li>"))
    other = t.supplier.select((k + 1).cast("string").alias("section"), parsing.class_words(html).alias("x")).select("section", "x.*")
    first = code.schedule(t).where("part = 'I'").withColumn("section", F.regexp_extract("section_ref", r"^([0-9]+[A-Z]?)", 1))
    return parsing.class_check(first, other)


@register(
    """with l as (select o_custkey k, o_orderkey o, row_number() over (partition by o_custkey order by o_orderkey) i, count(*) over (partition by o_custkey) n from orders)
select k::varchar as source, i::int as n, 'Answer ' || o || ' and more of ' || o as answer, 'numbered' as how from l where k % 3 = 0
union all select k::varchar, (100 + i)::int, 'A long answer without a number ' || o, 'positional' from l where k % 3 = 1 and n % 2 = 0"""
)
def reply_parse(t: Tables) -> DataFrame:
    """Reply files: numbered with wrapped lines, by position, and of a wrong length (which give nothing)."""
    w = "row_number() over (partition by o_custkey order by o_orderkey)"
    rows = t.orders.selectExpr("o_custkey k", "o_orderkey o", f"{w} i", "count(*) over (partition by o_custkey) n")
    part = {"o": F.col("o"), "i": F.col("i")}
    lines = F.when(F.col("k") % 3 == 0, F.array(say("**{i}**) Answer {o}", **part), F.lit("  "), say("  and more of {o} ", **part))).otherwise(F.array(say("A long answer without a number {o}", **part), F.lit("short")))
    flat = rows.select(F.col("k").cast("string").alias("source"), "k", "n", "i", F.posexplode(lines).alias("j", "line")).withColumn("line_no", F.col("i") * 10 + F.col("j"))
    asked = F.when(F.col("k") % 3 == 1, F.when(F.col("n") % 2 == 0, F.col("n")).otherwise(F.col("n") + 1)).otherwise(F.lit(0))
    return parsing.replies(flat, "source", F.lit(101), asked)
