"""Words on pages: lines, the schedule without rules, acts with headings in the margin; the SQL gives what was printed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import layout
from sparkloom.operators.graph import cut
from sparkloom.operators.qa import say
from sparkloom.plans.base import Tables, register


def _word(x0: float, value, size: float = 10.0):
    return F.struct(F.lit(float(x0)).alias("x0"), (F.lit(float(x0)) + 5 * F.length(value)).alias("x1"), F.lit(size).alias("size"), value.alias("text"))


def _printed(t: Tables) -> DataFrame:
    """Two lines for each customer: doc, page, top and words; every fourth entry repeats no reference, every sixth has a
    word of the punishment in the next column."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    rows = t.customer.withColumn("i", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1)
    page, top = (F.floor(F.col("i") / 20) + 1).cast("int"), 60.0 + (F.col("i") % 20) * 24
    bare = (k % 4 == 0) & (F.col("i") % 20 > 0)
    ref = F.when(~bare, F.array(_word(50, say("{a}({b})", a=k % 90 + 1, b=k % 5 + 1))))
    cog, bail = F.when(k % 2 == 0, "Cognizable").otherwise("Non-cognizable"), F.when(k % 3 == 0, "Bailable").otherwise("Non-bailable")
    leak = F.when(k % 6 == 0, F.array(_word(290, F.lit("years")), _word(320, cog))).otherwise(F.array(_word(300, cog)))
    first = F.concat(F.coalesce(ref, F.array().cast(f"array<{layout.WORD}>")), F.array(_word(95, F.lit("Offence")), _word(140, F.lit("non-")), _word(195, F.lit("Fine")), _word(230, n.cast("string"))), leak, F.array(_word(390, bail), _word(470, F.lit("Court")), _word(500, F.lit("of")), _word(515, F.lit("Session."))))
    second = F.array(_word(95, F.lit("treatment")), _word(195, F.lit("rupees")))
    lines = F.array(F.struct(top.alias("top"), first.alias("w")), F.struct((top + 9.6).alias("top"), second.alias("w")))
    head = F.when(F.col("i") % 20 == 0, F.array(F.struct(F.lit(20.0).alias("top"), F.array(_word(200, F.lit("THE")), _word(220, F.lit("GAZETTE")), _word(260, F.lit("OF")), _word(280, F.lit("INDIA"))).alias("w"))))
    lines = F.concat(lines, F.coalesce(head, F.array().cast(f"array<struct<top:double,w:array<{layout.WORD}>>>")))
    return rows.select(n.alias("doc"), page.alias("page"), F.explode(lines).alias("l")).select("doc", "page", F.col("l.top").alias("y"), F.posexplode("l.w").alias("j", "w")).select("doc", "page", (F.col("y") + F.col("j") % 3 * 0.6).alias("top"), "w.x0", "w.x1", "w.size", "w.text")


_I = "r as (select *, row_number() over (partition by c_nationkey order by c_custkey) - 1 i from customer)"


@register(
    f"""with {_I}, l as (select c_nationkey as doc, (i // 20 + 1)::int as page, 60.0 + (i % 20) * 24 as top, case when c_custkey % 4 = 0 and i % 20 > 0 then '' else (c_custkey % 90 + 1) || '(' || (c_custkey % 5 + 1) || ') ' end || 'Offence non- Fine ' || c_nationkey || ' ' || case when c_custkey % 6 = 0 then 'years ' else '' end
|| case when c_custkey % 2 = 0 then 'Cognizable' else 'Non-cognizable' end || ' ' || case when c_custkey % 3 = 0 then 'Bailable' else 'Non-bailable' end || ' Court of Session.' as text from r
union all select c_nationkey, (i // 20 + 1)::int, 60.0 + (i % 20) * 24 + 9.6, 'treatment rupees' from r union all select c_nationkey, (i // 20 + 1)::int, 20.0, 'THE GAZETTE OF INDIA' from r where i % 20 = 0)
select doc, page, round(top, 3)::double as top, text from l"""
)
def page_lines(t: Tables) -> DataFrame:
    return layout.page_lines(_printed(t)).select("doc", "page", F.round("top", 3).alias("top"), "text")


@register(
    f"""with {_I} select c_nationkey as doc, last_value(case when c_custkey % 4 = 0 and i % 20 > 0 then null else (c_custkey % 90 + 1) || '(' || (c_custkey % 5 + 1) || ')' end ignore nulls) over (partition by c_nationkey order by i) as section_ref,
'Offence non-treatment' as offence_description, 'Fine ' || c_nationkey || ' rupees' || case when c_custkey % 6 = 0 then ' years' else '' end as punishment, case when c_custkey % 2 = 0 then 'Cognizable' else 'Non-cognizable' end as cognizable, case when c_custkey % 3 = 0 then 'Bailable' else 'Non-bailable' end as bailable, 'Court of Session' as triable_by from r"""
)
def schedule_parse(t: Tables) -> DataFrame:
    return layout.schedule_rows(layout.page_lines(_printed(t))).drop("entry")


def _whole_schedule(t: Tables) -> DataFrame:
    """The printed pages behind a page of other matter, with the schedule's title, and a page of its second part after them."""
    word = lambda page, top, x0, value: F.struct(page.alias("page"), F.lit(float(top)).alias("top"), _word(x0, F.lit(value) if isinstance(value, str) else value).alias("w"))
    first, last = F.lit(0), (F.floor(F.col("n") / 20) + 3).cast("int")
    n = F.col("c_nationkey").cast("string")
    matter = [word(first, 100, 50, "7(1)"), word(first, 100, 95, "of"), word(first, 100, 195, "another"), word(first, 100, 300, "table")]
    title = [word(F.lit(1), 30, x, v) for x, v in ((100, "THE"), (130, "FIRST"), (160, "SCHEDULE"))]
    head = [word(last, 40, x, v) for x, v in ((50, "II."), (80, "CLASSIFICATION"), (160, "OF"), (180, "OFFENCES"), (230, "AGAINST"), (270, "OTHER"), (300, "LAWS"))]
    names = [word(last, 60, x, v) for x, v in ((50, "Offence"), (321, "Cognizable"), (380, "or"), (401, "Bailable"), (440, "or"), (466, "By"), (480, "what"), (500, "court"))]
    one = [word(last, 90, x, v) for x, v in ((50, "If"), (70, "punishable"), (321, "Cognizable."), (401, "Non-bailable."), (466, "Court"), (500, "of"))] + [word(last, 100, 50, "with"), word(last, 100, 70, F.concat(F.lit("death-"), n)), word(last, 100, 466, "Session.")]
    two = [word(last, 120, 50, "Other"), word(last, 120, 80, "laws")]
    counts = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    rows = counts.select(F.col("c_nationkey").alias("doc"), F.explode(F.array(*matter, *title, *head, *names, *one, *two)).alias("x"))
    return _printed(t).unionByName(rows.select("doc", "x.page", "x.top", "x.w.x0", "x.w.x1", "x.w.size", "x.w.text"))


_PARTS = f"""{_I}, docs as (select distinct c_nationkey doc from customer)
select c_nationkey as doc, last_value(case when c_custkey % 4 = 0 and i % 20 > 0 then null else (c_custkey % 90 + 1) || '(' || (c_custkey % 5 + 1) || ')' end ignore nulls) over (partition by c_nationkey order by i) as section_ref,
'Offence non-treatment' as offence_description, case when c_custkey % 2 = 0 then 'Cognizable' else 'Non-cognizable' end as cognizable, case when c_custkey % 3 = 0 then 'Bailable' else 'Non-bailable' end as bailable, 'Court of Session' as triable_by, 'I' as part from r
union all select doc, '', 'If punishable with death-' || doc, 'Cognizable', 'Non-bailable', 'Court of Session', 'II' from docs union all select doc, '', 'Other laws', '', '', '', 'II' from docs"""


@register(f"with {_PARTS}")
def schedule_whole(t: Tables) -> DataFrame:
    """Both parts of the schedule, found between other matter."""
    lines = cut(layout.page_lines(_whole_schedule(t)))
    one = layout.schedule_part1(lines).drop("entry", "punishment").withColumn("part", F.lit("I"))
    two = layout.schedule_part2(lines).drop("entry").withColumns({"section_ref": F.lit(""), "part": F.lit("II")})
    return one.unionByName(two)


@register("select n_nationkey as k, 'OF ' || n_name || ', AND NON-' || n_regionkey || ' GOVERNMENT' as text from nation")
def smallcaps(t: Tables) -> DataFrame:
    """Titles whose words have a large first letter."""
    part = lambda x, value, size: F.struct(F.lit(float(x)).alias("x0"), F.lit(0.0).alias("x1"), F.lit(size).alias("size"), value.alias("text"))
    name = F.col("n_name")
    words = F.array(part(20, F.substring(name, 1, 1), 12.0), part(30, F.substring(name, 2, 99), 10.0), part(1, F.lit("O"), 12.0), part(2, F.lit("F"), 10.0), part(40, F.lit(","), 10.0), part(50, F.lit("AND"), 10.0), part(60, F.lit("NON-"), 10.0), part(70, F.col("n_regionkey").cast("string"), 10.0), part(80, F.lit("G"), 12.0), part(85, F.lit("OVERNMENT"), 10.0))
    return t.nation.select(F.col("n_nationkey").alias("k"), layout.smallcaps(words).alias("text"))


def _act_lines(t: Tables) -> DataFrame:
    """Three acts of as many sections as there are suppliers, five a page. Headings stand in two lines beside the section's
    first line; that of every seventh section is printed at the foot of the page before."""
    s = F.col("s_suppkey")
    page, top = (F.floor(s / 5) + 1).cast("int"), 100.0 + s % 5 * 60
    row = lambda band, y, value, at=page: F.struct(at.alias("page"), y.alias("top"), F.lit(band).alias("band"), value.alias("text"))
    late = (s % 35 == 0) & (s > 0)
    number = s + 1
    body = [row("body", top, say("{n}. Whoever holds {x}", n=number, x=F.col("s_name"))), row("body", top + 12, say("{n}. or more of it", n=number + 7)), row("body", top + 24, F.lit("shall pay."))]
    head = [row("margin", F.when(late, F.lit(700.0)).otherwise(top + 1), say("Title of", n=number), F.when(late, page - 1).otherwise(page)), row("margin", F.when(late, F.lit(709.0)).otherwise(top + 10), say("section {n}.", n=number), F.when(late, page - 1).otherwise(page))]
    chapter = F.when(s % 10 == 0, F.array(row("body", top - 30, F.when(s % 20 == 0, "CHAPTER IV").otherwise("CHAPTERIX")), row("margin", F.lit(20.0), F.lit("21 of 2000.")), row("body", F.lit(10.0), F.lit("THE GAZETTE OF INDIA EXTRAORDINARY"))))
    lines = F.concat(F.array(*body, *head), F.coalesce(chapter, F.array().cast("array<struct<page:int,top:double,band:string,text:string>>")))
    acts = F.explode(F.array(F.lit("BNS"), F.lit("BNSS"), F.lit("BSA")))
    rows = t.supplier.select(F.explode(lines).alias("l")).withColumn("doc", acts)
    last = t.supplier.agg((F.floor(F.max("s_suppkey") / 5) + 2).cast("int").alias("page")).select("page", F.lit(50.0).alias("top"), F.lit("body").alias("band"), F.explode(F.array(F.lit("THE FIRST SCHEDULE"), F.lit("1. not a section"))).alias("text")).withColumn("doc", acts)
    return rows.select("doc", "l.*").unionByName(last.withColumn("top", F.when(F.col("text").startswith("1"), 80.0).otherwise(F.col("top"))))


@register(
    """select act as doc, (s_suppkey + 1)::varchar as section, 'Title of section ' || (s_suppkey + 1) as title, case when s_suppkey // 10 % 2 = 0 then 4 else 9 end as chapter_no, (s_suppkey // 5 + 1)::int as page,
(s_suppkey + 1) || '. Whoever holds ' || s_name || ' ' || (s_suppkey + 8) || '. or more of it shall pay.' as text from supplier, (select unnest(['BNS', 'BNSS', 'BSA']) act)"""
)
def act_parse(t: Tables) -> DataFrame:
    return layout.act_sections(_act_lines(t))
