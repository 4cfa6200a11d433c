"""A code of law made from the star schema: sections of six acts, their concordance, a schedule, cases, questions.

Parts are the sections of the old acts, suppliers those of the new ones, small orders without discount the edges
between them, customers the entries of the schedule, orders the reported cases. ``CODE`` is the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.refs import NEW_OF
from sparkloom.operators import concordance
from sparkloom.plans.base import EDGES, Tables

OLD, NEW = list(NEW_OF), list(NEW_OF.values())


def _act(names: list[str], key: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), (key % 3).cast("int"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def old_number(key: Column) -> Column:
    return _text(F.floor(key / 3) + 1, F.when(key % 7 == 0, "A").otherwise(""))


def old_sections(t: Tables) -> DataFrame:
    """act, section, title, chapter_no, chapter_title, text, source_url."""
    k, number = F.col("p_partkey"), old_number(F.col("p_partkey"))
    rule = F.when(k % 2 == 0, _text(" shall be punished with imprisonment of ", F.col("p_size"), " years, or with fine; and more")).otherwise(" is defined.")
    body = _text(number, ". ", F.col("p_name"), " of ", F.col("p_brand"), rule, F.repeat(_text(" And the ", F.col("p_type"), " part."), F.col("p_size")))
    return t.part.select(_act(OLD, k).alias("act"), number.alias("section"), F.when(k % 11 == 0, "").otherwise(F.initcap("p_name")).alias("title"), F.col("p_size").alias("chapter_no"), F.when(k % 4 > 0, F.col("p_type")).alias("chapter_title"), body.alias("text"), _text("https://example.org/old/", k).alias("source_url"))


def new_sections(t: Tables) -> DataFrame:
    """The same of the new acts: every supplier is a section of each of them."""
    k = F.col("s_suppkey")
    body = _text(k + 1, ". Whoever does ", F.col("s_name"), " shall be punished with fine of ", F.col("s_nationkey"), " rupees, and costs.")
    rows = t.supplier.select("*", F.explode(F.array(*map(F.lit, NEW))).alias("act"))
    return rows.select("act", _text(k + 1).alias("section"), F.when(k % 5 == 0, "").otherwise(F.col("s_name")).alias("title"), F.col("s_nationkey").alias("chapter_no"), F.lit("GENERAL RULES").alias("chapter_title"), body.alias("text"), _text("https://example.org/new/", k).alias("source_url"))


def fallback_titles(t: Tables) -> DataFrame:
    """act, section, title of a second source that knows some of the new sections."""
    named = t.supplier.where("s_suppkey % 2 = 0").join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return named.select(F.explode(F.array(*map(F.lit, NEW))).alias("act"), _text(F.col("s_suppkey") + 1).alias("section"), F.initcap(F.col("n_name")).alias("title"))


def titled(sections: DataFrame, fallback: DataFrame) -> DataFrame:
    """sections with the fallback's title where their own is empty ('' where neither has one)."""
    other = fallback.select("act", "section", F.col("title").alias("other"))
    return sections.join(other, ["act", "section"], "left").withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "other", F.lit(""))).drop("other")


def sections(t: Tables) -> DataFrame:
    return titled(new_sections(t), fallback_titles(t)).unionByName(old_sections(t))


def pairs(t: Tables) -> DataFrame:
    """old_act, old_section, new_act, new_section, row (order of the concordance)."""
    o, n = F.col("old"), F.col("new")
    return t.edges.select(_act(OLD, o).alias("old_act"), old_number(o).alias("old_section"), _act(NEW, o).alias("new_act"), _text(n + 1).alias("new_section"), (o * 1000 + n).alias("row"))


def mapping(t: Tables) -> DataFrame:
    """The typed concordance with titles; removed and new provisions have a null side."""
    return t.once("mapping", lambda: concordance.typed(pairs(t), old_sections(t), titled(new_sections(t), fallback_titles(t))))


def schedule(t: Tables) -> DataFrame:
    """section_ref, offence_description, punishment, cognizable, bailable, triable_by, part, row."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return t.customer.select(
        _text(k % 100 + 1, F.when(k % 13 == 0, "A").otherwise(""), "(", F.floor(k / 100) + 1, ")").alias("section_ref"),
        _text("Offence of ", F.col("c_name"), ".").alias("offence_description"),
        _text("Fine of ", n, " rupees.").alias("punishment"),
        F.when(k % 100 % 2 == 0, "Cognizable").when(n % 2 == 0, "Non-cognizable").otherwise("Cognizable").alias("cognizable"),
        F.when(k % 100 % 3 == 0, "Non-bailable").when(n % 3 == 0, "Bailable").otherwise("Non-bailable").alias("bailable"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Court of Session").when(F.col("c_mktsegment") == "MACHINERY", "Magistrate of the first class").otherwise("Any Magistrate").alias("triable_by"),
        F.when(k % 50 == 7, "II").otherwise("I").alias("part"),
        k.alias("row"),
    )


def cases(t: Tables) -> DataFrame:
    """One row a topic and case: row, topic, case_name, court, year, old_act, old_sections, holding_summary, source_url."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    court = F.when(F.col("o_orderstatus") == "O", "Supreme Court").when(F.col("o_orderstatus") == "F", "High Court").otherwise("Sessions Court")
    return t.orders.select(k.alias("row"), F.substring("o_orderpriority", 3, 20).alias("topic"), _text("State v. Customer ", c).alias("case_name"), court.alias("court"), F.year("o_orderdate").alias("year"), _act(OLD, c).alias("old_act"), F.array(_text(c % 90 + 1), _text(k % 50 + 1)).alias("old_sections"), _text("The price of ", F.col("o_totalprice").cast("long"), " stands.").alias("holding_summary"), _text("https://example.org/doc/", c, "/").alias("source_url"))


def _list(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_NUMBER = "({k} // 3 + 1)::varchar || case when {k} % 7 = 0 then 'A' else '' end"
CODE = f"""{EDGES},
old_s as (select ({_list(OLD)})[p_partkey % 3 + 1] act, {_NUMBER.format(k='p_partkey')} section, case when p_partkey % 11 = 0 then '' else array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') end title, p_size chapter_no, case when p_partkey % 4 > 0 then p_type end chapter_title,
  {_NUMBER.format(k='p_partkey')} || '. ' || p_name || ' of ' || p_brand || case when p_partkey % 2 = 0 then ' shall be punished with imprisonment of ' || p_size || ' years, or with fine; and more' else ' is defined.' end || repeat(' And the ' || p_type || ' part.', p_size) as text, 'https://example.org/old/' || p_partkey source_url from part),
acts as (select unnest({_list(NEW)}) act),
fallback as (select act, (s_suppkey + 1)::varchar section, array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') title from supplier join nation on s_nationkey = n_nationkey, acts where s_suppkey % 2 = 0),
new_s as (select a.act, (s_suppkey + 1)::varchar section, coalesce(nullif(case when s_suppkey % 5 = 0 then '' else s_name end, ''), f.title, '') title, s_nationkey chapter_no, 'GENERAL RULES' chapter_title,
  (s_suppkey + 1) || '. Whoever does ' || s_name || ' shall be punished with fine of ' || s_nationkey || ' rupees, and costs.' as text, 'https://example.org/new/' || s_suppkey source_url
  from supplier s cross join acts a left join fallback f on f.act = a.act and f.section = (s_suppkey + 1)::varchar),
all_s as (select * from new_s union all select * from old_s),
pairs as (select ({_list(OLD)})[old % 3 + 1] old_act, {_NUMBER.format(k='old')} old_section, ({_list(NEW)})[old % 3 + 1] new_act, (new + 1)::varchar new_section, old * 1000 + new as rid from e),
mapping as (select p.old_act, p.old_section, o.title old_title, p.new_act, p.new_section, n.title new_title,
  case when count(*) over (partition by p.old_act, p.old_section) > 1 then 'split' when count(*) over (partition by p.new_act, p.new_section) > 1 then 'merged' else 'direct' end mapping_type, rid
  from pairs p join old_s o on o.act = p.old_act and o.section = p.old_section join new_s n on n.act = p.new_act and n.section = p.new_section
  union all select act, section, title, null, null, null, 'removed', null from old_s where (act, section) not in (select (old_act, old_section) from pairs)
  union all select null, null, null, act, section, title, 'new_provision', null from new_s where (act, section) not in (select (new_act, new_section) from pairs)),
schedule as (select (c_custkey % 100 + 1) || case when c_custkey % 13 = 0 then 'A' else '' end || '(' || (c_custkey // 100 + 1) || ')' section_ref, 'Offence of ' || c_name || '.' offence_description, 'Fine of ' || c_nationkey || ' rupees.' punishment,
  case when c_custkey % 100 % 2 = 0 or c_nationkey % 2 = 1 then 'Cognizable' else 'Non-cognizable' end cognizable, case when c_custkey % 100 % 3 = 0 or c_nationkey % 3 > 0 then 'Non-bailable' else 'Bailable' end bailable,
  case c_mktsegment when 'BUILDING' then 'Court of Session' when 'MACHINERY' then 'Magistrate of the first class' else 'Any Magistrate' end triable_by, case when c_custkey % 50 = 7 then 'II' else 'I' end part, c_custkey rid from customer),
cases as (select o_orderkey rid, substr(o_orderpriority, 3, 20) topic, 'State v. Customer ' || o_custkey case_name, case o_orderstatus when 'O' then 'Supreme Court' when 'F' then 'High Court' else 'Sessions Court' end court, year(o_orderdate) as year,
  ({_list(OLD)})[o_custkey % 3 + 1] old_act, [(o_custkey % 90 + 1)::varchar, (o_orderkey % 50 + 1)::varchar] old_sections, 'The price of ' || floor(o_totalprice)::bigint || ' stands.' holding_summary, 'https://example.org/doc/' || o_custkey || '/' source_url from orders)"""
