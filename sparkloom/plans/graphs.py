"""Concordance, components, splits and dealing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import concordance, graph
from sparkloom.plans.base import EDGES, Tables, register

_TYPED = f"""{EDGES}, t as (select old, new, case when count(*) over (partition by old) > 1 then 'split' when count(*) over (partition by new) > 1 then 'merged' else 'direct' end mapping_type from e
union all select p_partkey, null, 'removed' from part where p_partkey not in (select old from e)
union all select null, s_suppkey, 'new_provision' from supplier where s_suppkey not in (select new from e))"""


@register(f"with {_TYPED} select * from t")
def mapping_classify(t: Tables) -> DataFrame:
    return concordance.classify(t.edges, t.old_all, t.new_all)


@register(f"with {_TYPED} select mapping_type, count(*) as n from t group by 1")
def mapping_stats(t: Tables) -> DataFrame:
    return mapping_classify(t).groupBy("mapping_type").agg(F.count("*").alias("n"))


def _join(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.array_join("refs", "|").alias("refs"), F.size("refs").cast("long").alias("n"))


@register(f"with {EDGES} select old, string_agg(new::varchar, '|' order by new) as refs, count(*) as n from e group by 1")
def adjacency_fwd(t: Tables) -> DataFrame:
    return _join(concordance.adjacency(t.edges, "old", "new"), "old")


@register(f"with {EDGES} select new, string_agg(old::varchar, '|' order by old) as refs, count(*) as n from e group by 1")
def adjacency_rev(t: Tables) -> DataFrame:
    return _join(concordance.adjacency(t.edges, "new", "old"), "new")


@register(
    """with a as (select l_partkey k, list_sort(list(distinct l_suppkey)) x from lineitem where l_quantity <= 5 group by 1),
b as (select l_partkey k, list_sort(list(distinct l_suppkey)) x from lineitem where l_discount = 0 group by 1)
select k as old, array_to_string(a.x, '|') as ours, array_to_string(b.x, '|') as theirs, case when a.x = b.x then 'equal' when list_has_any(a.x, b.x) then 'partial_overlap' else 'no_overlap' end as kind from a join b using (k)"""
)
def crosscheck_overlap(t: Tables) -> DataFrame:
    sides = [t.lineitem.where(c).select(F.col("l_partkey").alias("old"), F.col("l_suppkey").alias("new")) for c in ("l_quantity <= 5", "l_discount = 0")]
    return concordance.crosscheck(*sides, "old", "new").select("old", F.array_join("ours", "|").alias("ours"), F.array_join("theirs", "|").alias("theirs"), "kind")


@register(f"with {EDGES} select old, string_agg(new::varchar, '|' order by new) as refs from e where old in (select s_suppkey from supplier) and (old, old) not in (select (old, new) from e) group by 1")
def collision_pairs(t: Tables) -> DataFrame:
    return concordance.collisions(t.edges, t.old_all, t.new_all).select("old", F.array_join("refs", "|").alias("refs"))


_COMPONENTS = f"""{EDGES}, a as (select 'o' || old x, 'n' || new y from e union select 'n' || new, 'o' || old from e),
r as (select x node, x reach from a union select r.node, a.y from r join a on a.x = r.reach), g as (select node, min(reach) grp from r group by 1)"""


def _groups(t: Tables) -> DataFrame:
    return graph.components(t.edges.select(F.concat(F.lit("o"), "old").alias("a"), F.concat(F.lit("n"), "new").alias("b")), "a", "b")


@register(f"with recursive {_COMPONENTS} select * from g")
def components(t: Tables) -> DataFrame:
    return _groups(t)


@register(f"with recursive {_COMPONENTS} select * from g")
def components_by_stars(t: Tables) -> DataFrame:
    """The same by large and small stars, for graphs with hubs or long chains."""
    return graph.star_components(t.edges.select(F.concat(F.lit("o"), "old").alias("a"), F.concat(F.lit("n"), "new").alias("b")), "a", "b")


@register(f"with recursive {_COMPONENTS}, s as (select grp, count(*) n from g group by 1) select n as size, count(*) as groups from s group by 1")
def group_sizes(t: Tables) -> DataFrame:
    return _groups(t).groupBy("grp").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


_SHARE = "(('0x' || substr(md5('20240701' || {k}), 1, 8))::bigint / 4294967296.0)"
_SPLIT = "case when {s} < 0.85 then 'train' when {s} < 0.95 then 'val' else 'test' end"


def _split_sql(key: str) -> str:
    return _SPLIT.format(s=_SHARE.format(k=key))


@register(f"with recursive {_COMPONENTS} select node, grp, {_split_sql('grp')} as split from g")
def split_groups(t: Tables) -> DataFrame:
    return graph.hash_split(_groups(t), "grp", "20240701")


def _events_split(t: Tables) -> DataFrame:
    return graph.hash_split(t.events.select("event_id", "user_id", "event_type"), "user_id", "20240701")


@register(f"select event_type, split, count(*) as n from (select event_type, {_split_sql('user_id::varchar')} as split from events) group by 1, 2")
def split_crosstab(t: Tables) -> DataFrame:
    return _events_split(t).groupBy("event_type", "split").agg(F.count("*").alias("n"))


@register(f"with s as (select event_type, {_split_sql('event_id::varchar')} split, user_id from events) select user_id, count(distinct split) as n_splits from s group by 1 having count(distinct split) > 1")
def split_leakage(t: Tables) -> DataFrame:
    return graph.leaks(graph.hash_split(t.events, "event_id", "20240701"), "user_id")


_OFF = "case when {a} >= 1 and (100.0 * {x} / sum({x}) over () > 2 * {a} or 100.0 * {x} / sum({x}) over () < 0.5 * {a}) then true when {a} < 1 and {x} = 0 and train > 0 then true else false end"


@register(
    f"""with s as (select event_type || (event_id % 40 = 0)::int::varchar || (event_id % 700 = 0)::int::varchar kind, {_split_sql('user_id::varchar')} split from events), c as (select kind, count_if(split = 'train') train, count_if(split = 'val') val, count_if(split = 'test') test from s group by 1)
select kind, train, val, test, {_OFF.format(a='(100.0 * train / sum(train) over ())', x='val')} as val_off, {_OFF.format(a='(100.0 * train / sum(train) over ())', x='test')} as test_off from c"""
)
def split_balance(t: Tables) -> DataFrame:
    """Kinds whose share in a split is over twice or under half of that in train, or which a split lacks."""
    flag = lambda m: (F.col("event_id") % m == 0).cast("int").cast("string")
    return graph.balance(_events_split(t).withColumn("kind", F.concat("event_type", flag(40), flag(700))), "kind")


@register(
    """with r as (select doc_id, row_number() over (order by md5('s' || doc_id::varchar), doc_id) k, count(*) over () n from documents)
select doc_id, case when k <= floor(n * 0.7) then 'positive' when k <= floor(n * 0.7) + floor(n * 0.2) then 'distractor' else 'none' end as condition from r"""
)
def condition_deal(t: Tables) -> DataFrame:
    return graph.deal(t.documents.select("doc_id"), "doc_id", "s")


@register(
    """with r as (select lang, doc_id, row_number() over (partition by lang order by md5('q' || doc_id::varchar), doc_id) k from documents),
b as (select *, k <= 20 first from r), o as (select *, row_number() over (order by first desc, md5('q' || doc_id::varchar), doc_id) g from b)
select lang, doc_id from o where g <= 100"""
)
def quota_topup(t: Tables) -> DataFrame:
    """20 rows of each kind, then the best of the rest up to 100: both rankings are top-k by kind first."""
    h = F.md5(F.concat(F.lit("q"), F.col("doc_id").cast("string")))
    ranked = t.documents.select("lang", "doc_id", h.alias("h")).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id")))
    return ranked.where("k <= 100").orderBy(F.desc(F.col("k") <= 20), "h", "doc_id").limit(100).select("lang", "doc_id")


@register(f"with recursive {_COMPONENTS}, h as (select distinct grp from g where {_split_sql('grp')} = 'test') select node from g where grp not in (select grp from h)")
def held_out_block(t: Tables) -> DataFrame:
    split = graph.hash_split(_groups(t), "grp", "20240701")
    return split.join(split.where("split = 'test'").select("grp").distinct(), "grp", "left_anti").select("node")
