"""Positions, gaps, nearest rows, percentiles, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import layout, nearest
from sparkloom.plans.base import Tables, register
from sparkloom.streaming import questions


@register(
    """with s as (select event_id, user_id, ts, case when epoch_us(ts) - lag(epoch_us(ts)) over w <= 86400000000 then 0 else 1 end n from events window w as (partition by user_id order by ts, event_id))
select event_id, user_id, sum(n) over (partition by user_id order by ts, event_id)::bigint as block from s"""
)
def gap_islands(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return layout.gap_islands(e, "user_id", "us", "event_id", 86_400_000_000).select("event_id", "user_id", F.col("block").cast("long").alias("block"))


@register("select event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as signup_id from events")
def carry_forward(t: Tables) -> DataFrame:
    e = t.events.withColumn("s", F.when(F.col("event_type") == "signup", F.col("event_id")))
    return layout.carry_forward(e, "user_id", "ts", "event_id", "s", "signup_id").select("event_id", "signup_id")


@register(
    """with recursive c as (select user_id, min(value) as first from events group by 1 union all select c.user_id, min(e.value) from c join events e on e.user_id = c.user_id and e.value - c.first > 2.2 group by c.user_id)
select c.user_id, c.first, count(*)::int as n from c join events e on e.user_id = c.user_id and e.value >= c.first and e.value - c.first <= 2.2 group by 1, 2"""
)
def anchored_clusters(t: Tables) -> DataFrame:
    return layout.anchored_clusters(t.events, "user_id", "value", 2.2)


@register(
    """with b as (select * from (values (0, 1000.0, 'a'), (1000, 50000, 'b'), (50000, 150000, 'c'), (150000, 1e12, 'd')) v(lo, hi, band))
select band, count(*) as n, round(sum(o_totalprice), 2) as total from orders join b on o_totalprice >= lo and o_totalprice < hi group by 1"""
)
def interval_bucket(t: Tables) -> DataFrame:
    """A handful of fixed bands: a range join with the four-row side broadcast."""
    bands = t.spark.createDataFrame([(0.0, 1000.0, "a"), (1000.0, 50000.0, "b"), (50000.0, 150000.0, "c"), (150000.0, 1e12, "d")], "lo double, hi double, band string")
    p = F.col("o_totalprice")
    return t.orders.join(F.broadcast(bands), (p >= F.col("lo")) & (p < F.col("hi"))).groupBy("band").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("select p.event_id, v.event_id as view_id from (select * from events where event_type = 'purchase') p asof left join (select user_id, ts, max(event_id) event_id from events where event_type = 'view' group by 1, 2) v on p.user_id = v.user_id and p.ts >= v.ts")
def nearest_asof(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", "ts", "event_type")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    found = layout.as_of(e.where("event_type = 'purchase'").drop("event_type"), views, "user_id", "ts", "view_id")
    return found.select("event_id", F.col("last").alias("view_id"))


@register(
    """with l as (select lang, list_sort(list(n_chars)) x from documents group by 1)
select lang, x[1] as least, x[len(x) // 2 + 1] as middle, x[least(len(x), floor(len(x) * 0.95)::bigint + 1)] as p95, x[len(x)] as most from l"""
)
def percentiles_exact(t: Tables) -> DataFrame:
    """Order statistics from counts of equal values: the ranking sees one row a distinct length, not a row a document."""
    counts = t.documents.groupBy("lang", "n_chars").agg(F.count("*").alias("c"))
    w = Window.partitionBy("lang")
    ranked = counts.withColumn("upto", F.sum("c").over(w.orderBy("n_chars").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("n_chars")))
    return ranked.groupBy("lang").agg(F.min("n_chars").alias("least"), at(F.floor(F.col("n") / 2)).alias("middle"), at(F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(0.95)))).alias("p95"), F.max("n_chars").alias("most"))


@register("select event_type, round(avg(value), 6) as mean, count(*) as n, count(distinct user_id) as users from events group by 1")
def counts_by_kind(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@register("select lang, doc_id from documents qualify row_number() over (partition by lang order by doc_id) <= 2")
def first_per_kind(t: Tables) -> DataFrame:
    return t.documents.select("lang", "doc_id").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).where("r <= 2").drop("r")


@register("select n_parts as size, count(*) as n from (select l_orderkey, count(*) n_parts from lineitem group by 1) group by 1")
def size_histogram(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


@register("select user_id, get_n as n from (select user_id, sum(cast(json_extract_string(props, '$.k') as bigint)) get_n from events group by 1)")
def json_fields(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.sum(F.get_json_object("props", "$.k").try_cast("long")).alias("n"))


@register("select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_windowed_counts(t: Tables) -> DataFrame:
    schema = t.events.schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(t._folder + "/events.parquet*")
    return questions.run_once(t.spark, questions.windowed_counts(stream), ["start", "event_type"])


_NEAR = """l as (select event_id l, user_id u, epoch_us(ts) p from events where event_type = 'purchase'), r as (select event_id r, user_id u, epoch_us(ts) p from events where event_type = 'view'),
pairs as (select u, l, r, abs(l.p - r.p) d from l join r using (u) where abs(l.p - r.p) <= 10800000000)"""


def _sides(t: Tables) -> list[DataFrame]:
    rows = t.events.select("event_id", F.col("user_id").alias("u"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    return [rows.where(F.col("event_type") == kind).select("u", "at", F.col("event_id").alias(name)) for kind, name in (("purchase", "event_id"), ("view", "view_id"))]


_BOUND = 10_800_000_000


def _seconds(found: DataFrame) -> DataFrame:
    return found.select("event_id", "view_id", F.round(F.col("distance") / 1_000_000, 3).alias("seconds"))


@register(f"with {_NEAR} select l.l as event_id, b.r as view_id, round(b.d / 1000000.0, 3) as seconds from l left join (select l, arg_min(r, (d, r)) r, min(d) d from pairs group by 1) b using (l)")
def nearest_within(t: Tables) -> DataFrame:
    """The view nearest to each purchase of a user, before or after it, three hours away at most."""
    return _seconds(nearest.within(*_sides(t), ["u"], "at", "event_id", "view_id", _BOUND))


@register(
    f"""with recursive {_NEAR}, n as (select *, row_number() over (partition by u order by d, l, r) i from pairs),
s as (select distinct u, 0::bigint i, []::bigint[] ls, []::bigint[] rs, null::bigint l, null::bigint r, null::bigint d from pairs
  union all select s.u, n.i, case when list_contains(ls, n.l) or list_contains(rs, n.r) then ls else list_append(ls, n.l) end, case when list_contains(ls, n.l) or list_contains(rs, n.r) then rs else list_append(rs, n.r) end,
  case when not (list_contains(ls, n.l) or list_contains(rs, n.r)) then n.l end, n.r, n.d from s join n on n.u = s.u and n.i = s.i + 1)
select l as event_id, r as view_id, round(d / 1000000.0, 3) as seconds from s where l is not null"""
)
def nearest_once(t: Tables) -> DataFrame:
    """The same with every view used once, the closest pairs first."""
    return _seconds(nearest.once(*_sides(t), ["u"], "at", "event_id", "view_id", _BOUND))
