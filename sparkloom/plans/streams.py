"""Streams over the events and the questions; each is fed in parts and compared with SQL over the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import answers
from sparkloom.operators.graph import cut
from sparkloom.plans import answering, code
from sparkloom.plans.base import ORACLES, Tables, register
from sparkloom.streaming import fetching, questions, replay

#: Ends of the parts in which events arrive; every seventh event arrives two days late.
ENDS = ["2024-01-08", "2024-01-19"]
_ARRIVES = "ts + case when event_id % 7 = 0 then interval '2' day else interval '0' day end"
_PART = "case " + " ".join(f"when {_ARRIVES} < timestamp '{e} 00:00:00' then {i}" for i, e in enumerate(ENDS)) + f" else {len(ENDS)} end"


def _events(t: Tables) -> DataFrame:
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


def _parts(events: DataFrame) -> list[DataFrame]:
    dealt = events.withColumn("part", F.expr(_PART))
    return [dealt.where(F.col("part") == i).drop("part") for i in range(len(ENDS) + 1)]


_REQUESTS = "r as (select 'host' || user_id % 5 host, event_id id, date_trunc('hour', ts)::timestamp as arrives from events)"


@register(
    f"""with {_REQUESTS}, n as (select *, 1500000 * (row_number() over (partition by host order by arrives, id) - 1) i from r)
select host, id, make_timestamp(max(epoch_us(arrives) - i) over (partition by host order by arrives, id rows unbounded preceding) + i) as start from n"""
)
def fetch_starts(t: Tables) -> DataFrame:
    """When each request of a stream may start, 1.5 seconds apart at a host; requests come in hourly lists."""
    all_ = _events(t).select(F.concat(F.lit("host"), (F.col("user_id") % 5).cast("string")).alias("host"), F.col("event_id").alias("id"), F.date_trunc("hour", "ts").alias("at"))
    day = F.to_date("at")
    parts = [all_.where(day < ENDS[0]), all_.where((day >= ENDS[0]) & (day < ENDS[1])), all_.where(day >= ENDS[1])]
    before = t.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", fetching.PROVIDER)
    try:
        path = replay.replay(parts, fetching.starts, replay.once_a_batch)
    finally:
        t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return t.spark.read.schema("host string, id long, at timestamp, start timestamp").parquet(path).select("host", "id", "start")


@register(ORACLES["engine_answers"])
def stream_answers(t: Tables) -> DataFrame:
    """Questions that come as a stream, each batch answered against the code as it stands."""
    s = cut(code.sections(t))
    profile = cut(answers.profiles(code.mapping(t), s, code.schedule(t)))
    asked = answering.asked(t)
    first = F.xxhash64("qid") % 3 == 0
    path = replay.replay([asked.where(first), asked.where(~first)], lambda rows: rows, lambda folder: replay.once_a_batch(folder, lambda rows: answers.answer(rows, profile, s)))
    return t.spark.read.schema("qid string, branch string, answer string").parquet(path).select("qid", "branch", "answer")


def _on_time(t: Tables) -> str:
    return replay.replay(_parts(_events(t)), lambda rows: rows, lambda folder: replay.split_late(folder, "1 hour"))


_SPLIT = f"""p as (select *, {_PART} part from events), w as (select part, max(max(ts)) over (order by part rows between unbounded preceding and 1 preceding) - interval '1' hour mark from p group by part),
k as (select p.*, coalesce(ts < mark, false) late from p join w using (part))"""


@register(f"with {_SPLIT} select event_id, user_id, event_type from k where late")
def stream_late_rows(t: Tables) -> DataFrame:
    """Events that arrive after the watermark, kept beside the stream."""
    return t.spark.read.schema(_events(t).schema).parquet(f"{_on_time(t)}/late").select("event_id", "user_id", "event_type")


@register(
    f"""with {_SPLIT}, g as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval '8' hour then 0 else 1 end opens from k where not late),
s as (select *, sum(opens) over (partition by user_id order by ts, event_id) session from g)
select user_id, min(ts) as start, max(ts) + interval '8' hour as finish, count(*) as n, round(sum(value), 4) as total from s group by user_id, session"""
)
def stream_sessions(t: Tables) -> DataFrame:
    """Sessions of each user, closed by eight quiet hours, of the events that arrive on time."""
    kept = t.spark.read.schema(_events(t).schema).parquet(f"{_on_time(t)}/kept").drop("batch")
    path = replay.replay([kept, questions.closing(kept, "ts", "2 days")], lambda rows: questions.sessions(rows, "user_id", "8 hours"), replay.once_a_batch)
    return t.spark.read.schema("user_id long, start timestamp, finish timestamp, n long, total double").parquet(path).select("user_id", "start", "finish", "n", "total")


@register("select event_type, count(*) as n from events group by 1")
def stream_first_seen(t: Tables) -> DataFrame:
    """Events of which the last two days of a part are sent again with the next part, each counted once."""
    events = _events(t)
    parts = [events.where(F.col("ts") < ENDS[0]), events.where((F.col("ts") >= F.lit(ENDS[0]) - F.expr("interval 2 days")) & (F.col("ts") < ENDS[1])), events.where(F.col("ts") >= F.lit(ENDS[1]) - F.expr("interval 2 days"))]
    path = replay.replay(parts, lambda rows: questions.first_seen(rows, "event_id"), replay.once_a_batch)
    return t.spark.read.schema(events.schema).parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))
