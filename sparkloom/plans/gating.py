"""The validation gate over the code, with faults put in so that the checks find something."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import gate, graph
from sparkloom.operators.graph import cut
from sparkloom.plans import code, hard
from sparkloom.plans.base import Tables, register
from sparkloom.plans.chunks import CORPUS, corpus
from sparkloom.plans.code import CODE
from sparkloom.plans.graphs import _split_sql
from sparkloom.plans.questions import DATASET, dataset

_LEVEL = """select "check", case when n = 0 then 'OK' else level end as level, n::bigint as n_bad from ({}) x("check", level, n)"""


def _counts(*tests: tuple[str, str, str]) -> str:
    return _LEVEL.format(" union all ".join(f"select '{name}', '{level}', ({sql})" for name, level, sql in tests))


_FAULTY = "fs as (select act, section, title, case when section::int % 23 = 0 then 'short' else text end as text from new_s where section::int % 17 <> 0 union all select act, section, title, text from new_s where section::int % 19 = 0), ex as (select unnest(['BNS', 'BNSS', 'BSA']) act, (select count(*) from supplier) n)"


def _faulty(t: Tables) -> DataFrame:
    n = F.col("section").cast("int")
    s = code.titled(code.new_sections(t), code.fallback_titles(t))
    return s.where(n % 17 != 0).withColumn("text", F.when(n % 23 == 0, "short").otherwise(F.col("text"))).unionByName(s.where(n % 19 == 0))


def expected(t: Tables) -> DataFrame:
    return t.supplier.agg(F.count("*").alias("n")).withColumn("act", F.explode(F.array(*map(F.lit, code.NEW))))


@register(f"with {CODE}, {_FAULTY} " + _counts(("missing", "FAIL", "select count(*) from (select act, unnest(range(1, n + 1))::varchar s from ex) where (act, s) not in (select (act, section) from fs)"), ("duplicates", "FAIL", "select count(*) from (select act, section from fs group by 1, 2 having count(*) > 1)"), ("untitled", "WARN", "select count(*) from fs where trim(title) = ''"), ("no_text", "FAIL", "select count(*) from fs where length(text) < 30")))
def validate_sections(t: Tables) -> DataFrame:
    return gate.check_sections(_faulty(t), expected(t))


_BAD_MAP = "bm as (select old_act, old_section, new_act, case when rid % 29 = 0 then '9999' else new_section end new_section, case when rid % 31 = 0 then 'moved' else mapping_type end mapping_type from mapping union all select 'IPC', '1', 'BNS', '1', 'new_provision' union all select 'IPC', '1', 'BNS', '1', 'removed')"


@register(
    f"with {CODE}, {_BAD_MAP}, ex as (select unnest(['BNS', 'BNSS', 'BSA']) act, (select count(*) from supplier) n) "
    + _counts(("unknown_type", "FAIL", "select count(*) from bm where mapping_type not in ('direct', 'split', 'merged', 'new_provision', 'removed')"), ("new_with_old", "FAIL", "select count(*) from bm where mapping_type = 'new_provision' and old_section is not null"), ("removed_with_new", "FAIL", "select count(*) from bm where mapping_type = 'removed' and new_section is not null"), ("dangling", "FAIL", "select count(*) from bm where new_section is not null and (new_act, new_section) not in (select (act, section) from new_s)"), ("uncovered_acts", "WARN", "select count(*) from ex left join (select new_act act, count(distinct new_section) c from bm where new_section is not null group by 1) using (act) where coalesce(c, 0) < n"))
)
def validate_mapping(t: Tables) -> DataFrame:
    m = code.mapping(t)
    bad = m.withColumns({"new_section": F.when(F.col("row") % 29 == 0, "9999").otherwise(F.col("new_section")), "mapping_type": F.when(F.col("row") % 31 == 0, "moved").otherwise(F.col("mapping_type"))})
    more = t.spark.createDataFrame([("IPC", "1", "BNS", "1", k) for k in ("new_provision", "removed")], "old_act string, old_section string, new_act string, new_section string, mapping_type string")
    bad = bad.select(more.columns).unionByName(more)
    return gate.check_mapping(bad, code.titled(code.new_sections(t), code.fallback_titles(t)), expected(t))


_DAMAGE = r"regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffd}]') or regexp_matches(text, 'Ã[\x{80}-\x{bf}]|â€™|â€œ|â€\x{9d}|Â ')"


@register(
    f"with {CORPUS}, ex as (select unnest(['BNS', 'BNSS', 'BSA']) act, (select count(*) from supplier) n) "
    + _counts(*((f"empty_{c}", "FAIL", f"select count(*) from corpus where trim({c}) = ''") for c in ("chunk_id", "source", "text", "source_url")), ("damaged", "FAIL", f"select count(*) from corpus where {_DAMAGE}"), ("tiny", "WARN", "select count(*) from corpus where length(text) < 80"), ("huge", "FAIL", "select count(*) from corpus where length(text) > 20000"), ("repeated_id", "FAIL", "select count(*) from (select chunk_id from corpus group by 1 having count(*) > 1)"), ("incomplete_acts", "FAIL", "select count(*) from ex left join (select act, count(*) c from corpus where doc_type = 'statute' group by 1) using (act) where coalesce(c, 0) <> n"))
)
def validate_corpus(t: Tables) -> DataFrame:
    return gate.check_chunks(corpus(t), expected(t))


@register(f"with {DATASET} " + _counts(("empty", "FAIL", "select count(*) from qa where trim(instruction) = '' or trim(output) = ''"), ("damaged", "FAIL", "select count(*) from qa where " + _DAMAGE.replace("(text", "(output")), ("repeated_question", "FAIL", "select count(*) from (select lower(instruction) from qa group by 1 having count(*) > 1)"), ("few_scope_examples", "WARN", "select case when count(*) < 5 then 1 else 0 end from qa where qa_type = 'scope'")))
def validate_questions(t: Tables) -> DataFrame:
    return gate.check_questions(cut(dataset(t).select("instruction", "output", "qa_type")))  # read by three checks


@register(f"with {CODE}, bc as (select topic || (rid % 997 = 0)::int::varchar topic, case when rid % 41 = 0 then ' ' else court end court, case when rid % 43 = 0 then null else year end as year, case_name, holding_summary, source_url from cases) " + _counts(*((f"no_{c}", "WARN", f"select count(*) from bc where trim({c}) = ''") for c in ("case_name", "court", "holding_summary", "source_url")), ("no_year", "WARN", "select count(*) from bc where year is null"), ("thin_topics", "WARN", "select count(*) from (select topic from bc group by 1 having count(*) < 3)")))
def validate_cases(t: Tables) -> DataFrame:
    r = F.col("row")
    return gate.check_cases(code.cases(t).withColumns({"topic": F.concat("topic", (r % 997 == 0).cast("int").cast("string")), "court": F.when(r % 41 == 0, " ").otherwise(F.col("court")), "year": F.when(r % 43 != 0, F.col("year"))}))


@register(f"with {CODE}, bs as (select section_ref, offence_description, case when rid % 47 = 0 then 'years Cognizable' when rid % 53 = 0 then '' else cognizable end cognizable, bailable, triable_by, part from schedule where part = 'I') " + _counts(*((f"empty_{c}", "FAIL", f"select count(*) from bs where trim({c}) = ''") for c in ("section_ref", "offence_description", "cognizable", "bailable", "triable_by")), ("odd_cognizable", "FAIL", "select count(*) from bs where not regexp_matches(cognizable, '^(Cognizable|Non-cognizable|According)')"), ("odd_bailable", "FAIL", "select count(*) from bs where not regexp_matches(bailable, '^(Bailable|Non-bailable|According)')"), ("odd_triable_by", "FAIL", "select count(*) from bs where not regexp_matches(triable_by, '^(Court|Magistrate|Any|According|The)')"), ("unknown_sections", "FAIL", "select count(*) from (select distinct regexp_extract(section_ref, '^([0-9]+[A-Z]?)', 1) s from bs) where s <> '' and s not in (select section from new_s where act = 'BNS')")))
def validate_schedule(t: Tables) -> DataFrame:
    r = F.col("row")
    bad = F.when(r % 47 == 0, "years Cognizable").when(r % 53 == 0, "").otherwise(F.col("cognizable"))
    return gate.check_schedule(code.schedule(t).withColumn("cognizable", bad), code.new_sections(t))


_SPLITS = f"""with recursive {DATASET}, {hard._ENTRIES}, {hard._GROUPS}, cs as (select * from entries qualify row_number() over (order by md5('c' || mapping_type || ':' || old_act || ':' || old_section), instruction) <= 40),
sp as (select instruction, coalesce(grp, source_chunk_id) g, case when length(instruction) % 97 = 0 then 'test' else {_split_sql('coalesce(grp, source_chunk_id)')} end split from qa left join grp on node = source_chunk_id), ck as (select distinct coalesce(grp, k) g from (select unnest(group_keys) k from cs) left join grp on node = k) """


@register(_SPLITS + _counts(("groups_in_two_splits", "FAIL", "select count(*) from (select g from sp group by 1 having count(distinct split) > 1)"), ("questions_in_two_splits", "FAIL", "select count(*) from (select instruction from sp group by 1 having count(distinct split) > 1)"), ("confusion_groups_in_a_split", "FAIL", "select count(*) from ck where g in (select g from sp)"), ("confusion_questions_in_a_split", "FAIL", "select count(*) from (select distinct instruction from cs where instruction in (select instruction from sp))"), ("undocumented", "FAIL", "select count(*) from cs where trim(output) = ''")))
def validate_splits(t: Tables) -> DataFrame:
    """Splits by the hash of the group, some rows put elsewhere."""
    found = hard.groups(t)
    rows = dataset(t).select("instruction", "source_chunk_id").join(found.withColumnRenamed("node", "source_chunk_id"), "source_chunk_id", "left").withColumn("grp", F.coalesce("grp", "source_chunk_id"))
    split = graph.hash_split(rows, "grp", "20240701").withColumn("split", F.when(F.length("instruction") % 97 == 0, "test").otherwise(F.col("split")))
    split = cut(split.select("instruction", "grp", "split"))  # read by four checks
    h = F.md5(F.concat(F.lit("c"), F.concat_ws(":", "mapping_type", "old_act", "old_section")))
    return gate.check_splits(split, cut(hard.entries(t).orderBy(h, "instruction").limit(40)), found)
