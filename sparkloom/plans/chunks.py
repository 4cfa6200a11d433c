"""The retrieval corpus of the code: chunks of four kinds, their counts, the compact payload."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import chunks
from sparkloom.plans import code
from sparkloom.plans.base import Tables, register
from sparkloom.plans.code import CODE


def named_sql(names: dict[str, str], act: str) -> str:
    return "case " + act + " " + " ".join(f"when '{k}' then '{v}'" for k, v in names.items()) + " end"


_LONG = named_sql(chunks.LONG, "{}")
_EQUIV = """links as (select old_act act, old_section section, new_act to_act, new_section to_section, min(rid) rid from mapping where rid is not null group by all
union all select new_act, new_section, old_act, old_section, min(rid) from mapping where rid is not null group by all),
equiv as (select act, section, list(to_act || ' ' || to_section order by rid) refs, string_agg({} || ' Section ' || to_section, ', ' order by rid) names from links group by 1, 2)""".format(_LONG.format("to_act"))
_TITLE = "array_to_string(list_transform(string_split({}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_STATUTE = f"""{_EQUIV},
statute as (select lower(act || '_' || section) chunk_id, 'statute' doc_type, {_LONG.format('act')} || ', Section ' || section as source, act, section, title section_title, chapter_no::int chapter_no, chapter_title,
  case when act in ('BNS', 'BNSS', 'BSA') then '2024-07-01' end in_force_from, case when act in ('BNS', 'BNSS', 'BSA') then 'in force' else 'repealed with effect from 1 July 2024' end status, coalesce(refs, []) equivalent_sections,
  {_LONG.format('act')} || ', Section ' || section || case when title <> '' then ' - ' || title else '' end
  || case when names is null then '' else chr(10) || '(' || case when act in ('BNS', 'BNSS', 'BSA') then 'corresponds to ' else 'replaced by ' end || names || ')' end
  || case when chapter_title is null then '' else chr(10) || 'Chapter ' || chapter_no || ': ' || {_TITLE.format('chapter_title')} end || chr(10) || text as text, source_url
  from all_s left join equiv using (act, section))"""
_OUT = "chunk_id, doc_type, source, act, section, section_title, chapter_no, chapter_title, in_force_from, status, array_to_string(equivalent_sections, '|') as equivalent_sections, text, source_url"
_INTRO = "BNSS First Schedule, Part II - classification of offences against other laws' || chr(10) || 'Where an offence is created by an Act other than the Bharatiya Nyaya Sanhita, it is classified by the punishment it carries:"
_SCHEDULE = f"""part1 as (select regexp_extract(section_ref, '^([0-9]+[A-Z]?)', 1) section, * from schedule where part = 'I'),
sched as (select 'schedule_bns_' || lower(p.section) chunk_id, 'BNSS 2023, First Schedule (BNS Section ' || p.section || ')' as source, p.section, coalesce(max(n.title), '') section_title,
  'BNSS First Schedule - classification of the offence under BNS Section ' || p.section || case when coalesce(max(n.title), '') <> '' then ' (' || max(n.title) || ')' else '' end || chr(10)
  || string_agg('Section ' || section_ref || ' - ' || offence_description || ' Punishment: ' || punishment || ' ' || cognizable || '. ' || bailable || '. Triable by: ' || triable_by || '.', chr(10) order by rid) as text
  from part1 p left join new_s n on n.act = 'BNS' and n.section = p.section group by p.section
  union all select 'schedule_other_laws', 'BNSS 2023, First Schedule, Part II', '', 'Offences against other laws', '{_INTRO}' || chr(10) || string_agg(offence_description || ' ' || cognizable || '. ' || bailable || '. Triable by: ' || triable_by || '.', chr(10) order by rid) from schedule where part = 'II' having count(*) > 0),
sched_all as (select chunk_id, 'schedule' doc_type, source, 'BNSS' act, section, section_title, null::int chapter_no, 'First Schedule - Classification of Offences' chapter_title, '2024-07-01' in_force_from, 'in force' status, []::varchar[] equivalent_sections, text, '{chunks.SCHEDULE_URL}' source_url from sched)"""
_CASES = """asked as (select rid, old_act, unnest(old_sections) s, unnest([1, 2]) as pos from cases),
met as (select a.rid, m.new_act || ' ' || m.new_section ref, min(a.pos * 1000000000000 + m.rid) o from asked a join mapping m on m.old_act = a.old_act and m.old_section = a.s where m.rid is not null group by all),
newref as (select rid, list(ref order by o) new_sections from met group by 1),
full_cases as (select c.*, coalesce(n.new_sections, []) new_sections from cases c left join newref n using (rid)),
c1 as (select * from full_cases qualify row_number() over (partition by source_url order by rid) = 1),
ct as (select source_url, list(topic order by r) topics from (select source_url, topic, min(rid) r from cases group by all) group by 1),
co as (select source_url, list(ref order by r) old_refs from (select source_url, a.old_act || ' ' || s ref, min(a.rid * 10 + pos) r from asked a join cases using (rid) group by all) group by 1),
cx as (select source_url, unnest(new_sections) ref, rid, unnest(range(len(new_sections))) as pos from full_cases),
cn as (select source_url, list(ref order by r) new_refs from (select source_url, ref, min(rid * 1000 + pos) r from cx group by all) group by 1),
case_rows as (select 'case_' || lpad(k::varchar, greatest(3, length(k::varchar))::int, '0') chunk_id, 'case_law' doc_type, case_name || ' (' || court || ', ' || year || ')' as source, old_act act, old_sections[1] section, array_to_string(topics, '; ') section_title,
  null::int chapter_no, null::varchar chapter_title, null::varchar in_force_from, 'case law' status, coalesce(new_refs, []) equivalent_sections,
  case_name || ' (' || court || ', ' || year || ')' || chr(10) || 'Topics: ' || array_to_string(topics, '; ') || chr(10) || 'Provisions: ' || array_to_string(old_refs, ', ') || case when new_refs is null then '' else ' (now ' || array_to_string(new_refs[1:8], ', ') || ')' end || chr(10) || 'Held (extract from the judgment): ' || holding_summary as text, source_url
  from (select *, row_number() over (order by source_url) k from c1 join ct using (source_url) join co using (source_url) left join cn using (source_url)))"""
_REFERENCE = f"reference as (select 'transition_commencement' chunk_id, 'reference' doc_type, 'Commencement of the new criminal codes' as source, '' act, '' section, 'Commencement of the new criminal codes' section_title, null::int chapter_no, null::varchar chapter_title, '2024-07-01' in_force_from, 'reference' status, []::varchar[] equivalent_sections, regexp_replace('{chunks.COMMENCEMENT}', '\\n+', chr(10), 'g') as text, 'https://www.mha.gov.in/' source_url)"
CORPUS = f"{CODE}, {_STATUTE}, {_SCHEDULE}, {_CASES}, {_REFERENCE}, corpus as (select * from statute union all select * from sched_all union all select * from case_rows union all select * from reference)"


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("equivalent_sections", F.array_join("equivalent_sections", "|"))


def _titles(t: Tables) -> DataFrame:
    return code.titled(code.new_sections(t), code.fallback_titles(t)).where("act = 'BNS'").select("section", "title")


@register(f"with {CODE} select old_act, old_section, old_title, new_act, new_section, new_title, mapping_type from mapping")
def mapping_table(t: Tables) -> DataFrame:
    return code.mapping(t).drop("row")


@register(f"with {CODE}, {_STATUTE} select {_OUT} from statute")
def chunks_statute(t: Tables) -> DataFrame:
    return _flat(chunks.statute_chunks(code.sections(t), code.mapping(t)))


@register(f"with {CODE}, {_SCHEDULE} select {_OUT} from sched_all")
def chunks_schedule(t: Tables) -> DataFrame:
    return _flat(chunks.schedule_chunks(code.schedule(t), _titles(t)))


def full_cases(t: Tables) -> DataFrame:
    return t.once("full_cases", lambda: chunks.case_new_sections(code.cases(t), code.mapping(t)))


@register(f"with {CODE}, {_CASES} select {_OUT} from case_rows")
def chunks_cases(t: Tables) -> DataFrame:
    return _flat(chunks.case_chunks(full_cases(t)))


def corpus(t: Tables) -> DataFrame:
    parts = [chunks.statute_chunks(code.sections(t), code.mapping(t)), chunks.schedule_chunks(code.schedule(t), _titles(t)), chunks.case_chunks(full_cases(t))]
    return reduce(DataFrame.unionByName, [*parts, chunks.transition_chunk(parts[0])])


@register(f"with {CORPUS} select doc_type, act, count(*) as n, max(length(text)) as longest, count_if(len(equivalent_sections) > 0) as linked from corpus group by 1, 2")
def corpus_stats(t: Tables) -> DataFrame:
    return corpus(t).groupBy("doc_type", "act").agg(F.count("*").alias("n"), F.max(F.length("text")).cast("long").alias("longest"), F.count_if(F.size("equivalent_sections") > 0).alias("linked"))
