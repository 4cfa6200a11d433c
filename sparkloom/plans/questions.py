"""Families of questions and answers over the code, and their union without repeated questions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import chunks, qa
from sparkloom.operators.graph import cut
from sparkloom.plans import code
from sparkloom.plans.base import Tables, register
from sparkloom.plans.chunks import _CASES, full_cases, named_sql
from sparkloom.plans.code import CODE


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def say_sql(template: str, **parts: str) -> str:
    """The template as a concatenation of SQL expressions."""
    out = [parts[x[1:-1]] if x[:1] == "{" else _q(x) for x in re.split(r"(\{\w+\})", template) if x]
    return "(" + " || ".join(f"({x})" for x in out) + ")"


def family_sql(source: str, kind: str, key: str, group: str, asked: list[str], take: int, answer: str, where: str = "true", **parts: str) -> str:
    phrasings = ", ".join(say_sql(q, **parts) for q in asked)
    return f"""(select q as instruction, a as output, '{kind}' as qa_type, g as source_chunk_id, k || ':' || i as seq from (select {key} k, {group} g, unnest([{phrasings}]) q, unnest(range(1, {len(asked) + 1})) i, {answer} a from {source} where {where})
qualify row_number() over (partition by k order by md5('7' || k || ':' || i), i) <= {take})"""


_FULL, _SHORT = named_sql(chunks.FULL, "act"), named_sql(chunks.SHORT, "act")
_BASE = {"full": _FULL, "short": _SHORT, "sec": "section"}
_ENTITY = "lower(act || '_' || section)"
_BRACKET = "case when {} <> '' then ' (' || {} || ')' else '' end"
_CUT = "case when length({x}) <= {n} then {x} when greatest(case when instr(reverse({x}[1:{n}]), ' .') > 0 then {n} - instr(reverse({x}[1:{n}]), ' .') else 0 end, case when instr(reverse({x}[1:{n}]), ' ;') > 0 then {n} - instr(reverse({x}[1:{n}]), ' ;') else 0 end) - 1 > {n} * 0.5 then rtrim({x}[1:greatest(case when instr(reverse({x}[1:{n}]), ' .') > 0 then {n} - instr(reverse({x}[1:{n}]), ' .') else 0 end, case when instr(reverse({x}[1:{n}]), ' ;') > 0 then {n} - instr(reverse({x}[1:{n}]), ' ;') else 0 end)]) || ' [...]' else rtrim({x}[1:{n}]) || ' [...]' end"
_BODY = "(select *, case when starts_with(text, section || '.') then trim(text[length(section) + 2:]) else trim(text) end body from all_s)"

SECTION_TEXT = family_sql(_BODY, "section_text", _ENTITY, _ENTITY, ["What does {short} Section {sec} cover?", "What does Section {sec} of the {full} say?", "Explain {short} Section {sec}.", "State the text of Section {sec} of the {short}.", "Under the {full}, what is provided by Section {sec}?"], 2, f"case when title <> '' then {_SHORT} || ' Section ' || section || ' (' || title || '). ' else '' end || {_CUT.format(x='body', n=1000)}", "length(body) >= 40", **_BASE)
_SUBJECT = "lower(title[1]) || title[2:]"
SECTION_LOOKUP = family_sql("all_s", "section_lookup", _ENTITY, _ENTITY, ["Which section of the {short} deals with {subject}?", "Under which section of the {full} does {subject} fall?", "Where in the {short} is {subject} dealt with?"], 1, f"'Section ' || section || ' of the ' || {_FULL} || ' (' || title || ').'", "length(title) >= 6", subject=_SUBJECT, **_BASE)
_FOUND = "regexp_extract(text, '(?i)shall be punished with ([^.;:]{10,220})', 1)"
PUNISHMENT = family_sql("all_s", "punishment", _ENTITY, _ENTITY, ["What is the punishment under {short} Section {sec}?", "What penalty does Section {sec} of the {full} prescribe?", "How is an offence under {short} Section {sec} punished?"], 2, f"'Under ' || {_SHORT} || ' Section ' || section || {_BRACKET.format('title', 'title')} || ', the offender shall be punished with ' || rtrim(trim({_FOUND}), ',') || '.'", f"act <> 'CRPC' and act <> 'IEA' and {_FOUND} <> ''", **_BASE)


def _listed(side: str, other: str) -> str:
    return f"(select {side}_act act, {side}_section section, first({other}_act order by rid) other, array_to_string((list('Section ' || {other}_section || {_BRACKET.format(other + '_title', other + '_title')} order by rid))[1:5], ', ') refs from mapping where rid is not null group by 1, 2)"


_MAPPED = {"so": _SHORT, "sn": named_sql(chunks.SHORT, "other"), "sec": "section", "refs": "refs", "new": named_sql(chunks.FULL, "other"), "old": _FULL}
OLD_TO_NEW = family_sql(_listed("old", "new"), "old_to_new", _ENTITY, _ENTITY, ["Which {sn} section replaced {so} Section {sec}?", "{so} {sec} corresponds to which section of the new law?", "What is the new section for {so} Section {sec}?", "Under the new criminal codes, what has {so} {sec} become?"], 2, say_sql("{so} Section {sec} corresponds to {sn} {refs}. The {new} replaced the {old} with effect from 1 July 2024.", **_MAPPED), **_MAPPED)
_BACK = {**_MAPPED, "sn": _SHORT, "so": named_sql(chunks.SHORT, "other")}
NEW_TO_OLD = family_sql(_listed("new", "old"), "new_to_old", _ENTITY, _ENTITY, ["Which {so} section corresponds to {sn} Section {sec}?", "What was {sn} {sec} before 1 July 2024?", "{sn} Section {sec} replaced which provision of the old law?"], 2, say_sql("{sn} Section {sec} corresponds to {so} {refs}. The {so} was repealed with effect from 1 July 2024.", **_BACK), **_BACK)
_ONE = "(select {s}_act act, {s}_section section, {s}_title title from mapping where mapping_type = '{k}' and {s}_title <> '')"
_FRESH = {**_BASE, "title": "title", "low": "lower(title)", "old": "case act when 'BNS' then 'Indian Penal Code, 1860' when 'BNSS' then 'Code of Criminal Procedure, 1973' else 'Indian Evidence Act, 1872' end"}
NEW_PROVISION = family_sql(_ONE.format(s="new", k="new_provision"), "new_provision", _ENTITY, _ENTITY, ["Is {short} Section {sec} a new provision?", "Did the old law have an equivalent of {short} Section {sec}?", "Is {low} a new offence under the {short}?"], 2, say_sql("Yes. {short} Section {sec} ({title}) is a new provision introduced by the {full}; it has no equivalent in the {old}.", **_FRESH), **_FRESH)
_GONE = {**_BASE, "title": "title", "new": "case act when 'IPC' then 'BNS' when 'CRPC' then 'BNSS' else 'BSA' end", "into": "case act when 'IPC' then 'Bharatiya Nyaya Sanhita, 2023' when 'CRPC' then 'Bharatiya Nagarik Suraksha Sanhita, 2023' else 'Bharatiya Sakshya Adhiniyam, 2023' end"}
REMOVED = family_sql(_ONE.format(s="old", k="removed"), "removed", _ENTITY, _ENTITY, ["Does {short} Section {sec} have an equivalent in the {new}?", "What replaced {short} Section {sec} in the new code?", "Is {short} {sec} carried forward into the {new}?"], 2, say_sql("{short} Section {sec} ({title}) has no corresponding provision in the {into}. The official correspondence table published by the Bureau of Police Research and Development lists no {new} counterpart for it.", **_GONE), **_GONE)
_DAYS = "(select * from (values " + ", ".join(f"({_q(d)}, {_q(w)})" for d, w in qa.DAYS) + ") d(day, law) cross join (values " + ", ".join(f"({_q(a)}, {_q(b)}, {_q(chunks.FULL[b])})" for a, b in qa.CODES) + ") c(old, new, full))"
_DAY = {x: x for x in ("day", "old", "new")} | {"full": '"full"'}
_DAYS = _DAYS.replace("c(old, new, full)", 'c(old, new, "full")')
_DAY_KEY = "'transition_' || replace(day, ' ', '-') || '_' || lower(new)"
_DAY_ANSWER = "case when law = 'new' then " + say_sql("The {new} applies. The {full} came into force on 1 July 2024, so an offence committed on {day} is dealt with under the {new} and not the {old}.", **_DAY) + " else " + say_sql("The {old} applies. The new codes came into force only on 1 July 2024, so a matter arising on {day} continues under the {old}.", **_DAY) + " end"


def _fixed_sql(kind: str, group: str, rows: list[tuple[str, str]]) -> str:
    return "(select * from (values " + ", ".join(f"({_q(x)}, {_q(a)}, '{kind}', '{group}_{i:02d}', '{group}_{i:02d}')" for i, (x, a) in enumerate(rows, 1)) + ") v(instruction, output, qa_type, source_chunk_id, seq))"


TRANSITION = "(" + family_sql(_DAYS, "transition", _DAY_KEY, _DAY_KEY, ["An offence was committed on {day}. Does the {old} or the {new} apply?", "For an incident on {day}, should a case be registered under the {old} or the {new}?", "Which applies to conduct on {day} - the {old} or the {new}?"], 2, _DAY_ANSWER, **_DAY) + " union all " + _fixed_sql("transition", "transition_general", qa.GENERAL) + ")"
SCOPE = _fixed_sql("scope", "scope", qa.SCOPE)
_CASE = {"name": "case_name", "court": "court", "year": "year", "secs": f"array_to_string(list_transform(old_sections, lambda s: {named_sql(chunks.SHORT, 'old_act')} || ' ' || s), ', ')", "topic": "lower(topic)", "url": "source_url", "held": "holding_summary"}
_CASE |= {"now": "case when len(new_sections) > 0 then ' (now ' || array_to_string(new_sections[1:3], ', ') || ')' else '' end", "then": "case when len(new_sections) > 0 then ', now ' || array_to_string(new_sections[1:3], ', ') else '' end"}
_CASE_GROUP = "'case_' || regexp_extract(source_url, '/doc/([0-9]+)', 1)"
CASE_LAW = "(" + family_sql("full_cases", "case_law", "'case:' || rid", _CASE_GROUP, ["What did the court hold in {name}?", "Summarise the decision in {name}.", "What is the significance of {name} for {topic}?"], 2, say_sql("In {name} ({court}, {year}), on {secs}{now}, the court stated: {held} Source: {url}", **_CASE), **_CASE)
CASE_LAW += " union all " + family_sql("full_cases", "case_law", "'case:' || rid || ':name'", _CASE_GROUP, ["Name a reported case on {topic} under {secs}."], 1, say_sql("{name} ({court}, {year}) concerns {topic} under {secs}{then}. Source: {url}", **_CASE), **_CASE) + ")"


def _described(field: str) -> str:
    return f"case when count(distinct {field}) = 1 then max({field}) else string_agg(rtrim(offence_description, '.') || ' - ' || {field}, '; ' order by rid) end"


_CLASSES = f"""(select p.section, coalesce(max(n.title), '') title, first(offence_description order by rid) first_offence, {_described('cognizable')} cog, {_described('bailable')} bail, {_described('triable_by')} court, count(distinct cognizable) = 1 and count(distinct bailable) = 1 same
from (select regexp_extract(section_ref, '^([0-9]+[A-Z]?)', 1) section, * from schedule where part = 'I') p left join new_s n on n.act = 'BNS' and n.section = p.section group by p.section)"""
_CLASS = {"sec": "section", "subject": "case when title <> '' then lower(title[1]) || title[2:] else lower(rtrim(first_offence, '.')) end", "named": "'BNS Section ' || section || case when title <> '' then ' (' || title || ')' else '' end", "cog": "cog", "bail": "bail", "court": "court"}
_CLASS_GROUP = "'bns_' || lower(section)"
_CLASS_ASKED = {
    "cog": (["Is an offence under BNS Section {sec} cognizable?", "Is {subject} under the BNS a cognizable offence?", "Under the BNSS First Schedule, is BNS Section {sec} cognizable or non-cognizable?"], "Under the First Schedule to the BNSS, an offence under {named} is: {cog}.", "true"),
    "bail": (["Is an offence under BNS Section {sec} bailable?", "Is {subject} under the BNS bailable or non-bailable?", "Can a person accused under BNS Section {sec} get bail as of right?"], "Under the First Schedule to the BNSS, an offence under {named} is: {bail}.", "true"),
    "court": (["Which court tries an offence under BNS Section {sec}?", "Which court has jurisdiction to try {subject} under the BNS?", "Before which court is an offence under BNS Section {sec} triable?"], "Under the First Schedule to the BNSS, an offence under {named} is triable by: {court}.", "true"),
    "all": (["How is the offence under BNS Section {sec} classified under the BNSS First Schedule?"], "An offence under {named} is {cog}, {bail}, and triable by {court}.", "same"),
}
CLASSIFICATION = "(" + " union all ".join(family_sql(_CLASSES, "offence_classification", f"'{f}:' || {_CLASS_GROUP}", _CLASS_GROUP, qs, 1, say_sql(a, **_CLASS), w, **_CLASS) for f, (qs, a, w) in _CLASS_ASKED.items()) + ")"

FAMILIES = [SECTION_TEXT, SECTION_LOOKUP, PUNISHMENT, OLD_TO_NEW, NEW_TO_OLD, NEW_PROVISION, REMOVED, TRANSITION, CASE_LAW, CLASSIFICATION, SCOPE]
_KEY = "trim(regexp_replace(lower(instruction), '[^a-z0-9]+', ' ', 'g'))"
DATASET = f"{CODE}, {_CASES}, raw as (" + " union all ".join(f"select *, {i} family from {f}" for i, f in enumerate(FAMILIES)) + f"), qa as (select family, seq, instruction, output, qa_type, source_chunk_id from raw qualify row_number() over (partition by {_KEY} order by family, seq) = 1)"
_OUT = "select instruction, output, source_chunk_id from"


def _spread(sections: DataFrame) -> DataFrame:
    """The sections over all tasks: they come from small files, and the work on their texts is many times that of reading them."""
    return sections.repartition("act", "section")


def families(t: Tables) -> list[DataFrame]:
    s, m = cut(_spread(code.sections(t))), code.mapping(t)  # read by eleven families
    titles = s.where("act = 'BNS'").select("section", "title")
    return [qa.section_text(s), qa.section_lookup(s), qa.punishment(s), qa.old_to_new(m), qa.new_to_old(m), qa.new_provision(m), qa.removed(m), qa.transition(m), qa.case_law(full_cases(t)), qa.offence_classification(code.schedule(t), titles), qa.scope(m)]


def dataset(t: Tables) -> DataFrame:
    return qa.deduplicated(families(t))


def _register(name: str, sql: str, make) -> None:
    def query(t: Tables) -> DataFrame:
        return make(t).select("instruction", "output", "source_chunk_id")

    query.__name__ = name
    register(sql)(query)


_register("qa_section_text", f"with {CODE} {_OUT} {SECTION_TEXT}", lambda t: qa.section_text(_spread(code.sections(t))))
_register("qa_section_lookup", f"with {CODE} {_OUT} {SECTION_LOOKUP}", lambda t: qa.section_lookup(code.sections(t)))
_register("qa_punishment", f"with {CODE} {_OUT} {PUNISHMENT}", lambda t: qa.punishment(code.sections(t)))
_register("qa_mapping", f"with {CODE} {_OUT} {OLD_TO_NEW} union all {_OUT} {NEW_TO_OLD}", lambda t: qa.old_to_new(code.mapping(t)).unionByName(qa.new_to_old(code.mapping(t))))
_register("qa_new_and_removed", f"with {CODE} {_OUT} {NEW_PROVISION} union all {_OUT} {REMOVED}", lambda t: qa.new_provision(code.mapping(t)).unionByName(qa.removed(code.mapping(t))))
_DATES = "(select d, strftime(d, '%-d %B %Y') as day, case when d >= date '2024-07-01' then 'new' else 'old' end law, c.* from (select distinct (o_orderdate + interval '28' year)::date d from orders where o_orderdate is not null) cross join (values " + ", ".join(f"({_q(a)}, {_q(b)}, {_q(chunks.FULL[b])})" for a, b in qa.CODES) + ') c(old, new, "full"))'
TRANSITION_DAYS = family_sql(_DATES, "transition", _DAY_KEY, _DAY_KEY, ["An offence was committed on {day}. Does the {old} or the {new} apply?", "For an incident on {day}, should a case be registered under the {old} or the {new}?", "Which applies to conduct on {day} - the {old} or the {new}?"], 2, _DAY_ANSWER, **_DAY)
_register("qa_transition", f"{_OUT} {TRANSITION_DAYS}", lambda t: qa.transition_days(qa.days_of(t.orders.select((F.col("o_orderdate") + F.expr("interval 28 years")).alias("d")), "d")))
_register("qa_case_law", f"with {CODE}, {_CASES} {_OUT} {CASE_LAW}", lambda t: qa.case_law(full_cases(t)))
_register("qa_classification", f"with {CODE} {_OUT} {CLASSIFICATION}", lambda t: qa.offence_classification(code.schedule(t), code.sections(t).where("act = 'BNS'")))
_SCOPED = {"sec": "section", "subject": _SUBJECT}
SCOPE_SECTIONS = " union all ".join(f"{_OUT} " + family_sql("new_s", "scope", f"'scope{i}:bns_' || lower(section)", "'bns_' || lower(section)", [q], 1, say_sql(a + qa.DISCLAIMER, **_SCOPED), "act = 'BNS' and length(title) >= 6", **_SCOPED) for i, (q, a) in enumerate(qa.SCOPE_SECTIONS))
_register("qa_scope", f"with {CODE} {SCOPE_SECTIONS}", lambda t: qa.scope_sections(code.sections(t).where("act = 'BNS'")))
_register("qa_dataset", f"with {DATASET} {_OUT} qa", dataset)


@register(f"with {DATASET} select qa_type, count(*) as n, max(length(instruction)) as instruction_chars, max(length(output)) as output_chars from qa group by 1")
def qa_stats(t: Tables) -> DataFrame:
    return dataset(t).groupBy("qa_type").agg(F.count("*").alias("n"), F.max(F.length("instruction")).cast("long").alias("instruction_chars"), F.max(F.length("output")).cast("long").alias("output_chars"))
