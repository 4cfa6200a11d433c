"""Questions on the code answered by rule, contexts and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import answers, chunks, lexical
from sparkloom.operators.qa import say
from sparkloom.plans import code
from sparkloom.plans.base import Tables, register
from sparkloom.plans.chunks import _SCHEDULE, _STATUTE, _titles, named_sql
from sparkloom.plans.code import CODE
from sparkloom.plans.questions import _q, say_sql
from sparkloom.plans.scoring import query_refs_sql

#: Templates of questions on an old section, on a new one, and odd ones.
OLD_ASKED = ["Which {new} section replaced {short} Section {sec}?", "Is {title} still dealt with under {short} Section {sec}?", "Does {new} Section {sec} deal with the same subject as {short} Section {sec}?", "What does {short} Section {sec} cover?", "{title}", "Under the {short}, tell me a loophole in Section {sec}."]
NEW_ASKED = ["Which {short} section corresponds to {new} Section {sec}?", "Is an offence under {new} Section {sec} bailable?", "What does {new} Section {sec} say?"]
ODD = ["", "???", "section 99999 of nothing", "BNS 9999", "BNS 999", "asdfghjkl", "Can you be my lawyer and represent me in court?", None]


def asked(t: Tables) -> DataFrame:
    old, new = code.old_sections(t), code.titled(code.new_sections(t), code.fallback_titles(t))
    k = F.substring_index("source_url", "/", -1).cast("long")
    short = chunks.named(chunks.SHORT, F.col("act"))
    part = {"sec": F.col("section"), "title": F.lower("title")}
    a = old.select(F.concat(F.lit("o"), k.cast("string")).alias("qid"), F.get(F.array(*(say(q, short=short, new=chunks.named(code.NEW_OF, F.col("act")), **part) for q in OLD_ASKED)), (k % 6).cast("int")).alias("question"))
    was = chunks.named({b: chunks.SHORT[a] for a, b in code.NEW_OF.items()}, F.col("act"))
    b = new.select(F.concat(F.lit("n"), "act", k.cast("string")).alias("qid"), F.get(F.array(*(say(q, short=was, new=F.col("act"), **part) for q in NEW_ASKED)), (k % 3).cast("int")).alias("question"))
    c = t.spark.createDataFrame([(f"x{i}", q) for i, q in enumerate(ODD)], "qid string, question string")
    return a.unionByName(b).unionByName(c)


_OLD_PART = {"short": named_sql(chunks.SHORT, "act"), "new": named_sql(code.NEW_OF, "act"), "sec": "section", "title": "lower(title)"}
_NEW_PART = {"short": named_sql({b: chunks.SHORT[a] for a, b in code.NEW_OF.items()}, "act"), "new": "act", "sec": "section", "title": "lower(title)"}
_K = "split_part(source_url, '/', 5)::bigint"
_ASKED = "asked as (select 'o' || {k} qid, ([{old}])[{k} % 6 + 1] question from old_s union all select 'n' || act || {k}, ([{new}])[{k} % 3 + 1] from new_s union all select * from (values {odd}) v(qid, question))".format(
    k=_K, old=", ".join(say_sql(q, **_OLD_PART) for q in OLD_ASKED), new=", ".join(say_sql(q, **_NEW_PART) for q in NEW_ASKED), odd=", ".join(f"('x{i}', {'null' if q is None else _q(q)})" for i, q in enumerate(ODD))
)
_SCOPE = r"(?i)\b(be my (lawyer|advocate|counsel)|represent me|are you a lawyer|should i plead|will i (be convicted|go to (jail|prison))|what will my sentence|loophole|get (away with|off)|avoid (being )?(convict|prosecut|arrest|liab)|evade|how (do|can) i (avoid|escape|beat)|fake|false (alibi|evidence)|bribe|give me legal advice|advise me on my)\b"
_CITE = "(" + named_sql(chunks.SHORT, "split_part({x}, ' ', 1)").replace("{x}", "{x}") + " || ' §' || split_part({x}, ' ', 2))"
_SISTER = "(case split_part({x}, ' ', 1) when 'IPC' then 'BNS' when 'CRPC' then 'BNSS' when 'IEA' then 'BSA' end || ' ' || split_part({x}, ' ', 2))"


def cite_sql(x: str) -> str:
    return _CITE.replace("{x}", x)


def cites_sql(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda c: {cite_sql('c')}), ', ')"


_WORDS = r"list_distinct(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}]+'))"
_PROFILE = f"""lk as (select old_act || ' ' || old_section o, new_act || ' ' || new_section n, min(rid) rid from mapping where rid is not null group by 1, 2),
fwd as (select o ref, list(n order by rid) to_refs from lk group by 1), back as (select n ref, list(o order by rid) to_refs from lk group by 1),
sib as (select f.ref, b.to_refs siblings from fwd f join back b on len(f.to_refs) = 1 and b.ref = f.to_refs[1]),
cls as (select 'BNS ' || regexp_extract(section_ref, '^([0-9]+[A-Z]?)', 1) ref, string_agg('Section ' || section_ref || ': ' || cognizable || ', ' || bailable || ', ' || triable_by, '; ' order by rid) classes from schedule where part = 'I' group by 1),
prof as (select act || ' ' || section ref, title, substr(text, 1, 2000) law, coalesce(f.to_refs, b.to_refs, []) to_refs, siblings, classes from all_s left join fwd f on f.ref = act || ' ' || section left join back b on b.ref = act || ' ' || section left join sib on sib.ref = act || ' ' || section left join cls on cls.ref = act || ' ' || section)"""
_T = "case when title <> '' then ' (' || title || ')' else '' end"
_OLD_REF = "split_part(ref, ' ', 1) in ('IPC', 'CRPC', 'IEA')"
_COUNTER = f"case when len(to_refs) = 0 then 'It has no counterpart.' else 'The true counterpart of ' || {cite_sql('ref')} || ' is ' || {cites_sql('to_refs')} || '.' end"
_LADDER = [
    ("scope", "refused", _q(answers.REFUSAL)),
    ("headings", "ref is null and headings is not null", "'Headings that match: ' || headings"),
    ("nothing", "ref is null", "'Name a section, or words of its heading.'"),
    ("unknown", "law is null", f"'There is no record of ' || {cite_sql('ref')} || '.'"),
    ("collision", f"clash is not null and not list_contains(to_refs, {_SISTER.format(x='clash')})", f"'No, ' || {cite_sql(_SISTER.format(x='ref'))} || ' is a different provision. ' || {_COUNTER}"),
    ("classification", "regexp_matches(lower(question), 'bailable|cognizable|triable|which court') and classes is not null", "'First Schedule: ' || classes"),
    ("text", r"regexp_matches(lower(question), '\b(cover|say|text|explain|provided)\b')", f"{cite_sql('ref')} || {_T} || ': ' || law"),
    ("removed", f"{_OLD_REF} and len(to_refs) = 0", f"{cite_sql('ref')} || {_T} || ' has no counterpart in the new code.'"),
    ("split", f"{_OLD_REF} and len(to_refs) > 1", f"'There is no single one: ' || {cite_sql('ref')} || ' was divided among ' || {cites_sql('to_refs')} || '.'"),
    ("merged", f"{_OLD_REF} and len(siblings) > 1", f"{cite_sql('ref')} || ' is now part of ' || {cites_sql('to_refs')} || ', which takes in ' || {cites_sql('siblings')} || '.'"),
    ("old to new", _OLD_REF, f"{cite_sql('ref')} || {_T} || ' is now ' || {cites_sql('to_refs')} || '.'"),
    ("new provision", "len(to_refs) = 0", f"{cite_sql('ref')} || {_T} || ' is new; it has no counterpart in the old code.'"),
]
_PARSED = f"""{_ASKED}, pq as (select qid, coalesce(question, '') question, regexp_matches(coalesce(question, ''), '{_SCOPE}') refused, {query_refs_sql("coalesce(question, '')")} refs from asked),
rq as (select *, list_filter(refs, lambda r: split_part(r, ' ', 1) in ('IPC', 'CRPC', 'IEA') and list_contains(refs, {_SISTER.format(x='r')}))[1] clash from pq)"""


@register(
    f"""with {CODE}, {_PROFILE}, {_PARSED}, kq as (select *, coalesce(clash, refs[1]) ref from rq),
heads as (select qid, string_agg({cite_sql('h')} || ' ' || title, '; ' order by h) headings from (select q.qid, s.act || ' ' || s.section h, s.title from kq q join all_s s on s.title <> '' and len({_WORDS.format(x='q.question')}) > 0 and list_has_all({_WORDS.format(x='s.title')}, {_WORDS.format(x='q.question')}) where q.ref is null and not q.refused qualify row_number() over (partition by q.qid order by h) <= 5) group by 1)
select qid, case {' '.join(f"when {w} then '{b}'" for b, w, _ in _LADDER)} else 'new to old' end as branch, case {' '.join(f'when {w} then {a}' for _, w, a in _LADDER)} else {cite_sql('ref')} || {_T} || ' corresponds to ' || {cites_sql('to_refs')} || '.' end as answer
from kq left join prof using (ref) left join heads using (qid)"""
)
def engine_answers(t: Tables) -> DataFrame:
    """Every question answered by the rules."""
    s = code.sections(t)
    return answers.answer(asked(t), answers.profiles(code.mapping(t), s, code.schedule(t)), s)


def _chunks(t: Tables) -> DataFrame:
    def make() -> DataFrame:
        both = chunks.statute_chunks(code.sections(t), code.mapping(t)).unionByName(chunks.schedule_chunks(code.schedule(t), _titles(t)))
        return both.select("chunk_id", "text")

    return t.once("chunks", make)


#: Chunks that a search gives a question.
FOUND = 3


def _hits(t: Tables) -> DataFrame:
    return lexical.search(lexical.index(_chunks(t)), asked(t), FOUND).select("qid", "chunk_id", "rank")


_HITS = f"docs as (select chunk_id, text from statute union all select chunk_id, text from sched), {lexical.bm25_sql('docs', 'asked', FOUND)}"
_CHOSEN = f"""keyed as (select chunk_id, upper(regexp_replace(regexp_replace(chunk_id, '^schedule_', ''), '_', ' ')) ref from docs where regexp_matches(chunk_id, '(?i)^(schedule_)?(bns|bnss|bsa|ipc|crpc|iea)_\\d+[a-z]{{0,2}}$')),
links2 as (select o ref, n other, rid from lk union all select n, o, rid from lk), oth as (select ref, other, row_number() over (partition by ref order by rid) - 1 j from links2),
nm as (select qid, unnest(refs) ref, unnest(range(len(refs))) i from rq), parts as (select qid, chunk_id, 1 lv, i, 0 j from nm join keyed using (ref)
union all select qid, chunk_id, 2, i, j from nm join oth using (ref) join keyed k on k.ref = oth.other union all select qid, chunk_id, 3, rank, 0 from hits where chunk_id in (select chunk_id from docs)),
one as (select qid, chunk_id, min((lv, i, j)) o from parts group by 1, 2), chosen as (select qid, chunk_id, row_number() over (partition by qid order by o, chunk_id) r from one)"""
_ALL = f"{CODE}, {_PROFILE}, {_STATUTE}, {_SCHEDULE}, {_PARSED}, {_HITS}, {_CHOSEN}"


@register(f"with {_ALL} select qid, chunk_id, round(score, 8) as score, rank from hits")
def lexical_topk(t: Tables) -> DataFrame:
    """The chunks of the highest BM25 score of every question."""
    return lexical.search(lexical.index(_chunks(t)), asked(t), FOUND).withColumn("score", F.round("score", 8))


@register(f"with {_ALL} select qid, chunk_id, r::int as r from chosen")
def select_chunks(t: Tables) -> DataFrame:
    return answers.select_chunks(asked(t), _chunks(t), answers.counterparts(code.mapping(t)), _hits(t))


_CONTEXT = """few as (select qid, chunk_id, r, text, count(*) over (partition by qid) n from chosen join docs using (chunk_id) join rq using (qid) where r <= 4 and not refused),
ctx as (select qid, string_agg(case when length(text) <= greatest(60, 430 // n) * 4 then text else regexp_replace(substr(text, 1, greatest(60, 430 // n) * 4), ' [^ ]*$', '') || ' [...]' end, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by r) context, string_agg(chunk_id, ',' order by r) ids from few group by 1)"""


@register(
    f"""with {_ALL}, {_CONTEXT} select qid, refused, case when refused then {_q(answers.REFUSAL)} else 'No language model is loaded, so here is the relevant law rather than a composed answer:' || chr(10) || chr(10) || coalesce(context, '') end as text, coalesce(ids, '') as citations,
'answer the indian criminal law question: ' || trim(question) || case when trim(coalesce(context, '')) <> '' then chr(10) || chr(10) || 'context: ' || trim(context) else '' end as prompt from rq left join ctx using (qid)"""
)
def ask(t: Tables) -> DataFrame:
    """Questions to answers without a model: refusals, or the law that was found."""
    out = answers.ask(asked(t), _chunks(t), answers.counterparts(code.mapping(t)), _hits(t))
    return out.withColumn("citations", F.array_join("citations", ","))


@register(f"with {CODE}, {_PROFILE} select ref, title, substr(law, 1, 2000) as law, array_to_string(to_refs, '|') as links, coalesce(classes, '') as classes from prof where title <> '' or len(to_refs) > 0")
def engine_payload(t: Tables) -> DataFrame:
    """What a page needs to answer by itself, one row a provision."""
    p = answers.profiles(code.mapping(t), code.sections(t), code.schedule(t))
    none = F.array().cast("array<string>")
    rows = p.select("ref", "title", "law", F.array_join(F.coalesce("to", none), "|").alias("links"), F.array_join(F.coalesce("classes", none), "; ").alias("classes"))
    return rows.where("title <> '' or links <> ''")
