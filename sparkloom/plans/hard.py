"""Confusions, negations, splits and contexts over the code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import opens_with
from sparkloom.operators import answers, chunks, graph, hard, lexical, qa, retrieval, splits
from sparkloom.operators.graph import cut
from sparkloom.operators.ranks import global_rank
from sparkloom.plans import code
from sparkloom.plans.answering import _PROFILE
from sparkloom.plans.base import Tables, register
from sparkloom.plans.chunks import _CASES, _REFERENCE, _SCHEDULE, _STATUTE, corpus, named_sql
from sparkloom.plans.code import CODE
from sparkloom.plans.graphs import _split_sql
from sparkloom.plans.questions import DATASET, _q, dataset, full_cases, say_sql
from sparkloom.plans.scoring import query_refs_sql

_FACTS = f"""rel as (select old_act, old_section, new_act, new_section, min(rid) rid from mapping where rid is not null group by all),
news as (select old_act, old_section, list(new_section order by rid) news, string_agg({named_sql(chunks.SHORT, 'new_act')} || ' Section ' || new_section || case when n.title <> '' then ' (' || n.title || ')' else '' end, ', ' order by rid) refs from rel join new_s n on n.act = new_act and n.section = new_section group by 1, 2),
olds as (select new_act, new_section, list(old_section order by regexp_extract(old_section, '^\\d+')::int, old_section) olds from rel group by 1, 2),
facts as (select o.act old_act, o.section old_section, o.title, {named_sql(code.NEW_OF, 'o.act')} new_act, coalesce(w.news, []) news, coalesce(w.refs, '') refs, x.title other, d.olds, lower(o.act || '_' || o.section) node,
  {named_sql(chunks.SHORT, 'o.act')} short, {named_sql(chunks.SHORT, '(' + named_sql(code.NEW_OF, 'o.act') + ')')} as new, {named_sql(chunks.FULL, 'o.act')} as full_old, {named_sql(chunks.FULL, '(' + named_sql(code.NEW_OF, 'o.act') + ')')} as full_new
  from old_s o left join news w on w.old_act = o.act and w.old_section = o.section left join new_s x on x.act = {named_sql(code.NEW_OF, 'o.act')} and x.section = o.section and x.title <> ''
  left join olds d on d.new_act = {named_sql(code.NEW_OF, 'o.act')} and d.new_section = w.news[1] where o.title <> '')"""
_PART = {"short": "short", "new": "new", "title": "title", "refs": "refs", "other": "other", "sec": "old_section", "code": "new_act", "full": "full_old", "into": "full_new", "subject": "lower(title[1]) || title[2:]", "olds": "array_to_string(olds[1:8], ', ')"}
_KEYS = "list_sort(list_distinct(list_concat([node], list_transform(news, lambda s: lower(new_act || '_' || s)))))"


def _kind(kind: str, where: str, question: str, answer: str, order: str | None = None) -> str:
    return f"select '{kind}' mapping_type, old_act, old_section, {say_sql(question, **_PART)} instruction, {answer} output, {_KEYS} group_keys, {order or f'''md5('{kind}' || ':' || old_act || ':' || old_section)'''} as ord from {where}"


_SALIENT = "salient as (select distinct old_act, s from (select old_act, unnest(old_sections) s from cases))"
_VETTED = "vetted as (select ([{}])[p_partkey % 3 + 1] act, (p_partkey // 3 + 1)::varchar || case when p_partkey % 7 = 0 then 'A' else '' end section, p_partkey as row_ from part where p_partkey % 40 = 3)".format(", ".join(f"'{a}'" for a in code.OLD))
_ENTRIES = f"""{_FACTS}, {_SALIENT}, {_VETTED}, entries as ({_kind('collision', "facts where (old_act, old_section) in (select (old_act, s) from salient) and other is not null and not list_contains(news, old_section)", "Does {new} Section {sec} deal with the same subject as {short} Section {sec}?", "case when len(news) > 0 then " + say_sql("No. {short} Section {sec} was {title}. {new} Section {sec} is a different provision entirely - {other}. The provision that now corresponds to {short} Section {sec} is {refs}.", **_PART) + " else " + say_sql("No. {short} Section {sec} was {title}, whereas {new} Section {sec} is {other}, and the old provision has no counterpart in the {code}.", **_PART) + " end")}
union all {_kind('merged', "facts where (old_act, old_section) in (select (old_act, s) from salient) and len(news) = 1 and len(olds) > 1", "Is {subject} still dealt with under {short} Section {sec}?", say_sql("No. The {full} was repealed with effect from 1 July 2024. {short} Section {sec} ({title}) now corresponds to {refs}, which consolidates {short} Sections {olds} into a single provision.", **_PART))}
union all {_kind('split', "facts where len(news) > 1", "Which single {code} section replaced {short} Section {sec}?", say_sql("There is no single one. {short} Section {sec} ({title}) was split across {refs}. Citing only one of them states the position incompletely.", **_PART))}
union all {_kind('removed', "facts join vetted on act = old_act and section = old_section where len(news) = 0", "Which {code} section corresponds to {short} Section {sec}?", say_sql("None. {short} Section {sec} ({title}) has no counterpart in the {into}; the official BPRD correspondence table lists no {code} equivalent for it.", **_PART), "lpad(row_::varchar, 12, '0')")}
union all select 'transition', 'IPC', '1860', {_q(hard.TRANSITION[0])}, {_q(hard.TRANSITION[1])}, ['transition_general_03'], '')"""


def facts(t: Tables) -> DataFrame:
    return hard.facts(code.mapping(t), code.sections(t))


def entries(t: Tables) -> DataFrame:
    salient = code.cases(t).select(F.col("old_act").alias("act"), F.explode("old_sections").alias("section"))
    old = code.old_sections(t).withColumn("row", F.substring_index("source_url", "/", -1).cast("long"))
    return hard.confusions(facts(t), salient, old.where("row % 40 = 3").select("act", "section", "row"))


@register(f"with {CODE}, {_ENTRIES} select mapping_type, old_act, old_section, instruction, output, array_to_string(group_keys, '|') as group_keys from entries")
def confusion_entries(t: Tables) -> DataFrame:
    return entries(t).drop("order").withColumn("group_keys", F.array_join("group_keys", "|"))


_QUOTA = "case mapping_type " + " ".join(f"when '{k}' then {v}" for k, v in hard.CONFUSIONS.items()) + " end"


@register(f"with {CODE}, {_ENTRIES}, r as (select *, row_number() over (partition by mapping_type order by ord, old_act, old_section) r from entries) select mapping_type, old_act, old_section, instruction from r order by r <= {_QUOTA} desc, md5('rest:' || mapping_type || ':' || old_act || ':' || old_section) limit 44")
def confusion_set(t: Tables) -> DataFrame:
    return hard.select_confusions(entries(t)).select("mapping_type", "old_act", "old_section", "instruction")


_GROUPS = """ed as (select lower(old_act || '_' || old_section) a, lower(new_act || '_' || new_section) b from mapping where rid is not null), arc as (select a x, b y from ed union select b, a from ed),
reach as (select x node, x r from arc union select reach.node, arc.y from reach join arc on arc.x = reach.r), grp as (select node, min(r) grp from reach group by 1)"""


def groups(t: Tables) -> DataFrame:
    m = code.mapping(t).where("row is not null")
    edges = m.select(chunks.entity(F.col("old_act"), F.col("old_section")).alias("a"), chunks.entity(F.col("new_act"), F.col("new_section")).alias("b"))
    return graph.components(edges, "a", "b")


_HELD = f"all_grp as (select distinct coalesce(grp, node) g from facts left join grp using (node) union select grp from grp), held as (select g from all_grp where {_split_sql('g')} = 'test')"


def held_out(t: Tables, found: DataFrame) -> DataFrame:
    own = facts(t).select(chunks.entity(F.col("old_act"), F.col("old_section")).alias("node")).join(found, "node", "left").select(F.coalesce("grp", "node").alias("grp"))
    return graph.hash_split(own.union(found.select("grp")).distinct(), "grp", "20240701").where("split = 'test'").select("grp")


_STOP = "['of', 'the', 'a', 'an', 'to', 'for', 'in', 'on', 'or', 'and', 'by', 'with', 'from', 'as', 'at', 'any', 'be', 'is', 'not', 'punishment', 'etc']"
_TW = "list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z]+')), lambda w: not list_contains({s}, w))"
_OVER = f"case when len({_TW.format(x='title', s=_STOP)}) = 0 or len({_TW.format(x='other', s=_STOP)}) = 0 then 0.0 else len(list_intersect({_TW.format(x='title', s=_STOP)}, {_TW.format(x='other', s=_STOP)})) / least(len({_TW.format(x='title', s=_STOP)}), len({_TW.format(x='other', s=_STOP)})) end"
_TAIL = "case when len(news) > 0 then " + say_sql(" The provision that now corresponds to {short} Section {sec} is {refs}.", **_PART) + " else " + say_sql(" {short} Section {sec} has no counterpart in the {code}.", **_PART) + " end"
_VARIANTS = ", ".join([say_sql("Does {new} Section {sec} deal with the same subject as {short} Section {sec}?", **_PART), say_sql("Is {short} Section {sec} the same provision as {new} Section {sec}?", **_PART), say_sql("{short} Section {sec} and {new} Section {sec} - do they cover the same {noun}?", noun="case when old_act = 'IPC' then 'offence' else 'subject' end", **_PART)])
_NEG = f"""{_FACTS}, {_GROUPS}, {_HELD},
f2 as (select *, coalesce(grp, node) g, coalesce(grp, node) in (select g from held) blocked from facts left join grp using (node)),
clash as (select *, case when list_contains(news, old_section) then 'collision: same number IS the counterpart' when {_OVER} > 0.5 then 'collision: titles too similar to call it different' when blocked then 'collision: held-out group' end reason from f2 where other is not null),
n1 as (select 'collision' qa_type, ([{_VARIANTS}])[('0x' || substr(md5('variant:' || node), 1, 8))::bigint % 3 + 1] instruction, {say_sql("No. {short} Section {sec} was {title}, whereas {new} Section {sec} is a different provision entirely - {other}.", **_PART)} || {_TAIL} output, node, g from (select * from clash where reason is null order by md5('collision:' || node), node limit 700)),
n2 as (select 'merged' qa_type, unnest(case when regexp_matches(lower(title[1]) || title[2:], '^(when|same|such|that|which|who|it) ') then [{say_sql("Is the matter dealt with by {short} Section {sec} still governed by that section?", **_PART)}] else [{say_sql("Is {subject} still dealt with under {short} Section {sec}?", **_PART)}] end) instruction,
  {say_sql("No. The {full} was repealed with effect from 1 July 2024. {short} Section {sec} ({title}) now corresponds to {refs}, which consolidates {short} Sections {olds} into a single provision.", **_PART)} output, node, g from (select * from f2 where len(news) = 1 and len(olds) > 1 and not blocked order by md5('merged:' || node), node limit 300)),
into_ as (select d.new_act, d.new_section, d.olds, lower(d.new_act || '_' || d.new_section) node, {named_sql({b: a for a, b in code.NEW_OF.items()}, 'd.new_act')} old_act from olds d where len(olds) > 1),
into2 as (select i.*, coalesce(grp, node) g, coalesce(grp, node) in (select g from held) blocked from into_ i left join grp using (node)),
lst as (select node, string_agg({named_sql(chunks.SHORT, 'x.old_act')} || ' Section ' || s || case when o.title <> '' then ' (' || o.title || ')' else '' end, ', ' order by i) listed from (select node, old_act, unnest(olds[1:8]) s, unnest(range(len(olds[1:8]))) i from into2) x left join old_s o on o.act = x.old_act and o.section = s group by 1),
n3 as (select 'no_single' qa_type, unnest(['Which single ' || {named_sql(chunks.SHORT, 'old_act')} || ' section corresponds to ' || new_act || ' Section ' || new_section || '?', 'Is there one ' || {named_sql(chunks.SHORT, 'old_act')} || ' section that ' || new_act || ' Section ' || new_section || ' replaced?']) instruction,
  'There is no single one. ' || new_act || ' Section ' || new_section || ' (' || title || ') consolidates ' || listed || '. Citing only one of them states the position incompletely.' output, node, g
  from (select i.*, listed, n.title from into2 i join lst using (node) join new_s n on n.act = i.new_act and n.section = i.new_section and n.title <> '' where not blocked order by md5('no_single:' || node), node limit 250))"""


_NEG_DATASET = f"{DATASET}, {_NEG}"


def negations(t: Tables) -> tuple[DataFrame, DataFrame]:
    found = groups(t)
    return hard.negations(facts(t), code.mapping(t), code.sections(t), found, held_out(t, found))


@register(f"with recursive {CODE}, {_NEG} select qa_type, instruction, output, node as source_chunk_id, g as grp from n1 union all select * from n2 union all select * from n3")
def negation_rows(t: Tables) -> DataFrame:
    return negations(t)[0]


@register(f"with recursive {CODE}, {_NEG} select reason, count(*) as n from (select reason from clash where reason is not null union all select 'merged: held-out group' from f2 where len(news) = 1 and len(olds) > 1 and blocked union all select 'no_single: held-out group' from into2 where blocked) group by 1")
def negation_skipped(t: Tables) -> DataFrame:
    return negations(t)[1]


@register(
    f"""with recursive {CODE}, {_NEG}, rows_ as (select qa_type, instruction, g from n1 union all select qa_type, instruction, g from n2 union all select qa_type, instruction, g from n3)
select 'held_out_group' as "check", count(*) as n_bad from rows_ where g in (select g from held) union all select 'opens_without_negation', count(*) from (select output from n1 union all select output from n2 union all select output from n3) where not regexp_matches(lower(substr(output, 1, 60)), 'no\\.|no,|none|no single|not ') union all select 'repeated_question', count(*) - count(distinct instruction) from rows_"""
)
def validate_negation(t: Tables) -> DataFrame:
    """Rows of blocked groups, answers that do not open with a negation, repeated questions."""
    found = groups(t)
    held = held_out(t, found)
    rows = hard.negations(facts(t), code.mapping(t), code.sections(t), found, held)[0]
    out = [
        rows.join(held, "grp", "left_semi").agg(F.lit("held_out_group").alias("check"), F.count("*").alias("n_bad")),
        rows.agg(F.lit("opens_without_negation").alias("check"), F.count_if(~opens_with(F.col("output"), ["no.", "no,", "none", "no single", "not "])).alias("n_bad")),
        rows.agg(F.lit("repeated_question").alias("check"), (F.count("*") - F.count_distinct("instruction")).alias("n_bad")),
    ]
    return reduce(DataFrame.unionByName, out)


_GROUNDED = """base as (select family || ':' || seq seq, instruction, output, qa_type, source_chunk_id from qa),
cdocs as (select chunk_id, source_url, text from statute union all select chunk_id, source_url, text from sched_all union all select chunk_id, source_url, text from case_rows union all select chunk_id, source_url, text from reference),
by_doc as (select 'case_' || regexp_extract(source_url, '/doc/([0-9]+)', 1) d, chunk_id case_chunk from cdocs where regexp_extract(source_url, '/doc/([0-9]+)', 1) <> ''), cids as (select distinct chunk_id from cdocs),
tg as (select seq qid, instruction question, output, qa_type, case when qa_type = 'scope' then null when qa_type = 'transition' then 'transition_commencement' when starts_with(source_chunk_id, 'case_') then case_chunk
  when qa_type = 'offence_classification' and one.chunk_id is not null then one.chunk_id when two.chunk_id is not null then two.chunk_id end target
  from base left join by_doc on d = source_chunk_id left join cids one on one.chunk_id = 'schedule_' || source_chunk_id left join cids two on two.chunk_id = source_chunk_id),
rk as (select *, row_number() over (order by md5('deal:' || qid), qid) r, count(*) over () n from tg),
dl as (select *, case when r <= floor(n * 0.7) and target is null then case when ('0x' || substr(md5('deal:' || qid), 1, 8))::bigint < 0.67 * 4294967296.0 then 'distractor' else 'none' end when r <= floor(n * 0.7) then 'positive' when r <= floor(n * 0.7) + floor(n * 0.2) then 'distractor' else 'none' end condition from rk)"""
_FULL = f"{DATASET}, {_STATUTE}, {_SCHEDULE}, {_REFERENCE}"


def _grounded(t: Tables) -> DataFrame:
    """The questions of all families with the chunk that grounds each answer and the condition that it is dealt. Questions and
    their ranks are made once a query."""
    ranked = t.once("grounded", lambda: _ranked(t))
    return hard.dealt(ranked, ranked.count(), "deal")


def _docs(t: Tables) -> DataFrame:
    """chunk_id, source_url, text of the corpus, made once a query."""
    return t.once("docs", lambda: corpus(t).select("chunk_id", "source_url", "text"))


def _ranked(t: Tables) -> DataFrame:
    rows = dataset(t).select(F.concat_ws(":", F.col("family").cast("string"), "seq").alias("qid"), F.col("instruction").alias("question"), "output", "qa_type", "source_chunk_id")
    met = hard.grounding(rows, _docs(t).select("chunk_id", "source_url")).withColumn("h", F.md5(F.concat(F.lit("deal:"), "qid")))
    return global_rank(met, ["h", "qid"], "r").drop("h")


@register(f"with {_FULL}, {_GROUNDED} select qid, coalesce(target, '') as target, condition from dl")
def context_deal(t: Tables) -> DataFrame:
    return _grounded(t).select("qid", F.coalesce("target", F.lit("")).alias("target"), "condition")


#: Chunks that a search gives a question, and the share of the chunks beyond which ``context_crosstab`` and ``recall_by_kind`` do not
#: search for a word.
FOUND, COMMON = 12, 0.05
_CHITS = "asked_c as (select qid, question from dl where condition <> 'none'), {}"
_PLACED = f"""ky as (select chunk_id, upper(regexp_replace(regexp_replace(chunk_id, '^schedule_', ''), '_', ' ')) ref from cdocs where regexp_matches(chunk_id, '(?i)^(schedule_)?(bns|bnss|bsa|ipc|crpc|iea)_\\d+[a-z]{{0,2}}$')),
lx as (select o ref, n other, rid from lk union all select n, o, rid from lk), ox as (select ref, other, row_number() over (partition by ref order by rid) - 1 j from lx),
rf as (select *, {query_refs_sql('question')} refs, {query_refs_sql('output')} orefs from dl where condition <> 'none'), nx as (select qid, unnest(refs) ref, unnest(range(len(refs))) i from rf),
px as (select qid, chunk_id, 1 lv, i, 0 j from nx join ky using (ref) union all select qid, chunk_id, 2, i, j from nx join ox using (ref) join ky k on k.ref = ox.other
union all select c.qid, c.chunk_id, 3, rank, 0 from chits c join dl using (qid) where c.chunk_id in (select chunk_id from cdocs) and ((condition = 'positive' and rank < 3) or condition = 'distractor')),
bn as (select qid, chunk_id from (select qid, unnest(orefs) ref from rf where condition = 'distractor') join ky using (ref) union select qid, target from rf where condition = 'distractor' and target is not null),
ux as (select qid, chunk_id, min((lv, i, j)) o from px group by 1, 2), vx as (select qid, list(chunk_id order by o, chunk_id) ids from ux where (qid, chunk_id) not in (select (qid, chunk_id) from bn) group by 1),
wx as (select dl.*, coalesce(ids, []) ids, list_filter(coalesce(ids, []), lambda x: x <> target) rest from dl left join vx using (qid)),
yx as (select *, ('0x' || substr(md5('slot:' || qid), 1, 8))::bigint % (least(len(rest), 3) + 1) slot from wx),
zx as (select qid, condition, target, (case when condition = 'positive' and not list_contains(ids[1:4], target) then list_concat(list_concat(rest[1:slot], [target]), rest[slot + 1:]) else ids end)[1:4] ids from yx)"""


def _ctx(share: float) -> str:
    return f"{_CHITS.format(lexical.bm25_sql('cdocs', 'asked_c', FOUND, share, 'chits'))}, {_PLACED}"


_CTX = _ctx(COMMON)


@register(f"with {_FULL}, {_PROFILE}, {_GROUNDED}, {_ctx(1.0)} select qid, case when condition = 'distractor' and len(ids) = 0 then 'none' else condition end as context_type, array_to_string(ids, ',') as ids, coalesce(list_contains(ids, target), false) as gold_in_context from zx")
def context_rows(t: Tables) -> DataFrame:
    """Contexts of all questions, out of what a search for all their words finds."""
    return contexts(t, 1.0)


def contexts(t: Tables, share: float) -> DataFrame:
    """Contexts of all questions; words of over this share of the chunks are not searched for."""
    rows = _grounded(t).select("qid", "question", "output", "target", "condition")
    docs = _docs(t).select("chunk_id", "text")
    hits = lexical.search(lexical.index(docs, share), rows.where("condition <> 'none'").select("qid", "question"), FOUND).select("qid", "chunk_id", "rank")
    out = hard.context_rows(rows, docs.select("chunk_id"), answers.counterparts(code.mapping(t)), hits)
    return out.withColumn("ids", F.array_join("ids", ","))


_RECALL_KINDS = ["section_text", "old_to_new", "offence_classification"]
_RECALL = f"""rq_ as (select qid, question, qa_type kind, target from dl where qa_type in ({', '.join(f"'{k}'" for k in _RECALL_KINDS)}) and target is not null), {lexical.bm25_sql('cdocs', 'rq_', 5, COMMON, 'rhits')},
pos as (select kind, coalesce(rank + 1, 99) p from rq_ left join rhits on rhits.qid = rq_.qid and chunk_id = target)"""


@register(f"with {_FULL}, {_GROUNDED}, {_RECALL} select kind, round(100 * avg((p <= 1)::int), 4) as r1, round(100 * avg((p <= 3)::int), 4) as r3, round(100 * avg((p <= 5)::int), 4) as r5, count(*) as n, 100 * avg((p <= 3)::int) >= 80 as passed from pos group by rollup (kind)")
def recall_by_kind(t: Tables) -> DataFrame:
    """How often a search finds the chunk that grounds a question's answer among the first 1, 3 and 5, by kind of question and
    for all (kind null), and whether the kind would pass the gate of 80 percent among three."""
    rows = cut(_grounded(t).where(F.col("qa_type").isin(_RECALL_KINDS) & F.col("target").isNotNull()).select("qid", "question", F.col("qa_type").alias("kind"), F.col("target").alias("pid")))
    hits = lexical.search(lexical.index(_docs(t).select("chunk_id", "text"), COMMON), rows, 5)
    found = retrieval.recall(hits.select("qid", F.col("chunk_id").alias("pid"), "rank"), rows.select("qid", "pid", "kind"))
    return found.select("kind", "r1", "r3", "r5", "n", (F.col("r3") >= 80).alias("passed"))


@register()
def greedy_split(t: Tables) -> DataFrame:
    """Groups to splits by the kinds of rows that they hold: sequential, over one row a group and kind, which are as many
    as the provisions, not as the rows. tests compare it with a plain walk."""
    m = code.mapping(t)
    rows = reduce(DataFrame.unionByName, (qa.old_to_new(m), qa.new_to_old(m), qa.case_law(full_cases(t)))).select("qa_type", "source_chunk_id")
    found = groups(t)
    counts = rows.join(found.withColumnRenamed("node", "source_chunk_id").hint("merge"), "source_chunk_id", "left").groupBy(F.coalesce("grp", "source_chunk_id").alias("grp"), "qa_type").agg(F.count("*").alias("n"))
    return splits.assigned(counts)
