"""Citations, scores and their summaries, agreement of two systems, over questions and answers of the code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import refs, text
from sparkloom.operators import metrics, qa
from sparkloom.plans import code
from sparkloom.plans.base import Tables, register
from sparkloom.plans.code import CODE
from sparkloom.plans.questions import DATASET, dataset, say_sql
from sparkloom.plans.texts import _METRIC

_ALIASES = "bharatiya nagarik suraksha sanhita|code of criminal procedure|bharatiya sakshya adhiniyam|bharatiya nyaya sanhita|indian evidence act|indian penal code|evidence act|cr\\.p\\.c|bnss|crpc|bns|bsa|ipc|iea"
_S, _D = r"[\s\x1c-\x1f\x{85}\p{Z}]", r"\p{Nd}"
_NUMS = rf"{_D}+[A-Za-z]{{0,2}}(?:{_S}*(?:,|and|&){_S}*{_D}+[A-Za-z]{{0,2}})*"
_CANON = """case lower({x}) when 'bharatiya nyaya sanhita' then 'BNS' when 'bharatiya nagarik suraksha sanhita' then 'BNSS' when 'bharatiya sakshya adhiniyam' then 'BSA' when 'indian penal code' then 'IPC' when 'code of criminal procedure' then 'CRPC' when 'cr.p.c' then 'CRPC' when 'indian evidence act' then 'IEA' when 'evidence act' then 'IEA' else upper({x}) end"""
_PARTS = "list_filter(list_transform(regexp_split_to_array({{x}}, '{s}*(?:,|and|&){s}*'), lambda v: upper(regexp_replace(v, '^{s}+|{s}+$', '', 'g'))), lambda v: regexp_full_match(v, '{d}+[A-Z]{{{{0,2}}}}') and translate(regexp_extract(v, '^{d}+'), '०१२३४५६७८९', '0123456789')::double < 1000)".format(s=_S.replace("{", "{{").replace("}", "}}"), d=_D.replace("{", "{{").replace("}", "}}"))


def _pairs_sql(t: str, pattern: str, act: int, nums: int) -> str:
    return f"flatten(list_transform(list_zip(regexp_extract_all({t}, '{pattern}', {act}), regexp_extract_all({t}, '{pattern}', {nums})), lambda z: list_transform({_PARTS.format(x='z[2]')}, lambda n: {_CANON.format(x='z[1]')} || ' ' || n)))"


_FIRST = rf"(?i)({_ALIASES})\b[ ,]*(?:{_D}{{4}}[ ,]*)?(?:Sections?|ss?\.)?{_S}*({_NUMS})"
_LAST = rf"(?i)Sections?{_S}*({_NUMS})(?:{_S}*\([0-9a-z]+\))*{_S}*(?:of{_S}+(?:the{_S}+)?)({_ALIASES})\b"
_LAST_PLAIN = rf"(?i)Sections?{_S}*({_NUMS}){_S}*(?:of{_S}+(?:the{_S}+)?)({_ALIASES})\b"


def refs_sql(t: str) -> str:
    return f"list_sort(list_distinct(list_concat({_pairs_sql(t, _FIRST, 1, 2)}, {_pairs_sql(t, _LAST, 2, 1)})))"


def query_refs_sql(t: str) -> str:
    strict = f"list_sort(list_distinct(list_concat({_pairs_sql(t, _FIRST, 1, 2)}, {_pairs_sql(t, _LAST_PLAIN, 2, 1)})))"
    acts = rf"list_distinct(list_transform(regexp_extract_all({t}, '(?i)\b({_ALIASES})\b', 1), lambda y: {_CANON.format(x='y')}))"
    bare = rf"flatten(list_transform(regexp_extract_all({t}, '(?i)\bSections?{_S}*({_NUMS})', 1), lambda w: {_PARTS.format(x='w')}))"
    return f"case when len({strict}) = 0 and len({acts}) = 1 then list_sort(list_distinct(list_transform({bare}, lambda n: {acts}[1] || ' ' || n))) else {strict} end"


#: Sentences that cite in every form that the grammar knows, and in forms that it does not.
CITING = [
    "IPC Section {a} corresponds to BNS Section {b}.",
    "the Indian Penal Code, 1860, Section {a}; Indian Penal Code 1860 Section {b}",
    "under Section {a}(2)(a) of the Bharatiya Nyaya Sanhita, 2023 or section {b} of BSA",
    "IPC ss. {a}, {b}",
    "BNS {a} or {b}",
    "Section 65B of the Indian Evidence Act, 1872 and CrPC {a}, Cr.P.C {b}",
    "IPC Sections {a}, {b} and {a}A & {b}b; The Bharatiya Nyaya Sanhita, 2023 replaced it.",
    "Under the Indian Penal Code, 1860, what is provided by Section {a}?",
    "sections {a}, {b} and {a}a IPC. The code of criminal procedure, section {b}, IEA 12 AND 13",
    "Section\u00a0{a}\u00a0of\u2009the\u00a0BNS, IPC\u2003{b}\u3000and\u2028{a}A; BSA\u00a0Section\u202f{b}",
    "IPC \u0969\u0966\u0968, section {a}\u00a0of the IPC and BNS \u0968\u0966\u0968\u0969",
]


def _citing(t: Tables) -> DataFrame:
    part = {"a": F.col("o_orderkey") % 600, "b": F.col("o_custkey") % 350}
    kinds = F.array(*(qa.say(s, **part) for s in CITING))
    return t.orders.select(F.col("o_orderkey").alias("k"), F.get(kinds, (F.col("o_orderkey") % len(CITING)).cast("int")).alias("t"))


_CITING = "c as (select o_orderkey k, ([" + ", ".join(say_sql(s, a="o_orderkey % 600", b="o_custkey % 350") for s in CITING) + f"])[o_orderkey % {len(CITING)} + 1] t from orders)"


@register(f"with {_CITING} select k, array_to_string({refs_sql('t')}, ',') as refs, array_to_string({query_refs_sql('t')}, ',') as query_refs from c")
def refs_extract(t: Tables) -> DataFrame:
    return _citing(t).select("k", F.array_join(refs.extract_refs(F.col("t")), ",").alias("refs"), F.array_join(refs.query_refs(F.col("t")), ",").alias("query_refs"))


_CHUNK_IDS = "select item_id, (['bns_' || item_id, 'schedule_BNS_' || item_id || 'a', 'case_' || item_id, 'crpc_' || item_id || 'abc', 'transition_commencement'])[item_id % 5 + 1] id from benchmark"


@register(rf"with i as ({_CHUNK_IDS}) select item_id, case when regexp_matches(id, '(?i)^(schedule_)?(bns|bnss|bsa|ipc|crpc|iea)_\d+[a-z]{{0,2}}$') then upper(regexp_replace(regexp_replace(id, '(?i)^schedule_', ''), '_', ' ')) end as ref from i")
def chunk_refs(t: Tables) -> DataFrame:
    k = F.col("item_id").cast("string")
    ids = F.array(F.concat(F.lit("bns_"), k), F.concat(F.lit("schedule_BNS_"), k, F.lit("a")), F.concat(F.lit("case_"), k), F.concat(F.lit("crpc_"), k, F.lit("abc")), F.lit("transition_commencement"))
    return t.benchmark.select("item_id", refs.chunk_ref(F.get(ids, (F.col("item_id") % 5).cast("int"))).alias("ref"))


#: Damaged strings as bytes would leave them, and fragments of pages.
DAMAGED = ["a\x18b\x1cc\x1fd", "It\x12s \x13so\x14 \x16 said\x17 he \x05", "x\x01y\x0fz\x10w\x1d", " one   two\t\n \n\n  three “four” —— ’", "\x00\x02\x03\x04\x06\x07\x08\x0b\x0c\x0e", "\x11\x15\x19\x1a\x1b\x1e", ""]
REPAIRED = ["a˜bœcŸd", "It's \"so\" – said— he …", "xyzw", "one two\nthree \"four\" — '", "€‚ƒ„†‡ˆ‹ŒŽ", "'•™š›ž", ""]
MARKUP = ["a<script>x < y</script>b<style type='t'>q</style>c", "<p>caf&eacute; &hellip; &#8364; &#x2014; &amp;lt;</p><div>two</div>", "<ol><li>one</li><LI class='x'>two</ol>three<br/>four<br >five", "<h2>head</h2>x<b>bold</b>y&nbsp;&nbsp;z"]
STRIPPED = ["a b c", "café … € — &lt;\ntwo", "- one\n- two\nthree\nfour\nfive", "head\nxboldy z"]


def _literal(rows: list[str], kind: str) -> str:
    return " union all ".join(f"select '{kind}' as kind, {i} as k, {' || '.join(f'chr({ord(c)})' for c in x) or chr(39) * 2} as text" for i, x in enumerate(rows))


@register(_literal(REPAIRED, "clean") + " union all " + _literal(STRIPPED, "strip"))
def damaged_rows(t: Tables) -> DataFrame:
    """Literal rows whose repaired form is written out in the SQL."""
    make = lambda rows, kind, f: t.spark.createDataFrame(list(enumerate(rows)), "k int, t string").select(F.lit(kind).alias("kind"), "k", f(F.col("t")).alias("text"))
    return make(DAMAGED, "clean", text.clean_text).unionByName(make(MARKUP, "strip", text.strip_html))


_SAID = "said as (select qa_type kind, instruction q, output gold, (length(instruction) + length(output)) % 5 m from qa)"
_SYSTEMS = f"""{_SAID}, sys as (select *, case m when 0 then 'I do not know.' when 1 then replace(gold, 'Section 1', 'Section 2') when 2 then gold || ' See also IPC 302.' when 3 then '' else gold end pred, case when m = 1 then 'IPC 1' when m = 2 then gold when m = 3 then upper(gold) else split_part(gold, '. ', 1) end pred2 from said)"""
_SCORED = f"""{_SYSTEMS}, w as (select *, {_METRIC.format(c='pred')} p, {_METRIC.format(c='gold')} g, {refs_sql('pred')} pr, {refs_sql('gold')} gr from sys),
c as (select *, list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(g, lambda y: y = x))))) both_words, len(list_intersect(pr, gr)) hits from w),
scored as (select kind, q, (p = g)::int::double em, case when len(p) = 0 or len(g) = 0 then (len(p) = len(g))::int::double else 2.0 * coalesce(both_words, 0) / (len(p) + len(g)) end f1,
case when len(pr) > 0 then hits / len(pr) when len(gr) = 0 then 1.0 else 0.0 end cite_p, case when len(gr) > 0 then hits / len(gr) else 1.0 end cite_r, (hits = len(gr))::int::double cite_all, (pr = gr)::int::double cite_exact, len(gr) > 0 has_refs, m from c)"""


def _systems(t: Tables) -> DataFrame:
    """Answers of two systems to every question of all families."""
    rows = dataset(t).select(F.col("qa_type").alias("kind"), F.col("instruction").alias("q"), F.col("output").alias("gold"))
    gold, k = F.col("gold"), (F.length("q") + F.length("gold")) % 5
    pred = F.when(k == 0, "I do not know.").when(k == 1, F.replace(gold, F.lit("Section 1"), F.lit("Section 2"))).when(k == 2, F.concat(gold, F.lit(" See also IPC 302."))).when(k == 3, "").otherwise(gold)
    other = F.when(k == 1, "IPC 1").when(k == 2, gold).when(k == 3, F.upper(gold)).otherwise(F.split_part(gold, F.lit(". "), F.lit(1)))
    return rows.select("kind", "q", "gold", k.alias("m"), pred.alias("pred"), other.alias("pred2"))


_ROUND = ["em", "f1", "cite_p", "cite_r", "cite_all", "cite_exact"]


@register(f"with {DATASET}, {_SCORED} select kind, q, {', '.join(f'round({c}, 9) as {c}' for c in _ROUND)}, has_refs from scored")
def citation_metrics(t: Tables) -> DataFrame:
    return metrics.score(_systems(t)).select("kind", "q", *(F.round(c, 9).alias(c) for c in _ROUND), "has_refs")


_AVG = "round(100 * avg({c}) filter (where has_refs), 6)"
_P, _R = (f"(100 * avg({c}) filter (where has_refs))" for c in ("cite_p", "cite_r"))


@register(f"with {DATASET}, {_SCORED} select kind, count(*) as n, round(100 * avg(em), 6) as exact_match, round(100 * avg(f1), 6) as f1, round(case when {_P} + {_R} > 0 then 2 * {_P} * {_R} / ({_P} + {_R}) when {_P} + {_R} = 0 then 0.0 end, 6) as citation_f1, {_AVG.format(c='cite_all')} as all_citations_present, {_AVG.format(c='cite_exact')} as citation_exact, count_if(has_refs) as n_with_citations from scored group by rollup (kind)")
def metric_summary(t: Tables) -> DataFrame:
    out = metrics.summarise(metrics.score(_systems(t)), ["kind"])
    return out.select("kind", "n", *(F.round(c, 6).alias(c) for c in ("exact_match", "f1", "citation_f1", "all_citations_present", "citation_exact")), "n_with_citations")


_VERDICT = f"""v as (select kind, len(list_intersect({refs_sql('gold')}, {refs_sql('pred')})) = len({refs_sql('gold')}) a, len(list_intersect({refs_sql('gold')}, {refs_sql('pred2')})) = len({refs_sql('gold')}) b from sys where len({refs_sql('gold')}) > 0)"""


@register(f"with {DATASET}, {_SYSTEMS}, {_VERDICT} select kind, count(*) as n, count_if(a and b) as both, count_if(a and not b) as first_only, count_if(b and not a) as second_only, count_if(not a and not b) as neither, count_if(a or b) as at_least_one, count_if(a <> b) as disagree from v group by rollup (kind)")
def verdict_by_kind(t: Tables) -> DataFrame:
    return metrics.agreement(metrics.verdicts(_systems(t), "gold", "pred", "pred2"), "kind")


_GAINED = f"""cond as (select kind, unnest(['none', 'retrieved', 'gold']) condition, unnest(['I do not know.', pred, pred2]) pred, gold from sys), cw as (select kind, condition, {_METRIC.format(c='pred')} p, {_METRIC.format(c='gold')} g from cond),
cb as (select *, list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(g, lambda y: y = x))))) both_words from cw),
cf as (select kind, condition, case when len(p) = 0 or len(g) = 0 then (len(p) = len(g))::int::double else 2.0 * coalesce(both_words, 0) / (len(p) + len(g)) end f1 from cb),
x as (select kind, 100 * avg(f1) filter (where condition = 'none') as none, 100 * avg(f1) filter (where condition = 'retrieved') as retrieved, 100 * avg(f1) filter (where condition = 'gold') as gold from cf group by 1)"""


@register(f"with {DATASET}, {_SYSTEMS}, {_GAINED} select kind, round(none, 6) as none, round(retrieved, 6) as retrieved, round(gold, 6) as gold, round(retrieved - none, 6) as gain, round(gold - retrieved, 6) as ceiling from x")
def gain_and_ceiling(t: Tables) -> DataFrame:
    """Every question under all three conditions: what retrieval gains, and what it could gain at most."""
    said = F.inline(F.array(*(F.struct(F.lit(c).alias("condition"), p.alias("pred")) for c, p in (("none", F.lit("I do not know.")), ("retrieved", F.col("pred")), ("gold", F.col("pred2"))))))
    answered = _systems(t).select("kind", "q", "gold", F.col("pred"), F.col("pred2")).select("kind", "q", "gold", said)
    out = metrics.gains(metrics.score(answered).select("kind", "condition", "f1"), "kind", value="f1")
    return out.select("kind", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@register(f"with {DATASET}, {_SCORED} select kind, q, round(f1, 9) as f1 from scored order by f1, q limit 5")
def worst_rows(t: Tables) -> DataFrame:
    scored = metrics.score(_systems(t)).select("kind", "q", F.round("f1", 9).alias("f1"))
    return metrics.worst(scored, "f1", "q")


@register(f"with {DATASET}, {_SAID} select kind, count(*) as n, max(length(q)) as longest_source, count_if(length(q) > 60) as sources_over, max(length(gold)) as longest_target, count_if(length(gold) > 320) as targets_over from said group by 1")
def length_report(t: Tables) -> DataFrame:
    """Rows over a limit on either side."""
    q, g = F.length("q"), F.length("gold")
    return _systems(t).groupBy("kind").agg(F.count("*").alias("n"), F.max(q).cast("long").alias("longest_source"), F.count_if(q > 60).alias("sources_over"), F.max(g).cast("long").alias("longest_target"), F.count_if(g > 320).alias("targets_over"))
