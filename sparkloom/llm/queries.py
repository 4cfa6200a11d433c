"""The queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import centroids, decontaminate, divergence, html_extract, lattice_lm, license_scan, line_templates, ngram_join, quality, sentencepiece_codec, shards, suffix_dedup, warc
from sparkloom.llm.common import table

#: Where the public tokenizer's model lies; every operator takes the path as a parameter.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.pages_to_responses(table(spark, sf_dir, "pages")))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_texts(table(spark, sf_dir, "documents"), PIECES)


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines_dropped")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("n_spans", F.size("spans").cast("long"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h")


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measured(table(spark, sf_dir, "documents"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op9_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_texts(table(spark, sf_dir, "documents"), PIECES)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_links")


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_report(table(spark, sf_dir, "embeddings"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_places(table(spark, sf_dir, "documents"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact part of op5 by itself, which SQL can express."""
    return op5_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counted part of op9 by itself, which SQL can express."""
    return op9_lattice_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc_derivatives, op2_sentencepiece, op3_line_templates, op4_suffix_dedup, op5_license_scan, op6_decontaminate, op7_quality_cascade, op8_html_extract, op9_lattice_lm, op10_ngram_join, op11_source_audit, op12_sort_means, op13_sharding, license_base, lm_base)
}

_WORD = r"[^\x20\x09-\x0D]+"



def _means_sql(k: int = 16, rounds: int = 3) -> str:
    """Plain k-means: every vector against every centroid in every round."""
    steps = [f"""with v as (select row_number() over () r, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) x from embeddings
  where len(embedding) = 64 and not list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)),
c0 as (select row_number() over (order by sha256('1:' || coalesce(vec_id::varchar, '')), x) - 1 k, x c from v qualify k < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} as (select r, any_value(vec_id) vec_id, any_value(x) x, arg_min(k, (d, k)) k, min(d) d
  from (select r, vec_id, x, k, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint d from v, c{i}) group by r)""")
        if i < rounds:
            steps.append(f"""m{i} as (select k, list(f order by j) c from (select k, j, ((sum(y) - ((sum(y) % count(*)) + count(*)) % count(*)) // count(*))::bigint f from (select k, unnest(x) y, unnest(range(64)) j from a{i}) group by 1, 2) group by 1),
c{i + 1} as (select k, coalesce(m{i}.c, c{i}.c) c from c{i} left join m{i} using (k))""")
    return ",\n".join(steps) + f"""
select a.vec_id, a.k::int as cluster, a.d as distance, (sum(a.d) over (partition by a.k))::bigint as cluster_inertia, (sum(a.d) over ())::bigint as inertia, sha256(array_to_string(c.c, ',')) as centroid_sha256 from a{rounds} a join c{rounds} c using (k)"""


ORACLES: dict[str, str] = {
    "op7_quality_cascade": rf"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') t from documents),
w as (select r, doc_id, t, regexp_extract_all(t, '{_WORD}') w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) l from d),
g as (select r, unnest(range(1, len(w) - 3)) i, w from w where len(w) >= 5),
h as (select r, i, array_to_string(w[i:i+4], ' ') g from g),
k as (select r, i, count(*) over (partition by r, g) c from h),
p as (select r, i, i - lag(i) over (partition by r order by i) gap from k where c > 1),
q as (select r, cast(sum(least(5, coalesce(gap, 5))) as bigint) n from p group by r),
m as (select doc_id, cast(len(w) as bigint) n_words, cast(length(array_to_string(w, '')) as bigint) word_chars,
  cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) n_symbols,
  cast(len(l) - len(list_distinct(l)) as bigint) n_dup_lines, coalesce(q.n, 0) n_repeat_words, len(l) n_lines,
  length(regexp_replace(t, '[^\p{{L}}\p{{M}}]+', '', 'g')) n_letters, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) n_capitals
  from w left join q using (r)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not (10 * n_symbols > 3 * n_words or word_chars > 20 * n_words or word_chars < 2 * n_words
    or 2 * n_dup_lines > n_lines or 2 * n_letters < word_chars or 10 * n_capitals > 7 * n_letters) kept
from b""",
    "license_base": r"""
with d as (select row_number() over () r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
w as (select r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from d),
p as (select r, doc_id, w, list_filter(range(1, len(w) + 1), lambda i: w[i:i+3] = ['under', 'the', 'mit', 'license']) a,
  list_filter(range(1, len(w) + 1), lambda i: w[i:i+3] = ['apache', 'license', 'version', '2']) b, list_filter(range(1, len(w) + 1), lambda i: w[i:i+2] = ['cc', 'by', 'nc']) c from w)
select doc_id, cast(len(w) as bigint) n_words, cast(len(a) + len(b) + len(c) as bigint) n_base, list_min(list_concat(a, b, c)) - 1 first_word, list_max(list_concat(a, b, c)) - 1 last_word,
  array_to_string(list_filter([case when len(b) > 0 then 'apache-2' end, case when len(c) > 0 then 'cc-by-nc' end, case when len(a) > 0 then 'mit' end], lambda x: x is not null), ',') base_labels from p""",
    "op10_ngram_join": r"""
with recursive d as (select row_number() over () r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') w from documents),
g as (select distinct r, gram from (select r, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i+4], ' '))) gram from d where len(w) > 0)),
n as (select r, count(*) n from g group by 1),
c as (select a.r x, b.r y, count(*) c from g a join g b on a.gram = b.gram and a.r < b.r group by 1, 2),
l as (select x, y from c join n a on a.r = x join n b on b.r = y where c >= 0.8 * (a.n + b.n - c) - 1e-9),
e as (select x, y from l union all select y, x from l),
k as (select r, r root from d union select k.r, e.y from k join e on e.x = k.root),
m as (select r, min(root) root from k group by 1), s as (select m.root, min(doc_id) class_id, count(*) class_size from m join d using (r) group by 1)
select d.doc_id, s.class_id, s.class_size, cast(coalesce(f.f, 0) as bigint) n_links from d join m using (r) join s using (root) left join (select x, count(*) f from e group by 1) f on f.x = d.r""",
    "op3_line_templates": r"""
with d as (select row_number() over () r, doc_id, text from documents),
l as (select r, text h, pos, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) raw, whole from (select r, text, unnest(string_split(text, chr(10))) whole, unnest(range(len(string_split(text, chr(10))))) pos, unnest(string_split(text, chr(10))) raw from d)),
m as (select *, regexp_replace(raw, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g') line from l),
w as (select *, regexp_split_to_array(line, '[\x20\x09-\x0D]+') w from m where raw <> ''),
v as (select *, len(w) || ' ' || array_to_string(w[1:3], ' ') leaf from w),
counted as (select leaf, line, any_value(w) w, count(distinct h) docs from v group by 1, 2),
crowded as (select leaf from counted group by 1 having sum(docs) >= 20 and count(*) > 1),
c as (select * from counted where leaf in (select leaf from crowded)),
x as (select leaf, line, docs, unnest(w) word, unnest(range(len(w))) place from c),
fixed as (select leaf, place, word, coalesce(sum(docs) filter (where docs < 20), 0) >= 20 rare from x where word <> '<*>' group by 1, 2, 3 having sum(docs) >= 20),
p as (select x.leaf, x.line, x.docs, list(f.place || ':' || f.word) filter (where f.word is not null) has, list(f.place || ':' || f.word) filter (where f.rare) own, count(*) n from x left join fixed f using (leaf, place, word) group by 1, 2, 3),
q as (select * from p where len(has) >= ceil(0.7 * n)),
t as (select distinct leaf, list_sort(has) t from q where len(has) < n union select distinct leaf, list_sort(own) from q where docs < 20 and len(own) >= ceil(0.7 * n) and len(own) < n),
pair as (select q.leaf, q.line, q.docs, t.t from q join t on t.leaf = q.leaf and list_has_all(q.has, t.t)),
grown as (select pair.leaf, pair.t from pair join v on v.leaf = pair.leaf and v.line = pair.line group by 1, 2 having count(distinct v.h) >= 20),
gone as (select leaf, line from counted where docs >= 20 union select leaf, line from pair join grown using (leaf, t) where docs < 20),
k as (select l.r, l.pos, l.whole, g.line is not null cut from l left join v using (r, pos) left join gone g on g.leaf = v.leaf and g.line = v.line)
select d.doc_id, case when d.text is null then null else coalesce(string_agg(k.whole, chr(10) order by k.pos) filter (where not k.cut), '') end as text, cast(count(*) filter (where k.cut) as bigint) n_lines_dropped from d left join k using (r) group by d.r, d.doc_id, d.text""",
    "op4_suffix_dedup": """
with d as (select row_number() over () r, doc_id, hex(encode(coalesce(text, ''))) x from documents),
w as (select r, i, md5(x[2 * i + 1 : 2 * i + 400]) k from (select r, x, unnest(range(0, length(x) // 2 - 199)) i from d where length(x) >= 400)),
t as (select r, i from w qualify count(*) over (partition by k) > 1),
g as (select r, i, i - lag(i) over (partition by r order by i) gap from t),
b as (select r, i, sum(case when gap <= 200 then 0 else 1 end) over (partition by r order by i) b from g),
s as (select r, min(i) a, max(i) + 200 e from b group by r, b),
c as (select r, a, e, coalesce(lag(e) over (partition by r order by a), 0) p from s),
k as (select d.r, sum(e - a) n_removed, count(*) n_spans, string_agg(x[2 * p + 1 : 2 * a], '' order by a) || any_value(x)[2 * max(e) + 1 :] kept from c join d using (r) group by 1)
select doc_id, cast(length(x) // 2 as bigint) n_bytes, cast(coalesce(n_removed, 0) as bigint) n_removed, cast(coalesce(n_spans, 0) as bigint) n_spans, sha256(unhex(coalesce(kept, x))) kept_sha256 from d left join k using (r)""",
    "op11_source_audit": r"""
with d as (select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w from documents),
t as (select r, lang, source, unnest(w) term from d),
k as (select lang, term, count(*)::hugeint n from t group by 1, 2 having count(distinct r) >= 3),
c as (select lang, source, term, count(*)::hugeint n from t semi join k using (lang, term) group by 1, 2, 3),
l as (select lang, count(*)::hugeint v, sum(n) n_all from k group by 1),
g as (select lang, source, coalesce(v, 0) v, coalesce(x.n_all, 0) n_all, coalesce(l.n_all, 0) lang_all
  from (select distinct lang, source from d) left join (select lang, source, sum(n) n_all from c group by 1, 2) x using (lang, source) left join l using (lang)),
s as (select g.lang, g.source, k.term, coalesce(c.n, 0) n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (g.n_all + g.v) p, 1 + 1000000000 * (k.n + 1) // (g.lang_all + g.v) q
  from g join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pairs as (select a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p) f from s a join s b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
found as (select a.lang, a.source, 'pair' part, b.source item, coalesce(pairs.f, 0) f from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
  union all select lang, source, 'term', term, (p - q) * (p - q) // q from s where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by f desc, item) n from found)
select lang, source, part, item, f::bigint as value, n::int as rank from ranked where part = 'pair' or n <= 200""",
    "op12_sort_means": _means_sql(),
    "lm_base": r"""
with d as (select row_number() over () r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w,
  list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(doc_id::varchar, ''), ''), lambda s: ascii(s)::bigint)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))) crc from documents),
f as (select *, xor(crc, 4294967295) % 5 = 1 held_out from d),
u as (select r, held_out, unnest(w) word from f),
c as (select word, count(*) c from u where not held_out group by 1),
n as (select (select count(*) from u where not held_out) + (select count(*) from f where not held_out) n, (select count(*) from c) + 1 v, (select count(*) from f where not held_out) ends),
b as (select u.r, count(c.word) known, sum(log10((coalesce(c.c, 0) + 0.5) / (n.n + 0.5 * (n.v + 1)))) s from u left join c using (word), n group by 1)
select doc_id, held_out, cast(len(w) + 1 as bigint) n_tokens, cast(coalesce(known, 0) + 1 as bigint) n_known, cast(n.n as bigint) train_tokens, round(coalesce(s, 0) + log10((n.ends + 0.5) / (n.n + 0.5 * (n.v + 1))), 4) base_score from f left join b using (r), n""",
}
