"""Sharding, sort-means and the source audit against plain versions, on small tables with edge rows."""

import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from sparkloom.llm import centroids, divergence, html_extract, license_scan, queries, shards, warc

SCHEMA = "doc_id long, text string, lang string, source string, shard string, slot string, row string, h string, bucket int, term string"


def rows_of_docs():
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "délta", "ÉTÉ", "x1y", "zeta's", "日本語", "a-b", "Ω"]
    out = []
    for i in range(400):
        text = rng.choice([None, "", "one", " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))]) if i % 9 else "same text here"
        lang, source = rng.choice([("en", "s1"), ("en", "s1"), ("en", "s2"), ("de", "s1"), ("de", None), (None, "s9"), ("", "s8"), ("en", "é"), ("fr", "only")])
        out.append((i if i % 11 else None, text, lang, source, "mine", "own", "r", "hh", 7, "t"))
    out.append((999, "lonely " * 3000 + "Alpha", "xx", "big", "mine", "own", "r", "hh", 7, "t"))
    return out + [out[5]] * 150


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of_docs(), SCHEMA).repartition(3).cache()


def test_fisher_yates_is_a_uniform_order():
    assert shards.fisher_yates(0, 1, 0).tolist() == [] and shards.fisher_yates(1, 1, 0).tolist() == [0]
    seen = Counter(tuple(shards.fisher_yates(3, 5, b).tolist()) for b in range(6000))
    assert len(seen) == 6 and all(850 < n < 1150 for n in seen.values())


@pytest.mark.parametrize("bucket_bytes", [1 << 30, 4000])
def test_shards(spark, docs, bucket_bytes):
    given = docs.collect()
    got = shards.deal_shards(docs, 7, bucket_bytes=bucket_bytes).collect()
    plain = [c for c in docs.columns if c not in ("shard", "slot")]
    assert Counter(tuple(r[c] for c in plain) for r in got) == Counter(tuple(r[c] for c in plain) for r in given)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def test_shards_do_not_depend_on_the_layout(docs):
    once = docs.dropDuplicates()
    a, b = (Counter(tuple(r) for r in shards.deal_shards(d, 5, bucket_bytes=4000).collect()) for d in (once.repartition(2), once.repartition(5, "lang")))
    assert a == b and a != Counter(tuple(r) for r in shards.deal_shards(once, 5, seed=2, bucket_bytes=4000).collect())


def test_shards_follow_the_two_passes(spark, docs):
    """Hash, bucket and swaps by hand."""
    df = docs.dropDuplicates()
    hashed = df.select(shards.row_hash(df, 1).alias("h"), "doc_id", "text").collect()
    n = -(-sum(len((r.text or "").encode()) + 1 for r in hashed) // 4000)
    assert n > 3
    want = []
    for b in range(n):
        own = sorted((r for r in hashed if r.h % n == b), key=lambda r: r.h)
        draws = np.random.Generator(np.random.Philox(key=[1, b])).integers(0, np.arange(len(own), 0, -1))
        for i in range(len(own) - 1, 0, -1):
            j = int(draws[len(own) - 1 - i])
            own[i], own[j] = own[j], own[i]
        want += [(r.doc_id, r.text) for r in own]
    got = shards.deal_shards(df, 4, bucket_bytes=4000).orderBy("shard", "slot").collect()
    assert [(r.doc_id, r.text) for r in got] == want


def test_one_row_many_times_fills_many_buckets(spark):
    df = spark.createDataFrame([(1, "the same row " * 3)] * 3000 + [(i, f"row {i}") for i in range(3000)], "doc_id long, text string")
    sizes = [r["count"] for r in shards.shuffle_rows(df, bucket_bytes=6000).groupBy("bucket").count().collect()]
    assert sum(sizes) == 6000 and max(sizes) < 3 * 6000 / len(sizes)


def test_shard_report_and_files(spark, docs, tmp_path):
    got = shards.shard_places(docs).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    plain = docs.select("doc_id", "text")
    said = {r.shard: (r.n_rows, r.n_bytes) for r in shards.write_shards(plain, str(tmp_path / "out"), 3).collect()}
    assert sum(n for n, _ in said.values()) == 551 and sum(b for _, b in said.values()) == sum(len((r.text or "").encode()) for r in docs.collect())
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert shards.shard_places(empty).count() == 0


def brute_audit(rows):
    groups, counts, seen, whole = set(), defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        lang, source = r.lang or "", r.source or ""
        groups.add((lang, source))
        terms = [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r.text or "")]
        counts[lang, source].update(terms)
        whole[lang].update(terms)
        seen[lang].update(set(terms))
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(t for t, n in seen[lang].items() if n >= 3)
        own = [s for g, s in groups if g == lang]

        def part(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        q, p = part(whole[lang]), {s: part(counts[lang, s]) for s in own}
        for s in own:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in own if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for name, found, most in (("pair", pairs, None), ("term", terms, 200)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, name, item, v, i) for i, (item, v) in enumerate(ranked, 1)]
    return out


@pytest.mark.parametrize("sizes", [(32, 50_000, 4, 0), (1, 3, 1, 0), (2, 5, 2, 1)])
def test_audit(docs, monkeypatch, sizes):
    """Whole, cut into many tiles, chunks and slices, and without the broadcast."""
    for name, n in zip(("BLOCK", "CHUNK_ROWS", "SLICE"), sizes, strict=False):
        monkeypatch.setattr(divergence, name, n)
    if sizes[3]:
        monkeypatch.setattr(divergence, "SMALL_GROUPS", 0)
    got = divergence.audit_sources(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(brute_audit(docs.collect()))


def test_audit_of_nothing(spark):
    assert divergence.audit_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    bare = spark.createDataFrame([(1, None, "en", "a"), (2, "", "en", "b"), (3, "12 34", "en", "c")], "doc_id long, text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit_sources(bare).collect())) == sorted(("en", s, "pair", o, 0, i) for s in "abc" for i, o in enumerate([x for x in "abc" if x != s], 1))


def test_shares_without_overflow():
    counts, total = np.array([[0, 5, 9 * 10**14]]), np.array([9 * 10**14 + 5])
    assert divergence.shares(counts, total, 3)[0].tolist() == [1 + 10**9 * (int(c) + 1) // (int(total[0]) + 3) for c in counts[0]]


def test_share_column(spark):
    got = spark.sql("select * from values (0L, 4L, 3L), (20000000000L, 90000000000L, 7L), (1L, 1L, 1L) as t(n, a, v)").select("n", "a", "v", divergence.share("n", "a", "v").alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (r.n + 1) // (r.a + r.v) for r in got]


def vectors():
    rng = np.random.default_rng(4)
    out = [(i, [float(v) for v in rng.normal(size=64) * 3], 0) for i in range(300)]
    out += [(1000 + i, [1.0] * 64, 0) for i in range(120)] + [(1, out[1][1], 0)] * 5
    out += [(None, [0.5] * 64, 0), (7, None, 0), (8, [], 0), (9, [1.0] * 63, 0), (10, [1.0] * 65, 0), (11, [None] + [1.0] * 63, 0), (12, [float("nan")] + [1.0] * 63, 0), (13, [float("-inf")] + [1.0] * 63, 0), (14, [1e30] + [-1.0] * 63, 0)]
    return out


def brute_means(rows, k=16, rounds=3):
    kept = []
    for key, x, _ in rows:
        if x is not None and len(x) == 64 and all(v is not None and np.isfinite(v) for v in x):
            kept.append((key, tuple(int(np.floor(max(-(2.0**26), min(2.0**26, 64 * v)))) for v in x)))
    cents = [x for _, x in sorted(kept, key=lambda r: (sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(cents)) for _, x in kept]

    for _ in range(rounds):
        at = assign()
        for i in range(len(cents)):
            own = [x for (_, x), (_, c) in zip(kept, at, strict=True) if c == i]
            if own:
                cents[i] = tuple(sum(col) // len(own) for col in zip(*own, strict=True))
    at = assign()
    inertia = Counter()
    for d, c in at:
        inertia[c] += d
    return Counter((key, c, d, inertia[c], sum(inertia.values()), sha256(",".join(map(str, cents[c])).encode()).hexdigest()) for (key, _), (d, c) in zip(kept, at, strict=True))


def test_sort_means(spark):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, cluster int").repartition(3)
    assert Counter(map(tuple, centroids.cluster_report(df).collect())) == brute_means(vectors())
    few = vectors()[:5]
    assert Counter(map(tuple, centroids.cluster_report(df.sparkSession.createDataFrame(few, df.schema)).collect())) == brute_means(few)
    assert centroids.cluster_report(spark.createDataFrame([], df.schema)).count() == 0


def test_the_walk_stops_early_and_keeps_ties():
    rng = np.random.default_rng(1)
    cents = np.concatenate([rng.integers(-900, 900, (30, 4)), [[5, 5, 5, 5]] * 2])
    x = np.concatenate([cents[rng.integers(0, 32, 500)] + rng.integers(-3, 4, (500, 4)), (cents[:10] + cents[10:20]) // 2])
    every = ((x[:, None] - cents[None]) ** 2).sum(2)
    cluster, best, tried = centroids.nearest(x, rng.integers(0, 32, len(x)), cents)
    assert (cluster == every.argmin(1)).all() and (best == every.min(1)).all()
    assert centroids.nearest(x, cluster, cents)[2] < len(x) * 32 // 4


def test_the_queries_are_registered():
    assert {"op11_source_audit", "op12_sort_means", "op13_sharding"} <= set(queries.QUERIES)


BODY = "<p>Whole body of the page, with more words than any box beside it has.</p>"


@pytest.mark.parametrize("names", ["article-body ad-free", "post social-enabled", "content notice-board", "entry related-topics", "story-widget-2", "body-alert-level", "main-column shared", "comment-free", "navigate", "widget", "promo"])
def test_names_do_not_take_the_article(spark, names):
    """Parts of a name say nothing, and a marked element that holds the article stays."""
    html = f'<article><h1>Title</h1><div class="{names}">{BODY}<div>more</div></div><p>end</p></article><footer>x</footer>'
    got = html_extract.extract_text(spark.createDataFrame([(1, "http://a.org/1", html)], "page_id long, url string, html string")).first()
    assert got.text == "Title\nWhole body of the page, with more words than any box beside it has.\nmore\nend"


def test_boxes_go_by_whole_names():
    boxes = ["ad", "cookie-banner", "related-posts", "newsletter-signup", "left x sidebar", "comments", "site-footer", "share-buttons"]
    html = "<article>" + "".join(f'<p>kept {i} and more words here</p><div class="{b}"><div>gone</div><section><div class="ad">gone</div></section>gone</div>' for i, b in enumerate(boxes)) + "</article>"
    assert html_extract.main_texts([html_extract.blocks_of(html)]) == ["\n".join(f"kept {i} and more words here" for i in range(len(boxes)))]
    talk = '<article><p>Short.</p><div id="comments">' + "<p>a long reply of a reader</p>" * 20 + "</div></article>"
    assert html_extract.main_texts([html_extract.blocks_of(talk)]) == ["Short."]
    open_ = "<article><p>All of this stays here.</p><div class=ad>gone</article><article><p>second</p></article>"
    assert html_extract.main_texts([html_extract.blocks_of(open_)]) == ["All of this stays here.\nsecond"]


def test_a_zero_width_blank_is_no_blank():
    assert html_extract.main_texts([html_extract.blocks_of("<article><p>foo&#8203;bar&nbsp; baz</p></article>")]) == ["foo\u200bbar baz"]


def test_archives_are_whole_wherever_spark_splits_them(spark, tmp_path):
    """Blocks that hold marks and whole records, cut at every few bytes; a cut file; a file of other matter."""
    inner = warc.serialize({"WARC-Type": "response", "Content-Length": "9"}, b"WARC/1.0 ")
    blocks = [b"a", b"", b"x" * 300, inner * 5, b"WARC/1.1\r\n" * 30, b"\xff\x00WARC/1.", inner + b"tail" * 40, b"last \r\n\r\n"] * 2
    heads = [{"WARC-Type": "resource", "WARC-Record-ID": f"<urn:{i}>", "Content-Length": str(len(b))} for i, b in enumerate(blocks)]
    data = b"".join(warc.serialize(h, b) for h, b in zip(heads, blocks, strict=True))
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc").write_bytes(b"no archive\r\n" * 40)
    (tmp_path / "c.warc").write_bytes(data[: data.index(b"<urn:6>") + 60])
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    found = {}
    try:
        for size in (128 << 20, 701, 256, 97, 64):
            spark.conf.set(keys[0], str(size))
            spark.conf.set(keys[1], "1")
            found[size] = Counter((tuple(sorted(r.headers.items())), bytes(r.block)) for r in warc.read_warc(spark, str(tmp_path)).collect())
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)
    whole = [(tuple(sorted(h.items())), b) for h, b in zip(heads, blocks, strict=True)]
    cut = data[: data.index(b"<urn:6>") + 60].split(b"\r\n\r\n")
    want = Counter(whole + whole[:6])
    assert cut
    for size, got in found.items():
        rest = got - want
        assert not want - got, size
        assert sum(rest.values()) == 1 and "WARC-Truncated" in dict(next(iter(rest))[0]), size


def test_many_notices_in_one_text():
    import time

    scanner = license_scan.Scanner()
    began = time.process_time()
    spans = scanner.fuzzy(scanner.normal("all rights reserved. " * 100_000))
    assert len(spans) == 100_000 and time.process_time() - began < 10
