"""Search, containment, nearest rows, components, splits, stages and streams against plain versions."""

import json
import math
import random
import re
import shutil
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import refs
from sparkloom.operators import answers, graph, layout, lexical, nearest, overlap, retrieval, splits, stages
from sparkloom.plans import registry
from sparkloom.sources import files
from sparkloom.streaming import fetching, questions, replay


def plain_words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def plain_bm25(chunks, asked, k, most_share=1.0):
    docs = defaultdict(list)
    for c, t in chunks:
        docs[c] += plain_words(t)
    n, average = len(docs), sum(map(len, docs.values())) / max(1, len(docs))
    df = Counter(w for ws in docs.values() for w in set(ws))

    def half_up(x):
        return math.floor(x + 0.5)

    out = {}
    for q, t in asked:
        found = []
        for c, ws in docs.items():
            tf, score = Counter(ws), 0
            for w in set(plain_words(t)):
                if tf[w] and df[w] <= most_share * n:
                    part = tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / average))
                    score += half_up(part * 10000) * max(1, half_up(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * 10000))
            if score:
                found.append((-score, c))
        out |= {(q, c): (i, -s) for i, (s, c) in enumerate(sorted(found)[:k])}
    return out


@pytest.mark.parametrize(("k", "hot", "growth", "share"), [(3, 10_000, 4, 1.0), (1, 2, 2, 1.0), (12, 5, 3, 0.3)])
def test_bm25(spark, monkeypatch, k, hot, growth, share):
    """Lists of many blocks, words in every chunk, equal scores, empty and missing texts, salted words."""
    monkeypatch.setattr(lexical, "BLOCK", 4)
    rng = random.Random(k)
    vocabulary = ["the", "law"] + [f"w{i}" for i in range(40)]
    chunks = [(f"c{i:03d}", "The law. " + " ".join(rng.choices(vocabulary, k=rng.randint(0, 12)))) for i in range(150)]
    chunks += [("same1", "twin text"), ("same0", "twin text"), ("none", None), ("blank", ""), ("two", "first part"), ("two", "second part")]
    asked = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 5)))) for i in range(40)] + [(90, "the law"), (91, "twin"), (92, None), (93, "??"), (94, "unknown"), (95, "The LAW the w1"), (96, "first second")]
    found = lexical.index(spark.createDataFrame(chunks, "chunk_id string, text string"), share)
    got = lexical.search(found, spark.createDataFrame(asked, "qid long, question string"), k, growth, hot).collect()
    assert {(r.qid, r.chunk_id): (r["rank"], round(r.score * 1e8)) for r in got} == plain_bm25(chunks, asked, k, share)


def test_search_hands_on_k_rows_a_word(spark, monkeypatch):
    """A question with words of many chunks hands on k whole scores a word and tile, not a row for each chunk that it meets."""
    handed = {}
    for name in ("_by_rare_words", "_by_tiles"):
        make = getattr(lexical, name)
        monkeypatch.setattr(lexical, name, lambda *a, make=make, name=name: handed.setdefault(name, make(*a)))
    chunks = [(f"c{i:03d}", "all " * (i % 5 + 1) + ("some" if i < 100 else "") + (" much" if i % 7 == 0 else "")) for i in range(300)]
    asked = [(1, "some"), (2, "all"), (3, "some all"), (4, "All of some much"), (5, "much all")]
    found = lexical.index(spark.createDataFrame(chunks, "chunk_id string, text string"))
    got = lexical.search(found, spark.createDataFrame(asked, "qid long, question string"), 2, 60).collect()
    assert {(r.qid, r.chunk_id): (r["rank"], round(r.score * 1e8)) for r in got} == plain_bm25(chunks, asked, 2)
    assert handed["_by_rare_words"].count() == 2 * 5  # some: 1, 3, 4; much: 4, 5
    assert handed["_by_tiles"].count() == 2  # one set of frequent words: all


@pytest.mark.parametrize(("slice_", "right"), [(10_000, 10_000), (7, 3)])
def test_long_chunks_are_not_copied_to_each_rare_word(spark, monkeypatch, slice_, right):
    """Chunks of many rare words stay whole in their tile, questions come to them; slices of questions give the same hits."""
    monkeypatch.setattr(lexical, "SLICE", slice_)
    monkeypatch.setattr(lexical, "RIGHT", right)
    monkeypatch.setattr(lexical, "LONG", 100)
    monkeypatch.setattr(lexical, "BLOCK", 4)
    rng = random.Random(5)
    chunks = [(f"long{i}", "the law " + " ".join(f"w{j}" for j in range(i, 120, 2))) for i in range(4)] + [(f"c{i:03d}", "the law " + " ".join(f"w{rng.randrange(150)}" for _ in range(4))) for i in range(200)]
    asked = [(i, f"the law w{rng.randrange(150)} w{rng.randrange(150)}") for i in range(40)] + [(90, "the law"), (91, "unknown"), (92, None), (93, " ".join(f"w{j}" for j in range(150)))]
    found = lexical.index(spark.createDataFrame(chunks, "chunk_id string, text string"))
    questions = spark.createDataFrame(asked, "qid long, question string")
    got = lexical.search(found, questions, 3, 60, 2).collect()
    assert {(r.qid, r.chunk_id): (r["rank"], round(r.score * 1e8)) for r in got} == plain_bm25(chunks, asked, 3)


def test_words_handed_to_rare_words_grow_with_the_chunks(spark, monkeypatch):
    """A chunk of many rare words is not written once for each of them."""
    handed, make = [], lexical._by_rare_words
    monkeypatch.setattr(lexical, "_by_rare_words", lambda *a: handed.append(a) or make(*a))
    chunks = spark.createDataFrame([("long", " ".join(f"w{i}" for i in range(500))), ("short", "w1 w2")], "chunk_id string, text string")
    asked = spark.createDataFrame([(i, f"w{i}") for i in range(500)], "qid long, question string")
    lexical.search(lexical.index(chunks), asked, 3)
    words = lambda k: lambda left, right: pa.table({"qid": [0], "chunk_id": ["all"], "score": [sum(map(len, left.column("ws").to_pylist()))]})
    monkeypatch.setattr(lexical, "_pairs", words)
    assert sum(r.score for r in make(*handed[0]).collect()) <= 500 + 2 * 2  # 500 * 500 where a chunk goes to each of its words


def test_contexts_search_for_every_word(spark, sf, monkeypatch):
    """No word is left out of the index of context_rows because many chunks have it."""
    shares, make = [], lexical.index
    monkeypatch.setattr(lexical, "index", lambda chunks, share=1.0: shares.append(share) or make(chunks, share))
    rows = registry.QUERIES["context_rows"](spark, sf)
    assert shares == [1.0] and rows.columns == ["qid", "context_type", "ids", "gold_in_context"]
    assert "df <= 0.05" not in registry.ORACLES["context_rows"]


def test_bm25_of_nothing(spark):
    none = spark.createDataFrame([], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "a word")], "qid long, question string")
    assert lexical.search(lexical.index(none), asked, 3).count() == 0
    some = lexical.index(spark.createDataFrame([("c", "a word")], "chunk_id string, text string"))
    assert lexical.search(some, asked.limit(0), 3).count() == 0


def test_contexts_are_written_for_the_chosen_chunks_alone(spark):
    """Repeated chunks, more than a context takes; rows are shuffled once, and no text before its chunk is chosen."""
    rows = [(q, p, p % 3, p, f"{10 * p + q}") for q in range(3) for p in range(7)] + [(1, 2, 0, 1, "9"), (1, 2, 2, 9, "07")]
    df = spark.createDataFrame(rows, "qid long, pid int, priority int, seq int, text string")
    made = retrieval.assemble(df, 2, 430, lambda t: F.concat(F.lit("text "), t))
    got = {r.qid: (r.n, r.context) for r in made.collect()}
    rule = "\n\n---\n\n"
    assert got == {0: (2, f"text 0{rule}text 30"), 1: (2, f"text 1{rule}text 07"), 2: (2, f"text 2{rule}text 32")}
    assert made._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_similarities_are_held_in_parts(spark, monkeypatch):
    """A batch of passages and a block of queries are never one matrix; ties go to the lesser id."""
    monkeypatch.setattr(retrieval, "CELLS", 50, raising=False)
    seen, own = [], np.round
    monkeypatch.setattr(np, "round", lambda x, n: seen.append(np.size(x)) or own(x, n))
    rng = np.random.default_rng(1)
    q, p = rng.integers(0, 3, (23, 4)), rng.integers(0, 3, (31, 4))
    work = retrieval._best([(i, v, i % 2) for i, v in enumerate(q)], 3, 10.0, spark)
    batch = pa.RecordBatch.from_arrays([pa.array(range(31)), pa.array(p.tolist()), pa.array([i % 3 for i in range(31)])], ["pid", "p", "key"])
    got = [tuple(r.values()) for r in next(work(iter([batch]))).to_pylist()]
    scores = q @ p.T + 10.0 * (np.arange(23)[:, None] % 2 == np.arange(31)[None, :] % 3)
    assert got == [(i, int(j), line[j]) for i, line in enumerate(scores) for j in np.argsort(-line, kind="stable")[:3]]
    assert max(seen) <= 50


def test_contained(spark):
    rng = random.Random(2)
    words = ["ab", "abc", "b", "cab", "d", "e f", "g", "hh"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(120)] + [(500, None), (501, ""), (502, "  "), (503, "x\ny\tz  w"), (504, " ".join(f"v{i}" for i in range(60)))]
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([1, 1, 2, 2, 3, 3, 4, 5, 6, 8, 9])]
    items += [(40 + i, rng.choice(texts[:120])[1][rng.randint(0, 6) :][: rng.randint(1, 90)]) for i in range(40)]
    items += [(90, None), (91, ""), (92, " "), (93, "y\tz"), (94, "3 v4 v5 v6 v7 v8 v9 v10 v11 v12 v1"), (95, "v5 v6 v8"), (96, "zz"), (97, "b"), (98, "3 v4 v5 v6 v7 v8 v9 v10 v11 v13")]
    got = overlap.contained(spark.createDataFrame(items, "i long, item string"), "i", "item", spark.createDataFrame(texts, "t long, x string"), "t", "x").collect()
    want = Counter((i, t) for i, item in items for t, x in texts if item is not None and x is not None and item in x)
    assert Counter(map(tuple, got)) == want


def test_windows_share_a_fingerprint(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        shared = [rng.choice("abcdefg") for _ in range(8)]
        rows.append((i, [rng.choice("abcdefg") for _ in range(rng.randint(0, 9))] + shared, shared + [rng.choice("abcdefg") for _ in range(rng.randint(0, 9))]))
    df = spark.createDataFrame(rows, "i long, a array<string>, b array<string>")
    assert df.where(~F.arrays_overlap(overlap.winnowed(F.col("a")), overlap.winnowed(F.col("b")))).count() == 0


def plain_nearest(lefts, rights, bound):
    out = {}
    for l, g, p in lefts:
        near = sorted((abs(p - q), r) for r, h, q in rights if h == g and p is not None and q is not None and abs(p - q) <= bound)
        out[l] = near[0][::-1] if near else (None, None)
    return out


def plain_once(lefts, rights, bound):
    pairs = sorted((abs(p - q), l, r) for l, g, p in lefts for r, h, q in rights if g == h and p is not None and q is not None and abs(p - q) <= bound)
    ls, rs, out = set(), set(), set()
    for d, l, r in pairs:
        if l not in ls and r not in rs:
            ls.add(l)
            rs.add(r)
            out.add((l, r, d))
    return out


@pytest.mark.parametrize(("span", "bound", "wide"), [(40, 3, 16), (400, 9, 1), (12, 30, 2), (50, 0, 16)])
def test_nearest(spark, span, bound, wide):
    rng = random.Random(span)
    lefts = [(i, rng.choice("xyy"), rng.randint(0, span)) for i in range(60)] + [(900, "x", None), (901, "z", 4)]
    rights = [(i, rng.choice("xyy"), rng.randint(0, span)) for i in range(50)] + [(950, "x", None)]
    a, b = spark.createDataFrame(lefts, "l long, g string, p long"), spark.createDataFrame(rights, "r long, g string, p long")
    got = nearest.within(a, b, ["g"], "p", "l", "r", bound, wide).collect()
    assert {r.l: (r.r, r.distance) for r in got} == plain_nearest(lefts, rights, bound) and len(got) == len(lefts)
    got = nearest.once(a, b, ["g"], "p", "l", "r", bound, wide).collect()
    assert {(r.l, r.r, r.distance) for r in got} == plain_once(lefts, rights, bound)


def plain_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("heavy", [100_000, 3])
def test_star_components(spark, heavy):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)]
    edges += [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5001 + i) for i in range(200)] + [(7000 - i, 7000) for i in range(1, 60)] + [(9, 9), (8888, 8888), (None, 4), (4, None)]
    got = graph.star_components(spark.createDataFrame(edges, "a long, b long"), "a", "b", heavy).collect()
    assert {r.node: r.grp for r in got} == plain_components(edges) and len(got) == len({r.node for r in got})
    assert graph.star_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_a_hub_is_spread_over_the_tasks(spark):
    """A node with all arcs: no task of the round that hands its neighbours on reads more than the others."""
    arcs = spark.range(1, 40_001).select(F.lit(0).cast("long").alias("x"), F.col("id").alias("y")).repartition(20)
    met = graph._least_neighbours(arcs, 1000)
    sizes = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 40_000 and max(sizes) <= 2 * 40_000 / 20


def test_split_by_classes_is_as_balanced_as_the_walk(spark):
    rng = random.Random(4)
    rows = []
    for i in range(4000):
        for kind, chance in (("a", 0.9), ("b", 0.3), ("c", 0.05), ("d", 0.004)):
            if rng.random() < chance:
                rows.append((f"g{i}", kind, rng.choice([1, 2, 2, 2, 3])))
    counts = spark.createDataFrame(rows, "grp string, qa_type string, n long").cache()

    def flags(most):
        found = splits.assigned(counts, most=most)
        assert found.count() == found.select("grp").distinct().count() == counts.select("grp").distinct().count()
        whole = counts.join(found, "grp").select("qa_type", "split", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        return {r.qa_type: (r.val_off, r.test_off) for r in graph.balance(whole, "qa_type").collect()}

    plain = flags(10**6)
    for most in (5000, 40, 10):
        for kind, off in flags(most).items():
            assert off == plain[kind] or (kind == "d" and not any(off)), (most, kind)  # the walk leaves the rarest kind out of a split


def test_stages_go_on_where_they_stopped(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(10).write.parquet(source)
    runs = Counter()

    def first(rows, least):
        runs["first"] += 1
        return rows.where(F.col("id") >= least)

    def second(rows, killed):
        runs["second"] += 1
        if killed and not (tmp_path / "mended").exists():
            return rows.select(F.raise_error(F.lit("killed")).cast("long").alias("id"))
        return rows.select((F.col("id") * 2).alias("id"))

    def run(least=3):
        steps = [("first", first, {"least": least}), ("second", second, {"killed": True})]
        return stages.run_stages(spark, spark.read.parquet(source), [source], steps, str(tmp_path / "out")), steps

    with pytest.raises(Exception, match="killed"):
        run()
    assert runs == {"first": 1, "second": 1} and not stages.marker(spark, str(tmp_path / "out/second")).take(1)
    (tmp_path / "mended").touch()
    out, steps = run()
    assert sorted(r.id for r in out.collect()) == [6, 8, 10, 12, 14, 16, 18] and runs == {"first": 1, "second": 2}
    assert run()[0].count() == 7 and runs == {"first": 1, "second": 2}
    assert {r.stage: r.rows for r in stages.report(spark, str(tmp_path / "out"), steps).collect()} == {"first": 7, "second": 7}
    assert run(least=5)[0].count() == 5 and runs == {"first": 2, "second": 3}
    spark.range(10, 12).write.mode("append").parquet(source)
    assert run(least=5)[0].count() == 7 and runs == {"first": 3, "second": 4}


ROBOTS = """# a file
User-agent: other
Disallow: /

user-agent: last-named
User-Agent: *
Disallow: /private # not this
Allow: /private/open
Disallow: /same
Allow: /same
Disallow:
Allow: /deep/
Disallow: /deep/er*
Crawl-delay: 3
User-agent: third
Allow: /
"""


def test_robots(spark):
    rules = files.robots_rules(spark.createDataFrame([("a.org", ROBOTS), ("b.org", ""), ("c.org", None)], "host string, body string"))
    assert {(r.prefix, r.allow) for r in rules.collect()} == {("/private", False), ("/private/open", True), ("/same", False), ("/same", True), ("/deep/", True), ("/deep/er", False)}
    paths = {"/": True, "": True, "/private": False, "/private/x?q=1": False, "/private/open/1": True, "/same/1": True, "/deep/a": True, "/deep/erer": False, "/pri": True}
    urls = [(f"https://a.org{p}",) for p in paths] + [("https://b.org/private",), ("https://d.org/private",), ("no url",), (None,), ("https://a.org/private",)]
    got = Counter(r.url for r in files.allowed(spark.createDataFrame(urls, "url string"), rules).collect())
    want = Counter([f"https://a.org{p}" for p, good in paths.items() if good] + ["https://b.org/private", "https://d.org/private", "no url", None])
    assert got == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Section 103\u00a0of the BNS", ["BNS 103"]),
        ("section 3\u2009of the IPC", ["IPC 3"]),
        ("IPC\u2003302", ["IPC 302"]),
        ("BNS \u0968\u0966", ["BNS \u0968\u0966"]),
        ("BNS \u0968\u0966\u0968\u0969", []),
        ("IPC Sections 415,\u3000417\x1cand\u2028420A", ["IPC 415", "IPC 417", "IPC 420A"]),
        ("IPC Section 302 corresponds to BNS Section 103.", ["BNS 103", "IPC 302"]),
        ("CrPC 438 is now BNSS 482.", ["BNSS 482", "CRPC 438"]),
        ("Section 65B of the Indian Evidence Act, 1872", ["IEA 65B"]),
        ("BNS Section 318 absorbs IPC Sections 415, 417, 418, 419 and 420.", ["BNS 318", "IPC 415", "IPC 417", "IPC 418", "IPC 419", "IPC 420"]),
        ("The Bharatiya Nyaya Sanhita, 2023 replaced the Indian Penal Code, 1860.", []),
        ("now dealt with under Section 115(2) of the Bharatiya Nyaya Sanhita, 2023", ["BNS 115"]),
        ("the definition is in Section 324(1) of the Bharatiya Nyaya Sanhita", ["BNS 324"]),
        ("corresponds to Section 23(1)(a) of the Bharatiya Sakshya Adhiniyam, 2023", ["BSA 23"]),
        ("BNS Section 303(2) prescribes the punishment", ["BNS 303"]),
        ("IPC\u00e9 302, IPC 0103", ["IPC 0103"]),
    ],
)
def test_references_with_any_blank_and_digit(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(refs.extract_refs(F.col("t")).alias("r")).first().r == want


def test_heading_search(spark):
    rng = random.Random(6)
    words = ["murder", "theft", "of", "the", "law", "court", "bail"]
    sections = [("BNS", str(i), " ".join(rng.choices(words, k=rng.randint(1, 5))).title()) for i in range(80)] + [("BNS", "900", ""), ("IPC", "1", "Of")]
    asked = [(i, " ".join(rng.choices(words, k=rng.randint(1, 4)))) for i in range(60)] + [(90, ""), (91, None), (92, "of"), (93, "unknown of"), (94, "Law, the")]
    got = answers.heading_search(spark.createDataFrame(asked, "qid long, question string"), spark.createDataFrame(sections, "act string, section string, title string")).collect()
    want = {}
    for q, t in asked:
        ws = set(plain_words(t))
        found = sorted((f"{a} {s}", title) for a, s, title in sections if title and ws and ws <= set(plain_words(title)))[:5]
        if found:
            want[q] = "; ".join(f"{r.split()[0]} §{r.split()[1]} {title}" for r, title in found)
    assert {r.qid: r.headings for r in got} == want


def plain_starts(rows, gap):
    free, out = {}, set()
    for host, i, at in sorted(rows, key=lambda r: (r[2], r[1])):
        start = max(at, free.get(host, at))
        free[host] = start + gap
        out.add((host, i, start))
    return out


def requests(spark, rows):
    return spark.createDataFrame(rows, "host string, id long, us long").select("host", "id", F.timestamp_micros("us").alias("at"))


def test_paced_fetches(spark):
    rng = random.Random(9)
    second, day = 1_000_000, 1_700_000_000  # a time after the epoch, at which a watermark begins
    rows = [(rng.choice(["a", "a", "b", None]), i, (day + rng.randint(0, 60)) * second) for i in range(80)]
    # state that is held over a run, and state that its timer has cleared
    later = [("a", 200 + i, (day + 61 + i) * second) for i in range(20)] + [("b", 300, (day + 9000) * second)]
    last = [("a", 400 + i, (day + 20_000) * second) for i in range(4)]
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, fetching.PROVIDER)
    try:
        path = replay.replay([requests(spark, r) for r in (rows, later, last)], lambda s: fetching.starts(s, idle=100.0), replay.once_a_batch)
    finally:
        spark.conf.set(key, before)
    got = {(r.host, r.id, r.us) for r in spark.read.parquet(path).select("host", "id", F.unix_micros("start").alias("us")).collect()}
    want = plain_starts(rows + later + last, 1_500_000)
    assert sorted(got ^ want, key=str) == []
    batch = fetching.starts_batch(requests(spark, rows + later + last)).select("host", "id", F.unix_micros("start").alias("us"))
    assert {tuple(r) for r in batch.collect()} == want


def test_a_repeated_batch_is_not_doubled(spark, tmp_path):
    """The last batch's commit is lost: the stream runs that batch again."""
    spark.range(5).write.parquet(str(tmp_path / "in"))
    made = Counter()

    def doubled(rows):
        made["calls"] += 1
        return rows.select((F.col("id") * 2).alias("id"))

    def run():
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        sink = replay.once_a_batch(str(tmp_path / "out"), doubled)
        stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [0, 2, 4, 6, 8]
    commits = [p for p in (tmp_path / "state/commits").iterdir() if p.name.isdigit()]
    last = max(commits, key=lambda p: int(p.name))
    last.unlink()
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    assert run() == [0, 2, 4, 6, 8] and made["calls"] >= 2
    spark.range(5, 7).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == [0, 2, 4, 6, 8, 10, 12]


def test_late_rows_and_sessions(spark):
    def events(rows):
        return spark.createDataFrame(rows, "user_id long, minute long, value double").select("user_id", F.timestamp_seconds(F.col("minute") * 60).alias("ts"), "value")

    parts = [events([(1, 0, 1.0), (1, 5, 1.0), (2, 100, 2.0), (3, None, 9.0)]), events([(1, 30, 4.0), (2, 60, 1.0), (2, 200, 1.0)]), events([(2, 139, 7.0), (2, 140, 7.0)])]
    path = replay.replay(parts, lambda rows: rows, lambda folder: replay.split_late(folder, "60 minutes"))
    late = {(r.user_id, r.value) for r in spark.read.parquet(f"{path}/late").collect()}
    assert late == {(3, 9.0), (1, 4.0), (2, 7.0)}
    kept = spark.read.parquet(f"{path}/kept").drop("batch")
    assert kept.count() == 6
    closed = replay.replay([kept, questions.closing(kept, "ts", "2 days")], lambda rows: questions.sessions(rows, "user_id", "10 minutes"), replay.once_a_batch)
    got = {(r.user_id, r.a, r.b, r.n, r.total) for r in spark.read.parquet(closed).select("user_id", (F.unix_seconds("start") / 60).alias("a"), (F.unix_seconds("finish") / 60).alias("b"), "n", "total").collect()}
    assert got == {(1, 0, 15, 2, 2.0), (2, 100, 110, 1, 2.0), (2, 60, 70, 1, 1.0), (2, 200, 210, 1, 1.0), (2, 140, 150, 1, 7.0)}


def test_acts_are_read_page_by_page():
    """What the reader of an act holds does not grow with the act."""
    reader, most, found = layout.ActReader(), 0, []
    for s in range(3000):
        for top, band, text in ((100.0, "body", f"{s + 1}. Whoever holds"), (101.0, "margin", f"Title {s}."), (112.0, "body", "shall pay.")):
            found += list(reader.eval({"doc": "X", "page": s // 5, "top": top + s % 5 * 60, "band": band, "text": text}))
            most = max(most, len(reader.lines) + len(reader.pending) + (len(reader.current[4]) if reader.current else 0))
    found += list(reader.terminate())
    assert len(found) == 3000 and most < 40
    assert found[7] == ("X", "8", "Title 7", None, 1, "8. Whoever holds shall pay.")


def test_schedule_bounds(spark):
    lines = spark.createDataFrame([("d", 0, 1.0, "THE FIRST TABLE"), ("d", 2, 5.0, "  the FIRST schedule "), ("d", 3, 1.0, "THE FIRST SCHEDULE"), ("d", 9, 2.0, "II. Classification of offences against other laws"), ("e", 1, 1.0, "x")], "doc string, page int, top double, text string")
    got = {r.doc: (r["first"] and tuple(r["first"]), r["second"] and tuple(r["second"])) for r in layout.schedule_bounds(lines).collect()}
    assert got == {"d": ((2, 5.0), (9, 2.0)), "e": (None, None)}


def test_marker_of_a_missing_stage(spark, tmp_path):
    assert stages.marker(spark, str(tmp_path / "none")).count() == 0
    assert json.loads(json.dumps(stages.input_marks(spark, [str(tmp_path)]))) == [[str(tmp_path), 0, None, None]]
    shutil.rmtree(tmp_path)
