"""Column functions and operators on literal rows."""

import re
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import refs, text
from sparkloom.operators import concordance, graph, layout, retrieval
from sparkloom.plans.quality import checks, gate
from sparkloom.sources import files


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "want"),
    [
        # fixed values: the nine checks of the metric
        ("IPC Section 302 corresponds to BNS Section 103.", ["BNS 103", "IPC 302"]),
        ("CrPC 438 is now BNSS 482.", ["BNSS 482", "CRPC 438"]),
        ("Section 65B of the Indian Evidence Act, 1872", ["IEA 65B"]),
        ("BNS Section 318 absorbs IPC Sections 415, 417, 418, 419 and 420.", ["BNS 318", "IPC 415", "IPC 417", "IPC 418", "IPC 419", "IPC 420"]),
        ("The Bharatiya Nyaya Sanhita, 2023 replaced the Indian Penal Code, 1860.", []),
        ("now dealt with under Section 115(2) of the Bharatiya Nyaya Sanhita, 2023", ["BNS 115"]),
        ("the definition is in Section 324(1) of the Bharatiya Nyaya Sanhita", ["BNS 324"]),
        ("corresponds to Section 23(1)(a) of the Bharatiya Sakshya Adhiniyam, 2023", ["BSA 23"]),
        ("BNS Section 303(2) prescribes the punishment", ["BNS 303"]),
        # forms with a year, with abbreviations, with words that are no list marks
        ("the Indian Penal Code, 1860, Section 302", ["IPC 302"]),
        ("Indian Penal Code 1860 Section 302", ["IPC 302"]),
        ("IPC ss. 3, 4", ["IPC 3", "IPC 4"]),
        ("BNS 5 or 6", ["BNS 5"]),
        ("sections 415, 417 and 420 IPC", []),
        ("Cr.P.C 438 and Cr.P.C. 439", ["CRPC 438"]),
        ("IPC 498A and BNS 85", ["BNS 85", "IPC 498A"]),
        ("BNSS 2023", []),
        ("no reference", []),
        (None, None),
    ],
)
def test_refs(spark, given, want):
    assert one(spark, given, refs.extract_refs) == want


def test_query_refs(spark):
    assert one(spark, "Under the IPC, what is section 302 about?", refs.query_refs) == ["IPC 302"]
    assert one(spark, "What is section 302?", refs.query_refs) == []


@pytest.mark.parametrize(("given", "want"), [(" a  b \n\n\n c ", "a b\nc"), ("“x”\x13y\x01", "\"x\"“y".replace("“", '"')), (None, None), ("", "")])
def test_clean_text(spark, given, want):
    assert one(spark, given, text.clean_text) == want


@pytest.mark.parametrize(("f", "given", "want"), [(text.section_number, "498 A(2)", "498A"), (text.section_number, "23c", "23"), (text.section_number, "nil", ""), (text.split_refs, "12, 13A & 14 and 12", ["12", "13A", "14"]), (text.split_refs, "New", []), (text.roman, "MCMXCIV", 1994), (text.roman, "abc", None), (text.dedup_key, "What's  UP?", "what s up"), (text.metric_key, "The cat, an Éa!", "cat éa")])
def test_scalars(spark, f, given, want):
    assert one(spark, given, f) == want


def test_strip_html(spark):
    assert one(spark, "a<script>x</script>b&eacute;&#8364;<li>c", text.strip_html) == "a bé€\n- c"
    assert one(spark, "<p>In re</p>X &amp; Y", text.judgment_text) == "In re X & Y"


def test_shorten(spark):
    long = "First sentence here. " * 3 + "tail without end"
    got = one(spark, long, lambda c: text.shorten(c, 60))
    assert got.endswith(" [...]") and got.startswith("First sentence here.") and "tail" not in got
    assert one(spark, "short", lambda c: text.shorten(c, 60)) == "short"


@pytest.mark.parametrize(("p", "g", "want"), [("a cat sat", "the cat sat down", 0.8), ("", "", 1.0), ("", "x", 0.0), ("x x y", "x y y", 2 / 3)])
def test_token_f1(spark, p, g, want):
    got = spark.createDataFrame([(p, g)], "p string, g string").select(text.token_f1(F.col("p"), F.col("g")).alias("x")).first().x
    assert got == pytest.approx(want)


def test_join_wrapped_and_overlap(spark):
    assert one(spark, ["non-", "bailable", "offence"], text.join_wrapped, "array<string>") == "non-bailable offence"
    assert one(spark, "The Theft of Cattle", text.title_words) == ["theft", "cattle"]
    row = spark.createDataFrame([(["a", "b"], ["b"], [])], "a array<string>, b array<string>, c array<string>").select(text.overlap(F.col("a"), F.col("b")).alias("x"), text.overlap(F.col("a"), F.col("c")).alias("y")).first()
    assert (row.x, row.y) == (1.0, 0.0)


def test_concordance(spark):
    edges = spark.createDataFrame([(1, 1), (2, 3), (3, 3), (4, 5), (4, 6)], "old long, new long")
    old = spark.range(1, 7).withColumnRenamed("id", "old")
    new = spark.range(1, 8).withColumnRenamed("id", "new")
    got = {(r.old, r.new): r.mapping_type for r in concordance.classify(edges, old, new).collect()}
    assert got == {(1, 1): "direct", (2, 3): "merged", (3, 3): "merged", (4, 5): "split", (4, 6): "split", (5, None): "removed", (6, None): "removed", (None, 2): "new_provision", (None, 4): "new_provision", (None, 7): "new_provision"}


def test_graph(spark):
    got = {r.node: r.grp for r in graph.components(spark.createDataFrame([(3, 2), (2, 1), (5, 6), (6, 5), (9, 9)], "a long, b long"), "a", "b").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 9: 9}
    split = graph.hash_split(spark.range(2000).withColumnRenamed("id", "grp"), "grp", "s")
    counts = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert abs(counts["train"] - 1700) < 100 and graph.leaks(split, "grp").count() == 0
    assert set(graph.greedy_assign([(str(i), {"a": 1 + i % 3}) for i in range(50)], {"train": 0.85, "val": 0.1, "test": 0.05}).values()) == {"train", "val", "test"}


def test_layout(spark):
    frame = spark.createDataFrame([("k", v) for v in (0.0, 1.0, 2.0, 3.0, 9.0)], "key string, v double")
    assert [(r.first, r.n) for r in layout.anchored_clusters(frame, "key", "v", 2.2).orderBy("first").collect()] == [(0.0, 3), (3.0, 1), (9.0, 1)]


def test_context(spark):
    rows = [("q", i, i, 1, f"text{i} " * 100) for i in range(6)] + [("q", 0, 5, 1, "text0 " * 100)]
    got = retrieval.assemble(spark.createDataFrame(rows, "qid string, pid long, priority int, seq int, text string")).first()
    assert got.n == 4 and got.context.count("---") == 3 and "text4" not in got.context


def test_gate(spark):
    frame = spark.createDataFrame([("a",), ("",)], "t string")
    found = checks(frame, {"empty": ("FAIL", F.col("t") == ""), "long": ("WARN", F.length("t") > 9)})
    assert {r.check: (r.level, r.n_bad) for r in found.collect()} == {"empty": ("FAIL", 1), "long": ("OK", 0)}
    with pytest.raises(ValueError, match="empty"):
        gate(found)


def test_files(spark, tmp_path):
    frame = spark.createDataFrame([("1", "x, \"y\"\nz"), ("2", None)], "a string, b string")
    files.write_csv(frame, ["a", "b"], str(tmp_path / "c"))
    files.write_jsonl(frame, str(tmp_path / "j"))
    assert {(r.a, r.b) for r in files.read_csv(spark, str(tmp_path / "c"), "a string, b string").collect()} == {("1", "x, \"y\"\nz"), ("2", None)}
    assert files.read_jsonl(spark, str(tmp_path / "j"), "a string, b string").count() == 2
    (tmp_path / "d.json").write_text('{"sections": [{"n": "1"}, {"n": "2"}]}')
    assert files.read_json_items(spark, str(tmp_path / "d.json"), "sections", "n: string").count() == 2
    known = files.manifest(spark, str(tmp_path / "d.json"))
    assert files.not_yet_loaded(known, known).count() == 0
    urls = spark.createDataFrame([("http://a.b/x/1",), ("http://a.b/y",)], "url string")
    assert files.allowed(urls, spark.createDataFrame([("a.b", "/x")], "host string, prefix string")).count() == 1


def test_overlap_of_long_texts_takes_no_pairs_of_words(spark):
    """Sixty thousand words a side: a look at every pair of positions would take minutes."""
    words = F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.concat(F.lit("w"), (i % 50_000).cast("string")))
    start = time.monotonic()
    got = spark.range(1).select(text.multiset_overlap(words, F.concat(words, words)).alias("n")).first().n
    assert got == 60_000
    assert time.monotonic() - start < 20


@pytest.mark.parametrize("f", [lambda c: text.shorten(text.clean_text(c), 60), lambda c: text.token_f1(text.clean_text(c), text.clean_text(c))])
def test_cleaning_stands_once_in_what_is_made_of_it(spark, f):
    shown = spark.createDataFrame([("a  b",)], "t string").select(f(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("——") <= 2


@pytest.mark.parametrize("given", ["a b", " a", "a ", "a  b", "a\tb", " a", "a ", "a\n\n b", "“a”", "a\x18b", "", "a ", "a\n"])
def test_clean_texts_stay_and_others_are_cleaned(spark, given):
    want = re.sub(r"\s*\n\s*", "\n", re.sub(r"[ \t\xa0]+", " ", given.translate({0x18: "˜", 0x201C: '"', 0x201D: '"'}))).strip()
    assert one(spark, given, text.clean_text) == want


def test_references_without_a_semicolon_stay(spark):
    got = one(spark, "<title>a &amp; b &amp</title><p>&copy; &copy &ampx; &#65; &#65 &amp;lt;</p>", lambda c: text.strip_html(c, closed=True))
    assert got == "a & b &amp© &copy &ampx; A &#65 &lt;"


def test_long_robots_files_are_split_once(spark):
    """Sixty thousand lines of one host: splitting the file again for each line would take hours."""
    body = "User-agent: *\n" + "\n".join(f"Disallow: /{i}" for i in range(60_000))
    start = time.monotonic()
    assert files.robots_rules(spark.createDataFrame([("h", body)], "host string, body string")).count() == 60_000
    assert time.monotonic() - start < 60
