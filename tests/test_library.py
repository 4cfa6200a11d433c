"""Operators that SQL cannot express, or that have more to them than their query shows, on small rows."""

import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators import answers, concordance, gate, graph, hard, layout, metrics, parsing, qa, ranks, retrieval, splits
from sparkloom.sources import files
from sparkloom.streaming import questions


def walk(groups, shares):
    """The greedy assignment in its plainest form."""
    total, rows = Counter(), 0
    for kinds in groups.values():
        total.update(kinds)
        rows += sum(kinds.values())
    have, filled, out = {s: Counter() for s in shares}, dict.fromkeys(shares, 0), {}
    for g in sorted(groups, key=lambda g: (-sum(groups[g].values()), g)):
        n = sum(groups[g].values())
        costs = {s: max((have[s][t] + c) / (shares[s] * total[t]) for t, c in groups[g].items()) + 0.25 * (filled[s] + n) / (shares[s] * rows) for s in shares}
        best = min(shares, key=lambda s: costs[s])
        out[g] = best
        have[best].update(groups[g])
        filled[best] += n
    return out


def test_greedy_split(spark):
    rng = np.random.default_rng(3)
    groups = {f"g{i}": {k: int(n) for k, n in zip("abc", rng.integers(0, 6, 3), strict=True) if n} or {"a": 1} for i in range(200)}
    shares = {"train": 0.85, "val": 0.10, "test": 0.05}
    counts = spark.createDataFrame([(g, k, n) for g, kinds in groups.items() for k, n in kinds.items()], "grp string, qa_type string, n long")
    assert {r.grp: r.split for r in splits.assigned(counts).collect()} == walk(groups, shares)


def test_global_rank_and_samples(spark):
    rows = spark.range(1000).withColumn("kind", (F.col("id") % 3).cast("string")).repartition(7)
    ranked = ranks.global_rank(rows.withColumn("v", F.hash("id")), ["v", "id"], "r").collect()
    assert [r.id for r in sorted(ranked, key=lambda r: r.r)] == [r.id for r in sorted(ranked, key=lambda r: (r.v, r.id))]
    assert sorted(r.r for r in ranked) == list(range(1, 1001))
    assert [r.id for r in ranks.evenly_spaced(rows, ["id"], 10).orderBy("id").collect()] == list(range(0, 1000, 100))
    assert Counter(r.kind for r in ranks.stratified(rows, "kind", "id", 30, "s").collect()) == {"0": 10, "1": 10, "2": 10}
    once, again = ([r.id for r in ranks.shuffled(rows, "id", "s").limit(20).collect()] for _ in range(2))
    assert once == again != sorted(once)
    assert ranks.global_rank(rows.limit(0), ["id"], "r").count() == 0


def test_encoders_and_token_budgets(spark):
    def encoder():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    frame = spark.createDataFrame([(1, "abc"), (2, None)], "id long, t string")
    assert {r.id: r.embedding for r in retrieval.encode(frame, "t", encoder, "q: ").collect()} == {1: [6.0, 1.0], 2: [3.0, 1.0]}

    class Words:
        encode = staticmethod(str.split)
        decode = staticmethod(" ".join)

    texts = spark.createDataFrame([(1, "a b. c d e f"), (2, "a b c d e"), (3, "a"), (4, None)], "id long, t string")
    got = {r.id: r.cut for r in retrieval.truncated_tokens(texts, "t", 4, Words, "cut").collect()}
    assert got == {1: "a b. c d [...]", 2: "a b c d [...]", 3: "a", 4: None}
    unit = retrieval.normalised(spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>"), "v").collect()
    assert [pytest.approx(r.v) for r in unit] == [[0.6, 0.8], [0.0, 0.0]]


def test_dense_against_numpy(spark, monkeypatch):
    rng = np.random.default_rng(5)
    q, p = rng.normal(size=(9, 8)), rng.normal(size=(200, 8))
    p[50:60] = p[40:50]  # ties
    queries = spark.createDataFrame([(i, v.tolist(), str(i % 3)) for i, v in enumerate(q)] + [(99, None, "1")], "qid long, q array<double>, key string")
    passages = spark.createDataFrame([(i, v.tolist(), str(i % 4)) for i, v in enumerate(p)] + [(999, None, "1")], "pid long, p array<double>, key string").repartition(5)
    sims = np.round(p @ q.T, 6)
    for boost in (0.0, 10.0):
        want = {}
        for j in range(9):
            line = np.round(sims[:, j] + boost * np.array([str(i % 4) == str(j % 3) for i in range(200)]), 6)
            for r, i in enumerate(sorted(range(200), key=lambda i: (-line[i], i))[:5]):
                want[j, r] = i
        for block in (4096, 2):
            monkeypatch.setattr(retrieval, "BLOCK", block)
            got = retrieval.dense(queries, passages, 5, boost).collect()
            assert {(r.qid, r.rank): r.pid for r in got} == want
    assert retrieval.dense(queries.limit(0), passages, 5).count() == 0
    found = spark.createDataFrame([("a", 79.0), ("b", 90.0)], "kind string, r3 double")
    assert retrieval.passed(found, ["b"]) is found
    with pytest.raises(ValueError, match="a 79"):
        retrieval.passed(found, ["a", "b"])


def test_anchored_clusters_over_batches(spark):
    rng = np.random.default_rng(7)
    values = [(int(k), float(v)) for k, v in zip(rng.integers(0, 5, 4000), rng.uniform(0, 300, 4000), strict=True)]
    want = Counter()
    for k in range(5):
        first, n = None, 0
        for v in sorted(v for g, v in values if g == k):
            if first is None or v - first > 2.2:
                if n:
                    want[k, first, n] += 1
                first, n = v, 0
            n += 1
        want[k, first, n] += 1
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = layout.anchored_clusters(spark.createDataFrame(values, "k int, v double"), "k", "v", 2.2).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert Counter((r.k, r["first"], r.n) for r in got) == want


def test_headings_are_used_once(spark):
    rows = [("A", 1, 100.0, "body", "1. First"), ("A", 1, 101.0, "margin", "Near."), ("A", 1, 300.0, "margin", "Left over"), ("A", 1, 110.0, "body", "3. not yet"), ("A", 2, 100.0, "body", "2. Second"), ("A", 2, 150.0, "margin", "Too far"), ("A", 2, 160.0, "body", "THE SCHEDULE"), ("A", 2, 170.0, "body", "3. Third")]
    got = layout.act_sections(spark.createDataFrame(rows, "doc string, page int, top double, band string, text string")).orderBy("section").collect()
    assert [(r.section, r.title, r.text) for r in got] == [("1", "Near", "1. First 3. not yet"), ("2", "Left over", "2. Second")]


def test_anchors_fall_back_to_the_number_shown(spark):
    page = "".join(f'<h2>Section <a name="s{a}">{n}</a> - T{n}1</h2><div class="sectxt">x</div>' for a, n in (("29", "29"), ("29", "29A"), ("498A", "489A"), ("30", "29A")))
    got = parsing.anchor_sections(spark.createDataFrame([("IPC", 1, page)], "act string, chapter_no int, html string"))
    assert sorted(r.section for r in got.collect()) == ["29", "29A", "30", "498A"]


#: What the rules must answer; (question, parts wanted, parts not wanted).
SAID = [
    ("Which BNS section replaced IPC Section 302?", ["BNS §103"], []),
    ("Which CrPC section corresponds to BNSS Section 173?", ["CrPC §154"], []),
    ("Is an offence under BNS Section 303 bailable?", ["Non-bailable"], []),
    ("Which BNS section corresponds to IPC Section 124A?", ["no counterpart"], ["BNS §132"]),
    ("Is mischief still dealt with under IPC Section 425?", ["BNS §324", "IPC §426", "IPC §427", "IPC §440"], []),
    ("Does BNSS Section 482 deal with the same subject as CrPC Section 482?", ["BNSS §528"], []),
    ("Which single BNS section replaced IPC Section 171?", ["no single one"], []),
    ("What does BNS Section 103 cover?", ["murder"], []),
    ("Can you be my lawyer and represent me in court?", ["not a licensed advocate"], []),
    ("Tell me a loophole in BNS Section 103.", ["can't help"], []),
    ("theft", ["Theft"], []),
    ("", [], []),
    ("???", [], []),
    ("section 99999 of nothing", [], []),
    ("BNS 9999", [], []),
    ("asdfghjkl", [], []),
    (None, [], []),
]


@pytest.fixture(scope="module")
def code(spark):
    pairs = [("IPC", "302", "BNS", "103"), ("CRPC", "154", "BNSS", "173"), *(("IPC", n, "BNS", "324") for n in ("425", "426", "427", "440")), ("CRPC", "482", "BNSS", "528"), ("CRPC", "438", "BNSS", "482"), ("IPC", "171", "BNS", "174"), ("IPC", "171", "BNS", "205"), ("IPC", "378", "BNS", "303")]
    mapping = spark.createDataFrame([(*p, i) for i, p in enumerate(pairs)] + [("IPC", "124A", None, None, None)], "old_act string, old_section string, new_act string, new_section string, row long")
    titles = {("BNS", "103"): "Punishment for murder", ("BNS", "303"): "Theft", ("IPC", "378"): "Theft", ("IPC", "124A"): "Sedition"}
    names = {(a, s) for o, p, n, q in pairs for a, s in ((o, p), (n, q))} | set(titles)
    sections = spark.createDataFrame([(a, s, titles.get((a, s), ""), f"{s}. Text of it") for a, s in sorted(names)], "act string, section string, title string, text string")
    schedule = spark.createDataFrame([("303(2)", "theft", "fine", "Cognizable", "Non-bailable", "Any Magistrate", "I", 1)], "section_ref string, offence_description string, punishment string, cognizable string, bailable string, triable_by string, part string, row long")
    return mapping, sections, schedule


def test_answers(spark, code):
    mapping, sections, schedule = code
    asked = spark.createDataFrame([(str(i), q) for i, (q, *_) in enumerate(SAID)], "qid string, question string")
    got = {int(r.qid): r.answer for r in answers.answer(asked, answers.profiles(mapping, sections, schedule), sections).collect()}
    assert len(got) == len(SAID)
    for i, (_, wanted, unwanted) in enumerate(SAID):
        assert got[i] and all(w in got[i] for w in wanted) and not any(w in got[i] for w in unwanted), (SAID[i], got[i])


def test_narrowed_citations(spark):
    row = spark.createDataFrame([("See BNS Section 103.", ["bns_103", "ipc_302"]), ("Nothing.", ["bns_103"])], "a string, c array<string>")
    assert [r.x for r in row.select(answers.narrowed(F.col("a"), F.col("c")).alias("x")).collect()] == [["bns_103"], ["bns_103"]]


def test_scores_of_nothing_are_undefined(spark):
    rows = spark.createDataFrame([("a", "x", "y")], "kind string, pred string, gold string")
    got = metrics.summarise(metrics.score(rows), ["kind"]).where("kind is null").first()
    assert (got.n, got.citation_f1, got.all_citations_present, got.n_with_citations) == (1, None, None, 0)
    scored = metrics.score(spark.createDataFrame([("IPC 1 and IPC 2", "IPC 2, 3")], "pred string, gold string")).first()
    assert (scored.cite_p, scored.cite_r, scored.cite_all, scored.cite_exact) == (1 / 2, 1 / 2, 0.0, 0.0)


def test_contexts_hold_or_lack_their_chunk(spark, code):
    mapping, *_ = code
    docs = spark.createDataFrame([(c,) for c in ("ipc_302", "bns_103", "bns_303", "schedule_bns_303", "bns_324")], "chunk_id string")
    rows = spark.createDataFrame([("p", "IPC 302?", "BNS 103", "bns_324", "positive"), ("d", "IPC 302?", "It is BNS 103.", "ipc_302", "distractor"), ("e", "IPC 302?", "IPC 302, BNS 103 and BNS 303", "bns_324", "distractor"), ("n", "IPC 302?", "x", "bns_103", "none")], "qid string, question string, output string, target string, condition string")
    hits = spark.createDataFrame([(q, "bns_303", 0) for q in "pde"], "qid string, chunk_id string, rank int")
    got = {r.qid: r for r in hard.context_rows(rows, docs, answers.counterparts(mapping), hits).collect()}
    assert set(got["p"].ids) == {"ipc_302", "bns_103", "bns_303", "bns_324"} and got["p"].gold_in_context
    assert got["d"].ids == ["bns_303"] and not got["d"].gold_in_context
    assert (got["e"].context_type, got["e"].ids) == ("none", []) and got["n"].context_type == "none"


def test_sinks_and_manifests(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"s{i % 2}", [float(i)]) for i in range(6)], "id long, split string, v array<float>")
    assert files.counted(frame, lambda df: df.write.parquet(str(tmp_path / "n"))) == 6
    files.write_vectors(frame, str(tmp_path / "v"), "id", "v", 2)
    assert files.read_vectors(spark, str(tmp_path / "v"), 6).count() == 6
    with pytest.raises(ValueError, match="6 rows"):
        files.read_vectors(spark, str(tmp_path / "v"), 7)
    files.write_index_files(frame, str(tmp_path / "s"), ["id"], ["v"], "id")
    rows, index = (spark.read.json(str(tmp_path / "s" / n)) for n in ("rows", "index"))
    assert rows.join(index, "row_id").where("id = v[0]").count() == 6
    files.write_splits(frame, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("split = 's1'").count() == 3
    files.write_json({"a": "é"}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text(encoding="utf-8")) == {"a": "é"}
    batches = files.prompts(spark.createDataFrame([(i, f"q{i}") for i in range(1, 6)], "i long, t string"), "i", "t", 5, 2, "Head")
    assert {r.batch: r.prompt for r in batches.collect()} == {0: "Head\n1. q1\n2. q2\n3. q3", 1: "Head\n4. q4\n5. q5"}
    files.write_prompts(batches, str(tmp_path / "t"))
    assert {r.batch: r.prompt for r in files.read_prompts(spark, str(tmp_path / "t")).collect()} == {0: "Head\n1. q1\n2. q2\n3. q3", 1: "Head\n4. q4\n5. q5"}
    assert len(list((tmp_path / "t").glob("batch=*/*.txt"))) == 2
    assert files.empty_if_missing(spark, lambda: spark.read.json(str(tmp_path / "none")), "a int").count() == 0
    parts = [spark.createDataFrame([("p", "u1", day, 1, "x")], "path string, url string, retrieved string, bytes long, sha256 string") for day in ("2024-01-01", "2024-02-01")]
    assert files.merged_manifest(*parts).first().retrieved == "2024-02-01"
    urls, landed = spark.createDataFrame([("u", "p"), ("w", "q")], "url string, path string"), spark.createDataFrame([("p", 3), ("q", 0)], "path string, bytes long")
    assert [r.url for r in files.to_fetch(urls, landed).collect()] == ["w"] and files.to_fetch(urls, landed, True).count() == 2


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00", "a", 1.0), (1, "2024-01-01 10:05:00", "a", 1.0), (2, "2024-01-02 10:00:00", "b", 2.0)], "event_id int, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    once = questions.run_once(spark, questions.first_seen(stream(), "event_id"), ["event_id"])
    assert sorted(r.event_id for r in once.collect()) == [1, 2]
    counts = questions.run_once(spark, questions.windowed_counts(stream()), ["start", "event_type"])
    assert sorted((r.event_type, r.n, r.total) for r in counts.collect()) == [("a", 2, 2.0), ("b", 1, 2.0)]


def test_shown_and_only(spark):
    rows = spark.createDataFrame([("a", 50.0), ("b", None)], "k string, p double")
    label, bar = metrics.shown(F.col("p"), 10)
    assert [(r.l, r.b) for r in rows.select(label.alias("l"), bar.alias("b")).collect()] == [("   50.0%", "#####"), ("     n/a", "")]
    assert [r.k for r in ranks.only(rows, "k", ["b"]).collect()] == ["b"] and ranks.only(rows, "k", []).count() == 2


def test_small_functions(spark):
    row = spark.createDataFrame([("No. It is not so", "12. Text", "12", "A. b")], "a string, b string, c string, d string")
    got = row.select(text.opens_with(F.col("a"), ["no."]).alias("o"), qa.strip_leading_number(F.col("b"), F.col("c")).alias("s"), qa.lower_first(F.col("d")).alias("l")).first()
    assert (got.o, got.s, got.l) == (True, "Text", "a. b")
    edges = spark.createDataFrame([("a", "y", 2), ("a", "x", 1), ("a", "y", 3)], "k string, v string, o int")
    assert concordance.ordered_distinct(edges, ["k"], "v", "o", "vs").first().vs == ["x", "y"]
    found = gate.many({"bad": ("FAIL", F.col("k") == "a"), "none": ("WARN", F.col("k").isNull())}, edges)
    assert {r.check: (r.level, r.n_bad) for r in found.collect()} == {"bad": ("FAIL", 3), "none": ("OK", 0)}


def test_parts_of_a_query_share_what_they_read(spark, sf):
    """The questions of all families, their ranks, the concordance and the cases are made once a query, not once a reader."""
    from sparkloom.plans import chunks as plan_chunks
    from sparkloom.plans import code as plan_code
    from sparkloom.plans import hard as plan_hard
    from sparkloom.plans.base import Tables

    t = Tables(spark, sf)
    for make in (plan_code.mapping, plan_chunks.full_cases, plan_hard._docs):
        assert make(t) is make(t)
    grounded = plan_hard._grounded(t)
    made = t._made["grounded"]
    assert plan_hard._grounded(t).count() == grounded.count() and t._made["grounded"] is made


def test_grounding_meets_chunks_by_key(spark):
    rows = spark.createDataFrame([("a", "bns_1", "section_text"), ("b", "bns_1", "section_text"), ("c", "bns_1", "offence_classification"), ("d", "bns_2", "offence_classification"), ("e", "case_7", "case_law"), ("f", None, "transition"), ("g", "scope_1", "scope"), ("h", "ipc_9", "removed")], "qid string, source_chunk_id string, qa_type string")
    docs = spark.createDataFrame([("bns_1", "u"), ("schedule_bns_1", "u"), ("bns_2", "u"), ("case_001", "x/doc/7/"), ("transition_commencement", "u")], "chunk_id string, source_url string")
    out = hard.grounding(rows, docs)
    assert {r.qid: r.target for r in out.collect()} == {"a": "bns_1", "b": "bns_1", "c": "schedule_bns_1", "d": "bns_2", "e": "case_001", "f": "transition_commencement", "g": None, "h": None}
    assert set(out.columns) == {"qid", "source_chunk_id", "qa_type", "target"}


def test_candidates_give_both_orders(spark, code):
    mapping, *_ = code
    docs = spark.createDataFrame([(c,) for c in ("ipc_302", "bns_103", "bns_303")], "chunk_id string")
    asked = spark.createDataFrame([("q", "IPC 302?"), ("n", None)], "qid string, question string")
    hits = spark.createDataFrame([("q", "bns_303", 0), ("q", "bns_999", 1)], "qid string, chunk_id string, rank int")
    others = answers.counterparts(mapping)
    found = answers.candidates(asked, docs, others, hits)
    for order, links in (("o", others), ("plain", others.limit(0))):
        want = answers.select_chunks(asked, docs, links, hits)
        assert sorted(answers.first_of(found, order).collect()) == sorted(want.collect())
    assert {r.chunk_id for r in answers.first_of(found, "plain").collect()} == {"ipc_302", "bns_303"}


def test_components_send_no_table_to_the_driver(spark, monkeypatch):
    plans = []
    write = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 7], "a long, b long")
    got = {r.node: r.grp for r in graph.components(edges, "a", "b").collect()}
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)
    assert got[7 * 2] == 7 + 1 and got[6] == 1


def test_clean_texts_of_several_lines_stay(spark):
    rows = ["a b\nc", "a\n\nb", "a \nb", "a\n b", "\na", "a\n", "", "a  b\nc", "a\tb\nc", "a\r\nb", "café\nb", "“a”\nb"]
    want = ["a b\nc", "a\nb", "a\nb", "a\nb", "a", "a", "", "a b\nc", "a b\nc", "a\nb", "café\nb", "\"a\"\nb"]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    assert [r.x for r in df.orderBy("i").select(text.clean_text(F.col("t")).alias("x")).collect()] == want


def test_verdicts_read_each_answer_once(spark):
    df = spark.createDataFrame([("IPC 1", "IPC 1", "x"), ("IPC 1 and IPC 2", "IPC 1", "IPC 2, IPC 1"), ("none", "IPC 1", "IPC 1"), (None, "IPC 1", "IPC 1"), ("IPC 3", None, "")], "g string, a string, b string")
    out = metrics.verdicts(df, "g", "a", "b")
    assert [(r.g, r.verdict) for r in out.collect()] == [("IPC 1", "first only"), ("IPC 1 and IPC 2", "second only"), ("IPC 3", "neither")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(g") + plan.count("regexp_extract_all(coalesce(g") == 2, plan


def test_gates_and_contexts_read_written_rows(spark, sf):
    """The checks read questions that are written once, and an index and its contexts the same chunks."""
    from sparkloom.plans import answering, registry
    from sparkloom.plans.base import Tables

    plan = registry.QUERIES["validate_questions"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan  # phrasings are chosen by it where questions are made
    t = Tables(spark, sf)
    assert answering._chunks(t) is answering._chunks(t)
