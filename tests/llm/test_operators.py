"""Every corpus operator against a plain brute-force version, on a small table with edge rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from html import unescape
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from sparkloom.llm import decontaminate, html_extract, lattice_lm, license_scan, line_templates, ngram_join, quality, queries, sentencepiece_codec, suffix_dedup, warc
from sparkloom.llm.common import components
from sparkloom.llm.queries import PIECES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, set string, c0 string"
SPACE = "[ \t\n\x0b\x0c\r]+"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


WORDS = [a + b + c for a in ("ta", "ri", "mo", "éle", "sh") for b in ("n", "st", "ou", "") for c in ("ing", "er", "as", "o", "il")]


def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(30, 120)) for _ in range(40)]
    out = list(base)
    for t in base[:8]:
        w = t.split()
        w[len(w) // 2] = "changed"
        out.append(" ".join(w))
    out += base[:3] * 2
    passage = prose(rng, 60)
    out += [f"{prose(rng, 30)}\n{passage}\n{prose(rng, 20)}" for _ in range(6)]
    out += [f"{prose(rng, 25)}\nread more about item {i} here today\nshared line of the site\n{prose(rng, 15)}" for i in range(25)]
    out += ["ab" * 400, "a" * 900, None, "", " \n\t ", "one two", "one two", "x y   z", "Ünï\u0085cödé ▁▁ a  b\n\n c ", "same\nsame\nsame\nother words stand here now yes", "👍🏽 " * 30, "w " * 3000]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 17 else None, t, "en", "src0", len(t or ""), "x", "y", "z") for i, t in enumerate(texts(), 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def multiset(rows):
    return Counter(tuple(r) for r in rows)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def measures(text):
    t = text or ""
    w = [x for x in re.split(SPACE, t) if x]
    lines = [x for x in t.split("\n") if re.sub(SPACE, "", x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    over = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(over)


def test_quality(spark, docs, rows):
    got = quality.measured(docs)
    want = Counter()
    for r in rows:
        m = measures(r.text)
        want[(r.doc_id, *m, m[0] < 10 or 100 * m[4] > 20 * m[0])] += 1
    assert multiset(got.drop("kept").collect()) == want
    assert not got.where("base_failed and kept").count()
    judged = quality.apply_rules(docs)
    assert judged.columns == [*docs.columns, "failed_rule"]
    assert judged.where("failed_rule is null").count() == got.where("kept").count()
    assert quality.measured(empty(spark)).count() == 0
    m = {k: quality.F.col(k) for k in ("n_words",)}
    order = quality.plan_cascade(docs, quality.BASE)
    assert sorted(order) == sorted(quality.BASE) and m


def covered(all_texts, length):
    data = [(t or "").encode() for t in all_texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    for d in data:
        over = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                over[i : i + length] = True
        left = bytes(b for b, o in zip(d, over, strict=True) if not o)
        runs = int(np.count_nonzero(np.diff(np.concatenate(([0], over.astype(int)))) == 1))
        yield len(d), int(over.sum()), runs, sha256(left).hexdigest()


@pytest.mark.parametrize(("length", "gram", "bucket"), [(200, 64, 40_000), (40, 16, 40_000), (40, 16, 3)])
def test_suffix_dedup(docs, rows, length, gram, bucket):
    got = suffix_dedup.dedup_substrings(docs, length, gram, bucket)
    want = Counter((r.doc_id, *c) for r, c in zip(rows, covered([r.text for r in rows], length), strict=True))
    assert multiset(got.collect()) == want


@pytest.mark.parametrize("period", [3, 5, 7])
def test_blocks_are_sorted_by_ranks_of_the_cover(period):
    rng = np.random.default_rng(period)
    data = rng.integers(0, 2, 3000).astype(np.uint8)
    data[1000:1700] = data[200:900]
    data[2000:2500] = 7
    length, cover = 60, suffix_dedup.difference_cover(period)
    eight = suffix_dedup.leading(data, length)
    places = rng.permutation(len(data) - length)[:1200].astype(np.int64)
    rank = suffix_dedup.cover_ranks(eight, places, length, period, cover)
    line = suffix_dedup.sorted_block(places, eight, rank, period, cover)
    raw = data.tobytes()
    got = [raw[p : p + length] for p in line]
    assert sorted(line.tolist()) == sorted(places.tolist()) and got == sorted(got)


def test_suffix_dedup_edges(spark):
    assert suffix_dedup.dedup_substrings(empty(spark)).count() == 0
    assert suffix_dedup.difference_cover(16) == [0, 1, 2, 3, 4, 8, 12]
    for p in (4, 9, 16, 30):
        cover = suffix_dedup.difference_cover(p)
        assert {(a - b) % p for a in cover for b in cover} == set(range(p))


def scan(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(label, i) for label, p in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for _, i in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for x, _ in hits}))


def test_licenses(spark, rows):
    more = ["Released under the MIT License. (under the mit-license)", "Licensed under CC BY-NC 4.0.", "APACHE license, version 2.0 and cc by nc cc by nc", "licenced under teh gnu general public license version 3", "Permission is hereby granted, free of charge, to any person obtaning a copy", "is licensed under the apache licence version 2.0", "cc by ncé under the mitx license"]
    given = [(r.doc_id, r.text) for r in rows] + [(1000 + i, t) for i, t in enumerate(more)]
    got = license_scan.scan_licenses(spark.createDataFrame(given, "doc_id long, text string"))
    assert multiset(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()) == Counter((d, *scan(t)) for d, t in given)
    by = {r.doc_id: r for r in got.collect()}
    assert by[1003].labels == "gpl-3" and by[1003].spans[0].edits == 3 and 0 < by[1003].score < 1
    assert "mit" in by[1004].labels and by[1005].labels == "apache-2" and by[1006].base_labels == ""
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) for r in by.values() if r.base_labels)
    assert license_scan.scan_licenses(empty(spark)).count() == 0


def test_license_seeds_lose_nothing():
    import regex

    scanner, rng = license_scan.Scanner(), random.Random(3)
    for label, notice in license_scan.NOTICES:
        e = license_scan.edits_of(notice)
        for _ in range(20):
            s = list(notice)
            for _ in range(e):
                i = rng.randrange(len(s))
                s[i : i + rng.randint(0, 1)] = rng.choice(["", "q", "z"])
            words = scanner.normal("start " + "".join(s) + " end")
            plain = regex.search(rf"(?<![^ ])(?:{regex.escape(notice)}){{e<={e}}}(?![^ ])", words.decode())
            assert bool(plain) <= any(x[0] == label or x[3] <= e for x in scanner.fuzzy(words))
            if not e or notice in words.decode():
                assert any(x[0] == label for x in scanner.fuzzy(words))


def test_notices_end_with_words_and_the_best_one_explains_a_place():
    scanner = license_scan.Scanner()
    assert scanner.fuzzy(b"small rights reserved seats") == []
    assert {x[0] for x in scanner.fuzzy(b"licensed under cc by sa 4 0")} == {"cc-by-sa"}
    assert {x[0] for x in scanner.fuzzy(b"licensed under cc by nd 4 0")} <= {"cc-by-nc", "cc-by-sa", "cc-by"}
    assert {x[0] for x in scanner.fuzzy(b"it is licensed under the gnu general public license version 3 here")} >= {"gpl-3"}


def test_unclosed_cdata_is_read_once():
    import time

    began = time.process_time()
    assert html_extract.main_texts([html_extract.blocks_of("<article>" + "<![CDATA[x " * 20000 + "<p>end</article>")])[0].endswith("end")
    assert time.process_time() - began < 3
    assert html_extract.main_texts([html_extract.blocks_of("<article><p>a<![CDATA[b < c]]> d</article>")]) == ["ab < c d"]


def test_adjacent_notices_each_give_a_span():
    scanner = license_scan.Scanner()
    assert [x[:4] for x in scanner.fuzzy(b"all right reserved all rights reserved")] == [("proprietary", 0, 18, 1), ("proprietary", 19, 38, 0)]
    words = b"released under the mitt license releasd under the mit license released under the mit license"
    assert [x[3] for x in scanner.fuzzy(words) if x[0] == "mit"] == [1, 1, 0]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_match():
    rng = np.random.default_rng(1)
    for _ in range(40):
        item, area = rng.integers(1, 5, rng.integers(1, 8)), rng.integers(1, 5, rng.integers(0, 12))
        least = min(edits(list(item), list(area[i:j])) for i in range(len(area) + 1) for j in range(i, len(area) + 1))
        assert decontaminate.edit_match(item, area)[0] == least


def test_decontaminate(spark, docs, rows):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.randint(14, 60))) for i in range(60)]
    given, want = [], set()
    for i, (item, text) in enumerate(items):
        w = text.split()
        for _ in range(int(len(w) * (0, 0.05, 0.1, 0.15)[i % 4])):
            p = rng.randrange(len(w))
            w[p : p + rng.randint(0, 1)] = [rng.choice(["qq", "zz", "ww"])]
        given.append((5000 + i, f"{prose(rng, 50)} {' '.join(w).upper()}. {prose(rng, 50)}"))
        want.add((5000 + i, item))
    items += [(900, None), (901, ""), (902, "two words")]
    frame = spark.createDataFrame(given + [(r.doc_id, r.text) for r in rows], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(frame, table)
    found = {(r.doc_id, r.item_id): r for r in got.collect()}
    # brute force: the least edits over every stretch of every text
    ids = {}
    true = {}
    for d, t in given:
        area = np.array([ids.setdefault(w, len(ids)) for w in decontaminate.words_of(t)])
        for item, text in items:
            w = decontaminate.words_of(text)
            if w and (n := decontaminate.edit_match(np.array([ids.setdefault(x, len(ids)) for x in w]), area)[0]) <= decontaminate.radius(len(w)):
                true[d, item] = n
    assert want <= set(true)
    mine = {k for k in found if k[0] in {d for d, _ in given}}
    assert mine <= set(true)
    assert len(mine) >= 0.97 * len(true)
    clean = decontaminate.drop_leaks(docs, table)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert decontaminate.drop_leaks(frame, table.limit(60)).where("doc_id >= 5000").count() <= 2
    assert decontaminate.find_leaks(empty(spark), table).count() == 0
    assert decontaminate.find_leaks(docs, table.limit(0)).count() == 0


def test_long_items_are_found_at_the_full_radius():
    rng = random.Random(31)
    vocabulary = [f"w{i}" for i in range(3000)]
    for n in (25, 30, 60, 100, 200, 300):
        items = [[rng.choice(vocabulary) for _ in range(n)] for _ in range(60)]
        given = []
        for w in items:
            w = list(w)
            for _ in range(decontaminate.radius(n)):
                p = rng.randrange(len(w))
                w[p : p + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 1)
            given.append(" ".join([prose(rng, 20), *w, prose(rng, 20)]))
        found = {(d, i) for d, i, *_ in decontaminate.Index([(i, " ".join(w)) for i, w in enumerate(items)]).find(given)}
        assert sum((i, i) in found for i in range(60)) >= decontaminate.RECALL * 60


def gram_set(text):
    w = (text or "").lower()
    w = [x for x in re.split(SPACE, w) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(texts, t=0.8):
    sets = [gram_set(x) for x in texts]
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= t * len(a | sets[j]) - 1e-9:
                links[i].add(j)
                links[j].add(i)
    root = list(range(len(texts)))
    for i in range(len(texts)):
        todo = [i]
        while todo:
            k = todo.pop()
            for j in links[k]:
                if root[j] > root[i]:
                    root[j] = root[i]
                    todo.append(j)
    return root, links


def test_near_duplicates(spark, docs, rows):
    got = ngram_join.near_duplicates(docs).collect()
    root, links = brute_classes([r.text for r in rows])
    members = defaultdict(list)
    for i, r in enumerate(root):
        members[r].append(i)
    least = {r: min((rows[i].doc_id for i in m if rows[i].doc_id is not None), default=None) for r, m in members.items()}
    want = Counter((r.doc_id, least[root[i]], len(members[root[i]]), len(links[i])) for i, r in enumerate(rows))
    assert Counter((r.doc_id, r.class_id, r.class_size, r.n_links) for r in got) == want
    one = ngram_join.keep_one(docs)
    assert one.columns == docs.columns and one.count() == len(members)
    assert ngram_join.near_duplicates(empty(spark)).count() == 0
    assert ngram_join.keep_one(empty(spark)).count() == 0


def test_near_duplicates_in_chunks(spark, monkeypatch):
    rng = random.Random(2)
    base = [prose(rng, 150).split() for _ in range(3)]
    given = []
    for i in range(90):
        w = list(base[i % 3])
        w[rng.randrange(len(w))] = f"e{i}"
        given.append((i, " ".join(w)))
    frame = spark.createDataFrame(given, "doc_id long, text string")
    root, links = brute_classes([t for _, t in given])
    want = Counter((i, root[i], len(links[i])) for i, _ in given)
    monkeypatch.setattr(ngram_join, "CHUNK_SETS", 7)
    got = ngram_join.near_duplicates(frame)
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got.collect()) == want


def test_bands():
    bands, per = ngram_join.choose_bands(0.8, 0.9995)
    assert 1 - (1 - 0.8**per) ** bands >= 0.9995
    sets = [np.unique(np.random.default_rng(k).integers(0, 900, 300)).astype(np.uint64) for k in range(60)]
    left, right = np.nonzero(np.triu(np.ones((60, 60)), 1))
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(left, right, strict=True)]
    assert ngram_join._common(sets, left, right).tolist() == want
    assert ngram_join._common(sets, left[:50], right[:50]).tolist() == want[:50]


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100, 102: 100}


def brute_lines(rows, min_docs, depth=3, share=0.7):
    """Texts without recurring lines, by plain dictionaries."""
    seen, per_leaf = defaultdict(set), defaultdict(lambda: defaultdict(set))
    parsed = []
    for r in rows:
        lines = (r.text or "").split("\n")
        sign = max((len(x), x) for x in lines)[0], sorted({x for x in lines if len(x) == max(map(len, lines))})[0]
        mine = []
        for x in lines:
            w = tuple("<*>" if re.search("[0-9]", t) else t for t in re.split(SPACE, x) if t)
            mine.append(w)
            if w:
                seen[w].add(sign)
                per_leaf[len(w), w[:depth]][w].add(sign)
        parsed.append((lines, mine))
    out = {w for w, s in seen.items() if len(s) >= min_docs}
    for kinds in per_leaf.values():
        if sum(map(len, kinds.values())) < min_docs or len(kinds) < 2:
            continue
        rare = {w: s for w, s in kinds.items() if w not in out}
        at = Counter((i, t) for w, s in rare.items() for i, t in enumerate(w) for _ in s)
        grown = defaultdict(list)
        for w in rare:
            fixed = tuple((i, t) for i, t in enumerate(w) if at[i, t] >= min_docs and t != "<*>")
            if len(fixed) >= math.ceil(share * len(w)):
                grown[fixed, len(w)].append(w)
        for group in grown.values():
            if len(set().union(*(rare[w] for w in group))) >= min_docs:
                out |= set(group)
    for r, (lines, mine) in zip(rows, parsed, strict=True):
        if r.text is None:
            yield r.doc_id, None, 0
        else:
            yield r.doc_id, "\n".join(x for x, w in zip(lines, mine, strict=True) if w not in out), sum(w in out for w in mine)


def test_lines(spark, docs, rows):
    got = line_templates.drop_recurring_lines(docs)
    want = list(brute_lines(rows, 20))
    assert multiset(got.select("doc_id", "text", "n_lines_dropped").collect()) == Counter(want)
    assert sum(n for *_, n in want) == 50
    assert got.columns == [*docs.columns, "n_lines_dropped"]
    assert line_templates.drop_recurring_lines(empty(spark)).count() == 0


def test_line_fields_grow(spark):
    rng = random.Random(4)
    given = [(i, f"{prose(rng, 20)}\nwritten by staff member {rng.choice(WORDS)}{i}x{'abc'[i % 3]} for the evening news\n{prose(rng, 10)}".replace("0", "o").translate(str.maketrans("123456789", "abcdefghi"))) for i in range(40)]
    frame = spark.createDataFrame(given, "doc_id long, text string")
    got = line_templates.drop_recurring_lines(frame).collect()
    assert all(r.n_lines_dropped == 1 and "staff" not in r.text for r in got)
    assert multiset((r.doc_id, r.text, r.n_lines_dropped) for r in got) == Counter(brute_lines(frame.collect(), 20))


def test_shared_longest_line_recurs(spark):
    rng = random.Random(12)
    notice, footer = prose(rng, 60), "footer of the same site"
    given = [(i, f"{prose(rng, 12)}\n{notice}\n{footer}\n{prose(rng, 9)}") for i in range(100)]
    copies = [(1000 + i, f"{prose(random.Random(77), 40)}\nan own short line") for i in range(30)]
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(spark.createDataFrame(given + copies, "doc_id long, text string")).collect()}
    for i, text in given:
        assert got[i].n_lines_dropped == 2
        assert got[i].text == "\n".join(x for x in text.split("\n") if x not in (notice, footer))
    assert all(got[i].text == text and got[i].n_lines_dropped == 0 for i, text in copies)


def test_hot_variants_count_for_their_template(spark):
    rng = random.Random(13)
    ends = ["news"] * 60 + ["sports", "films", "music", "books"] * 3
    given = [(i, f"{prose(rng, 12)}\nposted by anna in {x}\n{prose(rng, 9)}") for i, x in enumerate(ends)]
    # two frequent words at a field's place, each rare beside the other words
    given += [(1000 + i, f"{prose(rng, 12)}\nwritten by our staff member {x} for evening readers\n{prose(rng, 9)}") for i, x in enumerate(["bob"] * 30 + [f"{a}x" for a in "abcdefghijkl"])]
    given += [(2000 + i, f"{prose(rng, 12)}\nposted by anna at {w}") for i, w in enumerate(WORDS[:5])]
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(spark.createDataFrame(given, "doc_id long, text string")).collect()}
    for i, text in given:
        lines = text.split("\n")
        assert (got[i].text, got[i].n_lines_dropped) == ((text, 0) if i >= 2000 else ("\n".join((lines[0], lines[2])), 1))


def test_sentencepiece(spark, docs, rows):
    from sentencepiece import SentencePieceProcessor

    peer = SentencePieceProcessor(model_file=PIECES)
    got = sentencepiece_codec.encode_texts(docs, PIECES).collect()
    want = Counter((r.doc_id, tuple(peer.encode(r.text or "")), "▁" not in (r.text or "")) for r in rows)
    assert Counter((r.doc_id, tuple(r.ids), r.round_trip) for r in got) == want
    assert all(r.parity for r in got)
    back = sentencepiece_codec.decode_ids(spark.createDataFrame([(r.doc_id, r.ids) for r in got], "doc_id long, ids array<int>"), PIECES)
    assert Counter(tuple(r) for r in back.collect()) == Counter((r.doc_id, (r.text or "").replace("▁", " ")) for r in rows)
    assert sentencepiece_codec.encode_texts(empty(spark), PIECES).count() == 0


def test_unigram_models():
    import io

    import sentencepiece

    def field(number, wire, value):
        def varint(n):
            out = b""
            while n > 127:
                out += bytes([n & 127 | 128])
                n >>= 7
            return out + bytes([n])

        return varint(number << 3 | wire) + (varint(len(value)) + value if wire == 2 else varint(value) if wire == 0 else value)

    import struct

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", -20.0, 6) for b in range(256)]
    pieces += [(t, s, 1) for t, s in (("▁", -3.0), ("▁a", -2.5), ("b", -3.1), ("ab", -2.9), ("a", -3.3), ("▁ab", -5.0), ("c", -4.0), ("bc", -4.5))]
    data = b"".join(field(1, 2, field(1, 2, t.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, k)) for t, s, k in pieces)
    data += field(2, 2, field(3, 0, 1) + field(35, 0, 1)) + field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 0) + field(5, 0, 1))
    model = sentencepiece_codec.parse_model(data)
    assert model.kind == 1 and model.byte_fallback and not model.remove_extra_spaces
    peer = sentencepiece.SentencePieceProcessor(model_proto=data)
    codec = sentencepiece_codec.Codec(data, True)
    given = ["ab abc", "a b c", "abab é b", "", "cab  bc"]
    assert [x.tolist() for x, *_ in codec.encode(given)] == [peer.encode(t) for t in given]
    assert io and lattice_lm.start_weights(model)["▁a"] == pytest.approx(-2.5)


def test_user_defined_pieces_come_first():
    import struct

    import sentencepiece

    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    def field(number, wire, value):
        return varint(number << 3 | wire) + (varint(len(value)) + value if wire == 2 else varint(value) if wire == 0 else value)

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("XY", 0.0, 4)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [(t, -float(i), 1) for i, t in enumerate(("ab", "▁ab", "aX", "▁", "a", "b", "X", "Y", "c"))]
    data = b"".join(field(1, 2, field(1, 2, t.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, k)) for t, s, k in pieces)
    data += field(2, 2, field(3, 0, 2) + field(35, 0, 1)) + field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 0) + field(5, 0, 1))
    peer = sentencepiece.SentencePieceProcessor(model_proto=data)
    codec = sentencepiece_codec.Codec(data, True)
    given = ["ab aXY c", "XYXY", "aX XYab", "abc", ""]
    for t, (ids, back, same) in zip(given, codec.encode(given), strict=True):
        assert ids.tolist() == peer.encode(t) and same and back


def test_line_dedup_twice(spark, docs):
    once = line_templates.drop_recurring_lines(docs)
    again = line_templates.drop_recurring_lines(once)
    assert again.columns == once.columns
    assert multiset(again.select("doc_id", "text", "n_lines_dropped").collect()) == multiset(once.select("doc_id", "text", "n_lines_dropped").collect())


def test_cascade_takes_cheap_rules_first(spark, docs):
    rules = {"repeats": quality.BASE["repeats"], "few_words": quality.BASE["few_words"], "symbols": quality.METHOD["symbols"]}
    orders = {tuple(quality.plan_cascade(docs, rules)) for _ in range(3)}
    assert len(orders) == 1 and next(iter(orders)).index("few_words") < next(iter(orders)).index("repeats")
    with pytest.raises(ValueError, match="failed_rule"):
        quality.apply_rules(docs.withColumn("failed_rule", docs.lang))


def test_keys_that_are_no_numbers_become_null(spark):
    frame = spark.createDataFrame([("a1", "some words stand here"), ("7", "some words stand here")], "doc_id string, text string")
    assert sorted(r.doc_id or 0 for r in license_scan.scan_licenses(frame).collect()) == [0, 7]
    assert sorted((r.doc_id or 0, r.class_size) for r in ngram_join.near_duplicates(frame).collect()) == [(0, 2), (7, 2)]


def test_plain_text_drops_tags_over_several_lines():
    assert warc.plain_text("<p>a <a\nhref='x'\n>b</a> &amp;&#10;c</p><br\n/>d") == "a b & c\nd"


def test_words_summed_side_by_side_equal_words_summed_alone():
    lattice = lattice_lm.Lattice(lattice_lm.start_weights(sentencepiece_codec.parse_model(Path(PIECES).read_bytes())))
    mark = lattice_lm.MARK
    words = [mark + w for w in ("the", "", "a", "thing", "h\u00e9llo", "\U0001d4b3y\U0001f600", "\x00\x00", "ab" * 60, "the", "x" * lattice_lm.SIDE_BY_SIDE)]
    assert lattice.forward_all(words) == pytest.approx([lattice.forward(w) for w in words])
    alone, together = defaultdict(float), defaultdict(float)
    for n, w in enumerate(words):
        lattice.expect(w, n + 1, alone)
    lattice.expect_all(words, list(range(1, len(words) + 1)), together)
    assert all(together[p] == pytest.approx(alone[p], abs=1e-6) for p in {*alone, *together})
    assert lattice.forward_all([]) == []


def test_lattice_sums_all_segmentations():
    weights = {p: math.log(x) for p, x in {"▁": 0.1, "▁a": 0.2, "a": 0.1, "b": 0.2, "ab": 0.1, "▁ab": 0.05, "<0xC3>": 0.01, "<0xA9>": 0.02}.items()}

    def total(s):
        if not s:
            return 1.0
        out = sum(math.exp(weights[s[:n]]) * total(s[n:]) for n in range(1, len(s) + 1) if s[:n] in weights)
        return out + (math.exp(weights["<0xC3>"] + weights["<0xA9>"]) * total(s[1:]) if s[0] == "é" else 0)

    lattice = lattice_lm.Lattice(weights)
    for word in ("▁ab", "▁abab", "▁aébab"):
        assert lattice.forward(word) == pytest.approx(math.log(total(word)))
        into = Counter()
        lattice.expect(word, 2.0, into)
        letters = sum(n * (0.5 if p.startswith("<") else len(p)) for p, n in into.items())
        assert letters == pytest.approx(2.0 * len(word))


def lattice_sums(word, weights):
    """(sum over all segmentations, expected count of every piece), by plain prefix and suffix sums."""
    n = len(word)
    arcs = []
    for i in range(n):
        for j in range(i + 1, n + 1):
            if word[i:j] in weights:
                arcs.append((i, j, math.exp(weights[word[i:j]]), [word[i:j]]))
        if word[i] not in weights:
            spelled = [f"<0x{b:02X}>" for b in word[i].encode()]
            arcs.append((i, i + 1, math.exp(sum(weights[p] for p in spelled)), spelled))
    a, b = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for i, j, w, _ in sorted(arcs):
        a[j] += a[i] * w
    for i, j, w, _ in sorted(arcs, key=lambda x: -x[1]):
        b[i] += b[j] * w
    count = Counter()
    for i, j, w, pieces in arcs:
        for p in pieces:
            count[p] += a[i] * w * b[j] / a[n]
    return a[n], count


def brute_scores(texts, held, weights, rounds):
    words = [[x for x in re.split(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x] for t in texts]
    ends = held.count(False)
    train = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    if rounds:
        got = Counter()
        for w, c in train.items():
            for p, x in lattice_sums("▁" + w, weights)[1].items():
                got[p] += c * x
        total = sum(got[p] + lattice_lm.PRIOR for p in weights) + ends + lattice_lm.PRIOR
        weights = {p: math.log((got[p] + lattice_lm.PRIOR) / total) for p in weights}
        end, on = (ends + lattice_lm.PRIOR) / total, 1.0
    else:
        end = (ends + 0.5) / (sum(train.values()) + ends + 1)
        on = 1 - end
    return [math.log10(end) + sum(math.log10(on * lattice_sums("▁" + w, weights)[0]) for w in ws) for ws in words]


def unigram_model():
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    def field(number, wire, value):
        return varint(number << 3 | wire) + (varint(len(value)) + value if wire == 2 else varint(value) if wire == 0 else value)

    pieces = [("<unk>", 0.0, 2)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] + [(t, -1.5 - 0.1 * i, 1) for i, t in enumerate(("▁", "▁ta", "ta", "n", "t", "a", "ing", "in", "g", "er", "as", "il", "st", "o", "i", "r", "e", "s", "l"))]
    data = b"".join(field(1, 2, field(1, 2, t.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, k)) for t, s, k in pieces)
    return data + field(2, 2, field(3, 0, 1) + field(35, 0, 1)) + field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 0) + field(5, 0, 1))


@pytest.mark.parametrize("kind", ["merges", "unigram"])
def test_language_model_scores(spark, tmp_path, kind):
    (tmp_path / "u.model").write_bytes(unigram_model())
    path = PIECES if kind == "merges" else str(tmp_path / "u.model")
    rng = random.Random(41)
    given = [(i, prose(rng, 12) + (" Ü" if i % 3 else "") + (" " + "taning" * 20 if i % 5 == 0 else "")) for i in range(30)] + [(30, None), (31, "")]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in given]
    weights = lattice_lm.start_weights(sentencepiece_codec.parse_model(Path(path).read_bytes()))
    want = brute_scores([t for _, t in given], held, weights, int(kind == "merges"))
    for head in (1000, 3):
        got = {r.doc_id: r.score for r in lattice_lm.score_texts(spark.createDataFrame(given, "doc_id long, text string"), path, head_words=head).collect()}
        assert [got[i] for i, _ in given] == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize("head", [50_000, 5])
def test_language_model(spark, docs, rows, head):
    got = lattice_lm.score_texts(docs, PIECES, head_words=head).collect()
    words = [[x for x in re.split(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) if x] for r in rows]
    fold = [zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 1 for r in rows]
    count = Counter(w for ws, h in zip(words, fold, strict=True) if not h for w in [*ws, None])
    total, kinds = sum(count.values()), len(count)
    want = Counter()
    for r, ws, h in zip(rows, words, fold, strict=True):
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in [*ws, None])
        want[(r.doc_id, h, len(ws) + 1, sum(count[w] > 0 for w in [*ws, None]), total, round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    short = {r.score for r in got if r.n_tokens == 1}
    assert max(short) - min(short) < 1e-9
    assert lattice_lm.score_texts(empty(spark), PIECES).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p><article>no";</script></head><body class="ad-free">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy</div><div id="cookie-notice"><div>We use</div> cookies</div>
<article><header><h1>Head&nbsp;line</h1></header><p><b>One &lt;two&gt;<br>three<p>Four   <i>fi</i>ve<!-- no --> &eacute;<div class="share">tweet</div><form><p>mail</form><p>Last</article>
<section class="comments"><p>first!</p></section><aside>side</aside><footer>&copy;</footer></body></html>"""


def test_html(spark):
    want = "Head line\nOne <two> three\nFour five é\nLast"
    assert html_extract.main_texts([html_extract.blocks_of(PAGE)]) == [want]
    rng = random.Random(8)
    bar = prose(rng, 20)
    bodies = [prose(rng, 30) for _ in range(12)]
    given = [(i, "http://h.example/x", f"<body><div>{bar}</div><div>{b}</div>", 1) for i, b in enumerate(bodies)]
    given += [(100, "http://h.example/y", PAGE, 1), (101, None, None, 1), (102, "http://h.example", "", None), (102, "http://h.example", "", None)]
    frame = spark.createDataFrame(given, "page_id long, url string, html string, host int")
    got = html_extract.extract_text(frame)
    assert Counter((r.page_id, r.text) for r in got.collect()) == Counter([*enumerate(bodies), (100, want), (101, ""), (102, ""), (102, "")])
    assert html_extract.extract_text(frame.limit(0)).count() == 0


def test_html_outside_the_article(spark):
    rng = random.Random(21)
    bar, heads, bodies = prose(rng, 20), [prose(rng, 6) for _ in range(5)], [prose(rng, 30) for _ in range(5)]
    given = [(i, "http://a.example/", f"<body><h1>{h}</h1><article><p>teaser {i}</article><div>{bar}</div><div>{b}</div>") for i, (h, b) in enumerate(zip(heads, bodies, strict=True))]
    got = {r.page_id: r.text for r in html_extract.extract_text(spark.createDataFrame(given, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{h}\nteaser {i}\n{b}" for i, (h, b) in enumerate(zip(heads, bodies, strict=True))}


def test_html_behaves_alike_at_every_size(spark, monkeypatch):
    rng = random.Random(22)
    bar = prose(rng, 20)
    bodies = [prose(rng, 30) for _ in range(60)]
    given = [(i, f"http://b.example/{i}", f"<body><div>{b}</div>" + (f"<div>{bar}</div>" if i % 10 == 0 else "")) for i, b in enumerate(bodies)]
    frame = spark.createDataFrame(given, "page_id long, url string, html string")
    for pages in (256, 4):
        monkeypatch.setattr(html_extract, "CHUNK_PAGES", pages)
        assert {r.page_id: r.text for r in html_extract.extract_text(frame).collect()} == dict(enumerate(bodies))


@pytest.mark.parametrize("chunk", [256, 4])
def test_html_copies_of_a_page_keep_their_text(spark, monkeypatch, chunk):
    monkeypatch.setattr(html_extract, "CHUNK_PAGES", chunk)
    rng = random.Random(23)
    body, bar, others = prose(rng, 40), prose(rng, 20), [prose(rng, 30) for _ in range(4)]
    given = [(1, "http://c.example/", f"<body><p>{body}</p>")] * 4 + [(2, f"http://c.example/{i}", f"<body><p>{body}</p>") for i in range(3)]
    given += [(10 + i, "http://c.example/o", f"<body><p>{x}</p><p>{bar}</p>") for i, x in enumerate(others)]
    got = html_extract.extract_text(spark.createDataFrame(given, "page_id long, url string, html string"))
    assert Counter((r.page_id, r.text) for r in got.collect()) == Counter([(1, body)] * 4 + [(2, body)] * 3 + [(10 + i, x) for i, x in enumerate(others)])


def test_html_on_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract_text(pages).collect()}
    for p in pages.collect():
        inner = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]+>", "", re.sub("<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[p.page_id].text == "\n".join(b for b in blocks if b)
        assert got[p.page_id].n_chars == len(got[p.page_id].text)


def test_covered_runs():
    rng = random.Random(6)
    streams = [[rng.choice("abc") for _ in range(rng.randint(0, 30))] for _ in range(12)]
    for run, least in ((3, 2), (5, 3)):
        owners = defaultdict(set)
        for p, s in enumerate(streams):
            for i in range(len(s) - run + 1):
                owners[tuple(s[i : i + run])].add(p)
        for s, got in zip(streams, html_extract.covered(streams, run, least), strict=True):
            want = np.zeros(len(s), bool)
            for i in range(len(s) - run + 1):
                if len(owners[tuple(s[i : i + run])]) >= least:
                    want[i : i + run] = True
            assert got.tolist() == want.tolist()


def test_warc(spark, tmp_path):
    frame = spark.createDataFrame([(1, "http://a.example/x", PAGE, "k"), (2, None, None, None), (2, None, None, None)], "page_id long, url string, html string, headers string")
    records = warc.pages_to_responses(frame)
    raw = records.collect()
    data = b"".join(warc.serialize(r.headers, bytes(r.block), compress=i % 2 == 0) for i, r in enumerate(raw))
    (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.serialize(r.headers, bytes(r.block), compress=True) for r in raw))
    assert [(h, b) for h, b in warc.parse(b"".join(warc.serialize(r.headers, bytes(r.block)) for r in raw))] == [(r.headers, bytes(r.block)) for r in raw]
    assert data
    again = warc.read_warc(spark, str(tmp_path))
    assert again.count() == 3
    got = warc.derive(records).collect()
    assert len(got) == 6 and warc.derive(again).count() == 6
    source = {r.headers["WARC-Record-ID"]: r for r in raw}
    for r in got:
        from_ = source[r.refers_to].headers
        assert r.headers["WARC-Refers-To"] == r.refers_to and r.target_uri == from_.get("WARC-Target-URI") and r.date == from_["WARC-Date"]
        assert r.source_payload_digest == from_["WARC-Payload-Digest"] and r.source_block_digest == from_["WARC-Block-Digest"]
        assert r.block_digest == warc.digest(r.content.encode()) and r.content_length == len(r.content.encode())
    first = {r.kind: r for r in got if r.page_id == 1}
    assert "outlink: /a\r\n" in first["metadata"].content and "http-status: 200" in first["metadata"].content and "title: T & x" in first["metadata"].content
    assert "Four five é" in first["conversion"].content and "var t" not in first["conversion"].content
    assert warc.derive(records.limit(0)).count() == 0


class Page(HTMLParser):
    """Text lines and links of a page by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.lines, self.links, self.hidden = [""], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript", "template", "head"):
            self.hidden += 1
        if tag == "a" and not self.hidden:
            self.links += [v for k, v in attrs if k == "href"]
        if tag == "br" or tag in html_extract.BLOCKS:
            self.lines.append("")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript", "template", "head"):
            self.hidden -= 1
        if tag in html_extract.BLOCKS:
            self.lines.append("")

    def handle_data(self, data):
        if not self.hidden:
            self.lines[-1] += data


def test_warc_conversions_of_pages(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = warc.derive(warc.pages_to_responses(spark.read.parquet(f"{sf}/pages.parquet"))).collect()
    assert len(got) == 2 * len(pages)
    for r in got:
        page = Page()
        page.feed(pages[r.page_id].html)
        page.close()
        if r.kind == "conversion":
            assert r.content == "\n".join(x for x in (" ".join(line.split()) for line in page.lines) if x)
        else:
            assert re.findall(r"outlink: (.*)\r\n", r.content) == [v for v in page.links if v is not None]
            assert f"via-record: {r.refers_to}\r\n" in r.content and r.target_uri == pages[r.page_id].url


def test_warc_damage(spark, tmp_path):
    import gzip

    heads = [{"WARC-Type": "response", "WARC-Record-ID": f"<urn:uuid:{i}>", "WARC-Concurrent-To": "a", "Content-Length": ""} for i in range(4)]
    blocks = [b"HTTP/1.1 200 OK\r\n\r\n<p>one WARC/1.1 two</p>", b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 3000, b"", b"HTTP/1.1 200 OK\r\n\r\nlast"]
    whole = [warc.serialize({**h, "Content-Length": str(len(b))}, b) for h, b in zip(heads, blocks, strict=True)]
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.warc").write_bytes(b"".join(whole))
    got = warc.read_warc(spark, str(tmp_path / "plain")).collect()
    assert [bytes(r.block) for r in got] == blocks
    (tmp_path / "gz").mkdir()
    (tmp_path / "gz" / "a.warc.gz").write_bytes(b"".join(gzip.compress(w) for w in whole))
    assert sorted(bytes(r.block) for r in warc.read_warc(spark, str(tmp_path / "gz")).collect()) == sorted(blocks)
    # a cut block, a cut head, a damaged member, a head without length
    cut = list(warc.parse(b"".join(whole)[:-6]))
    assert [b for _, b in cut[:3]] == blocks[:3] and cut[3][0]["WARC-Truncated"] == "unspecified"
    assert [b for _, b in warc.parse(whole[0] + b"WARC/1.1\r\nWARC-Type: x")] == blocks[:1]
    assert [b for _, b in warc.parse(b"WARC/1.1\r\nWARC-Type: x\r\n\r\nzz" + whole[3])] == blocks[3:]
    packed = [gzip.compress(w) for w in whole]
    packed[1] = packed[1][:40] + b"\xff\xff" + packed[1][44:]
    assert [b for _, b in warc.parse(b"".join(packed)) if b != blocks[1]][-1] == blocks[3]
    twice = b"WARC/1.1\r\nWARC-Type: x\r\nWARC-Concurrent-To: a\r\nWARC-Concurrent-To: b\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    assert next(warc.parse(twice))[0]["WARC-Concurrent-To"] == "a\nb"


def test_warc_payloads():
    import gzip
    import time
    import zlib as z

    html = "<html><head><meta charset='iso-8859-1'></head><p>café</p></html>"
    latin = html.encode("cp1252")
    chunks = b"5\r\n" + latin[:5] + b"\r\n" + f"{len(latin) - 5:x}".encode() + b";x=y\r\n" + latin[5:] + b"\r\n0\r\n\r\n"
    for fields, payload in (([], latin), ([("Content-Type", "text/html; charset=ISO-8859-1")], latin), ([("Content-Encoding", "gzip")], gzip.compress(latin)), ([("content-encoding", "deflate")], z.compress(latin)), ([("Transfer-Encoding", "chunked")], chunks), ([("Content-Type", "text/html; charset=nosuch")], html.encode()), ([("Content-Encoding", "br")], latin)):
        assert warc.plain_text(warc.decoded(fields, payload)) == "café"
    began = time.process_time()
    assert warc.plain_text("<script>a" * 20000).startswith("a") and time.process_time() - began < 2
    assert warc.plain_text("a<!-- x -->b<SCRIPT>c</script >d<style>e") == "a b de"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_with_sql(spark, sf, name):
    import duckdb

    got = queries.QUERIES[name](spark, sf).toPandas()
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    rows = [sorted(tuple("~" if pd.isna(x) else f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in f[sorted(f.columns)].itertuples(index=False)) for f in (got, want)]
    assert rows[0] == rows[1]


def kept_by_rules(rows):
    """doc_ids whose verdict is to keep, by the SQL of the whole cascade."""
    import duckdb

    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(r.doc_id, r.text) for r in rows], columns=["doc_id", "text"]))
    return {d for d, kept in con.execute(f"select doc_id, kept from ({queries.ORACLES['op7_quality_cascade']})").fetchall() if kept}


def one_of_each_class(rows):
    """doc_ids of the least of each class of near copies, and of all rows without words."""
    root, _ = brute_classes([r.text for r in rows])
    least = {}
    for r, k in zip(rows, root, strict=True):
        if gram_set(r.text):
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    return set(least.values()) | {r.doc_id for r in rows if not gram_set(r.text)}


def leaking(rows, items):
    """(doc_ids that hold an item within its radius, those among them at two thirds of the radius or less): least edits
    over every stretch; texts that share no word run with a share of an item's words are passed over."""
    ids, found, near = {}, set(), set()

    def coded(t):
        return np.array([ids.setdefault(w, len(ids)) for w in decontaminate.words_of(t)])

    wanted = [(w, set(w.tolist()), decontaminate.radius(len(w))) for w in (coded(i.text) for i in items) if len(w)]
    for r in rows:
        area = coded(r.text)
        have = set(area.tolist())
        for w, kinds, most in wanted:
            # an edit takes one word at most, so a match leaves all kinds but as many in the text
            if len(kinds - have) <= most and (n := decontaminate.edit_match(w, area)[0]) <= most:
                found.add(r.doc_id)
                if 3 * n <= 2 * most:
                    near.add(r.doc_id)
    return found, near


def test_pipeline(spark, sf):
    """Every stage keeps the rows that a brute-force version keeps, unchanged but for the lines that line_dedup takes."""
    from sentencepiece import SentencePieceProcessor

    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = at.collect()
        at = spark.createDataFrame(stage(spark, at, sf).collect(), docs.schema)
        after, rows = at.collect(), {r.doc_id: r for r in before}
        assert at.columns == docs.columns and len(rows) == len(before), name
        assert len({r.doc_id for r in after}) == len(after), name
        if name != "line_dedup":
            assert all(rows[r.doc_id] == r for r in after), name
        ids = {r.doc_id for r in after}
        if name == "quality_rules":
            assert ids == kept_by_rules(before) and len(ids) > 0.5 * len(before)
            assert not ids & {r.doc_id for r in before if (m := measures(r.text))[0] < 10 or 100 * m[4] > 20 * m[0]}
        elif name == "line_dedup":
            want = {d: t for d, t, _ in brute_lines(before, line_templates.MIN_DOCS)}
            assert {r.doc_id: (r.text, r.n_chars, r.lang, r.source) for r in after} == {d: (t, len(t), rows[d].lang, rows[d].source) for d, t in want.items()}
        elif name == "near_duplicates":
            assert ids == one_of_each_class(before)
        else:
            found, near = leaking(before, items)
            gone = set(rows) - ids
            assert gone <= found and near <= gone and len(gone) >= 0.97 * len(found)
    last = corpus_pipeline.run(spark, sf)
    peer = SentencePieceProcessor(model_file=PIECES)
    assert Counter((r.doc_id, tuple(r.ids)) for r in last.collect()) == Counter((r.doc_id, tuple(peer.encode(r.text))) for r in after)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_stretches_are_encoded_as_whole_texts(spark, sf):
    """The peer gets long texts in stretches; the ids are those of the whole text."""
    from sentencepiece import SentencePieceProcessor

    peer = SentencePieceProcessor(model_file=PIECES)
    long = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text or "") > 2000][:60]
    assert len(long) > 20
    got = sentencepiece_codec.encode_texts(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string"), PIECES).collect()
    assert {r.doc_id: list(r.ids) for r in got} == {i: peer.encode(t) for i, t in enumerate(long)} and all(r.parity for r in got)
