"""Benchmark decontamination by edit distance.

A window of a document matches an item of n words if at most a fifth of n words must be inserted, deleted or
replaced. The CGK embedding walks through a window with random steps of nought or one word, so that few edits
become few unequal places (edit distance becomes Hamming distance); each of ``TABLES`` hash tables looks at a few
random places of one of ``WALKS`` independent walks. An item of over ``PIECE_WORDS`` words is cut into even
pieces of at most that many, each with its own table entries: of m pieces, one has at most an m-th of the edits,
so long items are found no worse than short ones. Windows that share a table entry with an item or a piece of it
are verified by exact edit distance of the whole item, over every stretch of the text it may touch.

Every word of a text starts a window, except where counting shows that no item can match: an edit breaks at most
two neighbouring pairs of words, so a matching stretch of n+k words holds at least n-1-2k pairs that occur in an
item. This bound loses nothing.

Items are taken in blocks of at most ``BLOCK_ITEMS``, each sent to the tasks, whatever the number of items.

Null and empty texts and items match nothing; repeated rows and ties (several items in one text) each give their
rows; texts are read whole; other columns are ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import keep, map_columns, stretches
from sparkloom.llm.fingerprints import U, mix
from sparkloom.llm.license_scan import _WORD_BYTES

SHARE = 0.2
WALKS = 4
TABLES = 32
PLACES = 4
BLOCK_ITEMS = 20_000
#: Letters of text that are searched at a time, unless one text is longer.
BATCH_LETTERS = 2_000_000
#: Words of the longest piece; at this length the tables find more than ``RECALL`` of the matches at the full radius.
PIECE_WORDS = 22
RECALL = 0.95
#: Bits of the table of word pairs that occur in items.
PAIR_BITS = 24


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_WORD_BYTES).split()


def radius(n: int, share: float = SHARE) -> int:
    return int(n * share + 1e-9)


def edit_match(item: np.ndarray, area: np.ndarray) -> tuple[int, int]:
    """(least edits, end) between the whole item and any stretch of area."""
    line = np.arange(len(area) + 1)
    row = np.zeros(len(area) + 1, np.int64)
    for i, w in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (area != w))
        row = np.minimum.accumulate(new - line) + line
    return int(row.min()), int(row.argmin())


class Index:
    """Hash tables over the walks of the items."""

    def __init__(self, items: list[tuple[int, str | None]], share: float = SHARE, tables: int = TABLES, places: int = PLACES, seed: int = 11) -> None:
        self.share, self.tables = share, tables
        self.ids: dict[bytes, int] = {}
        self.items = []
        for key, text in items:
            if w := words_of(text):
                self.items.append((key, np.array([self.ids.setdefault(x, len(self.ids) + 1) for x in w], np.int64)))
        rng = np.random.default_rng(seed)
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        for _, w in self.items:
            self.pairs[self.pair(w)] = True
        # pieces: item, offset, words, edits that the best piece of the item has at most
        self.pieces = []
        for i, (_, w) in enumerate(self.items):
            m = -(-len(w) // PIECE_WORDS)
            cuts = [len(w) * c // m for c in range(m + 1)]
            self.pieces += [(i, a, w[a:b], -(-radius(len(w), share) // m)) for a, b in zip(cuts, cuts[1:], strict=False)]
        groups: dict[int, list[int]] = {}
        for i, (_, _, w, _) in enumerate(self.pieces):
            groups.setdefault(int(np.log(len(w)) / np.log(1.5)), []).append(i)
        self.groups = []
        for members in groups.values():
            words = [self.pieces[i][2] for i in members]
            least, most = min(map(len, words)), max(map(len, words))
            steps = max(1, int(1.6 * least))
            looks = [np.sort(rng.choice(steps, min(places, steps), replace=False)) for _ in range(tables)]
            flat = np.concatenate([np.concatenate((w, np.full(2 * most + 2, -1))) for w in words])
            starts = np.concatenate(([0], np.cumsum([len(w) + 2 * most + 2 for w in words])[:-1]))
            keys = self.keys(flat, starts, steps, looks)
            order = np.argsort(keys, axis=1, kind="stable")
            sizes = sorted({(len(self.pieces[i][2]), self.pieces[i][3]) for i in members})
            self.groups.append((sizes, most, steps, looks, np.take_along_axis(keys, order, 1), np.array(members)[order]))

    @staticmethod
    def pair(w: np.ndarray) -> np.ndarray:
        return (mix(w[:-1].astype(U) * U(0x9E3779B97F4A7C15) + w[1:].astype(U)) >> U(64 - PAIR_BITS)).astype(np.int64)

    def keys(self, words: np.ndarray, starts: np.ndarray, steps: int, looks: list[np.ndarray]) -> np.ndarray:
        """A hash for every table and start; a walk goes on by a random bit of its step and word."""
        out = np.zeros((self.tables, len(starts)), U)
        for walk in range(WALKS):
            mine = [t for t in range(self.tables) if t % WALKS == walk]
            last = max((int(looks[t][-1]) for t in mine), default=-1)
            at = starts.copy()
            for step in range(min(steps, last + 1)):
                here = words[at].astype(U)
                for t in mine:
                    if step in looks[t]:
                        out[t] = mix(out[t] * U(0x100000001B3) + here + U(t + 1))
                at = at + (mix(here + U((step + 1) * 1_000_003 + walk * 7_919_777)) & U(1)).astype(np.int64)
        return out

    def find(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, first word of the stretch searched, edits, end word) of every match; the best for each text and item."""
        get = self.ids.get
        lists = [[get(w, 0) for w in words_of(t)] for t in texts]
        if not self.items or not any(lists):
            return
        pad = 2 * max(g[1] for g in self.groups) + 4
        flat = np.concatenate([np.array(x + [-1] * pad, np.int64) for x in lists])
        bounds = np.cumsum([0] + [len(x) + pad for x in lists])
        hit = np.zeros(len(flat) + 1, np.int64)
        both = (flat[:-1] > 0) & (flat[1:] > 0)
        at = np.flatnonzero(both)
        marks = np.zeros(len(flat), np.int64)
        marks[at] = self.pairs[(mix(flat[at].astype(U) * U(0x9E3779B97F4A7C15) + flat[at + 1].astype(U)) >> U(64 - PAIR_BITS)).astype(np.int64)]
        np.cumsum(marks, out=hit[1:])
        end = len(flat)
        found: dict[tuple[int, int], list[int]] = {}
        for sizes, _, steps, looks, table, members in self.groups:
            # positions where any size of the group may match; the loosest bound first
            need = [(n, max(0, n - 1 - 2 * k), n + k) for n, k in sizes]
            low, wide = min(x[1] for x in need), max(x[2] for x in need)
            start = np.arange(end)
            pos = start[(flat >= 0) & (hit[np.minimum(start + wide - 1, end)] - hit[start] >= low)]
            ok = np.zeros(len(pos), bool)
            for _, least, span in need:
                ok |= hit[np.minimum(pos + span - 1, end)] - hit[pos] >= least
            pos = pos[ok]
            for part in range(0, len(pos), 500_000):
                some = pos[part : part + 500_000]
                keys = self.keys(flat, some, steps, looks)
                for t in range(self.tables):
                    a = np.searchsorted(table[t], keys[t], "left")
                    b = np.searchsorted(table[t], keys[t], "right")
                    for x in np.flatnonzero(b > a):
                        doc = int(np.searchsorted(bounds, some[x], "right")) - 1
                        for i in members[t][a[x] : b[x]]:
                            item, offset = self.pieces[i][:2]
                            found.setdefault((doc, item), []).append(int(some[x]) - offset)
        known: dict[tuple[int, bytes], tuple[int, int]] = {}
        for (doc, i), places in found.items():
            item = self.items[i][1]
            n, k = len(item), radius(len(item), self.share)
            places = sorted(set(places))
            best = None
            low = places[0]
            for prev, here in zip(places, [*places[1:], None], strict=True):
                if here is not None and here - prev <= n:
                    continue
                a, b = max(int(bounds[doc]), low - 2 * k), min(int(bounds[doc + 1]) - pad, prev + n + 2 * k)
                area = flat[a:b]
                key = (i, area.tobytes())
                if key not in known:
                    known[key] = edit_match(item, area)
                edits, stop = known[key]
                if edits <= k and (best is None or edits < best[1]):
                    best = (a - int(bounds[doc]), edits, a - int(bounds[doc]) + stop)
                low = here
            if best:
                yield doc, i, *best


def find_leaks(df: DataFrame, items: DataFrame, share: float = SHARE, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each row of df and item that match: doc_id, h (hash of the text), item_id, edits, n_item_words, end_word, similarity."""
    spark = df.sparkSession
    items = items.select(F.col(item_key).try_cast("long").alias("k"), F.col(item_text).alias("t"))
    blocks = max(1, -(-items.count() // (BLOCK_ITEMS // 2)))
    schema = "doc_id long, h long, item_id long, edits long, n_item_words long, end_word long"
    out = None
    for block in range(blocks):
        rows = [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == block).collect()]  # a bounded block
        sent = spark.sparkContext.broadcast(rows)

        def make(sent=sent) -> Callable[..., Iterator[tuple]]:
            index = Index(sent.value, share)

            def work(keys: list, hashes: list, texts: list) -> Iterator[tuple]:
                for at, end in stretches(texts, BATCH_LETTERS):
                    for doc, i, _, edits, stop in index.find(texts[at:end]):
                        item, w = index.items[i]
                        yield keys[at + doc], hashes[at + doc], item, edits, len(w), stop

            return work

        got = map_columns(df, [F.col(key).try_cast("long"), F.xxhash64(F.col(text)), F.col(text)], schema, make)
        out = got if out is None else out.unionByName(got)
    return out.withColumn("similarity", 1 - F.col("edits") / F.col("n_item_words"))


def drop_leaks(df: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """df without the rows that match an item."""
    leaks = keep(find_leaks(df, items, text=text, key=key, **options).select(F.col("doc_id").alias("leak_id__"), F.col("h").alias("leak_h__")).distinct(), "leaks")
    return df.join(leaks, F.col(key).try_cast("long").eqNullSafe(F.col("leak_id__")) & (F.xxhash64(F.col(text)) == F.col("leak_h__")), "left_anti")
