"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that starts at two places or more.

1. Every window of ``length`` bytes is named by its least k-gram (its anchor), so equal windows have equal anchors
   at equal offsets; a window belongs to one anchor alone. Only anchors that occur twice go on.
2. The bytes around some anchors (whole anchors, many small ones together) make a text. The suffixes of it that start
   at places of a difference cover modulo ``PERIOD`` are ranked once, by doubling. Then the windows are sorted as
   suffixes, one block of leading bytes at a time: of two suffixes at any places, one shift brings both to places of
   the cover, so a comparison takes the few bytes up to there and two ranks, however long the tie. Memory holds the
   text, the ranks of the cover and one block.
3. A window repeats if it agrees with a neighbour in the sorted block over ``length`` bytes.

Equal surroundings are sorted once with a count. An anchor of more than ``BUCKET`` distinct surroundings would not fit
a task: its windows go to finer buckets, one for each offset and content (128-bit hashes); those of one bucket agree
wholly, so their number decides. Documents that are exact copies of each other are covered wholly; one of them stands
for all when others are compared.

Null and empty texts and texts under ``length`` bytes are never covered; repeated rows are exact copies; a key that
is no number becomes null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b, md5, sha256
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import keep, map_columns, release
from sparkloom.llm.fingerprints import INVERSE, U, mix, powers, prefix_sums
from sparkloom.operators.graph import forget

LENGTH = 200
GRAM = 64
#: Period of the difference cover, at most 8: a shift stays within the eight bytes that compare as one number.
PERIOD = 3
BUCKET = 16_000
#: Surroundings that make a text, unless an anchor has more; suffixes of a block, unless one pair of leading bytes has more.
TOGETHER = 8_000
BLOCK = 200_000
_PLACE_BITS = 30


def difference_cover(period: int) -> list[int]:
    """Few residues among which every difference modulo period occurs: for a small period the fewest, else small ones
    and multiples of the root."""
    if period < 8:
        return next(list(c) for n in range(1, period + 1) for c in combinations(range(period), n) if len({(x - y) % period for x in c for y in c}) == period)
    root = int(period**0.5)
    while root * root < period:
        root += 1
    return sorted({*range(root), *(i % period for i in range(root, period + root, root))})



def anchors(texts: list[bytes], length: int, gram: int) -> list[np.ndarray]:
    """For each text rows of (hash of the anchor, its place, first and last start of the windows it names)."""
    width = length - gram + 1
    data = np.frombuffer(b"".join(texts), np.uint8)
    out: list[np.ndarray] = [np.zeros((0, 4), np.int64)] * len(texts)
    if len(data) < length:
        return out
    sums = prefix_sums(data)
    n = len(data) - gram + 1
    grams = mix((sums[gram:] - sums[:n]) * powers(INVERSE, n))
    packed = (grams >> U(_PLACE_BITS)) << U(_PLACE_BITS) | np.arange(n, dtype=U)
    # least value of every `width` neighbours: running minima from both ends of blocks of that width
    blocks = -(-n // width)
    filled = np.full(blocks * width, np.iinfo(U).max, U)
    filled[:n] = packed
    grid = filled.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = len(data) - length + 1
    least = np.minimum(back[:starts], ahead[width - 1 : width - 1 + starts])
    place = (least & U((1 << _PLACE_BITS) - 1)).astype(np.int64)
    low = 0
    for i, t in enumerate(texts):
        m = len(t) - length + 1
        if m > 0:
            own = place[low : low + m]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            last = np.concatenate((first[1:] - 1, [m - 1]))
            out[i] = np.stack((grams[own[first]].view(np.int64), own[first] - low, first, last), 1)
        low += len(t)
    return out


def leading(data: np.ndarray, length: int) -> np.ndarray:
    """The eight bytes from each place on, as one number that sorts like them; room for ``length`` more places."""
    wide = np.zeros(len(data) + length + 32, np.uint8)
    wide[: len(data)] = data
    out = np.zeros(len(wide) - 8, U)
    for k in range(8):
        out |= wide[k : k + len(out)].astype(U) << U(8 * (7 - k))
    return out


def cover_ranks(eight: np.ndarray, wanted: np.ndarray, length: int, period: int, cover: list[int]) -> np.ndarray:
    """Rank of the suffix by at least ``length`` of its bytes, at every place of the cover that a wanted place or one less
    than a period after it has; 0 elsewhere. Widths double, the last step overlaps; each width is ranked only where a
    later one asks for it."""
    width = 8 * period
    steps = []  # (step to the second half, width after it)
    while width < length:
        step = min(width, -(-(length - width) // period) * period)
        steps.append(step)
        width += step
    room = len(eight)
    in_cover = np.isin(np.arange(room) % period, cover)
    need = np.zeros(room, bool)
    for x in range(period):
        need[np.minimum(wanted + x, room - 1)] = True
    asked = [need & in_cover]
    for step in reversed(steps):
        more = asked[-1].copy()
        more[step:] |= asked[-1][:-step]
        asked.append(more)
    rank = np.zeros(room, np.int64)
    places = np.flatnonzero(asked.pop())
    keys = [eight[np.minimum(places + 8 * k, room - 1)] for k in reversed(range(period))]
    order = np.lexsort(keys)
    new = np.ones(len(places), bool)
    if len(places):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    rank[places[order]] = np.cumsum(new)
    for step in steps:
        places = np.flatnonzero(asked.pop())
        key = rank[places] << np.int64(32) | rank[np.minimum(places + step, room - 1)]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.ones(len(places), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        rank[places[order]] = np.cumsum(new)
    return rank


def sorted_block(places: np.ndarray, eight: np.ndarray, rank: np.ndarray, period: int, cover: list[int]) -> np.ndarray:
    """The places in the order of their suffixes. For each pair of residues there is a shift that brings both to the
    cover; in that pair's order each suffix counts those of the other residue before it, and the counts add up to its place."""
    residue = places % period
    kinds = [r for r in range(period) if (residue == r).any()]
    before, own = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    for i, r in enumerate(kinds):
        for q in kinds[i + 1 :] or ([r] if len(kinds) == 1 else []):
            shift = next(x for x in range(period) if (r + x) % period in cover and (q + x) % period in cover)
            some = np.flatnonzero((residue == r) | (residue == q))
            at = places[some]
            head = eight[at] >> U(64 - 8 * shift) if shift else np.zeros(len(at), U)
            order = np.lexsort((rank[at + shift], head))
            some = some[order]
            first = residue[some] == r
            upto = np.cumsum(first)
            index = np.arange(len(some))
            own[some] = np.where(first, upto - 1, index - upto)
            if r != q:
                before[some] += np.where(first, index + 1 - upto, upto)
    return places[np.argsort(before + own, kind="stable")]


def repeated_windows(pieces: list[bytes], low: np.ndarray, high: np.ndarray, times: np.ndarray, length: int, period: int = PERIOD, block: int = BLOCK) -> np.ndarray:
    """Which windows repeat. Piece i holds the windows of offsets high..low before its anchor, one starting at each of its
    first places, and stands for times[i] places of documents. A matrix pieces x offsets."""
    cover = difference_cover(period)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    eight = leading(data, length)
    starts = np.concatenate(([0], np.cumsum([len(p) for p in pieces])[:-1])).astype(np.int64)
    counts = high - low + 1
    row = np.repeat(np.arange(len(pieces)), counts)
    within = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    places, offset = starts[row] + within, high[row] - within
    rank = cover_ranks(eight, places, length, period, cover)
    lead = (eight[places] >> U(48)).astype(np.uint16)
    order = np.argsort(lead, kind="stable")
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(lead[order])) + 1, [len(order)]))  # a block holds whole groups of leading bytes
    again = np.zeros(len(data), bool)
    at = 0
    while at < len(cuts) - 1:
        end = max(at + 1, int(np.searchsorted(cuts, cuts[at] + block, "right")) - 1)
        line = sorted_block(places[order[cuts[at] : cuts[end]]], eight, rank, period, cover)
        a, b = line[:-1], line[1:]
        for k in range(0, length, 8):
            take = min(8, length - k)
            same = (eight[a + k] ^ eight[b + k]) >> U(64 - 8 * take) == 0
            a, b = a[same], b[same]
        again[a] = again[b] = True
        at = end
    out = np.zeros((len(pieces), int(high.max()) + 1 if len(high) else 0), bool)
    out[row, offset] = again[places] | (times[row] > 1)
    return out


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of every run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], marks.astype(np.int8), [0]))))
    return list(zip(edge[0::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _sorter(length: int) -> Callable:
    """Rows (g, low, high, around, times, u), sorted by g, to (g, low, high, u, runs of repeated offsets)."""

    def work(rows: list[tuple]) -> pa.RecordBatch:
        low, high, times = (np.array([r[c] for r in rows], np.int64) for c in (1, 2, 4))
        got = repeated_windows([r[3] for r in rows], low, high, times, length)
        keep_rows = [(*r[:3], r[5], [{"a": a, "b": b} for a, b in _runs(got[i])]) for i, r in enumerate(rows) if got[i].any()]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in keep_rows], t) for c, t in enumerate(kinds)], ["g", "low", "high", "u", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(rows) >= TOGETHER and row[0] != rows[-1][0]:
                    yield work(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield work(rows)
        rows = []
        release()

    return run


def _named(df: DataFrame, text: str, key: str) -> DataFrame:
    """d, h, h2 (two hashes that name a document's text) and its bytes t."""
    bare = df.select(F.col(key).try_cast("long").alias("d"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    return bare.select("d", F.xxhash64("t").alias("h"), F.xxhash64("t", F.lit(1)).alias("h2"), "t")


def repeated_spans(df: DataFrame, text: str, key: str, length: int, gram: int, bucket: int) -> DataFrame:
    """(d, h, h2, whole, spans) of the documents with covered bytes; whole: it is one of several copies."""
    named = _named(df, text, key).where(F.length("t") >= length)

    def find() -> Callable[..., Iterator[tuple]]:
        def work(keys: list, names: list, names2: list, texts: list) -> Iterator[tuple]:
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < 4_000_000):
                    size += len(texts[end])
                    end += 1
                for i, x in enumerate(anchors(texts[at:end], length, gram), at):
                    # place, then the offsets of the last and the first window before it
                    yield keys[i], names[i], names2[i], x[:, 0], x[:, 1] << 24 | (x[:, 1] - x[:, 3]) << 12 | (x[:, 1] - x[:, 2])
                at = end

        return work

    found = map_columns(named, [F.col(c) for c in ("d", "h", "h2", "t")], "d long, h long, h2 long, g array<long>, x array<long>", find)
    found = keep(found.withColumn("row", F.monotonically_increasing_id()), "anchors")
    heads = found.select("row", "d", "h", "h2")
    groups = keep(heads.groupBy("h", "h2").agg(F.count("*").alias("n"), F.min("row").alias("least")).where("n > 1"), "groups")
    copies = keep(heads.join(groups, ["h", "h2"]).select("row", "d", "h", "h2", (F.col("row") == F.col("least")).alias("stands")), "copies")
    places = found.select("row", "h", F.explode(F.arrays_zip("g", "x")).alias("p")).select("row", "h", "p.g", "p.x")
    here = F.xxhash64("h", "x")  # the same place of a copy is the same place
    # a table of its own, so that the join below reads two shuffles and a hot anchor's side can be split (AQE)
    twice = keep(places.groupBy("g").agg(F.min(here).alias("a"), F.max(here).alias("b")).where("a <> b").select("g"), "twice")
    wanted = places.select("row", "g", "x").join(twice, "g").groupBy("row").agg(F.collect_list(F.struct("g", "x")).alias("p"))
    wanted = keep(wanted.join(copies.where("not stands").select("row"), "row", "left_anti").join(heads, "row").drop("row"), "wanted")
    forget(found, groups, twice)

    def surround() -> Callable[..., Iterator[tuple]]:
        def work(keys: list, names: list, names2: list, texts: list, lists: list) -> Iterator[tuple]:
            for k, h, h2, t, found in zip(keys, names, names2, texts, lists, strict=True):
                for p in found:
                    at, low, high = p["x"] >> 24, p["x"] >> 12 & 4095, p["x"] & 4095
                    piece = t[at - high : at - low + length]
                    yield k, h, h2, p["g"], at, low, high, piece, md5(piece).digest()

        return work

    same = F.col("d").eqNullSafe(F.col("e")) & (F.col("h") == F.col("i")) & (F.col("h2") == F.col("i2"))
    joined = named.join(wanted.select(F.col("d").alias("e"), F.col("h").alias("i"), F.col("h2").alias("i2"), "p"), same)
    around = keep(map_columns(joined, [F.col(c) for c in ("d", "h", "h2", "t", "p")], "d long, h long, h2 long, g long, at long, low int, high int, around binary, u binary", surround), "around")
    forget(wanted)
    kinds = keep(around.groupBy("g", "low", "high", "u").agg(F.first("around").alias("around"), F.count("*").alias("times")), "kinds")
    big = keep(kinds.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("g"), "big")
    # a bucket sorts as one, so its rows meet in one task; their number is bounded by `bucket`
    sized = kinds.join(big, "g", "left_anti").select("g", "low", "high", "around", "times", "u").repartition("g").sortWithinPartitions("g")
    sorted_ = sized.mapInArrow(_sorter(length), "g long, low int, high int, u binary, runs array<struct<a:int,b:int>>")
    repeats = keep(sorted_, "runs")

    def hashed() -> Callable[..., Iterator[tuple]]:
        def work(g: list, low: list, high: list, texts: list, times: list, names: list) -> Iterator[tuple]:
            for k, a, b, t, n, u in zip(g, low, high, texts, times, names, strict=True):
                for offset in range(a, b + 1):
                    yield k, a, b, u, offset, blake2b(t[b - offset : b - offset + length], digest_size=16).digest(), n

        return work

    windows = map_columns(kinds.join(big, "g", "left_semi"), [F.col(c) for c in ("g", "low", "high", "around", "times", "u")], "g long, low int, high int, u binary, offset int, w binary, times long", hashed)
    many = windows.groupBy("g", "offset", "w").agg(F.sum("times").alias("n")).where("n > 1").select("g", "offset", "w")
    extra = windows.join(many, ["g", "offset", "w"]).groupBy("g", "low", "high", "u").agg(F.collect_set(F.struct(F.col("offset").alias("a"), F.col("offset").alias("b"))).alias("runs"))
    runs = repeats.unionByName(extra) if big.limit(1).count() else repeats
    spans = around.drop("around").join(runs, ["g", "low", "high", "u"]).select("d", "h", "h2", "at", F.explode("runs").alias("r"))
    spans = spans.select("d", "h", "h2", F.struct((F.col("at") - F.col("r.b")).alias("a"), (F.col("at") - F.col("r.a") + length).alias("b")).alias("s"))
    whole = copies.select("d", "h", "h2", F.lit(True).alias("whole")).distinct()
    out = keep(spans.unionByName(whole, allowMissingColumns=True).groupBy("d", "h", "h2").agg(F.coalesce(F.max("whole"), F.lit(False)).alias("whole"), F.collect_list("s").alias("spans")), "spans")
    forget(copies, around, kinds, big, repeats)
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal runs removed)."""
    left, removed, runs, at = [], 0, 0, 0
    for a, b in sorted(spans):
        if a > at or not runs:
            left.append(text[at:a])
            runs += 1
            removed += b - a
            at = b
        elif b > at:
            removed += b - at
            at = b
    left.append(text[at:])
    return b"".join(left), removed, runs


def dedup_substrings(df: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET, text: str = "text", key: str = "doc_id", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left, with_text) of every row."""
    spans = repeated_spans(df, text, key, length, gram, bucket).toDF("e", "i", "i2", "whole", "spans")
    same = F.col("d").eqNullSafe(F.col("e")) & (F.col("h") == F.col("i")) & (F.col("h2") == F.col("i2"))
    joined = _named(df, text, key).join(spans, same, "left")

    def make() -> Callable[..., Iterator[tuple]]:
        def work(keys: list, texts: list, wholes: list, lists: list) -> Iterator[tuple]:
            for k, t, n, found in zip(keys, texts, wholes, lists, strict=True):
                left, removed, runs = cut(t, [(0, len(t))] if n else [(s["a"], s["b"]) for s in found or []])
                yield k, len(t), removed, runs, sha256(left).hexdigest(), left if with_text else None

        return work

    out = map_columns(joined, [F.col("d"), F.col("t"), F.col("whole"), F.col("spans")], "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary", make)
    return out if with_text else out.drop("kept")
