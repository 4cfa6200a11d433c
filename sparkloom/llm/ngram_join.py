"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets verify them.

A document is the set of its runs of five words (lower case, split at white space; a text of one to four words
is one run), held as 64-bit hashes. Documents with equal sets are one set with a weight, so exact copies never
meet as pairs. ``choose_bands`` picks the rows and bands that reach the wanted recall at the threshold. Only
(set, band hash) rows are shuffled for the search; buckets that hold the same members are tried once. A bucket
is cut into chunks of bounded size and each pair of chunks is a task of its own, in which a pair is verified in
the first band that it shares and counted, never emitted: what leaves the task is one count a member and a
star of links for each group found. Groups are the connected components of verified links.

Null and empty texts have no set and link with nothing; repeated rows are copies of each other; a null doc_id
is never a class id unless all of its class are null; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import components, keep, map_columns, release, stretches
from sparkloom.llm.fingerprints import TOGETHER, U, mix, shingles
from sparkloom.operators.graph import forget

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9995
#: Members of a chunk, and hashes of a chunk.
CHUNK_SETS = 1024
CHUNK_HASHES = 1_000_000


def choose_bands(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which at most ``most`` hashes reach the recall."""
    best = None
    for rows in range(1, 17):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows <= most:
            best = bands, rows
    return best or (most, 1)


def signatures(hashes: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A band hash for every segment of hashes and every band."""
    rng = np.random.default_rng(7)
    out = np.zeros((len(starts), bands), U)
    for b in range(bands):
        total = np.full(len(starts), b + 1, U)
        for _ in range(rows):
            a, c = rng.integers(1, 1 << 62, 2, dtype=np.int64).astype(U)
            low = np.minimum.reduceat(mix_fast(hashes * (a | U(1)) + c), starts)
            total = (total ^ low) * U(0xFF51AFD7ED558CCD)
            total ^= total >> U(32)
        out[:, b] = total
    return out


def mix_fast(x: np.ndarray) -> np.ndarray:
    return x ^ (x >> U(29))


def fingerprint(df: DataFrame, text: str, key: str, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, h (hash of the text), set (hash of the n-gram set, null if it is empty), n, bands."""

    def make() -> Callable[..., Iterator[tuple]]:
        def work(keys: list, hashed: list, texts: list) -> Iterator[tuple]:
            for at, end in stretches(texts, TOGETHER):
                yield from some(keys[at:end], hashed[at:end], texts[at:end])

        def some(keys: list, hashed: list, texts: list) -> Iterator[tuple]:
            grams, where = shingles(texts, words)
            starts = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1]))) if len(where) else np.array([], int)
            of = where[starts] if len(starts) else []
            ends = np.concatenate((starts[1:], [len(grams)])).astype(int)
            sig = signatures(grams, starts, bands, rows).view(np.int64) if len(starts) else None
            found = {}
            for row, (doc, a, b) in enumerate(zip(of, starts, ends, strict=True)):
                own = np.unique(grams[a:b])
                found[doc] = blake2b(own.tobytes(), digest_size=16).hexdigest(), len(own), sig[row]
            for i, (k, h) in enumerate(zip(keys, hashed, strict=True)):
                yield k, h, *found.get(i, (None, 0, None))

        return work

    return map_columns(df, [F.col(key).try_cast("long"), F.md5(F.col(text).cast("binary")), F.col(text)], "doc_id long, h string, set string, n long, bands array<long>", make)


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (left[i], right[i])."""
    if len(left) <= 16 * len(sets):
        out = np.zeros(len(left), np.int64)
        for i, (x, y) in enumerate(zip(left, right, strict=True)):
            a, b = (sets[x], sets[y]) if len(sets[x]) < len(sets[y]) else (sets[y], sets[x])
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            out[i] = np.count_nonzero(b[at] == a)
        return out
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    rows, column = rows[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    width = 1024
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        tile = np.zeros((len(sets), width), np.float32)
        tile[rows[a:b], column[a:b] - low] = 1
        total += tile @ tile.T
    return total[left, right].astype(np.int64)


def verify_block(ids: list[str], weights: np.ndarray, bands: np.ndarray, sets: list[np.ndarray], side: np.ndarray, band: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each member: weight of the sets linked here, and the least member it is linked with.

    side is 0 or 1 where members of two chunks meet, else 0 for all. A pair counts only where band is the
    first band that it shares.
    """
    m = len(ids)
    open_pairs = np.triu(np.ones((m, m), bool), 1) if not side.any() else side[:, None] < side[None, :]
    for b in range(band):
        open_pairs &= bands[:, None, b] != bands[None, :, b]
    size = np.array([len(s) for s in sets])
    open_pairs &= np.minimum(size[:, None], size[None, :]) >= threshold * np.maximum(size[:, None], size[None, :]) - 1e-9
    left, right = np.nonzero(open_pairs)
    links, root = np.zeros(m, np.int64), np.arange(m)
    if not len(left):
        return links, root
    both = _common(sets, left, right)
    true = both >= threshold * (size[left] + size[right] - both) - 1e-9
    left, right = left[true], right[true]
    np.add.at(links, left, weights[right])
    np.add.at(links, right, weights[left])
    while True:
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        root = root[root]
        if (root == before).all():
            return links, root


def _verifier(threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        block = None

        def done() -> pa.RecordBatch:
            rows.sort(key=lambda r: r[5])
            bucket_band, i, j = block[0], block[2], block[3]
            links, root = verify_block([r[5] for r in rows], np.array([r[6] for r in rows]), np.array([r[7] for r in rows], np.int64), [np.frombuffer(r[8], U) for r in rows], np.array([int(i != j and r[4] == j) for r in rows]), bucket_band, threshold)
            out = [(r[5], int(n), rows[k][5]) for r, n, k in zip(rows, links, root, strict=True) if n]
            return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["set", "links", "root"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:4] != block:
                    if rows:
                        yield done()
                    rows, block = [], row[:4]
                rows.append(row)
        if rows:
            yield done()
        rows = []
        release()

    return run


def near_duplicates(df: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a row of df: doc_id, h, class_key, class_id (least doc_id of the class), class_size, n_links
    (other rows whose similarity is at least the threshold)."""
    bands, rows = choose_bands(threshold, recall)
    docs = keep(fingerprint(df, text, key, words, bands, rows), "prints")
    sets = docs.where("set is not null").groupBy("set").agg(F.count("*").alias("weight"), F.min("doc_id").alias("first"), F.min("n").alias("n"), F.min_by("bands", "h").alias("bands"), F.min(F.struct("doc_id", "h")).alias("from"))
    sets = keep(sets, "sets")
    spread = sets.select("set", F.posexplode("bands").alias("band", "hash"))
    sign = F.xxhash64("set")
    buckets = (
        spread.groupBy("band", "hash")
        .agg(F.count("*").alias("m"), F.bit_xor(sign).alias("x"), F.sum(sign % F.lit(1 << 31)).alias("s"))
        .where("m > 1")
        .groupBy("m", "x", "s")
        .agg(F.min(F.struct("band", "hash")).alias("b"))
        .select("b.band", "b.hash", "m")
    )
    members = keep(spread.join(buckets, ["band", "hash"]).select("band", "hash", "set", "m"), "members")
    wanted = keep(members.select("set").distinct().join(sets, "set").select("set", "weight", "n", "bands", "from.doc_id", "from.h"), "wanted")

    def grams() -> Callable[..., Iterator[tuple]]:
        def work(names: list, texts: list) -> Iterator[tuple]:
            for at, end in stretches(texts, TOGETHER):
                yield from some(names[at:end], texts[at:end])

        def some(names: list, texts: list) -> Iterator[tuple]:
            found, where = shingles(texts, words)
            for i, (a, b) in enumerate(np.stack((np.searchsorted(where, np.arange(len(texts))), np.searchsorted(where, np.arange(len(texts)), "right")), 1)):
                yield names[i], np.unique(found[a:b]).tobytes()

        return work

    texts = df.select(F.col(key).try_cast("long").alias("doc_id"), F.md5(F.col(text).cast("binary")).alias("h"), F.col(text).alias("t"))
    match = wanted.select("set", F.col("doc_id").alias("d"), F.col("h").alias("g"))
    payload = map_columns(texts.join(match, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g"))), [F.col("set"), F.col("t")], "set string, grams binary", grams)
    payload = keep(payload.dropDuplicates(["set"]).join(wanted.select("set", "weight", "n", "bands"), "set"), "grams")
    sized = members.join(payload.select("set", "n"), "set").groupBy("band", "hash").agg(F.greatest(F.ceil(F.count("*") / CHUNK_SETS), F.ceil(F.sum("n") / CHUNK_HASHES)).cast("int").alias("k"))
    chunk = F.pmod(F.xxhash64("set", "band"), F.col("k")).cast("int")
    dealt = (
        members.join(sized, ["band", "hash"])
        .withColumn("c", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .select("band", "hash", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), "c", "set")
        .join(payload, "set")
        .select("band", "hash", "i", "j", "c", "set", "weight", "bands", "grams")
    )
    dealt = dealt.repartition("band", "hash", "i", "j").sortWithinPartitions("band", "hash", "i", "j")
    found = keep(dealt.mapInArrow(_verifier(threshold), "set string, links long, root string"), "links")
    forget(members, wanted, payload)
    label = components(found.select(F.col("set").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("set").agg(F.sum("links").alias("links"))
    info = sets.select("set", "weight", "first", "from").join(links, "set", "left").join(label.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    classes = info.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("weight").alias("class_size"), F.min("from").alias("kept"))
    info = info.join(classes, "root").select("set", F.col("root").alias("class_key"), "class_id", "class_size", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "kept")
    joined = docs.where("set is not null").join(info, "set").select("doc_id", "h", "class_key", "class_id", "class_size", "n_links", "kept")
    alone = docs.where("set is null").select("doc_id", "h", F.lit(None).cast("string").alias("class_key"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"), F.struct("doc_id", "h").alias("kept"))
    return joined.unionByName(alone)


def keep_one(df: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """df with one row of each class, the one of the least doc_id (then of the least hash of the text); rows without words all stay."""
    classes = near_duplicates(df, text=text, key=key, **options)
    chosen = classes.where("class_key is not null").select("kept.doc_id", "kept.h").distinct().select(F.col("doc_id").alias("kept_id"), F.col("h").alias("kept_h"))
    hashed = df.withColumn("text_hash__", F.md5(F.col(text).cast("binary")))
    words = F.coalesce(F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r")), F.lit("")) != ""
    kept = hashed.where(words).join(chosen, F.col(key).try_cast("long").eqNullSafe(F.col("kept_id")) & (F.col("text_hash__") == F.col("kept_h")), "left_semi").dropDuplicates([key, "text_hash__"])
    return kept.unionByName(hashed.where(~words)).select(df.columns)
