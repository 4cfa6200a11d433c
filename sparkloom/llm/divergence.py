"""Source divergence audit: how far the word shares of each (lang, source) group lie from those of every other source of the
language, and from the language as a whole. All arithmetic is on whole numbers.

Terms are runs of ASCII letters and of characters from U+0080 up, with A-Z lower-cased. A language keeps the V terms that
stand in at least ``MIN_DOCS`` of its documents. A group with ``count`` occurrences of a term and N of all kept terms
gives it the share p = 1 + floor(SCALE * (count + 1) / (N + V)); the divergence from shares q is the sum of
floor((p - q)^2 / q) over all kept terms.

Counting: a task counts into dictionaries of bounded size, so a frequent term or a hot source reaches the shuffle as a few
rows; one shuffle by (lang, term) sums counts and documents. Pairs: a language's groups are numbered and cut into
blocks of ``BLOCK``, its terms into chunks of about ``CHUNK_ROWS`` counts by their hash. The counts of a block in a
chunk are packed into one row, which goes to every pair of blocks (tile) that the block is in. A tile's chunks are cut
into slices, each a task that holds two blocks of ``STEP`` terms at a time and its sub-matrix of sums. A term that
neither block has adds the same to a pair each time: it is counted once for all V terms, and tasks add by how much the
terms they see differ from it. Terms: the ``TOP`` rows of a group are cut per task before the shuffle.

Null text, lang and source are empty; a group without kept terms has N = 0; a language without kept terms has divergence 0
everywhere; repeated rows are documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import keep, map_columns, release

SCALE = 1_000_000_000
MIN_DOCS = 3
TOP = 200
#: Distinct terms that a counting task holds before it hands them on, one text's more at most.
HELD = 200_000
#: Groups of a block, counts of a chunk, chunks of a slice, terms of a step.
BLOCK, CHUNK_ROWS, SLICE, STEP = 32, 50_000, 4, 2048
#: Groups and bytes of their names up to which their table is broadcast.
SMALL_GROUPS, SMALL_BYTES = 100_000, 16 << 20
SALTS = 32


def _named(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def count_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term (binary), n, docs: partial counts, each task's own."""
    word = re.compile(rb"[a-z\x80-\xff]+")

    def make():
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> Iterator[tuple]:
            nonlocal size
            size = 0
            while held:
                (g, s), (n, docs) = held.popitem()
                yield from ((g, s, t, c, docs[t]) for t, c in n.items())

        def work(langs: list, sources: list, texts: list) -> Iterator[tuple]:
            nonlocal size
            for g, s, t in zip(langs, sources, texts, strict=True):
                words = word.findall(t.lower())
                if words:
                    n, docs = held.setdefault((g, s), (Counter(), Counter()))
                    size -= len(n)
                    n.update(words)
                    docs.update(set(words))
                    size += len(n)
                    if size > HELD:
                        yield from flush()

        work.finish = flush
        return work

    bytes_of = F.coalesce(F.col(text).cast("string").cast("binary"), F.lit(b""))
    return map_columns(docs, [_named(lang), _named(source), bytes_of], "lang string, source string, term binary, n long, docs long", make)


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n, lang_n (in all of the language), first (one row a term) of the terms in enough documents."""
    one = Window.partitionBy("lang", "term")
    summed = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = summed.select("*", F.sum("docs").over(one).alias("all_docs"), F.sum("n").over(one).alias("lang_n"), (F.row_number().over(one.orderBy("source")) == 1).alias("first"))
    return whole.where(F.col("all_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", "first")


def number_groups(docs: DataFrame, kept: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, g (from 0 in the language), n_all, v, lang_all, chunks of every group that occurs."""
    occurring = docs.select(_named(lang).alias("lang"), _named(source).alias("source")).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_all"), F.count("*").alias("entries"), F.sum(F.col("first").cast("long")).alias("firsts"))
    full = occurring.join(own, ["lang", "source"], "left").na.fill(0, ["n_all", "entries", "firsts"])
    whole = Window.partitionBy("lang")
    return full.select(
        *("lang", "source", "n_all"), (F.row_number().over(whole.orderBy("source")) - 1).alias("g"),
        F.sum("firsts").over(whole).alias("v"), F.sum("n_all").over(whole).alias("lang_all"),
        F.ceil(F.sum("entries").over(whole) / CHUNK_ROWS).alias("chunks"),
    )


def with_groups(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """kept with its group's numbers: by broadcast if their table is small, else joined with salts against hot groups."""
    size = groups.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("lang") + F.octet_length("source")), F.lit(0)).alias("b")).first()
    if size["n"] <= SMALL_GROUPS and size["b"] <= SMALL_BYTES:
        return kept.join(F.broadcast(groups), ["lang", "source"])
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return kept.withColumn("salt", F.pmod(F.hash("term"), F.lit(SALTS))).join(salted, ["lang", "source", "salt"]).drop("salt")


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), in decimals where the product is no long."""
    long = f"({SCALE}L * ({n} + 1)) div ({total} + {terms})"
    wide = f"({SCALE}BD * cast({n} + 1 as decimal(20, 0))) div cast({total} + {terms} as decimal(20, 0))"
    return F.expr(f"1 + case when {n} < 9000000000 then {long} else {wide} end")


def shares(counts: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """The same for a row of counts a group; three digits in base 1000, so that no product leaves 64 bits."""
    whole = (total + terms)[:, None]
    out, rest = np.zeros_like(counts), counts + 1
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest %= whole
    return out + 1


def top_terms(counted: DataFrame, top: int = TOP) -> DataFrame:
    """The terms of which a group has more than its language, the furthest first."""
    p, q = share("n", "n_all", "v"), share("lang_n", "lang_all", "v")
    over = counted.select("lang", "source", "term", p.alias("p"), q.alias("q")).where("p > q")
    valued = over.select("lang", "source", "term", F.expr("((p - q) * (p - q)) div q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    return valued.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")


def tiles(counted: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of every task, by lang, lo, hi and slice: heads (chunk -1: the groups of a block) and packed counts."""
    at = groups.withColumn("block", F.floor(F.col("g") / BLOCK).cast("int"))
    heads = at.groupBy("lang", "block").agg(F.first("v").alias("v"), F.first("chunks").alias("chunks"), F.sort_array(F.collect_list(F.struct("g", "n_all"))).alias("of"))  # BLOCK groups
    blocks = at.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
    heads = heads.join(blocks, "lang").withColumn("slice", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("chunks") / SLICE) - 1))))
    heads = heads.select("lang", "block", "blocks", F.col("slice").cast("int").alias("slice"), F.lit(-1).alias("chunk"), "v", F.transform("of", lambda x: F.struct(F.lit(0).alias("t"), x["g"].alias("g"), x["n_all"].alias("n"))).alias("cells"))
    placed = counted.withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    numbered = placed.select("lang", "chunk", "g", "n", F.dense_rank().over(Window.partitionBy("lang", "chunk").orderBy("term")).alias("t"))
    packed = numbered.groupBy("lang", "chunk", F.floor(F.col("g") / BLOCK).cast("int").alias("block")).agg(F.collect_list(F.struct("t", "g", "n")).alias("cells"))
    packed = packed.join(blocks, "lang").select("lang", "block", "blocks", F.floor(F.col("chunk") / SLICE).cast("int").alias("slice"), "chunk", F.lit(0).cast("long").alias("v"), "cells")
    dealt = heads.unionByName(packed).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")
    return dealt.select("lang", low, high, "slice", "chunk", "block", "v", "cells")


class Tile:
    """The sub-matrix of one task: by how much the terms that it sees differ from a term that neither group has."""

    def __init__(self, v: int, lo: tuple[np.ndarray, np.ndarray], hi: tuple[np.ndarray, np.ndarray], first: bool) -> None:
        self.v, self.sides, self.same = v, (lo, hi), lo is hi
        self.sums = [np.zeros((len(lo[0]), len(hi[0])), np.int64) for _ in range(2)]  # from lo to hi, from hi to lo
        if v:
            self.base = self.pair([shares(np.zeros((len(n), 1), np.int64), n, v) for _, n in self.sides])
            self.sums = [b * (v if first else 0) for b in self.base]

    def pair(self, p: list[np.ndarray]) -> list[np.ndarray]:
        """Sums over the terms of p in both directions."""
        out = [np.zeros_like(s) for s in self.sums]
        for a, row in enumerate(p[0]):
            square = (row - p[1]) ** 2
            out[0][a] = (square // p[1]).sum(1)
            if not self.same:
                out[1][a] = (square // row).sum(1)
        return out

    def chunk(self, cells: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Adds the terms of one chunk; cells: (term, group, count) of either block."""
        terms = np.unique(np.concatenate([c[0] for c in cells]))
        sides = cells if not self.same else cells[:1]
        for at in range(0, len(terms), STEP):
            some = terms[at : at + STEP]
            p = []
            for (t, g, n), (numbers, total) in zip(sides, self.sides, strict=False):
                mine = (t >= some[0]) & (t <= some[-1])
                counts = np.zeros((len(numbers), len(some)), np.int64)
                counts[g[mine] - numbers[0], np.searchsorted(some, t[mine])] = n[mine]
                p.append(shares(counts, total, self.v))
            for s, more, base in zip(self.sums, self.pair(p if len(p) == 2 else p * 2), self.base, strict=True):
                s += more - base * len(some)

    def rows(self) -> Iterator[tuple[int, int, int]]:
        (lo, _), (hi, _) = self.sides
        for a, x in enumerate(lo.tolist()):
            for b, y in enumerate(hi.tolist()):
                if x != y:
                    yield x, y, int(self.sums[0][a, b])
                    if not self.same:
                        yield y, x, int(self.sums[1][a, b])


_NONE = (np.zeros(0, np.int64),) * 3


def pair_values(dealt: DataFrame) -> DataFrame:
    """lang, a, b, value: the divergence of group a from group b for all pairs of a language."""
    dealt.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    out = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("value", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, task, heads, chunk, cells = None, None, {}, None, {}

        def count() -> None:
            nonlocal tile
            if tile is None:
                lo, hi = min(heads), max(heads)
                sides = {b: (g.astype(np.int64), n) for b, (_, g, n) in heads.items()}
                tile = Tile(v, sides[lo], sides[hi], task[3] == 0)
            if cells and tile.v:
                tile.chunk([cells.get(b, _NONE) for b in ((task[1],) if task[1] == task[2] else (task[1], task[2]))])

        def done() -> Iterator[pa.RecordBatch]:
            if task is not None:
                count()
                rows = [(task[0], *r) for r in tile.rows()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

        for batch in batches:
            plain = [batch.column(n).to_pylist() for n in ("lang", "lo", "hi", "slice", "chunk", "block", "v")]
            lists = batch.column("cells")
            for i, (lang, lo, hi, part, at, block, terms) in enumerate(zip(*plain, strict=True)):
                if (lang, lo, hi, part) != task:
                    yield from done()
                    tile, task, heads, chunk, cells, v = None, (lang, lo, hi, part), {}, -1, {}, terms
                if at != chunk:
                    count()
                    chunk, cells = at, {}
                own = lists[i].values
                t, g, n = (own.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("t", "g", "n"))
                (heads if at < 0 else cells)[block] = (t, g, n)
        yield from done()
        release()

    by = ["lang", "lo", "hi", "slice"]
    sorted_rows = dealt.repartition(*by).sortWithinPartitions(*by, "chunk", "block")
    parts = sorted_rows.mapInArrow(work, "lang string, a int, b int, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit_sources(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` has every other source of the language, part ``term`` the
    terms by which the group stands out."""
    kept = keep(kept_terms(count_terms(docs, text, lang, source), min_docs), "terms")
    groups = keep(number_groups(docs, kept, lang, source), "groups")
    counted = with_groups(kept, groups)
    values = pair_values(tiles(counted, groups))
    names = groups.select("lang", "g", "source")
    pairs = values.join(names.withColumnRenamed("g", "a"), ["lang", "a"]).join(names.select("lang", F.col("g").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank")).unionByName(top_terms(counted, top))
