"""Language-model scores from the lattice of all subword segmentations.

The pieces are those of an existing tokenizer model (never trained here). A unigram model's scores are log
probabilities and weight the pieces as they are (``rounds`` 0 by default); at every word the text may end, with a
probability that the training texts give. A merge model's scores are only ranks, so its pieces start from
1/(rank + 2), and expected piece counts over every training word (forward-backward, one round by default) give the
piece probabilities of this corpus; the end of a text is one more piece. A text's probability is the product over its
words of the sum over all segmentations, by forward recursion in log space, times the end's.

Words occur a thousandfold, so the recursion runs once for every distinct word. Words are counted with partial
sums before the shuffle. The ``head_words`` most frequent words (a stated bound) travel to the tasks as one
table (words of over ``LONG_WORD`` letters by their hash); all rarer words are joined by a shuffle, so nothing is
left out and no word is hot in the shuffle.

Null and empty texts consist of the end alone; repeated rows are scored alike (rows, not doc_ids, are the
unit); other columns are ignored; a null doc_id counts as the text "" for the fold; an empty table gives an
empty result; without training texts every count is 0.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from hashlib import md5
from itertools import chain, compress, repeat
from pathlib import Path

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import keep, map_columns
from sparkloom.llm.sentencepiece_codec import UNIGRAM, Model, parse_model

MARK = "▁"
LOG10 = math.log(10)
#: Most frequent words sent to every task (at most this many rows), and letters above which a hash stands for a word.
HEAD_WORDS = 100_000
LONG_WORD = 64
#: Smoothing of the pieces' expected counts.
PRIOR = 0.1
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000
#: Words of at most this many letters are summed side by side, longer ones letter by letter; the sums are the same.
SIDE_BY_SIDE = 48
#: Words that are summed side by side at a time.
GROUP = 8192


def start_weights(model: Model) -> dict[str, float]:
    """Natural-log weights of the pieces that may stand in a segmentation; bytes are spelled <0xNN>."""
    kept = [(p.text, p.score, i, p.kind) for i, p in enumerate(model.pieces) if p.kind in (1, 4, 6) and MARK not in p.text[1:]]
    if model.kind == 1:
        low = min((s for _, s, _, kind in kept if kind != 6), default=0.0)
        return {t: (low - 10 if kind == 6 else s) for t, s, _, kind in kept}
    rank = {i: n for n, (_, _, i, kind) in enumerate(sorted((k for k in kept if k[3] != 6), key=lambda k: (-k[1], k[2])))}
    raw = {t: 1 / (len(kept) * 2 if kind == 6 else rank[i] + 2) for t, _, i, kind in kept}
    total = sum(raw.values())
    return {t: math.log(w / total) for t, w in raw.items()}


class Lattice:
    """Forward and backward sums over the segmentations of one marked word."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        self.linear = {p: math.exp(w) for p, w in weights.items()}
        self.longest = max(map(len, weights), default=1)
        self.pieces = list(weights)
        self.logs = np.array([weights[p] for p in self.pieces])
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)
        self.single = np.full(0x110000, -1, np.int64)  # pieces of one letter, by code point: they would crowd the automaton's root
        self.found = ahocorasick.Automaton()
        for n, p in enumerate(self.pieces):
            if len(p) == 1:
                self.single[ord(p)] = n
            else:
                self.found.add_word(p, n)
        self.found.add_word("\0" * 1024, 0)  # never empty; longer than any word summed side by side
        self.found.make_automaton()

    def arcs(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """All arcs of the marked words: (start, end, log weight, piece or -1); places count on from word to word,
        each word having one more place than letters. A letter that is no piece is spelled in bytes. No piece holds
        the marker but at its front, so none crosses words."""
        joined = "".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        hits = np.fromiter(chain.from_iterable(self.found.iter(joined)), np.int64).reshape(-1, 2)
        # the letter at index x of the joined words spans the places x + k and x + k + 1 of word k
        word = np.repeat(np.arange(len(words)), lengths)
        single = self.single[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        alone, bare = np.flatnonzero(single >= 0), np.flatnonzero(single < 0)
        spelled = np.array([sum(self.weights.get(p, -30.0) for p in self.spelled(joined[x])) for x in bare], float)
        piece = np.concatenate([hits[:, 1], single[alone], np.full(len(bare), -1)])
        weight = np.concatenate([self.logs[piece[: len(hits) + len(alone)]], spelled])
        end = np.concatenate([hits[:, 0], alone, bare]) + 1
        begin = end - np.where(piece < 0, 1, self.sizes[piece])
        shift = word[end - 1]
        return begin + shift, end + shift, weight, piece

    def swept(self, sums: np.ndarray, source: np.ndarray, goal: np.ndarray, weight: np.ndarray, step: np.ndarray) -> None:
        """Log sums into sums[goal] over sums[source] + weight, all arcs of one step at once, steps in ascending order."""
        order = np.lexsort((goal, step))
        source, goal, weight = source[order], goal[order], weight[order]
        first = np.flatnonzero(np.diff(goal, prepend=-1))  # arcs of one goal share a step and lie together
        bounds = np.searchsorted(step[order], np.arange(step.max() + 2)) if len(step) else []
        cuts = np.searchsorted(first, bounds)
        for n in range(len(bounds) - 1):
            lo, hi, groups = bounds[n], bounds[n + 1], first[cuts[n] : cuts[n + 1]]
            if lo == hi:
                continue
            terms, at = sums[source[lo:hi]] + weight[lo:hi], groups - lo
            top = np.maximum.reduceat(terms, at)
            spread = np.exp(terms - np.repeat(top, np.diff(at, append=hi - lo)))
            sums[goal[groups]] = top + np.log(np.add.reduceat(spread, at))

    def swept_forward(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """(sums at all places, first and last place of every word, its arcs)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        last = np.cumsum(lengths + 1) - 1
        base = last - lengths
        arcs = self.arcs(words)
        sums = np.zeros(last[-1] + 1)
        place = np.arange(len(sums)) - np.repeat(base, lengths + 1)
        self.swept(sums, arcs[0], arcs[1], arcs[2], place[arcs[1]])
        return sums, base, last, arcs

    def forward_all(self, words: list[str]) -> list[float]:
        """forward() of every word, short words side by side."""
        out = [0.0] * len(words)
        short = sorted((n for n, w in enumerate(words) if len(w) <= SIDE_BY_SIDE), key=lambda n: len(words[n]))
        for at in range(0, len(short), GROUP):
            some = short[at : at + GROUP]
            sums, _, last, _ = self.swept_forward([words[n] for n in some])
            for n, x in zip(some, sums[last].tolist(), strict=True):
                out[n] = x
        for n, w in enumerate(words):
            if len(w) > SIDE_BY_SIDE:
                out[n] = self.forward(w)
        return out

    def expect_all(self, words: list[str], times: list[int], into: dict[str, float]) -> None:
        """expect() of every word, short words side by side: an arc's expected count is the share of the sum over all
        paths that its own paths have."""
        short = sorted((n for n, w in enumerate(words) if len(w) <= SIDE_BY_SIDE), key=lambda n: len(words[n]))
        for at in range(0, len(short), GROUP):
            some = [words[n] for n in short[at : at + GROUP]]
            sums, base, last, (begin, end, weight, piece) = self.swept_forward(some)
            back = np.zeros(len(sums))
            word = np.repeat(np.arange(len(some)), last - base + 1)
            self.swept(back, end, begin, weight, last[word[begin]] - begin)
            count = np.array([times[n] for n in short[at : at + GROUP]], float)
            share = np.exp(sums[begin] + weight + back[end] - sums[last][word[begin]]) * count[word[begin]]
            whole = piece >= 0
            got = np.bincount(piece[whole], share[whole], len(self.pieces))
            for n in np.flatnonzero(got):
                into[self.pieces[n]] += float(got[n])
            joined = "".join(some)
            for x, part in zip((end[~whole] - 1 - word[end[~whole]]).tolist(), share[~whole].tolist(), strict=True):
                for p in self.spelled(joined[x]):
                    into[p] += part
        for n, w in enumerate(words):
            if len(w) > SIDE_BY_SIDE:
                self.expect(w, times[n], into)

    def forward(self, s: str) -> float:
        get, longest, n, exp, log = self.weights.get, self.longest, len(s), math.exp, math.log
        a = [0.0] * (n + 1)
        for j in range(1, n + 1):
            terms = []
            for i in range(j - longest if j > longest else 0, j):
                w = get(s[i:j])
                if w is not None:
                    terms.append(a[i] + w)
            if get(s[j - 1]) is None:
                terms.append(a[j - 1] + sum(get(f"<0x{b:02X}>", -30.0) for b in s[j - 1].encode("utf-8", "replace")))
            if len(terms) == 1:
                a[j] = terms[0]
            else:
                top = max(terms)
                a[j] = top + log(sum([exp(t - top) for t in terms]))
        return a[n]

    def spelled(self, letter: str) -> list[str]:
        return [f"<0x{b:02X}>" for b in letter.encode("utf-8", "replace")]

    def steps(self, s: str, j: int, scale: array) -> Iterator[tuple[int, float, str | None]]:
        """(start, weight, piece or None) of the arcs that end at j; weights hold the factors of the places they pass."""
        get, factor = self.linear.get, 1.0
        for i in range(j - 1, max(-1, j - self.longest - 1), -1):
            if (w := get(s[i:j])) is not None:
                yield i, w * factor, s[i:j]
            factor *= scale[i]
        if get(s[j - 1]) is None:
            yield j - 1, math.exp(sum(self.weights.get(p, -30.0) for p in self.spelled(s[j - 1]))), None

    def expect(self, s: str, times: float, into: dict[str, float]) -> None:
        """Adds times the expected count of every piece of s, whatever its length. The forward sums are kept at 1 by a factor
        for each place, so only the factors are held; the arcs are looked up again on the way back."""
        n = len(s)
        scale, back = array("d", bytes(8 * (n + 1))), array("d", bytes(8 * (n + 1)))
        scale[0] = 1.0
        for j in range(1, n + 1):
            scale[j] = 1.0 / sum(w for _, w, _ in self.steps(s, j, scale))
        back[n] = 1.0
        for j in range(n, 0, -1):
            up = back[j] * scale[j]
            for i, w, piece in self.steps(s, j, scale):
                part = w * up
                back[i] += part
                if piece is not None:
                    into[piece] += part * times
                else:
                    for p in self.spelled(s[j - 1]):
                        into[p] += part * times


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


#: A-Z to a-z; other bytes stay.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words as UTF-8. Bytes split at \x20 and \x09 to \x0D alone, so other Unicode spaces stay in words."""
    return (text or "").encode("utf-8", "replace").translate(_BYTES).split()


def score_texts(df: DataFrame, model_file: str, text: str = "text", key: str = "doc_id", fold: Callable[[Column], Column] = held_out, head_words: int = HEAD_WORDS, rounds: int | None = None) -> DataFrame:
    """One row a document, see the contract of op9; score is log10 of the text's probability."""
    spark = df.sparkSession
    model = parse_model(Path(model_file).read_bytes())
    rounds = (0 if model.kind == UNIGRAM else 1) if rounds is None else rounds

    def count() -> Callable[..., Iterator[tuple]]:
        counted: Counter = Counter()

        def finish() -> Iterator[tuple]:
            for w, c in counted.items():
                yield w.decode(), c
            counted.clear()

        def work(held: list, texts: list) -> Iterator[tuple]:
            for h, t in zip(held, texts, strict=True):
                if h:
                    for w in set(words_of(t)):
                        counted.setdefault(w, 0)
                else:
                    counted.update(words_of(t))
            if len(counted) > COUNTED:
                yield from finish()

        work.finish = finish
        return work

    partial = map_columns(df, [fold(F.col(key)), F.col(text)], "word string, c long", count)
    vocab = keep(partial.groupBy("word").agg(F.sum("c").alias("c")), "words")
    trained, types = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    ends = df.where(~fold(F.col(key))).count()
    n_tokens, n_types = trained + ends, types + (ends > 0)

    weights = start_weights(model)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(weights)  # as many as the tokenizer has pieces

        def gather() -> Callable[..., Iterator[tuple]]:
            lattice = Lattice(sent.value)
            into: dict[str, float] = defaultdict(float)

            def work(words: list, counts: list) -> Iterator[tuple]:
                lattice.expect_all([MARK + w for w in words], counts, into)
                return iter(())

            work.finish = into.items  # at most one row a piece
            return work

        expected = map_columns(vocab.where("c > 0"), [F.col("word"), F.col("c")], "piece string, n double", gather)
        got = {r[0]: r[1] for r in expected.groupBy("piece").agg(F.sum("n")).collect()}  # one row a piece of the tokenizer
        total = sum(got.get(p, 0.0) + PRIOR for p in weights) + ends + PRIOR
        weights = {p: math.log((got.get(p, 0.0) + PRIOR) / total) for p in weights}
        end_weight = math.log((ends + PRIOR) / total)
    go_on = 0.0
    if not rounds:  # the pieces keep their scores; a text ends or goes on before every word
        end_weight = math.log((ends + 0.5) / (n_tokens + 1))
        go_on = math.log1p(-math.exp(end_weight))
    sent = spark.sparkContext.broadcast(weights)
    norm = n_tokens + 0.5 * (n_types + 1)

    def rate() -> Callable[..., Iterator[tuple]]:
        lattice = Lattice(sent.value)

        def work(words: list, counts: list) -> Iterator[tuple]:
            for w, c, lp in zip(words, counts, lattice.forward_all([MARK + w for w in words]), strict=True):
                yield w, int(c > 0), math.log10((c + 0.5) / norm), (lp + go_on) / LOG10, c

        return work

    rated = keep(map_columns(vocab, [F.col("word"), F.col("c")], "word string, known int, base double, lp double, c long", rate), "rated")
    short = F.length("word") <= LONG_WORD
    name = F.when(short, F.col("word")).otherwise(F.concat(F.lit("\0"), F.md5("word")))  # no word holds this letter first and a hash after it
    top = rated.orderBy(F.desc("c"), "word").limit(head_words).select(name.alias("word"), "known", "base", "lp").toArrow()
    head = spark.sparkContext.broadcast((top["word"].to_pylist(), *(top[c].to_numpy() for c in ("known", "base", "lp"))))
    end = (int(ends > 0), math.log10((ends + 0.5) / norm) if norm else 0.0, end_weight / LOG10)

    def sums() -> Callable[..., Iterator[tuple]]:
        names, *values = head.value
        place = {w.encode(): n for n, w in enumerate(names)}.get

        def work(keys: list, held: list, texts: list) -> Iterator[tuple]:
            for k, h, t in zip(keys, held, texts, strict=True):
                words = words_of(t)
                at = np.fromiter(map(place, words, repeat(-1)), np.int64, len(words))
                for x in np.flatnonzero(at < 0):
                    if len(words[x]) > LONG_WORD:
                        at[x] = place(b"\0" + md5(words[x]).hexdigest().encode(), -1)
                rare = Counter(compress(words, (at < 0).tolist()))
                at = at[at >= 0]
                known, base, lp = (e + v[at].sum().item() for e, v in zip(end, values, strict=True))
                yield k, bool(h), len(words) + 1, known, base, lp, [w.decode() for w in rare], list(rare.values())

        return work

    first = map_columns(df, [F.col(key).try_cast("long"), fold(F.col(key)), F.col(text)], "doc_id long, held_out boolean, n_tokens long, known long, base double, lp double, word array<string>, tf array<long>", sums)
    first = keep(first.withColumn("row", F.monotonically_increasing_id()), "sums")
    rest = first.select("row", F.explode(F.arrays_zip("word", "tf")).alias("r")).select("row", "r.word", "r.tf").join(rated.drop("c"), "word")
    parts = first.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "lp").unionByName(rest.select("row", (F.col("known") * F.col("tf")).alias("known"), (F.col("base") * F.col("tf")).alias("base"), (F.col("lp") * F.col("tf")).alias("lp")), allowMissingColumns=True)
    return (
        parts.groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("known").cast("long").alias("n_known"), F.sum("base").alias("base_score"), F.sum("lp").alias("score"))
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
    )
