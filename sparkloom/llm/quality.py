"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Rules are Columns over lazily built measures. ``plan_cascade`` counts on a bounded seeded sample what each rule
rejects and how many letters and words it goes over, then orders the rules by rejections per cost; ``cascade``
evaluates them in that order inside one CASE, so a row that a cheap rule rejects never reaches the dear ones. The
order changes the time taken, never whether a row is rejected.

Nulls and empty texts have no words and fail ``few_words``; repeated rows are judged alike; further columns
pass through (one named like the new column is an error); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import SPACES, let

Rule = Callable[[Mapping[str, Column]], Column]

SYMBOLS = "#*$%&|<>"
#: Rows of the sample that sets the order of the rules (not the verdicts).
SAMPLE_ROWS = 2000
SAMPLE_FILES = 8
#: What a measure costs: passes over the letters, and work for each word, in the time of one pass over a letter.
WORK = {
    "n_words": {"letters": 2.0, "words": 2.0},
    "word_chars": {"letters": 1.0},
    "n_symbols": {"letters": 2.0},
    "n_dup_lines": {"letters": 3.0},
    "n_repeat_words": {"letters": 7.0, "words": 40.0},
    "n_lines": {"letters": 2.0},
    "n_letters": {"letters": 8.0},
    "n_capitals": {"letters": 8.0},
}
WINDOW = 5


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _without(text: Column, marks: str) -> Column:
    return F.length(F.translate(text, marks, "")).cast("long")


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    return let(lines, lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


def repeat_words(word_array: Column) -> Column:
    """Words that lie in five-word windows found at least twice: a hash of each window decides whether
    the windows themselves must be sorted and compared."""

    def windows(w: Column) -> Column:
        return F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))

    def covered(w: Column) -> Column:
        grams = F.array_sort(F.transform(windows(w), lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("g"), i.alias("i"))))

        def again(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: F.get(s, j - 1)["g"].eqNullSafe(x["g"]) | F.get(s, j + 1)["g"].eqNullSafe(x["g"]))
            starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
            zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(starts, zero, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")), lambda a: a["n"])

        return let(grams, again)

    def judged(w: Column) -> Column:
        hashes = F.transform(windows(w), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        twice = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
        return F.when(F.size(w) <= WINDOW, F.lit(0)).when(twice, covered(w)).otherwise(F.lit(0))

    return let(word_array, judged).cast("long")


def measures(text: Column, w: Column | None = None) -> dict[str, Column]:
    """The measures of a text that is never null; w: a column that has its words already."""
    w = words(text) if w is None else w
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": _without(text, SPACES),
        "n_symbols": F.length(text).cast("long") - _without(text, SYMBOLS),
        "n_dup_lines": dup_lines(text),
        "n_repeat_words": repeat_words(w),
        "n_lines": F.size(F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")).cast("long"),
        "n_letters": F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]+", "")).cast("long"),
        "n_capitals": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long"),
    }


#: The two rules of the contract.
BASE: dict[str, Rule] = {
    "few_words": lambda m: m["n_words"] < 10,
    "repeats": lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"],
}
#: The further rules; bounds lie far from ordinary prose in any language.
METHOD: dict[str, Rule] = {
    "symbols": lambda m: 10 * m["n_symbols"] > 3 * m["n_words"],
    "long_words": lambda m: m["word_chars"] > 20 * m["n_words"],
    "short_words": lambda m: m["word_chars"] < 2 * m["n_words"],
    "same_lines": lambda m: 2 * m["n_dup_lines"] > m["n_lines"],
    "few_letters": lambda m: 2 * m["n_letters"] < m["word_chars"],
    "capitals": lambda m: 10 * m["n_capitals"] > 7 * m["n_letters"],
}


def sample_of(df: DataFrame, text: str, rows: int, seed: int = 7) -> DataFrame:
    """About ``rows`` texts, a seeded sample. A table read from files is sampled in at most ``SAMPLE_FILES`` of them,
    chosen by hash, whatever its size; any other frame is sampled as a whole."""
    files = sorted(df.inputFiles(), key=lambda f: md5(f.rsplit("/", 1)[-1].encode()).digest())[:SAMPLE_FILES]
    source = df
    if files:
        some = df.sparkSession.read.parquet(*files)
        source = some if text in some.columns else df
    n = source.count()
    return source.select(text).sample(False, min(1.0, rows / n if n else 1.0), seed)


def plan_cascade(df: DataFrame, rules: Mapping[str, Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS, paid: frozenset[str] = frozenset()) -> list[str]:
    """Rule names by rejections per cost on a sample of about sample_rows rows. A rule costs the letters and words that
    its measures go over, as counted on the sample by ``WORK``, and one for each row; measures in ``paid`` are there
    anyway and cost nothing. The same rows give the same order."""
    t = F.coalesce(F.col(text), F.lit(""))
    m = measures(t)
    used: dict[str, set[str]] = {}
    for name, rule in rules.items():
        seen = _Seen(m)
        rule(seen)
        used[name] = seen.names - paid
    sample = sample_of(df, text, sample_rows)
    counts = [F.count("*").alias("rows"), F.sum(F.length(t)).alias("letters"), F.sum(m["n_words"]).alias("words"), *(F.count_if(rule(m)).alias(f"hit_{name}") for name, rule in rules.items())]
    got = sample.agg(*counts).first()
    n = got["rows"] or 1
    units = {"letters": (got["letters"] or 0) / n, "words": (got["words"] or 0) / n}
    cost = {name: 1 + sum(w * units[u] for k in sorted(used[name]) for u, w in WORK[k].items()) for name in rules}
    return sorted(rules, key=lambda name: (-((got[f"hit_{name}"] + 0.5) / n / cost[name]), name))


class _Seen(Mapping):
    """Remembers which measures a rule asks for."""

    def __init__(self, m: Mapping[str, Column]) -> None:
        self.m, self.names = m, set()

    def __getitem__(self, name: str) -> Column:
        self.names.add(name)
        return self.m[name]

    def __iter__(self):
        return iter(self.m)

    def __len__(self) -> int:
        return len(self.m)


def cascade(m: Mapping[str, Column], rules: Mapping[str, Rule], order: list[str]) -> Column:
    """The first rule, in this order, that rejects the row; null where none does."""
    out = F.when(rules[order[0]](m), F.lit(order[0]))
    for name in order[1:]:
        out = out.when(rules[name](m), F.lit(name))
    return out


def apply_rules(df: DataFrame, rules: Mapping[str, Rule] | None = None, text: str = "text", out: str = "failed_rule") -> DataFrame:
    """df with the rule that rejected each row; rules that come after it are not evaluated for the row."""
    rules = {**BASE, **METHOD} if rules is None else rules
    if out in df.columns:
        raise ValueError(f"the table has a column {out} already")
    order = plan_cascade(df, rules, text)
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.withColumns({"t__": t, "w__": words(t)})  # the words are cut once for all rules
    return rows.withColumn(out, cascade(measures(F.col("t__"), F.col("w__")), rules, order)).drop("t__", "w__")


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id with the measures of the contract and the verdicts. Those measures are there for every row; the measures
    that only the method's rules need stand inside the cascade, so they are taken of rows that come to such a rule."""
    given = frozenset(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    order = plan_cascade(df, METHOD, text, paid=given)
    t = F.coalesce(F.col(text), F.lit(""))
    m = measures(F.col("t__"), F.col("w__"))
    rows = df.select("doc_id", t.alias("t__"), words(t).alias("w__")).select("doc_id", "t__", *(m[k].alias(k) for k in sorted(given)))
    lazy = {**m, **{k: F.col(k) for k in given}}
    failed = BASE["few_words"](lazy) | BASE["repeats"](lazy)
    rows = rows.withColumn("base_failed", failed)
    kept = F.when(F.col("base_failed"), False)
    for name in order:
        kept = kept.when(METHOD[name](lazy), False)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.otherwise(True).alias("kept"))
