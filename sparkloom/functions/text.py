"""Column functions over text; each takes and returns a Column and stays in the JVM."""

from __future__ import annotations

import html
import html.entities
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Control bytes that lost the high bit of a Windows-1252 letter, and these letters, in natural order.
CP1252_FROM = "\x00\x02\x03\x04\x05\x06\x07\x08\x0b\x0c\x0e\x11\x12\x13\x14\x15\x16\x17\x18\x19\x1a\x1b\x1c\x1e\x1f"
CP1252_TO = "€‚ƒ„…†‡ˆ‹ŒŽ‘’“”•–—˜™š›œžŸ"
#: The control bytes whose letter is not defined; tab, line feed and carriage return stay.
CP1252_NONE = "\x01\x0f\x10\x1d"
#: Curly quotes to ASCII.
QUOTES_FROM, QUOTES_TO = "‘’“”", "''\"\""
#: Words left out of titles when they are compared.
STOP_WORDS = ["of", "the", "a", "an", "to", "for", "in", "on", "or", "and", "by", "with", "from", "as", "at", "any", "be", "is", "not", "punishment", "etc"]


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, with c worked out once a row however often f names it."""
    return F.transform(F.array(c), f)[0]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def repair_cp1252(c: Column) -> Column:
    """C0 bytes that lost their high bit become the letters they were; those without a letter go."""
    return F.translate(c, CP1252_FROM + CP1252_NONE, CP1252_TO)


def clean_text(c: Column) -> Column:
    """Repaired bytes, ASCII quotes, single blanks, no blanks around line ends, no blank lines. A text of printable ASCII
    and line feeds without two blanks or line feeds side by side or one at its ends is clean: it stays as it is."""

    def steps(x: Column) -> Column:
        x = F.translate(repair_cp1252(x), QUOTES_FROM, QUOTES_TO)
        x = F.regexp_replace(F.regexp_replace(x, "——", "—"), r"[ \t\x{a0}]+", " ")
        return strip(F.regexp_replace(x, r"(?U)\s*\n\s*", "\n"))

    ends = lambda x: F.startswith(x, F.lit(" ")) | F.endswith(x, F.lit(" ")) | F.startswith(x, F.lit("\n")) | F.endswith(x, F.lit("\n"))
    inside = lambda x: F.contains(x, F.lit("  ")) | F.contains(x, F.lit(" \n")) | F.contains(x, F.lit("\n ")) | F.contains(x, F.lit("\n\n"))
    clean = lambda x: x.rlike(r"\A[ -~\n]*\z") & ~inside(x) & ~ends(x)
    return once(c, lambda x: F.when(clean(x), x).otherwise(steps(x)))


@F.pandas_udf(returnType=StringType())
def unescape(c: pd.Series) -> pd.Series:
    """Character references to letters, by the HTML standard's table."""
    return c.map(html.unescape, na_action="ignore")


@F.pandas_udf(returnType=StringType())
def unescape_closed(c: pd.Series) -> pd.Series:
    """The same of references that end in a semicolon; a name without one stays as it is written."""
    known = lambda m: html.unescape(m[0]) if m[1][0] == "#" or m[1] + ";" in html.entities.html5 else m[0]
    return c.map(lambda x: re.sub(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[0-9A-Za-z]+);", known, x), na_action="ignore")


def _lines(c: Column, tag: str, unescaped: Callable = unescape) -> Column:
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    c = F.regexp_replace(c, r"(?i)<li[^>]*>", "\n- ")
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)</(p|div|ol|ul|tr|h\d)>", "\n"), r"(?i)<br\s*/?>", "\n")
    return clean_text(unescaped(F.regexp_replace(c, r"<[^>]+>", tag)))


def strip_html(c: Column, closed: bool = False) -> Column:
    """Text of a page: scripts and styles dropped, list items and block ends on lines of their own. closed: only character
    references that end in a semicolon are letters."""
    return _lines(c, "", unescape_closed if closed else unescape)


def judgment_text(c: Column) -> Column:
    """Text of a judgment: any tag becomes a blank, then as clean_text."""
    return clean_text(unescape(F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]+>", " ")))


def dedup_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def metric_words(c: Column) -> Column:
    """Lower-case words without punctuation and articles."""
    words = F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "), " ")
    return F.filter(words, lambda w: ~w.isin("", "a", "an", "the"))


def metric_key(c: Column) -> Column:
    return F.array_join(metric_words(c), " ")


def section_number(c: Column) -> Column:
    """Leading number with at most two capitals after it, without blanks; '' where there is none."""
    trimmed = F.regexp_replace(F.replace(c, F.lit("\n"), F.lit(" ")), r"^[\s\].,;]+|[\s\].,;]+$", "")
    return F.upper(F.regexp_replace(F.regexp_extract(trimmed, r"^([0-9]+\s*[A-Z]{0,2})", 1), r"\s+", ""))


def split_refs(c: Column) -> Column:
    """Distinct section numbers of a cell such as '12, 13A & 14', in order; none for new, nil or dashes."""
    cell = strip(F.replace(c, F.lit("\n"), F.lit(" ")))
    parts = F.transform(F.split(cell, r"\s*(?:,|;|&|\band\b|/)\s*"), section_number)
    none = cell.rlike(r"(?i)^(new(ly)?( added| provision| sub-?section)?|-+|nil|n/?a|none)\.?$") | (cell == "")
    return F.when(none, F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(parts, lambda x: x != "")))


def natural_key(c: Column) -> Column:
    """(number, suffix); what has no number comes last."""
    number = F.regexp_extract(c, "([0-9]+)", 1)
    return F.struct(F.when(number == "", F.lit(10**9)).otherwise(F.expr("0").cast("int") + number.try_cast("int")).alias("n"), F.regexp_extract(c, "[0-9]+(.*)$", 1).alias("s"))


def roman(c: Column) -> Column:
    """Value of a Roman numeral; null for anything else."""
    digit = F.create_map(*[F.lit(x) for pair in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in pair])
    values = F.transform(F.reverse(F.split(F.upper(c), "")), lambda x: F.element_at(digit, x))
    fold = F.aggregate(values, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("top")), lambda a, v: F.struct(F.when(v < a["top"], a["sum"] - v).otherwise(a["sum"] + v).alias("sum"), F.greatest(a["top"], v).alias("top")), lambda a: a["sum"])
    return F.when(F.upper(c).rlike("^[IVXLCDM]+$"), fold)


def shorten(c: Column, limit: int) -> Column:
    """At most limit letters, cut after the last sentence or clause end past the middle; marked with [...]."""

    def last(head: Column) -> Column:
        back = [limit - 1 - F.instr(F.reverse(head), mark[::-1]) + F.lit(1) for mark in (". ", "; ")]
        return F.greatest(*[F.when(F.instr(head, mark) > 0, b).otherwise(0) for mark, b in zip((". ", "; "), back, strict=True)])

    def cut(head: Column) -> Column:
        return once(last(head), lambda n: F.when((n - 1) * 2 > limit, F.substring(head, F.lit(1), n.cast("int"))).otherwise(head))

    return once(c, lambda x: F.when(F.length(x) <= limit, x).otherwise(F.concat(F.regexp_replace(once(F.substring(x, 1, limit), cut), r"\s+$", ""), F.lit(" [...]"))))


def title_words(c: Column) -> Column:
    return F.array_except(F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z]+"), lambda x: x != "")), F.array(*map(F.lit, STOP_WORDS)))


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two arrays; 0 where one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def join_wrapped(parts: Column) -> Column:
    """Lines joined by blanks, without one after a hyphen."""
    return F.aggregate(parts, F.lit(""), lambda a, x: F.when(a == "", x).when(a.endswith("-"), F.concat(a, x)).otherwise(F.concat(a, F.lit(" "), x)))


def opens_with(c: Column, markers: list[str], within: int = 60) -> Column:
    head = F.lower(F.substring(c, 1, within))
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(head, m))


def damaged(c: Column) -> Column:
    """Control bytes, replacement letters, or UTF-8 read as Windows-1252."""
    return c.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffd}]") | c.rlike("Ã[\\x{80}-\\x{bf}]|â€™|â€œ|â€\\x{9d}|Â ")


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays with multiplicity: the n-th occurrence of a word is a word of its own. Words are
    sorted and numbered within their run, so the work is that of sorting, however long the texts are."""

    def runs(s: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

    def numbered(s: Column) -> Column:
        ends = lambda starts, j: F.coalesce(F.get(starts, j + 1), F.size(s)) - 1
        each = lambda starts: F.flatten(F.transform(starts, lambda i, j: F.transform(F.sequence(i, ends(starts, j)), lambda k: F.concat(F.get(s, i), F.lit(" "), (k - i).cast("string")))))
        return F.when(F.size(s) == 0, s).otherwise(once(runs(s), each))

    return F.size(F.array_intersect(once(F.sort_array(a), numbered), once(F.sort_array(b), numbered)))


def words_f1(p: Column, g: Column) -> Column:
    """F1 of two arrays of words as multisets; if either is empty, 1 where both are."""
    shared = once(multiset_overlap(p, g).cast("double"), lambda n: F.when(n == 0, F.lit(0.0)).otherwise(2 * n / (F.size(p) + F.size(g))))
    return F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double")).otherwise(shared)


def token_f1(pred: Column, gold: Column) -> Column:
    """F1 of the words of two texts as multisets; if either is empty, 1 where both are."""
    return once(metric_words(pred), lambda p: once(metric_words(gold), lambda g: words_f1(p, g)))
