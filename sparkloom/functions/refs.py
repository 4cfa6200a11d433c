"""References to sections of acts inside text."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import once

#: The spellings of the acts and their short names.
ACTS = {
    "BHARATIYA NYAYA SANHITA": "BNS",
    "BNS": "BNS",
    "BHARATIYA NAGARIK SURAKSHA SANHITA": "BNSS",
    "BNSS": "BNSS",
    "BHARATIYA SAKSHYA ADHINIYAM": "BSA",
    "BSA": "BSA",
    "INDIAN PENAL CODE": "IPC",
    "IPC": "IPC",
    "CODE OF CRIMINAL PROCEDURE": "CRPC",
    "CRPC": "CRPC",
    "CR.P.C": "CRPC",
    "INDIAN EVIDENCE ACT": "IEA",
    "EVIDENCE ACT": "IEA",
    "IEA": "IEA",
}
#: How the old acts are called beside the new ones that replaced them.
NEW_OF = {"IPC": "BNS", "CRPC": "BNSS", "IEA": "BSA"}
#: Numbers from here on are years.
FIRST_YEAR = 1000

_NAMES = "|".join(name.replace(".", r"\.") for name in sorted(ACTS, key=len, reverse=True))
#: White space, digits and word ends of every script, named one by one: Java's U flag would slow the letters down.
SPACE, DIGIT, START, END = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", r"[0-9\p{Nd}]", r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: The letters with which an act's spelling begins: a position with another letter needs no look at the spellings.
_HEAD = "(?=[" + "".join(sorted({name[0] for name in ACTS})) + "])"
_LIST = rf"{DIGIT}+[A-Za-z]{{0,2}}(?:{SPACE}*(?:,|and|&){SPACE}*{DIGIT}+[A-Za-z]{{0,2}})*"
#: Fixed formats: an act, perhaps its year, perhaps the word section, then numbers; or numbers "of" an act.
ACT_FIRST = rf"(?i){_HEAD}({_NAMES}){END}[ ,]*(?:{DIGIT}{{4}}[ ,]*)?(?:Sections?|ss?\.)?{SPACE}*({_LIST})"
SECTION_FIRST = rf"(?i)Sections?{SPACE}*({_LIST})(?:{SPACE}*\([0-9a-z]+\))*{SPACE}*of{SPACE}+(?:the{SPACE}+)?({_NAMES}){END}"
SECTION_FIRST_PLAIN = rf"(?i)Sections?{SPACE}*({_LIST}){SPACE}*of{SPACE}+(?:the{SPACE}+)?({_NAMES}){END}"
ACT_ALONE = rf"(?i){_HEAD}{START}({_NAMES}){END}"
SECTION_ALONE = rf"(?i){START}Sections?{SPACE}*({_LIST})"
CHUNK = r"(?i)^(?:schedule_)?(bns|bnss|bsa|ipc|crpc|iea)_([0-9]+[a-z]{0,2})$"


def canon(name: Column) -> Column:
    """The short name of an act's spelling."""
    known = F.create_map(*[F.lit(x) for pair in ACTS.items() for x in pair])
    return F.element_at(known, F.upper(name))


@cache
def _digits() -> tuple[str, str]:
    """Every decimal digit, and the ASCII digits that they stand for."""
    found = [chr(c) for c in range(128, 0x110000) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(found), "".join(str(unicodedata.digit(c)) for c in found)


def numbers(listed: Column) -> Column:
    """Section numbers of a list such as '415, 417 and 420A', as they are written; years are none."""
    parts = F.transform(F.split(F.regexp_replace(listed, rf"{SPACE}*(?:,|and|&){SPACE}*", ","), ","), F.upper)
    year = lambda x: F.translate(F.regexp_extract(x, rf"^({DIGIT}+)", 1), *_digits()).cast("double") >= FIRST_YEAR
    return F.filter(parts, lambda x: x.rlike(rf"^{DIGIT}+[A-Z]{{0,2}}$") & ((F.length(x) < 4) | ~year(x)))


def _cited(c: Column, pattern: str, act: int, listed: int) -> Column:
    # one pass over the text; the parts are taken out of what it found
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    one = lambda m: once(canon(F.regexp_extract(m, pattern, act)), lambda a: F.transform(numbers(F.regexp_extract(m, pattern, listed)), lambda x: F.concat_ws(" ", a, x)))
    return F.flatten(F.transform(found, one))


def extract_refs(c: Column) -> Column:
    """Sorted distinct 'ACT N' that a text cites, act first or section first, sub-sections passed over. A null text gives null."""
    return F.array_sort(F.array_distinct(F.concat(_cited(c, ACT_FIRST, 1, 2), _cited(c, SECTION_FIRST, 2, 1))))


def query_refs(c: Column) -> Column:
    """The same of a question, without sub-sections; if that finds nothing and the text names one act alone, that
    act with the numbers of every 'section N'."""
    strict = F.array_sort(F.array_distinct(F.concat(_cited(c, ACT_FIRST, 1, 2), _cited(c, SECTION_FIRST_PLAIN, 2, 1))))
    acts = F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(ACT_ALONE), F.lit(1)), canon))
    bare = F.flatten(F.transform(F.regexp_extract_all(c, F.lit(SECTION_ALONE), F.lit(1)), numbers))
    loose = lambda a: F.array_sort(F.array_distinct(F.transform(bare, lambda n: F.concat_ws(" ", a[0], n))))
    return once(strict, lambda s: F.when(F.size(s) == 0, once(acts, lambda a: F.when(F.size(a) == 1, loose(a)).otherwise(s))).otherwise(s))


def chunk_ref(chunk_id: Column) -> Column:
    """'ACT N' of the id of a statute or schedule chunk, else null."""
    return F.when(chunk_id.rlike(CHUNK), F.upper(F.concat_ws(" ", F.regexp_extract(chunk_id, CHUNK, 1), F.regexp_extract(chunk_id, CHUNK, 2))))


def subset(gold: Column, pred: Column) -> Column:
    return F.size(F.array_except(gold, pred)) == 0


def same(gold: Column, pred: Column) -> Column:
    return F.array_sort(F.array_distinct(gold)) == F.array_sort(F.array_distinct(pred))
