"""Rows from marked-up pages, JSON of several dialects, table cells, numbered replies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.functions.refs import canon

#: Fixed formats of the section pages.
ANCHOR = r"<h2[^>]*>\s*Section\s*<a name=[\"']s([0-9A-Za-z]+)[\"']>"
SHOWN = r"^\s*([0-9]+[A-Za-z]{0,2})\s*</a>"
TITLE = r"(?s)^[^<]*</a>\s*(?::-|&#8211;|&ndash;|–|-)?\s*(.*?)</h2>"
BODY = r"(?s)<div class=[\"']sectxt[\"'][^>]*>(.*?)</div>"
CHAPTER = r"(?is)<h1>\s*Chapter\s+([IVXLC0-9]+)\s*</h1>\s*<h2[^>]*>(.*?)</h2>"
CROSS = r"(?i)<span class=\"caps\">(IPC|CRPC|BNS|BNSS|BSA)</span>\s*Section\s*<a href=\"[^\"]*?/(?:ipc|crpc|iea|bns)/section/([0-9A-Za-z]+)/?\""
#: Fixed formats of results, judgments and citations in them.
RESULT = r"(?s)(<article class=\"result\".*?</article>)"
RESULT_LINK = r"(?s)href=\"/doc(?:fragment)?/([0-9]+)/?[^\"]*\"[^>]*>(.*?)</a>"
CITED = r"(?iU)[Ss]ections?\s+(\d+[A-Z]{0,2})(?:\s*\([^)]{1,8}\))?\s*(?:of\s+(?:the\s+)?)?(IPC|I\.P\.C|Indian Penal Code|CrPC|Cr\.P\.C|Code of Criminal Procedure|Evidence Act|Indian Evidence Act|BNS|BNSS|BSA)"
#: Fixed formats of table cells, classes and replies.
NO_OLD = r"(?i)^(new(ly)?( added| provision| sub-?section)?|-+|nil|n/?a|none)\.?$"
NUMBERED = r"^\s*(?:\*\*)?([0-9]{1,3})(?:\*\*)?\s*[.)\-:]\s*(.*)$"
LEAST_REPLY = 25
#: What page furniture looks like and how courts state what they decide.
FURNITURE = r"(?i)Page\s+\d+\s+of\s+\d+|Signature\s+Not\s+Verified|Digitally\s+signed(?:\s+by)?[^.]{0,60}|Date:\s*\d{4}\.\d{2}\.\d{2}[^ ]*|Reason:\s*$|\b(?:SLP|S\.L\.P|Criminal Appeal|Crl\.?\s*A)\s*\(?(?:Crl|Criminal|C)?\.?\)?\s*(?:No)?\.?\s*\(?s?\)?\.?\s*\d[\d/ ]*(?:of\s+\d{4})?"
HOLDING = r"(?i)\b(we are of the (?:considered )?(?:view|opinion)|we hold|it is well settled|the settled position|we are satisfied|we find no|in our (?:considered )?(?:view|opinion)|the appeal is (?:allowed|dismissed)|the conviction is|we set aside|is hereby quashed|cannot be sustained|it is trite law|the law is well settled|we accordingly|we therefore hold|must be held)\b"


def resolved_numbers(rows: DataFrame) -> DataFrame:
    """act, chapter_no, pos, section: a section's anchor, or the number shown if an earlier section of the act has the
    anchor already. Each choice rests on all before it, so an act's numbers (not its texts) are walked in one task."""

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        seen, out = set(), []
        for anchor, shown in part.sort_values(["chapter_no", "pos"])[["anchor", "shown"]].itertuples(index=False):
            number = shown if anchor in seen and shown else anchor
            seen.add(number)
            out.append(number)
        return part.sort_values(["chapter_no", "pos"]).assign(section=out)[["act", "chapter_no", "pos", "section"]]

    return rows.select("act", "chapter_no", "pos", "anchor", "shown").groupBy("act").applyInPandas(walk, "act string, chapter_no int, pos int, section string")


def anchor_sections(pages: DataFrame) -> DataFrame:
    """Sections of chapter pages (act, chapter_no, html): act, section, title, chapter_no, chapter_title, text, xref_act, xref_section."""
    names = F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1))
    parts = F.slice(F.split("html", ANCHOR), F.lit(2), F.size(names) + 1)
    chapter = F.regexp_extract("html", CHAPTER, 2)
    cut = pages.select("act", F.col("chapter_no").cast("int").alias("chapter_no"), F.when(chapter != "", text.strip_html(chapter)).alias("chapter_title"), F.posexplode(F.arrays_zip(names.alias("anchor"), parts.alias("chunk"))).alias("pos", "x"))
    cut = cut.select("act", "chapter_no", "chapter_title", "pos", "x.anchor", "x.chunk").withColumns({"shown": F.regexp_extract("chunk", SHOWN, 1), "body": F.regexp_extract("chunk", BODY, 1)})
    title = F.regexp_replace(F.regexp_replace(text.strip_html(F.regexp_extract("chunk", TITLE, 1)), r"(?<=[a-z])[0-9]$", ""), r"\.+$", "")
    x_act, x_section = F.upper(F.regexp_extract("body", CROSS, 1)), F.regexp_extract("body", CROSS, 2)
    rows = cut.select("act", "chapter_no", "pos", "chapter_title", title.alias("title"), text.strip_html(F.col("body")).alias("text"), F.nullif(x_act, F.lit("")).alias("xref_act"), F.nullif(x_section, F.lit("")).alias("xref_section"))
    return rows.join(resolved_numbers(cut), ["act", "chapter_no", "pos"]).drop("pos")


def aliased(raw: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Fields of the JSON objects in column ``json`` under the first of several names that is there and not empty;
    objects without a section are left out."""
    pick = lambda keys: F.coalesce(*(F.nullif(F.get_json_object("json", f"$.{k}"), F.lit("")) for k in keys), F.lit(""))
    rows = raw.select(*(c for c in raw.columns if c != "json"), *(text.clean_text(pick(keys)).alias(name) for name, keys in names.items()))
    return rows.where("section <> ''")


def search_results(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, doc_id, title of the results of each page, each document once, where it stands first."""
    blocks = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(RESULT), F.lit(1))).alias("pos", "block"))
    found = blocks.select(key, "pos", F.regexp_extract("block", RESULT_LINK, 1).alias("doc_id"), F.regexp_extract("block", RESULT_LINK, 2).alias("raw")).where("doc_id <> ''")
    return found.groupBy(key, "doc_id").agg(F.min_by("raw", "pos").alias("raw")).select(key, "doc_id", text.judgment_text(F.col("raw")).alias("title"))


def search_url(base: str, query: Column, doctype: Column) -> Column:
    """Address of a search; blanks are %20."""
    return F.concat(F.lit(f"{base}/search/?formInput="), F.replace(F.url_encode(F.concat(query, F.lit(" doctypes: "), doctype)), F.lit("+"), F.lit("%20")))


def judgment(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with title, case_name, court, bench, year and text of a judgment's page."""
    part = lambda pattern: F.regexp_extract(html, pattern, 1)
    rows = pages.withColumns({
        "title": text.judgment_text(part(r'(?s)<h2 class="doc_title">(.*?)</h2>')),
        "court": text.judgment_text(part(r'(?s)<h[23] class="docsource_main"[^>]*>(.*?)</h[23]>')),
        "bench": text.strip(F.replace(text.judgment_text(part(r'(?s)<h3 class="doc_bench">(.*?)</h3>')), F.lit("Bench:"), F.lit(""))),
        "text": flat(text.judgment_text(part(r'(?s)<div class="judgments">(.*)$'))),
    })
    year = F.coalesce(*(F.regexp_extract("title", p, 1).try_cast("int") for p in (r"on\s+[0-9]{0,2}\s*[A-Za-z]*\s*,?\s*([0-9]{4})\s*$", r"([0-9]{4})\s*$")))
    return rows.withColumns({"year": year, "case_name": text.strip(F.regexp_replace("title", r"\s+on\s+[0-9].*$", ""))})


def flat(c: Column) -> Column:
    """One line, without page furniture."""
    return text.strip(F.regexp_replace(F.regexp_replace(c, FURNITURE, " "), r"(?U)\s+", " "))


def cited_sections(c: Column) -> Column:
    """Sorted distinct (act, section) that a judgment cites, numbers in natural order."""
    numbers, acts = (F.regexp_extract_all(c, F.lit(CITED), F.lit(g)) for g in (1, 2))
    short = lambda a: F.when(F.lower(a) == "i.p.c", "IPC").otherwise(canon(a))
    found = F.zip_with(numbers, acts, lambda n, a: F.struct(short(a).alias("act"), F.regexp_extract(n, "^([0-9]+)", 1).cast("int").alias("n"), F.upper(n).alias("section")))
    return F.transform(F.array_sort(F.array_distinct(found)), lambda x: F.concat_ws(" ", x["act"], x["section"]))


def usable_sentence(s: Column) -> Column:
    n = F.length(s)
    letters, digits = (F.length(F.regexp_replace(s, p, "")) / n for p in (r"[^\p{L}]", r"[^\p{Nd}]"))
    return n.between(60, 400) & (letters >= 0.62) & (digits <= 0.10) & ~s.rlike(FURNITURE)


def holding_summary(df: DataFrame, key: str, body: str, sections: Column, most: int = 700, markers: str = HOLDING) -> DataFrame:
    """key, summary: of the last two thirds of a text, the three usable sentences that state a conclusion best, in the
    order of the text; a sentence scores 1, and 2 more for each of the sections that it names."""
    tail = F.substring(F.col(body), F.floor(F.length(body) / 3).cast("int") + 1, F.length(body))
    cut = df.select(key, sections.alias("secs"), F.posexplode(F.split(tail, r"(?<=[.;])\s+(?=[A-Z(])")).alias("pos", "s"))
    cut = cut.withColumn("s", text.strip(F.col("s"))).where(usable_sentence(F.col("s")) & F.col("s").rlike(markers))
    named = F.size(F.filter("secs", lambda x: F.array_contains(F.split("s", r"[^\p{L}\p{N}_]+"), x)))
    best = Window.partitionBy(key).orderBy(F.desc("score"), "pos")
    top = cut.withColumn("score", 1 + 2 * named).withColumn("r", F.row_number().over(best)).where("r <= 3")
    joined = top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), " ").alias("t"))
    head = F.regexp_replace(F.substring("t", 1, most), r" [^ ]*$", "")
    return joined.select(key, text.clean_text(F.when(F.length("t") > most, F.concat(head, F.lit(" ..."))).otherwise(F.col("t"))).alias("summary"))


def compact(cells: Column) -> Column:
    """Cells that hold something, cleaned."""
    return F.transform(F.filter(cells, lambda x: text.strip(x) != ""), text.clean_text)


def table_rows(rows: DataFrame, cells: str, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected): rows of the wanted number of cells as columns ``names``; one cell less is padded if the last
    column is the summary. Heading rows and rows of a wrong shape are rejected, not guessed."""
    full = rows.withColumn("c__", compact(F.col(cells)))
    padded = F.when((F.size("c__") == len(names) - 1) & F.lit(names[-1] == "summary"), F.concat("c__", F.array(F.lit("")))).otherwise(F.col("c__"))
    full = full.withColumn("c__", padded)
    at = {n: F.get("c__", i) for i, n in enumerate(names)}
    old = text.strip(at["old"])
    good = (F.size("c__") == len(names)) & at["new"].rlike("^[0-9]") & ((text.section_number(old) != "") | old.rlike(NO_OLD))
    heading = F.when(F.size("c__") == len(names), ~at["new"].rlike("^[0-9]")).otherwise((F.size("c__") == 0) | F.get("c__", 0).rlike(r"(?i)^(BNS|BNSS|BSA)\b"))
    keep = [c for c in rows.columns if c != cells]
    kept = full.where(good).select(*keep, *(c.alias(n) for n, c in at.items()))
    kept = kept.withColumns({"new_section": text.section_number(F.col("new")), "old_sections": text.split_refs(F.col("old"))})
    return kept, full.where(~F.coalesce(good, F.lit(False)) & ~F.coalesce(heading, F.lit(False))).select(*keep, F.col("c__").alias("cells"))


def class_words(html: Column) -> Column:
    """cognizable, bailable, court that a block of markup names; the negative form and the higher court first."""
    t = F.lower(F.regexp_replace(html, "<[^>]+>", " "))
    first = lambda words, out=None: F.coalesce(*(F.when(F.contains(t, F.lit(w)), (out or {}).get(w, w)) for w in words), F.lit(""))
    return F.struct(first(["non-cognizable", "cognizable"]).alias("cognizable"), first(["non-bailable", "bailable"]).alias("bailable"), first(["session", "first class", "second class", "any magistrate"]).alias("court"))


def class_check(schedule: DataFrame, other: DataFrame) -> DataFrame:
    """section, field, theirs, ours of the sections whose entries nowhere hold the other source's word. schedule:
    section and the three fields; other: section, cognizable, bailable, court. A plain word is found inside its negative too."""
    union = schedule.groupBy("section").agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in ("cognizable", "bailable", "triable_by")))
    both = union.join(other.select("section", F.struct("cognizable", "bailable", "court").alias("t")), "section")
    pairs = [("cognizable", "cognizable"), ("bailable", "bailable"), ("triable_by", "court")]
    rows = both.select("section", F.inline(F.array(*(F.struct(F.lit(a).alias("field"), F.col("t")[b].alias("theirs"), F.array_join(a, "; ").alias("ours")) for a, b in pairs))))
    return rows.where((F.col("theirs") != "") & ~F.contains(F.lower("ours"), F.col("theirs")))


def replies(lines: DataFrame, source: str, first: Column, count: Column) -> DataFrame:
    """source, n, answer, how: answers of reply files by line (source, line_no, line, and the numbers asked). Numbered
    lines begin an answer, other lines continue it, repeated numbers are put together. A file without numbers is taken by
    position if it has exactly as many long lines as questions, else it gives no rows."""
    w = Window.partitionBy(source).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumns({"t": text.strip(F.col("line")), "first": first, "count": count}).where("t <> ''")
    number = F.regexp_extract("line", NUMBERED, 1).try_cast("int")
    rows = rows.withColumn("own", F.when(F.col("line").rlike(NUMBERED), number))
    rows = rows.withColumn("n", F.last("own", ignorenulls=True).over(w))
    said = F.when(F.col("own").isNotNull(), text.strip(F.regexp_extract("line", NUMBERED, 2))).otherwise(F.col("t"))
    numbered = rows.where("n is not null").groupBy(source, "n").agg(F.array_sort(F.collect_list(F.struct("line_no", said.alias("s")))).alias("p"))
    numbered = numbered.select(source, "n", text.strip(F.array_join(F.filter(F.transform("p", lambda x: x["s"]), lambda x: x != ""), " ")).alias("answer"), F.lit("numbered").alias("how"))
    bare = rows.join(rows.where("own is not null").select(source).distinct(), source, "left_anti").where(F.length("t") > LEAST_REPLY)
    own = Window.partitionBy(source)
    bare = bare.withColumns({"r": F.row_number().over(own.orderBy("line_no")), "m": F.count("*").over(own)}).where(F.col("m") == F.col("count"))
    return numbered.unionByName(bare.select(source, (F.col("first") + F.col("r") - 1).cast("int").alias("n"), F.col("t").alias("answer"), F.lit("positional").alias("how")))
