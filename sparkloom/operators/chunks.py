"""Retrieval chunks: one for each section, each section of the schedule, each judgment, and the transition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators.concordance import ordered_distinct
from sparkloom.operators.ranks import global_rank

#: Names of the acts.
LONG = {"BNS": "BNS 2023", "BNSS": "BNSS 2023", "BSA": "BSA 2023", "IPC": "IPC 1860", "CRPC": "CrPC 1973", "IEA": "Indian Evidence Act 1872"}
FULL = {"BNS": "Bharatiya Nyaya Sanhita, 2023", "BNSS": "Bharatiya Nagarik Suraksha Sanhita, 2023", "BSA": "Bharatiya Sakshya Adhiniyam, 2023", "IPC": "Indian Penal Code, 1860", "CRPC": "Code of Criminal Procedure, 1973", "IEA": "Indian Evidence Act, 1872"}
SHORT = {"BNS": "BNS", "BNSS": "BNSS", "BSA": "BSA", "IPC": "IPC", "CRPC": "CrPC", "IEA": "Indian Evidence Act"}
NEW = ["BNS", "BNSS", "BSA"]
#: Day of commencement, first page of the schedule, the transition's text.
IN_FORCE = "2024-07-01"
SCHEDULE_URL = "https://www.mha.gov.in/sites/default/files/2024-04/250884_2_english_01042024.pdf"
COMMENCEMENT = "Commencement of the new criminal codes\n\nThe Bharatiya Nyaya Sanhita, 2023 (BNS, 358 sections), the Bharatiya Nagarik Suraksha Sanhita, 2023 (BNSS, 531 sections) and the Bharatiya Sakshya Adhiniyam, 2023 (BSA, 170 sections) came into force on 1 July 2024. They replace the Indian Penal Code, 1860, the Code of Criminal Procedure, 1973 and the Indian Evidence Act, 1872 respectively. The new criminal codes came into force on 1 July 2024. Offences committed on or after that date are dealt with under the new codes; matters registered earlier continue under the old codes."
#: New sections that a case's provisions line names at most.
MOST_NEW = 8

SCHEMA = ["chunk_id", "doc_type", "source", "act", "section", "section_title", "chapter_no", "chapter_title", "in_force_from", "status", "equivalent_sections", "text", "source_url"]


def named(names: dict[str, str], act: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), act)


def entity(act: Column, section: Column) -> Column:
    return F.lower(F.concat_ws("_", act, section))


def base_section(ref: Column) -> Column:
    """'356A' of '356A(3)'; '' where the reference starts with no number."""
    return F.regexp_extract(ref, r"^([0-9]+[A-Z]?)", 1)


def equivalents(mapping: DataFrame) -> DataFrame:
    """act, section, equivalents: array of (act, section) in the order of the concordance, in both directions."""
    both = mapping.where("old_section is not null and new_section is not null")
    a = both.select(F.col("old_act").alias("act"), F.col("old_section").alias("section"), F.struct(F.col("new_act").alias("act"), F.col("new_section").alias("section")).alias("to"), "row")
    b = both.select(F.col("new_act").alias("act"), F.col("new_section").alias("section"), F.struct(F.col("old_act").alias("act"), F.col("old_section").alias("section")).alias("to"), "row")
    return ordered_distinct(a.unionByName(b), ["act", "section"], "to", "row", "equivalents")


def statute_chunks(sections: DataFrame, mapping: DataFrame) -> DataFrame:
    """One chunk a section: a header line, its counterparts, its chapter, its text."""
    rows = sections.join(equivalents(mapping), ["act", "section"], "left")
    new = F.col("act").isin(NEW)
    listed = F.array_join(F.transform("equivalents", lambda x: F.concat(named(LONG, x["act"]), F.lit(" Section "), x["section"])), ", ")
    source = F.concat(named(LONG, F.col("act")), F.lit(", Section "), "section")
    head = F.concat(source, F.when(F.col("title") != "", F.concat(F.lit(" - "), "title")).otherwise(""))
    relation = F.concat(F.lit("("), F.when(new, "corresponds to ").otherwise("replaced by "), listed, F.lit(")"))
    chapter = F.when(F.col("chapter_title") != "", F.concat(F.lit("Chapter "), F.col("chapter_no").cast("string"), F.lit(": "), F.initcap("chapter_title")))
    return rows.select(
        entity(F.col("act"), F.col("section")).alias("chunk_id"),
        F.lit("statute").alias("doc_type"),
        source.alias("source"),
        "act",
        "section",
        F.col("title").alias("section_title"),
        F.col("chapter_no").cast("int").alias("chapter_no"),
        "chapter_title",
        F.when(new, IN_FORCE).alias("in_force_from"),
        F.when(new, "in force").otherwise("repealed with effect from 1 July 2024").alias("status"),
        F.coalesce(F.transform("equivalents", lambda x: F.concat_ws(" ", x["act"], x["section"])), F.array().cast("array<string>")).alias("equivalent_sections"),
        text.clean_text(F.concat_ws("\n", head, relation, chapter, "text")).alias("text"),
        "source_url",
    )


def schedule_chunks(schedule: DataFrame, titles: DataFrame) -> DataFrame:
    """One chunk for all entries of a section (Part I), one for Part II. titles: section, title of the penal code."""
    entry = F.concat(F.lit("Section "), "section_ref", F.lit(" - "), "offence_description", F.lit(" Punishment: "), "punishment", F.lit(" "), "cognizable", F.lit(". "), "bailable", F.lit(". Triable by: "), "triable_by", F.lit("."))
    first = schedule.where("part <> 'II'").withColumn("section", base_section(F.col("section_ref"))).where("section <> ''")
    listed = first.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("row", entry.alias("e")))).alias("e")).join(titles.select("section", "title"), "section", "left")
    title = F.coalesce("title", F.lit(""))
    head = F.concat(F.lit("BNSS First Schedule - classification of the offence under BNS Section "), "section", F.when(title != "", F.concat(F.lit(" ("), title, F.lit(")"))).otherwise(""))
    one = listed.select(
        F.concat(F.lit("schedule_bns_"), F.lower("section")).alias("chunk_id"),
        F.concat(F.lit("BNSS 2023, First Schedule (BNS Section "), "section", F.lit(")")).alias("source"),
        "section",
        title.alias("section_title"),
        F.concat_ws("\n", head, F.array_join(F.transform("e", lambda x: x["e"]), "\n")).alias("text"),
    )
    other = schedule.where("part = 'II'").withColumn("e", F.concat("offence_description", F.lit(" "), "cognizable", F.lit(". "), "bailable", F.lit(". Triable by: "), "triable_by", F.lit(".")))
    other = other.groupBy(F.lit("schedule_other_laws").alias("chunk_id")).agg(F.array_sort(F.collect_list(F.struct("row", "e"))).alias("e"))
    intro = "BNSS First Schedule, Part II - classification of offences against other laws\nWhere an offence is created by an Act other than the Bharatiya Nyaya Sanhita, it is classified by the punishment it carries:"
    two = other.select("chunk_id", F.lit("BNSS 2023, First Schedule, Part II").alias("source"), F.lit("").alias("section"), F.lit("Offences against other laws").alias("section_title"), F.concat_ws("\n", F.lit(intro), F.array_join(F.transform("e", lambda x: x["e"]), "\n")).alias("text"))
    fixed = {"doc_type": F.lit("schedule"), "act": F.lit("BNSS"), "chapter_no": F.lit(None).cast("int"), "chapter_title": F.lit("First Schedule - Classification of Offences"), "in_force_from": F.lit(IN_FORCE), "status": F.lit("in force"), "equivalent_sections": F.array().cast("array<string>"), "source_url": F.lit(SCHEDULE_URL)}
    return one.unionByName(two).withColumns(fixed).withColumn("text", text.clean_text(F.col("text"))).select(SCHEMA)


def case_new_sections(cases: DataFrame, mapping: DataFrame) -> DataFrame:
    """cases (row, old_act, old_sections) with new_sections: counterparts of its sections, in order, each once."""
    known = mapping.where("old_section is not null and new_section is not null").select("old_act", F.col("old_section").alias("s"), F.concat_ws(" ", "new_act", "new_section").alias("ref"), F.col("row").alias("map_row"))
    asked = cases.select("row", "old_act", F.posexplode("old_sections").alias("at", "s"))
    met = asked.join(known, ["old_act", "s"]).withColumn("order", F.struct("at", "map_row"))
    return cases.join(ordered_distinct(met, ["row"], "ref", "order", "new_sections"), "row", "left").withColumn("new_sections", F.coalesce("new_sections", F.array().cast("array<string>")))


def merged_cases(cases: DataFrame) -> DataFrame:
    """One row a judgment (source_url): the first row's fields; topics, old and new references in the order they come."""
    first = cases.groupBy("source_url").agg(F.min_by(F.struct("case_name", "court", "year", "old_act", "old_sections", "holding_summary"), "row").alias("c"))
    topics = ordered_distinct(cases, ["source_url"], "topic", "row", "topics")
    old = cases.select("source_url", "row", "old_act", F.posexplode("old_sections").alias("at", "s"))
    old = ordered_distinct(old.select("source_url", F.concat_ws(" ", "old_act", "s").alias("ref"), F.struct("row", "at").alias("order")), ["source_url"], "ref", "order", "old_refs")
    new = cases.select("source_url", "row", F.posexplode("new_sections").alias("at", "ref"))
    new = ordered_distinct(new.select("source_url", "ref", F.struct("row", "at").alias("order")), ["source_url"], "ref", "order", "new_refs")
    none = F.array().cast("array<string>")
    joined = first.join(topics, "source_url").join(old, "source_url", "left").join(new, "source_url", "left")
    return joined.select("source_url", "c.*", "topics", F.coalesce("old_refs", none).alias("old_refs"), F.coalesce("new_refs", none).alias("new_refs"))


def case_chunks(cases: DataFrame) -> DataFrame:
    """One chunk a judgment, numbered in the order of the addresses. cases as of case_new_sections."""
    rows = global_rank(merged_cases(cases), ["source_url"], "n")
    source = F.concat("case_name", F.lit(" ("), "court", F.lit(", "), F.col("year").cast("string"), F.lit(")"))
    new = F.array_join(F.slice("new_refs", 1, MOST_NEW), ", ")
    body = F.concat_ws("\n", source, F.concat(F.lit("Topics: "), F.array_join("topics", "; ")), F.concat(F.lit("Provisions: "), F.array_join("old_refs", ", "), F.when(new != "", F.concat(F.lit(" (now "), new, F.lit(")"))).otherwise("")), F.concat(F.lit("Held (extract from the judgment): "), "holding_summary"))
    number = F.col("n").cast("string")
    return rows.select(
        F.concat(F.lit("case_"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)).alias("chunk_id"),
        F.lit("case_law").alias("doc_type"),
        source.alias("source"),
        F.col("old_act").alias("act"),
        F.coalesce(F.get("old_sections", 0), F.lit("")).alias("section"),
        F.array_join("topics", "; ").alias("section_title"),
        F.lit(None).cast("int").alias("chapter_no"),
        F.lit(None).cast("string").alias("chapter_title"),
        F.lit(None).cast("string").alias("in_force_from"),
        F.lit("case law").alias("status"),
        F.col("new_refs").alias("equivalent_sections"),
        text.clean_text(body).alias("text"),
        "source_url",
    )


def transition_chunk(df: DataFrame) -> DataFrame:
    """The one chunk on commencement, in df's session."""
    title = COMMENCEMENT.split("\n")[0]
    row = ("transition_commencement", "reference", title, "", "", title, None, None, IN_FORCE, "reference", [], COMMENCEMENT, "https://www.mha.gov.in/")
    schema = ", ".join(f"{c} {'int' if c == 'chapter_no' else 'array<string>' if c == 'equivalent_sections' else 'string'}" for c in SCHEMA)
    return df.sparkSession.createDataFrame([row], schema).withColumn("text", text.clean_text(F.col("text")))
