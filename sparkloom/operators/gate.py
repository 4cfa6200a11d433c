"""The validation gate over sections, concordance, chunks, questions, cases, schedule and splits: check, level, n_bad."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators.chunks import base_section

#: Types of a mapping, limits of lengths, the first words of the classes.
TYPES = ["direct", "split", "merged", "new_provision", "removed"]
LEAST_SECTION, LEAST_CHUNK, MOST_CHUNK, LEAST_SCOPE, LEAST_CASES = 30, 80, 20_000, 5, 3
STARTS = {"cognizable": "^(Cognizable|Non-cognizable|According)", "bailable": "^(Bailable|Non-bailable|According)", "triable_by": "^(Court|Magistrate|Any|According|The)"}


def rows(counts: DataFrame, levels: dict[str, str]) -> DataFrame:
    """One row a column of a one-row table of counts."""
    found = F.array(*(F.struct(F.lit(n).alias("check"), F.when(F.col(n) == 0, "OK").otherwise(level).alias("level"), F.col(n).cast("long").alias("n_bad")) for n, level in levels.items()))
    return counts.select(F.inline(found))


def one(name: str, level: str, bad: DataFrame) -> DataFrame:
    return rows(bad.agg(F.count("*").alias(name)), {name: level})


def many(tests: dict[str, tuple[str, Column]], df: DataFrame) -> DataFrame:
    """All tests of a table in one pass."""
    return rows(df.agg(*(F.count_if(F.coalesce(bad, F.lit(False))).alias(n) for n, (_, bad) in tests.items())), {n: level for n, (level, _) in tests.items()})


def blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""


def check_sections(sections: DataFrame, expected: DataFrame) -> DataFrame:
    """sections: act, section, title, text; expected: act, n. Numbers that lack, that come twice, sections without heading or text."""
    wanted = expected.select("act", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("section")).withColumn("section", F.col("section").cast("string"))
    parts = [one("missing", "FAIL", wanted.join(sections, ["act", "section"], "left_anti")), one("duplicates", "FAIL", sections.groupBy("act", "section").count().where("count > 1"))]
    parts.append(many({"untitled": ("WARN", blank("title")), "no_text": ("FAIL", F.length("text") < LEAST_SECTION)}, sections))
    return reduce(DataFrame.unionByName, parts)


def check_mapping(mapping: DataFrame, sections: DataFrame, expected: DataFrame) -> DataFrame:
    kind = F.col("mapping_type")
    parts = [many({"unknown_type": ("FAIL", ~kind.isin(TYPES)), "new_with_old": ("FAIL", (kind == "new_provision") & F.col("old_section").isNotNull()), "removed_with_new": ("FAIL", (kind == "removed") & F.col("new_section").isNotNull())}, mapping)]
    named = mapping.where("new_section is not null").select(F.col("new_act").alias("act"), F.col("new_section").alias("section"))
    parts.append(one("dangling", "FAIL", named.join(sections, ["act", "section"], "left_anti")))
    covered = named.distinct().groupBy("act").agg(F.count("*").alias("c"))
    parts.append(one("uncovered_acts", "WARN", expected.join(covered, "act", "left").where(F.coalesce("c", F.lit(0)) < F.col("n"))))
    return reduce(DataFrame.unionByName, parts)


def check_chunks(chunks: DataFrame, expected: DataFrame) -> DataFrame:
    t = F.col("text")
    tests = {f"empty_{c}": ("FAIL", blank(c)) for c in ("chunk_id", "source", "text", "source_url")}
    tests |= {"damaged": ("FAIL", text.damaged(t)), "tiny": ("WARN", F.length(t) < LEAST_CHUNK), "huge": ("FAIL", F.length(t) > MOST_CHUNK)}
    statutes = chunks.where("doc_type = 'statute'").groupBy("act").agg(F.count("*").alias("c"))
    parts = [many(tests, chunks), one("repeated_id", "FAIL", chunks.groupBy("chunk_id").count().where("count > 1")), one("incomplete_acts", "FAIL", expected.join(statutes, "act", "left").where(F.coalesce("c", F.lit(0)) != F.col("n")))]
    return reduce(DataFrame.unionByName, parts)


def check_questions(qa: DataFrame) -> DataFrame:
    """qa: instruction, output, qa_type."""
    parts = [many({"empty": ("FAIL", blank("instruction") | blank("output")), "damaged": ("FAIL", text.damaged(F.col("output")))}, qa), one("repeated_question", "FAIL", qa.groupBy(F.lower("instruction").alias("q")).count().where("count > 1"))]
    few = qa.agg(F.count_if(F.col("qa_type") == "scope").alias("c")).where(F.col("c") < LEAST_SCOPE)
    return reduce(DataFrame.unionByName, [*parts, one("few_scope_examples", "WARN", few)])


def check_cases(cases: DataFrame) -> DataFrame:
    tests = {f"no_{c}": ("WARN", blank(c)) for c in ("case_name", "court", "holding_summary", "source_url")} | {"no_year": ("WARN", F.col("year").isNull())}
    return many(tests, cases).unionByName(one("thin_topics", "WARN", cases.groupBy("topic").count().where(F.col("count") < LEAST_CASES)))


def check_schedule(schedule: DataFrame, sections: DataFrame) -> DataFrame:
    first = schedule.where("part = 'I'")
    tests = {f"empty_{c}": ("FAIL", blank(c)) for c in ("section_ref", "offence_description", "cognizable", "bailable", "triable_by")}
    tests |= {f"odd_{c}": ("FAIL", ~F.col(c).rlike(p)) for c, p in STARTS.items()}
    bases = first.select(base_section(F.col("section_ref")).alias("section")).where("section <> ''").distinct()
    return many(tests, first).unionByName(one("unknown_sections", "FAIL", bases.join(sections.where("act = 'BNS'"), "section", "left_anti")))


def check_splits(split: DataFrame, confusion: DataFrame, groups: DataFrame) -> DataFrame:
    """split: instruction, grp, split; confusion: instruction, output, mapping_type, group_keys; groups: node, grp."""
    twice = lambda c: split.groupBy(c).agg(F.count_distinct("split").alias("n")).where("n > 1")
    keys = confusion.select(F.explode("group_keys").alias("node")).join(groups, "node", "left").select(F.coalesce("grp", "node").alias("grp")).distinct()
    parts = [
        one("groups_in_two_splits", "FAIL", twice("grp")),
        one("questions_in_two_splits", "FAIL", twice("instruction")),
        one("confusion_groups_in_a_split", "FAIL", keys.join(split, "grp", "left_semi")),
        one("confusion_questions_in_a_split", "FAIL", confusion.select("instruction").distinct().join(split, "instruction", "left_semi")),
        many({"undocumented": ("FAIL", blank("output") | blank("mapping_type"))}, confusion),
    ]
    return reduce(DataFrame.unionByName, parts)
