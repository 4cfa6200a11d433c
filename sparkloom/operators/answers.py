"""Answers by rule from concordance, schedule and sections; contexts and prompts for a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import refs, text
from sparkloom.functions.refs import NEW_OF
from sparkloom.operators.chunks import NEW, SHORT, base_section, named
from sparkloom.operators.concordance import ordered_distinct
from sparkloom.operators.graph import cut
from sparkloom.operators.qa import DISCLAIMER

#: Questions out of scope and the refusal; beginning of a prompt; numbers of the context.
OUT_OF_SCOPE = r"(?i)\b(be my (lawyer|advocate|counsel)|represent me|are you a lawyer|should i plead|will i (be convicted|go to (jail|prison))|what will my sentence|loophole|get (away with|off)|avoid (being )?(convict|prosecut|arrest|liab)|evade|how (do|can) i (avoid|escape|beat)|fake|false (alibi|evidence)|bribe|give me legal advice|advise me on my)\b"
REFUSAL = "I can't help with that. I'm an informational tool, not a licensed advocate: I can't advise on a specific case, predict an outcome, or help with avoiding liability. What I can do is set out what a provision of the BNS, BNSS or BSA says, which older provision it corresponds to, and what reported decisions have held about it."
TASK = "answer the indian criminal law question: "
NO_MODEL = "No language model is loaded, so here is the relevant law rather than a composed answer:\n\n"
MOST_CHUNKS, BUDGET, LEAST_SHARE, LETTERS_A_TOKEN = 4, 430, 60, 4
#: Letters of a section's text in an answer, titles that a search lists.
MOST_LAW, MOST_TITLES = 2000, 5


def refused(question: Column) -> Column:
    return question.rlike(OUT_OF_SCOPE)


def cite(ref: Column) -> Column:
    """'CrPC §154' of 'CRPC 154'."""
    act = F.split_part(ref, F.lit(" "), F.lit(1))
    return F.concat(named(SHORT, act), F.lit(" §"), F.split_part(ref, F.lit(" "), F.lit(2)))


def cites(listed: Column) -> Column:
    return F.array_join(F.transform(listed, cite), ", ")


def profiles(mapping: DataFrame, sections: DataFrame, schedule: DataFrame) -> DataFrame:
    """One row a provision: ref, title, law, to (counterparts in order), siblings (every provision that the only
    counterpart takes in), classes (entries of the schedule)."""
    key = lambda side: F.concat_ws(" ", f"{side}_act", f"{side}_section")
    both = mapping.where("row is not null").select(key("old").alias("o"), key("new").alias("n"), "row")
    fwd = ordered_distinct(both, ["o"], "n", "row", "to").withColumnRenamed("o", "ref")
    back = ordered_distinct(both, ["n"], "o", "row", "to").withColumnRenamed("n", "ref")
    siblings = back.select(F.col("ref").alias("n"), F.col("to").alias("siblings"))
    only = fwd.where(F.size("to") == 1).select("ref", F.col("to")[0].alias("n")).join(siblings, "n").select("ref", "siblings")
    entry = F.concat(F.lit("Section "), "section_ref", F.lit(": "), "cognizable", F.lit(", "), "bailable", F.lit(", "), "triable_by")
    first = schedule.where("part = 'I'").withColumn("ref", F.concat(F.lit("BNS "), base_section(F.col("section_ref")))).where(F.col("ref") != "BNS ")
    classes = first.groupBy("ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", entry.alias("e")))), lambda x: x["e"]).alias("classes"))
    rows = sections.select(F.concat_ws(" ", "act", "section").alias("ref"), "title", F.substring(F.regexp_replace("text", r"\s+", " "), 1, MOST_LAW).alias("law"))
    return rows.join(fwd.unionByName(back), "ref", "left").join(only, "ref", "left").join(classes, "ref", "left")


def heading_search(questions: DataFrame, sections: DataFrame) -> DataFrame:
    """qid, headings: sections whose heading holds every word of a question that names no section, five at most, by their
    reference.

    Words are ordered by the number of headings that hold them, the rarest first. A question of two words or more meets the
    headings of its two rarest words together, which are then held against all its words; a heading goes to each pair of its
    words. Of the headings of a word, and of a pair, only the first five are wanted by a question that has no other words, so
    these are cut before they meet the questions, however many headings hold the word."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    titles = sections.where("title <> ''").select(F.concat_ws(" ", "act", "section").alias("ref"), "title", words(F.col("title")).alias("has"))
    one = F.transform("has", lambda x: F.struct(x.alias("a"), x.alias("b")))
    two = F.flatten(F.transform("has", lambda x: F.transform(F.filter("has", lambda y: x < y), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    index = titles.select("ref", F.inline(F.concat(one, two)))
    counts = titles.select(F.explode("has").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    asked = questions.select("qid", words(F.col("question")).alias("w")).where(F.size("w") > 0)
    known = asked.select("qid", F.explode("w").alias("word")).join(counts, "word")
    rare = known.groupBy("qid").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "word"))), 1, 2).alias("x"), F.count("*").alias("m"))  # the words of one question
    x, y = F.col("x")[0]["word"], F.coalesce(F.get("x", 1), F.get("x", 0))["word"]
    keyed = asked.join(rare, "qid").where(F.col("m") == F.size("w")).select("qid", "w", "m", F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    first = index.withColumn("r", F.row_number().over(Window.partitionBy("a", "b").orderBy("ref"))).where(F.col("r") <= MOST_TITLES).drop("r")
    few = keyed.where("m <= 2").join(first, ["a", "b"]).select("qid", "ref")
    more = keyed.where("m > 2").join(index, ["a", "b"]).join(titles.select("ref", "has"), "ref").where(F.size(F.array_except("w", "has")) == 0).select("qid", "ref")
    best = few.unionByName(more).withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("ref"))).where(F.col("r") <= MOST_TITLES).join(titles.select("ref", "title"), "ref")
    line = F.concat(cite(F.col("ref")), F.lit(" "), "title")
    return best.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("l")))), lambda x: x["l"]), "; ").alias("headings"))


def answer(questions: DataFrame, profile: DataFrame, sections: DataFrame) -> DataFrame:
    """qid, branch, answer of every question (qid, question); any text has an answer, a null one as an empty one.

    Out of scope; no provision named: headings that hold its words; an unknown provision; the number of one act asked of
    its successor (collision): the true counterpart; a question on classes: the schedule; what a section says: its text;
    else the counterparts: none, several, one that takes in several, one."""
    q = F.coalesce(F.col("question"), F.lit(""))
    # parsed once: a filter over what was found would be pushed below and parse each question again for every mention
    rows = cut(questions.select("qid", q.alias("question"), refs.query_refs(q).alias("refs"), refused(q).alias("refused")))
    old = F.filter("refs", lambda r: F.split_part(r, F.lit(" "), F.lit(1)).isin(list(NEW_OF)))
    sister = lambda r: F.concat_ws(" ", named(NEW_OF, F.split_part(r, F.lit(" "), F.lit(1))), F.split_part(r, F.lit(" "), F.lit(2)))
    clash = F.filter(old, lambda r: F.array_contains(F.col("refs"), sister(r)))
    rows = rows.withColumn("clash", F.get(clash, 0)).withColumn("ref", F.coalesce("clash", F.get("refs", 0)))
    open_ = rows.where(~F.col("refused") & F.col("ref").isNull())
    found = rows.join(profile, "ref", "left").join(heading_search(open_, sections), "qid", "left")
    name, to = cite(F.col("ref")), F.coalesce("to", F.array().cast("array<string>"))
    act = F.split_part("ref", F.lit(" "), F.lit(1))
    new = act.isin(NEW)
    title = F.when(F.col("title") != "", F.concat(F.lit(" ("), "title", F.lit(")"))).otherwise("")
    asks = lambda words: F.lower("question").rlike(words)
    counterpart = F.when(F.size(to) == 0, F.lit("It has no counterpart.")).otherwise(F.concat(F.lit("The true counterpart of "), name, F.lit(" is "), cites(to), F.lit(".")))
    branches = [
        ("scope", F.col("refused"), F.lit(REFUSAL)),
        ("headings", F.col("ref").isNull() & F.col("headings").isNotNull(), F.concat(F.lit("Headings that match: "), "headings")),
        ("nothing", F.col("ref").isNull(), F.lit("Name a section, or words of its heading.")),
        ("unknown", F.col("law").isNull(), F.concat(F.lit("There is no record of "), name, F.lit("."))),
        ("collision", F.col("clash").isNotNull() & ~F.array_contains(to, sister(F.col("clash"))), F.concat(F.lit("No, "), cite(sister(F.col("ref"))), F.lit(" is a different provision. "), counterpart)),
        ("classification", asks("bailable|cognizable|triable|which court") & F.col("classes").isNotNull(), F.concat(F.lit("First Schedule: "), F.array_join("classes", "; "))),
        ("text", asks(r"\b(cover|say|text|explain|provided)\b"), F.concat(name, title, F.lit(": "), "law")),
        ("removed", ~new & (F.size(to) == 0), F.concat(name, title, F.lit(" has no counterpart in the new code."))),
        ("split", ~new & (F.size(to) > 1), F.concat(F.lit("There is no single one: "), name, F.lit(" was divided among "), cites(to), F.lit("."))),
        ("merged", ~new & (F.size(F.coalesce("siblings", F.array().cast("array<string>"))) > 1), F.concat(name, F.lit(" is now part of "), cites(to), F.lit(", which takes in "), cites(F.col("siblings")), F.lit("."))),
        ("old to new", ~new, F.concat(name, title, F.lit(" is now "), cites(to), F.lit("."))),
        ("new provision", F.size(to) == 0, F.concat(name, title, F.lit(" is new; it has no counterpart in the old code."))),
    ]
    kind, said = F.when(branches[0][1], branches[0][0]), F.when(branches[0][1], branches[0][2])
    for b, test, out in branches[1:]:
        kind, said = kind.when(test, b), said.when(test, out)
    said = said.otherwise(F.concat(name, title, F.lit(" corresponds to "), cites(to), F.lit(".")))
    return found.select("qid", kind.otherwise("new to old").alias("branch"), said.alias("answer"))


def counterparts(mapping: DataFrame) -> DataFrame:
    """ref, others: counterparts of every provision, both directions, in the order of the concordance."""
    both = mapping.where("row is not null").select(F.concat_ws(" ", "old_act", "old_section").alias("a"), F.concat_ws(" ", "new_act", "new_section").alias("b"), "row")
    return ordered_distinct(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "row")), ["a"], "b", "row", "others").withColumnRenamed("a", "ref")


def select_chunks(questions: DataFrame, chunks: DataFrame, others: DataFrame, hits: DataFrame, most: int | None = None) -> DataFrame:
    """qid, chunk_id, r (from 1): chunks of the provisions that a question names (in the order of their names as texts),
    then of their counterparts, then its similarity hits (qid, chunk_id, rank), each once. chunks: chunk_id."""
    return first_of(candidates(questions, chunks, others, hits), "o", most)


def candidates(questions: DataFrame, chunks: DataFrame, others: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, chunk_id, o, plain: each chunk that a question may be given, with its place in the order (o) and its place where
    counterparts are not looked up (plain, null if it is there as a counterpart alone). Questions are parsed once."""
    keyed = chunks.select("chunk_id", refs.chunk_ref(F.col("chunk_id")).alias("ref")).where("ref is not null")
    asked = cut(questions.select("qid", F.posexplode(refs.query_refs(F.coalesce("question", F.lit("")))).alias("i", "ref")))
    order = lambda level, i, j: F.struct(F.lit(level).alias("level"), i.alias("i"), j.alias("j"))
    zero = F.lit(0)
    one = asked.join(keyed, "ref").select("qid", "chunk_id", order(1, F.col("i"), zero).alias("o"))
    hop = asked.join(others, "ref").select("qid", "i", F.posexplode("others").alias("j", "ref")).join(keyed, "ref")
    two = hop.select("qid", "chunk_id", order(2, F.col("i"), F.col("j")).alias("o"))
    three = hits.join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("qid", "chunk_id", order(3, F.col("rank").cast("int"), zero).alias("o"))
    return one.unionByName(two).unionByName(three).groupBy("qid", "chunk_id").agg(F.min("o").alias("o"), F.min(F.when(F.col("o.level") != 2, F.col("o"))).alias("plain"))


def first_of(found: DataFrame, order: str, most: int | None = None) -> DataFrame:
    """qid, chunk_id, r (from 1) of the candidates that have a place in this order; the first ``most`` if that is named."""
    ranked = found.where(F.col(order).isNotNull()).select("qid", "chunk_id", F.row_number().over(Window.partitionBy("qid").orderBy(order, "chunk_id")).alias("r"))
    return ranked if most is None else ranked.where(F.col("r") <= most)


def truncated(c: Column, letters: Column) -> Column:
    """At most so many letters, cut at the last blank, and a mark that more was there."""
    head = F.substring(c, F.lit(1), letters)
    return F.when(F.length(c) <= letters, c).otherwise(F.concat(F.regexp_replace(head, r" [^ ]*$", ""), F.lit(" [...]")))


def build_context(chosen: DataFrame, chunks: DataFrame, most: int = MOST_CHUNKS, budget: int = BUDGET) -> DataFrame:
    """qid, context, ids: the first chunks (qid, chunk_id, r) sharing a budget of tokens; texts are fetched for these alone."""
    first = chosen.where(F.col("r") <= most).join(chunks.select("chunk_id", "text"), "chunk_id")
    listed = first.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("r", "chunk_id", "text"))).alias("c"))
    share = F.greatest(F.lit(LEAST_SHARE), F.floor(F.lit(budget) / F.size("c"))).cast("int") * LETTERS_A_TOKEN
    parts = F.transform("c", lambda x: truncated(x["text"], share))
    return listed.select("qid", F.array_join(parts, "\n\n---\n\n").alias("context"), F.transform("c", lambda x: x["chunk_id"]).alias("ids"))


def prompt(question: Column, context: Column) -> Column:
    more = text.strip(F.coalesce(context, F.lit("")))
    return F.concat(F.lit(TASK), text.strip(question), F.when(more != "", F.concat(F.lit("\n\ncontext: "), more)).otherwise(""))


def ask(questions: DataFrame, chunks: DataFrame, others: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, refused, text, citations, prompt: the refusal, or the law itself where no model is loaded, with its sources."""
    said = questions.withColumn("refused", refused(F.coalesce("question", F.lit(""))))
    context = build_context(select_chunks(said.where("not refused"), chunks, others, hits.join(said.where("refused").select("qid"), "qid", "left_anti")), chunks)
    rows = said.join(context, "qid", "left").withColumn("context", F.coalesce("context", F.lit("")))
    body = F.when(F.col("refused"), F.lit(REFUSAL)).otherwise(F.concat(F.lit(NO_MODEL), "context"))
    return rows.select("qid", "refused", body.alias("text"), F.coalesce("ids", F.array().cast("array<string>")).alias("citations"), prompt(F.coalesce("question", F.lit("")), F.col("context")).alias("prompt"))


def narrowed(answer_text: Column, citations: Column) -> Column:
    """Of the citations those of provisions that the answer names; all of them where it names none of them."""
    named_ = refs.extract_refs(answer_text)
    few = F.filter(citations, lambda c: F.array_contains(named_, refs.chunk_ref(c)))
    return F.when(F.size(few) > 0, few).otherwise(citations)


def printed(answer_text: Column, sources: Column) -> Column:
    """An answer with its list of sources and the disclaimer."""
    listed = F.when(F.size(sources) > 0, F.concat(F.lit("\n\nSources:\n"), F.array_join(F.transform(sources, lambda s: F.concat(F.lit("  - "), s)), "\n"))).otherwise("")
    return F.concat(answer_text, listed, F.lit(f"\n\n{DISCLAIMER}"))
