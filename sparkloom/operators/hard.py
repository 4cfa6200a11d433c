"""Hard examples: confusions between two numberings, negations, and contexts that help or mislead."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import refs, text
from sparkloom.functions.refs import NEW_OF
from sparkloom.operators import answers
from sparkloom.operators.chunks import FULL, SHORT, entity, named
from sparkloom.operators.concordance import ordered_distinct
from sparkloom.operators.qa import lower_first, say

#: How many of each kind, titles listed, when two titles are too alike, how much is misled or helped.
CONFUSIONS = {"collision": 14, "merged": 14, "split": 5, "removed": 10, "transition": 1}
CONFUSION_TARGET = 44
NEGATIONS = {"collision": 700, "merged": 300, "no_single": 250}
MOST_LISTED, ALIKE = 8, 0.5
SHARE_HELPED, SHARE_MISLED, SPARE_MISLED = 0.70, 0.20, 0.67
SERVED, MOST_CHUNKS = 3, 4
TRANSITION = ("An FIR was registered on 20 June 2024 for an offence committed that week. The trial is going on now. Should the charge be framed under the IPC or the BNS?", "Under the IPC. The Bharatiya Nyaya Sanhita, 2023 came into force on 1 July 2024 and applies to offences committed on or after that date. An offence committed and registered before that date continues under the Indian Penal Code, 1860, whatever the date of the trial.")


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts))


def chance(*parts: Column) -> Column:
    """A number from 0 to 2^32 - 1 that the parts decide."""
    return F.conv(F.substring(_hash(*parts), 1, 8), 16, 10).cast("long")


def natural(sections: Column) -> Column:
    """Section numbers in natural order."""
    keyed = F.transform(sections, lambda s: F.struct(F.regexp_extract(s, "^([0-9]+)", 1).cast("int").alias("n"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])


def relations(mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(old_act, old_section, news) and (new_act, new_section, olds): counterparts in the order of the concordance."""
    both = mapping.where("row is not null")
    news = ordered_distinct(both, ["old_act", "old_section"], "new_section", "row", "news")
    olds = ordered_distinct(both, ["new_act", "new_section"], "old_section", "row", "olds")
    return news, olds


def _described(side: DataFrame, listed: str, act: str, titles: DataFrame, keys: list[str], out: str, most: int | None = None) -> DataFrame:
    """keys with the text 'BNS Section 1 (Title), ...' of the sections in ``listed`` of the act ``act``."""
    t = titles.select(F.col("act").alias(act), F.col("section").alias("s"), F.col("title").alias("t"))
    rows = side.select(*keys, *([] if act in keys else [act]), F.posexplode(F.slice(listed, 1, most) if most else F.col(listed)).alias("i", "s"))
    each = F.concat(named(SHORT, F.col(act)), F.lit(" Section "), "s", F.when(F.col("t") != "", F.concat(F.lit(" ("), "t", F.lit(")"))).otherwise(""))
    met = rows.join(t, [act, "s"], "left")
    return met.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", each.alias("d")))), lambda x: x["d"]), ", ").alias(out))


def facts(mapping: DataFrame, titles: DataFrame) -> DataFrame:
    """One row a titled old section: old_act, old_section, title, new_act, news, refs (described), other (title of the same
    number in the new act, null if it has none), olds (all that its first counterpart takes in, natural order)."""
    news, olds = relations(mapping)
    new_act = named(NEW_OF, F.col("old_act"))
    rows = titles.where("title <> ''").where(F.col("act").isin(list(NEW_OF))).select(F.col("act").alias("old_act"), F.col("section").alias("old_section"), "title").withColumn("new_act", new_act)
    rows = rows.join(news, ["old_act", "old_section"], "left").withColumn("news", F.coalesce("news", F.array().cast("array<string>")))
    described = _described(rows, "news", "new_act", titles, ["old_act", "old_section"], "refs")
    other = titles.where("title <> ''").select(F.col("act").alias("new_act"), F.col("section").alias("old_section"), F.col("title").alias("other"))
    first = olds.select("new_act", F.col("new_section").alias("first"), natural(F.col("olds")).alias("olds"))
    rows = rows.withColumn("first", F.get("news", 0)).join(described, ["old_act", "old_section"], "left").join(other, ["new_act", "old_section"], "left")
    return rows.join(first, ["new_act", "first"], "left").withColumn("refs", F.coalesce("refs", F.lit("")))


def confusions(facts: DataFrame, salient: DataFrame, vetted: DataFrame) -> DataFrame:
    """mapping_type, old_act, old_section, instruction, output, group_keys, order. Collisions and merges of the salient
    sections (act, section), every split, removals that were vetted (act, section, row)."""
    rows = facts.withColumns({"short": named(SHORT, F.col("old_act")), "new": named(SHORT, F.col("new_act"))})
    part = {c: F.col(c) for c in ("short", "new", "title", "refs", "other")} | {"sec": F.col("old_section"), "code": F.col("new_act"), "full": named(FULL, F.col("old_act")), "into": named(FULL, F.col("new_act"))}
    part["subject"] = lower_first(F.regexp_replace("title", "^Punishment (?:for|of) ", ""))
    part["olds"] = F.array_join(F.slice("olds", 1, MOST_LISTED), ", ")
    chosen = rows.join(salient.select(F.col("act").alias("old_act"), F.col("section").alias("old_section")).distinct(), ["old_act", "old_section"], "left_semi")
    many = F.size("news") > 0
    kinds = []

    def add(kind: str, df: DataFrame, question: str, answer: Column, order: Column | None = None) -> None:
        keys = F.array_sort(F.array_distinct(F.concat(F.array(entity(F.col("old_act"), F.col("old_section"))), F.transform("news", lambda s: entity(F.col("new_act"), s)))))
        kinds.append(df.select(F.lit(kind).alias("mapping_type"), "old_act", "old_section", say(question, **part).alias("instruction"), answer.alias("output"), keys.alias("group_keys"), (_hash(F.lit(kind), "old_act", "old_section") if order is None else order).alias("order")))

    clash = chosen.where(F.col("other").isNotNull() & ~F.array_contains("news", F.col("old_section")))
    add("collision", clash, "Does {new} Section {sec} deal with the same subject as {short} Section {sec}?", F.when(many, say("No. {short} Section {sec} was {title}. {new} Section {sec} is a different provision entirely - {other}. The provision that now corresponds to {short} Section {sec} is {refs}.", **part)).otherwise(say("No. {short} Section {sec} was {title}, whereas {new} Section {sec} is {other}, and the old provision has no counterpart in the {code}.", **part)))
    merged = chosen.where((F.size("news") == 1) & (F.size("olds") > 1))
    add("merged", merged, "Is {subject} still dealt with under {short} Section {sec}?", say("No. The {full} was repealed with effect from 1 July 2024. {short} Section {sec} ({title}) now corresponds to {refs}, which consolidates {short} Sections {olds} into a single provision.", **part))
    add("split", rows.where(F.size("news") > 1), "Which single {code} section replaced {short} Section {sec}?", say("There is no single one. {short} Section {sec} ({title}) was split across {refs}. Citing only one of them states the position incompletely.", **part))
    gone = rows.where(F.size("news") == 0).join(vetted.select(F.col("act").alias("old_act"), F.col("section").alias("old_section"), "row"), ["old_act", "old_section"])
    add("removed", gone, "Which {code} section corresponds to {short} Section {sec}?", say("None. {short} Section {sec} ({title}) has no counterpart in the {into}; the official BPRD correspondence table lists no {code} equivalent for it.", **part), F.lpad(F.col("row").cast("string"), 12, "0"))
    fixed = facts.sparkSession.createDataFrame([("transition", "IPC", "1860", *TRANSITION, ["transition_general_03"], "")], kinds[0].schema)
    return reduce(DataFrame.unionByName, [*kinds, fixed])


def select_confusions(entries: DataFrame, quotas: dict[str, int] = CONFUSIONS, target: int = CONFUSION_TARGET) -> DataFrame:
    """Rows of each kind up to its quota, in their order; what lacks to the target is filled from the rest in hash order."""
    quota = F.element_at(F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair]), F.col("mapping_type"))
    ranked = entries.withColumn("r", F.row_number().over(Window.partitionBy("mapping_type").orderBy("order", "old_act", "old_section")))
    few = ranked.withColumn("first", F.col("r") <= quota)
    return few.orderBy(F.desc("first"), _hash(F.lit("rest"), "mapping_type", "old_act", "old_section")).limit(target).drop("r", "first", "order")


def negations(facts: DataFrame, mapping: DataFrame, titles: DataFrame, groups: DataFrame, held_out: DataFrame, quotas: dict[str, int] = NEGATIONS) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped): rows qa_type, instruction, output, source_chunk_id, grp; skipped: reason, n. groups: node, grp of
    the provisions that are linked; a provision without links is a group of its own; held_out: grp."""
    rows = facts.withColumns({"short": named(SHORT, F.col("old_act")), "new": named(SHORT, F.col("new_act")), "node": entity(F.col("old_act"), F.col("old_section"))})
    blocked = held_out.select("grp").distinct().withColumn("blocked", F.lit(True))

    def grouped(df: DataFrame) -> DataFrame:
        return df.join(groups, "node", "left").withColumn("grp", F.coalesce("grp", "node")).join(blocked, "grp", "left").withColumn("blocked", F.coalesce("blocked", F.lit(False)))

    rows = grouped(rows)
    part = {c: F.col(c) for c in ("short", "new", "title", "refs", "other")} | {"sec": F.col("old_section"), "code": F.col("new_act"), "full": named(FULL, F.col("old_act"))}
    alike = text.overlap(text.title_words(F.col("title")), text.title_words(F.col("other"))) > ALIKE
    reason = F.when(F.array_contains("news", F.col("old_section")), "collision: same number IS the counterpart").when(alike, "collision: titles too similar to call it different").when(F.col("blocked"), "collision: held-out group")
    clash = rows.where("other is not null").withColumn("reason", reason)
    tail = F.when(F.size("news") > 0, say(" The provision that now corresponds to {short} Section {sec} is {refs}.", **part)).otherwise(say(" {short} Section {sec} has no counterpart in the {code}.", **part))
    noun = F.when(F.col("old_act") == "IPC", "offence").otherwise("subject")
    asked = [say("Does {new} Section {sec} deal with the same subject as {short} Section {sec}?", **part), say("Is {short} Section {sec} the same provision as {new} Section {sec}?", **part), say("{short} Section {sec} and {new} Section {sec} - do they cover the same {noun}?", noun=noun, **part)]
    question = F.get(F.array(*asked), (chance(F.lit("variant"), "node") % 3).cast("int"))
    answer = F.concat(say("No. {short} Section {sec} was {title}, whereas {new} Section {sec} is a different provision entirely - {other}.", **part), tail)
    parts, skips = [], [clash.where("reason is not null").select("reason")]

    def emit(kind: str, df: DataFrame, questions: Column, said: Column) -> None:
        top = df.withColumn("h", _hash(F.lit(kind), "node")).orderBy("h", "node").limit(quotas[kind])
        parts.append(top.select(F.lit(kind).alias("qa_type"), F.explode(questions).alias("instruction"), said.alias("output"), F.col("node").alias("source_chunk_id"), "grp"))

    emit("collision", clash.where("reason is null"), F.array(question), answer)
    merged = rows.where((F.size("news") == 1) & (F.size("olds") > 1))
    skips.append(merged.where("blocked").select(F.lit("merged: held-out group").alias("reason")))
    subject = lower_first(F.regexp_replace("title", "^Punishment (?:for|of) ", ""))
    clause = subject.rlike("^(when|same|such|that|which|who|it) ")
    part["subject"] = subject
    part["olds"] = F.array_join(F.slice("olds", 1, MOST_LISTED), ", ")
    one = F.array(say("Is {subject} still dealt with under {short} Section {sec}?", **part))
    charged = F.array(say("Can a person still be charged under {short} Section {sec} for {subject}?", **part))
    questions = F.when(clause, F.array(say("Is the matter dealt with by {short} Section {sec} still governed by that section?", **part))).when(F.col("title").rlike("^Punishment (?:for|of) "), F.concat(one, charged)).otherwise(one)
    emit("merged", merged.where("not blocked"), questions, say("No. The {full} was repealed with effect from 1 July 2024. {short} Section {sec} ({title}) now corresponds to {refs}, which consolidates {short} Sections {olds} into a single provision.", **part))
    _, olds = relations(mapping)
    into = olds.where(F.size("olds") > 1).withColumns({"olds": natural(F.col("olds")), "node": entity(F.col("new_act"), F.col("new_section")), "old_act": named({b: a for a, b in NEW_OF.items()}, F.col("new_act"))})
    into = grouped(into)
    skips.append(into.where("blocked").select(F.lit("no_single: held-out group").alias("reason")))
    listed = _described(into, "olds", "old_act", titles, ["new_act", "new_section"], "listed", MOST_LISTED)
    own = titles.where("title <> ''").select(F.col("act").alias("new_act"), F.col("section").alias("new_section"), "title")
    into = into.where("not blocked").join(listed, ["new_act", "new_section"]).join(own, ["new_act", "new_section"])
    part = {"short": named(SHORT, F.col("old_act")), "new": named(SHORT, F.col("new_act")), "sec": F.col("new_section"), "title": F.col("title"), "listed": F.col("listed")}
    emit("no_single", into, F.array(say("Which single {short} section corresponds to {new} Section {sec}?", **part), say("Is there one {short} section that {new} Section {sec} replaced?", **part)), say("There is no single one. {new} Section {sec} ({title}) consolidates {listed}. Citing only one of them states the position incompletely.", **part))
    skipped = reduce(DataFrame.unionByName, skips).groupBy("reason").agg(F.count("*").alias("n"))
    return reduce(DataFrame.unionByName, parts), skipped


def grounding(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """rows (source_chunk_id, qa_type) with target: the chunk that grounds the answer, null where there is none."""
    ids = chunks.select(F.col("chunk_id").alias("c"))
    by_doc = chunks.select(F.concat(F.lit("case_"), F.regexp_extract("source_url", "/doc/([0-9]+)", 1)).alias("d"), F.col("chunk_id").alias("case_chunk")).where("d <> 'case_'")
    source, kind = F.col("source_chunk_id"), F.col("qa_type")
    keys = rows.select("source_chunk_id", "qa_type").distinct()  # far fewer than rows: these meet the chunks, not the texts
    first = F.when(kind == "scope", None).when(kind == "transition", "transition_commencement").when(kind == "offence_classification", F.concat(F.lit("schedule_"), source)).otherwise(source)
    second = F.when(kind == "offence_classification", source)
    met = keys.withColumns({"first__": first, "second__": second})
    met = met.join(ids.withColumnRenamed("c", "first__").withColumn("one__", F.lit(True)), "first__", "left").join(ids.withColumnRenamed("c", "second__").withColumn("two__", F.lit(True)), "second__", "left")
    met = met.join(by_doc, (source == F.col("d")) & ~kind.isin("scope", "transition"), "left")
    target = F.when(source.startswith("case_") & ~kind.isin("scope", "transition"), F.col("case_chunk")).when(F.col("one__"), F.col("first__")).when(F.col("two__"), F.col("second__"))
    met = met.select(source.alias("source__"), kind.alias("kind__"), target.alias("target")).where("target is not null")
    return rows.join(met, source.eqNullSafe(F.col("source__")) & kind.eqNullSafe(F.col("kind__")), "left").drop("source__", "kind__")


def dealt(ranked: DataFrame, total: int, seed: str) -> DataFrame:
    """ranked (qid, target, r from 1) with condition: the first seventy percent positive, the next twenty distractor, the
    rest none; a positive without a chunk to ground it is dealt again, two thirds of them distractors."""
    a, b = int(total * SHARE_HELPED), int(total * SHARE_MISLED)
    kind = F.when(F.col("r") <= a, "positive").when(F.col("r") <= a + b, "distractor").otherwise("none")
    again = F.when(chance(F.lit(seed), "qid") < SPARE_MISLED * 4294967296.0, "distractor").otherwise("none")
    return ranked.withColumn("condition", F.when((kind == "positive") & F.col("target").isNull(), again).otherwise(kind))


def context_rows(rows: DataFrame, chunks: DataFrame, others: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, context_type, ids, gold_in_context: rows (qid, question, output, target, condition) with the chunks of their
    context. A positive row has what would be served, and its own chunk at a place that its hash decides if that lacks;
    a distractor has no chunk of the provisions that its answer names, and becomes none where nothing is left."""
    few = hits.join(rows.where("condition = 'positive'").select("qid"), "qid", "left_semi").where(F.col("rank") < SERVED)
    all_ = hits.join(rows.where("condition = 'distractor'").select("qid"), "qid", "left_semi")
    served = answers.select_chunks(rows.where("condition <> 'none'").select("qid", "question"), chunks, others, few.unionByName(all_))
    keyed = chunks.select("chunk_id", refs.chunk_ref(F.col("chunk_id")).alias("ref")).where("ref is not null")
    wrong = rows.where("condition = 'distractor'")
    banned = wrong.select("qid", F.explode(refs.query_refs(F.coalesce("output", F.lit("")))).alias("ref")).join(keyed, "ref").select("qid", "chunk_id").unionByName(wrong.where("target is not null").select("qid", F.col("target").alias("chunk_id"))).distinct()
    served = served.join(banned, ["qid", "chunk_id"], "left_anti")
    listed = served.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "chunk_id"))), lambda x: x["chunk_id"]).alias("ids"))
    met = rows.join(listed, "qid", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    rest = F.array_remove("ids", F.col("target"))
    slot = (chance(F.lit("slot"), "qid") % (F.least(F.size(rest), F.lit(MOST_CHUNKS - 1)) + 1)).cast("int")
    put = F.concat(F.slice(rest, F.lit(1), slot), F.array("target"), F.slice(rest, slot + 1, F.greatest(F.size(rest), F.lit(1))))
    positive = F.col("condition") == "positive"
    ids = F.when(positive & ~F.array_contains(F.slice("ids", 1, MOST_CHUNKS), F.col("target")), put).otherwise(F.col("ids"))
    met = met.withColumn("ids", F.slice(ids, 1, MOST_CHUNKS))
    kind = F.when((F.col("condition") == "distractor") & (F.size("ids") == 0), "none").otherwise(F.col("condition"))
    return met.select("qid", kind.alias("context_type"), "ids", F.coalesce(F.array_contains("ids", F.col("target")), F.lit(False)).alias("gold_in_context"))
