"""Question and answer rows from templates: families of phrasings over sections, concordance, schedule and cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.functions.refs import NEW_OF
from sparkloom.operators.chunks import FULL, NEW, SHORT, base_section, entity, named

#: Letters of an answer, of a held text, references listed, new sections of a case.
MOST_LETTERS, MOST_HELD, MOST_REFS, MOST_NEW = 1000, 600, 5, 3
#: Fixed format: the penalty in a section's text.
PUNISHED = r"(?i)shall be punished with ([^.;:]{10,220})"
OLD_OF = {new: old for old, new in NEW_OF.items()}

#: Days and the law that holds on them.
DAYS = [("2 March 2019", "old"), ("14 August 2021", "old"), ("30 June 2024", "old"), ("1 July 2024", "new"), ("2 July 2024", "new"), ("15 August 2024", "new"), ("9 January 2025", "new"), ("28 February 2023", "old"), ("31 December 2024", "new"), ("1 January 2020", "old"), ("20 November 2025", "new"), ("5 May 2022", "old")]
COMMENCED = "2024-07-01"
CODES = [("IPC", "BNS"), ("CrPC", "BNSS"), ("Indian Evidence Act", "BSA")]
#: General questions on the transition.
GENERAL = [
    ("When did the BNS, BNSS and BSA come into force?", "All three came into force on 1 July 2024. The Bharatiya Nyaya Sanhita, 2023 replaced the Indian Penal Code, 1860; the Bharatiya Nagarik Suraksha Sanhita, 2023 replaced the Code of Criminal Procedure, 1973; and the Bharatiya Sakshya Adhiniyam, 2023 replaced the Indian Evidence Act, 1872."),
    ("How many sections are there in the BNS, BNSS and BSA?", "The Bharatiya Nyaya Sanhita, 2023 has 358 sections, the Bharatiya Nagarik Suraksha Sanhita, 2023 has 531 sections, and the Bharatiya Sakshya Adhiniyam, 2023 has 170 sections."),
    ("An FIR was registered in March 2024 and the trial is continuing now. Which code governs it?", "A matter registered before 1 July 2024 continues under the old codes. The date of the offence and of registration governs, not the date of the trial, so the IPC and CrPC continue to apply to that case."),
    ("Which act replaced the Indian Penal Code?", "The Bharatiya Nyaya Sanhita, 2023 (Act 45 of 2023) replaced the Indian Penal Code, 1860, with effect from 1 July 2024."),
    ("Which act replaced the Code of Criminal Procedure?", "The Bharatiya Nagarik Suraksha Sanhita, 2023 (Act 46 of 2023) replaced the Code of Criminal Procedure, 1973, with effect from 1 July 2024."),
    ("Which act replaced the Indian Evidence Act?", "The Bharatiya Sakshya Adhiniyam, 2023 (Act 47 of 2023) replaced the Indian Evidence Act, 1872, with effect from 1 July 2024."),
]
#: Questions outside the scope and their answers.
DISCLAIMER = "This is general information about the law, not legal advice. For advice on a specific matter, consult a qualified advocate."
SCOPE = [
    ("Can you be my lawyer and represent me in court?", "No. I am an informational tool, not a licensed advocate, and I cannot represent anyone or act as counsel. I can point you to what a provision of the BNS, BNSS or BSA says and to reported decisions on it. " + DISCLAIMER),
    ("How can I avoid being convicted under BNS Section 318 for cheating?", "I can't help with avoiding liability for an offence. What I can do is set out what BNS Section 318 provides and what courts have said about its ingredients, so you understand the provision. " + DISCLAIMER),
    ("Tell me a loophole in BNS Section 103 so my friend gets off.", "I won't suggest ways to evade liability. I can explain what BNS Section 103 (punishment for murder) provides and which IPC provision it replaced. " + DISCLAIMER),
    ("Should I plead guilty to the charge against me?", "That is a decision that needs advice from an advocate who knows the facts of your case; I can't advise on it. I can explain the provisions and procedure involved. " + DISCLAIMER),
    ("What will my sentence be if I am convicted under BNS 105?", "I can't predict the sentence in any particular case - that depends on the facts and the court's discretion. I can tell you the punishment the section itself prescribes. " + DISCLAIMER),
    ("Draft a false alibi I can give to the police.", "No. Fabricating an alibi or misleading an investigation is itself an offence. I can explain what the law provides on a topic, nothing more. " + DISCLAIMER),
    ("Are you a substitute for consulting an advocate?", "No. I provide general information about Indian criminal law and cite the source for it. I do not give legal advice and I am not a substitute for a qualified advocate. " + DISCLAIMER),
    ("Give me legal advice on my ongoing criminal case.", "I can't advise on a specific case. I can describe what the relevant sections of the BNS, BNSS or BSA say, how they map to the old IPC, CrPC and Evidence Act provisions, and what reported decisions have held. " + DISCLAIMER),
    ("Is it okay to bribe an investigating officer to close a case?", "No, and I won't help with that. Bribery of a public servant is an offence, and so is causing disappearance of evidence. I can explain the relevant provisions if that is useful. " + DISCLAIMER),
    ("What are your limitations?", "I answer questions about Indian criminal law using the text of the BNS, BNSS and BSA, their correspondence with the IPC, CrPC and Indian Evidence Act, and summaries of reported decisions. I do not give legal advice, I cannot represent anyone, and my coverage of case law is limited. " + DISCLAIMER),
]
#: The same of any section: question, answer before the disclaimer.
SCOPE_SECTIONS = [
    ("How can I avoid being convicted under BNS Section {sec} for {subject}?", "I can't help with avoiding liability for an offence. What I can do is set out what BNS Section {sec} provides and what courts have said about its ingredients, so you understand the provision. "),
    ("Tell me a loophole in BNS Section {sec} so my friend gets off.", "I won't suggest ways to evade liability. I can explain what BNS Section {sec} ({subject}) provides and which IPC provision it replaced. "),
    ("What will my sentence be if I am convicted under BNS {sec}?", "I can't predict the sentence in any particular case - that depends on the facts and the court's discretion. I can tell you the punishment the section itself prescribes. "),
]


def say(template: str, **parts: Column) -> Column:
    """A template such as 'Section {section} of {act}.' with Columns in its places."""
    out, rest = [], template
    while "{" in rest:
        head, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        out += [F.lit(head), parts[name].cast("string")]
    return F.concat(*out, F.lit(rest))


def family(df: DataFrame, kind: str, key: Column, group: Column, phrasings: list[Column], take: int, answer: Column, seed: str = "7") -> DataFrame:
    """instruction, output, qa_type, source_chunk_id, seq: ``take`` of the phrasings of each row, chosen by a hash of the
    row's key inside the row, so that nothing is shuffled."""
    ranked = F.sort_array(F.transform(F.array(*phrasings), lambda q, i: F.struct(F.md5(F.concat(F.lit(seed), key, F.lit(":"), (i + 1).cast("string"))).alias("h"), (i + 1).alias("i"), q.alias("q"))))
    # the answer is made before its row is repeated for each phrasing
    rows = df.select(F.slice(ranked, 1, take).alias("xs"), answer.alias("output"), group.alias("source_chunk_id"), key.alias("k")).select(F.explode("xs").alias("x"), "output", "source_chunk_id", "k")
    return rows.select(F.col("x.q").alias("instruction"), "output", F.lit(kind).alias("qa_type"), "source_chunk_id", F.concat_ws(":", "k", "x.i").alias("seq"))


def lower_first(c: Column) -> Column:
    return F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def strip_leading_number(c: Column, section: Column) -> Column:
    """A section's text without its own 'N.' in front."""
    prefix = F.concat(section, F.lit("."))
    return text.strip(F.when(F.startswith(c, prefix), F.substring(c, F.length(prefix) + 1, F.length(c))).otherwise(c))


def _bracketed(title: Column) -> Column:
    return F.when(title != "", F.concat(F.lit(" ("), title, F.lit(")"))).otherwise("")


def section_text(sections: DataFrame) -> DataFrame:
    act, sec = F.col("act"), F.col("section")
    full, short = named(FULL, act), named(SHORT, act)
    rows = sections.withColumn("body", strip_leading_number(F.col("text"), sec)).where("length(body) >= 40")
    body = text.shorten(text.clean_text(F.col("body")), MOST_LETTERS)
    answer = F.concat(F.when(F.col("title") != "", say("{short} Section {sec} ({title}). ", short=short, sec=sec, title=F.col("title"))).otherwise(""), body)
    asked = ["What does {short} Section {sec} cover?", "What does Section {sec} of the {full} say?", "Explain {short} Section {sec}.", "State the text of Section {sec} of the {short}.", "Under the {full}, what is provided by Section {sec}?"]
    group = entity(act, sec)
    return family(rows, "section_text", group, group, [say(q, short=short, full=full, sec=sec) for q in asked], 2, answer)


def section_lookup(sections: DataFrame) -> DataFrame:
    act, sec, title = F.col("act"), F.col("section"), text.strip(F.col("title"))
    full, short = named(FULL, act), named(SHORT, act)
    asked = ["Which section of the {short} deals with {subject}?", "Under which section of the {full} does {subject} fall?", "Where in the {short} is {subject} dealt with?"]
    group = entity(act, sec)
    rows = sections.where(F.length(title) >= 6)
    return family(rows, "section_lookup", group, group, [say(q, short=short, full=full, subject=lower_first(title)) for q in asked], 1, say("Section {sec} of the {full} ({title}).", sec=sec, full=full, title=title))


def punishment(sections: DataFrame) -> DataFrame:
    act, sec = F.col("act"), F.col("section")
    full, short = named(FULL, act), named(SHORT, act)
    rows = sections.where(act.isin(*NEW, "IPC")).withColumn("found", F.regexp_extract("text", PUNISHED, 1)).where("found <> ''")
    penalty = F.regexp_replace(text.clean_text(F.col("found")), ",+$", "")
    answer = say("Under {short} Section {sec}{title}, the offender shall be punished with {penalty}.", short=short, sec=sec, title=_bracketed(F.col("title")), penalty=penalty)
    asked = ["What is the punishment under {short} Section {sec}?", "What penalty does Section {sec} of the {full} prescribe?", "How is an offence under {short} Section {sec} punished?"]
    group = entity(act, sec)
    return family(rows, "punishment", group, group, [say(q, short=short, full=full, sec=sec) for q in asked], 2, answer)


def _listed(mapping: DataFrame, side: str, other: str) -> DataFrame:
    """act, section of one side with the other side's act and its first references as a text."""
    both = mapping.where("old_section is not null and new_section is not null")
    group = both.groupBy(F.col(f"{side}_act").alias("act"), F.col(f"{side}_section").alias("section"))
    each = F.struct("row", F.col(f"{other}_act").alias("a"), F.concat(F.lit("Section "), f"{other}_section", _bracketed(F.col(f"{other}_title"))).alias("ref"))
    rows = group.agg(F.array_sort(F.collect_list(each)).alias("x"))
    return rows.select("act", "section", F.col("x")[0]["a"].alias("other"), F.array_join(F.transform(F.slice("x", 1, MOST_REFS), lambda x: x["ref"]), ", ").alias("refs"))


def old_to_new(mapping: DataFrame) -> DataFrame:
    act, sec, other = F.col("act"), F.col("section"), F.col("other")
    so, sn = named(SHORT, act), named(SHORT, other)
    answer = say("{so} Section {sec} corresponds to {sn} {refs}. The {new} replaced the {old} with effect from 1 July 2024.", so=so, sec=sec, sn=sn, refs=F.col("refs"), new=named(FULL, other), old=named(FULL, act))
    asked = ["Which {sn} section replaced {so} Section {sec}?", "{so} {sec} corresponds to which section of the new law?", "What is the new section for {so} Section {sec}?", "Under the new criminal codes, what has {so} {sec} become?"]
    group = entity(act, sec)
    return family(_listed(mapping, "old", "new"), "old_to_new", group, group, [say(q, so=so, sn=sn, sec=sec) for q in asked], 2, answer)


def new_to_old(mapping: DataFrame) -> DataFrame:
    act, sec, other = F.col("act"), F.col("section"), F.col("other")
    sn, so = named(SHORT, act), named(SHORT, other)
    answer = say("{sn} Section {sec} corresponds to {so} {refs}. The {so} was repealed with effect from 1 July 2024.", so=so, sec=sec, sn=sn, refs=F.col("refs"))
    asked = ["Which {so} section corresponds to {sn} Section {sec}?", "What was {sn} {sec} before 1 July 2024?", "{sn} Section {sec} replaced which provision of the old law?"]
    group = entity(act, sec)
    return family(_listed(mapping, "new", "old"), "new_to_old", group, group, [say(q, so=so, sn=sn, sec=sec) for q in asked], 2, answer)


def new_provision(mapping: DataFrame) -> DataFrame:
    act, sec, title = F.col("new_act"), F.col("new_section"), F.col("new_title")
    short, full, old = named(SHORT, act), named(FULL, act), named({a: FULL[b] for a, b in OLD_OF.items()}, act)
    answer = say("Yes. {short} Section {sec} ({title}) is a new provision introduced by the {full}; it has no equivalent in the {old}.", short=short, sec=sec, title=title, full=full, old=old)
    asked = ["Is {short} Section {sec} a new provision?", "Did the old law have an equivalent of {short} Section {sec}?", "Is {title} a new offence under the {short}?"]
    group = entity(act, sec)
    return family(mapping.where("mapping_type = 'new_provision' and new_title <> ''"), "new_provision", group, group, [say(q, short=short, sec=sec, title=F.lower(title)) for q in asked], 2, answer)


def removed(mapping: DataFrame) -> DataFrame:
    act, sec, title = F.col("old_act"), F.col("old_section"), F.col("old_title")
    short, new, full = named(SHORT, act), named(NEW_OF, act), named({a: FULL[b] for a, b in NEW_OF.items()}, act)
    answer = say("{short} Section {sec} ({title}) has no corresponding provision in the {full}. The official correspondence table published by the Bureau of Police Research and Development lists no {new} counterpart for it.", short=short, sec=sec, title=title, full=full, new=new)
    asked = ["Does {short} Section {sec} have an equivalent in the {new}?", "What replaced {short} Section {sec} in the new code?", "Is {short} {sec} carried forward into the {new}?"]
    group = entity(act, sec)
    return family(mapping.where("mapping_type = 'removed' and old_title <> ''"), "removed", group, group, [say(q, short=short, sec=sec, new=new) for q in asked], 2, answer)


def transition(df: DataFrame) -> DataFrame:
    """The fixed days by codes, and the general questions; df gives the session."""
    days = df.sparkSession.createDataFrame(DAYS, "day string, law string")
    return transition_days(days).unionByName(_fixed(df, "transition", "transition_general", GENERAL))


def days_of(dates: DataFrame, date: str) -> DataFrame:
    """day (as it is written), law of every date that occurs."""
    known = dates.select(F.to_date(date).alias("d")).where("d is not null").distinct()
    return known.select(F.date_format("d", "d MMMM yyyy").alias("day"), F.when(F.col("d") >= F.lit(COMMENCED).cast("date"), "new").otherwise("old").alias("law"))


def transition_days(days: DataFrame) -> DataFrame:
    """Which code applies on each of the days (day, law)."""
    codes = F.inline(F.array(*(F.struct(F.lit(a).alias("old"), F.lit(b).alias("new"), F.lit(FULL[b]).alias("full")) for a, b in CODES)))
    rows = days.select("day", "law", codes)
    part = {"day": F.col("day"), "old": F.col("old"), "new": F.col("new"), "full": F.col("full")}
    answer = F.when(F.col("law") == "new", say("The {new} applies. The {full} came into force on 1 July 2024, so an offence committed on {day} is dealt with under the {new} and not the {old}.", **part)).otherwise(say("The {old} applies. The new codes came into force only on 1 July 2024, so a matter arising on {day} continues under the {old}.", **part))
    asked = ["An offence was committed on {day}. Does the {old} or the {new} apply?", "For an incident on {day}, should a case be registered under the {old} or the {new}?", "Which applies to conduct on {day} - the {old} or the {new}?"]
    group = F.concat_ws("_", F.lit("transition"), F.replace("day", F.lit(" "), F.lit("-")), F.lower("new"))
    return family(rows, "transition", group, group, [say(q, **part) for q in asked], 2, answer)


def _fixed(df: DataFrame, kind: str, group: str, rows: list[tuple[str, str]]) -> DataFrame:
    table = [(q, a, kind, f"{group}_{i:02d}", f"{group}_{i:02d}") for i, (q, a) in enumerate(rows, 1)]
    return df.sparkSession.createDataFrame(table, "instruction string, output string, qa_type string, source_chunk_id string, seq string")


def scope(df: DataFrame) -> DataFrame:
    return _fixed(df, "scope", "scope", SCOPE)


def scope_sections(sections: DataFrame) -> DataFrame:
    """Questions outside the scope on every titled section (section, title) of the BNS, and their refusals."""
    rows = sections.where(F.length("title") >= 6)
    part = {"sec": F.col("section"), "subject": lower_first(F.col("title"))}
    group = F.concat(F.lit("bns_"), F.lower("section"))
    return reduce(DataFrame.unionByName, (family(rows, "scope", F.concat(F.lit(f"scope{i}:"), group), group, [say(q, **part)], 1, say(a + DISCLAIMER, **part)) for i, (q, a) in enumerate(SCOPE_SECTIONS)))


def case_law(cases: DataFrame) -> DataFrame:
    """cases with new_sections; rows of one judgment share a group."""
    doc = F.regexp_extract("source_url", "/doc/([0-9]+)", 1)
    group = F.concat(F.lit("case_"), F.when(doc != "", doc).otherwise(F.lpad(F.col("row").cast("string"), 3, "0")))
    secs = F.array_join(F.transform("old_sections", lambda s: F.concat(named(SHORT, F.col("old_act")), F.lit(" "), s)), ", ")
    new = F.array_join(F.slice("new_sections", 1, MOST_NEW), ", ")
    part = {"name": F.col("case_name"), "court": F.col("court"), "year": F.col("year"), "secs": secs, "topic": F.lower("topic"), "url": F.col("source_url"), "held": text.shorten(text.clean_text(F.col("holding_summary")), MOST_HELD)}
    part["now"] = F.when(new != "", F.concat(F.lit(" (now "), new, F.lit(")"))).otherwise("")
    part["then"] = F.when(new != "", F.concat(F.lit(", now "), new)).otherwise("")
    answer = say("In {name} ({court}, {year}), on {secs}{now}, the court stated: {held} Source: {url}", **part)
    asked = ["What did the court hold in {name}?", "Summarise the decision in {name}.", "What is the significance of {name} for {topic}?"]
    key = F.concat(F.lit("case:"), F.col("row").cast("string"))
    two = family(cases, "case_law", key, group, [say(q, **part) for q in asked], 2, answer)
    one = family(cases, "case_law", F.concat(key, F.lit(":name")), group, [say("Name a reported case on {topic} under {secs}.", **part)], 1, say("{name} ({court}, {year}) concerns {topic} under {secs}{then}. Source: {url}", **part))
    return two.unionByName(one)


def described(entries: Column, field: str) -> Column:
    """The one value of a field, or each entry's with its description."""
    values = F.array_distinct(F.transform(entries, lambda e: e[field]))
    each = F.transform(entries, lambda e: F.concat(F.regexp_replace(e["offence_description"], r"\.+$", ""), F.lit(" - "), e[field]))
    return F.when(F.size(values) == 1, values[0]).otherwise(F.array_join(each, "; "))


def offence_classification(schedule: DataFrame, titles: DataFrame) -> DataFrame:
    """Three questions on one field each and one on all, for every section of the schedule's first part."""
    fields = ["offence_description", "cognizable", "bailable", "triable_by"]
    first = schedule.where("part = 'I'").withColumn("section", base_section(F.col("section_ref"))).where("section <> ''")
    rows = first.groupBy("section").agg(F.array_sort(F.collect_list(F.struct("row", *fields))).alias("e")).join(titles.select("section", "title"), "section", "left")
    rows = rows.withColumn("title", F.coalesce("title", F.lit("")))
    rows = rows.withColumns({"cog": described(F.col("e"), "cognizable"), "bail": described(F.col("e"), "bailable"), "court": described(F.col("e"), "triable_by")})
    title, sec = F.col("title"), F.col("section")
    subject = F.when(title != "", lower_first(title)).otherwise(F.lower(F.regexp_replace(F.col("e")[0]["offence_description"], r"\.+$", "")))
    part = {"sec": sec, "subject": subject, "named": F.concat(F.lit("BNS Section "), sec, _bracketed(title)), "cog": F.col("cog"), "bail": F.col("bail"), "court": F.col("court")}
    group = F.concat(F.lit("bns_"), F.lower("section"))
    asked = {
        "cog": (["Is an offence under BNS Section {sec} cognizable?", "Is {subject} under the BNS a cognizable offence?", "Under the BNSS First Schedule, is BNS Section {sec} cognizable or non-cognizable?"], "Under the First Schedule to the BNSS, an offence under {named} is: {cog}."),
        "bail": (["Is an offence under BNS Section {sec} bailable?", "Is {subject} under the BNS bailable or non-bailable?", "Can a person accused under BNS Section {sec} get bail as of right?"], "Under the First Schedule to the BNSS, an offence under {named} is: {bail}."),
        "court": (["Which court tries an offence under BNS Section {sec}?", "Which court has jurisdiction to try {subject} under the BNS?", "Before which court is an offence under BNS Section {sec} triable?"], "Under the First Schedule to the BNSS, an offence under {named} is triable by: {court}."),
    }
    parts = [family(rows, "offence_classification", F.concat(F.lit(f"{f}:"), group), group, [say(q, **part) for q in qs], 1, say(a, **part)) for f, (qs, a) in asked.items()]
    one = lambda f: F.size(F.array_distinct(F.transform("e", lambda e: e[f]))) == 1
    same = rows.where(one("cognizable") & one("bailable"))
    parts.append(family(same, "offence_classification", F.concat(F.lit("all:"), group), group, [say("How is the offence under BNS Section {sec} classified under the BNSS First Schedule?", **part)], 1, say("An offence under {named} is {cog}, {bail}, and triable by {court}.", **part)))
    return reduce(DataFrame.unionByName, parts)


def deduplicated(families: list[DataFrame]) -> DataFrame:
    """All families, cleaned; of the rows with one normalised question the first family's first row stays."""
    ranked = [f.withColumn("family", F.lit(i)) for i, f in enumerate(families)]
    rows = reduce(DataFrame.unionByName, ranked).withColumns({"instruction": text.clean_text(F.col("instruction")), "output": text.clean_text(F.col("output"))})
    rows = rows.withColumn("key", text.dedup_key(F.col("instruction")))
    # empty rows go inside the aggregate: a filter would be pushed into every family and repeat its templates
    whole = (F.col("instruction") != "") & (F.col("output") != "")
    kept = rows.groupBy("key").agg(F.min(F.when(whole, F.struct("family", "seq", "instruction", "output", "qa_type", "source_chunk_id"))).alias("x"))
    return kept.where("x is not null").select("x.*")
