"""What notices to investors announce.

Each notice is read in one pass: every rule is matched once, and only where the words stand that all its matches have; its
matches are laid out as an array in the row, with their places, dates and excerpts; duplicates and the fallbacks are settled
within the array, and one explode gives the events.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navella.functions.dates import date_after

#: After these a date is the day on which a change takes effect.
EFFECTIVE = r"(?i)\bw\.?\s?e\.?\s?f\b\.?|\bwith\s+effect\s+from\b|\beffective(?:\s+(?:from|date|on))?\b"
#: How much of the text before a match, and after it, is looked through for that date; what an excerpt takes before it.
BEFORE, LEAD = 200, 50

WORD = r"\p{Lu}[\p{L}.'’-]*"
#: Capitalised words in a row, with commas, "and" or "&" between.
NAMES = rf"({WORD}(?:(?:\s+|\s*,\s*|\s+(?:and|&)\s+){WORD}){{0,11}})"
AUXILIARY = "has|have|had|is|are|was|were|been|being|be|will|shall|hereby|also"
OFFICE = r"(?:(?:as|to|be|from|of|the|an?|its|role|position|office|additional|co|lead|key|dedicated|overseas)[\s-]+){0,8}fund\s+managers?\b"
#: (sub_type, pattern of which the first group names the managers): passive and active voice.
PEOPLE = (
    ("appointment", rf"{NAMES}\s+(?i:(?:(?:{AUXILIARY})\s+){{0,4}}appointed\s+{OFFICE})"),
    ("appointment", rf"(?i:\bappoint(?:ed|s|ing|ment\s+of))\s+{NAMES}\s+(?i:{OFFICE})"),
    ("cessation", rf"{NAMES}\s+(?i:(?:(?:{AUXILIARY})\s+){{0,3}}(?:cease[sd]?|resign(?:s|ed)?|step(?:s|ped)?\s+down|relinquish(?:es|ed)?)\s+(?:{OFFICE}|to\s+manage\b|managing\b))"),
    ("cessation", rf"(?i:\b(?:resignation|cessation)\s+of)\s+{NAMES}\s+(?i:{OFFICE})"),
)


def near(topics: str, changes: str, reach: int = 60) -> str:
    """A pattern of a topic and a word of change in one sentence, in either order, at most so many characters apart."""
    topic, change, gap = rf"\b(?:{topics})\b", rf"\b(?:{changes})\b", rf"[^.;]{{0,{reach}}}?"
    return rf"(?is)({change}{gap}{topic}|{topic}{gap}{change})"


CHANGE = "changes?|changed|changing|revision|revised?|modification|modified|replacement|replaced?|substituted?"
RATE_CHANGE = CHANGE + "|increased?|decreased?|reduced?|reduction"
#: (event, pattern, how far after the match its date may stand, characters of the excerpt after it); the first match counts.
SUBJECTS = (
    ("benchmark_change", near(r"benchmark(?:\s+index)?", CHANGE), 400, 300),
    ("ter_change", near(r"(?:total\s+)?expense\s+ratio|TER", RATE_CHANGE), 300, 300),
    ("category_change", r"(?is)(\bre-?\s?categori[sz]\w+|\bmergers?\s+of\s+(?:the\s+)?schemes?\b|\bchanges?\s+(?:in|of)\s+(?:the\s+)?(?:scheme(?:'s|’s)?\s+)?(?:category|type|mandate|investment\s+objective)\b|\bscheme\s+(?:will|shall|is)\s+(?:be\s+)?(?:being\s+)?merged\b)", 300, 300),
    ("mandate_revision", near(r"investment\s+objective|asset\s+allocation|investment\s+strategy", CHANGE), 300, 400),
    ("addendum", near(r"(?:fresh\s+)?(?:subscriptions?|purchases?|redemptions?)", "suspension|suspended|suspends?|closure|closed|halt(?:ed|s)?", 40), 300, 300),
)
GENERAL = near(r"fund\s+managers?", "changes?|changed|replacement|replaced", 40)


#: Words of which each match of a rule has one of every row, in lower case (those of PEOPLE, SUBJECTS and GENERAL in their
#: order): a rule is tried only on texts that have them.
PEOPLE_WORDS = ((("appointed",), ("manager",)), (("appoint",), ("manager",)), (("ceas", "resign", "step", "relinquish"), ("manag",)), (("resignation", "cessation"), ("manager",)))
SUBJECT_WORDS = ((("benchmark",),), (("expense", "ter"),), (("categori", "merge", "change"),), (("objective", "allocation", "strategy"),), (("subscription", "purchase", "redemption"),))
GENERAL_WORDS = (("manager",),)


def has_words(low: Column, words: tuple[tuple[str, ...], ...]) -> Column:
    """Whether a lower-cased text has one word of every row. Short ones must stand alone."""
    has = lambda w: low.rlike(rf"\b{w}\b") if len(w) < 4 else low.contains(w)
    return reduce(and_, (reduce(or_, map(has, row)) for row in words))


def located(text: Column, hits: Column) -> Column:
    """Each hit, in the order of the text, as (hit, place): where it begins."""
    begin = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("places"))

    def fold(a: Column, hit: Column) -> Column:
        place = F.position(hit, text, a["at"])
        return F.struct((place + F.length(hit)).alias("at"), F.array_append(a["places"], place).alias("places"))

    return F.arrays_zip(hits.alias("hit"), F.aggregate(hits, begin, fold, lambda a: a["places"]).alias("place"))


def people(names: Column) -> Column:
    """The persons of a list of names, without titles, words of the sentence before them and auxiliaries after them; whoever
    has one word only must have had a title."""

    def person(piece: Column) -> Column:
        own = F.regexp_replace(piece, r"^.*\p{Ll}{3,}\.\s+", "")  # a sentence that ended before the name
        own = F.regexp_replace(own, rf"(?i)\s+(?:{AUXILIARY})\b.*$", "")
        titled = own.rlike(r"(?i)\b(?:mr|ms|mrs|dr|shri|smt)\b\.?\s")
        own = F.trim(F.regexp_replace(own, r"(?i)^.*\b(?:mr|ms|mrs|dr|shri|smt)\b\.?\s+", ""))
        return F.when(titled | own.contains(" "), own)

    return F.filter(F.transform(F.split(F.regexp_replace(names, r"\s+", " "), r"\s*,\s*|\s+(?:and|&)\s+"), person), lambda p: p.isNotNull() & (p != ""))


def stated(text: Column, label: str) -> Column:
    """What stands behind a label and a colon, or "to" or "from" and a benchmark's change: up to the line's or sentence's end,
    another label, or words on when."""
    rest = F.regexp_extract(text, rf"(?is)\b(?:{label})\s*(?::|is\b|-)?\s*([^\n.;:]{{3,80}})", 1)
    return F.nullif(F.trim(F.regexp_replace(rest, r"(?is)\s+(?:(?:will|shall|is|has|to|with|and|effective|w\.?e\.?f|from|existing|revised|new)\b).*$|\s*,\s*$", "")), F.lit(""))


def notice_signals(notices: DataFrame) -> DataFrame:
    """The events that notices (doc_id, doc_date, text) announce: event (manager_change, benchmark_change, ter_change,
    category_change, mandate_revision, addendum), sub_type (appointment, cessation, change; null otherwise), before, after,
    effective_date, excerpt and confidence, always official. Every manager who is appointed (after) or leaves (before)
    counts; a change of managers without either is one of sub_type change. A halt's after tells its type. A date counts
    only behind w.e.f. and the like, near the match; else the document's is taken. Same events of a document on the same
    day count once. A notice without any gives a plain addendum."""
    text = F.col("text")
    none = F.lit(None).cast("string")

    def event(kind, sub_type, before: Column, after: Column, m: Column, reach: int, window: int) -> Column:
        start = F.greatest(m["place"] - BEFORE, F.lit(1))
        day = date_after(text.substr(start, m["place"] - start + F.length(m["hit"]) + reach), EFFECTIVE)
        first = F.greatest(m["place"] - LEAD, F.lit(1))
        excerpt = F.trim(F.translate(text.substr(first, m["place"] - first + F.length(m["hit"]) + window), "\n", " "))
        sub = none if sub_type is None else F.lit(sub_type)
        return F.struct(F.lit(kind).alias("event"), sub.alias("sub_type"), before.alias("before"), after.alias("after"), F.coalesce(day, F.col("doc_date")).alias("effective_date"), excerpt.alias("excerpt"))

    def of_people(sub_type: str, pattern: str) -> Column:
        def each(m: Column) -> Column:
            pick = lambda p: event("manager_change", sub_type, none if sub_type == "appointment" else p, p if sub_type == "appointment" else none, m, 200, 200)
            # a hit by itself is matched as it was in its text
            return F.transform(people(F.regexp_extract(m["hit"], pattern, 1)), pick)

        return F.flatten(F.transform(located(text, F.col(f"people{PEOPLE.index((sub_type, pattern))}")), each))

    def of_subject(kind: str, pattern: str, reach: int, window: int) -> Column:
        def each(m: Column) -> Column:
            rest = text.substr(m["place"], F.length(m["hit"]) + 300)
            before = after = none
            if kind == "benchmark_change":
                whole = text.substr(m["place"], F.length(text))
                before = F.coalesce(stated(whole, r"existing\s+benchmark"), stated(rest, r"(?:changed?|replaced?|revised?|change\s+of\s+benchmark)\s+from"))
                after = F.coalesce(stated(whole, r"(?:revised?|new|proposed|changed\s+to)\s+benchmark"), stated(rest, r"(?:changed?|replaced?|revised?)\s+(?:from\s+[^.;\n]{3,80}?\s+)?(?:to|by|with)"))
            elif kind == "ter_change":
                rates = F.regexp_extract_all(rest, F.lit(r"(\d+\.\d+)\s*%"), 1)
                before, after = (F.concat(F.get(rates, F.lit(k)), F.lit("%")) for k in (0, 1))
            elif kind == "addendum":
                after = F.when(F.lower(m["hit"]).contains("subscription"), "subscription_suspension").otherwise("redemption_suspension")
            return event(kind, None, before, after, m, reach, window)

        return F.transform(located(text, F.col(kind)), each)

    low, none_hit = F.col("low"), F.array().cast("array<string>")
    every = {f"people{k}": F.when(has_words(low, w), F.regexp_extract_all(text, F.lit(p), 0)).otherwise(none_hit) for k, ((_, p), w) in enumerate(zip(PEOPLE, PEOPLE_WORDS, strict=True))}
    rules = [(*(r[:2]), w) for r, w in zip(SUBJECTS, SUBJECT_WORDS, strict=True)] + [("any_change", GENERAL, GENERAL_WORDS)]
    first = {k: F.filter(F.array(F.when(has_words(low, w), F.regexp_extract(text, p, 0))), lambda h: h != "") for k, p, w in rules}
    named = F.concat(*(of_people(*rule) for rule in PEOPLE))
    general = F.transform(located(text, F.col("any_change")), lambda m: event("manager_change", "change", none, none, m, 200, 200))
    rows = notices.select("doc_id", "doc_date", F.coalesce("text", F.lit("")).alias("text")).withColumn("low", F.lower("text")).withColumns({**every, **first})
    rows = rows.withColumns({"named": named, "others": F.concat(*(of_subject(*rule) for rule in SUBJECTS)), "general": general})
    plain = F.array(F.struct(F.lit("addendum").alias("event"), none.alias("sub_type"), none.alias("before"), none.alias("after"), F.col("doc_date").alias("effective_date"), F.trim(F.translate(F.substring("text", 1, 300), "\n", " ")).alias("excerpt")))
    events = F.concat(F.when(F.size("named") > 0, F.col("named")).otherwise(F.col("general")), F.col("others"))
    rows = rows.select("doc_id", F.when(F.size(events) > 0, events).otherwise(plain).alias("events"))
    key = lambda e: F.concat_ws("\x1f", e["event"], F.coalesce(e["sub_type"], F.lit("")), e["effective_date"].cast("string"), F.coalesce(e["after"], F.lit("\x1e")), F.coalesce(e["before"], F.lit("\x1e")))
    keys = F.transform("events", key)
    rows = rows.withColumn("keys", keys)
    once = F.filter("events", lambda e, i: F.array_position("keys", key(e)) == i + 1)
    return rows.select("doc_id", F.inline(once)).withColumn("confidence", F.lit("official"))
