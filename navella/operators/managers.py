"""Fund managers: who a page names, who is in office, since when, and what changed between documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from navella.functions.dates import MONTHS, date_after, leading_date

#: Words that look like a name's but are heads or captions.
NO_NAME = (
    "name", "since", "total", "exp", "over", "years", "fund", "manager", "managers", "scheme", "schemes", "date", "details",
    "experience", "managing", "overseas", "investment", "investments", "equity", "debt", "dedicated", "portion", "securities",
    "head", "research", "chief", "officer", "as", "on", "of",
)
TITLE = r"\b(?:Mr|Ms|Mrs|Dr)\b\.?[ \t]+"
#: A word of a name: capitalised, with apostrophes and hyphens, or an initial.
PART = r"(?:\p{Lu}[\p{L}'’-]+|\p{Lu}\.)"
SINCE = r"(?i)managing\s+(?:this\s+fund\s+)?since|\(\s*since|\bw\.?e\.?f\b\.?"
#: Characters after a name in which its start may stand; of a block under a heading of managers; of a label's line.
REACH, BLOCK, LINE = 300, 700, 240
MOST = 100


def leading_name(text: Column) -> Column:
    """Up to four parts of a name at a text's beginning; null without."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"^\s*({PART}(?:[ \t]+{PART}){{0,3}})", 1)), F.lit(""))


def trailing_name(text: Column) -> Column:
    """Up to six parts of a name or a head at a text's end; null without."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"({PART}(?:\s+{PART}){{0,5}})\s*$", 1)), F.lit(""))


def start_of(text: Column) -> Column:
    """What a start says: the inception (told apart from a date), or a date."""
    inception = text.rlike(r"(?i)^[\s:,-]*(?:since\s+)?inception")
    return F.struct(inception.alias("inception"), leading_date(text).alias("since"))


def parts_after(text: Column, cue: str) -> Column:
    """The texts behind each match of a cue, up to the next."""
    return F.slice(F.split(text, cue), 2, MOST)


def entry(name: Column, start: Column) -> Column:
    return F.struct(name.alias("name"), start["inception"].alias("inception"), start["since"].alias("since"))


def _none() -> Column:
    """A start that isn't stated."""
    return F.struct(F.lit(False).alias("inception"), F.lit(None).cast("date").alias("since"))


def titled(text: Column) -> Column:
    """Names behind a title that have a start of their own before the next title."""

    def each(part: Column) -> Column:
        near = F.substring(part, 1, REACH)
        start = F.get(F.filter(F.transform(parts_after(near, SINCE), start_of), lambda s: s["inception"] | s["since"].isNotNull()), F.lit(0))
        return F.when(start.isNotNull(), entry(leading_name(part), start))

    return F.transform(parts_after(text, TITLE), each)


def in_parentheses(text: Column) -> Column:
    """Names right before a parenthesis that says since when."""
    pieces = F.split(text, r"(?i)\(\s*managing\s+(?:this\s+fund\s+)?since\b")
    pairs = F.arrays_zip(F.slice(pieces, 1, MOST).alias("before"), F.slice(pieces, 2, MOST).alias("after"))
    return F.transform(pairs, lambda p: F.when(p["after"].isNotNull(), entry(trailing_name(p["before"]), start_of(p["after"]))))


def labelled(text: Column) -> Column:
    """Names in a list behind a label and a colon or dash, on its line, and on the next where the list goes on there. A start on
    the line is the first one's."""

    def each(part: Column) -> Column:
        lines = F.split(F.substring(part, 1, LINE), "\r?\n")
        first, second = F.get(lines, F.lit(0)), F.coalesce(F.get(lines, F.lit(1)), F.lit(""))
        line = F.when(first.rlike(r"(?i)(?:&|,|\band)\s*$"), F.concat(first, F.lit(" "), second)).otherwise(first)
        cut = F.split(line, rf"{SINCE}|\(")
        start = F.get(F.filter(F.transform(parts_after(line, SINCE), start_of), lambda s: s["inception"] | s["since"].isNotNull()), F.lit(0))
        names = F.transform(F.split(F.get(cut, F.lit(0)), r"\s*(?:,|&|/|;|\band\b)\s*"), lambda n: leading_name(F.regexp_replace(n, rf"^\s*{TITLE}", "")))
        return F.transform(names, lambda n, i: entry(n, F.when(i == 0, F.coalesce(start, _none())).otherwise(_none())))

    label = r"(?:(?i)\bfund[ \t]+managers?(?:\(s\))?|\bmanaged[ \t]+by)[ \t]*[*^#]*[ \t]*[:\-–](?-i)"
    return F.flatten(F.transform(parts_after(text, label), each))


def in_rows(text: Column) -> Column:
    """Names of table rows in the blocks under headings of managers, whose lines may be broken anywhere: a row is what
    stands between two dates, and its name the last words before marks, years and roles."""
    month = "|".join(f"{m[:3]}(?:{m[3:]})?" if len(m) > 3 else m for m in MONTHS) + "|sept"
    date = rf"(?i)\b(?:{month})\b[\s-]+(?:\d{{1,2}}\s*,\s*)?\d{{4}}\b"

    def each(block: Column) -> Column:
        flat = F.regexp_replace(F.substring(block, 1, BLOCK), r"\s+", " ")
        dates = F.regexp_extract_all(flat, F.lit(f"({date})"), 1)
        before = F.slice(F.split(flat, date), 1, MOST)
        rows = F.arrays_zip(before.alias("before"), dates.alias("date"))
        bare = lambda t: F.regexp_replace(F.regexp_replace(t, r"(?:\s*\d{1,2}\s+years?)?\s*$", ""), r"\s*\([^)]{0,60}\)\s*$", "")
        name = lambda t: trailing_name(F.element_at(F.split(bare(bare(t)), TITLE), -1))
        return F.transform(rows, lambda r: F.when(r["date"].isNotNull(), entry(name(r["before"]), start_of(r["date"]))))

    return F.flatten(F.transform(parts_after(text, r"(?i)\bfund\s+manager(?:\(s\)|s)?\b"), each))


def clean(name: Column) -> Column:
    """A name without heads and captions in front of it; null unless two to four words are left, with no caption among them. A
    name printed twice in a row is one."""
    bad = F.array(*map(F.lit, NO_NAME))
    caption = lambda w: F.array_contains(bad, F.lower(w))
    words = F.split(F.trim(F.regexp_replace(name, r"\s+", " ")), " ")
    first = F.array_position(F.transform(words, lambda w: ~caption(w)), F.lit(True))
    kept = F.slice(words, F.greatest(first.cast("int"), F.lit(1)), F.size(words))
    half = (F.size(kept) / 2).cast("int")
    kept = F.when(F.slice(kept, 1, half) == F.slice(kept, half + 1, F.size(kept)), F.slice(kept, 1, half)).otherwise(kept)
    return F.when((first > 0) & F.size(kept).between(2, 4) & ~F.exists(kept, caption), F.array_join(kept, " "))


def managers(pages: DataFrame) -> DataFrame:
    """(doc_id, name, managing_since) of managers named on pages (doc_id, text, and inception, to which "since inception"
    refers, where a column has it), in any of four layouts, all read in one pass; of several starts the earliest counts."""
    inception = F.col("inception") if "inception" in pages.columns else F.lit(None).cast("date")
    text = F.coalesce(F.col("text"), F.lit(""))
    every = F.concat(*(F.filter(f(text), lambda e: e["name"].isNotNull()) for f in (titled, in_parentheses, labelled, in_rows)))
    rows = pages.select("doc_id", inception.alias("start"), F.explode(every).alias("e"))
    since = F.when(F.col("e.inception"), F.col("start")).otherwise(F.col("e.since"))
    return rows.select("doc_id", clean(F.col("e.name")).alias("name"), since.alias("since")).filter("name is not null").groupBy("doc_id", "name").agg(F.min("since").alias("managing_since"))


def current_managers(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Of managers (doc_id, name, managing_since) those in office on the document's day (pages: doc_id, doc_date, text): not
    those printed with an end before it, nor with a start after it."""
    rows = found.join(pages.select("doc_id", "doc_date", "text"), "doc_id")
    behind = parts_after(F.col("text"), F.concat(F.lit(r"\Q"), F.col("name"), F.lit(r"\E")))
    end = r"(?i)^[\s,&(]*(?:effective\s+)?(?:till|until|up\s?to)\s+"
    ends = F.transform(behind, lambda x: F.when(x.rlike(end), leading_date(F.regexp_replace(F.substring(x, 1, 80), end, ""))))
    until = F.get(F.filter(ends, lambda x: x.isNotNull()), F.lit(0))
    gone = F.coalesce(until < F.col("doc_date"), F.lit(False))
    to_come = F.coalesce(F.col("managing_since") > F.col("doc_date"), F.lit(False))
    return rows.filter(~gone & ~to_come).select("doc_id", "name", "managing_since")


def inception_dates(pages: DataFrame) -> DataFrame:
    """(doc_id, inception) stated on pages (doc_id, page_number, text), the first."""
    flat = F.regexp_replace("text", r"\s+", " ")
    day = date_after(flat, r"(?i)\b(?:inception|allotment)\b(?:[ /-]+(?:allotment|inception|date))*[ /:-]*")
    return pages.withColumn("day", day).filter("day is not null").groupBy("doc_id").agg(F.min_by("day", "page_number").alias("inception"))


def name_changes(observed: DataFrame) -> DataFrame:
    """Names added and removed against the document before (observed: scheme_id, doc_date, name); the first document is a
    baseline."""
    days = observed.groupBy("scheme_id", "doc_date").agg(F.array_sort(F.collect_set("name")).alias("names"))
    rows = days.withColumn("before", F.lag("names").over(Window.partitionBy("scheme_id").orderBy("doc_date"))).filter("before is not null")
    return rows.select("scheme_id", "doc_date", F.array_except("names", "before").alias("added"), F.array_except("before", "names").alias("removed"))


def spells(observed: DataFrame) -> DataFrame:
    """The spells in which managers (observed: scheme_id, doc_date, name, managing_since; a document that names nobody has no
    row and moves nothing) were in every document of their scheme: from_date, to_date (the first document without the name;
    null while current) and stated (whether from_date was printed). A spell begins at the start that its first document states,
    or on that document's day; an earlier start stated within the spell corrects it, and no other spell. All is
    worked out from the whole history, so the order in which documents are loaded doesn't matter."""
    days = observed.select("scheme_id", "doc_date").distinct()
    by_day = Window.partitionBy("scheme_id").orderBy("doc_date")
    days = days.withColumns({"place": F.row_number().over(by_day), "next": F.lead("doc_date").over(by_day)})
    named = observed.groupBy("scheme_id", "doc_date", "name").agg(F.min("managing_since").alias("since"))
    rows = named.join(days, ["scheme_id", "doc_date"])
    spell = F.col("place") - F.row_number().over(Window.partitionBy("scheme_id", "name").orderBy("doc_date"))
    found = rows.withColumn("spell", spell).groupBy("scheme_id", "name", "spell").agg(
        F.min(F.struct("doc_date", "since")).alias("first"), F.min("since").alias("earliest"), F.max(F.struct("doc_date", "next")).alias("last")
    )
    opened = F.coalesce("first.since", "first.doc_date")
    start = F.least(opened, F.col("earliest"))
    stated = F.coalesce(start == F.col("earliest"), F.lit(False))
    return found.select("scheme_id", "name", start.alias("from_date"), F.col("last.next").alias("to_date"), stated.alias("stated"))


SIMILAR = 0.9


def same_person(a: str, b: str) -> float:
    """The ratio of two spellings of a name that share their first or last word; 0 if they don't, or differ by more than a
    slip of the pen."""
    from difflib import SequenceMatcher

    x, y = a.lower().split(), b.lower().split()
    if not x or not y or (x[0] != y[0] and x[-1] != y[-1]):
        return 0.0
    ratio = SequenceMatcher(None, a.lower(), b.lower()).ratio()
    return ratio if ratio >= SIMILAR else 0.0


def respelled(added: list[str], departed: list[str]) -> tuple[list[str], list[str]]:
    """Both lists without the pairs that are one person, the most alike first, each name in one pair at most."""
    pairs = sorted((-r, a, d) for a in added for d in departed if (r := same_person(a, d)))
    added, departed = list(added), list(departed)
    for _, a, d in pairs:
        if a in added and d in departed:
            added.remove(a)
            departed.remove(d)
    return added, departed


def manager_changes(documents: DataFrame, observed: DataFrame) -> DataFrame:
    """Documents (scheme_id, doc_date) whose managers (observed: scheme_id, doc_date, name, managing_since) differ from the
    document before: before and after (all names, sorted), added, departed. The first document is a baseline, and one that
    names nobody was misread: neither it nor the next tells a change. A name respelled is neither added nor departed; whoever
    by their own start managed before the earlier document was overlooked then and isn't added."""
    names = observed.groupBy("scheme_id", "doc_date").agg(F.array_sort(F.collect_set("name")).alias("names"), F.collect_list(F.struct("name", "managing_since")).alias("starts"))
    none = F.array().cast("array<string>")
    rows = documents.select("scheme_id", "doc_date").distinct().join(names, ["scheme_id", "doc_date"], "left").withColumn("names", F.coalesce("names", none))
    by_day = Window.partitionBy("scheme_id").orderBy("doc_date")
    rows = rows.withColumns({"before": F.lag("names").over(by_day), "day_before": F.lag("doc_date").over(by_day)})
    rows = rows.filter((F.size("before") > 0) & (F.size("names") > 0))
    already = F.transform(F.filter("starts", lambda s: s["managing_since"] < F.col("day_before")), lambda s: s["name"])
    rows = rows.select("scheme_id", "doc_date", "before", F.col("names").alias("after"), F.array_except("names", "before").alias("added"), F.array_except("before", "names").alias("departed"), F.array_distinct(already).alias("already"))
    rows = rows.filter((F.size("added") > 0) | (F.size("departed") > 0))

    def paired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [respelled(list(a), list(d)) for a, d in zip(pdf["added"], pdf["departed"], strict=True)]
            pdf["added"], pdf["departed"] = [x for x, _ in both], [x for _, x in both]
            yield pdf

    kept = rows.mapInPandas(paired, StructType(rows.schema.fields))
    kept = kept.withColumn("added", F.array_except("added", "already"))
    return kept.filter((F.size("added") > 0) | (F.size("departed") > 0)).drop("already")
