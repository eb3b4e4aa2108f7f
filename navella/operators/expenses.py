"""Expense ratios stated on factsheets, their changes, and the latest of each plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines under a heading in which its figures stand, beyond them those in which a caption may name them; on a page shared
#: with another scheme, where labels and figures may be printed one below the other, the lines that both take.
BLOCK, REACH, RUN = 6, 3, 12
#: Characters behind a footnote's mark in which it must speak of base ratios, and lines of one that a digit opens.
NOTE, NOTE_LINES = 200, 3
#: Words that name a plan, and the plan.
PLANS = {"direct": "Direct", "regular": "Regular", "other": "Regular"}
FIGURE = r"\d{1,2}\.\d{1,4}"


def squeezed(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\s+", " "))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)


def says_base(text: Column) -> Column:
    return squeezed(text).contains("base expense ratio") | F.array_contains(words_of(text), "ber")


def is_heading(line: Column) -> Column:
    return squeezed(line).contains("expense ratio") | F.array_contains(words_of(line), "ter")


def plan_of(word: Column) -> Column:
    found = F.lit(None).cast("string")
    for k, plan in PLANS.items():
        found = F.when(word == k, plan).otherwise(found)
    return found


def columns_of(line: Column) -> Column:
    """TER and BER in the order in which a line names both as columns; null otherwise."""
    named = F.filter(F.regexp_extract_all(line, F.lit(r"[A-Za-z]+"), 0), lambda w: w.isin("TER", "BER"))
    return F.when(F.size(F.array_distinct(named)) == 2, named)


def label_of(line: Column) -> Column:
    """The plan that a line's first word names; null without."""
    return plan_of(F.lower(F.regexp_extract(line, r"^\s*([A-Za-z]+)\b", 1)))


def figures_of(line: Column) -> Column:
    """(plan, pct) on one line: each plan's name before a colon with its figure right behind it, or else the plan that begins
    the line with the first number on it."""
    pieces = F.split(line, r"\s*:\s*")
    ends = F.transform(pieces, lambda p: plan_of(F.get(F.filter(F.slice(F.reverse(words_of(p)), 1, 2), lambda w: w != "plan"), F.lit(0))))
    numbers = F.transform(pieces, lambda p: F.regexp_extract(p, rf"^({FIGURE})\s*%", 1))
    pairs = F.arrays_zip(F.slice(ends, 1, 20).alias("plan"), F.slice(numbers, 2, 20).alias("pct"))
    colons = F.filter(pairs, lambda p: p["plan"].isNotNull() & p["pct"].isNotNull() & (p["pct"] != ""))
    rest = F.regexp_replace(line, r"^\s*[A-Za-z]+", "")
    number = F.regexp_extract(rest, r"^\D{0,160}(\d+(?:\.\d+)?)", 1)
    first = F.filter(F.array(F.struct(label_of(line).alias("plan"), number.alias("pct"))), lambda p: p["plan"].isNotNull() & p["pct"].rlike(rf"^{FIGURE}$"))
    return F.when(F.size(colons) > 0, colons).otherwise(first)


def percents(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(rf"({FIGURE})\s*%"), 1)


def typed(found: Column, kind: Column) -> Column:
    return F.transform(found, lambda p: F.struct(p["plan"].alias("plan"), p["pct"].alias("pct"), kind.alias("kind")))


def expense_ratios(pages: DataFrame) -> DataFrame:
    """(doc_id, plan_type, ratio_type, pct) of layout pages (doc_id, page_number, text; shared, where a column has it): a Direct
    or Regular (also Other) figure on one line, within six lines under a heading of expense ratios. A heading that names TER
    and BER as columns types its figures in that order; else they are BER if heading or caption says base, or a footnote
    does that a mark on the heading points at, and TER if not. On shared pages labels and figures may stand in lines of
    their own, labels first. The first of each kind counts, and headings after both plans are known don't. Figures lie
    between 0 and 5. Headings are found in each page's row; only footnotes bring a document's pages together."""
    shared = F.col("shared") if "shared" in pages.columns else F.lit(False)
    lines = F.split(F.coalesce("text", F.lit("")), "\r?\n")
    heads = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), x.alias("line"))), lambda h: is_heading(h["line"]))
    rows = pages.select("doc_id", "page_number", shared.alias("shared"), lines.alias("lines"), F.explode(heads).alias("h"))
    at = F.col("h.at") + 1
    rows = rows.select("doc_id", "page_number", "shared", F.col("h.at").alias("at"), F.slice("lines", at, BLOCK + REACH + 1).alias("near"), F.slice("lines", at, RUN).alias("run"),
                       F.regexp_extract(F.regexp_extract(squeezed(F.col("h.line")), r"expense ratio(.*)$", 1), r"^\s*([^\w\s:.,()\[\]-]{1,3}|\d)(?:\s|$)", 1).alias("mark"))
    noted = _notes(pages, rows.filter("mark <> ''").select("doc_id", "mark").distinct())
    rows = rows.join(noted, ["doc_id", "mark"], "left")
    kind = F.when(F.exists("near", says_base) | F.coalesce("noted", F.lit(False)), "BER").otherwise("TER")
    block = F.slice("near", 1, BLOCK + 1)
    columns = F.get(F.filter(F.transform(F.slice(F.filter(block, lambda x: F.trim(x) != ""), 1, 3), columns_of), lambda c: c.isNotNull()), F.lit(0))
    rows = rows.withColumns({"kind": kind, "columns": columns, "block": block})

    def by_column(line: Column) -> Column:
        pairs = F.arrays_zip(F.col("columns").alias("kind"), F.slice(percents(line), 1, 2).alias("pct"))
        made = F.transform(pairs, lambda z: F.struct(label_of(line).alias("plan"), z["pct"].alias("pct"), z["kind"].alias("kind")))
        return F.filter(made, lambda z: z["plan"].isNotNull() & z["pct"].isNotNull())

    by_line = F.flatten(F.transform("block", lambda x: F.when(F.col("columns").isNotNull(), by_column(x)).otherwise(typed(figures_of(x), F.col("kind")))))
    below = F.slice("run", 2, RUN)
    labels = F.filter(F.transform(below, label_of), lambda p: p.isNotNull())
    numbers = F.flatten(F.transform(F.filter(below, lambda x: label_of(x).isNull()), percents))
    stacked = F.when(F.col("shared") & F.col("columns").isNull() & (F.size(labels) == 2) & (F.size(numbers) >= 2), typed(F.arrays_zip(labels.alias("plan"), F.slice(numbers, 1, 2).alias("pct")), F.col("kind")))
    figures = F.when((F.size(by_line) == 0) & stacked.isNotNull(), stacked).otherwise(by_line)
    rows = rows.select("doc_id", "page_number", "at", F.posexplode(figures).alias("k", "z"))
    rows = rows.select("doc_id", F.struct("page_number", "at").alias("head"), F.struct("page_number", "at", "k").alias("order"), F.col("z.plan").alias("plan_type"), F.col("z.kind").alias("ratio_type"), F.col("z.pct").try_cast("double").alias("pct")).filter("pct > 0 and pct < 5")
    first = {p: F.min(F.when(F.col("plan_type") == p, F.col("head"))).over(Window.partitionBy("doc_id")) for p in ("Direct", "Regular")}
    known = F.greatest(first["Direct"], first["Regular"])  # nulls are passed over, so both must be there
    both = first["Direct"].isNotNull() & first["Regular"].isNotNull()
    rows = rows.withColumn("known_by", F.when(both, known)).filter("known_by is null or head <= known_by")
    return rows.groupBy("doc_id", "plan_type", "ratio_type").agg(F.min_by("pct", "order").alias("pct"))


def _notes(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, mark, noted): whether a footnote under a mark speaks of base ratios. A digit is a mark at a line's beginning
    only; symbols are one anywhere, if no further symbol follows."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("text"))))
    whole = pages.join(marks.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("notes"))
    rows = marks.join(whole, "doc_id")
    lines, mark = F.split("notes", "\r?\n"), F.col("mark")
    opened = F.transform(lines, lambda x, i: F.ltrim(x).startswith(mark) & says_base(F.array_join(F.slice(lines, i + 1, NOTE_LINES), " ")))
    behind = F.split(F.regexp_replace("notes", r"\s+", " "), F.concat(F.lit(r"\Q"), mark, F.lit(r"\E")))
    symbol = F.exists(F.slice(behind, F.lit(2), F.size(behind)), lambda x: ~x.rlike(r"^[^\w\s:.,()\[\]-]") & says_base(F.substring(x, 1, NOTE)))
    return rows.select("doc_id", "mark", F.when(mark.rlike(r"^\d"), F.exists(opened, lambda x: x)).otherwise(symbol).alias("noted"))


def ratio_map(ratios: DataFrame) -> DataFrame:
    """(doc_id, TER, BER): maps from plan type to figure; null without any."""
    plans = F.map_from_entries(F.array_sort(F.collect_list(F.struct("plan_type", "pct"))))
    return ratios.groupBy("doc_id").pivot("ratio_type", ["TER", "BER"]).agg(plans)


def ratio_changes(ratios: DataFrame, least: float = 0.001) -> DataFrame:
    """Total expense ratios (scheme_id, doc_date, plan_type, ratio_type, pct) that differ from the document before by more than
    least; base ratios are another number and don't count."""
    days = Window.partitionBy("scheme_id").orderBy("doc_date")
    docs = ratios.select("scheme_id", "doc_date").distinct().withColumn("previous", F.lag("doc_date").over(days))
    ter = ratios.filter("ratio_type = 'TER'").select("scheme_id", "doc_date", "plan_type", "pct")
    old = ter.withColumnsRenamed({"doc_date": "previous", "pct": "before"})
    rows = ter.join(docs, ["scheme_id", "doc_date"]).join(old, ["scheme_id", "plan_type", "previous"])
    return rows.filter(F.abs(F.col("pct") - F.col("before")) > least).select("scheme_id", "doc_date", "plan_type", "before", F.col("pct").alias("after"))


def latest_costs(plans: DataFrame, ratios: DataFrame) -> DataFrame:
    """For each scheme of plans and plan type the newest stated total expense ratio of its growth plan, or why there is none:
    no_direct_growth_plan, no_regular_growth_plan, not_yet_ingested."""
    kinds = F.explode(F.array(F.lit("Direct"), F.lit("Regular")))
    asked = plans.select("scheme_id").distinct().select("scheme_id", kinds.alias("plan_type"))
    growth = plans.filter("option_type = 'Growth'").select("scheme_id", "plan_type", F.lit(True).alias("has_plan")).distinct()
    newest = ratios.filter("ratio_type = 'TER'").groupBy("scheme_id", "plan_type").agg(F.max(F.struct("doc_date", "pct")).alias("c"))
    rows = asked.join(growth, ["scheme_id", "plan_type"], "left").join(newest, ["scheme_id", "plan_type"], "left")
    no_plan = F.concat(F.lit("no_"), F.lower("plan_type"), F.lit("_growth_plan"))
    reason = F.when(F.col("has_plan").isNull(), no_plan).when(F.col("c").isNull(), "not_yet_ingested").otherwise("stated")
    known = reason == "stated"
    return rows.select("scheme_id", "plan_type", F.when(known, F.col("c.doc_date")).alias("as_of_date"), F.when(known, F.col("c.pct")).alias("ter_pct"), reason.alias("source"))
