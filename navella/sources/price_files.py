"""Daily price files and upkeep of tables by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Header cells of the files, lower-cased, and what stands for no isin.
CODE, NAME, PRICE, DATE, PLAN, OPTION = "scheme code", ("scheme name", "nav name"), "net asset value", "date", "plan", "option"
NO_ISIN = ("", "-", "n/a", "na", "redeemed")


def clean_isin(x: Column) -> Column:
    return F.when(~F.lower(F.trim(x)).isin(*NO_ISIN), F.trim(x))


def price_date(x: Column) -> Column:
    x = F.trim(x)
    return F.coalesce(F.try_to_date(x, "d-MMM-yyyy"), F.try_to_date(x, "d-MMM-yy"))


def read_price_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all price files under path. A file is one value and so one task; files spread over the cluster."""
    return parse_price_text(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"))


def parse_price_text(files: DataFrame) -> DataFrame:
    """Rows of files (file, value: the whole text)."""
    return parse_price_lines(files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")))


def parse_price_lines(lines: DataFrame) -> DataFrame:
    """Rows of lines (file, line_no, line): code, name, isins, plan and option where the file has them, price, date, and the
    section and house that stand above. Section lines are ``Type(Category - Sub)``, house lines have no semicolon;
    columns are found by the header's names, and without a header by the layout of old files, in which price and date
    come last. Rows under 6 fields go; a price that is no number is null."""
    lines = lines.withColumn("line", F.trim("line")).filter("line <> ''")
    is_row = F.contains("line", F.lit(";"))
    tidy = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    head = F.when(F.lower("line").startswith(f"{CODE};"), F.transform(F.split("line", ";"), tidy))
    section = F.when(~is_row & F.contains("line", F.lit("(")) & F.endswith("line", F.lit(")")), F.col("line"))
    house = F.when(~is_row & section.isNull(), F.col("line"))
    above = Window.partitionBy("file").orderBy("line_no")
    rows = lines.withColumns({"head": head, "section": section, "house": house, "cells": F.split("line", ";"), "is_row": is_row & head.isNull()})
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(above) for c in ("head", "section", "house")})
    rows = rows.filter(F.col("is_row") & (F.size("cells") >= 6))

    def cell(test, place: Column | None = None) -> Column:
        """The cell under the header that passes, else at a place of the old layout, from 0."""
        at = F.nullif(F.array_position(F.transform("head", test), F.lit(True)), F.lit(0)) - 1
        at = at if place is None else F.coalesce(at, place)
        return F.trim(F.get("cells", at.cast("int")))

    n, bare = F.size("cells"), F.col("head").isNull()
    inside = F.trim(F.regexp_extract("section", r"^[^(]*\((.*)\)\s*$", 1))
    parts = F.split(inside, " - ", 2)
    blank = lambda x: F.nullif(x, F.lit(""))
    return rows.select(
        "file", "line_no", cell(lambda h: h == CODE, F.lit(0)).alias("code"), cell(lambda h: h.isin(*NAME), F.lit(3)).alias("name"),
        clean_isin(cell(lambda h: h.contains("isin") & ~h.contains("reinvest"), F.lit(1))).alias("isin"), clean_isin(cell(lambda h: h.contains("isin") & h.contains("reinvest"), F.lit(2))).alias("isin_reinvest"),
        blank(cell(lambda h: h == PLAN)).alias("plan"), blank(cell(lambda h: h == OPTION)).alias("option"),
        cell(lambda h: h == PRICE, F.when(bare, n - 2)).try_cast("double").alias("nav"), blank(cell(lambda h: h == DATE, F.when(bare, n - 1))).alias("date_text"),
        F.trim(F.regexp_extract("section", r"^([^(]*)\(", 1)).alias("scheme_type"), F.trim(F.get(parts, F.lit(0))).alias("category"),
        F.when(F.col("section").isNotNull(), F.coalesce(F.trim(F.get(parts, F.lit(1))), F.lit(""))).alias("sub_category"), "house", F.col("section").alias("header"),
    ).withColumn("date", price_date(F.col("date_text")))


#: Words of plans and options that are no part of a scheme's own name.
PLAN_WORDS = (
    "Direct Plan", "Regular Plan", "Direct", "Regular", "Growth Option", "Growth", "IDCW Reinvestment", "IDCW Payout", "IDCW",
    "Dividend Reinvestment", "Dividend Payout", "Dividend", "Plan", "Option",
)
#: Asset groups by category; any other is Other.
ROLL_UP = {"Equity Scheme": "Equity", "Debt Scheme": "Debt", "Hybrid Scheme": "Hybrid", "Solution Oriented Scheme": "Solution Oriented", "Other Scheme": "Other"}


def roll_up(category: Column) -> Column:
    return F.coalesce(*(F.when(F.trim(category) == k, v) for k, v in ROLL_UP.items()), F.lit("Other"))


def plan_and_option(plan: Column, option: Column | None = None) -> tuple[Column, Column, Column]:
    """(Direct, Regular or null; Growth, IDCW or null; of IDCW Reinvest, Payout or null) as stated in a plan and an option
    text, or in one name that holds both."""
    option = plan if option is None else option
    idcw = option.rlike(r"(?i)\b(IDCW|Dividend|Income Distribution)\b")
    variant = F.when(option.rlike(r"(?i)\bReinvest(ment)?\b"), "Reinvest").when(option.rlike(r"(?i)\bPayout\b"), "Payout")
    return (
        F.when(plan.rlike(r"(?i)\bDirect\b"), "Direct").when(plan.rlike(r"(?i)\bRegular\b"), "Regular"),
        F.when(idcw, "IDCW").when(option.rlike(r"(?i)\bGrowth\b"), "Growth"),
        F.when(idcw, variant),
    )


def base_name(name: Column) -> Column:
    """A name without its words of plan and option; the name itself if nothing is left."""
    bare = F.regexp_replace(name, "(?i)" + "|".join(rf"-?\s*{w}" for w in PLAN_WORDS), "")
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s{2,}", " ")), r"[\s-]+$", ""))
    return F.coalesce(F.nullif(bare, F.lit("")), F.trim(name))


def identified(rows: DataFrame) -> DataFrame:
    """Rows of price files with amc_id, scheme_id, plan_id, base name, plan and option type; those without a house go. Plan
    and option columns count where either is filled, else the name's own words."""
    rows = rows.filter("house is not null")
    own = F.col("plan").isNotNull() | F.col("option").isNotNull()
    columns = plan_and_option(F.coalesce("plan", F.lit("")), F.coalesce("option", F.lit("")))
    kinds = {k: F.when(own, c).otherwise(w) for k, c, w in zip(("plan_type", "option_type", "idcw_variant"), columns, plan_and_option(F.col("name")), strict=True)}
    rows = rows.withColumns(kinds | {"base": F.when(own, F.col("name")).otherwise(base_name(F.col("name")))})
    ids = {"amc_id": F.concat(F.lit("amc-"), slug(F.col("house"))), "scheme_id": key_id("scheme-", slug(F.col("house")), slug(F.col("base"))), "plan_id": F.concat(F.lit("plan-"), "code")}
    return rows.withColumns(ids)


def daily_frames(rows: DataFrame) -> dict[str, DataFrame]:
    """The tables that one day's rows give: amc, scheme (with its taxonomy; of several rows the first's), plan and nav
    (one row a plan and day, the last's), and counts with whether they look wrong: plans, but no price at all."""
    known = identified(rows)
    first = lambda c: F.min_by(c, F.struct("file", "line_no")).alias(c)
    last = lambda c: F.max_by(c, F.struct("file", "line_no")).alias(c)
    taxonomy = ("base", "scheme_type", "category", "sub_category", "header")
    nav = known.filter("nav is not null and date is not null")
    counts = known.agg(F.count_distinct("amc_id").alias("amcs"), F.count_distinct("scheme_id").alias("schemes"), F.count("*").alias("plans"), F.count_if(F.col("nav").isNotNull() & F.col("date").isNotNull()).alias("nav_points"))
    return {
        "amc": known.groupBy("amc_id").agg(first("house")),
        "scheme": known.groupBy("scheme_id").agg(first("amc_id"), *map(first, taxonomy)).withColumn("roll_up", roll_up(F.col("category"))),
        "plan": known.withColumn("isin", F.coalesce("isin", "isin_reinvest")).groupBy("plan_id").agg(*map(last, ("scheme_id", "isin", "plan_type", "option_type", "idcw_variant"))),
        "nav": nav.groupBy("plan_id", "date").agg(last("nav")),
        "counts": counts.withColumn("suspicious", (F.col("plans") > 0) & (F.col("nav_points") == 0)),
    }


def history_points(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Prices (plan_id, date, nav) of rows of known plans, one a plan and day, the last row's."""
    points = rows.filter("nav is not null and date is not null").withColumn("plan_id", F.concat(F.lit("plan-"), "code"))
    known = points.join(plans.select("plan_id").distinct(), "plan_id", "left_semi")
    return known.groupBy("plan_id", "date").agg(F.max_by("nav", F.struct("file", "line_no")).alias("nav"))


def history_counts(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """What became of a history's rows: parsed, prices of known plans, codes that no plan has, dates that are none; and the
    outcome, ok or empty."""
    priced = rows.withColumn("plan_id", F.concat(F.lit("plan-"), "code")).join(plans.select("plan_id", F.lit(True).alias("known")).distinct(), "plan_id", "left")
    usable = F.col("nav").isNotNull() & F.col("date_text").isNotNull()
    found = priced.agg(
        F.count("*").alias("rows_parsed"), F.count_if(usable & F.col("date").isNotNull() & F.col("known")).alias("nav_points"),
        F.count_distinct(F.when(usable & F.col("date").isNotNull() & F.col("known").isNull(), F.col("code"))).alias("unknown_codes"),
        F.count_if(usable & F.col("date").isNull()).alias("bad_dates"),
    )
    return found.withColumn("outcome", F.when(F.col("nav_points") > 0, "ok").otherwise("empty"))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def key_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("::", *parts)), 1, 16))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables with one row a key, the new table's where both have it; of several new rows the greatest. Most keys have
    one row, so rows are shuffled as they are and sorted once, not before the shuffle too."""
    rest = [c for c in old.columns if c not in keys]
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_new", F.lit(1)))
    best = rows.repartition(*keys).groupBy(*keys).agg(F.max(F.struct("_new", *rest)).alias("best"))
    return best.select(*keys, *(f"best.{c}" for c in rest)).select(*old.columns)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the rows of new whose key it lacks."""
    return old.unionByName(new.select(*old.columns).dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def replace_snapshots(old: DataFrame, new: DataFrame, snapshot: list[str]) -> DataFrame:
    """old without the snapshots that new has, and new."""
    return old.join(new.select(*snapshot).distinct(), snapshot, "left_anti").unionByName(new.select(*old.columns))


def merge_dimension(seen: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """From all sightings (key, attributes, seen): the newest attributes, first and last day seen, and whether seen on the
    newest day of all."""
    found = seen.groupBy(key).agg(F.max(F.struct("seen", *attributes)).alias("newest"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))
    last = F.broadcast(seen.agg(F.max("seen").alias("newest_day")))  # one row
    return found.crossJoin(last).select(key, *(f"newest.{c}" for c in attributes), "first_seen", "last_seen", (F.col("last_seen") == F.col("newest_day")).alias("active"))


def pending_months(spark: SparkSession, start: str, end: str, done: DataFrame) -> DataFrame:
    """Months between the days, clipped to them, that are not in done (month)."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    months = spark.range(1).select(F.explode(F.sequence(F.trunc(a, "MM"), b, F.expr("interval 1 month"))).alias("month"))
    return months.join(done.select("month"), "month", "left_anti").select("month", F.greatest("month", a).alias("first_day"), F.least(F.last_day("month"), b).alias("last_day"))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child whose key parent lacks, counted by key."""
    return child.join(parent.select(key), key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))


#: First bytes of files and their kinds.
MAGIC = {"504B0304": "xlsx", "D0CF11E0A1B11AE1": "xls_biff", "25504446": "pdf"}


def sniff(content: Column) -> Column:
    """The kind of a file by its first bytes: xlsx, xls_biff, pdf, html or unknown."""
    start = F.hex(F.substring(content, 1, 8))
    text = F.lower(F.trim(F.decode(F.substring(content, 1, 512), "ISO-8859-1")))
    html = text.startswith("<!doctype html") | text.startswith("<html")
    return F.coalesce(*(F.when(start.startswith(k), v) for k, v in MAGIC.items()), F.when(html, "html"), F.lit("unknown"))


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Of files (path, content) one of each content that known (sha256) lacks, the first by path: sha256, path, kind, n
    (how many have it)."""
    rows = files.select("path", F.sha2("content", 256).alias("sha256"), sniff(F.col("content")).alias("kind"))
    one = rows.groupBy("sha256").agg(F.min("path").alias("path"), F.first("kind").alias("kind"), F.count("*").alias("n"))
    return one.join(known.select("sha256"), "sha256", "left_anti")


def merge_aliases(names: DataFrame, seen: DataFrame) -> DataFrame:
    """names (id, name, aliases) with the other spellings of seen (id, spelling) added once each to the sorted aliases."""
    more = seen.groupBy("id").agg(F.collect_set("spelling").alias("more"))
    rows = names.join(more, "id", "left")
    every = F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>")))
    return rows.select("id", "name", F.array_sort(F.array_except(every, F.array("name"))).alias("aliases"))


def by_name_or_alias(asked: DataFrame, names: DataFrame) -> DataFrame:
    """The id of each asked name (asked): by equal name, else by an alias; of several ids the smallest. Names that nobody
    has are left out."""
    keys = names.select("id", F.col("name").alias("asked"), F.lit(0).alias("way")).unionByName(names.select("id", F.explode("aliases").alias("asked"), F.lit(1).alias("way")))
    best = asked.distinct().join(keys, "asked").groupBy("asked").agg(F.min(F.struct("way", "id")).alias("best"))
    return best.select("asked", "best.id", F.when(F.col("best.way") == 0, "name").otherwise("alias").alias("by"))
