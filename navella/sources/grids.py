"""Holdings and cap lists from decoded spreadsheet cells: sheet_id, row_no, cells (array of strings, null or blank for
none). A sheet is a few hundred rows and one window partition; sheets spread over the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words by which a row of a sheet is known.
TOP_SECTIONS = (
    "equity & equity related", "equity and equity related", "equity related instruments", "money market instruments",
    "debt instruments", "government securities", "derivatives", "others",
)
FOOTERS = (
    "# traded", "notes & symbols", "notes:", "lumpsum investment performance", "sip investment performance",
    "quantitative indicators", "this product is suitable", "total below investment grade",
    "details of intra scheme investments", "hedging positions", "nav as on", "annualised portfolio ytm", "macaulay duration",
)
GRAND_TOTALS = ("grand total", "net assets", "total net assets")
CASH_LABELS = ("net current assets", "net receivables", "cash & cash equivalent")
NAME_HEADS = ("name of the instrument", "name of instrument", "instrument name")
WEIGHT_HEADS = (
    "% to net", "% to aum", "% to nav", "% of net",
    "percentage to net", "percentage to aum", "percentage to nav", "percentage of net",
)
#: A file's weights add up to 1 within this; beyond MOST they are percent points.
TOLERANCE, MOST = 0.005, 5.0
LARGE, MID = 100, 250
ISIN = r"^IN[A-Z0-9]{10}$"


def any_of(x: Column, words, test=Column.contains) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | test(x, F.lit(w))
    return out


def one_of(x: Column, words, before: str = "") -> Column:
    """any_of in one pattern, where generated code would grow with the words."""
    return x.rlike(before + "(?:" + "|".join(rf"\Q{w}\E" for w in words) + ")")


def place(cells: Column, test) -> Column:
    """Place of the first cell that passes, from 1; null for none."""
    low = F.transform(cells, lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))
    return F.nullif(F.array_position(F.transform(low, test), F.lit(True)).cast("int"), F.lit(0))


def cell(at: Column) -> Column:
    """The cell at a place, null if blank or beyond the row."""
    return F.nullif(F.trim(F.get(F.col("cells"), at - 1)), F.lit(""))


def head(cells: Column) -> Column:
    """Where the columns of a holdings table stand, from its header row; null for any other row. Cells are looked through one by
    one only where the row as a whole has words that every header has."""
    row = F.lower(F.array_join(cells, "\n"))
    return F.when(row.contains("isin") & row.contains("quantity") & row.contains("instrument"), places_of(cells))


def places_of(cells: Column) -> Column:
    at = {
        "name": place(cells, lambda c: any_of(c, NAME_HEADS)), "isin": place(cells, lambda c: c.contains("isin")),
        "weight": place(cells, lambda c: any_of(c, WEIGHT_HEADS)), "industry": place(cells, lambda c: c.contains("industry")),
        "rating": place(cells, lambda c: c.contains("rating")), "quantity": place(cells, lambda c: c.contains("quantity")),
        "value": place(cells, lambda c: (c.contains("market") & c.contains("value")) | (c.contains("mkt") & c.contains("val"))),
    }
    both = at["industry"].isNotNull() & at["rating"].isNotNull() & (at["industry"] != at["rating"])
    fields = {**at, "industry": F.coalesce(at["industry"], at["rating"]), "rating": F.when(both, at["rating"])}
    whole = fields["industry"].isNotNull()
    for k in ("name", "isin", "weight", "quantity", "value"):
        whole = whole & at[k].isNotNull()
    return F.when(whole, F.struct(*(v.alias(k) for k, v in fields.items())))


def asset_class(top: Column, sub: Column) -> Column:
    t, s = F.lower(top), F.lower(sub)
    rules = (
        (t.contains("foreign"), "foreign"), (s.contains("reits"), "reit"), (t.contains("equity"), "equity"),
        (any_of(t, ("money market", "debt instruments", "government securities")), "debt"),
        (any_of(s, ("reverse repo", "treps", "mutual fund")), "cash"), (t.contains("derivatives"), "derivative"),
    )
    return F.coalesce(*(F.when(x, k) for x, k in rules), F.lit("other"))


def grid_rows(cells: DataFrame) -> DataFrame:
    """The rows of each sheet's table from its header to its footer, with what they are (kind: holding, derivative, total or
    null), the sections above them, and the number of valued rows up to them that have neither isin, industry nor quantity
    (block). Only the first of three windows holds cells; one sort serves them all. Expressions are kept short, as methods that
    are generated too long are not compiled."""
    up = Window.partitionBy("sheet_id").orderBy("row_no")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    sofar = up.rowsBetween(Window.unboundedPreceding, 0)
    filled = F.transform("cells", lambda c: F.nullif(F.trim(c), F.lit("")))
    rows = cells.select("sheet_id", "row_no", filled.alias("cells")).withColumn("own_head", head(F.col("cells")))
    rows = rows.withColumn("h", F.first("own_head", ignorenulls=True).over(before)).filter("h is not null")
    at = lambda c, k=0: F.get("cells", F.col(f"h.{c}") + (k - 1))
    texts = {"name": at("name"), "isin": at("isin"), "industry": at("industry"), "rating": at("rating"), "quantity_text": at("quantity"), "direction": at("name", 1)}
    numbers = {"value": at("value"), "weight": at("weight")} | {f"d{k}": at("name", k + 1) for k in (1, 2, 3)}
    rows = rows.select("sheet_id", "row_no", *(c.alias(k) for k, c in texts.items()), *(c.try_cast("double").alias(k) for k, c in numbers.items()))
    rows = rows.withColumns({"label": F.coalesce("name", "isin"), "isin": F.when(F.col("name").isNotNull(), F.col("isin"))}).drop("name")
    rows = rows.withColumn("low", F.lower("label"))
    footer = F.coalesce(one_of(F.col("low"), FOOTERS, "^") | F.lower("industry").contains("riskometer"), F.lit(False))
    total = F.coalesce(one_of(F.col("low"), GRAND_TOTALS, "^"), F.lit(False))
    skipped = (F.col("low") == "nil") | (F.col("isin").isNull() & F.col("low").rlike(r"\b(?:sub)?total\b"))
    bare = F.col("isin").isNull() & F.col("industry").isNull() & F.col("quantity_text").isNull()
    valued = F.col("value").isNotNull() | F.col("weight").isNotNull()
    starts = one_of(F.regexp_replace("low", r"^\(?[a-z0-9]{1,4}[).:]\s*", ""), TOP_SECTIONS, "^")
    top = F.when(F.col("bare"), one_of(F.col("low"), TOP_SECTIONS) & (~F.col("valued") | starts)).otherwise(False)
    rows = rows.withColumns({"footer": footer, "total": total, "bare": bare, "valued": valued})
    stays = F.col("label").isNotNull() & (F.col("total") | ~skipped)
    rows = rows.withColumns({"stays": stays, "opens": (F.col("low") == "derivatives") & ~F.col("total") & stays, "top": top & ~F.col("total") & stays}).drop("low")
    titled = F.col("top") | F.col("opens")
    rows = rows.withColumns({
        "ended": F.max("footer").over(sofar), "past_total": F.coalesce(F.max("total").over(before), F.lit(False)),
        "derivative": F.coalesce(F.last(F.when(F.col("opens"), True).when(F.col("top"), False), ignorenulls=True).over(sofar), F.lit(False)),
        "top_label": F.coalesce(F.last(F.when(titled, F.col("label")), ignorenulls=True).over(sofar), F.lit("")),
    }).filter("not ended and stays").drop("ended", "footer", "stays")
    # derivatives have a table of their own, a column to the left, once a header says long or short; else they stand in the main one
    rows = rows.withColumn("body", F.col("derivative") & ~F.col("opens") & ~F.col("total")).drop("derivative")
    says = F.coalesce(F.col("body") & F.lower("direction").contains("long"), F.lit(False))
    whole = F.col("value").isNotNull() & F.col("weight").isNotNull()
    # rows that are a section of their part in any case, and such as are one only below that header
    no_position = F.col("direction").isNull() & F.col("d2").isNull()
    section = F.when(F.col("body"), ~whole & no_position).otherwise(F.col("bare") & ~F.col("valued") & ~titled & ~F.col("total"))
    late = F.col("body") & whole & no_position
    held = ~(F.col("total") | titled | section | F.col("body") | F.col("past_total"))
    named = lambda c: F.when(titled, "").when(c, F.col("label"))
    rows = rows.withColumns({
        "headed_at": F.min(F.when(says, F.col("row_no"))).over(before), "block": F.sum((held & F.col("bare")).cast("int")).over(sofar),
        "sub_label": F.last(named(section), ignorenulls=True).over(sofar),
        "late_label": F.last(named(section | late), ignorenulls=True).over(sofar), "late_at": F.last(F.when(titled | section | late, F.col("row_no")), ignorenulls=True).over(sofar),
    })
    headed = F.col("headed_at").isNotNull()
    headings = titled | section | (late & headed) | (says & ~headed & ~whole)
    kind = F.when(F.col("total"), "total").when(headings, None).when(F.col("body"), "derivative").when(~F.col("past_total"), "holding")
    sub_label = F.coalesce(F.when(F.col("late_at") > F.col("headed_at"), F.col("late_label")).otherwise(F.col("sub_label")), F.lit(""))
    rows = rows.withColumns({"kind": kind, "sub_label": sub_label, "main": ~headed & whole}).filter("kind is not null")
    return rows.drop("past_total", "body", "valued", "opens", "top", "headed_at", "late_label", "late_at")


def tagged(rows: DataFrame) -> DataFrame:
    """grid_rows with what their holdings need: heads (whether a valued row without isin, industry and quantity is the total
    of the rows after it, one with an isin at least, which add up to its own weight), head_name, and held (whether the row
    is a holding that stays). Rows above the first such row have none, so no window holds them."""
    is_held, bare = F.col("kind") == "holding", F.col("bare")
    whole = Window.partitionBy("sheet_id", "block", F.when(F.col("block") == 0, F.col("row_no")))
    own = F.max(F.when(is_held & bare, F.col("weight"))).over(whole)
    children = F.sum(F.when(is_held & ~bare, F.coalesce("weight", F.lit(0.0)))).over(whole)
    named = F.max(F.when(is_held & ~bare, F.col("isin").isNotNull())).over(whole)
    heads = F.coalesce(named & (F.abs(children - own) <= F.greatest(F.lit(1e-6), 1e-4 * F.abs(own))), F.lit(False)) & (F.col("block") > 0)
    rows = rows.withColumns({"heads": heads, "head_name": F.max(F.when(is_held & bare, F.col("label"))).over(whole)})
    return rows.withColumn("held", is_held & ~(F.col("heads") & bare))


def holding_columns() -> list[Column]:
    """What a holding of tagged rows is, weights as printed."""
    industry, sub, name = F.col("industry"), F.lower("sub_label"), F.lower("head_name")
    missing = industry.isNull() | F.lower(industry).isin("n.a.", "na", "-")
    industry = F.coalesce(F.when(missing, F.col("rating")), industry)
    kind = F.when(any_of(F.lower("label"), CASH_LABELS), "cash").otherwise(asset_class(F.col("top_label"), F.col("sub_label")))
    listed = F.when(F.col("heads"), name.contains("listed") & ~name.contains("unlisted")).otherwise(sub.contains("listed"))
    label = F.when(F.col("heads"), F.col("head_name")).otherwise(F.coalesce(F.nullif("sub_label", F.lit("")), "top_label"))
    return [F.col("label").alias("instrument_name"), F.col("isin"), industry.alias("industry_or_rating"), F.col("quantity_text").try_cast("double").alias("quantity"), F.col("value").alias("market_value"), F.col("weight"), kind.alias("asset_class"), listed.alias("listed"), label.alias("section_label")]


def holdings(rows: DataFrame) -> DataFrame:
    """Holdings of grid_rows, weights as printed; rows that are their section's total are gone and name their section."""
    return tagged(rows).filter("held").select("sheet_id", "row_no", *holding_columns())


def derivatives(rows: DataFrame) -> DataFrame:
    """Derivative positions of grid_rows; they are never netted into holdings."""
    main = F.col("main")
    pick = lambda a, b: F.when(main, a).otherwise(b)
    values = (pick(F.col("quantity_text").try_cast("double"), F.col("d1")).alias("quantity"), pick(F.col("value"), F.col("d2")).alias("market_value"), pick(F.col("weight"), F.col("d3")).alias("weight"))
    direction = F.when(~main, F.nullif(F.trim(F.regexp_replace("direction", "[()]", "")), F.lit("")))
    label = F.coalesce(F.nullif("sub_label", F.lit("")), "top_label")
    return rows.filter("kind = 'derivative'").select("sheet_id", "row_no", F.col("label").alias("instrument_name"), direction.alias("direction"), *values, label.alias("section_label"))


def sums_of_sheet(over) -> dict[str, Column]:
    """Of tagged rows: the printed total weight (of several the last) and what holdings and derivatives add up to. over: makes a
    column of an aggregate, as of a group or a window."""
    weight, derived = F.col("weight"), F.col("kind") == "derivative"
    own = F.when(F.col("main"), weight).otherwise(F.col("d3"))
    return {
        "printed": over(F.max_by(weight, F.when(F.col("total"), F.col("row_no")))),
        "sum_held": over(F.sum(F.when(F.col("held"), weight))), "n_held": over(F.count_if(F.col("held"))),
        "sum_derived": over(F.sum(F.when(derived, own))), "n_derived": over(F.count_if(derived)),
    }


def verdict(found: DataFrame) -> DataFrame:
    """sums_of_sheet as fractions (scale: 100 where the file has percent points), ok and confidence."""
    target = F.coalesce("printed", F.when(F.col("sum_held") > 0, F.col("sum_held")))
    found = found.withColumn("scale", F.when(target > MOST, 100.0).otherwise(1.0)).withColumn("target", target / F.col("scale"))
    held, derived = (F.coalesce(c, F.lit(0.0)) / F.col("scale") for c in ("sum_held", "sum_derived"))
    agrees = (F.abs(held - F.col("target")) <= TOLERANCE) | (F.abs(held + derived - F.col("target")) <= TOLERANCE)
    ok = (F.abs(F.col("target") - 1) <= TOLERANCE) & (F.col("printed").isNull() | agrees)
    sure = F.when(F.col("n_held") == 0, 0.0).when(ok, 1.0).when(~ok, 0.5).otherwise(0.3)
    return found.withColumns({"printed": F.col("printed") / F.col("scale"), "sum_held": held, "sum_derived": derived, "ok": ok, "confidence": sure}).drop("target")


def reconciliation(rows: DataFrame) -> DataFrame:
    """For each sheet: the printed total weight (of several the last), what its holdings and its derivatives add up to, all as
    fractions (scale: 100 where the file has percent points), whether they agree, and the confidence: 1 if so, 0.5 if not,
    0.3 without any total, 0 without holdings. Without a printed total the holdings' own sum is the target."""
    sums = sums_of_sheet(lambda c: c)
    found = verdict(tagged(rows).groupBy("sheet_id").agg(*(c.alias(k) for k, c in sums.items())))
    return found.select("sheet_id", "scale", "printed", F.col("sum_held").alias("held"), F.col("sum_derived").alias("derived"), "ok", "confidence")


def judged(rows: DataFrame) -> DataFrame:
    """tagged rows with their sheet's verdict: scale, ok and the rest, by windows over the sheet, in the same pass."""
    whole = Window.partitionBy("sheet_id")
    return verdict(tagged(rows).withColumns(sums_of_sheet(lambda c: c.over(whole))))


def reconciled(rows: DataFrame) -> DataFrame:
    """The holdings of the sheets that reconcile, weights as fractions (pct_nav)."""
    good = judged(rows).filter("held and ok")
    return good.select("sheet_id", "row_no", *holding_columns(), "scale").withColumn("pct_nav", F.col("weight") / F.col("scale")).drop("weight", "scale")


#: Why a sheet isn't loaded.
REASONS = ("no_table", "no_holdings", "not_reconciled")


def sheet_outcomes(cells: DataFrame) -> DataFrame:
    """The ledger of sheets (sheet_id, row_no, cells): for each sheet its outcome (loaded, rejected), the reason of a rejection,
    its number of holdings and of derivatives and its three sums; no sheet is missing."""
    found = verdict(tagged(grid_rows(cells)).groupBy("sheet_id").agg(*(c.alias(k) for k, c in sums_of_sheet(lambda c: c).items())))
    every = cells.groupBy("sheet_id").agg(F.count("*").alias("n_rows"))
    rows = every.join(found, "sheet_id", "left")
    reason = F.when(F.col("n_held").isNull(), REASONS[0]).when(F.col("n_held") == 0, REASONS[1]).when(~F.coalesce("ok", F.lit(False)), REASONS[2])
    outcome = F.when(reason.isNull(), "loaded").otherwise("rejected")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_held", "n_derived")]
    return rows.select("sheet_id", outcome.alias("outcome"), reason.alias("reason"), "n_rows", *counts, "printed", F.col("sum_held").alias("held"), F.col("sum_derived").alias("derived"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def loaded_and_rejected(cells: DataFrame) -> DataFrame:
    """Every holding of every sheet with pct_nav and its sheet's outcome and reason: one computation whose two parts, by
    outcome, are what is loaded and what is put aside. Written with partitionBy("outcome") it is read once."""
    rows = judged(grid_rows(cells)).filter("held")
    loaded = F.coalesce("ok", F.lit(False))
    return rows.select("sheet_id", "row_no", *holding_columns(), (F.col("weight") / F.col("scale")).alias("pct_nav"), F.when(loaded, "loaded").otherwise("rejected").alias("outcome"), F.when(~loaded, REASONS[2]).alias("reason")).drop("weight")


def facts(cells: DataFrame) -> DataFrame:
    """For each sheet the day it is of (as on or as of, in its first ten rows) and its benchmark (a name with TRI in
    parentheses; that of the benchmark riskometer cell or the two rows below it goes first)."""
    up = Window.partitionBy("sheet_id").orderBy("row_no")
    risk = F.exists("cells", lambda c: F.coalesce(F.lower(c).contains("benchmark") & F.lower(c).contains("riskometer"), F.lit(False)))
    # of most rows no cell tells anything, so the windows sort rows without their cells
    numbered = F.transform("cells", lambda c, i: F.struct(i.alias("column"), c.alias("text")))
    telling = F.filter(numbered, lambda c: F.coalesce(F.lower(c["text"]).contains("as o") | c["text"].contains("("), F.lit(False)))
    each = cells.select("sheet_id", "row_no", F.coalesce(risk, F.lit(False)).alias("risk"), telling.alias("telling"), (F.size("cells") > 0).alias("filled"))
    each = each.withColumns({"place": F.row_number().over(up), "near": F.max("risk").over(up.rowsBetween(-2, 0))}).filter("filled")
    texts = each.select("sheet_id", "row_no", "place", "near", F.inline_outer("telling"))
    words, figures = (F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in (r"(?i)as o[nf]\s+([a-z]+ \d{1,2},?\s*\d{4})", r"(?i)as o[nf]\s+(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"))
    parts = [F.regexp_extract(words, r"([A-Za-z]{3})[a-z]* (\d{1,2}),?\s*(\d{4})", k) for k in (2, 1, 3)]
    day = F.coalesce(F.try_to_date(F.concat_ws(" ", parts[0], F.initcap(parts[1]), parts[2]), "d MMM yyyy"), F.try_to_date(F.translate(figures, "/", "-"), "d-M-yyyy"), F.try_to_date(F.translate(figures, "/", "-"), "d-M-yy"))
    index = F.nullif(F.trim(F.regexp_extract("text", r"\(([A-Za-z0-9&/ ]*\bTRI\b[A-Za-z0-9&/ ]*)\)", 1)), F.lit(""))
    order = F.struct("row_no", "column")
    return texts.groupBy("sheet_id").agg(
        F.min_by(day, F.when((F.col("place") <= 10) & day.isNotNull(), order)).alias("as_of_date"),
        F.min_by(index, F.when(index.isNotNull(), F.struct((~F.col("near")).alias("far"), "row_no", "column"))).alias("benchmark_name"),
    )


def cap_list(cells: DataFrame) -> DataFrame:
    """(sheet_id, isin, market_cap) of lists of companies by size: by a label column, else by the section above, else by the
    order of the rows (100 large, then 150 mid, then small), whichever of them the list has."""
    up = Window.partitionBy("sheet_id").orderBy("row_no")
    sofar = up.rowsBetween(Window.unboundedPreceding, 0)
    text = F.array_join(F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))), " ")
    isin = F.get(F.filter(F.transform("cells", lambda c: F.trim(c)), lambda c: c.rlike(ISIN)), F.lit(0))
    labels = place(F.col("cells"), lambda c: c.contains("market cap") | c.contains("marketcap") | c.contains("category"))
    is_head = place(F.col("cells"), lambda c: c == "isin").isNotNull()
    cap = lambda x: F.when(F.lower(x).contains("large"), "large").when(F.lower(x).contains("mid"), "mid").when(F.lower(x).contains("small"), "small")
    rows = cells.withColumns({"isin": isin, "at": F.when(is_head, labels), "section": F.when(isin.isNull() & ~is_head, cap(F.regexp_extract(F.trim(text), r"(?i)^(large[\s-]+cap|mid[\s-]+cap|small[\s-]+cap)", 1)))})
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(sofar) for c in ("at", "section")}).filter("isin is not null")
    rows = rows.withColumn("rank", F.row_number().over(up))
    whole = Window.partitionBy("sheet_id")
    flat, parted = F.max(F.col("at").isNotNull()).over(whole), F.max(F.col("section").isNotNull()).over(whole)
    ranked = F.when(F.col("rank") <= LARGE, "large").when(F.col("rank") <= MID, "mid").otherwise("small")
    label = F.when(flat, cap(cell(F.col("at")))).when(parted, F.col("section")).otherwise(ranked)
    return rows.select("sheet_id", "isin", label.alias("market_cap")).filter("market_cap is not null")
