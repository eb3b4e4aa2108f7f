"""Texts and cell grids written out of the views, as inputs of the parsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
OLD_HEAD = "Scheme Code;ISIN Div Payout/ ISIN Growth;ISIN Div Reinvestment;Scheme Name;Net Asset Value;Date"
NEW_HEAD = "Scheme Code;NAV  Name;Plan;Option;ISIN Div Payout/ISIN Growth;ISIN Div Reinvestment;Net Asset Value;Date"


def price_lines(rows: DataFrame) -> DataFrame:
    """(file, line_no, line) of the view price_row: f0 has the old header, f1 one with plan and option columns, f2 none. Each
    house and section stands above its rows; rows without a house come first."""
    name = F.concat_ws(" - ", "base", "plan_text", "option_text")
    blank = F.lit("")
    columns = F.when(F.col("by_columns"), F.concat_ws(";", "base", "plan_text", "option_text")).otherwise(F.concat_ws(";", name, blank, blank))
    new, old = F.concat_ws(";", "code", columns, "isin1", "isin2", "nav_text", "date_text"), F.concat_ws(";", "code", "isin1", "isin2", name, "nav_text", "date_text")
    body = rows.select("file", "house", "header", F.col("n").cast("long").alias("n"), F.when(F.col("file") == "f1", new).otherwise(old).alias("line"))
    above = rows.select("file", "house", "header").distinct()
    texts = F.array(F.lit(""), F.col("house"), F.col("header"), F.lit("short;row"))
    body = body.unionByName(above.select("file", "house", "header", F.posexplode(texts).alias("k", "line")).select("file", "house", "header", (F.col("k") - 10).cast("long").alias("n"), "line"))
    heads = rows.select("file").distinct().filter("file <> 'f2'").select("file", F.lit("").alias("house"), F.lit("").alias("header"), F.lit(-20).cast("long").alias("n"), F.when(F.col("file") == "f1", NEW_HEAD).otherwise(OLD_HEAD).alias("line"))
    order = Window.partitionBy("file").orderBy("house", "header", "n")
    return body.unionByName(heads).select("file", F.row_number().over(order).alias("line_no"), "line")


def day_words(day: Column) -> Column:
    """March 31, 1995."""
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day))
    return F.concat(month, F.lit(" "), F.dayofmonth(day).cast("string"), F.lit(", "), F.year(day).cast("string"))


def holding_sheets(holdings: DataFrame) -> DataFrame:
    """(sheet_id, row_no, cells) of a holdings sheet for each snapshot of the view holding. Odd and even schemes have
    different column orders; scheme-2 has percent points, scheme-3 a total that is wrong, scheme-4 none, scheme-5 lacks
    its largest holding, scheme-6 has derivatives in the main table."""
    sheet = F.concat_ws("/", "scheme_id", F.col("as_of_date").cast("string"))
    h = holdings.withColumns({"sheet_id": sheet, "scale": F.when(F.col("scheme_id") == "scheme-2", 100.0).otherwise(1.0)})
    h = h.withColumn("place", F.row_number().over(Window.partitionBy("sheet_id").orderBy(F.desc("pct_nav"), "instrument_name")))
    h = h.filter("not (scheme_id = 'scheme-5' and place = 1)")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    odd = F.substring("scheme_id", -1, 1).cast("int") % 2 == 1
    weight = (F.col("pct_nav") * F.col("scale")).cast("string")

    def line(name, isin, industry, quantity, value, pct):
        return F.when(odd, F.array(isin, name, F.lit("x"), industry, quantity, value, pct)).otherwise(F.array(F.lit(None).cast("string"), name, isin, industry, quantity, value, pct))

    part = {"equity": 1, "foreign": 2, "debt": 3, "cash": 5}
    number = F.coalesce(*(F.when(F.col("asset_class") == k, v) for k, v in part.items()))
    rows = h.select("sheet_id", "scheme_id", number.alias("part"), (F.col("place") + 100).alias("n"), line(F.col("instrument_name"), text("isin"), F.col("industry_or_rating"), text("quantity"), text("market_value"), weight).alias("cells"))
    sums = h.groupBy("sheet_id", "scheme_id", "as_of_date", "scale").agg(F.sum(F.when(F.col("asset_class") == "debt", F.col("pct_nav"))).alias("debt"), F.sum("market_value").alias("value"))
    e = F.lit("")
    own = lambda label: line(F.lit(label), e, e, e, e, e)
    day = F.when(odd, F.concat(F.lit("Portfolio as of "), F.date_format("as_of_date", "dd-MM-yyyy"))).otherwise(F.concat(F.lit("Monthly Portfolio Statement as on "), day_words(F.col("as_of_date"))))
    total = F.when(F.col("scheme_id") == "scheme-3", 0.97).when(F.col("scheme_id") != "scheme-4", F.col("scale"))
    side = F.col("scheme_id") != "scheme-6"
    fixed = [
        (0, 1, F.array(e, day, e)), (0, 2, F.array(e, F.lit("equity and equity related notes above the table"), e)),
        (0, 3, F.when(odd, F.array(*map(F.lit, ("ISIN", "Name of Instrument", "Code", "Industry", "Quantity", "Mkt Val (Lakhs)", "Percentage to Net Assets")))).otherwise(F.array(*map(F.lit, ("", "Name of the Instrument", "ISIN", "Industry / Rating", "Quantity", "Market Value (Rs. in Lakhs)", "% to Net Assets"))))),
        (1, 1, own("A) Equity & Equity Related")), (1, 2, own("(a) Listed / awaiting listing")), (1, 900000, line(F.lit("Sub Total"), e, e, e, F.lit("1"), F.lit("0.5"))),
        (2, 1, own("Foreign Securities and Equity Related Instruments")), (2, 2, own("Nil")),
        (3, 1, own("Debt Instruments")), (3, 2, line(F.lit("Unlisted Notes"), e, e, e, F.lit("9"), (F.col("debt") * F.col("scale")).cast("string"))),
        (4, 1, own("Derivatives")), (4, 2, F.when(side, F.array(e, F.lit("Instrument"), F.lit("Long / Short"), e, e, e, e))), (4, 3, F.array(e, F.lit("Index Futures"), e, e, e, e, e)),
        (4, 4, F.when(odd, F.array(e, F.lit("Broad Future"), F.lit("Long"), F.lit("5"), F.lit("50"), F.lit("0.01"), e)).when(side, F.array(e, F.lit("Broad Future"), F.lit("(Short)"), F.lit("5"), F.lit("50"), F.lit("0.01"), e)).otherwise(line(F.lit("Broad Future"), e, e, F.lit("5"), F.lit("50"), F.lit("0.01")))),
        (5, 1, own("Others")), (5, 2, own("TREPS / Reverse Repo")), (5, 3, line(F.lit("Cash Margin"), e, e, e, F.lit("0"), F.lit("0"))),
        (6, 1, line(F.lit("Net Current Assets"), e, e, e, F.lit("0"), F.lit("0"))), (6, 2, line(F.lit("GRAND TOTAL"), e, e, e, F.col("value").cast("string"), total.cast("string"))), (6, 3, line(F.lit("After The Total"), F.lit("INE999999999"), e, e, F.lit("1"), F.lit("0.2"))),
        (7, 1, own("Benchmark Riskometer")), (7, 2, own("of the index (Broad 500 TRI)")), (8, 1, own("Notes: see below")), (8, 2, line(F.lit("Past The Notes"), F.lit("INE999999998"), e, e, F.lit("1"), F.lit("0.2"))), (8, 3, own("returns (Other 100 TRI)")),
    ]
    frames = sums.select("sheet_id", "scheme_id", F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.lit(n).alias("n"), c.alias("cells")) for p, n, c in fixed))).alias("r")).select("sheet_id", "scheme_id", "r.*").filter("cells is not null")
    # numbers in order, though not in a row, so no window holds the cells of a sheet
    row_no = F.coalesce("part", F.lit(-1)).cast("long") * (1 << 40) + F.col("n")
    return rows.unionByName(frames).select("sheet_id", row_no.alias("row_no"), "cells")


def workbooks(schemes: DataFrame) -> dict[str, DataFrame]:
    """files, asked, sheets and cells of workbooks of the view combined_scheme, one a house. By turns a workbook has an index
    and sheets under codes; sheets under their titles, two of them alike; one scheme's sheet beside others without isins;
    and one isn't a workbook. The sixth scheme's sheet doesn't add up, the seventh's is empty, an index lacks the tenth."""
    rows = schemes.withColumn("h", F.floor(F.col("n") / 10)).withColumn("kind", F.col("h") % 4)
    code = F.concat(F.lit("S"), F.col("i").cast("string"))
    rows = rows.select(F.col("source_doc").alias("file_id"), "scheme_id", "name", "i", "kind", "h", F.concat_ws("/", "source_doc", code).alias("sheet_id"), code.alias("code"))
    files = rows.select("file_id", F.when(F.col("kind") == 3, "html").otherwise("xlsx").alias("kind")).distinct()
    own = rows.filter("kind < 2 and not (kind = 0 and i = 9) or kind = 2 and i = 0")
    title = F.when(F.col("kind") == 1, F.when(F.col("i") == 4, F.regexp_replace("name", "Gilt", "Liquid")).otherwise(F.upper("name"))).otherwise("Monthly statement")
    cells = lambda *x: F.array(*(c if isinstance(c, Column) else F.lit(c) for c in x))
    isin = F.concat(F.lit("INE"), F.lpad((F.col("h") * 10 + F.col("i")).cast("string"), 9, "0"))
    weight = F.when(F.col("i") == 5, "0.5").otherwise("1.0")
    body = [cells(title, ""), F.when(F.col("kind") == 2, cells("", F.concat(F.lit("Portfolio of "), "name"))), cells("", "Name of the Instrument", "ISIN", "Industry / Rating", "Quantity", "Market Value", "% to Net Assets"), F.when(F.col("i") != 6, cells("", "Some Company", isin, "Steel", "10", "100", weight)), cells("", "GRAND TOTAL", "", "", "", "100", "1.0")]
    each = own.select("sheet_id", F.posexplode(F.array(*body)).alias("row_no", "cells")).filter("cells is not null")
    listed = rows.filter("kind = 0 and i < 9").select(F.concat("file_id", F.lit("/Index")).alias("sheet_id"), (F.col("i") + 2).cast("int").alias("row_no"), cells(F.col("code"), F.lower("name")).alias("cells"))
    heads = rows.filter("kind = 0 and i = 0 and h % 8 = 0").select(F.concat("file_id", F.lit("/Index")).alias("sheet_id"), F.lit(1).alias("row_no"), cells("Fund Code", "Fund Name").alias("cells"))
    notes = rows.filter("kind = 2 and i = 0").select(F.concat("file_id", F.lit("/Notes")).alias("sheet_id"), F.lit(1).alias("row_no"), cells("Disclaimer", "").alias("cells"))
    sheets = own.select("file_id", "sheet_id", F.col("code").alias("sheet_name"))
    more = listed.unionByName(notes).select(F.substring_index("sheet_id", "/", 1).alias("file_id"), "sheet_id", F.substring_index("sheet_id", "/", -1).alias("sheet_name")).distinct()
    asked = rows.filter("kind <> 3 or i = 0").select("file_id", "scheme_id", "name")
    return {"files": files, "asked": asked, "sheets": sheets.unionByName(more), "cells": each.unionByName(listed).unionByName(heads).unionByName(notes)}


def cap_sheets(caps: DataFrame) -> DataFrame:
    """(sheet_id, row_no, cells) of the view ranked_part: its lists in three layouts, by label column, by section, by rank."""
    kind = F.year("effective_date") % 4
    e = F.lit("")
    isin, name = F.col("isin"), F.concat(F.lit("Company "), "isin")
    rank = F.col("rk")
    line = F.when(kind == 0, F.array(rank.cast("string"), name, isin, F.concat(F.initcap("market_cap"), F.lit(" Cap")))).otherwise(F.array(e, isin, name))
    rows = caps.select("effective_date", (rank * 10).alias("n"), line.alias("cells"))
    heads = caps.groupBy("effective_date").agg(F.max("rk").alias("most"))
    first = F.when(kind == 0, F.array(*map(F.lit, ("Sr. No.", "Company", "ISIN", "Categorization as per norms")))).otherwise(F.array(F.lit("Sr"), F.lit("ISIN"), F.lit("Company")))
    parts = [(1, first), *((n, F.when(kind == 1, F.array(e, F.lit(t), e))) for n, t in ((2, "Large Cap"), (1005, "Mid-Cap companies"), (2505, "small cap")))]
    frames = heads.select("effective_date", "most", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), c.alias("cells")) for n, c in parts))).alias("r")).select("effective_date", F.col("r.n").alias("n"), "r.cells").filter("cells is not null")
    order = Window.partitionBy("effective_date").orderBy("n")
    return rows.unionByName(frames).select(F.col("effective_date").cast("string").alias("sheet_id"), F.row_number().over(order).alias("row_no"), "cells")


FIRST = ("Arun", "Bela", "Chitra", "Dev", "Esha", "Farid", "Gita")


def factsheets(rows: DataFrame) -> DataFrame:
    """(doc_id, scheme_id, doc_date, page_number, text) of the view factsheet: a page with the managers, the inception date
    and expense ratios, in a layout of its own."""
    pick = lambda k: F.element_at(F.array(*map(F.lit, FIRST)), ((F.col("n") + k) % 7 + 1).cast("int"))
    one, two = F.concat(pick(0), F.lit(" Rao")), F.concat(pick(3), F.lit(" Mehta"))
    start = F.concat(F.lit("May "), F.col("day_no").cast("string"), F.lit(", "), F.col("year_no").cast("string"))
    until = F.when(F.col("leaves"), " (Effective till July 01, 2026)").otherwise("")
    second = F.when(F.col("comes"), "October 01, 2026").otherwise("January 15, 2020")
    titled = F.concat(F.lit("Mr. "), one, until, F.lit("\nDirector\nTotal Experience: 32 Years\nManaging Since: Since Inception\nMs. "), two, F.lit("\nManaging Since: "), second)
    parens = F.concat(one, F.lit("\n"), F.lit("x"), F.lit("\n"), one, F.lit(" (Managing this fund since "), start, F.lit(")"), until, F.lit("\n"), two, F.lit(" (Managing since "), second, F.lit(")"))
    table = F.concat(F.lit("FUND MANAGER\nName Since Total Exp\n"), one, until, F.lit("\n"), one, F.lit(" (Gold) "), start, F.lit("\nMr. "), two, F.lit(" 18 years "), second)
    people = F.when(F.col("layout") == "titled", titled).when(F.col("layout") == "parenthesis", parens).otherwise(table)
    pct = lambda c: F.format_string("%d.%02d", F.floor(c / 100).cast("int"), (c % 100).cast("int"))
    direct, regular = pct(F.col("direct_bps")), pct(F.col("direct_bps") + 70)
    ter = F.concat(F.lit("Total Expense Ratio (TER)\n Direct Plan:   "), direct, F.lit("%*\n Regular Plan:  "), regular, F.lit("%*"))
    ber = F.concat(F.lit("Expense Ratio\nOther : "), regular, F.lit("% p. a.  Direct : "), direct, F.lit("% p. a.\n\nBase Expense Ratio as on the last day"))
    both = F.concat(F.lit("Expense Ratio\nPlan  TER   BER\nRegular  "), regular, F.lit("%  1.39%\nDirect  "), direct, F.lit("%  0.22%\n"))
    costs = F.when(F.col("kind") == 0, ter).when(F.col("kind") == 1, ber).otherwise(both)
    text = F.concat_ws("\n", F.lit("Direct Plan 9.99 returns"), people, F.concat(F.lit("Date of Inception / Allotment: "), start), costs, F.lit("Expense ratio history\nDirect: 4.44%"))
    return rows.select("doc_id", "scheme_id", "doc_date", F.lit(1).alias("page_number"), text.alias("text"))


def combined_pages(schemes: DataFrame) -> DataFrame:
    """(doc_id, page_number, text) of combined factsheets of the view combined_scheme: an index of all names, the schemes' own
    pages, some shared, one with a column of text before its title, and a page of risk labels with every title."""
    own = schemes.filter("page_number is not null")
    text = F.concat(F.when(F.col("i") == 2, F.lit("Returns of one year\nDirect 12.50\n")).otherwise(F.lit("")), "above", "own")
    ordered = F.array_sort(F.collect_list(F.struct("n", text.alias("text"))))
    pages = own.groupBy(F.col("source_doc").alias("doc_id"), "page_number").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))
    names = F.array_sort(F.collect_list(F.struct("n", "name")))
    listed = schemes.groupBy(F.col("source_doc").alias("doc_id")).agg(names.alias("names"))
    index = listed.select("doc_id", F.lit(1).alias("page_number"), F.concat(F.lit("Contents\n"), F.array_join(F.transform("names", lambda x: x["name"]), "\n")).alias("text"))
    risk = F.array_join(F.transform("names", lambda x: F.concat(x["name"], F.lit("\nAn open ended scheme"))), "\n")
    labels = listed.select("doc_id", F.lit(99).alias("page_number"), F.concat(F.lit("Riskometers as on July 31, 2026\n"), risk).alias("text"))
    return pages.unionByName(index).unionByName(labels)


def with_figures(schemes: DataFrame) -> DataFrame:
    """The view combined_scheme with basis points as percents on its pages (101 as 1.01%) also from a hundred on, where the view
    puts them behind "0." as they are (0.101%)."""
    bps = F.col("direct_bps").cast("string")
    own = F.col("own")
    for whole in (1, 0):
        pct = F.format_string("%d.%02d%%", F.floor(F.col("direct_bps") / 100).cast("int") + whole, F.col("direct_bps") % 100)
        own = F.replace(own, F.concat(F.lit(f"{whole}."), bps, F.lit("%")), pct)
    return schemes.withColumn("own", F.when(F.col("direct_bps") >= 100, own).otherwise(F.col("own")))


#: What notices say: several wordings of each kind, in either voice; the SQL of notice_events has what they mean.
SAID = (
    "Mr. Alan Stone has ceased to manage the scheme w.e.f. 1st September 2026. Ms. Beth Rivers ceases to be the Fund Manager of the scheme.",
    "Dated 15-03-2026. The trustees appointed Mr. Carl Field as fund manager with effect from 05-10-2026.",
    "Notice of a change\nin the fund manager of the scheme, effective from 2 Oct 2026.",
    "Revision of the investment objective of the scheme w.e.f. 2026-12-01.",
    "There is a change in the benchmark of the scheme.\nExisting benchmark: Narrow 50 TRI\nRevised benchmark: Broad 100 TRI\nEffective from: 01/11/26",
    "The Total Expense Ratio (TER) of the scheme shall be revised from 1.50% to 1.25% p.a.",
    "Temporary suspension of fresh subscription in the scheme with effect from 3rd August 2026.",
    "",
    "Ms. Dora Hill and Mr. Eric Vale have been appointed as additional fund managers w.e.f. 01-09-2026.",
    "Mr. Alan Stone has resigned as Fund Manager of the scheme.",
    "The scheme is being re-categorised from Flexi Cap to Multi Cap with effect from 01-01-2027.",
    "Redemption of units is suspended in the scheme.",
    "The benchmark of the scheme is changed from Narrow 50 TRI to Broad 100 TRI effective from 7 July 2026.",
    "MR. CARL FIELD HAS BEEN APPOINTED AS FUND MANAGER. MR. CARL FIELD HAS BEEN APPOINTED AS FUND MANAGER.",
    "The asset allocation pattern stands modified w.e.f 12.06.2026.",
    "Merger of schemes is proposed. Letters dated 2026-05-05 were sent.",
)


def notices(documents: DataFrame) -> DataFrame:
    """(doc_id, doc_date, text): documents with what a notice says put behind their texts, by turns."""
    said = F.element_at(F.array(*map(F.lit, SAID)), (F.col("doc_id") % len(SAID) + 1).cast("int"))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n" + "-" * 500 + "\n"), said, F.lit("\n" + "-" * 500))
    return documents.select("doc_id", F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 200).cast("int")).alias("doc_date"), text.alias("text"))
