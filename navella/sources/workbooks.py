"""Which sheet of a workbook holds a scheme's portfolio, and what becomes of each file.

A workbook is a few hundred sheets at most, so names meet sheets within their file, by an equality join on the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navella.operators.factsheets import name_key
from navella.sources.grids import ISIN, cell, place

#: The name of a sheet that lists schemes and their sheets, and words by which its columns are known.
INDEX = "index"
NAME_WORDS = ("fund name", "scheme name")
CODE_WORDS = ("fund code", "scheme code", "short code", "short name", "acronym")
#: Rows of a sheet in which its title may stand, and the longest code of a list without a header.
TITLE_ROWS, CODE_LENGTH = 8, 12
#: How a sheet is found, the surest first.
WAYS = ("index", "title", "sole")


def has_word(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def index_entries(sheets: DataFrame, cells: DataFrame) -> DataFrame:
    """(file_id, row_no, name, code) listed in the sheets called Index: in the columns that a header row names, or, without
    one, a short code without blanks in the first column and a longer name in the second, from the first such row on."""
    rows = cells.join(sheets.filter(F.lower(F.trim("sheet_name")) == INDEX).select("file_id", "sheet_id"), "sheet_id")
    at = F.struct(place(F.col("cells"), lambda c: has_word(c, NAME_WORDS)).alias("name"), place(F.col("cells"), lambda c: has_word(c, CODE_WORDS)).alias("code"))
    rows = rows.withColumn("head", F.when(at["name"].isNotNull() & at["code"].isNotNull(), at))
    up = Window.partitionBy("sheet_id").orderBy("row_no")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    first, second = cell(F.lit(1)), cell(F.lit(2))
    pair = F.coalesce((F.length(first) <= CODE_LENGTH) & ~first.contains(" ") & (F.length(second) > F.length(first)), F.lit(False))
    rows = rows.withColumns({"at": F.first("head", ignorenulls=True).over(before), "headed": F.max(F.col("head").isNotNull()).over(Window.partitionBy("sheet_id")), "paired": F.max(pair).over(up)})
    name = F.when(F.col("headed"), cell(F.col("at.name"))).when(F.col("paired"), second)
    code = F.when(F.col("headed"), cell(F.col("at.code"))).when(F.col("paired"), first)
    return rows.select("file_id", "row_no", name.alias("name"), code.alias("code")).filter("name is not null and code is not null")


def titles(sheets: DataFrame, cells: DataFrame) -> DataFrame:
    """(file_id, sheet_id, keys, first_key, has_isin) of sheets other than an index: the keys of all cells of the first rows, that
    of the first row's first filled cell, and whether a row of the sheet has an isin."""
    place_no = F.row_number().over(Window.partitionBy("sheet_id").orderBy("row_no"))
    each = cells.select("sheet_id", place_no.alias("nth"), F.filter(F.transform("cells", lambda c: F.trim(c)), lambda c: c != "").alias("filled"))
    isin = F.exists("filled", lambda c: c.rlike(ISIN))
    top = F.when(F.col("nth") <= TITLE_ROWS, F.transform("filled", name_key))
    found = each.groupBy("sheet_id").agg(F.flatten(F.collect_list(top)).alias("keys"), F.max(F.when(F.col("nth") == 1, name_key(F.get("filled", F.lit(0))))).alias("first_key"), F.max(isin).alias("has_isin"))
    return sheets.filter(F.lower(F.trim("sheet_name")) != INDEX).join(found, "sheet_id").select("file_id", "sheet_id", "sheet_name", "keys", "first_key", "has_isin")


def likeness(name: Column, target: Column) -> Column:
    """0 for equal keys, 1 where one holds the other, null otherwise."""
    named = (name != "") & (target != "")
    return F.when(named & (name == target), 0).when(named & (name.contains(target) | target.contains(name)), 1)


def pick_sheets(asked: DataFrame, sheets: DataFrame, cells: DataFrame) -> DataFrame:
    """For each asked file_id, scheme_id and name the sheet that is the scheme's: sheet_id, way and reason. sheets: file_id,
    sheet_id, sheet_name; cells: sheet_id, row_no, cells. In order: the sheet whose code an index gives for the
    name; the sheet whose title is the name; the only sheet with isins, if it names the scheme at its top. Equal names go
    before such as hold one another; if two sheets do as well in the first way that finds any, none is picked and the reason
    is ambiguous, as a guess could give a scheme another's holdings; without any it is not_found."""
    keyed = asked.select("file_id", "scheme_id", name_key(F.col("name")).alias("target"))
    top = titles(sheets, cells)
    listed = index_entries(sheets, cells).select("file_id", name_key(F.col("name")).alias("key"), F.trim("code").alias("sheet_name"))
    by_index = keyed.join(listed, "file_id").withColumn("rank", likeness(F.col("key"), F.col("target"))).filter("rank is not null")
    by_index = by_index.join(sheets.select("file_id", "sheet_id", F.trim("sheet_name").alias("sheet_name")), ["file_id", "sheet_name"])
    pairs = keyed.join(top, "file_id")
    by_title = pairs.withColumn("rank", likeness(F.coalesce("first_key", F.lit("")), F.col("target"))).filter("rank is not null")
    alone = F.count_if("has_isin").over(Window.partitionBy("file_id", "scheme_id")) == 1
    sole = pairs.withColumn("alone", alone).filter("alone and has_isin and target <> ''").filter(F.exists("keys", lambda k: k.contains(F.col("target")))).withColumn("rank", F.lit(0))
    found = None
    for k, rows in enumerate((by_index, by_title, sole)):
        part = rows.select("file_id", "scheme_id", "sheet_id", F.struct(F.lit(k).alias("way"), "rank").alias("by"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("file_id", "scheme_id", "by").agg(F.min("sheet_id").alias("sheet_id"), F.count_distinct("sheet_id").alias("n"))
    best = best.groupBy("file_id", "scheme_id").agg(F.min_by(F.struct("by", "sheet_id", "n"), "by").alias("best"))
    rows = asked.select("file_id", "scheme_id").join(best, ["file_id", "scheme_id"], "left")
    one = F.col("best.n") == 1
    way = F.element_at(F.array(*map(F.lit, WAYS)), F.col("best.by.way") + 1)
    reason = F.when(F.col("best").isNull(), "not_found").when(~one, "ambiguous")
    return rows.select("file_id", "scheme_id", F.when(one, F.col("best.sheet_id")).alias("sheet_id"), F.when(one, way).alias("way"), reason.alias("reason"))


def file_outcomes(files: DataFrame, picks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """What became of each asked file: file_id, scheme_id, outcome (ingested, or skipped_format, skipped_sheet_not_found,
    skipped_ambiguous_multi_sheet, skipped_no_holdings, skipped_reconciliation_failed). files: file_id, kind (see sniff);
    picks: of pick_sheets; outcomes: of sheet_outcomes."""
    rows = picks.join(files.select("file_id", "kind"), "file_id", "left").join(outcomes.select("sheet_id", F.col("reason").alias("why")), "sheet_id", "left")
    outcome = (
        F.when(~F.coalesce("kind", F.lit("")).isin("xlsx", "xls_biff"), "skipped_format").when(F.col("reason") == "not_found", "skipped_sheet_not_found")
        .when(F.col("reason") == "ambiguous", "skipped_ambiguous_multi_sheet").when(F.col("why") == "not_reconciled", "skipped_reconciliation_failed")
        .when(F.col("why").isNotNull(), "skipped_no_holdings").otherwise("ingested")
    )
    return rows.select("file_id", "scheme_id", outcome.alias("outcome"))
