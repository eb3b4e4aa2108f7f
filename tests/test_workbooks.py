"""Sheets of workbooks: which is picked, and what becomes of each."""

from navella.sources import grids, workbooks

HEAD = ["", "Name of the Instrument", "ISIN", "Industry / Rating", "Quantity", "Market Value", "% to Net Assets"]


def book(spark, sheets, *asked):
    """sheets: name -> rows of cells, of one file."""
    frames = spark.createDataFrame([("f", f"f/{n}", n) for n in sheets], "file_id string, sheet_id string, sheet_name string")
    cells = spark.createDataFrame([(f"f/{n}", k, row) for n, rows in sheets.items() for k, row in enumerate(rows)], "sheet_id string, row_no int, cells array<string>")
    want = spark.createDataFrame([("f", a, a) for a in asked], "file_id string, scheme_id string, name string")
    return {r["scheme_id"]: (r["sheet_id"] and r["sheet_id"][2:], r["way"], r["reason"]) for r in workbooks.pick_sheets(want, frames, cells).collect()}


def table(title, isin="INE000000001"):
    return [[title, None], HEAD, ["", "Some Company", isin, "Steel", "1", "1", "1.0"]]


def test_an_index_goes_before_titles(spark):
    index = [["List", None], ["Short Code", "Scheme Name"], ["B", "North Gilt  Fund"], ["A", "North Gilt Fund Regular"], ["C", None]]
    sheets = {"Index": index, "A": table("North Gilt Fund"), "B": table("x")}
    assert book(spark, sheets, "North Gilt Fund") == {"North Gilt Fund": ("B", "index", None)}


def test_an_index_without_a_header(spark):
    sheets = {"index ": [["", ""], ["AB", "North Value Fund"], ["CD", "North Gilt Fund"]], "AB": table("-"), "CD": table("-")}
    assert book(spark, sheets, "North Gilt Fund", "North Debt Fund") == {"North Gilt Fund": ("CD", "index", None), "North Debt Fund": (None, None, "not_found")}


def test_titles_equal_contained_and_tied(spark):
    sheets = {"1": table("North Flexicap Fund"), "2": table("North Flexi Cap Fund - Monthly"), "3": table("North Gilt Fund (a)"), "4": table("North Gilt Fund (b)")}
    assert book(spark, sheets, "North Flexi Cap Fund", "North Gilt Fund", "") == {"North Flexi Cap Fund": ("1", "title", None), "North Gilt Fund": (None, None, "ambiguous"), "": (None, None, "not_found")}


def test_the_only_sheet_with_isins_must_name_the_scheme(spark):
    first = [["Monthly statement"], [None, "Portfolio of North Gilt Fund"], *table("")[1:]]
    assert book(spark, {"1": first, "Notes": [["Disclaimer"]]}, "North Gilt Fund", "South Gilt Fund") == {"North Gilt Fund": ("1", "sole", None), "South Gilt Fund": (None, None, "not_found")}
    assert book(spark, {"1": first, "2": table("Other")}, "North Gilt Fund")["North Gilt Fund"] == (None, None, "not_found")


def test_every_sheet_is_in_the_ledger(spark):
    total = [["", "GRAND TOTAL", "", "", "", "1", "1.0"]]
    sheets = {"good": table("a") + total, "wrong": table("a") + [["", "GRAND TOTAL", "", "", "", "1", "0.9"]], "bare": [HEAD, *total], "text": [["notes", None]], "none": [[None]]}
    cells = spark.createDataFrame([(n, k, row) for n, rows in sheets.items() for k, row in enumerate(rows)], "sheet_id string, row_no int, cells array<string>")
    got = {r["sheet_id"]: (r["outcome"], r["reason"], r["n_held"], r["n_rows"]) for r in grids.sheet_outcomes(cells).collect()}
    assert got == {"good": ("loaded", None, 1, 4), "wrong": ("rejected", "not_reconciled", 1, 4), "bare": ("rejected", "no_holdings", 0, 2), "text": ("rejected", "no_table", 0, 1), "none": ("rejected", "no_table", 0, 1)}
    parts = {(r["sheet_id"], r["outcome"], r["pct_nav"]) for r in grids.loaded_and_rejected(cells).collect()}
    assert parts == {("good", "loaded", 1.0), ("wrong", "rejected", 1.0)}


def test_rows_of_sheets_are_read_once(spark):
    cells = spark.createDataFrame([("s", 0, HEAD)], "sheet_id string, row_no int, cells array<string>")
    for found in (grids.reconciliation(grids.grid_rows(cells)), grids.reconciled(grids.grid_rows(cells)), grids.loaded_and_rejected(cells)):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_facts_sort_rows_without_their_cells(spark):
    from navella.sources import grids

    rows = [("a", k, ["x" * 5, f"row {k}", None]) for k in range(1, 14)] + [("a", 14, ["Portfolio as on 31-03-2024"]), ("b", 1, ["Portfolio AS OF 31-03-2024"]), ("b", 2, ["(Broad 100 TRI)"]), ("c", 1, ["nothing"])]
    found = grids.facts(spark.createDataFrame(rows, "sheet_id string, row_no int, cells array<string>"))
    got = {r["sheet_id"]: (str(r["as_of_date"]), r["benchmark_name"]) for r in found.collect()}
    assert got == {"a": ("None", None), "b": ("2024-03-31", "Broad 100 TRI"), "c": ("None", None)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all("cells" not in line for line in plan.splitlines() if "Window" in line) and "telling" in plan


def test_few_windows_hold_a_sheet_and_one_its_cells(spark):
    """A task's memory grows with each of them."""
    cells = spark.createDataFrame([("s", 0, HEAD)], "sheet_id string, row_no int, cells array<string>")
    plan = grids.holdings(grids.grid_rows(cells))._jdf.queryExecution()
    windows = [line for line in plan.optimizedPlan().toString().splitlines() if "Window [" in line]
    below = plan.optimizedPlan().toString().split("Window [")
    assert len(windows) == 4
    assert sum("cells#" in part.split("Project [")[1].splitlines()[0] for part in below[1:] if "Project [" in part) <= 1
    assert plan.sparkPlan().toString().count("Window [") == 4


def test_sections_below_the_header_of_derivatives(spark):
    body = [["", "Derivatives"], ["", "Early", "", "", "5", "1", "0.1"], ["", "Futures"], ["", "x", "Long / Short"], ["", "Options", None, "", "", "3", "0.2"], ["", "Position", "Long", "5", "50", "0.01"]]
    cells = spark.createDataFrame([("s", k, row) for k, row in enumerate([HEAD, *body])], "sheet_id string, row_no int, cells array<string>")
    got = {(r["instrument_name"], r["direction"], r["quantity"], r["section_label"]) for r in grids.derivatives(grids.grid_rows(cells)).collect()}
    assert ("Position", "Long", 5.0, "Options") in got and ("Early", None, 5.0, "Derivatives") in got
