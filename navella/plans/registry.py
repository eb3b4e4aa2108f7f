"""The registry of queries and the SQL that DuckDB checks them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navella.functions.provenance import with_provenance
from navella.sources.views import load, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: How each query's rows are known, where not by calculation.
KIND_OF = {
    "official": ("price_file_rows", "daily_plans", "daily_schemes", "daily_houses", "daily_prices", "history_prices", "notice_events", "cap_list_classes", "sheet_holdings", "sheet_derivatives", "latest_plan_costs"),
    "observed": ("sheet_managers", "managers_in_office", "combined_managers", "manager_change_events", "manager_spells", "name_changes", "name_assignments", "document_freshness", "sheet_ledger", "workbook_loads"),
    "approximation": ("benchmark_trailing", "benchmark_relative", "succession_flags", "suspected_successions"),
    "inferred": ("name_resolution", "name_resolution_of_all", "fund_search", "name_lookup"),
}


def with_envelope(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's rows with the envelope that tells how they are known, by which query over which tables."""
    kind = next((k for k, names in KIND_OF.items() if name in names), "calculated")
    read: list[str] = []
    rows = BUILDS[name](lambda table: read.append(table) or load(spark, sf_dir, table), spark)
    return with_provenance(rows, kind, name, {"rounded": ROUNDED[name]} if ROUNDED[name] else {}, tuple(read))


BUILDS: dict[str, Callable] = {}
ROUNDED: dict[str, dict[str, int]] = {}


def query(sql: str = "", views: str = "", **rounded: int):
    """Registers a query; its columns named in rounded are rounded to so many places, as the SQL does. views: those that
    the SQL reads; it goes on after them, with a + in front where it adds named parts of its own."""

    def put(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = build(lambda table: load(spark, sf_dir, table), spark)
            return found.withColumns({c: F.round(c, k) for c, k in rounded.items()}) if rounded else found

        QUERIES[build.__name__], BUILDS[build.__name__], ROUNDED[build.__name__] = run, build, rounded
        if sql:
            more = sql.lstrip()
            own = more.startswith("+")
            ORACLES[build.__name__] = sql if not views else with_views(*views.split()) + (", " + more[1:] if own else " " + more)
        return build

    return put
