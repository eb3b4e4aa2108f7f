"""Small cases worked out by hand."""

import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from navella.operators import disclosures as d
from navella.operators import nav as n
from navella.operators import portfolio as p
from navella.sources import price_files as f

NAV = "plan_id string, date date, nav double"
HOLDING = "scheme_id string, as_of_date date, isin string, instrument_name string, industry_or_rating string, quantity double, market_value double, pct_nav double, asset_class string"


def series(spark, *rows):
    return spark.createDataFrame([("p", date.fromisoformat(a), float(b)) for a, b in rows], NAV)


def test_growth_over_two_years(spark):
    row = n.trailing(series(spark, ("2020-01-01", 100), ("2022-01-01", 200))).first()
    assert row["cagr_inception"] == pytest.approx(2 ** (365.25 / 731) - 1)
    assert row["cagr_5y"] is None


def test_growth_under_a_year_is_the_simple_return(spark):
    assert n.trailing(series(spark, ("2024-01-01", 100), ("2024-07-01", 110))).first()["cagr_inception"] == pytest.approx(0.10)


def test_window_takes_the_price_on_or_before(spark):
    nav = series(spark, ("2021-01-04", 50), ("2021-01-08", 52))
    row = n.window_returns(nav, {"gap": ("2021-01-06", "2021-01-09"), "before": ("2020-01-01", "2021-01-09")}).first()
    assert row["gap"] == pytest.approx(0.04)
    assert row["before"] is None


def test_sharpe_of_two_returns(spark):
    row = n.risk(series(spark, ("2021-01-01", 100), ("2021-01-02", 101), ("2021-01-03", 99.99))).first()
    assert row["sharpe"] == pytest.approx(-0.065 / (math.sqrt(0.0002) * math.sqrt(252)))


def test_no_losses_no_sortino(spark):
    assert n.risk(series(spark, *((f"2021-01-0{k + 1}", 100 + k) for k in range(5)))).first()["sortino"] is None


def test_drawdown_with_recovery_and_without(spark):
    row = n.drawdowns(series(spark, ("2020-01-01", 100), ("2020-02-01", 120), ("2020-03-01", 90), ("2020-04-01", 130))).first()
    assert (str(row["peak_date"]), str(row["trough_date"]), str(row["recovery"]), row["depth"]) == ("2020-02-01", "2020-03-01", "2020-04-01", -0.25)
    assert n.drawdowns(series(spark, ("2020-01-01", 100), ("2020-02-01", 60))).first()["recovery"] is None
    assert n.drawdowns(series(spark, ("2020-01-01", 100), ("2020-02-01", 95))).count() == 0


def test_rolling_against_a_plain_loop(spark):
    import random

    random.seed(3)
    day, rows = date(2019, 1, 1), []
    for _ in range(500):
        day += timedelta(days=random.choice((1, 1, 2, 3, 9)))
        rows.append((day, random.uniform(50, 150)))
    want = {}
    for at, value in rows:
        first = next(((a, v) for a, v in rows if 0 <= (a - (at - timedelta(days=365))).days <= 5 and a <= at), None)
        if first:
            want[at] = value / first[1] - 1
    got = {r["date"]: r["ret"] for r in n.rolling_returns(spark.createDataFrame([("p", *r) for r in rows], NAV), 1).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_rolling_over_years_is_not_annualised(spark):
    rows = n.rolling_returns(series(spark, ("2020-01-02", 100), ("2023-01-01", 154.9)), 3).collect()
    assert [(str(r["date"]), r["ret"]) for r in rows] == [("2023-01-01", pytest.approx(0.549))]


def test_peers_are_ranked_at_one_anchor(spark):
    nav = spark.createDataFrame([(p_, date.fromisoformat(a), v) for p_, a, v in (("p1", "2020-01-01", 100.0), ("p1", "2023-06-01", 200.0), ("p2", "2020-01-01", 100.0), ("p2", "2023-01-01", 150.0), ("p2", "2023-06-01", 120.0), ("p2", "2024-01-01", 900.0))], NAV)
    plans = spark.createDataFrame([("p1", "s1", "Direct", "Growth", True), ("p2", "s2", "Direct", "Growth", True)], "plan_id string, scheme_id string, plan_type string, option_type string, active boolean")
    schemes = spark.createDataFrame([("s1", "One", "E", "M"), ("s2", "Two", "E", "M")], "scheme_id string, name string, category string, sub_category string")
    got = {r["scheme_id"]: (r["rank"], r["n"], r["percentile"]) for r in n.category_ranks(schemes, plans, nav, 3, "2023-06-01").collect()}
    assert got == {"s1": (1, 2, 100.0), "s2": (2, 2, 50.0)}


def test_gap_takes_growth_plans_alone(spark):
    days = [date(2024, 1, 1) + timedelta(days=k) for k in range(40)]
    nav = spark.createDataFrame([(p_, d_, 100.0 * (1 + r) ** k) for p_, r in (("d", 0.0002), ("i", 0.01), ("r", 0.0001)) for k, d_ in enumerate(days)], NAV)
    plans = spark.createDataFrame([("d", "s", "Direct", "Growth"), ("i", "s", "Direct", "IDCW"), ("r", "s", "Regular", "Growth")], "plan_id string, scheme_id string, plan_type string, option_type string")
    row = n.cost_gap(plans, nav).first()
    assert (row["n"], row["gap_bps"]) == (39, pytest.approx(math.log(1.0002 / 1.0001) * 2520000, abs=0.06))


def held(spark, *rows):
    return spark.createDataFrame([("s", date.fromisoformat(day), isin, name, "x", q, v, pct, "equity") for day, isin, name, q, v, pct in rows], HOLDING)


def test_actions_and_flags(spark):
    old, new = "2024-01-31", "2024-02-29"
    rows = [(old, "A", "a", 1000.0, 1.0, 0.05), (new, "A", "a", 1200.0, 1.0, 0.06), (old, "B", "b", 100.0, 1.0, 0.05), (new, "B", "b", 100.0, 1.0, 0.07), (old, "C", "c", 1000.0, 1.0, 0.05), (new, "C", "c", 2000.0, 1.0, 0.0505), (old, "D", "d", 9.0, 1.0, 0.01), (new, None, "e", 9.0, 1.0, 0.01), (old, "F", "f", 1000.0, 1.0, 0.05), (new, "F", "f", 1730.0, 1.0, 0.0505)]
    got = {r["key"]: r for r in p.changes(held(spark, *rows)).collect()}
    assert {k: r["action"] for k, r in got.items()} == {"A": "INCREASED", "B": "PRICE_FLOW_DRIFT", "C": "INCREASED", "D": "EXITED", "NAME::e": "NEW", "F": "INCREASED"}
    assert got["C"]["flags"] == ["corporate_action_suspected"] and got["C"]["confidence"] == "low"
    assert got["F"]["flags"] == [] and got["NAME::e"]["flags"] == ["name_keyed_no_isin"]
    assert got["B"]["flags"] == ["qty_flat_pct_nav_moved"] and got["B"]["confidence"] == "low"
    assert got["A"]["quantity_change"] == 200 and got["D"]["quantity_change"] == -9


def test_what_is_not_known_stays_unknown(spark):
    old, new = "2024-01-31", "2024-02-29"
    rows = [(old, "A", "a", 1000.0, 1.0, 0.05), (new, "A", "a", 1003.0, 1.0, 0.05), (old, "B", "b", None, 1.0, 0.05), (new, "C", "c", None, 2.0, None), (old, "", "n1", 1.0, 1.0, 0.1), (old, "", "n2", 1.0, 1.0, 0.1), (new, "", "n1", 1.0, 1.0, 0.1)]
    got = {r["key"]: r for r in p.changes(held(spark, *rows)).collect()}
    assert got["A"]["flags"] == ["corporate_action_suspected"]
    assert (got["B"]["action"], got["B"]["quantity_change"], got["B"]["pct_change"]) == ("EXITED", None, -0.05)
    assert (got["C"]["action"], got["C"]["quantity_change"], got["C"]["pct_change"], got["C"]["value_change"]) == ("NEW", None, None, 2.0)
    assert {k: r["action"] for k, r in got.items() if k.startswith("NAME::")} == {"NAME::n1": "UNCHANGED", "NAME::n2": "EXITED"}


def test_holding_that_comes_back(spark):
    rows = [("2024-01-31", "A", "a", 1.0, 1.0, 0.1), ("2024-01-31", "Z", "z", 1.0, 1.0, 0.1), ("2024-02-29", "Z", "z", 1.0, 1.0, 0.1), ("2024-03-31", "A", "a", 2.0, 1.0, 0.1), ("2024-03-31", "Z", "z", 1.0, 1.0, 0.1)]
    got = {(str(r["as_of_date"]), r["key"]): r["action"] for r in p.changes(held(spark, *rows)).collect()}
    assert got == {("2024-02-29", "A"): "EXITED", ("2024-02-29", "Z"): "UNCHANGED", ("2024-03-31", "A"): "NEW", ("2024-03-31", "Z"): "UNCHANGED"}


def test_successions_are_flagged_on_both_rows(spark):
    rows = [("2024-01-31", "A", "First Bank Limited", 1.0, 100.0, 0.1), ("2024-02-29", "B", "First Bank Ltd", 1.0, 105.0, 0.1), ("2024-02-29", "E", "Else", 1.0, 900.0, 0.1)]
    got = {r["key"]: (r["flags"], r["confidence"]) for r in p.with_successions(p.changes(held(spark, *rows))).collect()}
    assert got == {"A": (["isin_change_suspected"], "low"), "B": (["isin_change_suspected"], "low"), "E": ([], "high")}


def test_rename_wins_over_merger(spark):
    rows = [("2024-01-31", "A", "First Bank Limited", 1.0, 100.0, 0.1), ("2024-02-29", "B", "First Bank Ltd", 1.0, 105.0, 0.1), ("2024-01-31", "C", "Quartz Mining", 1.0, 400.0, 0.1), ("2024-02-29", "D", "Delta Foods", 1.0, 420.0, 0.1)]
    got = {(r["old_key"], r["new_key"]): r["suspicion"] for r in p.suspected_successions(p.changes(held(spark, *rows))).collect()}
    assert got == {("A", "B"): "isin_change_suspected", ("C", "D"): "possible_corporate_action_merger"}


def test_streaks(spark):
    rows = [("2024-01-31", "A", "a", 1.0, 1.0, 0.1), ("2024-02-29", "A", "a", 1.0, 1.0, 0.1), ("2024-03-31", "B", "b", 1.0, 1.0, 0.1)]
    assert {r["key"]: (r["held"], r["streak"]) for r in p.persistence(held(spark, *rows)).collect()} == {"A": (2, 0), "B": (1, 1)}


def test_gaps(spark):
    rows = [(day, "A", "a", 1.0, 1.0, 0.1) for day in ("2024-06-30", "2024-08-31", "2024-09-30")]
    assert [(r["days"], r["periods"]) for r in p.gaps(held(spark, *rows)).collect()] == [(62, 2)]


def test_overlap_is_weighed_on_each_side(spark):
    rows = [("a", "1", 30.0), ("a", "2", 20.0), ("b", "1", 10.0), ("b", "3", 25.0)]
    df = spark.createDataFrame([(s, date(2024, 1, 31), i, i, "x", 1.0, 1.0, w, "equity") for s, i, w in rows], HOLDING)
    row = p.overlap(df).first()
    assert (row["overlap_a"], row["overlap_b"], row["common"]) == (30.0, 10.0, 1)


def test_size_classes_never_use_a_later_list(spark):
    caps = spark.createDataFrame([("A", "large", date(2026, 7, 1)), ("B", "mid", date(2026, 7, 1))], "isin string, market_cap string, effective_date date")
    rows = [(day, i, i, 1.0, 1.0, w) for day in ("2026-06-30", "2026-08-31") for i, w in (("A", 0.4), ("B", 0.3))]
    got = {str(r["as_of_date"]): (r["large"], r["mid"], r["small"], r["n_classified"]) for r in p.cap_allocation(held(spark, *rows), caps).collect()}
    assert got == {"2026-08-31": (0.4, 0.3, 0.0, 2), "2026-06-30": (None,) * 4}


def test_price_text(spark):
    text = "Scheme Code;ISIN Div Payout/ ISIN Growth;ISIN Div Reinvestment;Scheme Name;Net Asset Value;Date\n\nOpen Ended(Equity Scheme - Mid Cap)\n\nNorth House\n\n1;INF1;-;North Mid Direct Growth;12.5;01-Feb-2024\n2;Redeemed;INF2;North Mid Regular IDCW;N.A.;02-Feb-24\nshort;row\n"
    got = f.parse_price_text(spark.createDataFrame([("f", text)], "file string, value string")).orderBy("code").collect()
    assert [(r["code"], r["isin"], r["isin_reinvest"], r["nav"], str(r["date"]), r["house"], r["category"], r["sub_category"]) for r in got] == [("1", "INF1", None, 12.5, "2024-02-01", "North House", "Equity Scheme", "Mid Cap"), ("2", None, "INF2", None, "2024-02-02", "North House", "Equity Scheme", "Mid Cap")]


def test_clean_ratios_are_the_nearest_of_small_fractions(spark):
    rows = [(100.0, 100 * x) for x in (2.0, 1.5, 0.2, 0.126, 1.0, 1.0000001, 7 / 5, 8 / 7, 11.0, 12.0, 1.334, 0.0, -2.0, 1.21, float("nan"), float("inf"))] + [(0.0, 5.0), (None, 5.0), (5.0, None)]

    def plain(old, new):
        if not old or new is None or not 0 < (r := new / old) < float("inf") or abs(r - 1) < 1e-6:
            return False
        off, d, n = min((abs(r - round(r * d) / d), d, round(r * d)) for d in range(1, 9))
        return off < 0.005 and n + d <= 12

    df = spark.createDataFrame(rows, "old double, new double").withColumn("is", p.clean_ratio(F.col("old"), F.col("new")))
    assert [r["is"] for r in df.collect()] == [plain(*r) for r in rows]
    assert "transform" not in df._jdf.queryExecution().executedPlan().toString()


def test_changes_and_upserts_shuffle_rows_once_before_they_sort(spark):
    def shuffles(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    rows = spark.createDataFrame([(1, "a", 1.0)], "k long, v string, x double")
    plan = f.upsert(rows, rows, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange") > plan.rindex("SortAggregate")
    # one of the holdings, two of the snapshots
    assert shuffles(p.changes(held(spark, ("2026-06-30", "A", "A", 1.0, 1.0, 0.1)))) == 3


def test_upkeep(spark):
    rows = lambda *r: spark.createDataFrame(r, "k long, v string")
    got = {tuple(r) for r in f.upsert(rows((1, "a"), (2, "b")), rows((2, "c"), (3, "d")), ["k"]).collect()}
    assert got == {(1, "a"), (2, "c"), (3, "d")}
    assert f.upsert(rows((1, "a")), rows((1, "a")), ["k"]).count() == 1
    assert {tuple(r) for r in f.insert_absent(rows((1, "a")), rows((1, "z"), (2, "b")), ["k"]).collect()} == {(1, "a"), (2, "b")}
    months = f.pending_months(spark, "2024-01-15", "2024-03-10", spark.createDataFrame([(date(2024, 2, 1),)], "month date"))
    assert [tuple(map(str, r[1:])) for r in months.orderBy("month").collect()] == [("2024-01-15", "2024-01-31"), ("2024-03-01", "2024-03-10")]


def test_stream_is_idempotent(spark, tmp_path):
    from navella.streaming.price_stream import price_table, watch

    landing, table = tmp_path / "in", tmp_path / "t"
    landing.mkdir()
    (landing / "a.txt").write_text("Scheme Code;Scheme Name;X;Y;Net Asset Value;Date\n1;a;;;10;01-Feb-2024\n1;a;;;11;02-Feb-2024\n")
    watch(spark, str(landing), str(table), str(tmp_path / "c")).awaitTermination()
    (landing / "b.txt").write_text("Scheme Code;Scheme Name;X;Y;Net Asset Value;Date\n1;a;;;12;02-Feb-2024\n")
    watch(spark, str(landing), str(table), str(tmp_path / "c")).awaitTermination()
    (landing / "c.txt").write_text("Scheme Code;Scheme Name;X;Y;Net Asset Value;Date\n1;a;;;13;02-Mar-2024\n")
    watch(spark, str(landing), str(table), str(tmp_path / "c")).awaitTermination()
    assert sorted((str(r["date"]), r["nav"]) for r in price_table(spark, str(table)).read().collect()) == [("2024-02-01", 10.0), ("2024-02-02", 12.0), ("2024-03-02", 13.0)]


def test_price_lines_without_a_header_and_with_columns(spark):
    text = "9;INF1;-;Old Fund - Direct Plan - IDCW Payout;7.5;01-Feb-2024\nClose Ended Schemes ( Income )\nNorth House\n8;;INF2;Nippon Growth Fund - Growth;1;2-Feb-24\n"
    rows = f.parse_price_text(spark.createDataFrame([("f", text)], "file string, value string"))
    got = {r["code"]: (r["house"], r["nav"], str(r["date"]), r["category"], r["sub_category"]) for r in rows.collect()}
    assert got == {"9": (None, 7.5, "2024-02-01", None, None), "8": ("North House", 1.0, "2024-02-02", "Income", "")}
    known = {r["code"]: (r["base"], r["plan_type"], r["option_type"], r["amc_id"]) for r in f.identified(rows).collect()}
    assert known == {"8": ("Nippon Fund", None, "Growth", "amc-north-house")}
    assert f.daily_frames(rows)["counts"].first()["suspicious"] is False


def test_kinds_of_files(spark):
    rows = [("a", b"PK\x03\x04xx"), ("b", bytes.fromhex("D0CF11E0A1B11AE1")), ("c", b"%PDF-1.7"), ("d", b" <!DOCTYPE html><p>"), ("e", b"hello"), ("f", b"%PDF-1.7")]
    got = {r["path"]: (r["kind"], r["n"]) for r in f.new_files(spark.createDataFrame(rows, "path string, content binary"), spark.createDataFrame([], "sha256 string")).collect()}
    assert got == {"a": ("xlsx", 1), "b": ("xls_biff", 1), "c": ("pdf", 2), "d": ("html", 1), "e": ("unknown", 1)}


def test_statuses_and_words(spark):
    rows = [(1, 1, "text"), (1, 2, " "), (2, 1, ""), (2, 2, None), (3, None, None)]
    got = {r["doc_id"]: (r["pages"], r["status"]) for r in d.parse_status(spark.createDataFrame(rows, "doc_id long, page_number int, text string")).collect()}
    assert got == {1: (2, "parsed"), 2: (2, "unparseable_scanned"), 3: (0, "unparseable")}
    from pyspark.sql import functions as F

    row = spark.range(1).select(d.words(F.lit("The Midcap Growth-Option, of  Acme")).alias("w"), d.headings(F.lit("a\n  asset allocation PATTERN x\nbenchmark\nRisk Factorsy")).alias("h")).first()
    assert (row["w"], row["h"]) == (["mid", "cap", "acme"], ["Asset Allocation Pattern"])


def test_former_names_and_no_match(spark):
    from navella.operators import funds as u

    plans = spark.createDataFrame([("s1", "SBI Large Cap Fund", "North", "INF1", "101"), ("s2", "Acme Mid Cap Fund", "Acme House", "INF2", "102")], "scheme_id string, name string, house string, isin string, code string")
    asked = spark.createDataFrame([("a", "SBI Bluechip Fund"), ("b", "inf2"), ("c", "midcap acme"), ("d", "acme house"), ("e", "nothing here"), ("f", "sbi large cap fund"), ("g", "")], "query_id string, text string")
    got = {r["query_id"]: (r["scheme_id"], r["confidence"], r["via"]) for r in u.resolve_funds(asked, plans).collect()}
    assert got == {"a": ("s1", 0.6, "former_name"), "b": ("s2", 1.0, "literal"), "c": ("s2", 0.6, "word_match"), "d": ("s2", 0.5, "literal"), "e": (None, None, "no_match"), "f": ("s1", 0.95, "literal"), "g": (None, None, "no_match")}


def test_successions_are_counted_as_their_pairs_are(spark):
    from difflib import SequenceMatcher
    from random import Random

    rnd = Random(7)
    stems = ["first bank limited", "first bank ltd", "first bnk limited", "quartz mining", "quartz minings co", "delta foods", "", "x", "7 10 2031 govt stock", "7 11 2031 govt stock"]
    value = lambda: rnd.choice([0.0, None, 100.0, 80.0, 120.0, 125.0, 83.33333333333333, 99.99999999999999, rnd.uniform(60, 200), 0.3, 0.36])
    rows = [(day, f"{day[-2:]}{i}", rnd.choice(stems), 1.0, value(), 0.1) for day in ("2024-01-31", "2024-02-29") for i in range(40)]
    changed = p.changes(held(spark, *rows))
    sides = {a: [r for r in changed.collect() if r["action"] == a] for a in ("EXITED", "NEW")}
    expected = {r["key"]: set() for s in sides.values() for r in s}
    for o in sides["EXITED"]:
        for n in sides["NEW"]:
            x, y, v, w = o["name"], n["name"], abs(o["value_change"] or 0.0), abs(n["value_change"] or 0.0)
            alike = bool(x and y) and SequenceMatcher(None, x, y).ratio() >= p.SIMILAR_NAMES
            if alike or (v > 0 and abs(w / v - 1) < 0.2):
                for r in (o, n):
                    expected[r["key"]].add("isin_change_suspected" if alike else "possible_corporate_action_merger")
    assert {len(x) for x in expected.values()} == {0, 1, 2}
    assert {r["key"]: set(r["more"]) for r in p.counted_successions(p.succession_sides(changed)).collect()} == expected


def test_snapshots_are_numbered_without_their_holdings(spark):
    rows = [("2024-01-31", "A", "a", 1.0, 1.0, 0.1), ("2024-02-29", "B", "b", 1.0, 1.0, 0.1), ("2024-02-29", "A", "a", 1.0, 1.0, 0.1), ("2024-03-31", "A", "a", 1.0, 1.0, 0.1)]
    found = p.persistence(held(spark, *rows))
    assert {r["key"]: (r["held"], r["streak"]) for r in found.collect()} == {"A": (3, 3), "B": (1, 0)}
    assert "dense_rank" not in found._jdf.queryExecution().optimizedPlan().toString()
