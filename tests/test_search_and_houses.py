"""Search by words and characters, successions, houses, provenance and ladders, against plain versions and by hand."""

import random
from datetime import date
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from navella.functions import provenance
from navella.operators import disclosures as d
from navella.operators import funds, houses, nav, portfolio


def test_containing_is_that_of_all_pairs(spark):
    rng = random.Random(3)
    strings = {"".join(rng.choice("ab c") for _ in range(rng.randint(0, 9))) for _ in range(120)} | {"", "aaaa", "日本語 fund"}
    texts = {"".join(rng.choice("ab c") for _ in range(rng.randint(1, 4))) for _ in range(60)} | {"本", "本語", "zzz", "a" * 12}
    got = {tuple(r) for r in d.containing(spark.createDataFrame([(t,) for t in texts], "q string"), spark.createDataFrame([(s,) for s in strings], "s string")).collect()}
    assert got == {(t, s) for t in texts for s in strings if t in s}


def test_search_has_no_nested_loop(spark):
    plans = spark.createDataFrame([("s1", "North Fund", "North", "INF1", "101")], "scheme_id string, name string, house string, isin string, code string")
    asked = spark.createDataFrame([("a", "nor")], "query_id string, text string")
    plan = funds.literal_matches(asked, plans)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_literal_matches_take_equal_texts_once(spark):
    plans = spark.createDataFrame([(f"s{k:02}", "North Fund" if k == 30 else f"North Fund {k}", "House", f"INF{k}", f"{k}") for k in range(40)], "scheme_id string, name string, house string, isin string, code string")
    asked = spark.createDataFrame([(f"q{k}", t) for k, t in enumerate([" North fund"] * 20 + ["INF7", "", None, "nowhere"])], "query_id string, text string")
    got = funds.literal_matches(asked, plans, 3)
    found = {(r["query_id"], r["scheme_id"], r["confidence"]) for r in got.collect()}
    assert found == {(f"q{k}", s, c) for k in range(20) for s, c in (("s30", 0.95), ("s00", 0.7), ("s01", 0.7))} | {("q20", "s07", 1.0)}


def test_resolve_is_that_of_all_pairs(spark):
    rng = random.Random(4)
    vocabulary = ["north", "south", "gilt", "value", "cap", "fund", "large", "rare"]
    names = [(f"s{i}", " ".join(rng.sample(vocabulary[:7], rng.randint(1, 4))) + (" rare" if i == 7 else "")) for i in range(60)]
    asked = [(f"q{i}", " ".join(rng.choices([*vocabulary, "absent", "the"], k=rng.randint(0, 3)))) for i in range(40)]
    stop = set(d.STOP_WORDS)
    words = lambda t: {w for w in t.split() if w not in stop}
    want = {(q, s) for q, t in asked for s, n in names if words(t) and words(t) <= words(n)}
    got = {(r["query_id"], r["scheme_id"]) for r in d.resolve(spark.createDataFrame(asked, "query_id string, text string"), spark.createDataFrame(names, "scheme_id string, name string"), 1000).collect()}
    assert got == want


def test_names_that_are_alike_share_letters(spark):
    """No pair of the ratio asked for is ruled out by its shared letters, of any made by a few edits."""
    rng = random.Random(6)
    pairs = []
    for _ in range(3000):
        a = "".join(rng.choice("abc d") for _ in range(rng.randint(1, 24)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 2)] = rng.choice(["", "x", "a", "ab"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    shared = F.size(F.array_intersect(portfolio.pairs_of_letters(F.col("a")), portfolio.pairs_of_letters(F.col("b"))))
    kept = df.select("a", "b", (shared >= portfolio.least_shared(F.length("a"), F.length("b"))).alias("kept")).collect()
    alike = [r for r in kept if SequenceMatcher(None, r["a"], r["b"]).ratio() >= portfolio.SIMILAR_NAMES]
    assert len(alike) > 500 and all(r["kept"] for r in alike)
    assert sum(r["kept"] for r in kept) < len(kept)


def test_houses_under_all_their_names(spark):
    pairs = lambda *r: spark.createDataFrame(r, "house string, now string")
    own = spark.createDataFrame([("D House",), ("Lone & Co",)], "house string")
    chain = pairs(*((f"{a} House", f"{b} House") for a, b in zip("ABC", "BCD", strict=True)), ("Old D", "D House"), ("D House", "D House"))
    found = houses.canonical_houses(own, chain)
    assert {r["house"]: r["canonical"] for r in found.collect()} == {**{f"{a} House": "D House" for a in "ABCD"}, "Old D": "D House", "Lone & Co": "Lone & Co"}
    assert {r["canonical_id"]: r["ids"] for r in houses.house_ids(found).collect()} == {"amc-d-house": ["amc-d-house", "amc-a-house", "amc-b-house", "amc-c-house", "amc-old-d"], "amc-lone-co": ["amc-lone-co"]}
    with pytest.raises(ValueError, match="circle"):
        houses.canonical_houses(own, pairs(("x", "y"), ("y", "x")))


def test_registration_overwrites_nothing(spark):
    schemes = spark.createDataFrame([("1", "One", "a", True), ("2", "Two", "a", True), ("3", "Three", "a", False), ("4", "Four", None, True), ("1", "One", "b", True)], "scheme_id string, name string, amc_id string, active boolean")
    hints = spark.createDataFrame([("1", "a", "by hand")], "scheme_id string, amc_id string, hint string")
    once = houses.registered(schemes, hints)
    assert {tuple(r) for r in once.collect()} == {("1", "a", "by hand"), ("2", "a", "Two"), ("1", "b", "One")}
    assert {tuple(r) for r in houses.registered(schemes, once).collect()} == {tuple(r) for r in once.collect()}


def test_envelopes(spark):
    rows = spark.createDataFrame([("k", 1)], "id string, v int")
    a = provenance.with_provenance(rows, "official", "read", {"file": "f"}, ("s2", "s1"))
    b = provenance.with_provenance(rows.select("id", F.col("v").alias("w")), "approximation", "guess", sources=("s3",), caveat=F.lit("by name"))
    got = provenance.joined(a, b, ["id"], "left", "ratio", {"of": "v/w"}).first()["provenance"]
    assert (got["kind"], got["method"], got["params"], got["source_id"], got["caveat"]) == ("approximation", "ratio", {"of": "v/w"}, ["s1", "s2", "s3"], "by name")
    lone = provenance.joined(a, b.filter("false"), ["id"], "left", "ratio").first()["provenance"]
    assert (lone["kind"], lone["source_id"], lone["caveat"]) == ("official", ["s1", "s2"], None)
    again = provenance.with_provenance(b, "calculated", "double").first()["provenance"]
    assert (again["kind"], again["method"], again["source_id"]) == ("approximation", "double", ["s3"])
    with pytest.raises(ValueError, match="none of"):
        provenance.envelope("rumour", "x")
    with pytest.raises(ValueError, match="method"):
        provenance.envelope("official", "")


def test_every_query_has_an_envelope(spark, sf_dir):
    from navella.plans import QUERIES
    from navella.plans.registry import BUILDS, KIND_OF, with_envelope

    assert BUILDS.keys() == QUERIES.keys()
    row = with_envelope("trailing_returns", spark, sf_dir).first()["provenance"]
    assert (row["kind"], row["method"], row["source_id"]) == ("calculated", "trailing_returns", ["nav_point"])
    assert with_envelope("sheet_ledger", spark, sf_dir).first()["provenance"]["kind"] == "observed"
    assert all(k in provenance.KINDS for k in KIND_OF)


def test_ladder_by_the_calendar(spark):
    rows = [("p", date.fromisoformat(x), v) for x, v in (("2020-02-28", 100.0), ("2020-03-01", 300.0), ("2023-02-28", 110.0), ("2024-02-29", 121.0))]
    row = nav.calendar_ladder(spark.createDataFrame(rows, "plan_id string, date date, nav double"), (1, 4, 0.5, 10)).first()
    assert row["cagr_1y"] == pytest.approx(1.1 ** (365.25 / 366) - 1)
    assert row["cagr_4y"] == pytest.approx(1.21 ** (365.25 / 1462) - 1)
    assert row["cagr_0_5y"] == pytest.approx(1.1 ** (365.25 / 366) - 1) and row["cagr_10y"] is None


def test_cadences(spark):
    rows = [("s", "2026-06-30", "monthly"), ("s", "2026-08-31", "monthly"), ("s", "2026-09-15", "fortnightly"), ("s", "2026-09-30", "fortnightly"), ("s", None, "monthly"), ("s", "2026-10-20", "weekly"), ("t", "2026-07-31", "monthly"), ("t", "2026-08-31", "monthly")]
    df = spark.createDataFrame([(s, x and date.fromisoformat(x), c) for s, x, c in rows], "scheme_id string, as_of_date date, cadence string")
    got = {(r["scheme_id"], str(r["as_of_date"]), r["days"], r["periods"], r["why"]) for r in portfolio.cadence_gaps(df).collect()}
    assert got == {("s", "2026-08-31", 62, 2, "gap"), ("s", "2026-09-15", 15, None, "cadence_changed")}


HOLDING = "scheme_id string, as_of_date date, isin string, instrument_name string, industry_or_rating string, quantity double, market_value double, pct_nav double, asset_class string"


def test_overlap_of_a_requested_set(spark):
    held = [("a", "1", 30.0), ("a", "2", 20.0), ("b", "1", 10.0), ("b", "2", 45.0), ("c", "9", 5.0)]
    df = spark.createDataFrame([(s, date(2024, 1, 31), i, f"Name {i}", "x", 1.0, 1.0, w, "equity") for s, i, w in held], HOLDING)
    asked = spark.createDataFrame([("q", x) for x in ("a", "b", "c", "none")] + [("r", "a")], "set_id string, scheme_id string")
    got = {(r["scheme_id_a"], r["scheme_id_b"]): r for r in portfolio.overlap_within(df, asked).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("a", "none"), ("b", "c"), ("b", "none"), ("c", "none")}
    row = got["a", "b"]
    assert (row["overlap_a"], row["overlap_b"], row["overlap"], row["common"], row["total_a"]) == (50.0, 55.0, 52.5, 2, 2)
    assert [(x["isin"], x["name"], x["mean"]) for x in row["holdings"]] == [("2", "Name 2", 32.5), ("1", "Name 1", 20.0)]
    zero = got["c", "none"]
    assert (zero["overlap"], zero["common"], zero["total_a"], zero["total_b"], zero["holdings"]) == (0.0, 0, 1, 0, [])


def test_page_search_by_a_text_and_without_terms(spark):
    rows = [("d", 1, "Risk Factors\nthe fund's risk"), ("d", 2, "risk risk"), ("d", 3, "none"), ("d", 4, None)]
    pages = spark.createDataFrame(rows, "doc_id string, page_number int, text string")
    pick = lambda *a: [(r["page_number"], r["score"]) for r in d.search_pages(pages, *a).orderBy("rank").collect()]
    assert pick("RISK, fund's", 1000) == [(1, 3), (2, 2)]
    assert pick("", 1000) == [(1, 0), (2, 0), (3, 0)]
    assert pick(["risk"], 1000, ["risk factors"]) == [(1, 2)] and pick(["risk"], 1000, ["unknown"]) == []


def test_equal_texts_are_resolved_once(spark):
    from navella.operators import disclosures as d

    schemes = spark.createDataFrame([(f"s{i}", f"Blue Chip {i}") for i in range(12)], "scheme_id string, name string")
    asked = spark.createDataFrame([(f"q{i}", "chip blue") for i in range(3)] + [("one", "Blue chip 7"), ("none", None)], "query_id string, text string")
    found = d.resolve(asked, schemes, 2)
    got = sorted((r["query_id"], r["scheme_id"], r["confidence"], r["rank"]) for r in found.collect())
    assert got == [("one", "s7", 0.95, 1)] + [(f"q{i}", s, 0.6, k) for i in range(3) for k, s in ((1, "s0"), (2, "s1"))]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(text#" in plan and "windowspecdefinition(query_id#" not in plan
