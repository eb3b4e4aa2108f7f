"""Notices, factsheets, managers and expense ratios: cases worked out by hand, in wordings and layouts of their own."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from navella.functions.dates import date_after, leading_date
from navella.operators import expenses, factsheets, managers, notices

DAY = date(2026, 8, 1)


def d(text):
    return date.fromisoformat(text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1st September 2026 x", "2026-09-01"), (": 03-Oct-26", "2026-10-03"), ("Sept. 9, 2026", "2026-09-09"), ("July, 2021 & overall", "2021-07-01"), ("Dec-2024", "2024-12-01"), ("2026-02-03", "2026-02-03"),
        ("5/6/07", "2007-06-05"), ("1.9.2026.", "2026-09-01"), ("31-02-2026", None), ("12.50%", None), ("Marketing 2026", None), ("of May 2026", "2026-05-01"), ("", None), ("the 3rd of June 2020", None),
    ],
)
def test_dates_at_the_beginning(spark, text, want):
    assert spark.range(1).select(leading_date(F.lit(text))).first()[0] == (want and d(want))


def test_dates_behind_a_cue(spark):
    text = "Dated 15-08-2026. Change w.e.f. the date below; effective from 01-09-2026, with effect from 02-09-2026"
    assert spark.range(1).select(date_after(F.lit(text), notices.EFFECTIVE)).first()[0] == d("2026-09-01")


def said(spark, *texts):
    df = spark.createDataFrame([(i, DAY, t) for i, t in enumerate(texts)], "doc_id int, doc_date date, text string")
    return {i: sorted((r["event"], r["sub_type"], r["before"], r["after"], str(r["effective_date"])) for r in rows) for i, rows in group(notices.notice_signals(df).collect()).items()}


def group(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], []).append(r)
    return out


def none_last(rows):
    return sorted(rows, key=lambda r: tuple("" if x is None else x for x in r))


def manager(sub, name, day="2026-08-01"):
    return ("manager_change", sub, *((None, name) if sub == "appointment" else (name, None)), day)


NOTICES = [
    ("Mr. Omar Lind has been appointed as the fund manager of the scheme w.e.f. 04 September 2026.", [manager("appointment", "Omar Lind", "2026-09-04")]),
    ("The board appointed Ms. Pia K. Moss as additional fund manager with effect from 4-9-26.", [manager("appointment", "Pia K. Moss", "2026-09-04")]),
    ("Appointment of Mr. Omar Lind and Dr. Rita O'Shea as Fund Managers", [manager("appointment", "Omar Lind"), manager("appointment", "Rita O'Shea")]),
    ("Mr. Sam Todd will cease to be the fund manager. Effective from 2026-10-01.", [manager("cessation", "Sam Todd", "2026-10-01")]),
    ("Ms. Uma Voss has stepped down from the role of fund manager.", [manager("cessation", "Uma Voss")]),
    ("Resignation of Mr. Sam Todd as fund manager; Mr. Omar Lind is hereby appointed as fund manager.", [manager("cessation", "Sam Todd"), manager("appointment", "Omar Lind")]),
    ("Investors may note a change of the fund manager.", [manager("change", None)]),
    ("The fund manager of the scheme has been changed.", [manager("change", None)]),
    ("He was appointed as auditor. Mr. Sam Todd resigned as director.", [("addendum", None, None, None, "2026-08-01")]),
    ("The benchmark stands revised.\nExisting Benchmark: Old 100 Index\nNew benchmark: New 200 Index", [("benchmark_change", None, "Old 100 Index", "New 200 Index", "2026-08-01")]),
    ("Change in benchmark. The existing benchmark: Old 100 TRI will be revised benchmark: New 200 TRI effective from 01-10-2026.", [("benchmark_change", None, "Old 100 TRI", "New 200 TRI", "2026-10-01")]),
    ("TER is reduced to 0.90% from 1.10%, w.e.f. 3 May 2026.", [("ter_change", None, "0.90%", "1.10%", "2026-05-03")]),
    ("Increase in the total expense ratio of the plan.", [("ter_change", None, None, None, "2026-08-01")]),
    ("The scheme is recategorized as a value fund.", [("category_change", None, None, None, "2026-08-01")]),
    ("Change in the investment objective of the scheme", [("category_change", None, None, None, "2026-08-01"), ("mandate_revision", None, None, None, "2026-08-01")]),
    ("The investment strategy has been modified.", [("mandate_revision", None, None, None, "2026-08-01")]),
    ("Permanent closure of fresh subscription from tomorrow", [("addendum", None, None, "subscription_suspension", "2026-08-01")]),
    ("Redemptions are halted.", [("addendum", None, None, "redemption_suspension", "2026-08-01")]),
    ("Dated 15-08-2026. Change in the fund manager, effective from 01-09-2026", [manager("change", None, "2026-09-01")]),
    (None, [("addendum", None, None, None, "2026-08-01")]),
    ("", [("addendum", None, None, None, "2026-08-01")]),
    ("TER changed from 1.50% to 1.25%. Mr. Omar Lind has been appointed as fund manager. " + "x " * 400 + " w.e.f. 01-01-2030", [("ter_change", None, "1.50%", "1.25%", "2026-08-01"), manager("appointment", "Omar Lind")]),
]


def test_notices_in_both_voices(spark):
    texts = [t for t, _ in NOTICES]
    df = spark.createDataFrame([(i, DAY, t) for i, t in enumerate(texts)], "doc_id int, doc_date date, text string")
    got = group(notices.notice_signals(df).collect())
    for i, (text, want) in enumerate(NOTICES):
        rows = [(r["event"], r["sub_type"], r["before"], r["after"], str(r["effective_date"])) for r in got[i]]
        assert none_last(rows) == none_last(want), text


def test_excerpts_and_repeated_statements(spark):
    text = "a" * 100 + " Mr. Omar Lind has been appointed\nas fund manager. Mr. Omar Lind has been appointed as fund manager. " + "b" * 400
    rows = notices.notice_signals(spark.createDataFrame([(1, DAY, text)], "doc_id int, doc_date date, text string")).collect()
    assert len(rows) == 1
    at = text.index("Mr.")
    end = text.index("manager.") + len("manager")
    assert rows[0]["excerpt"] == text[at - 50 : end + 200].replace("\n", " ").strip() and rows[0]["confidence"] == "official"


def test_notices_take_one_scan_and_no_shuffle(spark):
    df = spark.createDataFrame([(1, DAY, "x")], "doc_id int, doc_date date, text string")
    plan = notices.notice_signals(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


TWO_SCHEMES = """Performance of the year
NORTH GATE LARGE-CAP FUND
An open ended equity scheme
Large Cap Fund
Fund Manager: Mr. Omar Lind
North Gate Gilt Fund (see page 9)
North Gate Gilt Fund
(Erstwhile North Gate Bond Fund)
Fund Manager: Ms. Pia Moss"""


def test_two_schemes_on_one_page(spark):
    pages = [("f", 1, "Index\nNorth Gate Large Cap Fund\nNorth Gate Gilt Fund"), ("f", 2, TWO_SCHEMES), ("f", 3, "Fund Manager: Mr. Sam Todd\n\nNorth Gate Liquid Fund\nDetails as on July 31, 2026"), ("f", 4, "Riskometers as on July 31\nNorth Gate Gilt Fund\nAn open-ended scheme"), ("f", 5, None), ("g", 2, "South Gate Gilt Fund\nAn open-ended scheme")]
    schemes = [("l", "North Gate Large Cap Fund"), ("g", "North Gate Gilt Fund"), ("q", "North Gate Liquid Fund"), ("n", "North Gate Value Fund"), ("e", "")]
    pages, schemes = spark.createDataFrame(pages, "doc_id string, page_number int, text string"), spark.createDataFrame(schemes, "scheme_id string, name string")
    got = {(r["doc_id"], r["scheme_id"], r["page_number"]): (r["text"], r["sole_title"]) for r in factsheets.scheme_segments(pages, schemes).collect()}
    lines = TWO_SCHEMES.split("\n")
    # the line that only mentions the gilt fund is longer than its name, so it is another title of the house, and ends the first segment
    assert got == {("f", "l", 2): ("\n".join(lines[1:5]), False), ("f", "g", 2): ("\n".join(lines[6:]), False), ("f", "q", 3): ("Fund Manager: Mr. Sam Todd\n\nNorth Gate Liquid Fund\nDetails as on July 31, 2026", True)}
    people = {(r["doc_id"], r["name"]) for r in managers.managers(factsheets.attributed(pages, schemes)).collect()}
    assert people == {("f/l", "Omar Lind"), ("f/g", "Pia Moss"), ("f/q", "Sam Todd")}


PEOPLE = [
    ("Fund Manager*: Mr. Omar T. Lind & \nMs. Pia O'Moss\nother", {"Omar T. Lind": None, "Pia O'Moss": None}),
    ("Managed by: Sam Todd, Uma Voss and Omar Lind (w.e.f. 3-May-2019)", {"Sam Todd": "2019-05-03", "Uma Voss": None, "Omar Lind": None}),
    ("FUND MANAGER ¥ \nName Since Total Exp \nPia Moss February \n01, 2022 \nOver 19 \nyears\nSam \nTodd \n(Gold/Silver \nMetals) \nAugust \n26,2023 \nOver 31 \nyears", {"Pia Moss": "2022-02-01", "Sam Todd": "2023-08-26"}),
    ("Name of Fund \nManagers\nTotal \nExperience\nManaging \nSince\nMr. Omar \nLind 18 years Dec-2021", {"Omar Lind": "2021-12-01"}),
    ("Uma Voss \n(Managing this fund since July, 2020\n& Overall 18 years)", {"Uma Voss": "2020-07-01"}),
    ("Dr. J. D'Souza-Hill: Head of Equity\nTotal Experience: 32 Years\nManaging Since: Since Inception\nMr. Sam Todd, trustee", {"J. D'Souza-Hill": "2015-01-01"}),
    ("Fund Manager: Overseas Investment\nTotal Exp: none", {}),
]


def test_names_in_four_layouts(spark):
    pages = spark.createDataFrame([(i, t, d("2015-01-01")) for i, (t, _) in enumerate(PEOPLE)], "doc_id int, text string, inception date")
    got = {i: {} for i in range(len(PEOPLE))}
    for r in managers.managers(pages).collect():
        got[r["doc_id"]][r["name"]] = r["managing_since"] and str(r["managing_since"])
    for i, (text, want) in enumerate(PEOPLE):
        assert got[i] == want, text


OBSERVED = "scheme_id string, doc_date date, name string, managing_since date"


def observed(spark, *rows):
    return spark.createDataFrame([("s", d(day), name, since and d(since)) for day, name, since in rows], OBSERVED)


def test_changes_of_managers(spark):
    days = ["2026-01-31", "2026-02-28", "2026-03-31", "2026-04-30", "2026-05-31", "2026-06-30", "2026-07-31"]
    rows = [
        (days[0], "Ranjana Gupta", None), (days[0], "Sam Todd", None),
        (days[1], "Ranjhana Gupta", "2019-01-01"), (days[1], "Sam Todd", None),  # respelled: no change
        (days[2], "Ranjhana Gupta", None), (days[2], "Sam Todd", None), (days[2], "Omar Lind", "2020-05-05"),  # overlooked before: no change
        # an empty read in April; May has nothing to be compared with
        (days[4], "Omar Lind", None), (days[5], "Omar Lind", None), (days[5], "Uma Voss", "2026-06-15"), (days[6], "Amit Ganatra", None), (days[6], "Uma Voss", None),
    ]
    documents = spark.createDataFrame([("s", d(x)) for x in days], "scheme_id string, doc_date date")
    got = sorted((str(r["doc_date"]), r["before"], r["after"], r["added"], r["departed"]) for r in managers.manager_changes(documents, observed(spark, *rows)).collect())
    assert got == [("2026-06-30", ["Omar Lind"], ["Omar Lind", "Uma Voss"], ["Uma Voss"], []), ("2026-07-31", ["Omar Lind", "Uma Voss"], ["Amit Ganatra", "Uma Voss"], ["Amit Ganatra"], ["Omar Lind"])]


def test_each_name_is_in_one_pair_of_spellings():
    assert managers.respelled(["Ana Maria Lopez", "Ana Mariah Lopez"], ["Ana Marria Lopez"]) == (["Ana Mariah Lopez"], [])
    assert managers.respelled(["Amit Sinha"], ["Amit Ganatra"]) == (["Amit Sinha"], ["Amit Ganatra"])
    assert managers.respelled([], ["A B"]) == ([], ["A B"]) and managers.same_person("", "x") == 0


def test_spells_with_stated_starts(spark):
    rows = [
        ("2026-01-31", "A B", None), ("2026-02-28", "A B", "2025-06-01"), ("2026-03-31", "C D", "2026-03-10"), ("2026-04-30", "A B", "2026-04-02"), ("2026-04-30", "C D", "2026-01-01"), ("2026-05-31", "A B", "2026-04-20"),
    ]
    want = {("A B", "2025-06-01", "2026-03-31", True), ("C D", "2026-01-01", "2026-05-31", True), ("A B", "2026-04-02", None, True)}
    import random

    for seed in range(4):
        random.Random(seed).shuffle(rows)
        got = {(r["name"], str(r["from_date"]), r["to_date"] and str(r["to_date"]), r["stated"]) for r in managers.spells(observed(spark, *rows).repartition(3)).collect()}
        assert got == want
    bare = {(r["from_date"], r["stated"]) for r in managers.spells(observed(spark, ("2026-01-31", "A B", None))).collect()}
    assert bare == {(d("2026-01-31"), False)}


COSTS = [
    ("Expense Ratio\nRegular Plan:   1.15%*\nDirect Plan:   0.63%*\nBase Expense Ratio (As on the last day)", False, {("Regular", "BER"): 1.15, ("Direct", "BER"): 0.63}),
    ("Base Expense Ratio^\nRegular/Other than Direct   1.60\nDirect   0.57", False, {("Regular", "BER"): 1.6, ("Direct", "BER"): 0.57}),
    ("EXPENSE RATIO\nbase expense  Ratio with levies\nRegular: 1.37% Direct: 0.77%", False, {("Regular", "BER"): 1.37, ("Direct", "BER"): 0.77}),
    ("Total Expense Ratio\n   BER   TER\nRegular  1.49%  2.16%\nDirect  0.82%  1.37%", False, {("Regular", "TER"): 2.16, ("Regular", "BER"): 1.49, ("Direct", "TER"): 1.37, ("Direct", "BER"): 0.82}),
    ("Direct Plan 12.50 returns\nTER\nDirect: 0.61%  Other : 1.30% p. a.", False, {("Direct", "TER"): 0.61, ("Regular", "TER"): 1.3}),
    ("Expense Ratio**\nDirect: 0.61%\nRegular: 1.43%\n" + "x\n" * 12 + "see page 163. **What is disclosed above is the Base\nExpense Ratio (BER).", False, {("Direct", "BER"): 0.61, ("Regular", "BER"): 1.43}),
    ("Expense Ratio**\nDirect: 0.61%\nRegular: 1.43%\n" + "x\n" * 12 + "***This is the Base Expense Ratio. ** As of today" + " y" * 200, False, {("Direct", "TER"): 0.61, ("Regular", "TER"): 1.43}),
    ("Expense Ratio2\nDirect: 0.61%\n" + "x\n" * 12 + "Since 2 January\n 2The figure is a\nBER figure", False, {("Direct", "BER"): 0.61}),
    ("Expense Ratio2\nDirect: 0.61%\n" + "x\n" * 12 + "Since 2 January the base expense ratio", False, {("Direct", "TER"): 0.61}),
    ("Expense Ratio\nRegular Plan:\nDirect Plan:\n1.43%\n0.61%", True, {("Regular", "TER"): 1.43, ("Direct", "TER"): 0.61}),
    ("Expense Ratio\nRegular Plan:\nDirect Plan:\n1.43%\n0.61%", False, {}),
    ("Expense Ratio\nDirect 7.5%\nTERRACE\nDirect: 0.4%", False, {("Direct", "TER"): 0.4}),
    (None, False, {}),
]


def test_expense_ratios(spark):
    pages = spark.createDataFrame([(i, 1, t, s) for i, (t, s, _) in enumerate(COSTS)], "doc_id int, page_number int, text string, shared boolean")
    got = {i: {} for i in range(len(COSTS))}
    for r in expenses.expense_ratios(pages).collect():
        got[r["doc_id"]][r["plan_type"], r["ratio_type"]] = r["pct"]
    for i, (text, _, want) in enumerate(COSTS):
        assert got[i] == want, text


def test_a_hundred_basis_points_are_one_percent(spark):
    from navella.plans import inputs

    rows = spark.createDataFrame([(31, "Regular Plan: 1.31%\nDirect Plan: 0.31%"), (101, "Regular Plan: 1.101%\nDirect Plan: 0.101%")], "direct_bps int, own string")
    got = [r["own"] for r in inputs.with_figures(rows).orderBy("direct_bps").collect()]
    assert got == ["Regular Plan: 1.31%\nDirect Plan: 0.31%", "Regular Plan: 2.01%\nDirect Plan: 1.01%"]


def test_a_rule_is_matched_once_and_only_where_its_words_stand(spark):
    rows = [(1, DAY, "NOTICE: TER REVISED from 1.5% to 1.2%. "), (2, DAY, "After a change the waters rose."), (3, DAY, "Resignation of Ms. Ada Wood as Fund Manager.")]
    found = notices.notice_signals(spark.createDataFrame(rows, "doc_id int, doc_date date, text string"))
    got = sorted((r["doc_id"], r["event"], r["before"]) for r in found.collect())
    assert got == [(1, "ter_change", "1.5%"), (2, "addendum", None), (3, "manager_change", "Ada Wood")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    for _, pattern in notices.PEOPLE:
        assert plan.count(f", {pattern}, 0)") == 1
