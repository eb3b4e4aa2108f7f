"""Queries of loading: price files, holdings sheets, cap lists and upkeep. Texts and cells are written out of views of the
given tables and parsed again; the SQL takes what they should give from the views."""

from __future__ import annotations

from pyspark.sql import functions as F

from navella.plans.registry import query
from navella.sources import grids as g
from navella.plans import inputs
from navella.sources import price_files as f
from navella.sources import workbooks as w
from navella.sources.views import PRICE_TRUTH


def _rows(t):
    return f.parse_price_lines(inputs.price_lines(t("price_row")))


@query(f"""+ {PRICE_TRUTH} select file, code, isin, isin_reinvest, case when by_columns then base else base || ' - ' || plan_text || ' - ' || option_text end as "name", case when by_columns then plan_text end as plan, case when by_columns then option_text end as option,
nav, date, scheme_type, category, sub_category, nullif(house, '') house from pt""", "price_row")
def price_file_rows(t, _):
    return _rows(t).select("file", "code", "isin", "isin_reinvest", "name", "plan", "option", "nav", "date", "scheme_type", "category", "sub_category", "house")


@query(f"+ {PRICE_TRUTH} select plan_id, scheme_id, coalesce(isin, isin_reinvest) isin, plan_type, option_type, idcw_variant from pi", "price_row")
def daily_plans(t, _):
    return f.daily_frames(_rows(t))["plan"]


@query(f"""+ {PRICE_TRUTH} select scheme_id, any_value(amc_id) amc_id, arg_min(own_name, (file, house, header, n)) base, arg_min(scheme_type, (file, house, header, n)) scheme_type, arg_min(category, (file, house, header, n)) category, arg_min(sub_category, (file, house, header, n)) sub_category,
case arg_min(category, (file, house, header, n)) when 'Equity Scheme' then 'Equity' when 'Debt Scheme' then 'Debt' else 'Other' end roll_up from pi group by 1""", "price_row")
def daily_schemes(t, _):
    return f.daily_frames(_rows(t))["scheme"].drop("header")


@query(f"+ {PRICE_TRUTH} select amc_id, any_value(house) house from pi group by 1", "price_row")
def daily_houses(t, _):
    return f.daily_frames(_rows(t))["amc"]


@query(f"+ {PRICE_TRUTH} select plan_id, date, nav from pi where nav is not null and date is not null", "price_row")
def daily_prices(t, _):
    return f.daily_frames(_rows(t))["nav"]


@query(f"+ {PRICE_TRUTH} select count(distinct amc_id) amcs, count(distinct scheme_id) schemes, count(*) plans, count(*) filter (nav is not null and date is not null) nav_points, false suspicious from pi", "price_row")
def daily_load_counts(t, _):
    return f.daily_frames(_rows(t))["counts"]


def _some_plans(t):
    return t("price_row").filter("n % 8 <> 0").select(F.concat(F.lit("plan-"), "code").alias("plan_id"))


@query(f"+ {PRICE_TRUTH} select plan_id, date, nav from pt where nav is not null and date is not null and n % 8 <> 0", "price_row")
def history_prices(t, _):
    return f.history_points(_rows(t), _some_plans(t))


@query(f"""+ {PRICE_TRUTH} select count(*) rows_parsed, count(*) filter (nav is not null and date is not null and n % 8 <> 0) nav_points, count(distinct code) filter (nav is not null and date is not null and n % 8 = 0) unknown_codes,
count(*) filter (nav is not null and date is null) bad_dates, 'ok' outcome from pt""", "price_row")
def history_load_counts(t, _):
    return f.history_counts(_rows(t), _some_plans(t))


@query("""+ m as (select unnest(generate_series((select date_trunc('month', min(date)) from nav_point), (select max(date) from nav_point), interval 1 month))::date as month),
d as (select distinct date_trunc('month', date)::date as month from nav_point where plan_id = 'plan-1')
select month, greatest(month, (select min(date) from nav_point)) first_day, least(last_day(month), (select max(date) from nav_point)) last_day from m where month not in (select month from d)""", "nav_point")
def months_to_load(t, spark):
    nav = t("nav_point")
    first, last = nav.agg(F.min("date"), F.max("date")).first()
    done = nav.filter("plan_id = 'plan-1'").select(F.trunc("date", "MM").alias("month")).distinct()
    return f.pending_months(spark, str(first), str(last), done)


@query("""+ n as (select scheme_id, as_of_date, isin, instrument_name, quantity * 2 quantity from holding where as_of_date >= date '1997-01-01' and quantity > 40)
select scheme_id, as_of_date, isin, instrument_name, quantity from holding where (scheme_id, as_of_date) not in (select scheme_id, as_of_date from n) union all select * from n""", "holding")
def snapshot_replacement(t, _):
    old = t("holding").select("scheme_id", "as_of_date", "isin", "instrument_name", "quantity")
    new = old.filter("as_of_date >= date '1997-01-01' and quantity > 40").withColumn("quantity", F.col("quantity") * 2)
    return f.replace_snapshots(old, new, ["scheme_id", "as_of_date"])


@query("""+ o as (select scheme_id, date '2024-01-01' as as_of_date, category from scheme where length(scheme_id) % 2 = 0)
select * from o union all select scheme_id, date '2024-01-01', upper(sub_category) from scheme where scheme_id not in (select scheme_id from o)""", "scheme")
def taxonomy_insert(t, _):
    rows = t("scheme").withColumn("as_of_date", F.lit("2024-01-01").cast("date"))
    old = rows.filter("length(scheme_id) % 2 = 0").select("scheme_id", "as_of_date", "category")
    return f.insert_absent(old, rows.select("scheme_id", "as_of_date", F.upper("sub_category").alias("category")), ["scheme_id", "as_of_date"])


@query("+ k as (select plan_id from plan where active) select plan_id, count(*) n from nav_point where plan_id not in (select plan_id from k) group by 1", "nav_point plan")
def orphan_prices(t, _):
    return f.orphans(t("nav_point"), t("plan").filter("active"), "plan_id")


@query("""select sha256(html) sha256, 'p/' || min(page_id)::varchar as path, 'html' kind, count(*) n from pages where html is not null and sha256(html) not in (select sha256(html) from pages where page_id % 7 = 0 and html is not null) group by 1""")
def files_to_read(t, _):
    pages = t("pages").filter("html is not null")
    files = pages.select(F.concat(F.lit("p/"), F.lpad(F.col("page_id").cast("string"), 12, "0")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    known = pages.filter("page_id % 7 = 0").select(F.sha2(F.encode("html", "UTF-8"), 256).alias("sha256")).distinct()
    found = f.new_files(files, known)
    return found.withColumn("path", F.concat(F.lit("p/"), F.substring("path", 3, 20).cast("long").cast("string")))


_HELD = """h as (select *, scheme_id || '/' || as_of_date::varchar sheet_id, row_number() over (partition by scheme_id, as_of_date order by pct_nav desc, instrument_name) place from holding),
k as (select * from h where not (scheme_id = 'scheme-5' and place = 1)),
x as (select sheet_id, scheme_id, as_of_date, instrument_name, isin, industry_or_rating, quantity::double quantity, market_value, pct_nav, asset_class, case asset_class when 'equity' then '(a) Listed / awaiting listing' when 'foreign' then 'Foreign Securities and Equity Related Instruments' when 'debt' then 'Unlisted Notes' else 'TREPS / Reverse Repo' end section_label, asset_class = 'equity' listed from k
 union all select sheet_id, scheme_id, as_of_date, 'Unlisted Notes', null, null, null, 9.0, null, 'debt', 'Debt Instruments', false from k group by 1, 2, 3 having count(*) filter (asset_class = 'debt') = 0
 union all select distinct sheet_id, scheme_id, as_of_date, unnest(['Net Current Assets', 'Cash Margin']), null, null, null::double, 0.0, 0.0, 'cash', 'TREPS / Reverse Repo', false from k)"""


@query(f"+ {_HELD} select sheet_id, instrument_name, isin, industry_or_rating, round(quantity, 4) quantity, round(market_value, 2) market_value, round(pct_nav * case when scheme_id = 'scheme-2' then 100 else 1 end, 6) weight, asset_class, listed, section_label from x", "holding", quantity=4, market_value=2, weight=6)
def sheet_holdings(t, _):
    return g.holdings(g.grid_rows(inputs.holding_sheets(t("holding")))).drop("row_no")


@query(f"+ {_HELD} select distinct sheet_id, 'Broad Future' instrument_name, case when scheme_id[-1]::int % 2 = 1 then 'Long' when scheme_id <> 'scheme-6' then 'Short' end direction, 5.0::double quantity, 50.0::double market_value, 0.01::double weight, 'Index Futures' section_label from k", "holding")
def sheet_derivatives(t, _):
    return g.derivatives(g.grid_rows(inputs.holding_sheets(t("holding")))).drop("row_no")


@query(f"""+ {_HELD}, s as (select sheet_id, scheme_id, sum(pct_nav) held from x group by 1, 2), q as (select *, case when scheme_id = 'scheme-2' then 0.0001 else 0.01 end derived, case when scheme_id = 'scheme-3' then 0.97 when scheme_id <> 'scheme-4' then 1.0 end printed from s),
v as (select *, abs(coalesce(printed, held) - 1) <= 0.005 and (printed is null or abs(held - printed) <= 0.005 or abs(held + derived - printed) <= 0.005) ok from q)
select sheet_id, case when scheme_id = 'scheme-2' then 100.0 else 1.0 end::double scale, printed::double printed, round(held, 6) held, round(derived, 6) derived, ok, case when ok then 1.0 else 0.5 end::double confidence from v""", "holding", held=6, derived=6)
def sheet_reconciliation(t, _):
    return g.reconciliation(g.grid_rows(inputs.holding_sheets(t("holding"))))


@query(f"""+ {_HELD}, s as (select sheet_id, scheme_id, sum(pct_nav) held from x group by 1, 2), q as (select *, case when scheme_id = 'scheme-2' then 0.0001 else 0.01 end derived, case when scheme_id = 'scheme-3' then 0.97 when scheme_id <> 'scheme-4' then 1.0 end printed from s),
v as (select sheet_id from q where abs(coalesce(printed, held) - 1) <= 0.005 and (printed is null or abs(held - printed) <= 0.005 or abs(held + derived - printed) <= 0.005))
select sheet_id, count(*) n, round(sum(pct_nav), 6) weight from x where sheet_id in (select sheet_id from v) group by 1""", "holding", weight=6)
def sheets_that_load(t, _):
    found = g.reconciled(g.grid_rows(inputs.holding_sheets(t("holding"))))
    return found.groupBy("sheet_id").agg(F.count("*").alias("n"), F.sum("pct_nav").alias("weight"))


@query("+ s as (select distinct scheme_id, as_of_date from holding) select scheme_id || '/' || as_of_date::varchar sheet_id, as_of_date, 'Broad 500 TRI' benchmark_name from s", "holding")
def sheet_facts(t, _):
    return g.facts(inputs.holding_sheets(t("holding")))


@query(" select effective_date::varchar sheet_id, isin, market_cap from ranked_part", "ranked_part")
def cap_list_classes(t, _):
    return g.cap_list(inputs.cap_sheets(t("ranked_part")))


@query("""select 'mgr-' || md5(event_type)[1:16] id, event_type as "name", array_to_string(list_sort(list(distinct event_type || '-' || (user_id % 3)::varchar)), ',') aliases from events group by event_type""")
def name_aliases(t, _):
    return _aliases(t).withColumn("aliases", F.array_join("aliases", ","))


def _aliases(t):
    rows = t("events").select(F.concat(F.lit("mgr-"), F.substring(F.md5("event_type"), 1, 16)).alias("id"), F.col("event_type").alias("name"), "user_id")
    names = rows.select("id", "name", F.array("name").alias("aliases")).distinct()
    return f.merge_aliases(names, rows.select("id", F.concat_ws("-", "name", (F.col("user_id") % 3).cast("string")).alias("spelling")))


@query("""with n as (select distinct event_type nm, 'mgr-' || md5(event_type)[1:16] id from events), a as (select distinct event_type nm, event_type || '-' || (user_id % 3)::varchar sp from events), k as (select nm asked, id, 'name' as "by" from n union all select sp, id, 'alias' from a join n using (nm))
select asked, id, "by" from k where asked in (select event_type from events union select event_type || '-1' from events)""")
def name_lookup(t, _):
    events = t("events")
    asked = events.select(F.col("event_type").alias("asked")).union(events.select(F.concat(F.col("event_type"), F.lit("-1")))).union(events.select(F.concat(F.col("event_type"), F.lit("?"))))
    return f.by_name_or_alias(asked, _aliases(t))


_JUDGED = _HELD + """, s as (select sheet_id, scheme_id, count(*) n, sum(pct_nav) held from x group by 1, 2), q as (select *, case when scheme_id = 'scheme-2' then 0.0001 else 0.01 end derived, case when scheme_id = 'scheme-3' then 0.97 when scheme_id <> 'scheme-4' then 1.0 end printed from s),
v as (select *, abs(coalesce(printed, held) - 1) <= 0.005 and (printed is null or abs(held - printed) <= 0.005 or abs(held + derived - printed) <= 0.005) ok from q)"""


def _with_odd_sheets(t):
    """Holdings sheets, and for each scheme one that has a header alone and one without any table."""
    cells = inputs.holding_sheets(t("holding"))
    schemes = t("scheme").select("scheme_id")
    head = F.array(*map(F.lit, ("", "Name of the Instrument", "ISIN", "Industry / Rating", "Quantity", "Market Value (Rs. in Lakhs)", "% to Net Assets")))
    bare = schemes.select(F.concat(F.lit("bare/"), "scheme_id").alias("sheet_id"), F.lit(1).alias("row_no"), head.alias("cells"))
    total = schemes.select(F.concat(F.lit("bare/"), "scheme_id").alias("sheet_id"), F.lit(2).alias("row_no"), F.array(*map(F.lit, ("", "GRAND TOTAL", "", "", "", "0", "1"))).alias("cells"))
    text = schemes.select(F.concat(F.lit("text/"), "scheme_id").alias("sheet_id"), F.lit(1).alias("row_no"), F.array(F.lit("Notes"), F.lit("none")).alias("cells"))
    return cells.unionByName(bare).unionByName(total).unionByName(text)


@query(f"""+ {_JUDGED} select sheet_id, case when ok then 'loaded' else 'rejected' end outcome, case when not ok then 'not_reconciled' end reason, n n_held, 1 n_derived from v
union all select 'bare/' || scheme_id, 'rejected', 'no_holdings', 0, 0 from scheme union all select 'text/' || scheme_id, 'rejected', 'no_table', 0, 0 from scheme""", "holding scheme")
def sheet_ledger(t, _):
    return g.sheet_outcomes(_with_odd_sheets(t)).select("sheet_id", "outcome", "reason", "n_held", "n_derived")


@query(f"""+ {_JUDGED} select outcome, count(*) n, round(sum(pct_nav), 4) weight from (select x.*, case when ok then 'loaded' else 'rejected' end outcome from x join v using (sheet_id)) group by 1""", "holding", weight=4)
def loaded_and_quarantined(t, _):
    found = g.loaded_and_rejected(inputs.holding_sheets(t("holding")))
    return found.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("pct_nav").alias("weight"))


_BOOKS = """bk as (select n, i, h, source_doc file_id, scheme_id, name from (select *, cast(floor(n / 10) as bigint) h from combined_scheme))"""


@query(f"""+ {_BOOKS} select file_id, scheme_id, case when h % 4 = 3 then case when i = 0 then 'skipped_format' end when h % 4 = 0 and i = 9 then 'skipped_sheet_not_found' when h % 4 = 1 and i = 3 then 'skipped_ambiguous_multi_sheet' when h % 4 = 1 and i = 4 then 'skipped_sheet_not_found' when h % 4 = 2 and i > 0 then 'skipped_sheet_not_found' when i = 5 then 'skipped_reconciliation_failed' when i = 6 then 'skipped_no_holdings' else 'ingested' end outcome,
case when h % 4 = 3 or h % 4 = 0 and i = 9 or h % 4 = 1 and i in (3, 4) or h % 4 = 2 and i > 0 then null when h % 4 = 0 then 'index' when h % 4 = 1 then 'title' else 'sole' end way from bk where h % 4 <> 3 or i = 0""", "combined_scheme")
def workbook_loads(t, _):
    books = inputs.workbooks(t("combined_scheme"))
    picks = w.pick_sheets(books["asked"], books["sheets"], books["cells"])
    found = w.file_outcomes(books["files"], picks, g.sheet_outcomes(books["cells"]))
    return found.join(picks.select("file_id", "scheme_id", "way"), ["file_id", "scheme_id"])
