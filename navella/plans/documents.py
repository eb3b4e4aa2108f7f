"""Queries of page texts, factsheets and notices."""

from __future__ import annotations

from pyspark.sql import functions as F

from navella.operators import disclosures as d
from navella.operators import expenses as e
from navella.operators import factsheets, notices
from navella.operators import managers as m
from navella.plans.registry import query
from navella.plans import inputs

_HEADED = """+ hd as (select *, case page_number % 9 when 1 then 'Investment Objective' when 2 then 'investment strategy' when 3 then 'Asset Allocation Pattern' when 4 then 'Risk Factors' when 5 then 'Fund Manager' when 6 then 'Load Structure' when 7 then 'Expenses of the Scheme' end h from document_section),
tx as (select doc_id, page_number, h, case when h is null then coalesce(text, '') else 'x' || chr(10) || '  ' || h || ' here' || chr(10) || coalesce(text, '') end text from hd)"""


def _headed(t):
    kind = F.element_at(F.array(*map(F.lit, ("", "Investment Objective", "investment strategy", "Asset Allocation Pattern", "Risk Factors", "Fund Manager", "Load Structure", "Expenses of the Scheme", ""))), (F.col("page_number") % 9 + 1).cast("int"))
    text = F.coalesce("text", F.lit(""))
    return t("document_section").withColumn("text", F.when(kind == "", text).otherwise(F.concat(F.lit("x\n  "), kind, F.lit(" here\n"), text)))


@query(_HEADED + " select doc_id, page_number, case when h = 'investment strategy' then 'Investment Strategy' else coalesce(h, '') end headings from tx", "document_section")
def page_headings(t, _):
    return _headed(t).select("doc_id", "page_number", F.array_join(d.headings(F.col("text")), ",").alias("headings"))


@query(_HEADED + ", k as (select *, row_number() over (partition by doc_id order by page_number) r from tx where h = 'Investment Objective') select doc_id, page_number, md5(text[1:3000]) excerpt from k where r <= 2", "document_section")
def objective_excerpts(t, _):
    return d.excerpts(_headed(t), "Investment Objective").withColumn("excerpt", F.md5("excerpt"))


@query(_HEADED + """, x as (select doc_id, page_number, length(text) size, (length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3 score from tx where h = 'Risk Factors'),
k as (select *, row_number() over w rank, coalesce(sum(size) over (partition by doc_id order by score desc, page_number rows between unbounded preceding and 1 preceding), 0) bef from x where score > 0 window w as (partition by doc_id order by score desc, page_number))
select doc_id, page_number, score, rank, least(size, 5000 - bef)::bigint chars from k where bef < 5000""", "document_section")
def risk_page_search(t, _):
    return d.search_pages(_headed(t), ["the"], 5000, ["Risk Factors"]).drop("text")


_EVENTS = (  # kind, event, sub_type, before, after, date
    (0, "manager_change", "cessation", "Alan Stone", None, "2026-09-01"), (0, "manager_change", "cessation", "Beth Rivers", None, "2026-09-01"),
    (1, "manager_change", "appointment", None, "Carl Field", "2026-10-05"), (2, "manager_change", "change", None, None, "2026-10-02"),
    (3, "mandate_revision", None, None, None, "2026-12-01"),
    (4, "benchmark_change", None, "Narrow 50 TRI", "Broad 100 TRI", "2026-11-01"), (5, "ter_change", None, "1.50%", "1.25%", None),
    (6, "addendum", None, None, "subscription_suspension", "2026-08-03"), (7, "addendum", None, None, None, None),
    (8, "manager_change", "appointment", None, "Dora Hill", "2026-09-01"), (8, "manager_change", "appointment", None, "Eric Vale", "2026-09-01"),
    (9, "manager_change", "cessation", "Alan Stone", None, None), (10, "category_change", None, None, None, "2027-01-01"),
    (11, "addendum", None, None, "redemption_suspension", None), (12, "benchmark_change", None, "Narrow 50 TRI", "Broad 100 TRI", "2026-07-07"),
    (13, "manager_change", "appointment", None, "CARL FIELD", None), (14, "mandate_revision", None, None, None, "2026-06-12"), (15, "category_change", None, None, None, None),
)
_EVENT_ROWS = ", ".join("(" + ", ".join("null" if x is None else repr(x) for x in e) + ")" for e in _EVENTS)


@query(f"""with n as (select doc_id, date '2026-01-01' + (doc_id % 200)::int dd, doc_id % 16 k from documents), v(k, event, sub_type, "before", "after", d) as (values {_EVENT_ROWS}),
e as (select doc_id, event, sub_type, "before", "after", coalesce(d::date, dd) effective_date from n join v using (k))
select *, 'evt-' || sha1(doc_id::varchar || '::' || event || '::' || effective_date::varchar || '::' || (coalesce("before", '') || coalesce("after", ''))[1:64])[1:16] event_id from e""")
def notice_events(t, _):
    found = notices.notice_signals(inputs.notices(t("documents")))
    said = F.substring(F.concat(F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))), 1, 64)
    return found.drop("excerpt", "confidence").withColumn("event_id", d.event_id(F.col("doc_id").cast("string"), F.col("event"), F.col("effective_date").cast("string"), said))


@query("""+ k as (select distinct date, (date_diff('day', date '1970-01-01', date) % 3) f from nav_point) select date as stated, date as parsed from k""", "nav_point")
def stated_dates(t, _):
    day = F.col("date")
    suffix = F.when(F.dayofmonth(day).isin(1, 21, 31), "st").when(F.dayofmonth(day).isin(2, 22), "nd").when(F.dayofmonth(day).isin(3, 23), "rd").otherwise("th")
    words = F.concat(F.lit("from "), F.dayofmonth(day).cast("string"), suffix, F.date_format(day, " MMMM yyyy"), F.lit(" on"))
    kind = F.datediff(day, F.lit("1970-01-01").cast("date")) % 3
    text = F.when(kind == 0, words).when(kind == 1, F.date_format(day, "'w.e.f.' d-M-yyyy")).otherwise(F.concat(F.lit("on "), day.cast("string")))
    return t("nav_point").select("date").distinct().select(day.alias("stated"), d.loose_date(text).alias("parsed"))


_PEOPLE = """+ fn as (select *, ['Arun', 'Bela', 'Chitra', 'Dev', 'Esha', 'Farid', 'Gita'] f, make_date(year_no, 5, day_no::int) st from factsheet),
pp as (select doc_id, scheme_id, doc_date, f[(n % 7 + 1)::int] || ' Rao' "name", st managing_since, leaves and layout <> 'parenthesis' and doc_date > date '2026-07-01' gone from fn union all select doc_id, scheme_id, doc_date, f[((n + 3) % 7 + 1)::int] || ' Mehta', case when comes then date '2026-10-01' else date '2020-01-15' end, comes from fn)"""


def _sheets(t):
    return inputs.factsheets(t("factsheet"))


def _people(t):
    pages = _sheets(t)
    return m.managers(pages.join(m.inception_dates(pages), "doc_id", "left")), pages


@query(_PEOPLE + ' select doc_id, "name", managing_since from pp', "factsheet")
def sheet_managers(t, _):
    return _people(t)[0]


@query(_PEOPLE + ' select doc_id, "name", managing_since from pp where not gone', "factsheet")
def managers_in_office(t, _):
    return m.current_managers(*_people(t))


@query(" select doc_id, make_date(year_no, 5, day_no::int) inception from factsheet", "factsheet")
def sheet_inceptions(t, _):
    return m.inception_dates(_sheets(t))


_COSTS = """+ cc as (select doc_id, scheme_id, doc_date, 'Direct' plan_type, case when kind = 1 then 'BER' else 'TER' end ratio_type, direct_bps / 100 pct from factsheet union all select doc_id, scheme_id, doc_date, 'Regular', case when kind = 1 then 'BER' else 'TER' end, (direct_bps + 70) / 100 from factsheet
union all select doc_id, scheme_id, doc_date, 'Direct', 'BER', 0.22 from factsheet where kind = 2 union all select doc_id, scheme_id, doc_date, 'Regular', 'BER', 1.39 from factsheet where kind = 2)"""


def _costs(t):
    pages = _sheets(t)
    return e.expense_ratios(pages).join(pages.select("doc_id", "scheme_id", "doc_date"), "doc_id")


@query(_COSTS + " select doc_id, plan_type, ratio_type, round(pct, 4) pct from cc", "factsheet", pct=4)
def sheet_expense_ratios(t, _):
    return e.expense_ratios(_sheets(t))


@query(_COSTS + " select doc_id, round(max(pct) filter (ratio_type = 'TER' and plan_type = 'Direct'), 4) ter_direct, round(max(pct) filter (ratio_type = 'TER' and plan_type = 'Regular'), 4) ter_regular, round(max(pct) filter (ratio_type = 'BER' and plan_type = 'Direct'), 4) ber_direct, round(max(pct) filter (ratio_type = 'BER' and plan_type = 'Regular'), 4) ber_regular from cc group by 1", "factsheet", ter_direct=4, ter_regular=4, ber_direct=4, ber_regular=4)
def sheet_ratio_map(t, _):
    found = e.ratio_map(e.expense_ratios(_sheets(t)))
    return found.select("doc_id", *(F.try_element_at(k.upper(), F.lit(p)).alias(f"{k}_{p.lower()}") for k in ("ter", "ber") for p in ("Direct", "Regular")))


@query(_COSTS + ", l as (select *, lag(pct) over (partition by scheme_id, plan_type order by doc_date) b from cc where ratio_type = 'TER') select scheme_id, doc_date, plan_type, round(b, 4) \"before\", round(pct, 4) \"after\" from l where abs(pct - b) > 0.001", "factsheet", before=4, after=4)
def expense_changes(t, _):
    return e.ratio_changes(_costs(t))


@query(_COSTS + """, a as (select distinct scheme_id, unnest(['Direct', 'Regular']) plan_type from plan), g as (select distinct scheme_id, plan_type from plan where option_type = 'Growth'), m as (select scheme_id, plan_type, max(doc_date) dd, arg_max(pct, doc_date) p from cc where ratio_type = 'TER' group by 1, 2),
r as (select a.scheme_id, a.plan_type, dd, p, case when g.scheme_id is null then 'no_' || lower(a.plan_type) || '_growth_plan' when m.scheme_id is null then 'not_yet_ingested' else 'stated' end source from a left join g on g.scheme_id = a.scheme_id and g.plan_type = a.plan_type left join m on m.scheme_id = a.scheme_id and m.plan_type = a.plan_type)
select scheme_id, plan_type, case when source = 'stated' then dd end as_of_date, case when source = 'stated' then round(p, 4) end ter_pct, source from r""", "factsheet plan", ter_pct=4)
def latest_plan_costs(t, _):
    return e.latest_costs(t("plan"), _costs(t))


@query(" select source_doc doc_id, page_number, scheme_id, md5(case when shared then own when i = 2 then 'Returns of one year' || chr(10) || 'Direct 12.50' || chr(10) || above || own else above || own end) segment, not shared sole_title from combined_scheme where page_number is not null", "combined_scheme")
def combined_segments(t, _):
    rows = t("combined_scheme")
    found = factsheets.scheme_segments(inputs.combined_pages(rows), rows.select("scheme_id", "name"))
    return found.withColumn("segment", F.md5("text")).drop("text")


def _attributed(t):
    rows = inputs.with_figures(t("combined_scheme"))
    return factsheets.attributed(inputs.combined_pages(rows), rows.select("scheme_id", "name"))


@query(""" select source_doc || '/' || scheme_id doc_id, unnest([first_one || ' Rao', first_two || ' Mehta']) "name" from combined_scheme where page_number is not null""", "combined_scheme")
def combined_managers(t, _):
    return m.managers(_attributed(t)).select("doc_id", "name")


@query("""+ c as (select source_doc || '/' || scheme_id doc_id, case when mark = '' then 'TER' else 'BER' end ratio_type, direct_bps from combined_scheme where page_number is not null)
select doc_id, 'Direct' plan_type, ratio_type, round(direct_bps / 100, 2) pct from c union all select doc_id, 'Regular', ratio_type, round(1 + direct_bps / 100, 2) from c""", "combined_scheme", pct=2)
def combined_expense_ratios(t, _):
    return e.expense_ratios(_attributed(t))


@query("""+ c as (select scheme_id, doc_date, lag(doc_date) over (partition by scheme_id order by doc_date) pd from manager_document),
cur as (select c.*, r."name", r.person, r.managing_since from c join manager_read r on r.scheme_id = c.scheme_id and r.doc_date = c.doc_date),
prev as (select c.*, r."name", r.person from c join manager_read r on r.scheme_id = c.scheme_id and r.doc_date = c.pd),
ad as (select * from cur where not exists (from prev p where p.scheme_id = cur.scheme_id and p.doc_date = cur.doc_date and p."name" = cur."name")),
de as (select * from prev where not exists (from cur p where p.scheme_id = prev.scheme_id and p.doc_date = prev.doc_date and p."name" = prev."name")),
a2 as (select * from ad where not exists (from de where de.scheme_id = ad.scheme_id and de.doc_date = ad.doc_date and de.person = ad.person) and not coalesce(managing_since < pd, false)),
d2 as (select * from de where not exists (from ad where de.scheme_id = ad.scheme_id and de.doc_date = ad.doc_date and de.person = ad.person)),
l as (select scheme_id, doc_date, (select string_agg("name", ',' order by "name") from prev x where x.scheme_id = c.scheme_id and x.doc_date = c.doc_date) "before", (select string_agg("name", ',' order by "name") from cur x where x.scheme_id = c.scheme_id and x.doc_date = c.doc_date) "after",
coalesce((select string_agg("name", ',' order by "name") from a2 x where x.scheme_id = c.scheme_id and x.doc_date = c.doc_date), '') added, coalesce((select string_agg("name", ',' order by "name") from d2 x where x.scheme_id = c.scheme_id and x.doc_date = c.doc_date), '') departed from c)
select * from l where "before" is not null and "after" is not null and (added <> '' or departed <> '')""", "manager_document manager_read")
def manager_change_events(t, _):
    found = m.manager_changes(t("manager_document"), t("manager_read"))
    return found.withColumns({c: F.array_join(F.array_sort(c), ",") for c in ("before", "after", "added", "departed")})


@query("""+ dy as (select scheme_id, doc_date, row_number() over w place, lead(doc_date) over w nxt from (select distinct scheme_id, doc_date from manager_read) window w as (partition by scheme_id order by doc_date)),
sp as (select o.*, place - row_number() over (partition by scheme_id, "name" order by doc_date) spell, nxt from manager_read o join dy using (scheme_id, doc_date)),
g as (select scheme_id, "name", min(doc_date) d0, first(managing_since order by doc_date) s0, min(managing_since) s1, first(nxt order by doc_date desc) to_date from sp group by scheme_id, "name", spell)
select scheme_id, "name", least(coalesce(s0, d0), coalesce(s1, coalesce(s0, d0))) from_date, to_date, coalesce(s1 <= coalesce(s0, d0), false) stated from g""", "manager_document manager_read")
def manager_spells(t, _):
    return m.spells(t("manager_read"))
