"""Registered queries of the engine and the SQL that DuckDB checks them by."""

from __future__ import annotations

from pyspark.sql import functions as F

from navella.operators import disclosures as d
from navella.operators import houses as h
from navella.operators import managers as m
from navella.operators import nav as n
from navella.operators import portfolio as p
from navella.plans.registry import query
from navella.sources import price_files as f

def _cagr(d0: str, n0: str, d1: str, n1: str) -> str:
    y = f"(date_diff('day', {d0}, {d1}) / 365.25)"
    return f"round(case when {n0} > 0 and {y} > 0 then case when {y} < 1 then {n1} / {n0} - 1 else pow({n1} / {n0}, 1 / {y}) - 1 end end, 6)"


_TRAILING = """+ a as (select plan_id, max(date) anchor from nav_point group by 1),
t as (select plan_id, anchor, count(*) n, min(date) d0, arg_min(nav, date) n0, arg_max(nav, date) n1,
""" + ", ".join(f"max(date) filter (date <= anchor - {int(h * 365.25)}) sd{h}, arg_max(nav, date) filter (date <= anchor - {int(h * 365.25)}) sn{h}" for h in (1, 3, 5)) + " from nav_point join a using (plan_id) group by 1, 2)"
_CAGRS = ", ".join(f"{_cagr(f'sd{h}', f'sn{h}', 'anchor', 'n1')} cagr_{h}y" for h in (1, 3, 5)) + f", {_cagr('d0', 'n0', 'anchor', 'n1')} cagr_inception"
_SIX = {c: 6 for c in ("cagr_1y", "cagr_3y", "cagr_5y", "cagr_inception")}
_RETURNS = "+ r as (select * from (select plan_id, date, nav, case when lag(nav) over w > 0 then nav / lag(nav) over w - 1 end ret from nav_point window w as (partition by plan_id order by date)) where ret is not null)"


@query(_TRAILING + f" select plan_id, anchor, n, {_CAGRS} from t", "nav_point", **_SIX)
def trailing_returns(t, _):
    return n.trailing(t("nav_point"))


@query(_TRAILING + f""", b as (select scheme_id, min((case when plan_type = 'Direct' and option_type = 'Growth' then 0 when plan_type = 'Direct' then 1 else 2 end, plan_id, option_type)) s from plan group by 1),
c as (select scheme_id, s[1] choice, s[2] plan_id, s[3] option_type from b),
v as (select scheme_id, c.plan_id, choice, case when option_type = 'IDCW' then 'idcw_plan_return_analytics_unsupported' when coalesce(n, 0) < 2 then 'insufficient_nav_history' else 'ok' end status, {_CAGRS} from c left join t on c.plan_id = t.plan_id)
select scheme_id, plan_id, choice, status, """ + ", ".join(f"case when status = 'ok' then {c} end {c}" for c in _SIX) + " from v", "nav_point plan", **_SIX)
def scheme_performance(t, _):
    return n.scheme_performance(t("plan"), t("nav_point"))


@query(_RETURNS + """, g as (select plan_id, count(*) n, pow(1 + avg(ret), 252) - 1 m, stddev_samp(ret) * sqrt(252) v, sqrt(avg(pow(least(ret, 0), 2))) * sqrt(252) dn from r group by 1)
select plan_id, n, round(m, 6) mean, round(v, 6) volatility, case when v <> 0 then round((m - 0.065) / v, 6) end sharpe, case when dn <> 0 then round((m - 0.065) / dn, 6) end sortino from g""", "nav_point", mean=6, volatility=6, sharpe=6, sortino=6)
def risk_ratios(t, _):
    return n.risk(t("nav_point"))


def _rolling(y: int) -> str:
    w = int(y * 365.25)
    points = (("min", "0.0::double"), ("p5", "0.05::double"), ("p25", "0.25::double"), ("median", "0.5::double"), ("p75", "0.75::double"), ("p95", "0.95::double"), ("max", "1.0::double"))
    return f"""+ s as (select plan_id, date, nav, first(nav) over q n0 from nav_point window q as (partition by plan_id order by date range between interval {w} day preceding and interval {w - 5} day preceding)),
r as (select plan_id, case when n0 > 0 then nav / n0 - 1 end ret from s),
k as (select plan_id, ret, row_number() over (partition by plan_id order by ret) rk, count(*) over (partition by plan_id) c from r where ret is not null)
select plan_id, """ + ", ".join(f"round(max(ret) filter (rk = round_even({q} * (c - 1), 0) + 1), 6) {k}" for k, q in points) + ", round(avg(case when ret < 0 then 1.0 else 0.0 end), 6) share_negative, count(*) n from k group by 1"


_ROLLED = {c: 6 for c in ("min", "p5", "p25", "median", "p75", "p95", "max", "share_negative")}


@query(_rolling(1), "nav_point", **_ROLLED)
def rolling_distribution(t, _):
    return n.rolling_distribution(t("nav_point"), 1)


@query(_rolling(3), "nav_point", **_ROLLED)
def rolling_distribution_3y(t, _):
    return n.rolling_distribution(t("nav_point"), 3)


@query(_rolling(5), "nav_point", **_ROLLED)
def rolling_distribution_5y(t, _):
    return n.rolling_distribution(t("nav_point"), 5)


@query("""+ h as (select *, case when nav > max(nav) over (partition by plan_id order by date rows between unbounded preceding and 1 preceding) is not false then 1 else 0 end hi from nav_point),
e as (select *, sum(hi) over (partition by plan_id order by date rows between unbounded preceding and current row) ep from h),
g as (select plan_id, ep, min(date) pd, arg_min(nav, date) pn, min((nav, date)) tr from e group by 1, 2),
x as (select plan_id, pd peak_date, tr[2] trough_date, lead(pd) over (partition by plan_id order by ep) recovery, case when pn > 0 then tr[1] / pn - 1 end depth from g)
select plan_id, peak_date, trough_date, recovery, round(depth, 6) depth, date_diff('day', peak_date, trough_date)::int days_down, date_diff('day', trough_date, recovery)::int days_up from x where depth <= -0.1""", "nav_point", depth=6)
def drawdown_episodes(t, _):
    return n.drawdowns(t("nav_point"))


_STRESS = {"early": ("1994-02-20", "1994-06-30"), "late": ("1997-01-01", "1997-09-30")}


@query(" select plan_id, " + ", ".join(f"round(case when arg_max(nav, date) filter (date <= date '{a}') > 0 then arg_max(nav, date) filter (date <= date '{b}') / arg_max(nav, date) filter (date <= date '{a}') - 1 end, 6) {k}" for k, (a, b) in _STRESS.items()) + " from nav_point group by 1", "nav_point", early=6, late=6)
def stress_windows(t, _):
    return n.window_returns(t("nav_point"), _STRESS)


@query("""+ l as (select plan_id, date, ln(nav / lag(nav) over (partition by plan_id order by date)) lg from nav_point),
x as (select scheme_id, plan_type, date, lg from l join plan using (plan_id) where lg is not null and option_type = 'Growth'),
g as (select a.scheme_id, avg(a.lg - b.lg) gap, count(*) n, min(a.date) first_date, max(a.date) last_date from x a join x b on a.scheme_id = b.scheme_id and a.date = b.date and a.plan_type = 'Direct' and b.plan_type = 'Regular' group by 1)
select scheme_id, case when n >= 30 then round(gap * 2520000, 1) end gap_bps, n, first_date, last_date from g""", "nav_point plan")
def cost_gaps(t, _):
    return n.cost_gap(t("plan"), t("nav_point"))


@query("""+ j as (select a.plan_id, a.date, a.nav f, b.nav b from nav_point a join nav_point b on a.date = b.date and b.plan_id = 'plan-1' where a.plan_id <> 'plan-1'),
r as (select plan_id, f / lag(f) over w - 1 f, b / lag(b) over w - 1 r from j window w as (partition by plan_id order by date)),
g as (select plan_id, count(*) n, covar_samp(f, r) / nullif(var_samp(r), 0) beta, pow(1 + avg(f), 252) - 1 mf, pow(1 + avg(r), 252) - 1 mr, avg(f - r) * 252 / nullif(stddev_samp(f - r) * sqrt(252), 0) ir,
 sum(f) filter (r > 0) / nullif(sum(r) filter (r > 0), 0) up, sum(f) filter (r < 0) / nullif(sum(r) filter (r < 0), 0) dn from r where f is not null and r is not null group by 1)
select plan_id, n, round(beta, 6) beta, round(ir, 6) information_ratio, round(up, 6) up_capture, round(dn, 6) down_capture, round(mf - (0.065 + beta * (mr - 0.065)), 4) alpha from g""", "nav_point", beta=6, information_ratio=6, up_capture=6, down_capture=6, alpha=4)
def benchmark_relative(t, _):
    return n.against_benchmark(t("nav_point"), "plan-1")


@query(f"""+ w as (select max(date) a from nav_point), q as (select scheme_id, min(plan_id) plan_id from plan where active and plan_type = 'Direct' and option_type = 'Growth' group by 1),
v as (select plan_id, a, max(date) filter (date <= a - 1095) d0, arg_max(nav, date) filter (date <= a - 1095) n0, max(date) d1, arg_max(nav, date) n1 from nav_point, w group by 1, 2),
c as (select q.scheme_id, q.plan_id, category, sub_category, a anchor, {_cagr('d0', 'n0', 'd1', 'n1').replace('round(', '(', 1).replace(', 6)', ')')} cagr from q join scheme using (scheme_id) join v on v.plan_id = q.plan_id where not regexp_matches(lower(name), '\\bseg(regated)?\\.?\\s*portfolio\\b')),
k as (select *, count(*) over g n, rank() over (partition by category, sub_category order by cagr desc) rank, row_number() over (partition by category, sub_category order by cagr) up from c where cagr is not null window g as (partition by category, sub_category))
select scheme_id, plan_id, anchor, category, sub_category, round(cagr, 6) cagr, rank, round(100 * (1 - (rank - 1) / n), 1) percentile, n,
round(max(case when up = n // 2 + 1 then cagr end) over g, 6) median, round(max(case when up = n // 4 + 1 then cagr end) over g, 6) p25, round(max(case when up = least(n - 1, 3 * n // 4) + 1 then cagr end) over g, 6) p75 from k window g as (partition by category, sub_category)""", "nav_point plan scheme", cagr=6, median=6, p25=6, p75=6)
def category_ranks(t, _):
    return n.category_ranks(t("scheme"), t("plan"), t("nav_point"))


@query("""+ u as (select scheme_id, as_of_date, 'asset_class' dimension, coalesce(asset_class, 'other') "name", sum(pct_nav) w from holding group by all
union all select scheme_id, as_of_date, 'sector', trim(industry_or_rating), sum(pct_nav) from holding where asset_class <> 'cash' and trim(industry_or_rating) <> '' group by all)
select scheme_id, as_of_date, dimension, "name", round(w, 6) weight from u""", "holding", weight=6)
def allocations(t, _):
    return p.allocation(t("holding"))


@query("""+ k as (select *, row_number() over (partition by scheme_id, as_of_date order by pct_nav desc) rk from holding where asset_class in ('equity', 'foreign', 'reit') and pct_nav <> 0)
select scheme_id, as_of_date, round(sum(pct_nav) filter (rk <= 5), 6) top_5, round(sum(pct_nav) filter (rk <= 10), 6) top_10, round(sum(pct_nav) filter (rk <= 20), 6) top_20, round(sum(pct_nav * pct_nav), 6) hhi, count(*) n, round(1 / sum(pct_nav * pct_nav), 4) effective_n from k group by all""", "holding", top_5=6, top_10=6, top_20=6, hhi=6, effective_n=4)
def concentrations(t, _):
    return p.concentration(t("holding"))


@query("""+ k as (select *, row_number() over (partition by scheme_id, as_of_date order by coalesce(pct_nav, 0) desc, instrument_name) rank from holding)
select scheme_id, as_of_date, rank, instrument_name "name", isin, round(pct_nav, 6) pct_nav from k where rank <= 10""", "holding", pct_nav=6)
def top_ten_holdings(t, _):
    return p.top_holdings(t("holding"), 10)


_RATIO = "(select min((abs(aq / oq - round_even(aq / oq * v.d, 0) / v.d), v.d, round_even(aq / oq * v.d, 0))) from range(1, 9) v(d))"
_CHANGES = f"""+ s as (select *, lag(as_of_date) over (partition by scheme_id order by as_of_date) prev from (select distinct scheme_id, as_of_date from odd_holding)),
k as (select *, coalesce(nullif(isin, ''), 'NAME::' || instrument_name) "key" from odd_holding qualify row_number() over (partition by scheme_id, as_of_date, coalesce(nullif(isin, ''), 'NAME::' || instrument_name) order by pct_nav nulls first, instrument_name) = 1),
nw as (select k.* from k join s using (scheme_id, as_of_date) where prev is not null), od as (select k.* replace (s.as_of_date as as_of_date) from k join s on k.scheme_id = s.scheme_id and k.as_of_date = s.prev),
b as (select coalesce(a.scheme_id, o.scheme_id) scheme_id, coalesce(a.as_of_date, o.as_of_date) as_of_date, coalesce(a."key", o."key") "key", coalesce(a.instrument_name, o.instrument_name) "name", a.instrument_name an, o.instrument_name obn, a.quantity aq, o.quantity oq, a.pct_nav ap, o.pct_nav op, a.market_value av, o.market_value ov
 from nw a full join od o on a.scheme_id = o.scheme_id and a.as_of_date = o.as_of_date and a."key" = o."key"),
c as (select *, case when obn is null then 'NEW' when an is null then 'EXITED' when aq is null or oq is null then 'UNCHANGED'
 when abs(aq - oq) < 1e-6 * greatest(abs(case when oq = 0 then 1 else oq end), 1) then case when abs(ap - op) > 0.001 then 'PRICE_FLOW_DRIFT' else 'UNCHANGED' end when aq > oq then 'INCREASED' else 'REDUCED' end action from b),
e as (select *, coalesce(action in ('INCREASED', 'REDUCED') and oq <> 0 and aq <> 0 and aq / oq > 0 and abs(aq / oq - 1) >= 1e-6 and (op is null or op = 0 or ap is null or abs(ap / op - 1) < 0.15) and {_RATIO}[1] < 0.005 and {_RATIO}[2] + {_RATIO}[3] <= 12, false) split,
 case action when 'NEW' then aq when 'EXITED' then -oq else aq - oq end dq, case action when 'NEW' then ap when 'EXITED' then -op else ap - op end dp, case action when 'NEW' then av when 'EXITED' then -ov else av - ov end dv from c)"""


@query(_CHANGES + """ select scheme_id, as_of_date, "key", "name", action, dq quantity_change, round(dp, 6) pct_change, round(dv, 2) value_change,
concat_ws(',', case when "key" like 'NAME::%' then 'name_keyed_no_isin' end, case when action = 'PRICE_FLOW_DRIFT' then 'qty_flat_pct_nav_moved' end, case when split then 'corporate_action_suspected' end) flags,
case when split or action = 'PRICE_FLOW_DRIFT' or "key" like 'NAME::%' then 'low' else 'high' end confidence from e""", "holding odd_holding", pct_change=6, value_change=2)
def holding_changes(t, _):
    return p.changes(t("odd_holding")).withColumn("flags", F.array_join("flags", ","))


@query("""+ s as (select *, lead(as_of_date) over (partition by scheme_id order by as_of_date) nxt from (select distinct scheme_id, as_of_date from reissued_holding)),
lst as (select scheme_id, max(as_of_date) m from s group by 1), fst as (select scheme_id, min(as_of_date) m from s group by 1),
ex as (select h.*, s.nxt gone_on from reissued_holding h join s using (scheme_id, as_of_date) where nxt is not null and not exists (select 1 from reissued_holding g where g.scheme_id = h.scheme_id and g.as_of_date = s.nxt and g.isin = h.isin)),
nw as (select h.* from reissued_holding h join s on s.scheme_id = h.scheme_id and s.nxt = h.as_of_date where not exists (select 1 from reissued_holding g where g.scheme_id = h.scheme_id and g.as_of_date = s.as_of_date and g.isin = h.isin)),
pr as (select ex.scheme_id, ex.gone_on as_of_date, ex.isin old_key, nw.isin new_key, case when ex.instrument_name = nw.instrument_name then 'isin_change_suspected' when abs(nw.market_value / ex.market_value - 1) < 0.2 then 'possible_corporate_action_merger' end f from ex join nw on nw.scheme_id = ex.scheme_id and nw.as_of_date = ex.gone_on),
u as (select scheme_id, as_of_date, old_key "key", 'EXITED' action, f from pr where f is not null union all select scheme_id, as_of_date, new_key, 'NEW', f from pr where f is not null)
select scheme_id, as_of_date, "key", action, array_to_string(list_sort(list(distinct f)), ',') flags, 'low' confidence from u group by 1, 2, 3, 4""", "holding reissued_holding")
def succession_flags(t, _):
    found = p.with_successions(p.changes(t("reissued_holding"))).filter("action in ('NEW', 'EXITED') and size(flags) > 0")
    return found.select("scheme_id", "as_of_date", "key", "action", F.array_join(F.array_sort("flags"), ",").alias("flags"), "confidence")


@query("""+ s as (select *, lag(as_of_date) over (partition by scheme_id order by as_of_date) previous from (select distinct scheme_id, as_of_date from holding))
select scheme_id, as_of_date, previous, date_diff('day', previous, as_of_date)::int as days, round_even(date_diff('day', previous, as_of_date) / 31, 0)::bigint periods from s where date_diff('day', previous, as_of_date) > 46.5""", "holding")
def disclosure_gaps(t, _):
    return p.gaps(t("holding"))


@query("""+ k as (select *, coalesce(isin, 'NAME::' || instrument_name) "key", dense_rank() over (partition by scheme_id order by as_of_date desc) back from holding),
g as (select scheme_id, "key", as_of_date, back, sum(pct_nav) pct, row_number() over (partition by scheme_id, "key" order by back) n from k group by 1, 2, 3, 4)
select scheme_id, "key", count(*) held, round(avg(pct), 6) mean_pct, min(as_of_date) first_seen, max(as_of_date) last_seen, count(*) filter (back = n) streak from g group by 1, 2""", "holding", mean_pct=6)
def holding_persistence(t, _):
    return p.persistence(t("holding"))


@query("""+ x as (select scheme_id, isin, sum(pct_nav) pct from holding h where as_of_date = (select max(as_of_date) from holding i where i.scheme_id = h.scheme_id) and asset_class in ('equity', 'foreign', 'reit') and isin is not null group by 1, 2),
z as (select scheme_id, count(*) total from x group by 1)
select a.scheme_id scheme_id_a, b.scheme_id scheme_id_b, round(sum(a.pct), 6) overlap_a, round(sum(b.pct), 6) overlap_b, count(*) common, any_value(za.total) total_a, any_value(zb.total) total_b, round((sum(a.pct) + sum(b.pct)) / 2, 6) overlap
from x a join x b on a.isin = b.isin and a.scheme_id < b.scheme_id join z za on za.scheme_id = a.scheme_id join z zb on zb.scheme_id = b.scheme_id group by 1, 2""", "holding", overlap_a=6, overlap_b=6, overlap=6)
def portfolio_overlap(t, _):
    return p.overlap(p.latest(t("holding")))


@query("""+ e as (select scheme_id, as_of_date, isin, pct_nav pct from holding where asset_class in ('equity', 'foreign', 'reit')),
m as (select e.*, c.market_cap, c.effective_date from e asof left join isin_market_cap c on e.isin = c.isin and e.as_of_date >= c.effective_date),
g as (select scheme_id, as_of_date, sum(case when market_cap = 'large' then pct else 0 end) l, sum(case when market_cap = 'mid' then pct else 0 end) m, sum(case when market_cap = 'small' then pct else 0 end) s, sum(case when market_cap is null then pct else 0 end) u, count(market_cap) n, max(effective_date) d, as_of_date >= (select min(effective_date) from isin_market_cap) ok from m group by 1, 2)
select scheme_id, as_of_date, case when ok then round(l, 6) end large, case when ok then round(m, 6) end mid, case when ok then round(s, 6) end small, case when ok then round(u, 6) end unclassified, case when ok then n end n_classified, case when ok then d end list_date from g""", "holding isin_market_cap", large=6, mid=6, small=6, unclassified=6)
def cap_allocations(t, _):
    return p.cap_allocation(t("holding"), t("isin_market_cap"))


@query("""+ x as (select doc_id, page_number, length(text) len, (length(lower(text)) - length(replace(lower(text), 'license', ''))) // 7 + (length(lower(text)) - length(replace(lower(text), 'version', ''))) // 7 score from document_section),
k as (select *, row_number() over w rank, coalesce(sum(len) over (partition by doc_id order by score desc, page_number rows between unbounded preceding and 1 preceding), 0) bef from x where score > 0 window w as (partition by doc_id order by score desc, page_number))
select doc_id, page_number, score, rank, least(len, 20000 - bef)::bigint chars, md5(case when len <= 20000 - bef then text else text[1:20000 - bef] || '…[truncated]' end) text_md5 from k join document_section using (doc_id, page_number) where bef < 20000""", "document_section")
def page_search(t, _):
    return d.search_pages(t("document_section"), ["license", "version"], 20_000).withColumn("text_md5", F.md5("text")).drop("text")


@query("""+ x as (select doc_id, page_number, case when doc_id like '%0' then '' when doc_id like '%1' and page_number > 1 then ' ' else text end txt from document_section)
select doc_id, count(*) pages, avg(case when length(trim(coalesce(txt, ''))) > 0 then 1.0 else 0.0 end) share, case when max(length(trim(coalesce(txt, '')))) > 0 then 'parsed' else 'unparseable_scanned' end status from x group by 1""", "document_section")
def parse_statuses(t, _):
    blank = F.when(F.col("doc_id").endswith("0"), "").when(F.col("doc_id").endswith("1") & (F.col("page_number") > 1), " ").otherwise(F.col("text"))
    return d.parse_status(t("document_section").withColumn("text", blank))


@query("""with p as (select page_id, coalesce(url, '') own, html || '<a href="/files/Sheet_Mar2024.xlsx ">x</a><a HREF=''report-2023-05-17.pdf''>y</a><a href="//cdn.net/a.xls">z</a>' html from pages),
l as (select distinct page_id, own, trim(unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"'']*)["'']', 1))) href from p),
x as (select *, regexp_extract(own, '^([a-z][a-z0-9+.-]*:)//', 1) sch, regexp_extract(own, '^([a-z][a-z0-9+.-]*://[^/?#]*)', 1) host, regexp_extract(own, '^([a-z][a-z0-9+.-]*://[^?#]*/)', 1) fold from l)
select page_id, href, case when regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') then href when href like '//%' then sch || href when href like '/%' then host || href when fold = sch || '//' then host || '/' || href else fold || href end address,
regexp_matches(lower(href), '\\.(xlsx|xls|pdf)$') is_file, case when href like '%Mar2024%' then date '2024-03-01' when href like '%2023-05-17%' then date '2023-05-01' end file_date from x""")
def file_links(t, _):
    more = """<a href="/files/Sheet_Mar2024.xlsx ">x</a><a HREF='report-2023-05-17.pdf'>y</a><a href="//cdn.net/a.xls">z</a>"""
    return d.file_links(t("pages").withColumn("html", F.concat("html", F.lit(more))), "url", "html")


_NAMES = """+ dd as (select scheme_id, doc_date, list_sort(list(distinct "name")) names from observed_name group by 1, 2), ll as (select *, lag(names) over (partition by scheme_id order by doc_date) bef from dd)"""


@query(_NAMES + " select scheme_id, doc_date, array_to_string(list_sort(list_filter(names, lambda x: not list_contains(bef, x))), ',') added, array_to_string(list_sort(list_filter(bef, lambda x: not list_contains(names, x))), ',') removed from ll where bef is not null", "observed_name")
def name_changes(t, _):
    return m.name_changes(t("observed_name")).withColumns({c: F.array_join(F.array_sort(c), ",") for c in ("added", "removed")})


def _observed(t):
    return t("observed_name").withColumn("managing_since", F.lit(None).cast("date"))


@query("""+ dy as (select scheme_id, doc_date, row_number() over w place, lead(doc_date) over w nxt from (select distinct scheme_id, doc_date from observed_name) window w as (partition by scheme_id order by doc_date)),
sp as (select o.*, place - row_number() over (partition by scheme_id, "name" order by doc_date) spell, nxt from observed_name o join dy using (scheme_id, doc_date))
select scheme_id, "name", min(doc_date) from_date, arg_max(coalesce(nxt, date '9999-01-01'), doc_date) to_date from sp group by scheme_id, "name", spell""", "observed_name")
def name_assignments(t, _):
    return m.spells(_observed(t)).drop("stated").withColumn("to_date", F.coalesce("to_date", F.lit("9999-01-01").cast("date")))


@query("""select lang doc_type, max(date '2020-01-01' + (doc_id % 700)::int) newest, count(*) n, date_diff('day', max(date '2020-01-01' + (doc_id % 700)::int), date '2022-01-01')::int age_days,
case when date_diff('day', max(date '2020-01-01' + (doc_id % 700)::int), date '2022-01-01') > case lang when 'en' then 20 else 60 end then 'degraded' else 'ok' end status from documents group by 1""")
def document_freshness(t, _):
    docs = t("documents").select(F.col("lang").alias("doc_type"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 700).cast("int")).alias("doc_date"))
    return d.freshness(docs, "2022-01-01", {"en": 20})


@query("""+ o as (select * from nav_point where date < date '1997-01-01'), w as (select plan_id, date, nav + 1 nav from nav_point where date >= date '1996-06-01')
select plan_id, date, coalesce(w.nav, o.nav) nav from o full join w using (plan_id, date)""", "nav_point")
def price_upsert(t, _):
    rows = t("nav_point")
    return f.upsert(rows.filter("date < date '1997-01-01'"), rows.filter("date >= date '1996-06-01'").withColumn("nav", F.col("nav") + 1), ["plan_id", "date"])


@query("""select user_id, arg_max(event_type, (ts, event_type)) event_type, min(ts)::date first_seen, max(ts)::date last_seen, max(ts)::date = (select max(ts)::date from events) active from events group by 1""")
def dimension_merge(t, _):
    seen = t("events").select("user_id", "event_type", "ts", F.to_date("ts").alias("seen"))
    return f.merge_dimension(seen, "user_id", ["ts", "event_type"]).drop("ts")


@query("""+ i as (select 'schemes' item, count(*) n, null::date first_day, null::date last_day from scheme union all select 'plans', count(*), null, null from plan union all select 'nav_points', count(*), min(date), max(date) from nav_point union all select 'holdings', count(*), min(as_of_date), max(as_of_date) from holding)
select item, n, coalesce(first_day, date '1900-01-01') first_day, coalesce(last_day, date '1900-01-01') last_day from i""", "nav_point plan scheme holding")
def inventory(t, _):
    none = F.lit("1900-01-01").cast("date")
    parts = [(k, v, c) for k, v, c in (("schemes", "scheme", None), ("plans", "plan", None), ("nav_points", "nav_point", "date"), ("holdings", "holding", "as_of_date"))]
    out = None
    for k, v, c in parts:
        days = [F.coalesce(g(c), none).alias(a) if c else F.first(none).alias(a) for g, a in ((F.min, "first_day"), (F.max, "last_day"))]
        row = t(v).agg(F.count("*").alias("n"), *days).select(F.lit(k).alias("item"), "n", "first_day", "last_day")
        out = row if out is None else out.unionByName(row)
    return out


@query("""+ q as (select scheme_id query_id, name as txt from scheme),
qw as (select query_id, txt, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(txt), '[^a-z0-9]+', ' ', 'g'), '\\b(mid|small|large|flexi|multi|micro)cap\\b', '\\1 cap', 'g')), ' '), lambda x: x not in ('fund', 'plan', 'scheme', 'the', 'of', 'direct', 'regular', 'growth', 'option'))) qs from q),
sw as (select scheme_id, name, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), '\\b(mid|small|large|flexi|multi|micro)cap\\b', '\\1 cap', 'g')), ' '), lambda x: x not in ('fund', 'plan', 'scheme', 'the', 'of', 'direct', 'regular', 'growth', 'option'))) ws from scheme),
m as (select query_id, scheme_id, name, case when lower(name) = lower(txt) then 0.95 when contains(lower(name), lower(txt)) then 0.7 else 0.6 end confidence, len(list_filter(ws, lambda x: not list_contains(qs, x))) extra from qw, sw where len(qs) > 0 and list_has_all(ws, qs)),
k as (select *, row_number() over (partition by query_id order by confidence desc, extra, scheme_id) rank from m)
select query_id, scheme_id, name, confidence::double confidence, extra::int extra, rank from k where rank <= 10""", "scheme")
def name_resolution(t, _):
    asked = t("scheme").select(F.col("scheme_id").alias("query_id"), F.col("name").alias("text"))
    return d.resolve(asked, t("scheme"), 10)


@query("""+ q as (select scheme_id query_id, split_part(name, ' ', 1) || ' ' || split_part(name, ' ', 2) as txt from scheme),
qw as (select query_id, txt, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(txt), '[^a-z0-9]+', ' ', 'g'), '\\b(mid|small|large|flexi|multi|micro)cap\\b', '\\1 cap', 'g')), ' '), lambda x: x not in ('fund', 'plan', 'scheme', 'the', 'of', 'direct', 'regular', 'growth', 'option'))) qs from q),
sw as (select scheme_id, name, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g'), '\\b(mid|small|large|flexi|multi|micro)cap\\b', '\\1 cap', 'g')), ' '), lambda x: x not in ('fund', 'plan', 'scheme', 'the', 'of', 'direct', 'regular', 'growth', 'option'))) ws from scheme),
h as (select a.query_id, b.scheme_id, count(*) hits from (select query_id, unnest(qs) word from qw) a join (select scheme_id, unnest(ws) word from sw) b using (word) group by 1, 2),
m as (select query_id, scheme_id, name, case when lower(name) = lower(txt) then 0.95 when contains(lower(name), lower(txt)) then 0.7 else 0.6 end confidence, len(list_filter(ws, lambda x: not list_contains(qs, x))) extra from h join qw using (query_id) join sw using (scheme_id) where hits = len(qs)),
k as (select *, row_number() over (partition by query_id order by confidence desc, extra, scheme_id) rank from m)
select query_id, scheme_id, name, confidence::double confidence, extra::int extra, rank from k where rank <= 10""", "scheme")
def name_resolution_of_all(t, _):
    asked = t("scheme").select(F.col("scheme_id").alias("query_id"), F.substring_index("name", " ", 2).alias("text"))
    return d.resolve(asked, t("scheme"), 10)



@query("""+ a as (select plan_id, max(date) dd from nav_point group by 1), w as (select h::int h, plan_id, dd, (dd - to_years(h::int))::date s from a, (values (1), (3), (5), (7), (10)) v(h)),
f as (select w.plan_id, h, dd, max(date) filter (date <= s) d0, arg_max(nav, date) filter (date <= s) n0, arg_max(nav, date) n1, max(date) d1 from w join nav_point using (plan_id) group by 1, 2, 3)
select plan_id, dd as_of_day, """ + ", ".join(f"max({_cagr('d0', 'n0', 'd1', 'n1')}) filter (h = {h}) cagr_{h}y" for h in (1, 3, 5, 7, 10)) + " from f group by 1, 2", "nav_point", **{f"cagr_{h}y": 6 for h in (1, 3, 5, 7, 10)})
def calendar_returns(t, _):
    return n.calendar_ladder(t("nav_point"))


@query("""+ m as (select scheme_id, max(as_of_date) nd from holding group by 1), h as (select scheme_id, coalesce(nullif(isin, ''), 'NAME::' || instrument_name) k, as_of_date, instrument_name nm, pct_nav, dense_rank() over (partition by scheme_id order by as_of_date desc) b from holding join m using (scheme_id) where as_of_date >= nd - 744),
g as (select scheme_id, k, as_of_date, b, sum(pct_nav) pct, max(nm) nm from h group by 1, 2, 3, 4), r as (select *, row_number() over (partition by scheme_id, k order by b) n from g),
s as (select scheme_id, k "key", count(*) held, round(avg(pct), 6) mean_pct, min(as_of_date) first_seen, max(as_of_date) last_seen, count(*) filter (b = n) streak, arg_max(nm, as_of_date) "name" from r group by 1, 2)
select *, row_number() over (partition by scheme_id order by streak desc, held desc, "key") place from s""", "holding", mean_pct=6)
def recent_holding_persistence(t, _):
    return p.recent_persistence(t("holding"), 24)


@query("""+ m as (select scheme_id, max(as_of_date) nd from holding group by 1), w as (select 'set-' || (substr(scheme_id, 8)::int % 2)::varchar set_id, scheme_id from (select distinct scheme_id from scheme) where substr(scheme_id, 8)::int < 12),
x as (select h.scheme_id, isin, sum(coalesce(pct_nav, 0)) pct from holding h join m on m.scheme_id = h.scheme_id and nd = as_of_date where isin is not null and asset_class in ('equity', 'foreign', 'reit', 'other') group by 1, 2), z as (select scheme_id, count(*) total from x group by 1),
c as (select a.scheme_id sa, b.scheme_id sb, sum(a.pct) pa, sum(b.pct) pb, count(*) c, string_agg(a.isin, ',' order by -(a.pct + b.pct) / 2, a.isin) l from x a join x b on a.isin = b.isin and a.scheme_id < b.scheme_id group by 1, 2)
select p.set_id, p.scheme_id scheme_id_a, q.scheme_id scheme_id_b, round(coalesce(pa, 0), 6) overlap_a, round(coalesce(pb, 0), 6) overlap_b, round((coalesce(pa, 0) + coalesce(pb, 0)) / 2, 6) overlap, coalesce(c, 0) common, coalesce(za.total, 0) total_a, coalesce(zb.total, 0) total_b, md5(coalesce(l, '')) holdings
from w p join w q on p.set_id = q.set_id and p.scheme_id < q.scheme_id left join c on sa = p.scheme_id and sb = q.scheme_id left join z za on za.scheme_id = p.scheme_id left join z zb on zb.scheme_id = q.scheme_id""", "scheme holding", overlap_a=6, overlap_b=6, overlap=6)
def requested_overlap(t, _):
    number = F.expr("cast(substring(scheme_id, 8) as int)")
    asked = t("scheme").filter(number < 12).select(F.concat(F.lit("set-"), (number % 2).cast("string")).alias("set_id"), "scheme_id")
    found = p.overlap_within(p.latest(t("holding")), asked)
    return found.withColumn("holdings", F.md5(F.array_join(F.transform("holdings", lambda h: h["isin"]), ",")))


@query("""+ s as (select distinct scheme_id, as_of_date, case when month(as_of_date) = 12 then 'half_yearly' else 'monthly' end cadence from holding),
l as (select *, lag(as_of_date) over w previous, lag(cadence) over w cb from s window w as (partition by scheme_id order by as_of_date)),
k as (select *, date_diff('day', previous, as_of_date)::int "days", case cadence when 'monthly' then 31 else 182 end e, case when cadence <> cb then 'cadence_changed' when date_diff('day', previous, as_of_date) > 1.5 * case cadence when 'monthly' then 31 else 182 end then 'gap' end why from l where previous is not null)
select scheme_id, as_of_date, previous, "days", case when why = 'gap' then round_even("days" / e, 0)::bigint end periods, why from k where why is not null""", "holding")
def cadence_gaps(t, _):
    cadence = F.when(F.month("as_of_date") == 12, "half_yearly").otherwise("monthly")
    return p.cadence_gaps(t("holding").select("scheme_id", "as_of_date", cadence.alias("cadence")))


@query("""select 'amc-' || source amc_id, lang doc_type, max(date '2020-01-01' + (doc_id % 700)::int) newest, count(*) n, date_diff('day', max(date '2020-01-01' + (doc_id % 700)::int), date '2022-01-01')::int age_days,
case when date_diff('day', max(date '2020-01-01' + (doc_id % 700)::int), date '2022-01-01') > case lang when 'en' then 20 else 60 end then 'degraded' else 'ok' end status from documents group by 1, 2""")
def house_freshness(t, _):
    docs = t("documents").select(F.concat(F.lit("amc-"), "source").alias("amc_id"), F.col("lang").alias("doc_type"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 700).cast("int")).alias("doc_date"))
    return d.freshness(docs, "2022-01-01", {"en": 20})


@query("+ a as (select distinct scheme_id from plan where active) select scheme_id, as_of_date, isin, instrument_name from holding join a using (scheme_id) where as_of_date >= date '1997-06-30'", "plan holding")
def holdings_since(t, _):
    rows = t("holding").select("scheme_id", "as_of_date", "isin", "instrument_name")
    return d.history(rows, "as_of_date", "1997-06-30", t("plan").filter("active"))


@query("""select 'North & House ' || k::varchar house, 'North & House ' || least(k - k % 3 + 2, m)::varchar canonical, 'amc-north-house-' || k::varchar id, 'amc-north-house-' || least(k - k % 3 + 2, m)::varchar canonical_id
from (select distinct n_nationkey k, (select max(n_nationkey) from nation) m from nation)""")
def house_identity(t, _):
    name = lambda c: F.concat(F.lit("North & House "), c.cast("string"))
    k = F.col("n_nationkey")
    houses = t("nation").select(name(k).alias("house"), "n_nationkey")
    renames = houses.join(t("nation").select((k - 1).alias("n_nationkey"), name(k).alias("now")), "n_nationkey").filter(k % 3 != 2)
    return h.canonical_houses(houses.select("house"), renames.select("house", "now"))


@query("""+ s as (select scheme_id, any_value(name) nm, 'amc-' || trim(regexp_replace(lower(any_value(sub_category)), '[^a-z0-9]+', '-', 'g'), '-') amc_id, bool_or(active) active from scheme join plan using (scheme_id) group by 1)
select scheme_id, amc_id, case when length(scheme_id) % 2 = 0 then 'by hand' else nm end hint from s where length(scheme_id) % 2 = 0 or active""", "scheme plan")
def scheme_registration(t, _):
    active = t("plan").groupBy("scheme_id").agg(F.max("active").alias("active"))
    schemes = t("scheme").join(active, "scheme_id").select("scheme_id", "name", F.concat(F.lit("amc-"), f.slug(F.col("sub_category"))).alias("amc_id"), "active")
    hints = schemes.filter(F.length("scheme_id") % 2 == 0).select("scheme_id", "amc_id", F.lit("by hand").alias("hint"))
    return h.registered(schemes, hints)
