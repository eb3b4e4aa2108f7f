"""Queries of identity, search, benchmarks, statuses, events and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from navella.operators import expenses as e
from navella.operators import funds as u
from navella.operators import managers as m
from navella.operators import nav as n
from navella.operators import portfolio as p
from navella.plans.documents import _COSTS, _PEOPLE, _costs, _people
from navella.plans.registry import query

_POOL = """pl as (select q.*, s.name, s.category, s.sub_category, 'house-' || (length(s.sub_category) % 5)::varchar house_id, 'House ' || (length(s.sub_category) % 5)::varchar house, right(q.plan_id, length(q.plan_id) - 5) code,
 case when substr(q.plan_id, 6)::int % 3 = 0 then null else 'INF' || lpad(substr(q.plan_id, 6), 9, '0') end isin from plan q join scheme s using (scheme_id))"""


def _pool(t):
    number = F.expr("substring(plan_id, 6)")
    plans = t("plan").withColumns({"code": number, "isin": F.when(number.cast("int") % 3 != 0, F.concat(F.lit("INF"), F.lpad(number, 9, "0")))})
    schemes = t("scheme").withColumn("house_id", F.concat(F.lit("house-"), (F.length("sub_category") % 5).cast("string")))
    houses = schemes.select("house_id").distinct().withColumn("house", F.concat(F.lit("House "), F.substring("house_id", 7, 9)))
    return u.pool(plans, schemes, houses)


@query(f"+ {_POOL} select plan_id, scheme_id, plan_type, option_type, active, name, category, house from pl", "plan scheme")
def search_pool(t, _):
    return _pool(t).select("plan_id", "scheme_id", "plan_type", "option_type", "active", "name", "category", "house")


_W = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x not in ('fund', 'plan', 'scheme', 'the', 'of', 'direct', 'regular', 'growth', 'option', '')))"


@query(f"""+ {_POOL}, nm as (select distinct scheme_id, name, house, split_part(name, ' ', 1) w1, split_part(name, ' ', 2) w2 from pl),
ql as (select 'isin ' || plan_id query_id, lower(isin) txt, lower(isin) q from pl where isin is not null union all select 'code ' || plan_id, code, code from pl
 union all select 'name ' || scheme_id, upper(name), lower(name) from nm union all select 'part ' || scheme_id, w1 || ' ' || w2, lower(w1 || ' ' || w2) from nm union all select 'words ' || scheme_id, w2 || ' ' || w1 || ' of the plan', lower(w2 || ' ' || w1 || ' of the plan') from nm union all select 'none ' || scheme_id, 'zzz' || w1, 'zzz' || w1 from nm),
ex as (select query_id, scheme_id, name, 1.0 c from ql join pl on q = lower(isin) or q = code), tq as (select distinct q from ql),
li as (select q, scheme_id, name, case when lower(name) = q then 0.95 when contains(lower(name), q) then 0.7 else 0.5 end c from nm join tq on contains(lower(name), q) or contains(lower(house), q)),
lt as (select query_id, scheme_id, name, max(c) c from (select * from ex union all select query_id, scheme_id, name, c from ql join li using (q)) group by 1, 2, 3),
wq as (select query_id, txt, {_W.format('txt')} qs from ql where query_id not in (select query_id from lt)), wn as (select scheme_id, name, {_W.format('name')} ws from nm),
h as (select a.query_id, b.scheme_id, count(*) hits from (select query_id, unnest(qs) word from wq) a join (select scheme_id, unnest(ws) word from wn) b using (word) group by 1, 2),
wm as (select query_id, scheme_id, name, 0.6 c, len(list_filter(ws, lambda x: not list_contains(qs, x))) extra from h join wq using (query_id) join wn using (scheme_id) where hits = len(qs)),
al as (select *, 0 extra, 'literal' via from lt union all select *, 'word_match' from wm), rk as (select *, row_number() over (partition by query_id order by c desc, extra, scheme_id) rank from al)
select ql.query_id, scheme_id, name, c::double confidence, extra::int extra, coalesce(via, 'no_match') via, rank from ql left join (select * from rk where rank <= 10) using (query_id)""", "plan scheme")
def fund_search(t, _):
    plans = _pool(t)
    names = plans.select("scheme_id", "name").distinct().withColumns({"w1": F.split("name", " ")[0], "w2": F.split("name", " ")[1]})
    ask = lambda rows, kind, key, text: rows.select(F.concat(F.lit(f"{kind} "), key).alias("query_id"), text.alias("text"))
    two = F.concat_ws(" ", "w2", "w1", F.lit("of the plan"))
    asked = ask(plans.filter("isin is not null"), "isin", F.col("plan_id"), F.lower("isin")).unionByName(ask(plans, "code", F.col("plan_id"), F.col("code")))
    for kind, text in (("name", F.upper("name")), ("part", F.concat_ws(" ", "w1", "w2")), ("words", two), ("none", F.concat(F.lit("zzz"), "w1"))):
        asked = asked.unionByName(ask(names, kind, F.col("scheme_id"), text))
    return u.resolve_funds(asked, plans).select("query_id", "scheme_id", "name", "confidence", "extra", "via", "rank")


@query("""+ m as (select distinct scheme_id from observed_name), h as (select distinct scheme_id from holding), dd as (select distinct 'scheme-' || (doc_id % 40)::varchar scheme_id from documents), v as (select scheme_id, max(date) e from nav_point join plan using (plan_id) group by 1)
select s.scheme_id, e nav_coverage_end, s.scheme_id in (select * from h) has_portfolio, s.scheme_id in (select * from m) has_factsheet, s.scheme_id in (select * from dd) has_documents from scheme s left join v using (scheme_id)""", "scheme plan nav_point holding observed_name")
def fund_availability(t, _):
    papers = t("documents").select(F.concat(F.lit("scheme-"), (F.col("doc_id") % 40).cast("string")).alias("scheme_id"))
    return u.availability(t("scheme"), t("plan"), t("nav_point"), t("holding"), t("observed_name"), papers)


_REGISTRY = [(0, "index 2 tri", "2", None, ["fund 2"]), (1, "index 4 tri", "4", "INF000000004", ["fund"]), (2, "index 5 tri", "5", None, []), (3, "index 10 tri", "10", "INF999999999", []), (4, "index 99999 tri", "99999", None, []), (5, "index 16 tri", "16", None, ["nowhere"]), (6, "tri", "12", None, [])]


@query("""+ b as (select distinct 'The Index ' || (substr(plan_id, 6)::int % 20)::varchar || ' TRI' benchmark_name from plan union all select 'Something else'), m as (select substr(plan_id, 6)::int k, plan_id, plan_type, option_type from plan),
r as (select *, case when benchmark_name not like '%TRI' then null else case substr(benchmark_name, 11)[1:-5] when '2' then 2 when '4' then 4 when '5' then 5 when '10' then 10 when '16' then 16 else 12 end end k from b)
select benchmark_name, case when r.k in (2, 4, 12) and option_type = 'Growth' then plan_id end proxy_plan_id, case when r.k is null then 'no_proxy' when plan_id is null then 'not_loaded' when r.k in (5, 10, 16) or option_type <> 'Growth' then 'mismatch' else 'proxy' end status from r left join m on m.k = r.k""", "plan")
def benchmark_proxies(t, spark):
    registry = spark.createDataFrame(_REGISTRY, "place int, key string, code string, isin string, words array<string>")
    number = F.expr("cast(substring(plan_id, 6) as int)")
    named = t("plan").select(F.concat(F.lit("The Index "), (number % 20).cast("string"), F.lit(" TRI")).alias("benchmark_name")).union(spark.createDataFrame([("Something else",)], "benchmark_name string"))
    return u.proxies(named, registry, _pool(t))


@query("""+ a as (select plan_id, max(date) anchor from nav_point group by 1), aa as (select distinct anchor from a), x as (select anchor, date, nav from aa join nav_point on plan_id = 'plan-1'),
t as (select anchor, max(date) filter (date <= anchor) d0, arg_max(nav, date) filter (date <= anchor) n0, """ + ", ".join(f"max(date) filter (date <= anchor - {int(h * 365.25)}) d{h}, arg_max(nav, date) filter (date <= anchor - {int(h * 365.25)}) n{h}" for h in (1, 3, 5)) + """ from x group by 1)
select 'plan-1' proxy_plan_id, anchor, """ + ", ".join(f"round(case when n{h} > 0 and d0 > d{h} then case when date_diff('day', d{h}, d0) < 365.25 then n0 / n{h} - 1 else pow(n0 / n{h}, 365.25 / date_diff('day', d{h}, d0)) - 1 end end, 6) benchmark_cagr_{h}y" for h in (1, 3, 5)) + " from t", "nav_point", **{f"benchmark_cagr_{h}y": 6 for h in (1, 3, 5)})
def benchmark_growth(t, _):
    anchors = t("nav_point").groupBy("plan_id").agg(F.max("date").alias("anchor")).select(F.lit("plan-1").alias("proxy_plan_id"), "anchor")
    return u.benchmark_trailing(anchors, t("nav_point"))


@query("""+ h as (select scheme_id, case scheme_id[-1] when '1' then 'h1' when '2' then 'h2' else 'h3' end hid, max(as_of_date) newest from holding where not (scheme_id in ('scheme-1', 'scheme-4') and as_of_date > date '1998-01-01') group by 1, 2)
select scheme_id, newest, date_diff('day', newest, date '1999-01-15')::int as days, case hid when 'h1' then 'degraded' else 'unknown' end status, 'Portfolio data is ' || date_diff('day', newest, date '1999-01-15')::varchar || ' days old (last snapshot: ' || newest::varchar || ')' || case hid when 'h1' then '; source as of 1999-01-02: degraded' else '' end warning from h where date_diff('day', newest, date '1999-01-15') > 60""", "holding")
def stale_portfolios(t, spark):
    last = F.substring("scheme_id", -1, 1)
    house = F.when(last == "1", "h1").when(last == "2", "h2").otherwise("h3")
    rows = t("holding").filter("not (scheme_id in ('scheme-1', 'scheme-4') and as_of_date > date '1998-01-01')").withColumn("house_id", house)
    known = rows.select("house_id").distinct().filter("house_id = 'h1'").select("house_id", F.lit("degraded").alias("status"), F.lit("1999-01-02").cast("date").alias("checked_on"))
    return u.staleness(rows, known, "1999-01-15")


@query(" select plan_id, date, nav from nav_point where date between date '1995-03-01' and date '1996-02-29' and plan_id in (select plan_id from plan where active)", "nav_point plan")
def price_range(t, _):
    return u.prices(t("nav_point"), t("plan").filter("active"), "1995-03-01", "1996-02-29")


@query("""+ a as (select scheme_id from scheme union select 'scheme-x' || (n_nationkey)::varchar from nation), k as (select scheme_id, max(c) m from (select plan_id, count(*) c from nav_point where date < date '1992-03-01' group by 1) join plan using (plan_id) group by 1)
select a.scheme_id, case when a.scheme_id not in (select scheme_id from plan) then 'no_plans_found' when coalesce(m, 0) < 2 then 'insufficient_nav_history' when a.scheme_id not in (select scheme_id from holding) then 'no_portfolio_data' else 'ok' end status from a left join k using (scheme_id)""", "scheme plan nav_point holding")
def fund_statuses(t, _):
    asked = t("scheme").select("scheme_id").union(t("nation").select(F.concat(F.lit("scheme-x"), F.col("n_nationkey").cast("string"))))
    return u.with_statuses(asked, t("plan"), t("nav_point").filter("date < date '1992-03-01'"), t("holding"))


@query("""+ f as (select scheme_id, doc_date detected_date, name event_type from observed_name where name in ('purchase', 'signup') and doc_date >= (select max(doc_date) - 10 from observed_name))
select scheme_id, detected_date, event_type, row_number() over (partition by scheme_id order by detected_date desc, event_type) place from f""", "observed_name")
def fund_events(t, _):
    rows = t("observed_name").withColumnsRenamed({"doc_date": "detected_date", "name": "event_type"})
    since = rows.agg(F.date_sub(F.max("detected_date"), 10)).first()[0]
    return u.events_of(rows, ["purchase", "signup"], str(since))


@query("""+ dy as (select scheme_id, doc_date, row_number() over w place, lead(doc_date) over w nxt from (select distinct scheme_id, doc_date from observed_name) window w as (partition by scheme_id order by doc_date)),
sp as (select o.*, place - row_number() over (partition by scheme_id, "name" order by doc_date) spell, nxt from observed_name o join dy using (scheme_id, doc_date)),
x as (select scheme_id, "name", min(doc_date) from_date, arg_max(coalesce(nxt, date '9999-01-01'), doc_date) t from sp group by scheme_id, "name", spell)
select scheme_id, "name", from_date, t = date '9999-01-01' "current", row_number() over (partition by scheme_id order by from_date, "name") place from x""", "observed_name")
def manager_timeline(t, _):
    return u.timeline(m.spells(t("observed_name").withColumn("managing_since", F.lit(None).cast("date"))).drop("stated")).drop("to_date")


@query("""select lang "name", source kind, case when count(*) > 40 then 'ok' when count(*) > 5 then 'degraded' else 'broken' end status, row_number() over (partition by source order by case when count(*) > 40 then 2 when count(*) > 5 then 1 else 0 end, lang) place from documents group by lang, source""")
def sources_worst_first(t, _):
    counts = t("documents").groupBy(F.col("lang").alias("name"), F.col("source").alias("kind")).agg(F.count("*").alias("c"))
    status = F.when(F.col("c") > 40, "ok").when(F.col("c") > 5, "degraded").otherwise("broken")
    return u.worst_first(counts.select("name", "kind", status.alias("status")))


@query("""+ g as (select scheme_id, as_of_date, trim(industry_or_rating) "name", sum(pct_nav) w from holding where asset_class <> 'cash' group by 1, 2, 3)
select scheme_id, as_of_date, "name", round(w, 6) weight, row_number() over (partition by scheme_id, as_of_date order by w desc, "name") place from g""", "holding", weight=6)
def sectors_by_weight(t, _):
    from pyspark.sql import Window

    rows = p.allocation(t("holding")).filter("dimension = 'sector'").drop("dimension")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("scheme_id", "as_of_date").orderBy(F.desc("weight"), "name")))


@query("""+ a as (select plan_id, max(date) anchor from nav_point group by 1), t as (select plan_id, count(*) n, arg_max(nav, date) n1, max(date) d1, """ + ", ".join(f"max(date) filter (date <= anchor - {int(h * 365.25)}) d_{h}, arg_max(nav, date) filter (date <= anchor - {int(h * 365.25)}) n_{h}" for h in (2, 4, 6)) + """ from nav_point join a using (plan_id) group by 1)
select plan_id, """ + ", ".join(f"round(pow(n1 / n_{h}, 365.25 / date_diff('day', d_{h}, d1)) - 1, 6) cagr_{h}y" for h in (2, 4, 6)) + " from t", "nav_point", cagr_2y=6, cagr_4y=6, cagr_6y=6)
def trailing_even_years(t, _):
    return n.trailing(t("nav_point"), (2, 4, 6)).drop("anchor", "n", "cagr_inception")


@query(f"""{_COSTS}, {_PEOPLE[2:]}, lc as (select distinct scheme_id, unnest(['Direct', 'Regular']) plan_type from plan), gp as (select distinct scheme_id, plan_type from plan where option_type = 'Growth'), mc as (select scheme_id, plan_type, max(doc_date) dd, arg_max(pct, doc_date) p from cc where ratio_type = 'TER' group by 1, 2),
tc as (select lc.scheme_id, lower(lc.plan_type) k, case when gp.scheme_id is not null then p end v, case when gp.scheme_id is null then 'no_' || lower(lc.plan_type) || '_growth_plan' when mc.scheme_id is null then 'not_yet_ingested' else 'as of ' || dd::varchar end c from lc left join gp on gp.scheme_id = lc.scheme_id and gp.plan_type = lc.plan_type left join mc on mc.scheme_id = lc.scheme_id and mc.plan_type = lc.plan_type),
oc as (select scheme_id, "name", max(managing_since) s from pp where not gone and doc_date = date '2026-08-31' group by 1, 2)
select scheme_id, 'name' fact, name as "value", 'price_file' source, 'official' kind, null caveat from scheme union all select scheme_id, 'category', category, 'price_file', 'official', null from scheme union all select scheme_id, 'sub_category', sub_category, 'price_file', 'official', null from scheme
union all select scheme_id, 'plans', '[' || string_agg('{{"plan_id":"' || plan_id || '","plan_type":"' || plan_type || '","option_type":"' || option_type || '"}}', ',' order by plan_id) || ']', 'price_file', 'official', null from plan group by 1
union all select scheme_id, 'ter_' || k, round(v, 2)::decimal(9, 2)::varchar, 'factsheet', 'official', c from tc
union all select s.scheme_id, 'managers', coalesce('[' || string_agg('{{"name":"' || "oc"."name" || '","managing_since":"' || s::varchar || '"}}', ',' order by "oc"."name") || ']', '[]'), 'factsheet', 'observed', case when count(oc.scheme_id) = 0 then 'no factsheet names any' end from scheme s left join oc using (scheme_id) group by 1
union all select scheme_id, 'documents', case when scheme_id in (select scheme_id from factsheet) then '3' else '0' end, 'document_index', 'official', null from scheme""", "factsheet plan scheme")
def fund_profiles(t, _):
    found, pages = _people(t)
    last = pages.filter("doc_date = date '2026-08-31'")
    people = m.current_managers(found, last).join(last.select("doc_id", "scheme_id"), "doc_id")
    facts = u.profiles(t("scheme"), t("plan"), e.latest_costs(t("plan"), _costs(t)), n.cost_gap(t("plan"), t("nav_point")), people, pages)
    # the gap has a query of its own; here its digits would be compared as text
    facts = facts.filter("fact <> 'realised_direct_regular_spread_bps'")
    number = F.expr("format_number(cast(value as double), '0.00')")
    return facts.withColumn("value", F.when(F.col("fact").startswith("ter_"), number).otherwise(F.col("value")))
