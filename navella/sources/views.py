"""Domain views over the star-schema tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "supplier", "part", "lineitem", "documents", "pages", "events")

#: name: (tables or views it reads, query). A name in braces is a table or view.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "nav_point": (("lineitem",), """
select concat('plan-', cast(l_suppkey as string)) as plan_id, cast(l_shipdate as date) as date, max(l_extendedprice) as nav
from {lineitem} group by l_suppkey, cast(l_shipdate as date)"""),
    "plan": (("supplier",), """
select concat('plan-', cast(s_suppkey as string)) as plan_id,
       concat('scheme-', cast(cast(floor(s_suppkey / 2) as bigint) as string)) as scheme_id,
       case when s_suppkey % 2 = 0 then 'Direct' else 'Regular' end as plan_type,
       case when s_suppkey % 10 >= 8 then 'IDCW' else 'Growth' end as option_type, s_acctbal >= 0 as active
from {supplier}"""),
    "scheme": (("supplier", "nation", "region", "part"), """
select concat('scheme-', cast(cast(floor(s_suppkey / 2) as bigint) as string)) as scheme_id,
       concat(p_name, ' fund ', cast(s_suppkey as string)) as name, r_name as category, n_name as sub_category
from {supplier} join {nation} on n_nationkey = s_nationkey join {region} on r_regionkey = n_regionkey
join {part} on p_partkey = s_suppkey where s_suppkey % 2 = 0"""),
    "holding": (("lineitem", "part"), """
with h as (
  select l_suppkey % 10 as s, last_day(cast(date_trunc('quarter', l_shipdate) + interval 2 month as date)) as as_of_date,
         l_partkey % (select cast(count(*) / 10 as bigint) from {part}) as i,
         sum(l_quantity) as quantity, sum(cast(l_extendedprice as decimal(18,2))) as value
  from {lineitem} group by 1, 2, 3)
select concat('scheme-', cast(s as string)) as scheme_id, as_of_date,
       case when i % 10 = 9 then null else concat('INE', lpad(cast(i as string), 9, '0')) end as isin,
       concat('Holding ', cast(i as string)) as instrument_name, concat('Sector ', cast(i % 7 as string)) as industry_or_rating,
       quantity, cast(value as double) as market_value,
       cast(value as double) / cast(sum(value) over (partition by s, as_of_date) as double) as pct_nav,
       case when i % 10 = 9 then 'cash' when i % 10 = 8 then 'debt' when i % 10 = 7 then 'foreign' else 'equity' end as asset_class
from h"""),
    # holdings with odd cases: empty isins, quantities and weights that aren't known, prices that move alone, splits
    "odd_holding": (("holding",), """
select scheme_id, as_of_date, case when isin like '%5' and quantity < 30 then '' else isin end as isin, instrument_name, industry_or_rating,
       case when isin like '%03' then null when isin like '%04' then 1000.0 when isin like '%06' then 100.0 * year(as_of_date) - 190000.0 when isin like '%07' then 1000.0 + 3.0 * (year(as_of_date) % 2) else cast(quantity as double) end as quantity,
       market_value, case when isin like '%13' then null when isin like '%06' then 0.01 else pct_nav end as pct_nav, asset_class
from {holding}"""),
    # debt holdings whose isins are issued anew each year, under names that tell them apart
    "reissued_holding": (("holding",), """
select scheme_id, as_of_date, concat(isin, cast(year(as_of_date) as string)) as isin, md5(isin) as instrument_name, industry_or_rating,
       quantity, market_value, pct_nav, asset_class
from {holding} where asset_class = 'debt'"""),
    "ranked_part": (("part",), """
with l as (
  select p_partkey, effective_date, row_number() over (partition by effective_date
           order by p_retailprice * (1 + ((p_partkey * 7 + k * 3) % 13) / 100.0) desc, p_partkey) as rk
  from {part} cross join (values (date '1996-06-30', 0), (date '1997-12-31', 1), (date '1999-06-30', 2), (date '2000-12-31', 3)) as v(effective_date, k))
select concat('INE', lpad(cast(p_partkey as string), 9, '0')) as isin, effective_date, rk,
       case when rk <= 100 then 'large' when rk <= 250 then 'mid' else 'small' end as market_cap
from l"""),
    "isin_market_cap": (("part",), """
with l as (
  select p_partkey, effective_date, row_number() over (partition by effective_date
           order by p_retailprice * (1 + ((p_partkey * 7 + k * 3) % 13) / 100.0) desc, p_partkey) as rk
  from {part} cross join (values (date '1996-06-30', 0), (date '1997-12-31', 1), (date '1999-06-30', 2), (date '2000-12-31', 3)) as v(effective_date, k)
  where p_partkey < (select cast(count(*) / 10 as bigint) from {part}))
select concat('INE', lpad(cast(p_partkey as string), 9, '0')) as isin, effective_date,
       case when rk <= 100 then 'large' when rk <= 250 then 'mid' else 'small' end as market_cap
from l"""),
    # what stands in price files, one row a plan; files of three layouts; see inputs.price_lines
    "price_row": (("supplier",), """
select concat('f', cast(s_suppkey % 3 as string)) as file, cast(100000 + s_suppkey as string) as code, s_suppkey as n,
       case when s_suppkey % 5 = 0 then '-' when s_suppkey % 5 = 1 then 'Redeemed' else concat('INF', lpad(cast(s_suppkey as string), 9, '0')) end as isin1,
       case when s_suppkey % 4 = 0 then concat('INR', lpad(cast(s_suppkey as string), 9, '0')) when s_suppkey % 4 = 1 then 'N/A' else '' end as isin2,
       concat('Alpha ', cast(cast(floor(s_suppkey / 6) as bigint) as string), ' Growth Fund') as base,
       case when s_suppkey % 2 = 0 then 'Direct Plan' else 'Regular Plan' end as plan_text,
       case when s_suppkey % 9 = 3 then 'IDCW Payout' when s_suppkey % 9 = 6 then 'IDCW Reinvestment' when s_suppkey % 9 = 7 then 'IDCW' else 'Growth Option' end as option_text,
       s_suppkey % 3 = 1 and s_suppkey % 7 <> 0 as by_columns,
       case when s_suppkey % 11 = 0 then 'N.A.' else concat(cast(cast(floor(abs(s_acctbal)) as bigint) as string), '.25') end as nav_text,
       case when s_suppkey % 13 = 0 then 'soon' when s_suppkey % 6 = 0 then concat(lpad(cast(s_suppkey % 28 + 1 as string), 2, '0'), '-Mar-24')
            else concat(lpad(cast(s_suppkey % 28 + 1 as string), 2, '0'), '-Mar-2024') end as date_text, s_suppkey % 28 + 1 as day_no,
       case when s_suppkey % 17 = 0 then '' else concat('North & House ', cast(s_nationkey as string)) end as house,
       case when s_nationkey % 3 = 0 then 'Open Ended Schemes(Equity Scheme - Mid Cap Fund)' when s_nationkey % 3 = 1 then 'Open Ended Schemes ( Debt Scheme - Liquid Fund )' else 'Close Ended Schemes(Income)' end as header
from {supplier}"""),
    # what stands in the factsheets of each scheme, three of them, in four layouts; see inputs.factsheets
    "factsheet": (("supplier",), """
select concat('scheme-', cast(cast(floor(s_suppkey / 2) as bigint) as string)) as scheme_id, k as doc_no, s_suppkey as n,
       concat('fs-', cast(s_suppkey as string), '-', cast(k as string)) as doc_id,
       case when k = 1 then date '2026-06-30' when k = 2 then date '2026-07-31' else date '2026-08-31' end as doc_date,
       case when s_suppkey % 4 = 0 then 'titled' when s_suppkey % 8 = 2 then 'parenthesis' else 'row' end as layout,
       s_suppkey % 3 as kind, s_suppkey % 28 + 1 as day_no, cast(2000 + s_suppkey % 20 as int) as year_no,
       cast(s_suppkey % 50 + 40 + case when k = 3 and s_suppkey % 10 = 0 then 7 else 0 end as int) as direct_bps,
       s_suppkey % 10 = 4 and k > 1 as leaves, s_suppkey % 10 = 6 and k < 3 as comes
from {supplier} cross join (values (1), (2), (3)) as v(k) where s_suppkey % 2 = 0"""),
    # the schemes of houses of ten, and what stands on their pages of a combined factsheet; the tenth has none. above: a line
    # over the title; own: the lines from the title on
    "combined_scheme": (("supplier",), """
with s as (select cast(floor(s_suppkey / 2) as bigint) as n from {supplier} where s_suppkey % 2 = 0),
w as (select *, n % 10 as i, cast(floor(n / 10) as bigint) as h, case n % 10 when 0 then 'Large Cap' when 1 then 'Mid Cap' when 2 then 'Flexi Cap' when 3 then 'Liquid' when 4 then 'Gilt' when 5 then 'Value' when 6 then 'Focused' when 7 then 'Arbitrage' when 8 then 'Overnight' else 'Balanced Advantage' end as word from s),
p as (select *, concat('cf-', cast(h as string)) as source_doc, concat('cs-', cast(n as string)) as scheme_id, concat('Harbour', cast(h as string), ' ', word, ' Fund') as name,
       case when i < 2 then 2 when i < 4 then i + 1 when i < 6 then 5 when i < 9 then i else null end as page_number,
       case n % 7 when 0 then 'Arun' when 1 then 'Bela' when 2 then 'Chitra' when 3 then 'Dev' when 4 then 'Esha' when 5 then 'Farid' else 'Gita' end as first_one,
       case n % 5 when 0 then 'Hari' when 1 then 'Indu' when 2 then 'Jaya' when 3 then 'Kiran' else 'Lata' end as first_two,
       cast(n % 80 + 31 as int) as direct_bps, case when n % 4 = 0 then '**' when n % 4 = 1 then '2' else '' end as mark from w),
b as (select *, count(*) over (partition by source_doc, page_number) > 1 as shared, concat('0.', cast(direct_bps as string), '%') as direct_text, concat('1.', cast(direct_bps as string), '%') as regular_text from p)
select n, i, source_doc, scheme_id, name, page_number, shared, first_one, first_two, direct_bps, mark,
       case when i % 3 = 0 then concat('Type of Scheme: an equity scheme', chr(10)) else '' end as above,
       concat(case when i % 3 = 0 then upper(replace(name, ' Cap', 'cap')) when i % 3 = 1 then replace(name, ' ', '  ') else concat(name, '.') end, chr(10),
              case when i % 3 = 1 then concat('An open-ended scheme', chr(10)) when i % 3 = 2 then concat('(Erstwhile Harbour Old ', word, ')', chr(10)) else '' end,
              word, ' Fund', chr(10), 'Fund Manager*: Mr. ', first_one, ' Rao & ', chr(10), 'Ms. ', first_two, ' Mehta', chr(10),
              'Date of Allotment: May ', cast(n % 28 + 1 as string), ', 2014', chr(10), 'Expense Ratio', mark, chr(10),
              case when shared then concat('Regular Plan:', chr(10), 'Direct Plan:', chr(10), regular_text, chr(10), direct_text) else concat('Regular Plan: ', regular_text, chr(10), 'Direct Plan: ', direct_text) end, chr(10),
              repeat(concat('A line of holdings', chr(10)), 12), case when mark = '**' then concat('Pages 3 to 9. **This stands for the base', chr(10), 'expense ratio before levies') when mark = '2' then '2Base expense ratio before levies' else 'No notes' end) as own
from b"""),
    # factsheets of six months of each scheme, and the managers that were read in them; some reads are empty, one name is
    # respelled from the fourth month on
    "manager_document": (("supplier",), """
select cast(floor(s_suppkey / 2) as bigint) as n, concat('scheme-', cast(cast(floor(s_suppkey / 2) as bigint) as string)) as scheme_id, k, cast(concat('2026-0', cast(k + 1 as string), '-28') as date) as doc_date
from {supplier} cross join (values (0), (1), (2), (3), (4), (5)) as v(k) where s_suppkey % 2 = 0"""),
    "manager_read": (("manager_document",), """
select scheme_id, doc_date, j as person,
       case j when 0 then 'Arun Rao' when 1 then 'Bela Mehta' when 2 then case when k >= 3 then 'Chithra Naidoo' else 'Chitra Naidoo' end when 3 then 'Dev Sharma' else 'Esha Kulkarni' end as name,
       case when (n + j + k) % 4 = 0 then null when (n + j) % 3 = 0 and k >= 2 then cast('2019-06-01' as date) when j = 4 then cast('2026-03-15' as date) else cast(concat('202', cast(j as string), '-0', cast(n % 9 + 1 as string), '-15') as date) end as managing_since
from {manager_document} cross join (values (0), (1), (2), (3), (4)) as w(j)
where (n + k) % 7 <> 3 and (n * 5 + k * k * 3 + j * 7) % 5 <> 0 and not (j = 1 and k >= n % 6)"""),
    "document_section": (("documents",), """
select source as doc_id, row_number() over (partition by source order by doc_id) as page_number, text from {documents}"""),
    "observed_name": (("events",), """
select distinct concat('scheme-', cast(user_id as string)) as scheme_id, cast(ts as date) as doc_date, event_type as name from {events}"""),
}


#: SQL over price_row by which parsed rows, ids and kinds can be checked; not from any text.
PRICE_TRUTH = """pt as (select *, case when lower(isin1) not in ('', '-', 'n/a', 'na', 'redeemed') then isin1 end isin, case when lower(isin2) not in ('', '-', 'n/a', 'na', 'redeemed') then isin2 end isin_reinvest,
 try_cast(nav_text as double) nav, case when n % 13 <> 0 then make_date(2024, 3, day_no::int) end as date,
 case when header like 'Open%' then 'Open Ended Schemes' else 'Close Ended Schemes' end scheme_type,
 case when header like '%Equity%' then 'Equity Scheme' when header like '%Debt%' then 'Debt Scheme' else 'Income' end category,
 case when header like '%Equity%' then 'Mid Cap Fund' when header like '%Debt%' then 'Liquid Fund' else '' end sub_category,
 case when by_columns then base else replace(base, ' Growth', '') end own_name,
 split_part(plan_text, ' ', 1) plan_type, case when option_text like 'IDCW%' then 'IDCW' else 'Growth' end option_type,
 case when option_text like '%Payout' then 'Payout' when option_text like '%Reinvestment' then 'Reinvest' end idcw_variant,
 'plan-' || code plan_id, trim(regexp_replace(lower(house), '[^a-z0-9]+', '-', 'g'), '-') hs from price_row),
pi as (select *, 'amc-' || hs amc_id, 'scheme-' || substr(sha1(hs || '::' || trim(regexp_replace(lower(own_name), '[^a-z0-9]+', '-', 'g'), '-')), 1, 16) scheme_id from pt where house <> '')"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the directory or a view over its tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    reads, query = VIEWS[name]
    return spark.sql(query, **{r: load(spark, sf_dir, r) for r in reads})


def with_views(*names: str) -> str:
    """The views as a WITH clause for DuckDB."""
    parts = [f"{n} as ({VIEWS[n][1].replace('{', '').replace('}', '')})" for n in names]
    return "with " + ",\n".join(parts)
