"""Returns, risk, drawdowns and comparisons of price series; nav: plan_id, date, nav."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from navella.functions.series import RISK_FREE, annual_mean, as_of, cagr, downside, nearest_rank, over, volatility

def by_day():
    return Window.partitionBy("plan_id").orderBy("date")



def daily_returns(nav: DataFrame) -> DataFrame:
    """nav with ret, the return since the day before; none where that price isn't above 0."""
    before = F.lag("nav").over(by_day())
    return nav.withColumn("ret", F.when(before > 0, F.col("nav") / before - 1)).filter("ret is not null")


def chosen_plans(plans: DataFrame, plan_type: str = "Direct", option: str = "Growth") -> DataFrame:
    """One plan of each scheme: the wanted type and option, else any of the type, else the first; choice tells which."""
    rank = F.when((F.col("plan_type") == plan_type) & (F.col("option_type") == option), 0).when(F.col("plan_type") == plan_type, 1).otherwise(2)
    best = F.min(F.struct(rank.alias("choice"), "plan_id", "option_type"))
    return plans.groupBy("scheme_id").agg(best.alias("best")).select("scheme_id", "best.plan_id", "best.option_type", "best.choice")


def trailing(nav: DataFrame, horizons: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Growth a year up to each plan's last price, over horizons and since inception. Starts are the last prices on or
    before the anchor less int(h * 365.25) days; they are taken from the whole series."""
    rows = nav.withColumn("anchor", F.max("date").over(Window.partitionBy("plan_id")))  # one shuffle serves both
    starts = [as_of(F.col("date"), F.col("nav"), F.date_sub("anchor", int(h * 365.25))).alias(f"s{h}") for h in horizons]
    found = rows.groupBy("plan_id").agg(F.count("*").alias("n"), F.min(F.struct("date", "nav")).alias("first"), F.max(F.struct("date", "nav")).alias("last"), *starts)
    grown = [cagr(F.col(f"s{h}.date"), F.col(f"s{h}.nav"), F.col("last.date"), F.col("last.nav")).alias(f"cagr_{h}y") for h in horizons]
    return found.select("plan_id", F.col("last.date").alias("anchor"), "n", *grown, cagr(F.col("first.date"), F.col("first.nav"), F.col("last.date"), F.col("last.nav")).alias("cagr_inception"))


def calendar_ladder(nav: DataFrame, horizons: tuple[float, ...] = (1, 3, 5, 7, 10), as_of_day: str | None = None) -> DataFrame:
    """Growth a year of each plan over horizons counted by the calendar: from the last price on or before the same day so many
    years earlier (28 February for the 29th; for a part of a year, int(h * 365.25) days earlier) to the last one on or
    before as_of_day, or the plan's own last day."""
    rows = nav.withColumn("day", F.max("date").over(Window.partitionBy("plan_id"))) if as_of_day is None else nav.withColumn("day", F.lit(as_of_day).cast("date"))
    start = lambda h: F.add_months("day", -12 * int(h)) if h == int(h) else F.date_sub("day", int(h * 365.25))
    named = {f"{h:g}".replace(".", "_"): h for h in horizons}
    ends = [as_of(F.col("date"), F.col("nav"), start(h)).alias(f"s{k}") for k, h in named.items()]
    found = rows.groupBy("plan_id", "day").agg(as_of(F.col("date"), F.col("nav"), F.col("day")).alias("last"), *ends)
    return found.select("plan_id", F.col("day").alias("as_of_day"), *(cagr(F.col(f"s{k}.date"), F.col(f"s{k}.nav"), F.col("last.date"), F.col("last.nav")).alias(f"cagr_{k}y") for k in named))


def scheme_performance(plans: DataFrame, nav: DataFrame) -> DataFrame:
    """Trailing returns of each scheme's chosen plan; distribution plans, schemes without enough prices and schemes without
    prices get a status instead of numbers."""
    found = chosen_plans(plans).join(trailing(nav), "plan_id", "left")
    status = F.when(F.col("option_type") == "IDCW", "idcw_plan_return_analytics_unsupported").when(F.coalesce("n", F.lit(0)) < 2, "insufficient_nav_history").otherwise("ok")
    found = found.withColumn("status", status)
    numbers = [F.when(F.col("status") == "ok", F.col(c)).alias(c) for c in ("cagr_1y", "cagr_3y", "cagr_5y", "cagr_inception")]
    return found.select("scheme_id", "plan_id", "choice", "status", *numbers)


def window_returns(nav: DataFrame, windows: dict[str, tuple[str, str]]) -> DataFrame:
    """Return between the last prices on or before the start and the end of each named window, in one pass."""
    ends = [as_of(F.col("date"), F.col("nav"), F.lit(d).cast("date")).alias(f"{w}_{k}") for w, days in windows.items() for k, d in enumerate(days)]
    found = nav.groupBy("plan_id").agg(*ends)
    return found.select("plan_id", *(F.when(F.col(f"{w}_0.nav") > 0, F.col(f"{w}_1.nav") / F.col(f"{w}_0.nav") - 1).alias(w) for w in windows))


def risk(nav: DataFrame, risk_free: float = RISK_FREE) -> DataFrame:
    """Annualised mean, volatility, Sharpe and Sortino ratios of daily returns."""
    r = F.col("ret")
    found = daily_returns(nav).groupBy("plan_id").agg(F.count("*").alias("n"), annual_mean(r).alias("mean"), volatility(r).alias("volatility"), downside(r).alias("down"))
    gain = F.col("mean") - risk_free
    return found.select("plan_id", "n", "mean", "volatility", over(gain, F.col("volatility")).alias("sharpe"), over(gain, F.col("down")).alias("sortino"))


def rolling_returns(nav: DataFrame, years: int) -> DataFrame:
    """For each day the return since the first price on or after the day w days before and at most 5 days later, not
    annualised; none where that price isn't above 0."""
    w = int(years * 365.25)
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    frame = Window.partitionBy("plan_id").orderBy("day").rangeBetween(-w, min(5 - w, 0))
    start = F.first(F.struct("date", "nav")).over(frame)
    rows = nav.withColumn("day", day).withColumn("start", start)
    grown = F.when(F.col("start.nav") > 0, F.try_divide("nav", "start.nav") - 1)
    return rows.select("plan_id", "date", grown.alias("ret")).filter("ret is not null")


def rolling_distribution(nav: DataFrame, years: int) -> DataFrame:
    """Nearest-rank quantiles of the rolling returns and the share of negative ones."""
    by_value = Window.partitionBy("plan_id").orderBy("ret")
    rows = rolling_returns(nav, years).withColumn("rank", F.row_number().over(by_value)).withColumn("n", F.count("*").over(Window.partitionBy("plan_id")))
    points = {"min": 0.0, "p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "max": 1.0}
    found = [F.max(F.when(F.col("rank") == nearest_rank(p, F.col("n")), F.col("ret"))).alias(k) for k, p in points.items()]
    return rows.groupBy("plan_id").agg(*found, F.avg((F.col("ret") < 0).cast("double")).alias("share_negative"), F.count("*").alias("n"))


def drawdowns(nav: DataFrame, least: float = 0.10) -> DataFrame:
    """Falls of at least that depth: an episode runs from a strict new high to the next; the trough is its earliest lowest
    price; recovery is the date of the next high, null for an open episode."""
    top = F.max("nav").over(by_day().rowsBetween(Window.unboundedPreceding, -1))
    rows = nav.withColumn("high", F.coalesce((F.col("nav") > top).cast("int"), F.lit(1)))
    rows = rows.withColumn("episode", F.sum("high").over(by_day().rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.groupBy("plan_id", "episode").agg(F.min(F.struct("date", "nav")).alias("peak"), F.min(F.struct("nav", "date")).alias("trough"))
    found = found.withColumn("recovery", F.lead("peak.date").over(Window.partitionBy("plan_id").orderBy("episode")))
    depth = F.when(F.col("peak.nav") > 0, F.col("trough.nav") / F.col("peak.nav") - 1)
    found = found.select("plan_id", F.col("peak.date").alias("peak_date"), F.col("trough.date").alias("trough_date"), "recovery", depth.alias("depth"))
    return found.filter(F.col("depth") <= -least).withColumns({"days_down": F.datediff("trough_date", "peak_date"), "days_up": F.datediff("recovery", "trough_date")})


def cost_gap(plans: DataFrame, nav: DataFrame, least_days: int = 30) -> DataFrame:
    """Mean difference of daily log returns of the direct and the regular growth plan, in basis points a year. Returns are
    taken on each series first, then put together by date."""
    wanted = plans.filter("option_type = 'Growth' and plan_type in ('Direct', 'Regular')").groupBy("scheme_id", "plan_type").agg(F.min("plan_id").alias("plan_id"))
    before = F.lag("nav").over(by_day())
    logs = nav.join(wanted, "plan_id").withColumn("log", F.when((before > 0) & (F.col("nav") > 0), F.log(F.col("nav") / F.when(before > 0, before))))
    side = lambda k: F.max(F.when(F.col("plan_type") == k, F.col("log")))
    days = logs.groupBy("scheme_id", "date").agg((side("Direct") - side("Regular")).alias("gap")).filter("gap is not null")
    found = days.groupBy("scheme_id").agg(F.avg("gap").alias("gap"), F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return found.select("scheme_id", F.when(F.col("n") >= least_days, F.round(F.col("gap") * 252 * 10000, 1)).alias("gap_bps"), "n", "first_date", "last_date")


def against_benchmark(nav: DataFrame, benchmark_id: str, risk_free: float = RISK_FREE) -> DataFrame:
    """Beta, alpha, information ratio and capture of each plan against a benchmark series, on returns between common dates. Spark
    sends the benchmark to every executor where its size allows that, and else shuffles."""
    bench = (nav.filter(F.col("plan_id") == benchmark_id).select("date", F.col("nav").alias("b")))
    rows = nav.filter(F.col("plan_id") != benchmark_id).join(bench, "date")
    f0, b0 = F.lag("nav").over(by_day()), F.lag("b").over(by_day())
    rows = rows.withColumns({"f": F.when(f0 > 0, F.col("nav") / f0 - 1), "r": F.when(b0 > 0, F.col("b") / b0 - 1)}).filter("f is not null and r is not null")
    f, r = F.col("f"), F.col("r")
    cond = lambda x, up: F.sum(F.when((r > 0) if up else (r < 0), x))
    found = rows.groupBy("plan_id").agg(
        F.count("*").alias("n"), over(F.covar_samp(f, r), F.var_samp(r)).alias("beta"), annual_mean(f).alias("mf"), annual_mean(r).alias("mr"),
        over(F.avg(f - r) * 252, volatility(f - r)).alias("information_ratio"),
        over(cond(f, True), cond(r, True)).alias("up_capture"), over(cond(f, False), cond(r, False)).alias("down_capture"),
    )
    alpha = F.col("mf") - (risk_free + F.col("beta") * (F.col("mr") - risk_free))
    return found.select("plan_id", "n", "beta", alpha.alias("alpha"), "information_ratio", "up_capture", "down_capture")


def side_pocket(name: Column) -> Column:
    """Whether a name is of a segregated portfolio."""
    return name.rlike(r"(?i)\bseg(regated)?\.?\s*portfolio\b")


def category_ranks(schemes: DataFrame, plans: DataFrame, nav: DataFrame, horizon: int = 3, anchor: str | None = None) -> DataFrame:
    """Rank and percentile of each scheme's plan among active direct growth plans of its category and sub-category, and the
    peers' quartiles, all at one anchor (the newest day of all prices, unless given): growth a year between the last prices
    on or before the anchor and the day int(horizon * 365.25) days before it. Side pockets are no peers."""
    pool = plans.filter("active and plan_type = 'Direct' and option_type = 'Growth'").groupBy("scheme_id").agg(F.min("plan_id").alias("plan_id"))
    pool = pool.join(schemes.filter(~side_pocket(F.col("name"))), "scheme_id")
    at = F.lit(anchor or nav.agg(F.max("date")).first()[0]).cast("date")
    ends = {"s": F.date_sub(at, int(horizon * 365.25)), "e": at}
    grown = nav.groupBy("plan_id").agg(*(as_of(F.col("date"), F.col("nav"), day).alias(k) for k, day in ends.items()))
    grown = grown.select("plan_id", cagr(F.col("s.date"), F.col("s.nav"), F.col("e.date"), F.col("e.nav")).alias("cagr"))
    rows = pool.join(grown, "plan_id").filter("cagr is not null").withColumn("anchor", at)
    group = Window.partitionBy("category", "sub_category")
    rows = rows.withColumns({"n": F.count("*").over(group), "rank": F.rank().over(group.orderBy(F.desc("cagr"))), "up": F.row_number().over(group.orderBy("cagr"))})
    nth = lambda i: F.max(F.when(F.col("up") == i + 1, F.col("cagr"))).over(group)
    n = F.col("n")
    points = {"median": nth(F.floor(n / 2)), "p25": nth(F.floor(n / 4)), "p75": nth(F.least(n - 1, F.floor(3 * n / 4)))}
    percentile = F.round(100 * (1 - (F.col("rank") - 1) / n), 1)
    return rows.withColumns(points).select("scheme_id", "plan_id", "anchor", "category", "sub_category", "cagr", "rank", percentile.alias("percentile"), "n", *points)
