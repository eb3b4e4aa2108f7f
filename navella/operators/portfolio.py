"""Holdings: allocation, concentration, changes between disclosures, persistence, overlap and size classes.

holdings: scheme_id, as_of_date, isin (nullable), instrument_name, industry_or_rating, quantity, market_value, pct_nav
(fraction), asset_class.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SNAPSHOT = ["scheme_id", "as_of_date"]
#: Days between disclosures by kind.
CADENCE = {"fortnightly": 15, "monthly": 31, "half_yearly": 182}
SIMILAR_NAMES = 0.82


def asset_class() -> Column:
    return F.coalesce(F.col("asset_class"), F.lit("other"))


def equity_like(holdings: DataFrame) -> DataFrame:
    return holdings.filter(asset_class().isin("equity", "foreign", "reit"))


def display_name(name: Column, asset_class: Column | None = None) -> Column:
    """Cash lines of a repo code with a readable name (of any asset class where it isn't given)."""
    is_cash = F.lit(True) if asset_class is None else asset_class == "cash"
    coded = F.concat(F.lit("TREPS / Reverse Repo ("), F.trim(name), F.lit(")"))
    return F.when(F.coalesce(is_cash, F.lit(False)) & F.trim(name).rlike(r"^TRP_\d{6}$"), coded).otherwise(name)


def allocation(holdings: DataFrame) -> DataFrame:
    """Weight by asset class and by sector (cash is in no sector, names are trimmed, blanks dropped) of every snapshot."""
    weight = F.sum(F.coalesce("pct_nav", F.lit(0.0))).alias("weight")
    sector = F.trim("industry_or_rating")
    classes = holdings.groupBy(*SNAPSHOT, asset_class().alias("name")).agg(weight).withColumn("dimension", F.lit("asset_class"))
    sectors = holdings.filter((asset_class() != "cash") & (sector != "")).groupBy(*SNAPSHOT, sector.alias("name")).agg(weight).withColumn("dimension", F.lit("sector"))
    return classes.unionByName(sectors).select(*SNAPSHOT, "dimension", "name", "weight")


def concentration(holdings: DataFrame) -> DataFrame:
    """Weights of the largest 5, 10 and 20 equity-like holdings, the sum of squares and its reciprocal; holdings without
    weight don't count."""
    rows = equity_like(holdings).filter("pct_nav <> 0")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*SNAPSHOT).orderBy(F.desc("pct_nav"))))
    tops = [F.sum(F.when(F.col("rank") <= n, F.col("pct_nav"))).alias(f"top_{n}") for n in (5, 10, 20)]
    found = rows.groupBy(*SNAPSHOT).agg(*tops, F.sum(F.col("pct_nav") * F.col("pct_nav")).alias("hhi"), F.count("*").alias("n"))
    return found.withColumn("effective_n", F.try_divide(F.lit(1.0), "hhi"))


def top_holdings(holdings: DataFrame, n: int) -> DataFrame:
    """The n largest holdings of every snapshot; no weight counts as 0; ties by name."""
    order = Window.partitionBy(*SNAPSHOT).orderBy(F.desc(F.coalesce("pct_nav", F.lit(0.0))), "instrument_name")
    rows = holdings.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return rows.select(*SNAPSHOT, "rank", display_name(F.col("instrument_name"), F.col("asset_class")).alias("name"), "isin", "pct_nav")


def snapshots(holdings: DataFrame) -> DataFrame:
    """Each snapshot with the one before it."""
    days = holdings.select(*SNAPSHOT).distinct()
    return days.withColumn("previous", F.lag("as_of_date").over(Window.partitionBy("scheme_id").orderBy("as_of_date")))


def gaps(holdings: DataFrame, kind: str = "monthly") -> DataFrame:
    """Snapshots that came later than 1.5 times the cadence after the one before, and the periods between."""
    days, each = F.datediff("as_of_date", "previous"), CADENCE[kind]
    return snapshots(holdings).filter(days > 1.5 * each).select(*SNAPSHOT, "previous", days.alias("days"), F.rint(days / each).cast("long").alias("periods"))


def cadence_gaps(snapshots: DataFrame) -> DataFrame:
    """Of snapshots (scheme_id, as_of_date, cadence) those that can't be compared with the one before as they are: why is
    cadence_changed where the two were disclosed at different intervals, else gap where more than 1.5 intervals lie
    between, with days and periods. A snapshot without a date or of an unknown cadence is passed over."""
    each = F.create_map(*(F.lit(x) for kv in CADENCE.items() for x in kv))
    days = Window.partitionBy("scheme_id").orderBy("as_of_date")
    rows = snapshots.filter(F.col("as_of_date").isNotNull() & each[F.col("cadence")].isNotNull()).select(*SNAPSHOT, "cadence").distinct()
    rows = rows.withColumns({"previous": F.lag("as_of_date").over(days), "cadence_before": F.lag("cadence").over(days)}).filter("previous is not null")
    gap, length = F.datediff("as_of_date", "previous"), each[F.col("cadence")]
    why = F.when(F.col("cadence") != F.col("cadence_before"), "cadence_changed").when(gap > 1.5 * length, "gap")
    return rows.select(*SNAPSHOT, "previous", gap.alias("days"), F.when(why == "gap", F.rint(gap / length).cast("long")).alias("periods"), why.alias("why")).filter("why is not null")


def clean_ratio(old: Column, new: Column) -> Column:
    """Whether new / old is close to n / d with d up to 8, n + d up to 12, and not 1: a split or bonus."""
    r = F.try_divide(new, old)
    off = {d: F.abs(r - F.rint(r * d) / d) for d in range(1, 9)}
    least = F.least(*off.values())
    total = F.coalesce(*(F.when(x == least, F.rint(r * d) + d) for d, x in off.items()))  # of the least d that is as close
    return F.coalesce((r > 0) & (F.abs(r - 1) >= 1e-6) & (least < 0.005) & (total <= 12), F.lit(False))


VALUES = ("instrument_name", "quantity", "pct_nav", "market_value")


def holding_key() -> Column:
    """What a holding is matched by: its isin, else its name."""
    return F.coalesce(F.nullif(F.col("isin"), F.lit("")), F.concat(F.lit("NAME::"), "instrument_name"))


def changes(holdings: DataFrame) -> DataFrame:
    """Every holding of every two snapshots in a row with what became of it, by the snapshot's number within its scheme: a
    holding that the snapshot before lacks is new, one that the next lacks has left by then. Of two with one key the
    one of the smaller weight counts. Changes of what isn't known on both sides are null."""
    days = snapshots(holdings).withColumn("nth", F.row_number().over(Window.partitionBy("scheme_id").orderBy("as_of_date")))
    days = days.withColumn("next_day", F.lead("as_of_date").over(Window.partitionBy("scheme_id").orderBy("as_of_date"))).drop("previous")
    least = F.min(F.struct("pct_nav", "instrument_name", "quantity", "market_value"))
    # one shuffle serves both the rows of a snapshot and the line of a holding; snapshots are few
    rows = holdings.withColumn("key", holding_key()).repartition("scheme_id", "key").groupBy(*SNAPSHOT, "key").agg(least.alias("h")).join(F.broadcast(days), SNAPSHOT)
    line = Window.partitionBy("scheme_id", "key").orderBy("nth")
    known = F.struct("nth", *(F.col(f"h.{c}").alias(c) for c in VALUES))
    rows = rows.withColumns({"known": known, "before": F.lag(known).over(line), "after": F.lead("nth").over(line)})
    none = F.lit(None).cast(rows.schema["known"].dataType)
    here = F.struct(F.col("as_of_date").alias("day"), F.when(F.col("before.nth") == F.col("nth") - 1, F.col("before")).alias("old"), F.col("known").alias("new"))
    gone = F.struct(F.col("next_day").alias("day"), F.col("known").alias("old"), none.alias("new"))
    left = F.col("next_day").isNotNull() & (F.coalesce("after", F.lit(0)) != F.col("nth") + 1)
    both = rows.select("scheme_id", "key", F.explode(F.array(F.when(F.col("nth") > 1, here), F.when(left, gone))).alias("c")).filter("c is not null").select("scheme_id", "key", "c.*")
    old, new = (lambda c: F.col(f"old.{c}")), (lambda c: F.col(f"new.{c}"))
    q, p = new("quantity") - old("quantity"), new("pct_nav") - old("pct_nav")
    flat = F.abs(q) < 1e-6 * F.greatest(F.abs(F.when(old("quantity") != 0, old("quantity")).otherwise(F.lit(1.0))), F.lit(1.0))
    drift = F.coalesce(F.abs(p) > 0.001, F.lit(False))
    action = (
        F.when(F.col("old").isNull(), "NEW").when(F.col("new").isNull(), "EXITED").when(q.isNull(), "UNCHANGED")
        .when(flat & drift, "PRICE_FLOW_DRIFT").when(flat, "UNCHANGED").when(q > 0, "INCREASED").otherwise("REDUCED")
    )
    steady = F.coalesce(F.abs(F.try_divide(p, old("pct_nav"))) < 0.15, F.lit(True))
    split = F.col("action").isin("INCREASED", "REDUCED") & clean_ratio(old("quantity"), new("quantity")) & steady
    kinds = (("name_keyed_no_isin", F.col("key").startswith("NAME::")), ("qty_flat_pct_nav_moved", F.col("action") == "PRICE_FLOW_DRIFT"), ("corporate_action_suspected", split))
    found = both.withColumn("action", action).withColumn("flags", F.array_compact(F.array(*(F.when(x, k) for k, x in kinds))))
    delta = lambda c: F.when(F.col("action") == "NEW", new(c)).when(F.col("action") == "EXITED", -old(c)).otherwise(new(c) - old(c))
    deltas = [delta(c).alias(k) for c, k in (("quantity", "quantity_change"), ("pct_nav", "pct_change"), ("market_value", "value_change"))]
    name = F.coalesce(new("instrument_name"), old("instrument_name"))
    return found.select("scheme_id", F.col("day").alias("as_of_date"), "key", name.alias("name"), "action", *deltas, "flags", F.when(F.size("flags") > 0, "low").otherwise("high").alias("confidence"))


def merged(old: Column, new: Column) -> Column:
    """Whether values are within a fifth of each other; none counts as 0."""
    o, n = F.coalesce(old, F.lit(0.0)), F.coalesce(new, F.lit(0.0))
    return F.coalesce(F.abs(F.try_divide(n, o) - 1) < 0.2, F.lit(False))


def pairs_of_letters(name: Column) -> Column:
    """The runs of two characters of a name, each with its number among equal ones, so that what two names share of them as
    sets they share with repeats."""
    runs = F.transform(F.sequence(F.lit(1), F.length(name) - 1), lambda i: F.substr(name, i, F.lit(2)))
    numbered = F.transform(runs, lambda r, i: F.concat(r, F.size(F.filter(F.slice(runs, 1, i), lambda x: x == r)).cast("string")))
    return F.when(F.length(name) >= 2, numbered).otherwise(F.array().cast("array<string>"))


def least_shared(a: Column, b: Column) -> Column:
    """Runs of two that names of these lengths share at least if their Ratcliff-Obershelp ratio is SIMILAR_NAMES: with m
    matched characters, a + b - 2 m others stand between the matched blocks, so there are at most one more blocks than
    these, and a block of n characters has n - 1 runs."""
    m = F.ceil(F.lit(SIMILAR_NAMES / 2) * (a + b) - F.lit(1e-9))
    return m - (a + b - 2 * m + 1)


def similar_names(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_name, new_name) of the names of two tables (old_name; new_name) that differ and have a Ratcliff-Obershelp ratio of
    SIMILAR_NAMES at least. Names of a and b characters then match in m of them at least, which leaves a + b - 2 m others; of
    one more runs that the old name is cut into, one stands in the new name as it is, at most as far off as characters may
    be lost or added. So names meet by equality of such runs, whatever number of rows has them."""
    a, b = F.col("a"), F.col("b")
    olds = old.filter("old_name <> ''").distinct().withColumn("a", F.length("old_name"))
    news = new.filter("new_name <> ''").distinct().withColumn("b", F.length("new_name"))
    lengths = olds.select("a").distinct().crossJoin(F.broadcast(news.select("b").distinct())).filter(2.0 * F.least(a, b) >= SIMILAR_NAMES * (a + b))
    lengths = F.broadcast(lengths.withColumn("m", F.ceil(F.lit(SIMILAR_NAMES / 2) * (a + b) - F.lit(1e-9)).cast("int")).withColumn("loose", a + b - 2 * F.col("m")))
    begin = lambda i: F.floor(i * a / (F.col("loose") + 1)).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.col("loose")), lambda i: F.struct(i.alias("i"), (begin(i) + 1).alias("at"), (begin(i + 1) - begin(i)).alias("n")))

    def runs_near(r: Column) -> Column:
        places = F.filter(F.transform(F.sequence(F.col("m") - a, b - F.col("m")), lambda k: r["at"] + k), lambda x: (x >= 1) & (x + r["n"] - 1 <= b))
        return F.transform(F.array_distinct(F.transform(places, lambda x: F.substr("new_name", x, r["n"]))), lambda t: F.struct(r["i"].alias("i"), t.alias("run")))

    x = olds.join(lengths, "a").select("old_name", "a", "b", "loose", F.inline(F.transform(runs, lambda r: F.struct(r["i"].alias("i"), F.substr("old_name", r["at"], r["n"]).alias("run")))))
    y = news.join(lengths, "b").select("new_name", "a", "b", F.inline(F.flatten(F.transform(runs, runs_near))))
    close = F.call_function("levenshtein", F.col("old_name"), F.col("new_name"), F.col("loose")) >= 0
    met = x.join(y, ["a", "b", "i", "run"]).filter((F.col("old_name") != F.col("new_name")) & close).select("old_name", "new_name").distinct()
    shared = F.size(F.array_intersect(pairs_of_letters(F.col("old_name")), pairs_of_letters(F.col("new_name"))))
    met = met.filter(shared >= least_shared(F.length("old_name"), F.length("new_name")))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from difflib import SequenceMatcher

        for pdf in batches:
            matchers = (SequenceMatcher(None, x, y) for x, y in zip(pdf["old_name"], pdf["new_name"], strict=True))
            yield pdf[[m.quick_ratio() >= SIMILAR_NAMES and m.ratio() >= SIMILAR_NAMES for m in matchers]]

    return met.mapInPandas(judge, met.schema)


def succession_sides(changed: DataFrame) -> DataFrame:
    """The exited and new holdings with the name and value that they are compared by; not known is like none."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce("name", F.lit(""))), "[^a-z0-9]+", " "))
    return changed.filter(F.col("action").isin("EXITED", "NEW")).select(*SNAPSHOT, "key", "action", plain.alias("name"), F.abs("value_change").alias("value"))


def of_action(sides: DataFrame, action: str, k: str) -> DataFrame:
    return sides.filter(F.col("action") == action).select(*SNAPSHOT, *(F.col(c).alias(f"{k}_{c}") for c in ("key", "name", "value")))


def pairs_by_similar_name(sides: DataFrame) -> DataFrame:
    """Exited and new holdings of one snapshot whose names are similar, not equal."""
    old, new = of_action(sides, "EXITED", "old"), of_action(sides, "NEW", "new")
    links = similar_names(old.select("old_name"), new.select("new_name"))
    return old.join(links, "old_name").join(new, [*SNAPSHOT, "new_name"])


def suspected_successions(changed: DataFrame) -> DataFrame:
    """Exited and new holdings of one snapshot that may be one: by name (an isin change, which wins; Ratcliff-Obershelp ratio of
    SIMILAR_NAMES at least) or by value (a merger). A name or value that isn't known is like none. These are pairs: where
    many values are near each other, they are many; with_successions needs none of them."""
    sides = succession_sides(changed)
    keys = [*SNAPSHOT, "old_key", "new_key"]
    old, new = of_action(sides, "EXITED", "old"), of_action(sides, "NEW", "new")
    same = old.filter("old_name <> ''").join(new.withColumn("old_name", F.col("new_name")), [*SNAPSHOT, "old_name"])
    named = same.select(*keys).unionByName(pairs_by_similar_name(sides).select(*keys))
    step = lambda v: F.floor(F.ln(v) / F.ln(F.lit(1.3)))  # noqa: E731  values near each other are one step apart at most
    around = F.explode(F.sequence(step(F.col("new_value")) - 1, step(F.col("new_value")) + 1)).alias("step")
    valued = old.filter("old_value > 0").withColumn("step", step(F.col("old_value"))).join(new.filter("new_value > 0").select("*", around), [*SNAPSHOT, "step"])
    valued = valued.filter(merged(F.col("old_value"), F.col("new_value"))).select(*keys).join(named, keys, "left_anti")
    return named.withColumn("suspicion", F.lit("isin_change_suspected")).unionByName(valued.withColumn("suspicion", F.lit("possible_corporate_action_merger")))


def near_values(value: Column, is_near) -> tuple[Column, Column]:
    """The least and greatest number that is_near says of; it is one stretch of numbers, whose ends are looked for among the
    numbers next to four guesses."""
    guesses = F.array(value * 0.8, value * 1.2, value / 1.2, value / 0.8)
    beside = lambda g: F.transform(F.sequence(F.lit(-8), F.lit(8)), lambda k: g + k * (g * F.lit(2.0**-53)))
    hits = F.filter(F.flatten(F.transform(guesses, beside)), is_near)
    return F.array_min(hits), F.array_max(hits)


def counted_successions(sides: DataFrame) -> DataFrame:
    """For each side of a snapshot the suspicions (more) that it is in a pair of suspected_successions with, without the pairs:
    partners of near values are counted by running sums in the order of values, at the least and the greatest near value;
    of them those of an equal name, and of a similar one, are no mergers. Only similar names, not equal ones, make pairs."""
    value, exited = F.col("value"), F.col("action") == "EXITED"
    (low_n, high_n), (low_o, high_o) = near_values(value, lambda x: merged(value, x)), near_values(value, lambda x: merged(x, value))
    stops = F.array(*(F.struct(at.alias("at"), F.lit(k).alias("k")) for at, k in ((F.when(exited, low_n).otherwise(low_o), -1), (value, 0), (F.when(exited, high_n).otherwise(high_o), 1))))
    rows = sides.select("*", F.inline(stops)).filter("at is not null or k = 0")
    alike = [*SNAPSHOT, "name"]
    counts = {}
    for c, by in (("near", SNAPSHOT), ("near_alike", alike)):
        line = Window.partitionBy(*by).orderBy("at", "k").rowsBetween(Window.unboundedPreceding, 0)
        partners = F.when(exited, F.sum(((F.col("k") == 0) & ~exited).cast("long")).over(line)).otherwise(F.sum(((F.col("k") == 0) & exited).cast("long")).over(line))
        counts[c] = F.col("k") * partners
    both = F.max(exited).over(Window.partitionBy(*alike)) & F.max(~exited).over(Window.partitionBy(*alike)) & (F.col("name") != "")
    rows = rows.withColumns({**counts, "alike": both})
    rows = rows.groupBy(*SNAPSHOT, "key", "action").agg(F.sum("near").alias("near"), F.sum(F.when(F.col("name") != "", F.col("near_alike")).otherwise(0)).alias("near_alike"), F.max("alike").alias("alike"))
    pairs = pairs_by_similar_name(sides).select(*SNAPSHOT, "old_key", "new_key", merged(F.col("old_value"), F.col("new_value")).cast("long").alias("both_near"))
    ends = F.inline(F.array(*(F.struct(F.col(f"{k}_key").alias("key"), F.lit(a).alias("action")) for k, a in (("old", "EXITED"), ("new", "NEW")))))
    more = pairs.select(*SNAPSHOT, "both_near", ends).groupBy(*SNAPSHOT, "key", "action").agg(F.sum("both_near").alias("near_similar"))
    rows = rows.join(more, [*SNAPSHOT, "key", "action"], "left")
    renamed = F.when(F.col("alike") | F.col("near_similar").isNotNull(), "isin_change_suspected")
    moved = F.when(F.col("near") > F.col("near_alike") + F.coalesce("near_similar", F.lit(0)), "possible_corporate_action_merger")
    return rows.select(*SNAPSHOT, "key", "action", F.array_compact(F.array(renamed, moved)).alias("more"))


def with_successions(changed: DataFrame) -> DataFrame:
    """changes with the flags of suspected successions on both rows of each, whose confidence is then low."""
    found = counted_successions(succession_sides(changed))
    rows = changed.join(found, [*SNAPSHOT, "key", "action"], "left").withColumn("flags", F.concat("flags", F.coalesce("more", F.array().cast("array<string>"))))
    return rows.withColumn("confidence", F.when(F.size("flags") > 0, "low").otherwise("high")).select(*changed.columns)


def persistence(holdings: DataFrame) -> DataFrame:
    """For each holding of a scheme: snapshots held, mean weight, first and last date, and how many snapshots in a row up to
    the newest."""
    back = F.row_number().over(Window.partitionBy("scheme_id").orderBy(F.desc("as_of_date")))
    days = holdings.select(*SNAPSHOT).distinct().withColumn("back", back).withColumnsRenamed({"scheme_id": "of", "as_of_date": "day"})
    rows = holdings.groupBy(*SNAPSHOT, holding_key().alias("key")).agg(F.sum("pct_nav").alias("pct"))
    # snapshots are few, so they are numbered by themselves, not among all holdings of a scheme
    rows = rows.join(F.broadcast(days), F.col("scheme_id").eqNullSafe(F.col("of")) & F.col("as_of_date").eqNullSafe(F.col("day")))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("scheme_id", "key").orderBy("back")))
    streak = F.sum((F.col("back") == F.col("n")).cast("long"))
    return rows.groupBy("scheme_id", "key").agg(F.count("*").alias("held"), F.avg("pct").alias("mean_pct"), F.min("as_of_date").alias("first_seen"), F.max("as_of_date").alias("last_seen"), streak.alias("streak"))


def recent_persistence(holdings: DataFrame, months: int) -> DataFrame:
    """persistence over the snapshots of the last so many months of 31 days before each scheme's newest one, with the
    holding's newest name and its place by streak, snapshots held and key."""
    newest = holdings.groupBy(F.col("scheme_id").alias("of")).agg(F.max("as_of_date").alias("newest"))
    rows = holdings.join(newest, F.col("scheme_id").eqNullSafe(F.col("of"))).filter(F.col("as_of_date") >= F.date_sub("newest", months * 31)).drop("of", "newest")
    names = rows.groupBy("scheme_id", holding_key().alias("key")).agg(F.max_by("instrument_name", F.struct("as_of_date", "instrument_name")).alias("name"))
    order = Window.partitionBy("scheme_id").orderBy(F.desc("streak"), F.desc("held"), "key")
    return persistence(rows).join(names, ["scheme_id", "key"]).withColumn("place", F.row_number().over(order))


def latest(holdings: DataFrame, as_of: str | None = None) -> DataFrame:
    """The newest snapshot of each scheme, on or before as_of."""
    rows = holdings if as_of is None else holdings.filter(F.col("as_of_date") <= F.lit(as_of).cast("date"))
    last = rows.groupBy("scheme_id").agg(F.max("as_of_date").alias("as_of_date"))
    return rows.join(last, SNAPSHOT, "left_semi")


def overlap(holdings: DataFrame) -> DataFrame:
    """Common equity-like weight of every two schemes that share an isin. holdings: one snapshot a scheme."""
    maps = equity_like(holdings).filter("isin is not null").groupBy("scheme_id", "isin").agg(F.sum(F.coalesce("pct_nav", F.lit(0.0))).alias("pct"))
    sizes = maps.groupBy("scheme_id").agg(F.count("*").alias("total"))
    a, b = (maps.select(*(F.col(c).alias(f"{c}_{k}") for c in maps.columns)) for k in "ab")
    both = a.join(b, (F.col("isin_a") == F.col("isin_b")) & (F.col("scheme_id_a") < F.col("scheme_id_b")))
    found = both.groupBy("scheme_id_a", "scheme_id_b").agg(F.sum("pct_a").alias("overlap_a"), F.sum("pct_b").alias("overlap_b"), F.count("*").alias("common"))
    for k in "ab":
        found = found.join(sizes.select(F.col("scheme_id").alias(f"scheme_id_{k}"), F.col("total").alias(f"total_{k}")), f"scheme_id_{k}")
    return found.withColumn("overlap", (F.col("overlap_a") + F.col("overlap_b")) / 2)


def overlap_within(holdings: DataFrame, asked: DataFrame) -> DataFrame:
    """The overlap of every two schemes of each requested set (asked: set_id, scheme_id), also of those that share nothing:
    set_id, scheme_id_a, scheme_id_b, overlap_a, overlap_b, overlap, common, total_a, total_b, and holdings, those in common
    (isin, name, pct_a, pct_b, mean) by mean weight. holdings: one snapshot a scheme. Pairs are of one set each, which
    somebody has listed, and meet the holdings by equality."""
    wanted = asked.select("set_id", "scheme_id").distinct()
    pairs = wanted.withColumnRenamed("scheme_id", "scheme_id_a").join(wanted.withColumnRenamed("scheme_id", "scheme_id_b"), "set_id").filter("scheme_id_a < scheme_id_b")
    held = equity_like(holdings).filter("isin is not null").join(wanted.select("scheme_id").distinct(), "scheme_id", "left_semi")
    maps = held.groupBy("scheme_id", "isin").agg(F.sum(F.coalesce("pct_nav", F.lit(0.0))).alias("pct"), F.min("instrument_name").alias("name"))
    sizes = maps.groupBy("scheme_id").agg(F.count("*").alias("total"))
    a, b = (maps.select(*(F.col(c).alias(f"{c}_{k}") for c in ("scheme_id", "pct", "name")), "isin") for k in "ab")
    mean = (F.col("pct_a") + F.col("pct_b")) / 2
    each = F.struct((-mean).alias("minus"), "isin", F.coalesce("name_a", "name_b").alias("name"), "pct_a", "pct_b", mean.alias("mean"))
    both = pairs.join(a, "scheme_id_a").join(b, ["scheme_id_b", "isin"]).groupBy("set_id", "scheme_id_a", "scheme_id_b")
    found = both.agg(F.sum("pct_a").alias("overlap_a"), F.sum("pct_b").alias("overlap_b"), F.count("*").alias("common"), F.array_sort(F.collect_list(each)).alias("holdings"))
    rows = pairs.join(found, ["set_id", "scheme_id_a", "scheme_id_b"], "left")
    for k in "ab":
        rows = rows.join(sizes.select(F.col("scheme_id").alias(f"scheme_id_{k}"), F.col("total").alias(f"total_{k}")), f"scheme_id_{k}", "left")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("overlap_a", "overlap_b")} | {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("common", "total_a", "total_b")}
    rows = rows.withColumns(zero).withColumn("overlap", (F.col("overlap_a") + F.col("overlap_b")) / 2)
    none = F.array().cast("array<struct<isin:string,name:string,pct_a:double,pct_b:double,mean:double>>")
    return rows.withColumn("holdings", F.coalesce(F.transform("holdings", lambda h: h.dropFields("minus")), none))


def cap_allocation(holdings: DataFrame, caps: DataFrame) -> DataFrame:
    """Equity-like weight by size class at each snapshot, by the list in force then (never a later one): lists become
    intervals, so it is one equi-join with a range condition. Null where no list was in force."""
    spans = caps.withColumn("until", F.lead("effective_date").over(Window.partitionBy("isin").orderBy("effective_date")))
    lists = caps.select("effective_date").distinct()
    rows = equity_like(holdings).select(*SNAPSHOT, "isin", F.coalesce("pct_nav", F.lit(0.0)).alias("pct"))
    c = spans.select(F.col("isin").alias("c_isin"), "effective_date", "until", "market_cap")
    on = (rows["isin"] == c["c_isin"]) & (c["effective_date"] <= rows["as_of_date"]) & (c["until"].isNull() | (rows["as_of_date"] < c["until"]))
    named = rows.join(c, on, "left")
    sums = [F.sum(F.when(F.col("market_cap") == k, F.col("pct")).otherwise(0.0)).alias(k) for k in ("large", "mid", "small")]
    found = named.groupBy(*SNAPSHOT).agg(*sums, F.sum(F.when(F.col("market_cap").isNull(), F.col("pct")).otherwise(0.0)).alias("unclassified"), F.count("market_cap").alias("n_classified"), F.max("effective_date").alias("list_date"))
    first = lists.agg(F.min("effective_date").alias("first_list"))
    found = found.crossJoin(F.broadcast(first))  # one row
    none = F.col("first_list").isNull() | (F.col("as_of_date") < F.col("first_list"))
    return found.select(*SNAPSHOT, *(F.when(~none, F.col(c)).alias(c) for c in ("large", "mid", "small", "unclassified", "n_classified", "list_date")))
