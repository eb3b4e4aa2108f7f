"""Fund houses under the names they have had, and the registration of their schemes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navella.sources.price_files import slug

#: Renames in a row that are followed at most.
RENAMES = 12


def canonical_houses(houses: DataFrame, renames: DataFrame) -> DataFrame:
    """(house, canonical, id, canonical_id) of every name of houses (house) and renames (house, now): the name that a house has
    after all renames, and ids of both. Rows that were loaded under an old name keep its id, so this leads from any id to
    the present one, and by canonical_id back to all of them. A round follows one rename; names that lead in a
    circle, or on for more than RENAMES, are an error. Of several present names of one house the smallest counts."""
    now = renames.filter("house <> now").groupBy("house").agg(F.min("now").alias("now"))
    names = houses.select("house").unionByName(renames.select("house")).unionByName(renames.select(F.col("now").alias("house"))).filter("house is not null").distinct()
    rows = names.join(now, "house", "left").select("house", F.coalesce("now", "house").alias("canonical"))
    further = now.select(F.col("house").alias("canonical"), F.col("now").alias("next"))
    for _ in range(RENAMES):
        if rows.join(further, "canonical", "left_semi").isEmpty():
            break
        rows = rows.join(further, "canonical", "left").select("house", F.coalesce("next", "canonical").alias("canonical"))
    else:
        raise ValueError("renames lead in a circle")
    key = lambda c: F.concat(F.lit("amc-"), slug(F.col(c)))
    return rows.select("house", "canonical", key("house").alias("id"), key("canonical").alias("canonical_id"))


def house_ids(canonical: DataFrame) -> DataFrame:
    """(canonical_id, ids) of canonical_houses: all ids under which a house's rows may be filed, the present one first."""
    own = F.col("id") != F.col("canonical_id")
    ids = F.transform(F.array_sort(F.collect_set(F.struct(own.alias("old"), "id"))), lambda x: x["id"])
    return canonical.groupBy("canonical_id").agg(ids.alias("ids"))


def registered(schemes: DataFrame, hints: DataFrame) -> DataFrame:
    """hints (scheme_id, amc_id, hint) and, for every active scheme (scheme_id, name, amc_id, active) of a house that has none
    for the two, one of its name. Hints that are there are never overwritten."""
    keys = ["scheme_id", "amc_id"]
    asked = schemes.filter("active and amc_id is not null").groupBy(*keys).agg(F.min("name").alias("hint"))
    return hints.select(*keys, "hint").unionByName(asked.join(hints.select(*keys), keys, "left_anti").select(*keys, "hint"))
