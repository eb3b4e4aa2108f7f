"""How facts are known: an envelope on rows, and what becomes of it where rows are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How facts are known, the surest first.
KINDS = ("official", "calculated", "observed", "approximation", "inferred")
COLUMN = "provenance"


def envelope(kind: str, method: str, params: dict[str, object] | None = None, sources: tuple[str, ...] = (), caveat: Column | None = None) -> Column:
    """The envelope of rows that a method with parameters makes from sources. Raises if kind is none of KINDS or there is no
    method, so nothing goes out without either."""
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {KINDS}")
    if not method:
        raise ValueError("a method is wanted")
    given = sorted((params or {}).items())
    made = F.create_map(*(F.lit(str(x)) for kv in given for x in kv)) if given else F.create_map().cast("map<string,string>")
    names = F.array(*map(F.lit, sorted(set(sources)))) if sources else F.array().cast("array<string>")
    note = F.lit(None).cast("string") if caveat is None else caveat
    return F.struct(F.lit(kind).alias("kind"), F.lit(method).alias("method"), made.alias("params"), names.alias("source_id"), note.alias("caveat"))


def with_provenance(rows: DataFrame, kind: str, method: str, params: dict[str, object] | None = None, sources: tuple[str, ...] = (), caveat: Column | None = None) -> DataFrame:
    """rows with an envelope; rows that have one keep what it tells, as the sources of the new one."""
    made = envelope(kind, method, params, sources, caveat)
    if COLUMN not in rows.columns:
        return rows.withColumn(COLUMN, made)
    return rows.withColumn(COLUMN, carried(made, F.col(COLUMN)))


def kind_rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def carried(own: Column, *others: Column) -> Column:
    """The envelope of rows made out of others: its own method and parameters, the least sure of all their kinds, and all
    their sources and caveats. An input without an envelope (null) adds nothing."""
    kind, sources, notes = own["kind"], own["source_id"], F.array(own["caveat"])
    for other in others:
        kind = F.when(other.isNotNull() & (kind_rank(other["kind"]) > kind_rank(kind)), other["kind"]).otherwise(kind)
        sources = F.array_union(sources, F.coalesce(other["source_id"], F.array().cast("array<string>")))
        notes = F.array_append(notes, other["caveat"])
    note = F.nullif(F.array_join(F.array_distinct(F.array_compact(notes)), "; "), F.lit(""))
    return F.struct(kind.alias("kind"), own["method"].alias("method"), own["params"].alias("params"), F.array_sort(sources).alias("source_id"), note.alias("caveat"))


def joined(a: DataFrame, b: DataFrame, on: list[str], how: str, method: str, params: dict[str, object] | None = None) -> DataFrame:
    """a joined with b, both with envelopes, into rows with one."""
    left, right = a.withColumnRenamed(COLUMN, "_left"), b.withColumnRenamed(COLUMN, "_right")
    rows = left.join(right, on, how)
    own = envelope("official", method, params)
    return rows.withColumn(COLUMN, carried(own, F.col("_left"), F.col("_right"))).drop("_left", "_right")
