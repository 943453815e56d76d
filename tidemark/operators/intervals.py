"""Validity intervals [valid_from, valid_to): closing, looking up at a time, joining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def close_intervals(rows: DataFrame, keys: list[str], at: str, tiebreak: list[str]) -> DataFrame:
    """``rows`` with ``valid_to``: the time of the next row of the same keys, NULL for the last."""
    order = Window.partitionBy(*keys).orderBy(at, *tiebreak)
    return rows.withColumn("valid_to", F.lead(at).over(order))


def not_empty() -> Column:
    """Intervals of some length; two rows at one instant leave only the later one."""
    return F.col("valid_to").isNull() | (F.col("valid_from") != F.col("valid_to"))


def valid_at(when: Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    return (F.col(start) <= when) & (F.col(end).isNull() | (F.col(end) > when))


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, how: str = "left") -> DataFrame:
    """Each row of ``left`` with the version in ``right`` that is valid at ``left[at]``; with ``how`` "left" also rows
    that have none.

    A sweep: rows and versions of a key are put in one order of time, and each row takes the last version that began
    by then, if that hasn't ended. So the work is linear in both, whatever the number of versions of a key, and the
    shuffle by key is the only one. Versions of a key must not overlap. A NULL time has no version; NULL keys match
    nothing; further columns of ``right`` may not have names of ``left``'s.
    """
    more = [c for c in right.columns if c not in keys]
    version = F.struct(*[F.col(f"`{c}`") for c in more])
    kinds = dict(right.select(version.alias("v")).dtypes)["v"]
    name = lambda c: f"_l_{c}"
    rows = left.select(*[F.col(f"`{c}`").alias(name(c)) for c in left.columns], *[F.col(k).alias(f"_k_{k}") for k in keys], F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(kinds).alias("_version"))
    starts = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("valid_from").alias("_at"), F.lit(0).alias("_kind"), version.alias("_version"))
    for k in keys:
        starts = starts.where(F.col(f"_k_{k}").isNotNull())
    order = Window.partitionBy(*[f"_k_{k}" for k in keys]).orderBy(F.asc_nulls_first("_at"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = starts.where("_at is not null").unionByName(rows, allowMissingColumns=True).withColumn("_met", F.last("_version", ignorenulls=True).over(order)).where("_kind = 1")
    held = F.col("_met.valid_to").isNull() | (F.col("_met.valid_to") > F.col("_at"))
    swept = swept.withColumn("_met", F.when(F.col("_at").isNotNull() & held, F.col("_met")))
    if how == "inner":
        swept = swept.where("_met is not null")
    return swept.select(*[F.col(f"`{name(c)}`").alias(c) for c in left.columns], *[F.col("_met").getField(c).alias(c) for c in more])
