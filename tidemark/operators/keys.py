"""Key constraints: declared with the tables, as nothing enforces them, and checked by queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Entity


@dataclass(frozen=True)
class ForeignKey:
    """``column`` holds values of ``other_column`` of the table of ``entity``."""

    column: str
    entity: str
    other_column: str = "id"


def foreign_keys(entity: Entity) -> list[ForeignKey]:
    """Those that the entity's keys declare."""
    return [ForeignKey(k.output, k.foreign_key_table, k.foreign_key_name or "id") for k in entity.keys if k.foreign_key_table]


def orphans(rows: DataFrame, key: ForeignKey, other: DataFrame) -> DataFrame:
    """``column_name, value, rows``: values of a foreign key that the table it names lacks. NULLs refer to nothing.

    Values are counted first, so that what is compared is distinct on both sides and a popular value is one row: the
    anti-join is as large as the keys, not as the rows.
    """
    column = F.col(f"`{key.column}`").cast("string")
    values = rows.where(column.isNotNull()).groupBy(column.alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    known = other.select(F.col(f"`{key.other_column}`").cast("string").alias("value")).where("value is not null").distinct()
    return values.join(known, "value", "left_anti").select(F.lit(key.column).alias("column_name"), "value", "rows")


def broken_primary_key(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Values of a primary key that several rows have, or of which a part is NULL."""
    counts = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))
    part = F.lit(False)
    for c in columns:
        part = part | F.col(c).isNull()
    return counts.where((F.col("rows") > 1) | part)
