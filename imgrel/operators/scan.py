"""Running values over ordered rows in two levels, so that no key has to fit one task.

Rows are cut into ranges of (key, order) of about equal size, so a hot key
spreads over many of them.  Every range has running values of its own and one
summary for each key in it; the summaries, a few for each range, are scanned in
order, and what they carry is added to the rows of the later ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.storage import written

PART = "part_"


def ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """``df`` with ``part_``: the number of its range of ``(keys, order)``.  Rows equal in all of these share a range.

    It is written once, since Spark draws the bounds of the ranges from a sample.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(parts, *keys, *order).withColumn(PART, F.spark_partition_id()))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the earlier rows of the same keys, 0 for the first.

    ``order`` has to tell all rows of a key apart.  Nulls in ``value`` count as 0.
    """
    cut = ranges(df, keys, order, parts)
    before = lambda *columns: Window.partitionBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(before(PART, *keys).orderBy(*order)), F.lit(0))
    sums = cut.groupBy(PART, *keys).agg(F.sum(value).alias("sum_"))
    carried = F.coalesce(F.sum("sum_").over(before(*keys).orderBy(PART)), F.lit(0)).alias("carried_")
    carry = sums.select(PART, *keys, carried)
    return _joined(cut.withColumn("own_", own), carry, keys).withColumn(name, F.col("own_") + F.col("carried_")).drop("own_", "carried_", PART)


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """``df`` with ``name``: the last ``value`` that is not null, of this row or an earlier one of the same keys; else null."""
    cut = ranges(df, keys, order, parts)
    inside = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    lasts = cut.where(F.col(value).isNotNull()).groupBy(PART, *keys).agg(F.max_by(value, F.struct(*order)).alias("last_"))
    every = cut.select(PART, *keys).distinct()
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    known = _joined(every, lasts, keys)
    carry = known.select(PART, *keys, F.last("last_", ignorenulls=True).over(earlier).alias("carried_"))
    own = F.last(value, ignorenulls=True).over(inside)
    return _joined(cut.withColumn("own_", own), carry, keys).withColumn(name, F.coalesce("own_", "carried_")).drop("own_", "carried_", PART)


def _joined(rows: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the facts of their range and keys; null keys meet each other."""
    named = facts.withColumnsRenamed({c: f"{c}__" for c in (PART, *keys)})
    same = F.lit(True)
    for c in (PART, *keys):
        same = same & F.col(c).eqNullSafe(F.col(f"{c}__"))
    return rows.join(named, same, "left").drop(*(f"{c}__" for c in (PART, *keys)))
