"""Running totals that do not gather a group in one task."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heirline.plans.scratch import Scratch


def running_total(
    scratch: Scratch,
    df: DataFrame,
    order: list[str],
    value: Column,
    name: str,
    group: list[str] | None = None,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all earlier rows of the row's group.

    Rows are range-partitioned by group and order, so a large group covers several
    ranges. The sum per (group, range) gives each range its start, and only the rows
    of one range are ordered within one task.
    """
    group = group or []
    ranged = df.withColumn("_value", value).repartitionByRange(*group, *order)
    ranged = ranged.withColumn("_range", F.spark_partition_id())
    rows = scratch.save(ranged, scratch.place(name)).df

    chunk = [*group, "_range"]
    sums = rows.groupBy(*chunk).agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start")
    starts = sums.select(*[F.col(c).alias(f"_{c}") for c in chunk], start)

    before = Window.partitionBy(*chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum("_value").over(before), F.lit(0)))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in chunk])
    return (
        local.join(starts, same)
        .withColumn(name, (F.col("_start") + F.col("_local")).cast("long"))
        .select(*df.columns, name)
    )
