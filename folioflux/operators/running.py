"""Running counts and sums over groups of any size, without one task per group.

A window over a book would put a book with a third of all rows into one task. Here rows are dealt by range over (group, order) and
written with the number of their range, each range is summed by itself, and the few totals of the ranges give each its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflux.operators.kept import keep

#: Rows of one group that one window task handles, about.
RANGE_ROWS = 200_000
#: Starts of ranges are broadcast up to so many, counted; more are joined by a shuffle, in which no range is larger than another.
MAX_BROADCAST_ROWS = 200_000


def running_totals(df: DataFrame, group: list[str], order: list[str], values: dict[str, Column], *, include_self: bool = False, range_rows: int = RANGE_ROWS, most: int | None = None) -> DataFrame:
    """Adds for each name the sum of its value over the group's rows before this one in `order` (or up to it).

    Order columns must be unique in a group. Nulls in values count as 0. Small inputs are summed by one window per group. `most`: a
    bound on the rows, where one is known: df needn't be counted if that is small.
    """
    span = (Window.unboundedPreceding, 0 if include_self else -1)
    own = [f"__v{i}" for i in range(len(values))]
    valued = df.withColumns({v: F.coalesce(value, F.lit(0)).cast("long") for v, value in zip(own, values.values(), strict=True)})
    total = lambda v, window: F.coalesce(F.sum(v).over(window.orderBy(*order).rowsBetween(*span)), F.lit(0)).cast("long")
    rows = most if most is not None and most <= range_rows else df.count()
    if rows <= range_rows:
        return valued.withColumns({name: total(v, Window.partitionBy(*group)) for name, v in zip(values, own, strict=True)}).drop(*own)
    ranged = keep(valued.repartitionByRange(-(-rows // range_rows), *group, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*group, "__range").agg(*[F.sum(v).alias(f"{v}s") for v in own])
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = keep(sums.select(*group, "__range", *[F.coalesce(F.sum(f"{v}s").over(before), F.lit(0)).alias(f"{v}s") for v in own]), "starts")
    joined = ranged.join(F.broadcast(starts) if starts.count() <= MAX_BROADCAST_ROWS else starts, [*group, "__range"])
    within = Window.partitionBy(*group, "__range")
    return joined.withColumns({name: (F.col(f"{v}s") + total(v, within)).cast("long") for name, v in zip(values, own, strict=True)}).select(*df.columns, *values)


def running_total(df: DataFrame, group: list[str], order: list[str], value: Column, name: str, *, include_self: bool = False, range_rows: int = RANGE_ROWS, most: int | None = None) -> DataFrame:
    """Adds one running sum."""
    return running_totals(df, group, order, {name: value}, include_self=include_self, range_rows=range_rows, most=most)


def keep_large(df: DataFrame, name: str, most: int) -> DataFrame:
    """Kept where running sums will count and range it; with few rows (`most`) they won't, and it stays part of one plan."""
    return df if most <= RANGE_ROWS else keep(df, name)


def row_index(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the number of the group's rows before this one."""
    return running_total(df, group, order, F.lit(1), name)
