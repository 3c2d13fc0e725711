"""Orders over whole tables: numbers, running sums and last values, without a task that holds all rows.

Rows are dealt into ranges of the order and written, so that the ranges stay as they are; each range
is then worked on by itself, and one row per range carries on what the ranges before it amount to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

RANGE = "__range"
BEFORE = (Window.unboundedPreceding, -1)


def in_ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``__range``: rows of a range stand before all rows of a greater one."""
    return cut(rows.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def summed_before(rows: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` (long) over the rows before; ``order`` must tell rows apart."""
    dealt = in_ranges(rows.withColumn("__v", value.cast("long")), order)
    whole = dealt.groupBy(RANGE).agg(F.sum("__v").alias("__s"))
    shifts = whole.select(RANGE, F.coalesce(F.sum("__s").over(Window.orderBy(RANGE).rowsBetween(*BEFORE)), F.lit(0)).alias("__shift"))  # a row per range
    within = F.coalesce(F.sum("__v").over(Window.partitionBy(RANGE).orderBy(*order).rowsBetween(*BEFORE)), F.lit(0))
    return dealt.withColumn(name, within).join(F.broadcast(shifts), RANGE).withColumn(name, F.col(name) + F.col("__shift")).drop(RANGE, "__v", "__shift")


def numbered(rows: DataFrame, order: list[str], name: str = "i", by: list[str] | None = None) -> DataFrame:
    """``rows`` with ``name``, a number from 0 without gaps in ``order``, in each group of ``by`` for itself.

    Equal rows get their numbers in no certain order.
    """
    by = by or []
    dealt = in_ranges(rows, [*by, *order])
    sizes = dealt.groupBy(RANGE).agg(F.count("*").alias("__s"))
    shifts = sizes.select(RANGE, F.coalesce(F.sum("__s").over(Window.orderBy(RANGE).rowsBetween(*BEFORE)), F.lit(0)).alias("__shift"))  # a row per range
    within = F.row_number().over(Window.partitionBy(RANGE).orderBy(*by, *order)) - 1
    out = dealt.withColumn(name, within).join(F.broadcast(shifts), RANGE).withColumn(name, F.col(name) + F.col("__shift")).drop(RANGE, "__shift")
    if not by:
        return out
    # a group starts behind all rows of the groups before it
    starts = summed_before(rows.groupBy(*by).agg(F.count("*").alias("__n")), by, F.col("__n"), "__start").drop("__n")
    same = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]
    starts = starts.withColumnsRenamed({c: f"__by_{c}" for c in by})
    return out.join(starts, same).withColumn(name, F.col(name) - F.col("__start")).select(*rows.columns, name)


def last_known(rows: DataFrame, order: list[str], value: str, by: list[str]) -> DataFrame:
    """``rows`` with ``value`` taken over, where it is null, from the last row before in its group that has one.

    Rows are dealt into ranges of the first column of ``order``, so one group may span all tasks.
    """
    dealt = in_ranges(rows, order[:1])
    upto = Window.partitionBy(RANGE, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct(*order)
    tops = dealt.groupBy(RANGE, *by).agg(F.max_by(value, F.when(F.col(value).isNotNull(), place)).alias("__top"))
    carried = tops.select(RANGE, *by, F.last("__top", ignorenulls=True).over(Window.partitionBy(*by).orderBy(RANGE).rowsBetween(*BEFORE)).alias("__carried"))  # a row per range and group
    held = dealt.withColumn(value, F.last(value, ignorenulls=True).over(upto))
    carried = carried.withColumnsRenamed({c: f"__by_{c}" for c in (RANGE, *by)})
    held = held.join(carried, [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in (RANGE, *by)])
    return held.withColumn(value, F.coalesce(value, "__carried")).select(*rows.columns)


def in_file_order(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` of files with ``name``, their number from 0 in the order in which they are read."""
    bits = 33  # of the place within a partition
    read = cut(rows.withColumn("__at", F.monotonically_increasing_id()), "in-file-order")
    part = F.shiftright("__at", bits)
    least = read.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    shifts = least.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(*BEFORE)), F.lit(0)).alias("__shift"))  # a row per partition
    placed = read.withColumn("__part", part).join(F.broadcast(shifts), "__part")
    return placed.withColumn(name, F.col("__at").bitwiseAND(F.lit((1 << bits) - 1)) + F.col("__shift")).drop("__at", "__part", "__shift")
