"""Ranks and states over the global order of rows, from ranges of rows: no task for all rows, no group in one task.

Rows are dealt into ranges of the order, sorted there and numbered by place; written once, so that what is counted a range
and what is joined to it are the same rows. What a range hands on is one row, so what all of them hand on is as small as
their number, whatever the rows or their groups are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import kept

#: Bits of a row's place within its range, as monotonically_increasing_id has them.
PLACE = 33


def in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` written in ranges of its order, with ``_at``: the range's number above the row's place within it."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return kept(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))


def range_of() -> Column:
    return F.shiftright("_at", PLACE)


def global_rank(df: DataFrame, *order: Column | str, out: str = "rank") -> DataFrame:
    """Adds the 1-based rank in the order. After the ranges are written, nothing is shuffled but a row a range."""
    rows = in_order(df, *order)
    sizes = rows.groupBy(range_of().alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row a range
    place = F.col("_at").bitwiseAND((1 << PLACE) - 1)
    return rows.withColumn("_range", range_of()).join(F.broadcast(before), "_range").withColumn(out, F.col("_before") + place + 1).drop("_at", "_range", "_before")


def last_known(df: DataFrame, value: Column, *order: Column | str, out: str) -> DataFrame:
    """Adds the last value that is not null among all rows up to this one.

    A range starts from the last value of the ranges before it; within a range the window is the range alone.
    """
    rows = in_order(df.withColumn("_value", value), *order).withColumn("_range", range_of())
    ends = rows.groupBy("_range").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_at"))).alias("_end"))
    start = F.last("_end", ignorenulls=True).over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    starts = ends.select("_range", start.alias("_start"))  # a row a range
    within = F.last("_value", ignorenulls=True).over(W.partitionBy("_range").orderBy("_at"))
    return rows.withColumn(out, within).join(F.broadcast(starts), "_range").withColumn(out, F.coalesce(out, "_start")).drop("_at", "_range", "_value", "_start")
