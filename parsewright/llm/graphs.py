"""Joins that stand hot keys, and connected components, without any unbounded group in a task or on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A key is hot if it holds more than one in so many rows; so there are at most so many hot keys.
HOT_SHARE = 1000
LEAST_HOT = 200
LANES = 1021


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str, values: list[str], total: int) -> DataFrame:
    """Left join of ``rows`` to ``table``, which has each key once and, in ``count``, the rows that have it.

    Keys with more than total / HOT_SHARE rows are at most HOT_SHARE many; they are broadcast, and their rows are spread
    over lanes of the shuffled join, in which they look for nothing. ``rows`` is read once.
    """
    bound = max(LEAST_HOT, total // HOT_SHARE)
    hot = table.filter(F.col(count) > bound).select(*[F.col(k).alias(f"_h_{k}") for k in keys], *[F.col(v).alias(f"_hv_{v}") for v in values], F.lit(True).alias("_hot"))
    same = [F.col(k) == F.col(f"_h_{k}") for k in keys]  # a null key meets nothing
    on = same[0]
    for s in same[1:]:
        on = on & s
    left = rows.join(F.broadcast(hot), on, "left")
    lane = F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(LANES)) + 1).otherwise(F.lit(0)).cast("int")
    cold = table.filter(F.col(count) <= bound).select(*keys, *[F.col(v).alias(f"_cv_{v}") for v in values], F.lit(0).alias("_lane"))
    out = left.withColumn("_lane", lane).join(cold, [*keys, "_lane"], "left")
    return out.select(*rows.columns, *[F.coalesce(f"_hv_{v}", f"_cv_{v}").alias(v) for v in values])


def salted_join(rows: DataFrame, table: DataFrame, key: str, count: str, values: list[str], total: int) -> DataFrame:
    """Inner join of ``rows`` to ``table``, which has each key once, wide ``values`` and, in ``count``, the rows that have it.

    As in ``spread_join`` there are at most HOT_SHARE hot keys. Only they and their numbers of lanes are broadcast: a hot
    key's row of ``table`` is repeated once a lane, and the rows that look for it are dealt over its lanes.
    """
    bound = max(LEAST_HOT, total // HOT_SHARE)
    lanes = F.least(F.ceil(F.col(count) / bound), F.lit(HOT_SHARE)).cast("int")
    hot = table.filter(F.col(count) > bound).select(F.col(key).alias("_h"), lanes.alias("_lanes"))
    left = rows.join(F.broadcast(hot), F.col(key) == F.col("_h"), "left")
    left = left.select(*rows.columns, F.coalesce(F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.col("_lanes")), F.lit(0)).cast("int").alias("_lane"))
    right = table.select(key, *values, F.explode(F.sequence(F.lit(0), F.when(F.col(count) > bound, lanes).otherwise(1) - 1)).alias("_lane"))
    return left.join(right, [key, "_lane"]).select(*rows.columns, *values)


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node that has an edge to another: label is the least node that it reaches.

    Alternates the large-star and the small-star step until nothing changes, which the method reaches from any edges.
    Every step is written to the shared folder; what it was made from is removed then.
    """
    spark = edges.sparkSession
    shared = common.Shared(spark)
    cur = shared.keep(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).distinct(), "edges0")
    seen, k = None, 0
    while True:
        total, sign = cur.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y"))).first()
        if (total, sign) == seen or not total:
            return cur.select(F.col("x").alias("node"), F.col("y").alias("label"))
        seen = (total, sign)
        both = cur.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(cur.select(F.col("y").alias("u"), F.col("x").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = shared.keep(spread_join(both.filter("v > u"), least, ["u"], "n", ["m"], 2 * total).select(F.col("v").alias("x"), F.col("m").alias("y")).distinct(), f"large{k}")
        least = large.groupBy("x").agg(F.min("y").alias("m"), F.count(F.lit(1)).alias("n"))
        small = spread_join(large, least, ["x"], "n", ["m"], total).filter("y != m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        cur = shared.keep(small.unionByName(least.select("x", F.col("m").alias("y"))).distinct(), f"edges{k + 1}")
        shared.drop(f"edges{k}")
        shared.drop(f"large{k}")
        k += 1
