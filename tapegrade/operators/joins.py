"""Joins that Spark has no operator for, as rewrites of equi joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, low: int, high: int, how: str = "inner", residual: Column | None = None) -> DataFrame:
    """Rows with equal ``keys`` and ``right_at - left_at`` in [low, high], both integers.

    Time is cut into buckets as wide as the band; a right row is put into the buckets that its band can touch, two or
    three, so the join is an equi join on (keys, bucket) with a residual, and a hot key is spread over its buckets. A
    left row has one bucket, which is what semi, anti and outer joins need. Columns of the right side must not
    clash with the left's, apart from ``keys``.
    """
    width = max(1, high - low)
    probes = left.withColumn("_bucket", F.floor(F.col(left_at) / width))
    first, last = F.floor((F.col(right_at) - high) / width), F.floor((F.col(right_at) - low) / width)
    found = right.withColumn("_bucket", F.explode(F.sequence(first, last)))
    near = (F.col(right_at) - F.col(left_at)).between(low, high)
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, "_bucket"]]
    both = on[0]
    for c in on[1:]:
        both &= c
    both &= near if residual is None else near & residual
    joined = probes.alias("l").join(found.alias("r"), both, how)
    out = [F.col(f"l.{c}") for c in left.columns]
    if how not in ("left_semi", "left_anti"):
        out += [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return joined.select(*out)


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """For each left row the ``values`` of the last right row with equal ``keys`` and ``at`` not later; null if none.

    Both sides go through one shuffle by key: they are stacked, right rows first on ties, and the last values
    are carried forward.
    """
    carried = F.struct(*values)
    kind = right.select(carried.alias("v")).schema["v"].dataType
    stacked = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(kind)).unionByName(right.select(*keys, at, F.lit(0).alias("_side"), carried.alias("_v")), allowMissingColumns=True)
    w = W.partitionBy(*keys).orderBy(F.col(at), F.col("_side")).rowsBetween(W.unboundedPreceding, 0)
    filled = stacked.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).filter("_side = 1")
    return filled.select(*left.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def islands(df: DataFrame, keys: list[str], order: str, step: int = 1) -> DataFrame:
    """Runs of consecutive ``order`` values: keys, first, last, length."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumn("_island", F.col(order) - step * F.row_number().over(w)).groupBy(*keys, "_island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("_island")
