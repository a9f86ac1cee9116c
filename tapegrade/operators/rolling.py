"""Summaries of every rolling period of a series in linear work, also of measures that no window function has.

The worst fall inside a period cannot be slid: a value that leaves may have been its peak. But stretches of a series merge: with the highest and
lowest level and the worst fall of two neighbouring stretches, those of both together are known. Time is cut into blocks as long as the
period, so a period is a tail of one block and a head of the next. Heads and tails of all rows are running summaries within blocks,
which are plain windows (tails run backwards: a frame that ends with the block would be read anew for each row), and each period is one merge.
Sums are merged likewise, a tail's and a head's: as differences of sums over the whole record they would lose digits that higher moments need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rolling_periods(df: DataFrame, keys: list[str], at: str, days: int, growth: Column, sums: dict[str, Column]) -> DataFrame:
    """For each row, of the ``days`` up to and including its ``at`` (an integer, unique within the keys):

    ``fall``, the worst fall of the running sum of ``growth`` from a level before it in the period, the level that the period starts from included;
    ``growth``, its sum; each of ``sums``, summed; ``rows``; and ``whole``, whether the period lies within the key's record. Rows come with their keys and ``at``.
    """
    by = W.partitionBy(*keys).orderBy(at)
    rows = df.select(*keys, at, growth.alias("_g"), *[c.alias(name) for name, c in sums.items()])
    up = by.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_level", F.sum("_g").over(up)).withColumn("_block", F.floor(F.col(at) / days)).withColumn("_k", F.row_number().over(by)).withColumn("_first", F.min(at).over(up))
    rows = rows.withColumn("_before", F.col("_level") - F.col("_g"))
    block = W.partitionBy(*keys, "_block").orderBy(at)
    head, tail = block.rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*keys, "_block").orderBy(F.desc(at)).rowsBetween(W.unboundedPreceding, 0)
    added = {"growth": "_g"} | {name: name for name in sums}
    rows = rows.withColumns({f"_{part}_{name}": F.sum(c).over(w) for part, w in (("head_sum", head), ("tail_sum", tail)) for name, c in added.items()} | {
        "_head_low": F.min("_level").over(head), "_head_gap": F.max("_level").over(head) - F.col("_level"), "_head_from": F.first("_before").over(head),
        "_tail_high": F.greatest("_before", F.max("_level").over(tail)), "_tail_low": F.min("_level").over(tail),
    })
    rows = rows.withColumn("_head_fall", F.max("_head_gap").over(head)).withColumn("_tail_fall", F.greatest(F.max(F.col("_level") - F.col("_tail_low")).over(tail), F.col("_before") - F.col("_tail_low")))
    start = F.struct("_block", "_k", "_tail_high", "_tail_fall", *[F.col(f"_tail_sum_{name}").alias(name) for name in added])
    rows = rows.withColumn("_s", F.first(start).over(by.rangeBetween(-(days - 1), 0)))
    # a period that begins with the block's first row is a head alone
    alone = F.greatest(F.col("_head_fall"), F.col("_head_from") - F.col("_head_low"))
    merged = F.greatest(F.col("_s._tail_fall"), F.col("_head_fall"), F.col("_s._tail_high") - F.col("_head_low"))
    fall = F.when(F.col("_s._block") == F.col("_block"), alone).otherwise(merged)
    total = lambda name: F.when(F.col("_s._block") == F.col("_block"), F.col(f"_head_sum_{name}")).otherwise(F.col(f"_s.{name}") + F.col(f"_head_sum_{name}"))
    return rows.select(
        *keys, at, F.greatest(fall, F.lit(0.0)).alias("fall"), *[total(name).alias(name) for name in added],
        (F.col("_k") - F.col("_s._k") + 1).alias("rows"), (F.col(at) - days + 1 >= F.col("_first")).alias("whole"),
    )


def rolling_top(df: DataFrame, keys: list[str], at: str, days: int, value: str, k: int) -> DataFrame:
    """For each (keys, at): ``total`` and ``top``, the sum and the sum of the ``k`` largest positive values of the ``days`` up to it.

    A day keeps its ``k`` largest values, so a period looks at ``k * days`` of them at most, however many rows a day has.
    """
    one = W.partitionBy(*keys, at).orderBy(F.desc(value))
    days_ = df.select(*keys, at, value).withColumn("_k", F.row_number().over(one)).groupBy(*keys, at).agg(F.sum(value).alias("_sum"), F.collect_list(F.when((F.col("_k") <= k) & (F.col(value) > 0), F.col(value))).alias("_top"))
    period = W.partitionBy(*keys).orderBy(at).rangeBetween(-(days - 1), 0)
    best = F.slice(F.sort_array(F.flatten(F.collect_list("_top").over(period)), asc=False), 1, k)
    return days_.select(*keys, at, F.sum("_sum").over(period).alias("total"), F.aggregate(best, F.lit(0).cast("bigint"), lambda a, v: a + v).alias("top"))
