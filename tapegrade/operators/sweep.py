"""Distinct counts over the recent past by a sweep instead of a self-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def distinct_recent(df: DataFrame, keys: list[str], at: str, who: str, span: int, slot: int | None = None) -> DataFrame:
    """(keys, at, addresses): for each moment of a row, how many distinct ``who`` have a row of the same keys in [at - span, at].

    A row counts from its own moment until the same ``who`` has another one, or the span is over, so each ``who`` counts once at any moment and the
    count is a running sum of arrivals and departures. Time is cut into slots, and a row that still counts when a slot begins
    arrives there too: a hot key is spread over its slots, each task sorts one, and rows grow by the share that crosses a slot's edge.
    """
    slot = slot or 4 * (span + 1)
    rows = df.select(*keys, F.col(at).alias("_at"), F.col(who).alias("_who"))
    # of rows of one moment and ``who`` one is left; departures are the first moment that no longer counts
    nexts = F.lead("_at").over(W.partitionBy(*keys, "_who").orderBy("_at"))
    lives = rows.distinct().withColumn("_until", F.least(F.col("_at") + span + 1, F.coalesce(nexts, F.col("_at") + span + 1)))
    slots = lives.withColumn("_slot", F.explode(F.sequence(F.floor(F.col("_at") / slot), F.floor((F.col("_until") - 1) / slot))))
    begin = F.col("_slot") * slot
    moves = slots.select(*keys, "_slot", F.explode(F.array(
        F.struct(F.greatest("_at", begin).alias("t"), F.lit(1).alias("step"), (F.col("_at") >= begin).alias("own")),
        F.struct(F.col("_until").alias("t"), F.lit(-1).alias("step"), F.lit(False).alias("own")),
    )).alias("m")).select(*keys, "_slot", "m.t", "m.step", "m.own")
    # a moment is one row before the running sum, so what arrives and leaves at once is settled
    settled = moves.groupBy(*keys, "_slot", "t").agg(F.sum("step").alias("step"), F.max("own").alias("own"))
    running = settled.withColumn("addresses", F.sum("step").over(W.partitionBy(*keys, "_slot").orderBy("t").rowsBetween(W.unboundedPreceding, 0)))
    return running.filter("own").select(*keys, F.col("t").alias(at), "addresses")
