"""Open positions marked on every day, without looking at the days on which nothing can happen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapegrade.plans.dialect import Frames


def underwater_days(t: Frames, width: int = 64) -> DataFrame:
    """(address, coin, trip, day, share): days on which an open position's loss is at least ``zombie_upnl`` of the equity.

    A position that stays open for years has a row for each of its days only where that can be so: it is first cut into blocks of days, and a block whose
    lowest (for shorts: highest) mark would not cost enough even at the smallest equity of the address is dropped whole.
    """
    c = t.config
    daily = t["daily_marks"].select("coin", F.col("day").alias("at"), "vwap_u").withColumn("block", F.floor(F.col("at") / width))
    bounds = daily.groupBy("coin", "block").agg(F.min("vwap_u").alias("low_u"), F.max("vwap_u").alias("high_u"))
    spans = t["equity_spans"]
    least = spans.groupBy("address").agg(F.min(F.when(F.col("equity_u") > 0, F.col("equity_u"))).alias("least_u"))
    # the smallest equity comes before the blocks, so that the many rows of these are only filtered
    cut = t["open_books"].join(least, "address").withColumn("block", F.explode(F.sequence(F.floor(F.col("day") / width), F.floor((F.col("until") - 1) / width)))).join(bounds, ["coin", "block"])
    loss = lambda mark: F.col("q") * (F.col(mark) - F.col("cost") * 1e6)
    worst = F.when(F.col("q") > 0, loss("low_u")).otherwise(loss("high_u"))
    left = cut.filter(worst <= c.zombie_upnl * F.col("least_u")).select("address", "coin", "trip", "day", "until", "q", "cost", "block")
    marked = left.join(daily, ["coin", "block"]).filter((F.col("at") >= F.col("day")) & (F.col("at") < F.col("until"))).select("address", "coin", "trip", F.col("at").alias("day"), "q", "cost", "vwap_u")
    # days meet the equity of their span by address; what is left is a small part of all open days
    own = spans.select("address", F.col("day").alias("since"), "until", "equity_u").filter("equity_u > 0")
    met = marked.join(own, "address").filter((F.col("day") >= F.col("since")) & (F.col("day") < F.col("until")) & (loss("vwap_u") <= c.zombie_upnl * F.col("equity_u")))
    return met.select("address", "coin", "trip", "day", (F.abs("q") * F.col("vwap_u") / F.col("equity_u")).alias("share"))


def equity(t: Frames) -> DataFrame:
    """One row an address and active day. Results and flows go by address once; a day of one address has few rows, so sums before that would spare little and cost a second shuffle."""
    zero = F.lit(0).cast("bigint")
    moves = t["fills"].select("address", "day", (F.col("pnl_u") - F.col("fee_u")).alias("net_u"), zero.alias("flow_u")).unionByName(t["flows"].select("address", "day", zero.alias("net_u"), "flow_u"))
    days = moves.repartition("address").groupBy("address", "day").agg(F.sum("net_u").alias("net_u"), F.sum("flow_u").alias("flow_u"))
    own = days.join(t["registry"].select("address", "value_u"), "address")
    upto = F.sum(F.col("net_u") + F.col("flow_u")).over(W.partitionBy("address").orderBy("day"))
    return own.select("address", "day", F.expr("year(date_add(DATE '1970-01-01', CAST(day AS INT))) * 12 + month(date_add(DATE '1970-01-01', CAST(day AS INT))) - 1").alias("month"), "net_u", "flow_u", (F.lit(1_000_000_000_000) + F.col("value_u") + upto).cast("bigint").alias("equity_u"))


BUILT = {"underwater_days": underwater_days, "equity": equity}
