"""Structured Streaming over the live actions: recorder, daily view, flocks, position events, triggers.

Each stream is a function of a streaming DataFrame, so that production reads it from any source. The registered
queries replay the stored events as files, drain them (``availableNow``), and read the sink's Parquet.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapegrade.operators.graph import saved
from tapegrade.operators.sweep import distinct_recent

#: How late a record may come; later ones are left to the batch repair job.
LATENESS = "10 minutes"


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored events as a stream: id, address, ts, coin, side (1 buys), units."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)
    side = F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 2
    return raw.select(F.col("event_id").alias("id"), F.col("user_id").alias("address"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("coin"), side.alias("side"), F.col("value"))


def recorded(stream: DataFrame) -> DataFrame:
    """Each action once, though the live feed and the gap filler may both deliver it."""
    return stream.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark(["id"])


def live_only(frames: DataFrame, flag: str = "isSnapshot") -> DataFrame:
    """Frames without the snapshots that open a subscription; a frame that says nothing is live."""
    return frames.filter(~F.coalesce(F.col(flag), F.lit(False)))


def daily(stream: DataFrame) -> DataFrame:
    """Actions by coin and day; in append mode a day is emitted once the watermark has passed it, in update mode at each change."""
    return stream.withWatermark("ts", LATENESS).groupBy(F.window("ts", "1 day"), "coin").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "coin", "n")


def flocks(rows: DataFrame, least: int = 2) -> DataFrame:
    """Moments from which several addresses act on one coin and side within a quarter of an hour, by a sweep over recorded actions: no action meets another."""
    back = rows.select("coin", "side", "address", (-F.unix_micros("ts")).alias("back"))
    seen = distinct_recent(back, ["coin", "side"], "back", "address", 900_000_000)
    return seen.filter(F.col("addresses") >= least).select(F.timestamp_micros(-F.col("back")).alias("start"), "coin", "side", "addresses")


def live_flocks(stream: DataFrame, least: int = 2) -> DataFrame:
    """While the stream runs: coins and sides by sliding windows of a quarter of an hour, a minute apart, with about so many addresses."""
    seen = stream.withWatermark("ts", LATENESS).groupBy(F.window("ts", "15 minutes", "1 minute"), "coin", "side").agg(F.approx_count_distinct("address").alias("addresses"))
    return seen.filter(F.col("addresses") >= least).select(F.col("window.start").alias("start"), "coin", "side", "addresses")


#: Groups that addresses are dealt to; part of a running stream's checkpoint.
DEALT = 1024


def position_events(stream: DataFrame) -> DataFrame:
    """open, add, reduce, close and flip events from a position kept by (address, coin), one unit an action.

    Addresses are dealt to groups, whose positions are one state: a call takes the rows of many addresses at once.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(zip(state.get[0], state.get[1]), state.get[2])) if state.exists else {}
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["address", "coin", "ts", "id"])
        address, coin = rows["address"].to_numpy().astype("int64"), rows["coin"].to_numpy(dtype=object)
        d = np.where(rows["side"].to_numpy() == 1, 1, -1).astype("int64")
        edge = np.flatnonzero(np.concatenate([[True], (address[1:] != address[:-1]) | (coin[1:] != coin[:-1]), [True]]))
        start, size = edge[:-1], np.diff(edge)
        keys = list(zip(address[start].tolist(), coin[start].tolist()))
        run = np.cumsum(d)
        after = run + np.repeat(np.array([held.get(k, 0) for k in keys], "int64") - run[start] + d[start], size)
        before = after - d
        event = np.select([before == 0, after == 0, np.abs(after) > np.abs(before)], ["open", "close", "add"], "reduce")
        held.update(zip(keys, after[edge[1:] - 1].tolist()))
        state.update(([a for a, _ in held], [c for _, c in held], list(held.values())))
        yield pd.DataFrame({"id": rows["id"].to_numpy(), "address": address, "coin": coin, "before_units": before, "after_units": after, "event": event.astype(object)})

    dealt = stream.withColumn("_group", F.pmod(F.xxhash64("address"), F.lit(DEALT)))
    return dealt.groupBy("_group").applyInPandasWithState(step, "id long, address long, coin string, before_units long, after_units long, event string", "addresses array<long>, coins array<string>, units array<long>", "append", GroupStateTimeout.NoTimeout)


def triggers(events: DataFrame, envelope: DataFrame) -> DataFrame:
    """Position events that leave an address' stored envelope: a stream-static join."""
    return events.join(envelope, "address").filter(F.abs("after_units") > F.col("most_units")).select("id", "address", "coin", "after_units", "most_units", F.lit("size").alias("trigger"))


STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drained(stream: DataFrame, keyed: bool = False) -> DataFrame:
    """All that is there now, through the file sink (exactly once, by its checkpoint); streams with ``keyed`` state need the store that has timers."""
    spark = stream.sparkSession
    if keyed:
        before = spark.conf.get(STORE[0], None)
        spark.conf.set(*STORE)
        try:
            return drained(stream)
        finally:
            spark.conf.set(STORE[0], before) if before else spark.conf.unset(STORE[0])
    if spark.sparkContext.getCheckpointDir() is None:
        saved(spark.range(0))  # sets the folder
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def drained_windows(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of every window there is now, open ones too: each batch's changed rows are written under its number."""
    spark = stream.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        saved(spark.range(0))  # sets the folder
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/out/batch=-1")

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    changes = spark.read.parquet(f"{folder}/out")
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*[f"v.{c}" if c in values else c for c in stream.columns])


def _query(build: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: drained(build(actions(spark, sf_dir)))


def stream_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    envelope = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("address")).agg((F.count("*") / 20 + 3).cast("long").alias("most_units"))
    return drained(triggers(position_events(actions(spark, sf_dir)), envelope))


QUERIES = {
    "stream_recorded": _query(recorded),
    "stream_daily": lambda spark, sf_dir: drained_windows(daily(actions(spark, sf_dir)), ["day", "coin"]),
    "stream_flocks": lambda spark, sf_dir: flocks(drained(recorded(actions(spark, sf_dir)))),
    "stream_positions": _query(position_events),
    "stream_triggers": stream_triggers,
}

_RUN = "SUM(CASE WHEN side = 1 THEN 1 ELSE -1 END) OVER (PARTITION BY address, coin ORDER BY ts, id ROWS UNBOUNDED PRECEDING)"
_ACTIONS = "SELECT event_id AS id, user_id AS address, ts, event_type AS coin, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 2 AS side FROM events"
ORACLES = {
    "stream_positions": f"""
        SELECT id, address, coin, CAST(after_units - d AS BIGINT) AS before_units, CAST(after_units AS BIGINT) AS after_units,
          CASE WHEN after_units - d = 0 THEN 'open' WHEN after_units = 0 THEN 'close' WHEN abs(after_units) > abs(after_units - d) THEN 'add' ELSE 'reduce' END AS event
        FROM (SELECT *, CASE WHEN side = 1 THEN 1 ELSE -1 END AS d, {_RUN} AS after_units FROM ({_ACTIONS}) a) p""",
    "stream_recorded": "SELECT event_id AS id, user_id AS address, ts, event_type AS coin, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 2 AS side, value FROM events",
}
