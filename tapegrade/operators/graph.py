"""Connected components of an edge table by alternating large and small stars, in DataFrame operations."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share; only a local master without a setting gets a temporary one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            where = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder that all executors share, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a partition of an edge table; fewer rows than this are one partition, which needs no shuffle.
ROWS = 100_000


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of so many counted rows in as many partitions as they need."""
    return df.coalesce(max(1, -(-rows // ROWS)))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node of ``edges`` (columns a, b: long).

    Each round joins a node's neighbours with their minimum. The edge table shrinks towards one star a
    component; it is written to the checkpoint folder after each round, and the loop ends when it no
    longer changes. Its partitions follow its rows, so that small tables cost no shuffles. Only a count and a checksum of the edges reach the driver.
    """
    now = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        met = both.join(least, "a")
        if large:
            # neighbours above a node move to its minimum
            return met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        return met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()

    def mark(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(now)
    now = packed(now, before[0])
    for _ in range(most_rounds):
        now = saved(star(star(now, True), False))
        after = mark(now)
        now = packed(now, after[0])
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
