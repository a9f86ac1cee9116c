"""Mixing sources to target weights by subset-sum budget fitting.

1. Sizes: words (runs of anything but ASCII white space) of each whole text, counted in the JVM.
2. Targets: sources in code-point order (null last) get weights in rotation and share a budget; a source's
   target stops at ``max_epochs`` times its size and the excess is shared anew by weight among the rest.
3. Fitting, per source: documents are counted by exact length, so the knapsack's input is one row a
   length, not a document. Whole epochs come first. Of the remaining budget every length class gives its
   proportional share, rounded down; what the rounding leaves is filled from the longest length down until
   less than ``window`` words are missing, and a bounded-knapsack dynamic program over the lengths that
   still have documents finds the reachable sum nearest below the rest. Its table is a bitset of
   ``window`` bits with the piece that first reached each sum, whatever the corpus' size. Lengths are divided by
   their common divisor first. If the sum falls short, the window doubles; once it covers the whole rest, no shares
   are given beforehand and the result is the nearest reachable sum below the target. ``widest`` (2**24 words, some 200 MB)
   bounds the table: a source whose rest is larger *and* whose sums still miss the target at that window gets
   the nearest sum found there; a larger ``widest`` makes it exact, for some 12 bytes a word of the rest.
4. Selection: of each (source, length) class, as many documents as the fit says, in order of a seeded
   hash of the id. The class is cut into hash buckets of about ``bucket_rows`` documents whose counts are
   summed first, so that only the one bucket that the limit falls into is ranked; a class that holds a
   third of all rows is never sorted in one task.

Defined results: a null text has size 0; documents of size 0 are taken 0 words. A null source is a
source of its own, after all others. Rows are ranked by (hash, id, text length); rows that repeat an id
count as documents of their own. An empty table gives an empty one. Reruns give the same rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import prepare, saved

WORDS = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def targets(sizes: list[tuple[str | None, int]], weights=(3, 1, 2), budget: float = 1.5, max_epochs: int = 2) -> dict[str | None, float]:
    """Target words by source: weighted shares of the budget, no source above ``max_epochs`` times its size."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {name: weights[i % len(weights)] for i, (name, _) in enumerate(order)}
    size = dict(order)
    out = {name: 0.0 for name in size}
    left, open_ = budget * sum(size.values()), list(size)
    while open_ and left > 0:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit >= max_epochs * size[s]]
        if not full:
            for s in open_:
                out[s] = weight[s] * unit
            break
        for s in full:
            out[s] = float(max_epochs * size[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in set(full)]
    return out


def goals(sizes: DataFrame, weights=(3, 1, 2), budget: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """``targets`` as a table: source, source_size, target; sources may be as many as hosts, so they stay on the executors.

    A target is min(cap, weight * unit). ``unit`` rises in rounds of one sum over the table, each of which finds further full sources.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranked = saved(sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    # one row a partition
    heads = ranked.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"))
    heads = heads.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("head"))
    place = F.col("head") + F.col("at").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    table = saved(ranked.join(heads, F.shiftright("at", 33) == F.col("part")).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_epochs).alias("cap")))
    every = table.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    unit, known = (budget * every["size"] / every["weight"] if every["weight"] else 0.0), -1
    while True:
        full = F.col("weight") * unit >= F.col("cap")
        r = table.agg(F.count(F.when(full, 1)).alias("n"), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)).alias("cap"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if r["n"] == known or not r["open"]:
            break
        unit, known = (budget * every["size"] - r["cap"]) / r["open"], r["n"]
    return table.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * unit).alias("target"))


def fit_counts(lengths: np.ndarray, counts: np.ndarray, target: float, max_epochs: int = 2, window: int = 1 << 17, widest: int = 1 << 24) -> tuple[int, np.ndarray]:
    """Whole epochs, and how many documents of each length to take once more."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    if total == 0 or target <= 0:
        return 0, np.zeros(len(lengths), np.int64)
    epochs = min(int(target // total), max_epochs)
    if epochs == max_epochs:
        return epochs, np.zeros(len(lengths), np.int64)
    # every reachable sum is a multiple of the lengths' common divisor
    unit = int(np.gcd.reduce(lengths[counts > 0]))
    small, rest = lengths // unit, int(round(target - epochs * total)) // unit
    while True:
        take, missed = fit_shares(small, counts, rest, window)
        if not missed:
            return epochs, take
        if rest <= window:
            # nothing is given beforehand: the largest sum that any choice reaches
            return epochs, knapsack(small, counts, rest)
        if window >= widest:
            return epochs, take
        window *= 2


def fit_shares(lengths: np.ndarray, counts: np.ndarray, rest: int, window: int) -> tuple[np.ndarray, int]:
    """Documents by length, the last ``window`` words or so by dynamic program, and the words still missing."""
    total = int((lengths * counts).sum())
    take = np.array([int(c) * rest // total for c in counts], np.int64)
    rest -= int((take * lengths).sum())
    free = counts - take
    # in the first round at least one document of each length is left for the dynamic program
    for spare in (1, 0):
        for i in np.argsort(-lengths, kind="stable"):
            if rest <= window or lengths[i] == 0:
                break
            n = min(int(free[i]) - spare, (rest - window) // int(lengths[i]))
            if n > 0:
                take[i] += n
                free[i] -= n
                rest -= n * int(lengths[i])
    # a document longer than the window may straddle its end
    more = knapsack(lengths, free, min(rest, 2 * window))
    return take + more, rest - int((more * lengths).sum())


def knapsack(lengths: np.ndarray, free: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: documents by length whose sum is the largest reachable one up to ``budget``."""
    taken = np.zeros(len(lengths), np.int64)
    if budget <= 0:
        return taken
    pieces: list[tuple[int, int]] = []
    first = np.full(budget + 1, -1, np.int32)
    reach, mask = 1, (1 << (budget + 1)) - 1
    for i in np.argsort(lengths, kind="stable"):
        size, left, step = int(lengths[i]), int(free[i]), 1
        if size <= 0 or size > budget:
            continue
        left = min(left, budget // size)
        while left > 0:
            n = min(step, left)
            moved = (reach << (size * n)) & mask & ~reach
            if moved:
                new = np.unpackbits(np.frombuffer(moved.to_bytes(budget // 8 + 1, "little"), np.uint8), bitorder="little")[: budget + 1]
                first[new.view(bool)] = len(pieces)
                reach |= moved
            pieces.append((int(i), n))
            left -= n
            step *= 2
        if reach >> budget & 1:
            break
    at = reach.bit_length() - 1
    while at > 0:
        i, n = pieces[first[at]]
        taken[i] += n
        at -= int(lengths[i]) * n
    return taken


def mix_sources(docs: DataFrame, weights=(3, 1, 2), budget: float = 1.5, max_epochs: int = 2, seed: int = 0, bucket_rows: int = 512, salts: int = 16, doc_id: str = "doc_id", source: str = "source", text: str = "text", window: int = 1 << 17, widest: int = 1 << 24) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (size times copies) of every row."""
    prepare(docs.sparkSession)
    # (id, source, size) alone is kept: a few bytes a document, and the texts are read once
    sized = saved(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")).withColumn("h", F.xxhash64("doc_id", F.lit(seed))))
    classes = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    sizes = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = goals(sizes, weights, budget, max_epochs)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", kind="stable").reset_index(drop=True)
        epochs, take = fit_counts(pdf["size"].to_numpy(), pdf["n"].to_numpy(), float(pdf["target"].iloc[0]), max_epochs, window, widest)
        return pdf.assign(epochs=epochs, take=take)[["source", "size", "n", "source_size", "target", "epochs", "take"]]

    schema = "source string, size long, n long, source_size long, target double, epochs long, take long"
    # a source's lengths: at most as many rows as its longest document has words
    fitted = saved(classes.join(goal, classes["source"].eqNullSafe(goal["source"])).drop(goal["source"]).groupBy("source").applyInPandas(fit, schema))
    fitted = fitted.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("n") / bucket_rows)))
    key = F.struct(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"), F.col("size").alias("z"))
    # a class may hold a third of all rows: its rows meet copies of its one fitted row in ``salts`` partitions
    spread = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = sized.withColumn("key", key).withColumn("salt", F.pmod("h", F.lit(salts)).cast("int"))
    joined = salted.join(spread(fitted.withColumn("key", key).drop("source", "size")), ["key", "salt"])
    # the hash's order is kept by its buckets: bucket b holds the hashes from b/buckets of the range on
    unit = (F.shiftrightunsigned(F.col("h"), 33)).cast("double") / float(1 << 31)
    # read three times below
    dealt = saved(joined.withColumn("bucket", F.least(F.floor(unit * F.col("buckets")), F.col("buckets") - 1).cast("long")))
    partial = F.col("take").between(1, F.col("n") - 1)
    counts = dealt.filter(partial).groupBy("key", "bucket").agg(F.count("*").alias("m"), F.max("take").alias("limit"))
    # one row a bucket; running sums go over a class's buckets in two steps, so that a large class is no single task
    wide = 256
    coarse = counts.withColumn("group", F.floor(F.col("bucket") / wide))
    sums = coarse.groupBy("key", "group").agg(F.sum("m").alias("gm"))
    before = sums.withColumn("ahead", F.coalesce(F.sum("gm").over(W.partitionBy("key").orderBy("group").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("gm")
    cut = coarse.join(before, ["key", "group"]).withColumn("lead", F.col("ahead") + F.coalesce(F.sum("m").over(W.partitionBy("key", "group").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    cut = cut.select("key", F.col("bucket").alias("cut"), (F.col("limit") - F.col("lead")).alias("room")).filter((F.col("room") > 0) & (F.col("room") <= F.col("m")))
    # the bucket where the limit falls: before it all are taken, after it none; one row a class
    chosen = dealt.join(spread(cut), ["key", "salt"], "left")
    ranked = chosen.filter(partial & (F.col("bucket") == F.col("cut"))).withColumn("rank", F.row_number().over(W.partitionBy("key", "bucket").orderBy("h", "doc_id")))
    plain = chosen.filter(~(partial & (F.col("bucket") == F.col("cut"))) | ~partial).withColumn("rank", F.lit(0))
    both = ranked.unionByName(plain)
    extra = F.when(~partial, F.when(F.col("take") > 0, 1).otherwise(0)).when(F.col("bucket") < F.col("cut"), 1).when(F.col("bucket") > F.col("cut"), 0).otherwise(F.when(F.col("rank") <= F.col("room"), 1).otherwise(0))
    copies = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.least(F.col("epochs") + extra, F.lit(max_epochs)))
    return both.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))
