"""Position events of many addresses in one call, over several micro-batches."""

import random
import time

from tapegrade.streaming import live


def test_positions_go_on_over_batches_and_share_their_state(spark, tmp_path):
    draw = random.Random(7)
    rows = [(i, draw.randrange(1500), 1_000 * (i // 3), draw.choice(["a", "b", None]), draw.randrange(2)) for i in range(6000)]
    for part in (rows[:3000], rows[3000:]):
        draw.shuffle(part)
        spark.createDataFrame(part, "id long, address long, at long, coin string, side int").selectExpr("id", "address", "timestamp_millis(at) AS ts", "coin", "side").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are taken by their time
    stream = spark.readStream.schema("id long, address long, ts timestamp, coin string, side int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = live.position_events(stream).writeStream.format("memory").queryName("positions_out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    held, expected = {}, set()
    for i, address, _, coin, side in sorted(rows, key=lambda r: (r[2], r[0])):
        before = held.get((address, coin), 0)
        after = held[address, coin] = before + (1 if side == 1 else -1)
        expected.add((i, address, coin, before, after, "open" if before == 0 else "close" if after == 0 else "add" if abs(after) > abs(before) else "reduce"))
    got = [tuple(r) for r in spark.table("positions_out").collect()]
    assert len(got) == len(rows) and set(got) == expected
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(states) >= 2 and max(states) <= live.DEALT < len(held)
