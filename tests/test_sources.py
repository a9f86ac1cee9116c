"""Payload readers, drift, limiter, paging, measures, engine."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tapegrade import engine
from tapegrade.functions import measures
from tapegrade.sources import payloads
from tapegrade.sources.limiter import TokenBucket, pages, weight


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def fill(tid, **more):
    return {"coin": "BTC", "px": "1.5", "sz": "2", "side": "B", "time": 5, "startPosition": "0", "dir": "Open Long", "closedPnl": "0", "hash": "h", "oid": 1, "crossed": True, "fee": "0.1", "tid": tid} | more


def test_three_fill_shapes_make_one_table(spark, tmp_path):
    a = lines(tmp_path / "a", [{"coin": "BTC", "side": "B", "time": 1, "px": "1", "sz": "1", "hash": "x", "tid": 1, "side_info": [{"user": "0xAA", "start_pos": "0", "oid": 1}, {"user": "0xBB", "start_pos": "3", "oid": 2}]}])
    b = lines(tmp_path / "b", [{"user": "0xCC", "fill": fill(2)}, {"user": "0xcc", "fill": fill(2)}])
    c = lines(tmp_path / "c", [{"block_number": 1, "block_time": 1, "events": [{"user": "0xDD", "fill": fill(3, twapId=7)}, {"user": "0xDD", "fill": fill(4)}]}])
    got = sorted((r["address"], r["tid"], r["fee"] is None, r["twapId"]) for r in payloads.fills(spark, a, b, c).collect())
    assert got == [("0xaa", 1, True, None), ("0xbb", 1, True, None), ("0xcc", 2, False, None), ("0xdd", 3, False, 7), ("0xdd", 4, False, None)]


def test_drift_names_unknown_fields(spark, tmp_path):
    path = lines(tmp_path / "t", [{"coin": "A", "px": "1", "new": 1}, {"coin": "B", "new": 2, "other": 3}])
    assert {(r["field"], r["n"]) for r in payloads.drift(spark, path, "trades").collect()} == {("new", 2), ("other", 1)}


def test_broken_lines_are_kept_apart(spark, tmp_path):
    df = payloads.read(spark, lines(tmp_path / "t", [{"coin": "A"}, "{broken"]), "trades")
    assert df.cache().filter("_corrupt_record is not null").count() == 1


def test_ledger_flows(spark, tmp_path):
    entry = lambda kind, **d: {"user": "0xA", "time": 1, "hash": "h", "delta": {"type": kind, **d}}
    path = lines(tmp_path / "l", [entry("deposit", usdc="5"), entry("withdraw", usdc="2"), entry("accountClassTransfer", usdc="3", toPerp=True), entry("internalTransfer", usdc="4", destination="0xa"), entry("send", amount="1", destination="0xb"), entry("rewardsClaim", amount="9")])
    got = {r["type"]: (float(r["flow"]), r["income"]) for r in payloads.ledger_flows(spark, path).collect()}
    assert got == {"deposit": (5, False), "withdraw": (-2, False), "accountClassTransfer": (3, False), "internalTransfer": (4, False), "send": (-1, False), "rewardsClaim": (0, True)}


def test_leaderboard_and_seeds(spark, tmp_path):
    path = lines(tmp_path / "b", [{"ethAddress": "0xA", "accountValue": "10", "windowPerformances": [{"span": "day", "pnl": "1", "roi": 0.1, "vlm": "5"}, {"span": "week", "pnl": "2", "roi": "0.2", "vlm": "6"}]}])
    assert {(r["address"], r["span"], float(r["pnl"]), r["roi"]) for r in payloads.leaderboard(spark, path).collect()} == {("0xa", "day", 1.0, 0.1), ("0xa", "week", 2.0, 0.2)}
    name = "0x" + "aB" * 20
    assert [r["address"] for r in payloads.seeds(spark, lines(tmp_path / "s", [f"x,{name},y", f"{name} and 0x12 and {name}f"])).collect()] == [name.lower()]


def test_tape_layout(spark, tmp_path):
    df = spark.createDataFrame([("A", 86_400_000 * d, d) for d in (1, 1, 2)], "coin string, time long, tid long")
    payloads.write_tape(df, str(tmp_path / "tape"))
    assert sorted(p.name for p in (tmp_path / "tape").glob("date=*")) == ["date=1970-01-02", "date=1970-01-03"]


def test_bucket_keeps_the_limit_and_the_lanes():
    now = [0.0]
    b = TokenBucket(100, lambda: now[0])
    for i in range(10):
        b.submit(("deep", i), 30, "deep")
    b.submit(("monitor", 0), 30, "monitor")
    assert list(b.ready()) == [("monitor", 0), ("deep", 0), ("deep", 1)]
    now[0] = 59.0
    assert list(b.ready()) == []
    now[0] = 61.0
    assert len(list(b.ready())) == 3
    b.rejected()
    now[0] = 125.0 if b.pause_until <= 125 else b.pause_until
    assert len(list(b.ready())) == 3
    with pytest.raises(ValueError):
        b.submit("x", 101, "deep")
    assert weight(20, 41) == 23


def test_paging_keeps_records_that_share_a_millisecond():
    data = [{"time": i, "tid": i} for i in range(1999)] + [{"time": 1999, "tid": 1999}, {"time": 1999, "tid": 2000}]
    got, cut = pages(lambda start: [r for r in data if r["time"] >= start][:2000], 0)
    assert len(got) == 2001 and not cut
    assert pages(lambda start: [{"time": start + i, "tid": start + i} for i in range(2000)], 0)[1]


def test_measures(spark):
    df = spark.createDataFrame([(0.1, 50.0), (0.037037, -10.0), (-0.1, 20.0)], "r double, pnl double")
    r = df.agg(measures.chained(F.col("r")).alias("twr"), measures.profit_factor(F.col("pnl")).alias("pf")).first()
    assert round(r["twr"], 5) == 0.02667 and r["pf"] == 7.0
    for z in (-3.0, -0.5, 0.0, 1.96):
        got = spark.range(1).select(measures.normal_cdf(F.lit(z))).first()[0]
        assert abs(got - 0.5 * (1 + math.erf(z / math.sqrt(2)))) < 1e-6
    assert spark.range(1).select(measures.modified_dietz(F.lit(100.0), F.lit(150.0), F.lit(50.0))).first()[0] == 0.0


def test_vet_and_report(spark, sf):
    got = engine.vet(spark, sf, 1)
    assert got["gates"].count() == 1 and got["detectors"].filter("severity is not null").count() > 5
    assert engine.report(spark, sf, 3).startswith("# Report")
