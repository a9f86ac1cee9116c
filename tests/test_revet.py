"""Re-vet triggers, stored and live, and the rules of vetting: hand-made wallets on both sides of each."""

from collections import Counter

import pytest

from tapegrade.plans import catalog
from tapegrade.streaming import live, revet, states

from .test_detectors import fills, flows, frames, registry
from .test_states import ROWS, START, made

ENVELOPE = [(0, 0.2, 600.0), (1, 0.05, 100_000.0)]
LINKS = [(0, 1), (5, 2)]


def row(at, kind="fill", side=1, price=10.0, amount=40.0, coin="X", linked=True, worst=0.2, hold=600.0, i=1):
    """A live row so many seconds after the start."""
    return {"id": i, "us": int(at * 1_000_000), "kind": kind, "side": side, "price": price, "amount": amount, "coin": coin, "linked": linked, "worst": worst, "hold": hold}


def told(*rows, **settings):
    return [e[2] for e in states.replay(revet.Watch(**settings), rows)[1]]


def test_each_liquidation_and_each_unknown_partner():
    assert told(row(0), row(1, "liquidation"), row(2), row(3, "liquidation")) == ["liquidation"] * 2
    assert told(row(0, "transfer", linked=False), row(1, "transfer"), row(2, "transfer", linked=False)) == ["link"] * 2


def test_a_rescue_counts_all_coins():
    """10 lost on one coin and 30 on another are 40 of 60 left; a gain on the other coin makes it none."""
    lost = [row(0), row(1, coin="Y", price=60.0), row(2, side=0, coin="X", price=1.0), row(3, coin="Y", price=1.0)]
    assert "rescue" in told(*lost, row(4, "deposit"))
    assert "rescue" not in told(*lost, row(4, "deposit", amount=1.0))
    assert "rescue" not in told(row(0), row(1, price=11.0), row(2, "deposit"))
    assert "rescue" not in told(row(0, "deposit"))


def test_a_drawdown_fires_once_until_it_has_healed():
    """An account of 100 bought at 50: a mark at 10 is a fall of 0.4 against 1.5 x 0.2; flows do not count as falls."""
    fall = [row(0, price=50.0), row(1, price=10.0), row(2, price=9.0)]
    assert told(*fall) == ["drawdown"]
    assert told(*fall, row(3, price=200.0), row(4, price=1.0), gate=1e9) == ["drawdown"] * 2
    assert told(row(0, price=50.0, worst=0.9), row(1, price=10.0, worst=0.9)) == []
    assert told(row(0, "withdraw", amount=80.0), row(1, "withdraw", amount=10.0)) == []


def test_leverage_above_the_gate():
    assert told(*(row(k, price=100.0) for k in range(12))) == ["leverage"]
    assert told(*(row(k, price=100.0) for k in range(10))) == []
    assert told(row(0, price=100.0, worst=9.0), row(1, "withdraw", amount=100.0, worst=9.0)) == ["leverage"]


def test_a_week_lost_in_a_green_month():
    day = 86_400
    won = [row(0, price=10.0), row(day, side=0, price=40.0)]
    lost = [row(12 * day, price=30.0), row(13 * day, side=0, price=20.0)]
    assert told(*won, *lost, recent=9) == ["crashed"]
    assert told(*won, row(3 * day, price=30.0), row(4 * day, side=0, price=20.0), recent=9) == []
    assert told(row(0, price=30.0), row(day, side=0, price=20.0), recent=9) == []


@pytest.mark.parametrize("held, usual, drifts", [(100, 600, True), (600, 600, False), (50_000, 600, True), (50_000, 60_000, False), (100, 60, False), (100, 60_000, True)])
def test_holding_times_leave_the_band(held, usual, drifts):
    rows = [x for k in range(5) for x in (row(k * 100_000, hold=usual), row(k * 100_000 + held, side=0, hold=usual))]
    assert told(*rows) == (["hold_drift"] if drifts else [])
    assert told(*rows[:8]) == []


def test_still_accounts_start_anew():
    m = revet.Watch()
    assert states.replay(m, [row(0), row(1, side=0, price=1.0)], None, 40 * states.DAY)[0] == m.begin()
    assert states.replay(m, [row(0)], None, 40 * states.DAY)[0]["books"]


def test_triggers_in_micro_batches_equal_one_pass(spark, tmp_path):
    rows = [(*r, r[1] + r[6] % 7) for r in made(4, 500, 14_400)]
    schema = ROWS + ", partner long"
    for p in range(4):
        # every fourth file has rows of the next one's time, and rows come in any order
        part = [r for k, r in enumerate(rows) if (k + (k % 11 == 0) * 30) * 4 // (len(rows) + 30) == p]
        spark.createDataFrame(part[::-1], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    envelope, known = spark.createDataFrame(ENVELOPE, "address long, worst double, hold double"), spark.createDataFrame(LINKS, "src long, dst long")
    machine = revet.Watch(capital=60.0, low_s=200, high_s=900)
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    got = live.drained(revet.revet_alerts(revet.watched(states.feed(stream), envelope, known), machine), keyed=True).collect()
    upto = int(((max(r[2] for r in rows) - START).total_seconds() - 600) * 1000) * 1000
    by = {}
    for r in revet.watched(states.feed(spark.createDataFrame(rows, schema)), envelope, known).collect():
        by.setdefault(r.address, []).append(r.asDict())
    start = min(r["us"] for x in by.values() for r in x) - int((rows[0][2] - START).total_seconds() * 1e6)
    want = Counter((e[0], a, *e[1:]) for a, x in by.items() for e in states.replay(machine, sorted((r for r in x if r["us"] < start + upto), key=lambda r: (r["us"], r["id"])), None, start + upto)[1])
    assert Counter((r.id, r.address, r.us, r.trigger, r.value, r.bound) for r in got) == want
    assert {r.trigger for r in got} >= {"liquidation", "rescue", "drawdown", "leverage", "link"}


def test_stored_triggers(spark):
    """One address a trigger, and for each one that is just short of it."""
    last = 1_000
    t = frames(
        spark, last_day=spark.createDataFrame([(last, 33)], "last int, last_month int"),
        fills=spark.createDataFrame([(1, last, "R", 1, 40), (11, last, "R", 1, 41), (12, last - 30, "R", 1, 40)], "address long, day int, flag string, ln int, ok long"),
        rescues=spark.createDataFrame([(2, last - 3), (21, last - 40)], "address long, day int"),
        drawdowns=spark.createDataFrame([(a, d, x) for a, b, now in ((3, 0.2, 0.31), (31, 0.2, 0.3)) for d, x in ((last - 100, b), (last - 1, now))], "address long, day int, dd double"),
        leverage=spark.createDataFrame([(4, last, 10.5), (41, last, 10.0), (42, last - 60, 50.0)], "address long, day int, lev double"),
        transfers=spark.createDataFrame([(5, 9, last - 2), (51, 9, last - 2), (51, 9, last - 200)], "src long, dst long, day int"),
        equity=spark.createDataFrame([(a, d, n) for a, x in ((6, 5), (61, 50), (62, -5)) for d, n in ((last - 12, x * 4), (last - 1, -10))], "address long, day int, net_u long").filter("NOT (address = 61 AND net_u < 0)"),
        closed_trips=spark.createDataFrame([(a, d, h) for a, was, now in ((7, 0, 3), (71, 2, 3), (72, 0, 0)) for d, h in ((last - 90, was), (last - 1, now))], "address long, close_day int, hold int").unionByName(spark.createDataFrame([(3, last - 90, 0), (31, last - 90, 0)], "address long, close_day int, hold int")),
    )
    t.made["drawdowns"] = t.made["drawdowns"].unionByName(spark.createDataFrame([(a, last - 90, 0.1) for a in (7, 71, 72)], "address long, day int, dd double"))
    got = {(r.address, r.kind, r.first_day) for r in t.sql(catalog.TEXTS["revet"]).collect()}
    assert got == {(1, "liquidation", last), (2, "rescue", last - 3), (3, "drawdown", last - 1), (4, "leverage", last), (5, "link", last - 2), (6, "crashed", last - 1), (7, "hold_drift", last - 1)}


def test_open_legs(spark):
    """Six coins open at once are too many, five are not, nor are seven one after another."""
    rows = [(1, f"c{k}", 10 + k, 1, 10, 0) for k in range(6)] + [(1, "c0", 99, -1, 10, 0)] + [(2, f"c{k}", 10 + k, 1, 10, 0) for k in range(5)] + [(2, "c0", 99, -1, 10, 0)]
    rows += [x for k in range(7) for x in ((3, f"c{k}", 10 + 2 * k, 1, 10, 0), (3, f"c{k}", 11 + 2 * k, -1, 10, 0))]
    t = frames(spark, fills=fills(spark, [(a, c, d, q, p, n) for a, c, d, q, p, n in rows]))
    assert {r.address: (r.open_legs, r.severity) for r in t.sql(catalog.TEXTS["d_b1"]).collect()} == {1: (6, "VETO"), 2: (5, "PASS"), 3: (1, "PASS")}


def test_own_books_find_a_wrong_result(spark):
    """Bought 1 at 10 and 3 at 14, sold 2 at 16: 6 over the average of 13; a stored result of 9 is off."""
    rows = [(a, "X", d, q, p, n) for a, n in ((1, 6), (2, 9)) for d, q, p, n in ((1, 1, 10, 0), (2, 3, 14, 0), (3, -2, 16, n))]
    got = {(r.address, r.day): (r.own, r.verdict) for r in frames(spark, fills=fills(spark, rows)).sql(catalog.TEXTS["pnl_crosscheck"]).collect()}
    assert got[1, 3] == (6.0, "ok") and got[2, 3] == (6.0, "off") and got[1, 1] == (0.0, "ok")


def test_stops(spark):
    """Trips that a prepared order has reduced, of all and of losing ones."""
    rows = [(1, "X", 1, 1, 10, 0), (1, "X", 2, -1, 10, -5), (1, "X", 3, 1, 10, 0), (1, "X", 4, -1, 10, 5)]
    r = frames(spark, fills=fills(spark, rows), trigger_orders=spark.createDataFrame([(1,), (2,)], "ok long")).sql(catalog.TEXTS["stop_usage"]).first()
    # order 2 only opens
    assert (r.n_trips, r.n_stopped, r.stop_share, r.stop_share_of_losses) == (2, 1, 0.5, 1.0)


def test_all_reasons_of_vetting(spark):
    board = registry(spark, {a: 0 for a in range(1, 9)}).selectExpr("address", "CASE address WHEN 1 THEN 'agent' WHEN 3 THEN 'vault' ELSE 'user' END AS role")
    people = spark.createDataFrame([(a, "backstop" if a == 2 else "x", 0 if a == 4 else 1, 7 if a in (5, 6, 7) else 10 + a) for a in range(1, 9)], "address long, name string, slot int, cluster long")
    trades = fills(spark, [(a, "X", k, (-1) ** k if a == 6 else 1, 10, 0) for a in range(1, 9) for k in range(45 if a == 7 else 4)])
    stats = spark.createDataFrame([(a, 0.0 if a == 3 else 0.5, 2, 1_000_000) for a in range(1, 9)], "address long, median_hold double, n_trips long, net_u long")
    flow = flows(spark, [(6, 1, 5, "internalTransfer", 200)]).unionByName(flows(spark, [(8, 2, 5, "internalTransfer", 5)]).selectExpr("address", "id", "day", "month", "kind", "usdc_u", "flow_u", "'2-HIGH' AS priority"))
    t = frames(
        spark, board=board, registry=people, fills=trades, trip_stats=stats, flows=flow, day_stats=spark.createDataFrame([(a, 100_000_000) for a in range(1, 9)], "address long, last_u long"),
        liquidations=spark.createDataFrame([(a, int(a == 8)) for a in range(1, 9)], "address long, lifetime long"), coin_share=spark.createDataFrame([(5, 0.9)], "address long, top_coin double"),
    )
    got = {r.address: (r.verdict, r.reasons, r.trading_equity) for r in t.sql(catalog.TEXTS["vet_d"]).collect()}
    assert got == {
        1: ("EXCLUDE", "EXCLUDE:agent", 100.0), 2: ("EXCLUDE", "EXCLUDE:backstop", 100.0), 3: ("VETO", "VETO:vault,VETO:hft", 100.0), 4: ("FLAG", "FLAG:calibration", 100.0), 5: ("VETO", "VETO:one_hit,FLAG:cluster", 100.0),
        6: ("VETO", "VETO:carry,FLAG:cluster", 100.0), 7: ("VETO", "VETO:churn,FLAG:cluster", 100.0), 8: ("FLAG", "FLAG:liquidated,SUBTRACT:debt", 95.0),
    }


def test_identifiers_of_pages_and_documents(spark):
    wallet = "0x" + "aB" * 20
    pages = spark.createDataFrame([("http://Example.com/a",), (None,), (f"https://scan.org/address/{wallet}",)], "url string")
    documents = spark.createDataFrame([(f"{wallet} and {wallet.lower()}, see https://example.com/x",), ("",), (None,), ("0x12",)], "text string")
    got = {(r.kind, r.name): (r.in_pages, r.in_documents) for r in frames(spark, pages=pages, documents=documents).sql(catalog.TEXTS["extract_identifiers"]).collect()}
    assert got == {("host", "example.com"): (1, 1), ("host", "scan.org"): (1, 0), ("address", wallet.lower()): (1, 2)}
