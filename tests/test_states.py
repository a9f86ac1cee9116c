"""Keyed state machines: streams in several micro-batches, with late rows, against one pass over the same rows."""

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tapegrade.streaming import live, states

ROWS = "id long, address long, ts timestamp, coin string, side int, value double, k int"
START = datetime.datetime(2024, 1, 1)


def made(seed, n=160, span=3_600):
    rng = random.Random(seed)
    at = sorted(rng.uniform(0, span) for _ in range(n))
    return [(i, rng.randrange(3), START + datetime.timedelta(seconds=t), rng.choice("XY"), rng.randrange(2), round(rng.uniform(1, 60), 2), rng.randrange(100)) for i, t in enumerate(at)]


def streamed(spark, tmp_path, rows, build, parts=4, seed=0):
    """The sink's rows after the feed came in ``parts`` files, each one shuffled and some rows a file late; and the last watermark in microseconds."""
    rng = random.Random(seed)
    folder = tmp_path / "feed"
    folder.mkdir()
    size = -(-len(rows) // parts)
    late = {r[0]: min(parts - 1, k // size + (rng.random() < 0.2 and k % size > size * 0.8)) for k, r in enumerate(rows)}
    schema = spark.createDataFrame([], ROWS).schema
    for p in range(parts):
        part = [r for r in rows if late[r[0]] == p]
        rng.shuffle(part)
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    got = live.drained(build(states.feed(stream)), keyed=True).collect()
    return got, int((max(r[2] for r in rows) - datetime.timedelta(minutes=10)).replace(tzinfo=datetime.timezone.utc).timestamp() * 1000) * 1000


def passed(spark, rows, keys, machine, upto):
    """key -> events of one pass."""
    by = {}
    for r in states.feed(spark.createDataFrame(rows, ROWS)).collect():
        by.setdefault(tuple(r[k] for k in keys), []).append(r.asDict())
    return {key: states.replay(machine, sorted((r for r in found if r["us"] < upto), key=lambda r: (r["us"], r["id"])), None, upto)[1] for key, found in by.items()}


def test_positions_in_micro_batches_equal_one_pass(spark, tmp_path):
    rows, machine = made(1, 400, 7_200), states.Positions(capital=20.0)
    got, upto = streamed(spark, tmp_path, rows, lambda s: states.position_states(s, machine))
    want = Counter((a, c, *e) for (a, c), events in passed(spark, rows, ("address", "coin"), machine, upto).items() for e in events)
    assert Counter((r.address, r.coin, r.id, r.us, r.event, r.before_units, r.after_units, r.amount) for r in got) == want
    assert {r.event for r in got} == {"open", "add", "reduce", "close", "liquidation", "deposit", "withdraw", "transfer", "margin_update", "leverage_change", "rescue"}


def test_alerts_in_micro_batches_equal_one_pass(spark, tmp_path):
    rows = made(2, 160, 5 * 86_400)
    for k, (build, keys, machine) in enumerate(((states.forward_alerts, ("address",), states.Forward(2, 14)), (states.silence_alerts, ("coin",), states.Silence(9_000)))):
        (tmp_path / str(k)).mkdir()
        got, upto = streamed(spark, tmp_path / str(k), rows, lambda s: build(s, machine))
        want = Counter((str(key[0]), *e) for key, events in passed(spark, rows, keys, machine, upto).items() for e in events)
        assert Counter((r.key, r.us, r.alert) for r in got) == want and len(want) > 2, build


def row(us, kind, side=1, price=10.0, amount=40.0, i=1):
    return {"id": i, "us": us, "kind": kind, "side": side, "price": price, "amount": amount}


def test_a_rescue_needs_a_loss_and_an_inflow():
    m = states.Positions(capital=20.0)
    kinds = lambda *rows: [e[2] for e in states.replay(m, rows)[1]]
    assert kinds(row(1, "fill"), row(2, "fill", 1, 4.0), row(3, "deposit")) == ["open", "add", "deposit", "rescue"]
    assert kinds(row(1, "fill"), row(2, "fill", 1, 9.0), row(3, "deposit")) == ["open", "add", "deposit"]
    assert kinds(row(1, "fill"), row(2, "fill", 1, 4.0), row(3, "deposit", amount=1.0)) == ["open", "add", "deposit"]
    assert kinds(row(1, "deposit"), row(2, "fill", 0), row(3, "fill", 1), row(4, "liquidation"), row(5, "withdraw")) == ["deposit", "open", "close", "withdraw"]
    assert kinds(row(1, "fill", 0), row(2, "liquidation", 0, 30.0)) == ["open", "liquidation"]


def test_flat_books_start_anew_and_are_dropped():
    m = states.Positions()
    s, _ = states.replay(m, [row(1, "fill"), row(2, "fill", 0, 4.0)], None, 40 * states.DAY)
    assert s == m.begin()
    s, _ = states.replay(m, [row(1, "fill")], None, 40 * states.DAY)
    assert s["units"] == 1


@pytest.mark.parametrize("n, alert", [(3, "dropped"), (2, "forward_validated")])
def test_forward_validation(n, alert):
    got = states.replay(states.Forward(30, 2), [row(k, "fill") for k in range(n)], None, 31 * states.DAY)[1]
    assert [e[1] for e in got] == [alert]


def test_live_flocks_count_windows(spark, tmp_path):
    rows = made(3, 60, 3_000)
    spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(str(tmp_path / "f"))
    stream = spark.readStream.schema(spark.createDataFrame([], ROWS).schema).parquet(str(tmp_path / "f"))
    got = live.drained(live.live_flocks(stream)).collect()
    assert got and all(r.addresses in (2, 3) for r in got)


def test_a_snapshot_frame_raises_nothing(spark):
    frames = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, isSnapshot boolean")
    assert [r.id for r in live.live_only(frames).orderBy("id").collect()] == [2, 3]


def test_a_hot_key_holds_few_rows_in_one_call_and_tells_the_same_silences():
    """a call a row and every row held made hot keys too slow."""
    import pandas as pd

    class Held:
        calls, rows = 0, []

        def appendList(self, rows):
            self.calls, self.rows = self.calls + 1, [*self.rows, *rows]

        def appendValue(self, row):
            self.appendList([row])

    class Value:
        def exists(self):
            return False

        def update(self, value):
            pass

    class Handle:
        def registerTimer(self, at):
            pass

    rng, machine = random.Random(9), states.Silence(60)
    us = sorted(rng.randrange(1000) * 3_600_000_000 + rng.randrange(600_000_000) for _ in range(20_000))
    frame = pd.DataFrame([(i, t, "fill", 1, 1.0, 4.0) for i, t in enumerate(us)], columns=["id", "us", "kind", "side", "price", "amount"]).sample(frac=1, random_state=1)
    ordered = states.Ordered(machine, lambda key, e: e)
    ordered.handle, ordered.state, ordered.held = Handle(), Value(), Held()
    list(ordered.handleInputRows(("X",), iter([frame[:7_000], frame[7_000:7_001], frame[7_001:]]), None))
    assert ordered.held.calls == 1 and len(ordered.held.rows) < 20_000
    whole, few = ([{"us": t} for t in us], [{"us": r[1]} for r in sorted(ordered.held.rows, key=lambda r: r[1])])
    for upto in (us[5_000], us[-1], us[-1] + 59_000_000, us[-1] + 10**9):
        told = [states.replay(machine, [r for r in rows if r["us"] < upto], None, upto)[1] for rows in (whole, few)]
        assert told[0] == told[1] and told[0]


@pytest.mark.parametrize("groups", [1, 5])
def test_dealt_keys_equal_one_pass(spark, tmp_path, groups):
    """Many keys in one state, with late rows and deadlines between rows, give what each key gives by itself."""
    rows = [(i, i % 23, *r[2:]) for i, r in enumerate(made(3, 400, 12 * 86_400))]
    machine = states.Forward(1, 1)
    name = lambda key, e: (str(key[0]), int(e[0]), e[1])
    got, upto = streamed(spark, tmp_path, rows, lambda s: states.run(s, ["address"], machine, name, states.ALERTS, groups=groups))
    want = Counter((str(key[0]), *e) for key, events in passed(spark, rows, ("address",), machine, upto).items() for e in events)
    assert Counter((r.key, r.us, r.alert) for r in got) == want
    assert {r.alert for r in got} == {"dropped", "forward_validated"}
