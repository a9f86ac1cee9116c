"""Keyed state over live actions: position events with live rescues, forward validation, silence alerts.

Rows of a key are held until the watermark has passed them and are then taken in the order of (time, id), so late rows, and rows that come in
another micro-batch than their neighbours, change nothing: what is emitted equals a batch pass over the rows that the watermark has passed.
One event-time timer a key stands at its earliest held row or deadline. Keys whose state says nothing any more are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapegrade.session import ship
from tapegrade.streaming.live import LATENESS, drained

HELD = "id long, us long, kind string, side int, price double, amount double"
EVENTS = "id long, address long, coin string, us long, event string, before_units long, after_units long, amount double"
ALERTS = "key string, us long, alert string"
#: What a live row may be: fills (the rest) and nine kinds of account actions, dealt by a number from 0 to 99.
KINDS = ((70, "fill"), (75, "deposit"), (80, "withdraw"), (85, "transfer"), (90, "margin_update"), (95, "leverage_change"), (100, "liquidation"))
DAY = 86_400_000_000


def feed(actions: DataFrame, k: str = "k") -> DataFrame:
    """Live rows from actions that carry ``k``: what they are, at what price, over what amount."""
    kind = F.lit(KINDS[-1][1])
    for upto, name in reversed(KINDS[:-1]):
        kind = F.when(F.col(k) < upto, name).otherwise(kind)
    more = [c for c in ("partner",) if c in actions.columns]
    return actions.select("id", "address", "ts", "coin", "side", F.unix_micros("ts").alias("us"), kind.alias("kind"), F.col("value").cast("double").alias("price"), (F.col("value") * 4).cast("double").alias("amount"), *more)


@dataclass(frozen=True)
class Positions:
    """Ten kinds of events of one address and coin, and rescues among them.

    A book starts with ``capital``. An inflow (deposit, transfer, margin update) of at least ``inflow`` of the equity into a book whose open result is at
    most ``upnl`` of it is a rescue. A book that is flat and still for ``idle_days`` starts anew.
    """

    capital: float = 100.0
    inflow: float = 0.15
    upnl: float = -0.25
    idle_days: int = 30

    def begin(self) -> dict:
        return {"units": 0, "cost": 0.0, "cash": self.capital, "price": 0.0, "last": None}

    def step(self, s: dict, row: dict) -> list[tuple]:
        if s["last"] is not None and s["units"] == 0 and row["us"] - s["last"] > self.idle_days * DAY:
            s.update(self.begin())
        s["last"] = row["us"]
        units, kind = s["units"], row["kind"]
        if kind in ("fill", "liquidation"):
            d = (1 if row["side"] == 1 else -1) if kind == "fill" else -units
            after, price = units + d, row["price"]
            if abs(after) > abs(units):
                s["cost"] = (abs(units) * s["cost"] + abs(d) * price) / abs(after)
            else:
                s["cash"] += d * -1 * (price - s["cost"])
            s["units"], s["price"] = after, price
            event = kind if kind == "liquidation" else "open" if units == 0 else "close" if after == 0 else "add" if abs(after) > abs(units) else "reduce"
            return [(row["id"], row["us"], event, units, after, price)] if d or kind == "fill" else []
        out = [(row["id"], row["us"], kind, units, units, row["amount"])]
        if kind in ("deposit", "transfer", "margin_update"):
            open_ = units * (s["price"] - s["cost"])
            equity = s["cash"] + open_
            if units and open_ <= self.upnl * equity and row["amount"] >= self.inflow * equity:
                out.append((row["id"], row["us"], "rescue", units, units, row["amount"]))
        if kind in ("deposit", "withdraw"):
            s["cash"] += row["amount"] if kind == "deposit" else -row["amount"]
        return out

    def deadline(self, s: dict) -> int | None:
        return s["last"] + self.idle_days * DAY + 1 if s["units"] == 0 and s["last"] is not None else None

    def expire(self, s: dict, us: int) -> tuple[list[tuple], bool]:
        return [], True


@dataclass(frozen=True)
class Forward:
    """Whether an address stays within its pace for so many days from its first action on: ``dropped`` at the action that exceeds it, else ``forward_validated``."""

    days: int = 30
    most_a_day: int = 20

    def begin(self) -> dict:
        return {"start": None, "day": None, "n": 0, "done": False}

    def step(self, s: dict, row: dict) -> list[tuple]:
        if s["done"]:
            return []
        s["start"] = row["us"] if s["start"] is None else s["start"]
        day = row["us"] // DAY
        s["n"] = s["n"] + 1 if day == s["day"] else 1
        s["day"] = day
        if s["n"] <= self.most_a_day:
            return []
        s["done"] = True
        return [(row["us"], "dropped")]

    def deadline(self, s: dict) -> int | None:
        return None if s["done"] or s["start"] is None else s["start"] + self.days * DAY

    def expire(self, s: dict, us: int) -> tuple[list[tuple], bool]:
        s["done"] = True
        return [(us, "forward_validated")], False


@dataclass(frozen=True)
class Silence:
    """An alert whenever a key has had no row for so many seconds."""

    seconds: int = 120

    def begin(self) -> dict:
        return {"last": None, "told": False}

    def step(self, s: dict, row: dict) -> list[tuple]:
        s.update(last=row["us"], told=False)
        return []

    def deadline(self, s: dict) -> int | None:
        return None if s["told"] or s["last"] is None else s["last"] + self.seconds * 1_000_000

    def expire(self, s: dict, us: int) -> tuple[list[tuple], bool]:
        s["told"] = True
        return [(us, "silence")], False

    def thin(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The first and the last row of each stretch of ``seconds``: rows between them are closer to both than any pause that is told."""
        by = rows.groupby(rows["us"] // (self.seconds * 1_000_000))["us"]
        return rows.loc[np.union1d(by.idxmin(), by.idxmax())]


def replay(machine, rows: Iterable[dict], state: dict | None = None, upto: int | None = None) -> tuple[dict | None, list[tuple]]:
    """State and events of ordered rows of one key, deadlines between them included, up to a time."""
    s, out = state or machine.begin(), []
    for row in [*rows, None]:
        at = row["us"] if row else upto
        while (due := machine.deadline(s)) is not None and at is not None and due < at:
            events, gone = machine.expire(s, due)
            out += events
            if gone:
                s = machine.begin()
        if row:
            out += machine.step(s, row)
    return s, out


class Ordered(StatefulProcessor):
    """Runs a machine over the rows of a key in order, behind the watermark. ``held`` are the columns that a row keeps while it waits, id and us first.

    The rows of a key are held by one call a micro-batch. A machine with ``thin`` names those that it needs to see, so a key of many rows holds few of them.
    """

    def __init__(self, machine, name, held=HELD):
        self.machine, self.name, self.schema = machine, name, held
        self.fields = [c.split()[0] for c in held.split(", ")]
        self.types = [{"long": int, "int": int, "double": float, "string": str, "boolean": bool}[c.split()[1]] for c in held.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "json string, timer long")
        self.held = handle.getListState("held", self.schema)

    def _timer(self, old: int | None, us: int | None) -> int | None:
        # the first whole millisecond by which ``us`` has passed
        at = None if us is None else us // 1000 + 1
        if at == old:
            return old
        if old is not None:
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)
        return at

    def _now(self) -> tuple[str | None, int | None]:
        found = self.state.get() if self.state.exists() else None
        return (found[0], found[1]) if found else (None, None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, timer = self._now()
        first, kept, thin = None, [], getattr(self.machine, "thin", None)
        for batch in rows:
            batch = batch[self.fields]
            if len(batch):
                first = min(int(batch["us"].min()), first) if first is not None else int(batch["us"].min())
            kept = [thin(pd.concat([*kept, batch], ignore_index=True))] if thin else [*kept, batch]
        new = [tuple(cast(v) for cast, v in zip(self.types, r)) for batch in kept for r in batch.itertuples(index=False)]
        if new:
            self.held.appendList(new)
        if first is not None and (timer is None or first // 1000 + 1 < timer):
            timer = self._timer(timer, first)
        self.state.update((state, timer))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        state, _ = self._now()
        held = sorted(self.held.get(), key=lambda r: (r[1], r[0])) if self.held.exists() else []
        ready, later = [r for r in held if r[1] < upto], [r for r in held if r[1] >= upto]
        s, events = replay(self.machine, [dict(zip(self.fields, r)) for r in ready], json.loads(state) if state else None, upto)
        due = min([x for x in (self.machine.deadline(s), later[0][1] if later else None) if x is not None], default=None)
        if later:
            self.held.put([tuple(r) for r in later])
        elif held:
            self.held.clear()
        if s == self.machine.begin() and not later:
            self.state.clear()
        else:
            # the timer that fired is gone
            self.state.update((json.dumps(s), self._timer(None, due)))
        yield pd.DataFrame([self.name(key, e) for e in events]) if events else pd.DataFrame()

    def close(self) -> None:
        pass


class Dealt(Ordered):
    """Runs a machine over many keys that are dealt to one group: the group's states and held rows are read and written once a call, and its timer stands at the earliest of its keys'.

    Rows wait as columns, one piece a call, as to write each by itself takes longer than all else. ``keys`` (name and type) stand in them behind ``held``.
    """

    def __init__(self, machine, name, held, keys: str):
        super().__init__(machine, name, f"{held}, {keys}")
        self.width = len(keys.split(", "))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "json string, timer long")
        self.held = handle.getListState("held", "columns string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, timer = self._now()
        batches = [b[self.fields] for b in rows if len(b)]
        if batches:
            batch = pd.concat(batches, ignore_index=True)
            first = int(batch["us"].min())
            self.held.appendList([(json.dumps([batch[c].astype(cast).tolist() for c, cast in zip(self.fields, self.types)]),)])
            if timer is None or first // 1000 + 1 < timer:
                timer = self._timer(timer, first)
        self.state.update((state, timer))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        found, _ = self._now()
        states = {tuple(k): s for k, s in json.loads(found)} if found else {}
        ready, later, out, due = {}, [], [], None
        pieces = list(self.held.get()) if self.held.exists() else []
        for r in (r for (piece,) in pieces for r in zip(*json.loads(piece))):
            later.append(r) if r[1] >= upto else ready.setdefault(r[-self.width :], []).append(r)
        for k in ready.keys() | states.keys():
            s = states.get(k)
            at = self.machine.deadline(s) if s else None
            if k in ready or (at is not None and at < upto):
                rows = sorted(ready.get(k, ()), key=lambda r: (r[1], r[0]))
                s, events = replay(self.machine, [dict(zip(self.fields, r)) for r in rows], s, upto)
                out += [self.name(k, e) for e in events]
                at = self.machine.deadline(s)
                states[k] = s
            due = at if due is None or (at is not None and at < due) else due
        # a key that says nothing any more begins anew, whether rows of it wait or not
        states = {k: s for k, s in states.items() if s != self.machine.begin()}
        first = min((r[1] for r in later), default=None)
        due = first if due is None or (first is not None and first < due) else due
        if later:
            self.held.put([(json.dumps(list(zip(*later))),)])
        elif ready:
            self.held.clear()
        if states or later:
            # the timer that fired is gone
            self.state.update((json.dumps(list(states.items())), self._timer(None, due)))
        else:
            self.state.clear()
        yield pd.DataFrame(out) if out else pd.DataFrame()


def run(stream: DataFrame, keys: list[str], machine, name, schema: str, held: str = HELD, groups: int | None = None) -> DataFrame:
    """A machine over each key of a stream; ``name`` makes the output row of a key and an event. With ``groups``, keys are dealt to so many, each one state."""
    ship(stream.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = ", ".join(f"{k} {stream.schema[k].dataType.simpleString().replace('bigint', 'long')}" for k in keys)

    class Named(Dealt if groups else Ordered):
        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            for df in super().handleExpiredTimer(key, timerValues, expiredTimerInfo):
                if len(df):
                    df.columns = names
                    yield df

    marked = stream.withWatermark("ts", LATENESS)
    if groups:
        dealt = marked.withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(groups)))
        return dealt.groupBy("_group").transformWithStateInPandas(Named(machine, name, held, kinds), schema, "append", "eventTime")
    return marked.groupBy(*keys).transformWithStateInPandas(Named(machine, name, held), schema, "append", "eventTime")


def position_states(stream: DataFrame, machine: Positions = Positions()) -> DataFrame:
    """Events of every address and coin of a live feed."""
    return run(stream, ["address", "coin"], machine, lambda key, e: (int(e[0]), int(key[0]), key[1], int(e[1]), e[2], int(e[3]), int(e[4]), float(e[5])), EVENTS)


def forward_alerts(stream: DataFrame, machine: Forward = Forward()) -> DataFrame:
    return run(stream, ["address"], machine, lambda key, e: (str(key[0]), int(e[0]), e[1]), ALERTS)


def silence_alerts(stream: DataFrame, machine: Silence = Silence()) -> DataFrame:
    return run(stream, ["coin"], machine, lambda key, e: (str(key[0]), int(e[0]), e[1]), ALERTS)


def stored_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored events as a live feed."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return feed(raw.select(F.col("event_id").alias("id"), F.col("user_id").alias("address"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("coin"), (k % 2).alias("side"), "value", k.alias("k")))


QUERIES = {
    "stream_states": lambda spark, sf_dir: drained(position_states(stored_feed(spark, sf_dir)), keyed=True),
    "stream_forward": lambda spark, sf_dir: drained(forward_alerts(stored_feed(spark, sf_dir), Forward(7, 2)), keyed=True),
    "stream_silence": lambda spark, sf_dir: drained(silence_alerts(stored_feed(spark, sf_dir), Silence(3_600)), keyed=True),
}
#: Rows that the last watermark has passed, and the pauses after them.
ORACLES = {
    "stream_silence": """
        SELECT key, us + 3600000000 AS us, 'silence' AS alert FROM (
          SELECT e.event_type AS key, epoch_us(e.ts) AS us, lead(epoch_us(e.ts)) OVER (PARTITION BY e.event_type ORDER BY e.ts) AS after, m.upto FROM events e CROSS JOIN (SELECT (epoch_us(max(ts)) - 600000000) // 1000 * 1000 AS upto FROM events) m WHERE epoch_us(e.ts) < m.upto) g
        WHERE us + 3600000000 < coalesce(after, upto)""",
}
