"""Reasons to vet an address again, as they happen: live rows meet the stored envelope and the stored links, and a machine keeps the account's state.

Seven triggers: ``liquidation``, ``rescue`` (an inflow into an account under water), ``drawdown`` (beyond the stored worst one), ``leverage`` (above the
gate), ``link`` (a transfer with an address that no stored link names), ``crashed`` (seven days lost while thirty are still green), ``hold_drift``
(holding times leave the band on a side on which they had been within it). States that last (drawdown, leverage, crashed, drift) fire when they
begin. An account without open positions that has been still for ``idle_days`` starts anew.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapegrade.config import DEFAULT
from tapegrade.plans import links
from tapegrade.plans.dialect import Frames
from tapegrade.streaming.live import DEALT, drained
from tapegrade.streaming.states import DAY, feed, run
from tapegrade.views import VIEWS

HELD = "id long, us long, kind string, side int, price double, amount double, coin string, linked boolean, worst double, hold double"
TRIGGERS = "id long, address long, us long, trigger string, value double, bound double"
INFLOWS = ("deposit", "transfer", "margin_update")


@dataclass(frozen=True)
class Watch:
    """The account of one address over all its coins; one unit an action. ``recent`` closed positions make the holding time."""

    capital: float = 100.0
    inflow: float = DEFAULT.rescue_inflow
    upnl: float = DEFAULT.rescue_upnl
    envelope: float = DEFAULT.envelope
    gate: float = DEFAULT.leverage_max
    low_s: float = DEFAULT.hold_low_s
    high_s: float = DEFAULT.hold_high_s
    recent: int = 5
    idle_days: int = 30

    def begin(self) -> dict:
        return {"cash": self.capital, "peak": self.capital, "books": {}, "days": [], "holds": [], "on": [], "last": None}

    def step(self, s: dict, row: dict) -> list[tuple]:
        s["last"] = row["us"]
        found, kind = [], row["kind"]
        if kind in ("fill", "liquidation"):
            if kind == "liquidation":
                found.append(("liquidation", row["amount"], 0.0))
            self._trade(s, row)
        elif kind in INFLOWS:
            if kind == "transfer" and not row["linked"]:
                found.append(("link", row["amount"], 0.0))
            lost, equity = self._open(s), self._equity(s)
            if s["books"] and lost <= self.upnl * equity and row["amount"] >= self.inflow * equity:
                found.append(("rescue", lost, self.upnl * equity))
        if kind in ("deposit", "withdraw"):
            flow = row["amount"] if kind == "deposit" else -row["amount"]
            s["cash"] += flow
            s["peak"] = max(s["peak"] + flow, 0.0)
        found += self._lasting(s, row)
        return [(row["id"], row["us"], *f) for f in found]

    def _trade(self, s: dict, row: dict) -> None:
        units, cost, _, opened = s["books"].get(row["coin"], (0, 0.0, 0.0, row["us"]))
        d = -units if row["kind"] == "liquidation" else 1 if row["side"] == 1 else -1
        after, price = units + d, row["price"]
        if abs(after) > abs(units):
            cost = (abs(units) * cost + abs(d) * price) / abs(after)
        elif d:
            gain, day = -d * (price - cost), row["us"] // DAY
            s["cash"] += gain
            if s["days"] and s["days"][-1][0] == day:
                s["days"][-1][1] += gain
            else:
                s["days"] = [x for x in s["days"] if x[0] > day - 30] + [[day, gain]]
        if after:
            s["books"][row["coin"]] = [after, cost, price, opened]
        elif s["books"].pop(row["coin"], None):
            s["holds"] = [*s["holds"], (row["us"] - opened) / 1e6][-self.recent :]

    @staticmethod
    def _open(s: dict) -> float:
        return sum(units * (price - cost) for units, cost, price, _ in s["books"].values())

    def _equity(self, s: dict) -> float:
        return s["cash"] + self._open(s)

    def _lasting(self, s: dict, row: dict) -> list[tuple]:
        equity, day = self._equity(s), row["us"] // DAY
        s["peak"] = max(s["peak"], equity)
        fall = 1 - equity / s["peak"] if s["peak"] > 0 else 0.0
        gross = sum(abs(units) * price for units, _, price, _ in s["books"].values())
        lever = gross / equity if equity > 0 else float(gross > 0) * 1e9
        week, month = (sum(g for at, g in s["days"] if at > day - n) for n in (7, 30))
        held = median(s["holds"]) if len(s["holds"]) == self.recent else None
        drift = held is not None and (held > self.high_s >= row["hold"] or held < self.low_s <= row["hold"])
        states = {
            "drawdown": (fall > self.envelope * row["worst"], fall, self.envelope * row["worst"]), "leverage": (lever > self.gate, lever, self.gate),
            "crashed": (week < 0 < month, week, month), "hold_drift": (drift, held if drift else 0.0, row["hold"]),
        }
        new = [(name, float(value), float(bound)) for name, (holds, value, bound) in states.items() if holds and name not in s["on"]]
        s["on"] = [name for name, (holds, _, _) in states.items() if holds]
        return new

    def deadline(self, s: dict) -> int | None:
        return s["last"] + self.idle_days * DAY + 1 if s["last"] is not None and not s["books"] else None

    def expire(self, s: dict, us: int) -> tuple[list[tuple], bool]:
        return [], True


def watched(rows: DataFrame, envelope: DataFrame, known: DataFrame) -> DataFrame:
    """A feed with ``partner`` beside what is stored: (address, worst, hold) and links (src, dst) of either direction; both are read anew each micro-batch.

    An address without an envelope has the gate's drawdown and the middle of the band.
    """
    ends = known.select("src", "dst").unionByName(known.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    ends = ends.select(F.col("src").alias("address"), F.col("dst").alias("partner"), F.lit(True).alias("linked"))
    own = envelope.select("address", "worst", "hold")
    held = rows.join(own, "address", "left").join(ends, ["address", "partner"], "left")
    return held.withColumns({"linked": F.coalesce("linked", F.lit(False)), "worst": F.coalesce("worst", F.lit(DEFAULT.max_dd)), "hold": F.coalesce("hold", F.lit((DEFAULT.hold_low_s + DEFAULT.hold_high_s) / 2))})


def revet_alerts(stream: DataFrame, machine: Watch = Watch()) -> DataFrame:
    """Triggers of every address of a watched feed; addresses are dealt to groups, so that a call takes the rows of many."""
    return run(stream, ["address"], machine, lambda key, e: (int(e[0]), int(key[0]), int(e[1]), e[2], float(e[3]), float(e[4])), TRIGGERS, HELD, DEALT)


def stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Envelopes (worst drawdown, median hold in seconds) and links of the stored tables, written once: micro-batches read small tables instead of making them again."""
    t = Frames(spark, sf_dir, VIEWS | links.VIEWS).keep(("risk", "trip_stats", "link_edges"))
    envelope = t["risk"].join(t["trip_stats"], "address", "left").select("address", F.col("max_dd").alias("worst"), (F.col("median_hold") * 86400.0).alias("hold"))
    return envelope, t["link_edges"]


def stored_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored events as a live feed; the partner of a transfer is as far from the address as the event's number says."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(sf_dir)
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    rows = raw.select(F.col("event_id").alias("id"), F.col("user_id").alias("address"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("coin"), (k % 2).alias("side"), "value", k.alias("k"), (F.col("user_id") + k).alias("partner"))
    return feed(rows)


QUERIES = {"stream_revet": lambda spark, sf_dir: drained(revet_alerts(watched(stored_feed(spark, sf_dir), *stored(spark, sf_dir))), keyed=True)}
