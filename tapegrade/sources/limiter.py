"""Request weights, priority lanes and paging for the venue's rate limit; plain driver-side classes."""

from __future__ import annotations

import heapq
import itertools
import time
from collections.abc import Callable, Iterator

#: Share of the budget that each lane may use up; the monitor always keeps its own.
LANES = {"monitor": 0, "incremental": 1, "deep": 2, "backfill": 3}


def weight(base: int = 20, rows: int = 0, rows_per_point: int = 20) -> int:
    """Weight of a call that returns ``rows`` items."""
    return base + -(-rows // rows_per_point)


class TokenBucket:
    """At most ``per_minute`` weight in any minute, the highest lane first; a 429 pauses all lanes."""

    def __init__(self, per_minute: int = 1_080, clock: Callable[[], float] = time.monotonic):
        self.per_minute, self.clock = per_minute, clock
        self.spent: list[tuple[float, int]] = []
        self.waiting: list[tuple[int, int, int, object]] = []
        self.order, self.pause_until, self.backoff = itertools.count(), 0.0, 0.0

    def used(self) -> int:
        now = self.clock()
        self.spent = [(t, w) for t, w in self.spent if t > now - 60]
        return sum(w for _, w in self.spent)

    def submit(self, call: object, cost: int, lane: str) -> None:
        if cost > self.per_minute:
            raise ValueError("a call may not weigh more than a minute's budget")
        heapq.heappush(self.waiting, (LANES[lane], next(self.order), cost, call))

    def ready(self) -> Iterator[object]:
        """Calls that may go now, in order of lane and age."""
        while self.waiting and self.clock() >= self.pause_until and self.used() + self.waiting[0][2] <= self.per_minute:
            _, _, cost, call = heapq.heappop(self.waiting)
            self.spent.append((self.clock(), cost))
            yield call

    def rejected(self) -> None:
        """A 429 came: pause for 5 seconds, twice as long after each further one, up to 5 minutes."""
        self.backoff = min(300.0, self.backoff * 2 or 5.0)
        self.pause_until = self.clock() + self.backoff

    def accepted(self) -> None:
        self.backoff = 0.0


def pages(fetch: Callable[[int], list[dict]], start: int, full: int = 2_000, cap: int = 10_000) -> tuple[list[dict], bool]:
    """All records from ``start`` on, and whether the venue's cap cut them off.

    The next page starts at the last record's time, not one later, so that records which share the last
    millisecond of a full page are not lost; (time, tid) drops what comes twice.
    """
    seen: dict[tuple, dict] = {}
    while True:
        got = fetch(start)
        before = len(seen)
        for r in got:
            seen.setdefault((r["time"], r["tid"]), r)
        if len(seen) >= cap:
            return list(seen.values()), True
        if len(got) < full or len(seen) == before:
            return list(seen.values()), False
        start = got[-1]["time"]
