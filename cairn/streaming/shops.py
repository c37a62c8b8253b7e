"""Shops as a stream with state: the last good snapshot of each stands in on days that bring none.

A shop's snapshot of a day goes out as it comes. When event time, told by other shops' snapshots, has left a day behind
without a snapshot of a shop, or a later one of its own has come, its last one goes out again for that day, flagged stale.
Late snapshots go out for their own day, fresh beside what stood in, and replace the state only if none newer has come.
State is one snapshot for each shop.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OFFER = "product_key string, total_dkk decimal(18,2)"
OUT = f"shop_key string, day date, {OFFER}, stale boolean"
DAY_MS = 86_400_000
EPOCH = datetime.date(1970, 1, 1)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _row(shop: str, day: int, product: str, total, stale: bool) -> Row:
    return Row(shop_key=shop, day=EPOCH + datetime.timedelta(days=day), product_key=product, total_dkk=total, stale=stale)


class LastGood(StatefulProcessor):
    """State of one shop: its newest snapshot, that one's day, and the day up to which it has stood in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.offers = handle.getListState("offers", OFFER)
        self.days = handle.getValueState("days", "day int, done int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        found: dict[int, set[tuple]] = {}
        for r in rows:
            found.setdefault((r["day"] - EPOCH).days, set()).add((r["product_key"], r["total_dkk"]))
        for day, offers in sorted(found.items()):
            for product, total in sorted(offers, key=str):
                yield _row(key[0], day, product, total, False)
        newest, state = max(found), self.days.get()
        if state is None:
            state = min(found), min(found)
        kept = [(o[0], o[1]) for o in self.offers.get()] if newest >= state[0] else []
        day, done = state
        for closed in range(done + 1, newest):  # a newer snapshot closes the days before it
            if day < closed and closed - 1 in found:
                day, kept = closed - 1, sorted(found[closed - 1], key=str)
            if closed not in found:
                yield from self._stand_in(key, closed, kept)
        if newest >= state[0]:
            old = {(o[0], o[1]) for o in self.offers.get()} if newest == state[0] else set()
            self.offers.put([(p, t) for p, t in sorted(found[newest] | old, key=str)])
        self.days.update((max(newest, state[0]), max(newest, done)))
        self._wake(max(newest, done))

    def _stand_in(self, key, day: int, offers: list[tuple]) -> Iterator[Row]:
        for product, total in offers:
            yield _row(key[0], day, product, total, True)

    def _wake(self, done: int) -> None:
        """Once the day after ``done`` is over."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer((done + 2) * DAY_MS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        day, done = self.days.get()
        kept = [(o[0], o[1]) for o in self.offers.get()]
        while (done + 2) * DAY_MS <= timerValues.getCurrentWatermarkInMs():
            done += 1
            yield from self._stand_in(key, done, kept)
        self.days.update((day, done))
        self._wake(done)

    def close(self) -> None:
        pass


def with_stand_ins(snapshots: DataFrame, late: str = "0 days") -> DataFrame:
    """Streamed snapshots (shop_key, day, product_key, total_dkk) with stale rows for the days a shop is silent. Null shops and days are left out."""
    rows = snapshots.filter(F.col("shop_key").isNotNull() & F.col("day").isNotNull()).withColumn("at", F.col("day").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy("shop_key").transformWithState(LastGood(), OUT, "Append", "EventTime")
