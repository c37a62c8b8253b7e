"""Shops' stand-ins from a stream against days filled by hand."""

import datetime
import json
import os
from decimal import Decimal

import pytest

from cairn.streaming import shops

SCHEMA = "shop_key string, day date, product_key string, total_dkk decimal(18,2)"


def day(n):
    return datetime.date(2026, 9, n)


@pytest.fixture
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", shops.PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, folder, batches, late="0 days"):
    """Each batch is a file; the stream is stopped and started anew after half of them."""
    os.makedirs(folder / "in")
    for part in (batches[: len(batches) // 2], batches[len(batches) // 2 :]):
        for rows in part:
            n = len(os.listdir(folder / "in"))
            path = folder / "in" / f"{n:03d}.json"
            path.write_text("".join(json.dumps({"shop_key": s, "day": str(day(d)), "product_key": p, "total_dkk": t}) + "\n" for s, d, p, t in rows))
            os.utime(path, (1000 + n, 1000 + n))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder / "in"))
        out = shops.with_stand_ins(stream, late).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp"))
        out.trigger(availableNow=True).start().awaitTermination(200)
    return {tuple(r) for r in spark.read.parquet(str(folder / "out")).select("shop_key", "day", "product_key", "total_dkk", "stale").collect()}


def test_silent_days_are_filled(spark, tmp_path, store):
    batches = [[("a", 1, "p", 10), ("b", 1, "p", 12)], [("b", 2, "p", 11)], [("b", 3, "p", 11)], [("b", 4, "p", 11), ("a", 4, "q", 5), ("a", 4, "r", 6)], [("b", 5, "p", 11)], [("b", 8, "p", 13)], [(None, 8, "p", 1), ("b", 9, "p", 13)]]
    got = run(spark, tmp_path, batches)
    fresh = {(s, day(d), p, Decimal(t), False) for rows in batches for s, d, p, t in rows if s}
    stale = {("a", day(d), "p", Decimal(10), True) for d in (2, 3)} | {("a", day(d), p, Decimal(t), True) for d in (5, 6, 7, 8) for p, t in (("q", 5), ("r", 6))} | {("b", day(d), "p", Decimal(11), True) for d in (6, 7)}
    assert {r for r in got if not r[4]} == fresh
    # the last day is over only when a later one has come
    assert {r for r in got if r[4] and r[1] <= day(7)} == {r for r in stale if r[1] <= day(7)} and {r for r in got if r[4]} <= stale


def test_late_and_repeated_snapshots(spark, tmp_path, store):
    batches = [[("a", 1, "p", 10), ("b", 1, "x", 1)], [("b", 2, "x", 1)], [("b", 3, "x", 1)], [("a", 3, "p", 30)], [("a", 3, "p", 30)], [("a", 2, "p", 20)], [("b", 4, "x", 1)], [("b", 5, "x", 1)], [("b", 6, "x", 1)]]
    got = run(spark, tmp_path, batches, late="10 days")
    assert {r for r in got if r[0] == "a" and not r[4]} == {("a", day(d), "p", Decimal(10 * d), False) for d in (1, 2, 3)}
    assert {r for r in got if r[0] == "a" and r[4]} == {("a", day(2), "p", Decimal(10), True)}  # it stood in until the late one came
    assert all(not r[4] for r in got if r[0] == "b")
