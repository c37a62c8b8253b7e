"""First offers of watched products by users' own shipping rates."""

import random
from decimal import Decimal

import pytest

from cairn.operators import users
from tests.measured import total

OFFERS = "product_key long, shop_key long, country string, in_stock boolean, amount_dkk decimal(18,2), shipping_dkk decimal(18,2), shipping_verified boolean, total_dkk decimal(18,2), seq struct<a:long>"


def tables(spark, products, each, watched, prices, seed=3):
    """Offers (shops of a country share an assumed rate, or have none), watched products with repeats, and rates of some users for some countries."""
    rng = random.Random(seed)
    assumed = {"A": 45, "B": 85, "C": None, "D": 0, None: None}
    offers = []
    for p in range(products):
        for s in rng.sample(range(each * 3), each):
            country, amount, verified = list(assumed)[s % 5], rng.choice([None, *[Decimal(rng.randrange(100, 100 + prices)) for _ in range(9)]]), rng.random() < 0.5
            ship = rng.choice([0, 30, 60]) if verified else assumed[country] if rng.random() < 0.9 else 70
            whole = None if amount is None else amount + (ship or 0)
            offers.append((p, s, country, rng.random() < 0.6, amount, None if ship is None else Decimal(ship), verified if verified or s % 2 else None, whole, (rng.randrange(10**9),)))
    watch = [(rng.randrange(watched // 6 + 1), rng.randrange(products + 2)) for _ in range(watched)]
    rates = [(u, c, Decimal(rng.randrange(0, 90))) for u in range(0, watched // 6 + 1, 2) for c in rng.sample("ABCDE", 2)]
    return spark.createDataFrame(offers, OFFERS), spark.createDataFrame(watch, "user_id long, product_key long"), spark.createDataFrame(rates, "user_id long, country string, amount decimal(18,2)")


@pytest.mark.parametrize("prices", [2, 40, 400])
def test_first_offers_are_those_of_rank_one(spark, prices):
    offers, watch, rates = tables(spark, 40, 9, 900, prices)
    names = ["user_id", "product_key", "shop_key", "country", "in_stock", "amount_dkk", "shipping_dkk", "total_dkk"]
    want = users.rerank(offers, watch, rates).filter("rank = 1").select(names)
    got = users.first_offers(offers, watch, rates).select(names)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 300


def test_several_rates_for_a_country(spark):
    offers, watch, rates = tables(spark, 20, 9, 200, 60)
    rates = rates.unionByName(rates.selectExpr("user_id", "country", "cast(amount - 20 as decimal(18,2)) AS amount"))
    names = ["user_id", "product_key", "shop_key", "total_dkk"]
    want = users.rerank(offers, watch, rates).filter("rank = 1").select(names)
    assert sorted(map(str, users.first_offers(offers, watch, rates).select(names).collect())) == sorted(map(str, want.collect()))


def test_few_offers_meet_users(spark, monkeypatch):
    """Bytes that the query's exchanges write, beside those of a ranking of all offers for each user."""
    from cairn.plans import users as plans

    offers, watch, rates = tables(spark, 60, 60, 3_000, 400)
    orders = watch.selectExpr("user_id AS o_custkey", "user_id * 100000 + product_key AS o_orderkey", "'1-URGENT' AS o_orderpriority").distinct()
    lines = orders.selectExpr("o_orderkey AS l_orderkey", "o_orderkey % 100000 AS l_partkey")
    nation = spark.createDataFrame([("AA",), ("B",), ("CCC",)], "n_name string")
    monkeypatch.setattr(plans.tables, "table", lambda _, d, name: {"orders": orders, "lineitem": lines, "nation": nation}[name])
    for name in ("landed", "deduped"):
        monkeypatch.setattr(plans, name, lambda *_: offers, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        whole = total(users.rerank(offers, watch, rates).filter("rank = 1").select("user_id", "product_key", "shop_key", "total_dkk"), "Exchange", "shuffleBytesWritten")
        assert total(plans.rerank_overrides(spark, ""), "Exchange", "shuffleBytesWritten") < whole / 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
