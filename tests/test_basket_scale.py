"""What baskets shuffle, and that what is left out of it changes nothing."""

import random
from decimal import Decimal

import pytest

from cairn.operators import basket
from tests.measured import total

SHOPS = "shop_key long, ship decimal(18,2), free_over decimal(18,2)"
OFFERS = "product_key long, offer_rank int, shop long, price decimal(18,2)"


def tables(spark, n_baskets, n_products, n_shops, each, spread, seed=1, low=1, high=6):
    """Items, offers, shops: prices of a product lie within ``spread``, some offers are of a shop that nobody knows."""
    rng = random.Random(seed)
    money = lambda v: None if v is None else Decimal(v)
    shops = [(s, money(rng.choice([None, 0, 40, 60, 90])), money(rng.choice([None, 500, 900, 1500]))) for s in range(n_shops)]
    offers = [(p, i + 1, s, Decimal(rng.randrange(100, 100 + spread))) for p in range(n_products) for i, s in enumerate(rng.sample(range(n_shops + 1), each))]
    items = [(b, i + 1, p) for b in range(n_baskets) for i, p in enumerate(sorted(rng.sample(range(n_products + 2), rng.randrange(low, high))))]
    return spark.createDataFrame(items, "basket_id long, item_pos int, product_key long"), spark.createDataFrame(offers, OFFERS), spark.createDataFrame(shops, SHOPS)


@pytest.mark.parametrize("shops, each", [(6, 4), (200, 3), (3, 4)])
def test_single_shops_of_products(spark, shops, each):
    items, offers, rules = tables(spark, 120, 40, shops, each, 300)
    known = offers.join(rules, offers["shop"] == rules["shop_key"], "left_semi")
    want = basket.single_shop(items.join(known, "product_key"), rules)
    got = basket.single_shop_products(items, offers, rules)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count()


def test_single_shops_shuffle_few_offers(spark, monkeypatch):
    """Baskets of several products that no shop has together: offers hardly become rows by basket."""
    items, offers, rules = tables(spark, 300, 200, 400, 12, 300, low=3)
    from cairn.plans import baskets as plans

    monkeypatch.setattr(plans, "items", lambda *_: items)
    monkeypatch.setattr(plans, "product_offers", lambda *_: offers)
    monkeypatch.setattr(plans, "rules", lambda *_: rules)
    monkeypatch.setattr(plans, "basket_offers", lambda *_: items.join(offers, "product_key").select("basket_id", "item_pos", "offer_rank", "shop", "price"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = total(plans.basket_single_shop(spark, ""), "Exchange", "shuffleRecordsWritten")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows < items.join(offers, "product_key").count()


@pytest.mark.parametrize("spread", [1, 60, 250, 5_000])
def test_splits_of_useful_offers_are_the_same(spark, spread):
    items, offers, rules = tables(spark, 80, 30, 7, 5, spread, seed=spread)
    whole, few = (basket.gather_products(items, offers, rules, keep) for keep in (None, basket.useful))
    want, got = ({r["basket_id"]: r for r in basket.split(b).collect()} for b in (whole, few))
    assert got == want and {r["method"] for r in got.values()} == {"exact"}
    size = lambda b: sum(len(x["offers"]) for r in b.collect() for x in r["items"])
    assert size(few) < size(whole) if spread > 200 else size(few) <= size(whole)


def test_large_baskets_of_useful_offers_are_no_dearer(spark):
    items, offers, rules = tables(spark, 30, 60, 14, 8, 500, seed=11, low=8, high=20)
    whole, few = (basket.gather_products(items, offers, rules, keep) for keep in (None, basket.useful))
    want, got = ({r["basket_id"]: r for r in basket.split(b, labels=200, more=400).collect()} for b in (whole, few))
    for b, r in want.items():
        assert got[b]["total"] == r["total"] if (got[b]["method"], r["method"]) == ("exact", "exact") else got[b]["total"] <= r["total"] or r["method"] == "exact"
    count = lambda found: sum(r["method"] == "exact" for r in found.values())
    assert count(got) >= count(want)


def test_cheapest_orders_of_first_offers_are_the_same(spark):
    items, offers, rules = tables(spark, 80, 30, 7, 5, 20)
    whole, few = (basket.cheapest(basket.gather_products(items, offers, rules, keep)) for keep in (None, basket.first))
    assert sorted(map(str, whole.collect())) == sorted(map(str, few.collect()))


def test_summary_of_one_pass(spark):
    items, offers, rules = tables(spark, 80, 30, 7, 5, 250, low=1, high=3)
    known = items.join(offers, "product_key").select("basket_id", "item_pos", "offer_rank", "shop", "price")
    total_, apart = ({r["basket_id"]: r[1] for r in df.collect()} for df in (basket.split(basket.gather_products(items, offers, rules)).select("basket_id", "total"), basket.separately(known, rules)))
    got = {r["basket_id"]: r for r in basket.summary(basket.gather_products(items, offers, rules, basket.useful, empty=True)).collect()}
    assert set(got) == {r["basket_id"] for r in items.collect()} > set(total_)
    for b, r in got.items():
        want = (total_.get(b, 0), apart.get(b, 0))
        assert (r["total"], r["separately"], r["saving"], r["method"]) == (*want, want[1] - want[0], "exact" if b in total_ else "empty")


@pytest.mark.parametrize("exact", [1, 20, 100, 10**6])
def test_methods_by_counts(spark, exact):
    items, offers, rules = tables(spark, 80, 30, 7, 5, 250)
    known = offers.join(rules, offers["shop"] == rules["shop_key"], "left_semi")
    whole = basket.gather_products(items, offers, rules)
    want = {r[0]: r[1:] for r in whole.select("basket_id", basket.method(whole["items"], exact), "items").collect()}
    got = {r["basket_id"]: (r["method"], r["items"]) for r in basket.methods(items, known.groupBy("product_key").count().withColumnRenamed("count", "n"), exact).collect()}
    assert got == {b: (m, len(i)) for b, (m, i) in want.items()}


@pytest.mark.parametrize("name, least", [("basket_method", 3), ("basket_cheapest_orders", 2), ("basket_exact", 2), ("basket_split", 2), ("basket_orders", 2)])
def test_baskets_shuffle_little(spark, monkeypatch, name, least):
    """Bytes that exchanges write, beside those of a plan that gives each basket all its items' offers."""
    from cairn.plans import baskets as plans

    items, offers, rules = tables(spark, 300, 400, 60, 40, 100_000)
    monkeypatch.setattr(plans, "items", lambda *_: items)
    monkeypatch.setattr(plans, "product_offers", lambda *_: offers)
    monkeypatch.setattr(plans, "rules", lambda *_: rules)
    monkeypatch.setattr(plans, "basket_offers", lambda *_: items.join(offers, "product_key").select("basket_id", "item_pos", "offer_rank", "shop", "price"))
    monkeypatch.setattr(plans, "offer_counts", lambda *_: offers.groupBy("product_key").count().withColumnRenamed("count", "n"), raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        whole = total(basket.gather_products(items, offers, rules), "Exchange", "shuffleBytesWritten")
        assert total(getattr(plans, name)(spark, ""), "Exchange", "shuffleBytesWritten") < whole / least
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
