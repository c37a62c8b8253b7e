"""Cheapest split of many baskets over shops, one shipping fee for each shop used.

A basket's offers become one row of arrays (one shuffle by basket), and the search is array
functions on that row. It goes item by item. A label is a set of shops used, with each one's
subtotal up to its free-shipping threshold: of all ways to come to one label only the cheapest
lives, and a label goes if even the cheapest rest, with all fees gone that can still go, doesn't
come under the best answer known. That is exact, and takes as many assignments as there are as long as
few labels live.

Where more than ``LABELS`` live, a local search comes first, from the obvious answers (every item where it is cheapest,
or all from one shop): it moves one item, or empties one shop into the others, until nothing gains. Its
answer is a closer bound for a second search with more labels; beyond those it is the split.
Amounts are whole cents inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import money

#: Assignments up to which a search of all of them is small.
EXACT = 50_000
#: Labels that may live in the first search and in the second, and rounds of the local search.
LABELS, MORE_LABELS, ROUNDS = 1_000, 8_000, 100
PICK = "array<struct<offer_rank:int,shop:bigint,price:bigint,ship:bigint,free_over:bigint>>"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def gather(offers: DataFrame, shops: DataFrame) -> DataFrame:
    """(basket_id, items): items in order of item_pos, each with its offers in order of offer_rank. Offers of unknown shops are left out."""
    cents = lambda c: (F.col(c) * 100).cast("bigint")
    known = offers.join(shops.select(F.col("shop_key").alias("shop"), cents("ship").alias("ship"), cents("free_over").alias("free_over")), "shop")
    own = F.struct(F.col("offer_rank").cast("int").alias("offer_rank"), F.col("shop").cast("bigint").alias("shop"), cents("price").alias("price"), "ship", "free_over")
    items = known.groupBy("basket_id", "item_pos").agg(F.array_sort(F.collect_list(own)).cast(PICK).alias("offers"))
    return items.groupBy("basket_id").agg(F.array_sort(F.collect_list(F.struct("item_pos", "offers"))).alias("items"))


def gather_products(items: DataFrame, offers: DataFrame, shops: DataFrame, keep=None, empty: bool = False) -> DataFrame:
    """As ``gather``, from items (basket_id, item_pos, product_key) and offers (product_key, offer_rank, shop, price): offers are gathered once for each product, and join as one array.

    ``keep`` makes that array smaller before baskets get it: ``useful`` or ``first``. ``empty`` keeps baskets without any offer, with no items.
    """
    cents = lambda c: (F.col(c) * 100).cast("bigint")
    known = offers.join(shops.select(F.col("shop_key").alias("shop"), cents("ship").alias("ship"), cents("free_over").alias("free_over")), "shop")
    own = F.struct(F.col("offer_rank").cast("int").alias("offer_rank"), F.col("shop").cast("bigint").alias("shop"), cents("price").alias("price"), "ship", "free_over")
    products = known.groupBy("product_key").agg(F.array_sort(F.collect_list(own)).cast(PICK).alias("offers"))
    products = products.withColumn("offers", keep(F.col("offers"))) if keep else products
    rows = items.join(products, "product_key", "left" if empty else "inner")
    return rows.groupBy("basket_id").agg(F.array_sort(F.collect_list(F.when(F.col("offers").isNotNull(), F.struct("item_pos", "offers")))).alias("items"))


def useful(offers: Column) -> Column:
    """An item's offers without those that no cheapest split has, whatever else is in the basket.

    Another offer in an offer's place costs at most its own price and fee, and gives back at least the offer's price less its shop's
    fee, which the shop's other items may then have to pay. Offers for which that is a gain go. The cheapest one, and
    the cheapest with its own fee, stay.
    """
    fee = lambda o: F.abs(F.coalesce(o["ship"], _zero()))
    return _let(F.array_min(F.transform(offers, lambda o: o["price"] + fee(o))), lambda least: F.filter(offers, lambda o: F.coalesce(o["price"] - fee(o) <= least, F.lit(True))))


def first(offers: Column) -> Column:
    """The cheapest of an item's offers alone."""
    return F.array(_first(offers)).cast(PICK)


def assignments(items: Column) -> Column:
    """Number of assignments; at most 10 ** 12, so that it can't overflow."""
    return F.aggregate(items, F.lit(1).cast("bigint"), lambda a, x: F.least(F.lit(10**12).cast("bigint"), a * F.size(x["offers"])))


def _first(offers: Column) -> Column:
    """The cheapest offer; of equal prices the first."""
    return F.array_min(F.transform(offers, lambda o: F.struct(o["price"].alias("p"), o["offer_rank"].alias("r"), o.alias("o"))))["o"]


def _cheapest(items: Column) -> Column:
    """Every item where it is cheapest."""
    return F.transform(items, lambda x: _first(x["offers"])).cast(PICK)


def _obvious(items: Column) -> Column:
    """Every item where it is cheapest, and all from each shop that has them all."""
    own = F.transform(items, lambda x: F.transform(x["offers"], lambda o: o["shop"]))
    full = F.aggregate(own, F.array_distinct(F.get(own, F.lit(0))), lambda a, shops: F.array_intersect(a, shops))
    single = F.transform(full, lambda s: F.transform(items, lambda x: _first(F.filter(x["offers"], lambda o: o["shop"] == s))).cast(PICK))
    return F.concat(F.array(_cheapest(items)), single)


def _fee(subtotal: Column, ship: Column, free_over: Column) -> Column:
    return F.when(free_over.isNotNull() & (subtotal >= free_over), F.lit(0).cast("bigint")).otherwise(F.coalesce(ship, F.lit(0).cast("bigint")))


def cost(picks: Column) -> Column:
    """Prices and one fee for each shop used, in cents."""
    first = F.filter(picks, lambda o, i: ~F.exists(F.slice(picks, F.lit(1), i), lambda p: p["shop"] == o["shop"]))
    fees = F.transform(first, lambda o: _fee(_sum(F.transform(F.filter(picks, lambda p: p["shop"] == o["shop"]), lambda p: p["price"])), o["ship"], o["free_over"]))
    return _sum(F.transform(picks, lambda o: o["price"])) + _sum(fees)


def method(items: Column, exact: int = EXACT) -> Column:
    """exact for at most so many assignments, else large."""
    return F.when(assignments(items) <= exact, "exact").otherwise("large")


def methods(items: DataFrame, counts: DataFrame, exact: int = EXACT) -> DataFrame:
    """(basket_id, method, items) as ``method`` tells it, of items (basket_id, product_key) and the number ``n`` of each product's offers; products without any are left out."""
    # a product of doubles is exact far beyond the bound, and never falls
    rows = items.join(counts.filter("n > 0"), "product_key").groupBy("basket_id").agg(F.product(F.col("n").cast("double")).alias("_all"), F.count("*").alias("items"))
    return rows.select("basket_id", F.when(F.col("_all") <= exact, "exact").otherwise("large").alias("method"), "items")


def _zero() -> Column:
    return F.lit(0).cast("bigint")


LABEL = "array<struct<shop:bigint,sub:bigint,may:bigint>>"


def _labels(items: Column, bound: Column, limit: int) -> Column:
    """(cost, picks) of the cheapest assignment of at most ``bound``, the first in order of items and offers; null if more than ``limit`` labels lived. picks are places of offers.

    A label's shops come with the subtotal up to the threshold (0 where there is none) and the fee that may still go.
    """
    least = F.transform(items, lambda x: F.array_min(F.transform(x["offers"], lambda o: o["price"])))
    # offers so dear that even the cheapest rest doesn't come under the bound go at once
    near = lambda x, over: F.filter(F.transform(x["offers"], lambda o, j: F.struct(o.alias("o"), j.alias("j"))), lambda e: e["o"]["price"] + over <= bound)
    step = lambda x, i, ls: _let(_sum(ls) - F.get(ls, i), lambda over: F.struct(near(x, over).alias("near"), _sum(F.slice(ls, i + 2, F.size(ls))).alias("rest")))
    steps = _let(least, lambda ls: F.transform(items, lambda x, i: step(x, i, ls)))
    start = F.array(F.struct(F.array().cast(LABEL).alias("key"), _zero().alias("cost"), F.array().cast("array<int>").alias("picks")))

    def next_label(s: Column, e: Column) -> Column:
        o = e["o"]
        have = F.get(F.filter(s["key"], lambda k: k["shop"] == o["shop"]), F.lit(0))
        ship, free = F.coalesce(o["ship"], _zero()), o["free_over"]
        sub = F.when(free.isNull(), _zero()).otherwise(F.least(free, F.coalesce(have["sub"], _zero()) + o["price"]))
        fee = lambda v: F.when(free.isNotNull() & (v >= free), _zero()).otherwise(ship)
        paid = F.when(have.isNull(), _zero()).otherwise(fee(have["sub"]))
        may = lambda v: F.when(free.isNotNull() & (v < free), ship).otherwise(_zero())
        return F.struct(s.alias("s"), e["j"].alias("j"), o["shop"].alias("shop"), sub.alias("sub"), may(sub).alias("may"), (s["cost"] + o["price"] + fee(sub) - paid).alias("cost"))

    def grown(n: Column) -> Column:
        others = F.filter(n["s"]["key"], lambda k: k["shop"] != n["shop"])
        own = F.struct(n["shop"].alias("shop"), n["sub"].alias("sub"), n["may"].alias("may"))
        return F.struct(F.array_sort(F.concat(others, F.array(own))).alias("key"), n["cost"].alias("cost"), F.concat(n["s"]["picks"], F.array(n["j"])).alias("picks"))

    def add(acc: Column, x: Column) -> Column:
        more = F.flatten(F.transform(acc, lambda s: F.transform(x["near"], lambda e: next_label(s, e))))
        may = lambda n: _sum(F.transform(n["s"]["key"], lambda k: k["may"])) + n["may"]
        close = F.filter(more, lambda n: n["cost"] - may(n) + x["rest"] <= bound)
        alive = F.filter(F.transform(close, grown), lambda s: s["cost"] - _sum(F.transform(s["key"], lambda k: k["may"])) + x["rest"] <= bound)
        # sorted by label, then cost and picks: the first of each label lives
        best = _let(F.array_sort(alive), lambda t: F.filter(t, lambda s, i: (i == 0) | (F.get(t, i - 1)["key"] != s["key"])))
        return F.when(F.size(acc) <= limit, best)

    def run(near_: Column) -> Column:
        # where one offer for each item is near enough, they are the answer
        alone = F.transform(near_, lambda x: F.get(x["near"], F.lit(0)))
        single = _let(alone, lambda es: F.struct(cost(F.transform(es, lambda e: e["o"]).cast(PICK)).alias("cost"), F.transform(es, lambda e: e["j"]).alias("picks")))
        several = _let(F.aggregate(near_, start, add), lambda t: F.when(F.size(t) <= limit, F.array_min(F.transform(t, lambda s: F.struct(s["cost"].alias("cost"), s["picks"].alias("picks"))))))
        return F.when(F.forall(near_, lambda x: F.size(x["near"]) == 1), single).otherwise(several)

    return _let(steps, run)


def _solved(items: Column, bound: Column, limit: int) -> Column:
    """``_labels`` with the bound evaluated once."""
    return _let(bound, lambda b: _labels(items, b, limit))


def _charge(picks: Column, o: Column) -> Column:
    """The fee of o's shop, 0 if no pick is from there."""
    own = F.filter(picks, lambda p: p["shop"] == o["shop"])
    return F.when(F.size(own) == 0, _zero()).otherwise(_fee(_sum(F.transform(own, lambda p: p["price"])), o["ship"], o["free_over"]))


def _improved(items: Column, starts: Column) -> Column:
    """(cost, picks) of the best answer that the local search comes to from any of the starts."""
    moves = F.flatten(F.transform(items, lambda x, i: F.transform(x["offers"], lambda o: F.struct(i.alias("i"), o.alias("o")))))
    state = lambda picks, cost_: F.struct(picks.cast(PICK).alias("picks"), cost_.alias("cost"))

    def move(s: Column, m: Column) -> Column:
        old, new = F.get(s["picks"], m["i"]), m["o"]
        moved = F.transform(s["picks"], lambda p, i: F.when(i == m["i"], new).otherwise(p))
        both = lambda picks: _charge(picks, old) + F.when(old["shop"] == new["shop"], _zero()).otherwise(_charge(picks, new))
        after = _let(moved, lambda picks: state(picks, s["cost"] - old["price"] + new["price"] - both(s["picks"]) + both(picks)))
        return _let(after, lambda a: F.when(a["cost"] < s["cost"], a).otherwise(s))

    def empty(used: Column):
        def drop(s: Column, shop: Column) -> Column:
            other = lambda i: F.array_min(F.transform(F.filter(F.get(items, i)["offers"], lambda o: (o["shop"] != shop) & F.array_contains(used, o["shop"])), lambda o: F.struct(o["price"].alias("p"), o["offer_rank"].alias("r"), o.alias("o"))))["o"]
            moved = F.transform(s["picks"], lambda p, i: F.when(p["shop"] == shop, other(i)).otherwise(p))
            return _let(moved, lambda t: F.when(F.exists(t, lambda o: o.isNull()), s).otherwise(_let(cost(t), lambda c: F.when(c < s["cost"], state(t, c)).otherwise(s))))

        return drop

    def round_(s: Column, _: Column) -> Column:
        def emptied(a: Column) -> Column:
            return _let(F.array_distinct(F.transform(a["picks"], lambda p: p["shop"])), lambda used: F.aggregate(used, a, empty(used)))

        after = lambda: _let(F.aggregate(moves, s["s"], move), emptied)
        return F.when(s["done"], s).otherwise(_let(after(), lambda a: F.struct(a.alias("s"), (a["cost"] >= s["s"]["cost"]).alias("done"))))

    def settled(picks: Column) -> Column:
        begin = F.struct(state(picks, cost(picks)).alias("s"), F.lit(False).alias("done"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, round_)["s"]

    ends = F.transform(starts, settled)
    return F.array_min(F.transform(ends, lambda s, i: F.struct(s["cost"].alias("cost"), i.alias("i"), s["picks"].alias("picks"))))


def _best(items: Column, labels: int, more: int) -> Column:
    """(method, cost, picks) of a basket."""
    chosen = lambda found: F.struct(F.lit("exact").alias("method"), found["cost"].alias("cost"), F.zip_with(items, found["picks"], lambda x, j: F.get(x["offers"], j)).cast(PICK).alias("picks"))
    known = lambda found: F.when(found.isNotNull(), chosen(found))
    second = lambda near: F.coalesce(_let(_solved(items, near["cost"], more), known), F.struct(F.lit("local").alias("method"), near["cost"].alias("cost"), near["picks"].alias("picks")))
    return _let(_obvious(items), lambda starts: F.coalesce(_let(_solved(items, F.array_min(F.transform(starts, cost)), labels), known), _let(_improved(items, starts), second)))


def split(baskets: DataFrame, labels: int = LABELS, more: int = MORE_LABELS) -> DataFrame:
    """(basket_id, method, total, picks) of ``gather``'s rows.

    method is exact, or local where too many labels lived for the exact search. Of equal exact
    totals the first assignment in order of items and offers wins.
    """
    out = baskets.withColumn("_best", _best(F.col("items"), labels, more))
    return out.select("basket_id", F.col("_best.method").alias("method"), (F.col("_best.cost") / 100).cast(money.MONEY).alias("total"), F.col("_best.picks").alias("picks"))


def cheapest(baskets: DataFrame) -> DataFrame:
    """(basket_id, total, picks) of ``gather``'s rows: every item where it is cheapest, of equal prices the first offer, with a fee for each shop used."""
    out = baskets.withColumn("picks", _cheapest(F.col("items")))
    return out.select("basket_id", (_let(F.col("picks"), cost) / 100).cast(money.MONEY).alias("total"), "picks")


def orders(solved: DataFrame) -> DataFrame:
    """Per basket and shop: place, items (their positions among the basket's available ones, from 0), subtotal, shipping and what is missing to free shipping.

    place 1 is the order of the largest subtotal; of equal ones the smaller shop is first.
    """
    rows = solved.select("basket_id", F.posexplode("picks").alias("item", "o")).select("basket_id", "item", "o.*")
    out = rows.groupBy("basket_id", "shop").agg(F.array_sort(F.collect_list("item")).alias("items"), F.sum("price").alias("_sub"), F.first("ship").alias("_ship"), F.first("free_over").alias("_free"))
    cents = lambda c: (c / 100).cast(money.MONEY)
    place = F.row_number().over(Window.partitionBy("basket_id").orderBy(F.desc("_sub"), "shop"))
    return out.select("basket_id", "shop", place.alias("place"), "items", cents(F.col("_sub")).alias("subtotal"), cents(_fee(F.col("_sub"), F.col("_ship"), F.col("_free"))).alias("shipping"), cents(money.to_free_shipping(F.col("_sub"), F.col("_ship"), F.col("_free"))).alias("to_free_shipping"))


def separately(offers: DataFrame, shops: DataFrame) -> DataFrame:
    """(basket_id, separately): every item at its best landed cost of its own."""
    rows = offers.join(shops.select(F.col("shop_key").alias("shop"), "ship", "free_over"), "shop")
    landed = F.col("price") + money.order_shipping(F.col("price"), F.col("ship"), F.col("free_over"))
    return rows.groupBy("basket_id", "item_pos").agg(F.min(landed).alias("landed")).groupBy("basket_id").agg(F.sum("landed").alias("separately"))


def single_shop(offers: DataFrame, shops: DataFrame) -> DataFrame:
    """(basket_id, shop, total): the cheapest shop that has every item of the basket that any shop has."""
    n = offers.groupBy("basket_id").agg(F.count_distinct("item_pos").alias("_n"))
    own = offers.groupBy("basket_id", "shop", "item_pos").agg(F.min_by("price", "offer_rank").alias("price")).groupBy("basket_id", "shop").agg(F.sum("price").alias("sub"), F.count("*").alias("_has"))
    full = own.join(n, "basket_id").filter("_has = _n").join(shops.select(F.col("shop_key").alias("shop"), "ship", "free_over"), "shop")
    total = F.col("sub") + money.order_shipping(F.col("sub"), F.col("ship"), F.col("free_over"))
    return full.withColumn("total", total).groupBy("basket_id").agg(F.min(F.struct("total", "shop")).alias("b")).select("basket_id", "b.shop", "b.total")


def single_shop_products(items: DataFrame, offers: DataFrame, shops: DataFrame) -> DataFrame:
    """As ``single_shop``, from items (basket_id, product_key) and offers (product_key, offer_rank, shop, price), those of unknown shops left out.

    A product's shops are 64 bits, each shop one by its hash; what the bits of a basket's products have in common tells
    which offers can matter, and only those become rows. Whether a shop has every item is then counted.
    """
    rules = shops.select(F.col("shop_key").alias("shop"), "ship", "free_over")
    known = offers.join(rules.select("shop"), "shop", "left_semi").groupBy("product_key", "shop").agg(F.min_by("price", "offer_rank").alias("price"))
    bit = lambda shop: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(shop), F.lit(64)).cast("int"))
    bits = known.groupBy("product_key").agg(F.bit_or(bit(F.col("shop"))).alias("_bits"))
    rows = items.select("basket_id", "product_key")
    able = rows.join(bits, "product_key").groupBy("basket_id").agg(F.bit_and("_bits").alias("_bits"), F.count("*").alias("_n")).filter("_bits <> 0")
    products = known.groupBy("product_key").agg(F.collect_list(F.struct("shop", "price")).alias("_offers"))
    near = rows.join(able, "basket_id").join(products, "product_key").select("basket_id", "_n", F.explode(F.filter("_offers", lambda o: bit(o["shop"]).bitwiseAND(F.col("_bits")) != 0)).alias("o"))
    own = near.groupBy("basket_id", F.col("o.shop").alias("shop")).agg(F.sum("o.price").alias("sub"), F.count("*").alias("_has"), F.first("_n").alias("_n"))
    full = own.filter("_has = _n").join(rules, "shop")
    total = F.col("sub") + money.order_shipping(F.col("sub"), F.col("ship"), F.col("free_over"))
    return full.withColumn("total", total).groupBy("basket_id").agg(F.min(F.struct("total", "shop")).alias("b")).select("basket_id", "b.shop", "b.total")


def unavailable(items: DataFrame, offers: DataFrame) -> DataFrame:
    """Items that no shop has."""
    return items.join(offers.select("basket_id", "item_pos").distinct(), ["basket_id", "item_pos"], "left_anti")


def summary(baskets: DataFrame) -> DataFrame:
    """(basket_id, method, total, separately, saving) of ``gather``'s rows, those without items too, with zeros. One pass: what the items cost apart is told by the same offers."""
    items, has = F.col("items"), F.size("items") > 0
    alone = F.transform(items, lambda x: F.array_min(F.transform(x["offers"], lambda o: o["price"] + _fee(o["price"], o["ship"], o["free_over"]))))
    rows = baskets.select("basket_id", F.when(has, _best(items, LABELS, MORE_LABELS)).alias("_best"), F.when(has, _sum(alone)).alias("_apart"))
    amount = lambda c: (F.coalesce(c, _zero()) / 100).cast(money.MONEY)
    total, apart = amount(F.col("_best.cost")), amount(F.col("_apart"))
    return rows.select("basket_id", F.coalesce("_best.method", F.lit("empty")).alias("method"), total.alias("total"), apart.alias("separately"), (apart - total).cast(money.MONEY).alias("saving"))
