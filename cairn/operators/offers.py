"""Offers to products: landed cost, one offer per shop, ranking, market statistics.

Ties always go to the earlier offer: every order ends in ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import money, text
from cairn.sources.staging import staged

#: Shops that must have a product in stock before it has a market price.
MARKET_SHOPS = 3


def land_cost(offers: DataFrame, shops: DataFrame, rates: DataFrame, assumed: DataFrame) -> DataFrame:
    """Adds factor, amount_dkk, shipping_dkk, shipping_verified and total_dkk.

    Offers without a convertible currency keep nulls (see ``convertible``). The joins
    carry no hints: shops, rates and assumptions are broadcast while they are small.
    """
    priced = offers.join(shops, "shop_key", "left").join(rates, "currency", "left").join(assumed, "country", "left")
    priced = priced.withColumn("amount_dkk", money.convert(F.col("amount"), F.col("factor")))
    shipping = money.offer_shipping(F.col("amount"), F.col("factor"), F.col("verified"), F.col("ship"), F.col("free_over"), F.col("assumed"))
    priced = priced.withColumn("shipping_dkk", shipping).withColumn("shipping_verified", F.coalesce("verified", F.lit(False)) & F.col("ship").isNotNull())
    return priced.withColumn("total_dkk", money.landed(F.col("amount_dkk"), F.col("shipping_dkk"))).drop("ship", "free_over", "verified", "assumed")


def convertible(offers: DataFrame) -> DataFrame:
    return offers.filter(F.col("amount_dkk").isNotNull())


def order() -> list[Column]:
    """In stock first, then the smallest landed total, unpriced last, then the earlier."""
    return [F.desc("in_stock"), F.asc_nulls_last("total_dkk"), F.asc("seq")]


def one_per_shop(offers: DataFrame) -> DataFrame:
    w = Window.partitionBy("product_key", "shop_key").orderBy(*order())
    return offers.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def ranked(offers: DataFrame, keys: tuple[str, ...] = ("product_key",)) -> DataFrame:
    """Adds rank within a product, and best: the first, if it is in stock."""
    out = offers.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order())))
    return out.withColumn("best", (F.col("rank") == 1) & F.col("in_stock"))


def statistics(offers: DataFrame) -> DataFrame:
    """One row per product of deduplicated offers: counts, cheapest by landed cost and by item, dearest, range and market price.

    One aggregation with partial sums on the map side; cheapest and dearest are structs of the offer.
    """
    own = F.struct("shop_key", "country", "in_stock", "amount_dkk", "shipping_dkk", "total_dkk")
    stock, total = F.col("in_stock"), F.col("total_dkk")
    priced = F.when(total.isNotNull(), own)
    out = offers.groupBy("product_key").agg(
        F.count("*").alias("n_offers"), F.count_distinct("shop_key").alias("shop_count"), F.count_if(stock).alias("n_in_stock"), F.count_distinct(F.when(stock, F.col("shop_key"))).alias("shops_in_stock"),
        F.min_by(priced, F.when(total.isNotNull(), F.struct(~stock, total, "seq"))).alias("cheapest"), F.min_by(own, F.when(stock, F.struct("amount_dkk", "seq"))).alias("cheapest_item"),
        F.min_by(own, F.when(stock, F.struct(-total, F.col("seq")))).alias("dearest"), F.min(F.when(stock, total)).alias("lo"), F.max(F.when(stock, total)).alias("hi"),
        money.median(total, stock).alias("_median"),
    )
    market = F.when(F.col("n_in_stock") >= MARKET_SHOPS, F.col("_median"))
    out = out.withColumn("market", market).drop("_median")
    gap = (100 * (F.col("market") - F.col("cheapest.total_dkk"))).cast("double")
    return out.withColumn("discount_pct", F.round(gap / F.col("market").cast("double"), 1)).withColumn("spread", F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")))


def deals(stats: DataFrame, least: float = 5.0) -> DataFrame:
    """Products far enough under their market price, the best first."""
    return stats.filter(F.col("discount_pct") >= least).orderBy(F.desc("discount_pct"), F.desc(F.col("market") - F.col("cheapest.total_dkk")), "product_key")


def savings(stats: DataFrame) -> DataFrame:
    return stats.filter(F.col("spread").isNotNull() & (F.col("shops_in_stock") >= 2)).orderBy(F.desc("spread"), "product_key")


def price_strip(offers: DataFrame, stats: DataFrame) -> DataFrame:
    """Per in-stock offer of products with a market price: its place and the market's, in % from lowest to highest."""
    s = stats.filter(F.col("market").isNotNull() & (F.col("hi") > F.col("lo"))).select("product_key", "lo", "hi", "market")
    place = lambda v: F.round((100 * (v - F.col("lo"))).cast("double") / (F.col("hi") - F.col("lo")).cast("double"), 1)
    rows = offers.filter("in_stock").join(s, "product_key")
    return rows.withColumn("tick", place(F.col("total_dkk"))).withColumn("market_pos", place(F.col("market")))


#: Parts of one in which values are counted before those of the middle are looked at one by one.
SCALES = (100, 1_000_000)


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, median) of the values that aren't null, exact, without any key's values in one place.

    Counts by hundredths tell in which of them the middle lies, counts by millionths in that one narrow it, and its
    distinct values are then counted themselves. Each step adds up before it shuffles; a key has a row for each part.
    """
    rows = staged(rows.filter(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("_v")))  # read once for each step
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    middle = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    want, by = n.select(key, "n", F.explode(middle).alias("_rank")), [key]
    for name, part in [*((f"_{s}", F.floor(F.col("_v") * s)) for s in SCALES), ("_exact", F.col("_v"))]:
        inside = rows.join(want.select(*by).distinct(), by) if len(by) > 1 else rows
        counts = inside.withColumn(name, part).groupBy(*by, name).agg(F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        at = F.col("_rank") - F.col("_before")
        want = want.join(counts.withColumn("_before", before), by).filter((at >= 0) & (at < F.col("_n"))).select(*by, name, "n", at.alias("_rank"))
        rows, by = rows.withColumn(name, part), [*by, name]
    return want.groupBy(key).agg(F.max("n").alias("n"), (0.5 * F.min("_exact") + 0.5 * F.max("_exact")).alias("median"))


def scorecard(offers: DataFrame, stats: DataFrame) -> DataFrame:
    """Per shop: offers, in stock, contested (two shops or more in stock), wins, win_pct and the price index (median of total to market, three ratios at least)."""
    s = stats.select("product_key", F.col("cheapest.shop_key").alias("_winner"), F.col("cheapest.in_stock").alias("_stock"), "shops_in_stock", "market")
    contested = F.col("in_stock") & (F.col("shops_in_stock") >= 2)
    ratio = F.when(F.col("in_stock") & (F.col("market") > 0), F.col("total_dkk").cast("double") / F.col("market").cast("double"))
    won = F.col("_stock") & (F.col("_winner") == F.col("shop_key"))
    rows = staged(offers.join(s, "product_key").select("shop_key", "in_stock", contested.alias("_contested"), won.alias("_won"), ratio.alias("_ratio")))
    out = rows.groupBy("shop_key").agg(F.count("*").alias("offers"), F.count_if("in_stock").alias("in_stock"), F.count_if("_contested").alias("contested"), F.count_if(F.col("_contested") & F.col("_won")).alias("wins"))
    index = medians(rows, "shop_key", "_ratio").filter("n >= 3").select("shop_key", F.round(100 * F.col("median"), 0).cast("long").alias("price_index"))
    return out.withColumn("win_pct", F.when(F.col("contested") > 0, F.round(100 * F.col("wins") / F.col("contested"), 0).cast("long"))).join(index, "shop_key", "left")


def won_products(offers: DataFrame, stats: DataFrame, most: int = 40) -> DataFrame:
    """(shop_key, rank, product_key, discount_pct): each shop's best wins, no discount counting as 0."""
    wins = stats.filter(F.col("cheapest.in_stock") & (F.col("shops_in_stock") >= 2)).select(F.col("cheapest.shop_key").alias("shop_key"), "product_key", "discount_pct")
    w = Window.partitionBy("shop_key").orderBy(F.coalesce("discount_pct", F.lit(0.0)).desc(), "product_key")
    return wins.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def set_rollup(stats: DataFrame, titles: DataFrame) -> DataFrame:
    """Per set: products, smallest item price of the cheapest offers, number of offers."""
    rows = titles.join(stats, "product_key")
    return rows.groupBy("set_name").agg(F.count("*").alias("products"), F.min("cheapest.amount_dkk").alias("cheapest"), F.sum("n_offers").alias("offer_count"), F.array_sort(F.collect_set("product_type")).alias("types"))


def set_overview(stats: DataFrame, titles: DataFrame) -> DataFrame:
    """Per set of titles (product_key, set_name, set_id, release_date): whether it is matched, its release date, products, smallest item price of the cheapest offers, number of offers."""
    rows = titles.select("product_key", "set_name", "set_id", "release_date").join(stats, "product_key")
    return rows.groupBy("set_name").agg(F.max("set_id").isNotNull().alias("matched"), F.max("release_date").alias("release_date"), F.count("*").alias("products"), F.min("cheapest.amount_dkk").alias("cheapest"), F.sum("n_offers").alias("offer_count"))


def cards(stats: DataFrame, titles: DataFrame, most: int = 6) -> DataFrame:
    """(set_name, product_key, total, place): each set's products with the best discounts, no discount counting as 0, then the cheapest."""
    rows = titles.select("product_key", "set_name").join(stats, "product_key").select("set_name", "product_key", "discount_pct", F.col("cheapest.total_dkk").alias("total"))
    w = Window.partitionBy("set_name").orderBy(F.coalesce("discount_pct", F.lit(0.0)).desc(), "total", "product_key")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def group_products(offers: DataFrame) -> DataFrame:
    """Keys of classified offers (set_id, set_name, product_type, language, seq, title columns): product_key and the naming offer's set_name.

    Offers of an unmatched set meet by the sorted words of its name; the first offer names the product.
    """
    raw = F.concat(F.lit("raw:"), F.array_join(F.array_sort(F.split(text.normalise(F.col("set_name")), " ")), " "))
    out = offers.withColumn("_group", F.coalesce(F.col("set_id"), raw))
    named = out.groupBy("_group", "product_type", "language").agg(F.min_by(F.struct("set_id", "set_name"), "seq").alias("_first"))
    named = named.withColumn("product_key", product_key(F.col("_first.set_id"), F.col("_first.set_name"), F.col("product_type"), F.col("language")))
    return out.drop("set_id", "set_name").join(named, ["_group", "product_type", "language"]).withColumn("set_id", F.col("_first.set_id")).withColumn("set_name", F.col("_first.set_name")).drop("_group", "_first")


def product_key(set_id: Column, set_name: Column, product_type: Column, language: Column) -> Column:
    """slug (48 letters at most), type, language and eight digits of a hash, joined by hyphens."""
    slug = text.slugify(set_name)
    base = F.concat_ws("|", F.coalesce(set_id, F.concat(F.lit("raw:"), slug)), product_type, language)
    return F.concat_ws("-", F.substring(slug, 1, 48), product_type, language, F.substring(F.sha1(base), 1, 8))


def fallback(fresh: DataFrame, last_good: DataFrame) -> DataFrame:
    """Fresh offers, and of shops without any the last good ones, flagged stale."""
    gone = last_good.join(fresh.select("shop_key").distinct(), "shop_key", "left_anti")
    return fresh.unionByName(gone.withColumn("stale", F.lit(True)))


def run_log(shops: DataFrame, fresh: DataFrame, last_good: DataFrame) -> DataFrame:
    """Per shop its status: ok with fresh rows, stale with rows of the last good run alone, else failed; and the rows that count."""
    n = lambda df, name: df.groupBy("shop_key").agg(F.count("*").alias(name))
    out = shops.join(n(fresh, "_fresh"), "shop_key", "left").join(n(last_good, "_last"), "shop_key", "left")
    status = F.when(F.col("_fresh") > 0, "ok").when(F.col("_last") > 0, "stale").otherwise("failed")
    return out.withColumn("status", status).withColumn("count", F.coalesce("_fresh", "_last", F.lit(0)).cast("long")).drop("_fresh", "_last")
