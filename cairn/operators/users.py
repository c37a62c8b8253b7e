"""Search over products, and what users watch and hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import money
from cairn.operators.offers import ranked
from cairn.sources.staging import staged

#: Sort modes of a product list: column, whether descending. Nulls come last, ties in the list's own order.
SORTS = {"set": ("set_order", False), "discount": ("discount_pct", True), "shops": ("shop_count", True), "price_asc": ("total", False), "price_desc": ("total", True)}


#: Names searched for as substrings up to which they are broadcast to the titles' places.
FEW_NAMES = 10_000


def search(index: DataFrame, text: str = "", product_type: str | None = None, country: str | None = None, in_stock: bool = False, watchlist: DataFrame | None = None, language: str | None = None) -> DataFrame:
    """Faceted search: a substring of title or set name in either case, type, language, country of any offer, stock, watched products."""
    out = index
    if text:
        out = out.filter(F.lower(F.concat_ws(" ", "title", "set_name")).contains(text.lower()))
    if product_type is not None:
        out = out.filter(F.col("product_type") == product_type)
    if language is not None:
        out = out.filter(F.col("language") == language)
    if country is not None:
        out = out.filter(F.array_contains("countries", country))
    if in_stock:
        out = out.filter("in_stock")
    return out if watchlist is None else out.join(watchlist.select("product_key").distinct(), "product_key", "left_semi")


def arrange(index: DataFrame, mode: str) -> DataFrame:
    column, down = SORTS[mode]
    return index.orderBy(F.desc_nulls_last(column) if down else F.asc_nulls_last(column), "set_order")


def places(index: DataFrame, mode: str) -> DataFrame:
    """The rows with their place in a sort mode, from 1: ranges of the order are numbered apart, and each begins where the ones before it end.

    The driver sees one row a range, to add up their sizes.
    """
    column, down = SORTS[mode]
    order = [F.desc_nulls_last(column) if down else F.asc_nulls_last(column), F.asc("set_order")]
    dealt = staged(index.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dict(sorted((r["_range"], r["count"]) for r in dealt.groupBy("_range").count().collect()))
    begins, at = [], 0
    for k, n in sizes.items():
        begins.append((k, at))
        at += n
    begin = dealt.sparkSession.createDataFrame(begins, "_range int, _begin long")
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(begin, "_range").withColumn("place", (F.col("_begin") + within).cast("long")).drop("_range", "_begin")


def find(index: DataFrame, names: DataFrame) -> DataFrame:
    """(name, product_key): the product whose title is the name in either case, else the first that contains it.

    Equal titles are one, with their first product. An equality join finds the exact titles; only names without one are searched
    for as substrings, at the places of a title where their first letters stand.
    """
    titles = index.groupBy(F.lower("title").alias("_title")).agg(F.min("product_key").alias("product_key"))
    wanted = names.select("name").distinct().withColumn("_name", F.lower("name"))
    exact = wanted.join(titles, F.col("_name") == F.col("_title")).groupBy("name").agg(F.min("product_key").alias("product_key"))
    rest = wanted.join(exact, "name", "left_anti")
    near = F.broadcast if wanted.limit(FEW_NAMES + 1).count() <= FEW_NAMES else lambda df: df
    places = titles.filter(F.length("_title") > 0).withColumn("_at", F.explode(F.sequence(F.lit(1), F.length("_title"))))

    def starting(n: int, size: Column) -> DataFrame:
        """Names of that size, each with the products of titles that have its first n letters and then the rest."""
        here = places.withColumn("_run", F.col("_title").substr(F.col("_at"), F.lit(n)))
        return here.join(near(rest.filter(size).withColumn("_run", F.substring("_name", 1, n))), "_run").filter(F.col("_title").contains(F.col("_name"))).select("name", "product_key")

    # names of one or two letters have no third
    found = starting(3, F.length("_name") >= 3).unionByName(starting(2, F.length("_name") == 2)).unionByName(starting(1, F.length("_name") == 1))
    return exact.unionByName(found.groupBy("name").agg(F.min("product_key").alias("product_key")))


def merge_holdings(rows: DataFrame) -> DataFrame:
    """Holdings (user_id, product_key, qty, cost, seq): adding an owned product raises its quantity; the first cost stays."""
    return rows.groupBy("user_id", "product_key").agg(F.sum("qty").alias("qty"), F.min_by("cost", "seq").alias("cost"))


def valuation(holdings: DataFrame, index: DataFrame) -> DataFrame:
    """Per user: products, cost, value (item price and its shipping, of products with a price), gain and gain in %.

    ``index`` has (product_key, price, ship); products that it lacks add to the cost alone.
    """
    rows = holdings.join(index.select("product_key", "price", "ship"), "product_key", "left")
    worth = money.money((F.col("price") + F.coalesce("ship", F.lit(0))) * F.col("qty"))
    out = rows.groupBy("user_id").agg(F.count("*").alias("products"), F.sum(money.money(F.col("cost") * F.col("qty"))).alias("cost"), F.coalesce(F.sum(worth), F.lit(0)).cast("decimal(28,2)").alias("value"))
    gain = F.col("value") - F.col("cost")
    return out.withColumn("gain", gain).withColumn("gain_pct", F.when(F.col("cost") > 0, F.round((100 * gain).cast("double") / F.col("cost").cast("double"), 1)))


def ship_for(verified: Column, published: Column, override: Column, assumed: Column) -> Column:
    """A published rate stands; else the user's own for the country, else the assumption, else the default."""
    return F.when(verified, published).otherwise(F.coalesce(override, assumed, F.lit(money.ASSUMED_DEFAULT))).cast(money.MONEY)


def rerank(offers: DataFrame, watched: DataFrame, overrides: DataFrame) -> DataFrame:
    """Offers of each user's watched products (user_id, product_key) with totals and ranks by the user's own shipping (user_id, country, amount)."""
    rows = offers.join(watched.select("user_id", "product_key").distinct(), "product_key").join(overrides.withColumnRenamed("amount", "_own"), ["user_id", "country"], "left")
    shipping = ship_for(F.col("shipping_verified"), F.col("shipping_dkk"), F.col("_own"), F.col("shipping_dkk"))
    rows = rows.withColumn("shipping_dkk", shipping).withColumn("total_dkk", money.landed(F.col("amount_dkk"), F.col("shipping_dkk"))).drop("_own")
    return ranked(rows, ("user_id", "product_key"))


def first_offers(offers: DataFrame, watched: DataFrame, overrides: DataFrame) -> DataFrame:
    """The offers of rank 1 by ``rerank``, with the user's own shipping and total: a row for each user and watched product that has offers.

    Before products meet their users, only offers that can come first for some user stay: of the best stock, of those with a published
    rate the first, and of each country's others the first by total and by price, for a user's own rate is the same for all of them.
    They go as one array to the user's rates. Offers that are dealt out by product already aren't shuffled again; what is watched is, by product and by user.
    """
    place = F.when(F.col("in_stock"), 0).when(~F.col("in_stock"), 1).otherwise(2)
    verified = F.coalesce("shipping_verified", F.lit(False))
    own = F.struct(place.alias("place"), "seq", "shop_key", "country", verified.alias("verified"), "amount_dkk", "shipping_dkk")
    no_own = F.lit(None).cast(money.MONEY)

    def judged(o: Column, rate: Column) -> Column:
        """An offer in front of which its order by a user's rate stands."""
        shipping = ship_for(o["verified"], o["shipping_dkk"], rate, o["shipping_dkk"])
        total = money.landed(o["amount_dkk"], shipping)
        return F.struct(o["place"].alias("place"), total.isNull().alias("unpriced"), total.alias("total_dkk"), o["seq"].alias("seq"), shipping.alias("shipping_dkk"), o.alias("o"))

    by_price = F.struct(F.col("_o.place"), F.col("_o.amount_dkk").isNull().alias("unpriced"), F.col("_o.amount_dkk"), F.col("_o.seq"), F.col("_o").alias("o"))
    rows = offers.select("product_key", verified.alias("_verified"), F.when(~verified, F.col("country")).alias("_country"), own.alias("_o"))
    near = rows.groupBy("product_key", "_verified", "_country").agg(F.min(judged(F.col("_o"), no_own))["o"].alias("_total"), F.min(by_price)["o"].alias("_price"))
    firsts = near.groupBy("product_key").agg(F.collect_list("_total").alias("_a"), F.collect_list(F.when(~F.col("_verified") & (F.col("_price") != F.col("_total")), F.col("_price"))).alias("_b"))
    both = firsts.select("product_key", F.concat("_a", "_b").alias("_all"))
    products = both.select("product_key", F.filter("_all", lambda o: o["place"] == F.array_min(F.transform("_all", lambda x: x["place"]))).alias("_offers"))
    seen = watched.select("user_id", "product_key").repartition("product_key").distinct().join(products, "product_key")
    rates = overrides.groupBy("user_id").agg(F.collect_list(F.struct("country", "amount")).alias("_rates"))
    # of several rates for one country the smallest comes first
    rate = lambda o: F.array_min(F.transform(F.filter("_rates", lambda r: r["country"] == o["country"]), lambda r: r["amount"]))
    best = F.array_min(F.transform("_offers", lambda o: judged(o, rate(o))))
    out = seen.join(rates, "user_id", "left").select("user_id", "product_key", best.alias("_best"))
    return out.select("user_id", "product_key", F.col("_best.o.shop_key").alias("shop_key"), F.col("_best.o.country").alias("country"), (F.col("_best.place") == 0).alias("in_stock"), F.col("_best.o.amount_dkk").alias("amount_dkk"), "_best.shipping_dkk", "_best.total_dkk")


def search_index(stats: DataFrame, offers: DataFrame, titles: DataFrame) -> DataFrame:
    """One row per product: title, set, type, item price and shipping of the cheapest offer, its shop and stock, countries of all offers."""
    countries = offers.groupBy("product_key").agg(F.array_sort(F.collect_set("country")).alias("countries"))
    c = "cheapest"
    rows = titles.join(stats, "product_key").join(countries, "product_key")
    order = F.row_number().over(Window.partitionBy("set_name").orderBy("product_type", "product_key"))
    return rows.select(
        "product_key", "title", "set_name", "product_type", F.col(f"{c}.amount_dkk").alias("price"), F.col(f"{c}.shipping_dkk").alias("ship"), F.col(f"{c}.total_dkk").alias("total"), F.col(f"{c}.shop_key").alias("shop"),
        F.coalesce(F.col(f"{c}.in_stock"), F.lit(False)).alias("in_stock"), "discount_pct", "shop_count", "countries", order.alias("place_in_set"), F.struct("set_name", order).alias("set_order"),
    )
