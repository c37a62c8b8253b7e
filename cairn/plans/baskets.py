"""Queries on baskets. Orders are the baskets, their distinct parts the items; each item has all its offers in stock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import money
from cairn.operators import basket, offers
from cairn.plans.market import SQL, landed, num
from cairn.registry import query
from cairn.sources import tables

#: Assignments up to which a search of all of them is small.
EXACT = basket.EXACT

BASKET_SQL = """, item AS (SELECT basket_id, product_key, row_number() OVER (PARTITION BY basket_id ORDER BY product_key) AS item_pos FROM (SELECT DISTINCT l_orderkey AS basket_id, l_partkey AS product_key FROM lineitem)),
top AS (SELECT product_key, shop_key AS shop, amount_dkk AS price, row_number() OVER (PARTITION BY product_key ORDER BY total_dkk, s1, s2, s3, s4) AS offer_rank FROM dedup WHERE in_stock),
rule AS (SELECT shop_key AS shop, CASE WHEN verified THEN CAST(ship * factor AS DECIMAL(18,2)) ELSE coalesce(assumed, 120) END AS ship, CASE WHEN verified THEN CAST(free_over * factor AS DECIMAL(18,2)) END AS free_over FROM shop),
bo AS (SELECT basket_id, item_pos, offer_rank, shop, price, ship, free_over FROM item JOIN top USING (product_key) JOIN rule USING (shop))"""
FEE = "CASE WHEN {1} IS NOT NULL AND {0} >= {1} THEN 0 ELSE coalesce({2}, 0) END"


def items(spark: SparkSession, d: str) -> DataFrame:
    # dealt out by basket once: distinct items and their places need no other shuffle
    pairs = tables.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("basket_id"), F.col("l_partkey").alias("product_key")).repartition("basket_id").distinct()
    return pairs.withColumn("item_pos", F.row_number().over(Window.partitionBy("basket_id").orderBy("product_key")))


def product_offers(spark: SparkSession, d: str) -> DataFrame:
    """Every product's offers in stock, in order of landed total: one shuffle, by product, of what is in stock. A shop's best offer is in stock if any of its offers is."""
    rows = landed(spark, d).filter("in_stock").repartition("product_key")
    return offers.ranked(offers.one_per_shop(rows)).select("product_key", F.col("rank").alias("offer_rank"), F.col("shop_key").alias("shop"), F.col("amount_dkk").alias("price"))


def basket_offers(spark: SparkSession, d: str) -> DataFrame:
    return items(spark, d).join(product_offers(spark, d), "product_key").select("basket_id", "item_pos", "offer_rank", "shop", "price")


def baskets(spark: SparkSession, d: str, keep=basket.useful, empty: bool = False) -> DataFrame:
    return basket.gather_products(items(spark, d), product_offers(spark, d), rules(spark, d), keep, empty)


def offer_counts(spark: SparkSession, d: str) -> DataFrame:
    """(product_key, n): shops that have each product in stock."""
    pairs = tables.offers(spark, d).filter("in_stock").select("product_key", "shop_key").join(rules(spark, d).select("shop_key"), "shop_key", "left_semi")
    return pairs.repartition("product_key").distinct().groupBy("product_key").agg(F.count("*").alias("n"))


def rules(spark: SparkSession, d: str) -> DataFrame:
    """Shipping of each shop in base currency: published, else assumed for its country."""
    s = tables.shops(spark, d).join(tables.rates(spark), "currency").join(tables.assumed_shipping(spark, d), "country", "left")
    own = lambda c: money.convert(F.col(c), F.col("factor"))
    return s.select("shop_key", F.when(F.col("verified"), own("ship")).otherwise(F.coalesce("assumed", F.lit(money.ASSUMED_DEFAULT))).cast(money.MONEY).alias("ship"), F.when(F.col("verified"), own("free_over")).alias("free_over"))


def solved(spark: SparkSession, d: str) -> DataFrame:
    return basket.split(baskets(spark, d))


@query(SQL + BASKET_SQL + f", l AS (SELECT basket_id, item_pos, min(price + {FEE.format('price', 'free_over', 'ship')}) AS landed FROM bo GROUP BY ALL) SELECT basket_id, CAST(sum(landed) AS DOUBLE) AS separately FROM l GROUP BY basket_id")
def basket_separately(spark: SparkSession, d: str) -> DataFrame:
    return num(basket.separately(basket_offers(spark, d), rules(spark, d)), "separately")


@query(SQL + BASKET_SQL + f""", n AS (SELECT basket_id, count(DISTINCT item_pos) AS n FROM bo GROUP BY basket_id), s AS (SELECT basket_id, shop, ship, free_over, sum(price) AS sub, count(*) AS has FROM bo GROUP BY ALL),
f AS (SELECT basket_id, shop, sub + {FEE.format('sub', 'free_over', 'ship')} AS total FROM s JOIN n USING (basket_id) WHERE has = n)
SELECT basket_id, shop, CAST(total AS DOUBLE) AS total FROM f QUALIFY row_number() OVER (PARTITION BY basket_id ORDER BY total, shop) = 1""")
def basket_single_shop(spark: SparkSession, d: str) -> DataFrame:
    return num(basket.single_shop_products(items(spark, d), product_offers(spark, d), rules(spark, d)), "total")


# item by item, without what can't come under the cost of taking every item where it is cheapest
EXACT_SQL = BASKET_SQL + f""", c AS (SELECT basket_id, item_pos, min(price) AS least, arg_min({{'shop': shop, 'ship': ship, 'free_over': free_over}}, (price, offer_rank)) AS f FROM bo GROUP BY ALL),
n AS (SELECT basket_id, count(*) AS items FROM c GROUP BY basket_id),
plain AS (SELECT basket_id, f.shop AS shop, f.ship AS ship, f.free_over AS free_over, sum(least) AS s FROM c GROUP BY ALL),
bound AS (SELECT basket_id, sum(s + {FEE.format('s', 'free_over', 'ship')}) AS bound FROM plain GROUP BY basket_id),
r AS (SELECT basket_id, item_pos, coalesce(sum(least) OVER (PARTITION BY basket_id ORDER BY item_pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS rest FROM c),
o AS (SELECT basket_id, dense_rank() OVER (PARTITION BY basket_id ORDER BY item_pos) AS k, items, rest, bound, offer_rank, shop, price, ship, free_over FROM bo JOIN n USING (basket_id) JOIN r USING (basket_id, item_pos) JOIN bound USING (basket_id)),
st AS (
  SELECT basket_id, k, items, CAST(price AS DECIMAL(38,2)) AS spent, [offer_rank] AS ranks, [shop] AS shops, [price] AS prices, [ship] AS ships, [free_over] AS frees FROM o WHERE k = 1 AND price + rest <= bound
  UNION ALL
  SELECT o.basket_id, o.k, o.items, CAST(spent + o.price AS DECIMAL(38,2)), list_append(ranks, o.offer_rank), list_append(shops, o.shop), list_append(prices, o.price), list_append(ships, o.ship), list_append(frees, o.free_over)
  FROM st JOIN o ON o.basket_id = st.basket_id AND o.k = st.k + 1 WHERE spent + o.price + rest <= bound),
full_ AS (SELECT *, row_number() OVER () AS id FROM st WHERE k = items),
flat AS (SELECT basket_id, id, ranks, unnest(range(0, items)) AS item, unnest(shops) AS shop, unnest(prices) AS price, unnest(ships) AS ship, unnest(frees) AS free_over FROM full_),
sub AS (SELECT basket_id, id, ranks, shop, ship, free_over, sum(price) AS s FROM flat GROUP BY ALL),
tot AS (SELECT basket_id, id, ranks, sum(s + {FEE.format('s', 'free_over', 'ship')}) AS total FROM sub GROUP BY ALL),
pick AS (SELECT basket_id, id, total FROM tot QUALIFY row_number() OVER (PARTITION BY basket_id ORDER BY total, ranks) = 1)"""
RECURSIVE = SQL.replace("WITH shop", "WITH RECURSIVE shop")


@query(RECURSIVE + EXACT_SQL + " SELECT basket_id, CAST(total AS DOUBLE) AS total FROM pick")
def basket_exact(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the baskets that are solved exactly: all of them here, whatever the number of assignments."""
    return num(solved(spark, d).filter("method = 'exact'").select("basket_id", "total"), "total")


@query(RECURSIVE + EXACT_SQL + f""", l AS (SELECT basket_id, item_pos, min(price + {FEE.format('price', 'free_over', 'ship')}) AS landed FROM bo GROUP BY ALL), a AS (SELECT basket_id, sum(landed) AS apart FROM l GROUP BY basket_id)
SELECT basket_id, CASE WHEN total IS NULL THEN 'empty' ELSE 'exact' END AS method, CAST(coalesce(total, 0) AS DOUBLE) AS total, CAST(coalesce(apart, 0) AS DOUBLE) AS separately, CAST(coalesce(apart, 0) - coalesce(total, 0) AS DOUBLE) AS saving
FROM (SELECT DISTINCT basket_id FROM item) LEFT JOIN pick USING (basket_id) LEFT JOIN a USING (basket_id)""")
def basket_split(spark: SparkSession, d: str) -> DataFrame:
    """Every basket's method, total, total bought separately and saving."""
    return num(basket.summary(baskets(spark, d, empty=True)), "total", "separately", "saving")


ORDER_COLUMNS = f"basket_id, shop, row_number() OVER (PARTITION BY basket_id ORDER BY sub DESC, shop) AS place, items, CAST(sub AS DOUBLE) AS subtotal, CAST({FEE.format('sub', 'free_over', 'ship')} AS DOUBLE) AS shipping, CAST(CASE WHEN ship > 0 AND sub < free_over THEN free_over - sub END AS DOUBLE) AS to_free_shipping"


def order_rows(solved_: DataFrame) -> DataFrame:
    rows = basket.orders(solved_)
    return num(rows.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ",")).withColumn("place", F.col("place").cast("long")), "subtotal", "shipping", "to_free_shipping")


@query(RECURSIVE + EXACT_SQL + f""", s2 AS (SELECT basket_id, shop, ship, free_over, string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) AS items, sum(price) AS sub FROM flat JOIN pick USING (basket_id, id) GROUP BY basket_id, shop, ship, free_over)
SELECT {ORDER_COLUMNS} FROM s2""")
def basket_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders by shop of every basket's split."""
    return order_rows(solved(spark, d))


@query(SQL + BASKET_SQL + " SELECT basket_id, product_key FROM item WHERE NOT EXISTS (SELECT 1 FROM bo WHERE bo.basket_id = item.basket_id AND bo.item_pos = item.item_pos)")
def basket_unavailable(spark: SparkSession, d: str) -> DataFrame:
    return basket.unavailable(items(spark, d), basket_offers(spark, d)).select("basket_id", "product_key")


@query(SQL + BASKET_SQL + f", c AS (SELECT basket_id, item_pos, count(*) AS n FROM bo GROUP BY ALL) SELECT basket_id, CASE WHEN round(product(n)) <= {EXACT} THEN 'exact' ELSE 'large' END AS method, count(*) AS items FROM c GROUP BY basket_id")
def basket_method(spark: SparkSession, d: str) -> DataFrame:
    """Which baskets have few assignments enough to try all."""
    return basket.methods(items(spark, d), offer_counts(spark, d), EXACT)


@query(SQL + BASKET_SQL + f""", c AS (SELECT basket_id, item_pos, arg_min({{'shop': shop, 'price': price, 'ship': ship, 'free_over': free_over}}, (price, offer_rank)) AS f FROM bo GROUP BY ALL),
n AS (SELECT basket_id, row_number() OVER (PARTITION BY basket_id ORDER BY item_pos) - 1 AS item, f.shop AS shop, f.price AS price, f.ship AS ship, f.free_over AS free_over FROM c),
s AS (SELECT basket_id, shop, ship, free_over, string_agg(CAST(item AS VARCHAR), ',' ORDER BY item) AS items, sum(price) AS sub FROM n GROUP BY ALL)
SELECT {ORDER_COLUMNS} FROM s""")
def basket_cheapest_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders by shop if every item is bought where it is cheapest."""
    return order_rows(basket.cheapest(baskets(spark, d, basket.first)))


@query(SQL + BASKET_SQL + " SELECT basket_id, product_key FROM item WHERE NOT EXISTS (SELECT 1 FROM bo WHERE bo.basket_id = item.basket_id AND bo.item_pos = item.item_pos AND shop % 4 = 0)")
def basket_unavailable_nearby(spark: SparkSession, d: str) -> DataFrame:
    """Items that none of a quarter of the shops has in stock."""
    return basket.unavailable(items(spark, d), basket_offers(spark, d).filter("shop % 4 = 0")).select("basket_id", "product_key")
