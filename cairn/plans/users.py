"""Queries on search, watchlists and holdings. Customers are the users; the parts they ordered are what they watch and hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import money
from cairn.operators import offers, text_index, users
from cairn.plans.market import SQL, deduped, landed, num
from cairn.registry import query
from cairn.sources import tables
from cairn.sources.staging import folder, staged

INDEX_SQL = """, countries AS (SELECT product_key, list_sort(list(DISTINCT country)) AS countries FROM dedup GROUP BY product_key),
idx AS (SELECT market.product_key, p_name || ' ' || p_type AS title, p_brand AS set_name, p_type AS product_type, best_amount AS price, best_shipping AS ship, best_total AS total, best_shop AS shop, best_in_stock AS in_stock, discount_pct, shop_count, countries,
        row_number() OVER (PARTITION BY p_brand ORDER BY p_type, p_partkey) AS place_in_set
 FROM market JOIN part ON p_partkey = market.product_key JOIN countries ON countries.product_key = market.product_key)"""


def index(spark: SparkSession, d: str) -> DataFrame:
    rows = deduped(spark, d)
    return users.search_index(offers.statistics(rows), rows, tables.titles(spark, d))


def watched(spark: SparkSession, d: str) -> DataFrame:
    o, li = tables.table(spark, d, "orders"), tables.table(spark, d, "lineitem")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("product_key"), F.col("l_quantity").cast("int").alias("qty"), F.col("l_extendedprice").cast(money.MONEY).alias("cost"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate").alias("seq"), F.col("l_returnflag").alias("flag"))


@query(SQL + INDEX_SQL + " SELECT product_key, title, set_name, product_type, CAST(price AS DOUBLE) AS price, CAST(ship AS DOUBLE) AS ship, shop, array_to_string(countries, ',') AS countries FROM idx")
def search_index(spark: SparkSession, d: str) -> DataFrame:
    return num(index(spark, d).select("product_key", "title", "set_name", "product_type", "price", "ship", "shop", F.array_join("countries", ",").alias("countries")), "price", "ship")


@query(SQL + INDEX_SQL + " SELECT product_key, title, CAST(total AS DOUBLE) AS total FROM idx WHERE lower(title || ' ' || set_name) LIKE '%ring%' AND in_stock AND list_contains(countries, (SELECT min(n_name) FROM nation)) AND product_key IN (SELECT l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority LIKE '1%')")
def faceted_search(spark: SparkSession, d: str) -> DataFrame:
    country = tables.table(spark, d, "nation").agg(F.min("n_name")).first()[0]
    urgent = tables.table(spark, d, "orders").filter(F.col("o_orderpriority").startswith("1"))
    watch = tables.table(spark, d, "lineitem").join(urgent, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(F.col("l_partkey").alias("product_key"))
    return num(users.search(index(spark, d), "ring", country=country, in_stock=True, watchlist=watch).select("product_key", "title", "total"), "total")


SORT_SQL = {"by_set": "set_name", "by_discount": "discount_pct DESC NULLS LAST, set_name", "by_shops": "shop_count DESC NULLS LAST, set_name", "by_price_asc": "total ASC NULLS LAST, set_name", "by_price_desc": "total DESC NULLS LAST, set_name"}


@query(SQL + INDEX_SQL + " SELECT product_key, " + ", ".join(f"row_number() OVER (ORDER BY {o}, place_in_set) AS {n}" for n, o in SORT_SQL.items()) + " FROM idx")
def sort_modes(spark: SparkSession, d: str) -> DataFrame:
    """Every product's place in each of the five sort modes."""
    rows = staged(index(spark, d).select("product_key", "set_order", *{c for c, _ in users.SORTS.values()} - {"set_order"}))
    out = rows.select("product_key")
    for mode in users.SORTS:
        out = out.join(users.places(rows, mode).select("product_key", F.col("place").alias(f"by_{mode}")), "product_key")
    return out


NAMES = ("Small Ring ECONOMY", "red widget", "bolt", "no such thing")


@query("WITH t AS (SELECT p_partkey AS product_key, lower(p_name || ' ' || p_type) AS title FROM part), n AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in NAMES) + "]) AS name) SELECT name, coalesce(min(product_key) FILTER (title = lower(name)), min(product_key)) AS product_key FROM n JOIN t ON contains(title, lower(name)) GROUP BY name")
def name_lookup(spark: SparkSession, d: str) -> DataFrame:
    return users.find(tables.titles(spark, d), spark.createDataFrame([(n,) for n in NAMES], "name string"))


@query(SQL + "SELECT product_key FROM stats WHERE product_key IN (SELECT l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'A')")
def watchlist_semi(spark: SparkSession, d: str) -> DataFrame:
    return index(spark, d).join(watched(spark, d).filter("flag = 'A'").select("product_key").distinct(), "product_key", "left_semi").select("product_key")


@query(SQL + "SELECT DISTINCT o_custkey AS user_id, l_partkey AS product_key FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_partkey NOT IN (SELECT product_key FROM stats WHERE n_in_stock >= 8)")
def watchlist_missing(spark: SparkSession, d: str) -> DataFrame:
    """Watched products that hardly any shop has in stock."""
    rows = offers.statistics(deduped(spark, d)).filter("n_in_stock >= 8").select("product_key")
    return watched(spark, d).select("user_id", "product_key").distinct().join(rows, "product_key", "left_anti").select("user_id", "product_key")


HOLD_SQL = """, held AS (SELECT o_custkey AS user_id, l_partkey AS product_key, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS qty,
   arg_min(CAST(l_extendedprice AS DECIMAL(18,2)), {'a': l_orderkey, 'b': l_linenumber, 'c': l_extendedprice, 'd': l_shipdate}) AS cost FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"""


@query(SQL + HOLD_SQL + " SELECT user_id, product_key, qty, CAST(cost AS DOUBLE) AS cost FROM held")
def holdings_merge(spark: SparkSession, d: str) -> DataFrame:
    return num(users.merge_holdings(watched(spark, d)), "cost")


@query(SQL + HOLD_SQL + """, v AS (SELECT user_id, count(*) AS products, sum(cost * qty) AS cost, coalesce(sum((best_amount + best_shipping) * qty), 0) AS value FROM held LEFT JOIN market USING (product_key) GROUP BY user_id)
SELECT user_id, products, CAST(cost AS DOUBLE) AS cost, CAST(value AS DOUBLE) AS value, CAST(value - cost AS DOUBLE) AS gain, round(CAST(100 * (value - cost) AS DOUBLE) / CAST(cost AS DOUBLE), 1) AS gain_pct FROM v""")
def collection_value(spark: SparkSession, d: str) -> DataFrame:
    return num(users.valuation(users.merge_holdings(watched(spark, d)), index(spark, d)), "cost", "value", "gain")


@query(SQL + """, watch AS (SELECT DISTINCT o_custkey AS user_id, l_partkey AS product_key FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority LIKE '1%'),
own AS (SELECT user_id, product_key, shop_key, in_stock, s1, s2, s3, s4, amount_dkk + CASE WHEN shipping_verified THEN shipping_dkk WHEN (user_id + length(country)) % 3 = 0 THEN 10 + user_id % 50 ELSE shipping_dkk END AS total FROM watch JOIN dedup USING (product_key))
SELECT user_id, product_key, shop_key, CAST(total AS DOUBLE) AS total_dkk FROM own QUALIFY row_number() OVER (PARTITION BY user_id, product_key ORDER BY in_stock DESC, total, s1, s2, s3, s4) = 1""")
def rerank_overrides(spark: SparkSession, d: str) -> DataFrame:
    """The first offer of each watched product when users bring their own shipping rates for some countries."""
    urgent = tables.table(spark, d, "orders").filter(F.col("o_orderpriority").startswith("1"))
    watch = urgent.join(tables.table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("product_key"))
    lengths = tables.table(spark, d, "nation").select(F.col("n_name").alias("country"), (F.length("n_name") % 3).alias("_third"))
    mine = urgent.select(F.col("o_custkey").alias("user_id")).distinct().withColumn("_third", F.pmod(-F.col("user_id"), F.lit(3)).cast("int")).join(lengths, "_third").select("user_id", "country", (10 + F.col("user_id") % 50).cast(money.MONEY).alias("amount"))
    out = users.first_offers(offers.one_per_shop(landed(spark, d).repartition("product_key")), watch, mine)
    return num(out.select("user_id", "product_key", "shop_key", "total_dkk"), "total_dkk")


@query("""WITH n AS (SELECT DISTINCT substr(p_name, 1 + p_partkey % 4, 2 + p_partkey % 6) AS name FROM part),
t AS (SELECT p_partkey AS product_key, lower(p_name || ' ' || p_type || ' ' || p_brand) AS title FROM part)
SELECT name, count(*) AS products, min(product_key) AS first FROM n JOIN t ON contains(title, lower(name)) GROUP BY name""")
def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of names searched for in all titles by an index of their runs of letters: how many products have each, and the first."""
    p = tables.table(spark, d, "part")
    path = folder(spark, "index")
    text_index.write(p.select(F.col("p_partkey").alias("product_key"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("title")), path)
    names = p.select(F.substring("p_name", (1 + F.col("p_partkey") % 4).cast("int"), (2 + F.col("p_partkey") % 6).cast("int")).alias("name"))
    return text_index.search(spark, path, names).groupBy("name").agg(F.count("*").alias("products"), F.min("product_key").alias("first"))
