"""Offers, shops, rates and users as views of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.money import FACTOR, MONEY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key: Column, values: dict[int, object], kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v).cast(kind)).otherwise(out)
    return out


def rates(spark: SparkSession) -> DataFrame:
    """Base currency for one unit of each currency."""
    return spark.sql(f"SELECT currency, CAST(factor AS {FACTOR}) AS factor FROM VALUES ('DKK', '1'), ('EUR', '7.46'), ('SEK', '0.66311') AS t(currency, factor)")


def assumed_shipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipping assumed for a country; a quarter of the countries is not listed."""
    n = F.col("n_nationkey") % 4
    return table(spark, sf_dir, "nation").filter(n < 3).select(F.col("n_name").alias("country"), _pick(n, {0: 45, 1: 85, 2: 95}, MONEY).alias("assumed"))


def shops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shop_key, shop_name, country, currency, ship, free_over (both in its currency), verified."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    key, rule = F.col("s_suppkey") % 3, F.col("s_suppkey") % 5
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("shop_key"), F.col("s_name").alias("shop_name"), F.col("n_name").alias("country"),
        F.when(key == 0, "DKK").when(key == 1, "EUR").otherwise("SEK").alias("currency"),
        _pick(rule, {0: "39", 1: "49", 2: "14.95", 3: "9.95"}, MONEY).alias("ship"), _pick(rule, {1: 699, 3: 75}, MONEY).alias("free_over"), (rule != 4).alias("verified"),
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One offer per line item. ``seq`` orders offers of equal price: the earlier one wins."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("product_key"), F.col("l_suppkey").alias("shop_key"), F.col("l_extendedprice").cast(MONEY).alias("amount"), (F.col("l_linestatus") == "O").alias("in_stock"),
        (F.col("l_returnflag") == "R").alias("stale"), F.col("l_shipdate").cast("date").alias("captured_at"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate").alias("seq"),
    )


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_key, title, set_name (the brand) and product_type of each part."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_key"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.col("p_brand").alias("set_name"), F.col("p_type").alias("product_type"))


#: The same views in SQL, for the oracle queries.
SQL = """
WITH shop AS (
  SELECT s_suppkey AS shop_key, s_name AS shop_name, n_name AS country,
         CASE s_suppkey % 3 WHEN 0 THEN 'DKK' WHEN 1 THEN 'EUR' ELSE 'SEK' END AS currency,
         CAST(CASE s_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 7.46 ELSE 0.66311 END AS DECIMAL(12,5)) AS factor,
         CAST(CASE s_suppkey % 5 WHEN 0 THEN 39 WHEN 1 THEN 49 WHEN 2 THEN 14.95 WHEN 3 THEN 9.95 END AS DECIMAL(18,2)) AS ship,
         CAST(CASE s_suppkey % 5 WHEN 1 THEN 699 WHEN 3 THEN 75 END AS DECIMAL(18,2)) AS free_over,
         s_suppkey % 5 <> 4 AS verified,
         CAST(CASE s_nationkey % 4 WHEN 0 THEN 45 WHEN 1 THEN 85 WHEN 2 THEN 95 END AS DECIMAL(18,2)) AS assumed
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
raw AS (
  SELECT l_partkey AS product_key, l_suppkey AS shop_key, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, l_linestatus = 'O' AS in_stock,
         l_returnflag = 'R' AS stale, CAST(l_shipdate AS DATE) AS captured_at, l_orderkey AS s1, l_linenumber AS s2, l_extendedprice AS s3, l_shipdate AS s4
  FROM lineitem),
priced AS (
  SELECT raw.*, shop_name, country, currency, factor, CAST(amount * factor AS DECIMAL(18,2)) AS amount_dkk,
         CASE WHEN verified THEN CASE WHEN free_over IS NOT NULL AND amount >= free_over THEN 0 ELSE CAST(ship * factor AS DECIMAL(18,2)) END
              ELSE coalesce(assumed, 120) END AS shipping_dkk, verified AS shipping_verified
  FROM raw JOIN shop USING (shop_key)),
offers AS (SELECT *, amount_dkk + shipping_dkk AS total_dkk FROM priced),
dedup AS (SELECT * FROM offers QUALIFY row_number() OVER (PARTITION BY product_key, shop_key ORDER BY in_stock DESC, total_dkk, s1, s2, s3, s4) = 1),
stats AS (
  SELECT product_key, count(*) AS n_offers, count(DISTINCT shop_key) AS shop_count, count(*) FILTER (in_stock) AS n_in_stock,
         count(DISTINCT shop_key) FILTER (in_stock) AS shops_in_stock, min(total_dkk) FILTER (in_stock) AS lo, max(total_dkk) FILTER (in_stock) AS hi,
         CASE WHEN count(*) FILTER (in_stock) >= 3 THEN round(CAST(quantile_cont(CAST(total_dkk AS DOUBLE), 0.5) FILTER (in_stock) AS DECIMAL(18,3)), 2) END AS market
  FROM dedup GROUP BY product_key),
best AS (SELECT * FROM dedup QUALIFY row_number() OVER (PARTITION BY product_key ORDER BY in_stock DESC, total_dkk, s1, s2, s3, s4) = 1),
market AS (
  SELECT stats.*, best.shop_key AS best_shop, best.in_stock AS best_in_stock, best.total_dkk AS best_total, best.amount_dkk AS best_amount, best.shipping_dkk AS best_shipping,
         round(CAST(100 * (market - best.total_dkk) AS DOUBLE) / CAST(market AS DOUBLE), 1) AS discount_pct
  FROM stats JOIN best USING (product_key))
"""
