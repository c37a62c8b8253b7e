"""Queries on offers: landed cost, ranking, market statistics, shops, history, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import money
from cairn.operators import history, offers
from cairn.registry import query
from cairn.sources import sinks, tables

SQL = tables.SQL
D = "CAST({0} AS DOUBLE) AS {1}"


def landed(spark: SparkSession, d: str) -> DataFrame:
    return offers.land_cost(tables.offers(spark, d), tables.shops(spark, d), tables.rates(spark), tables.assumed_shipping(spark, d))


def deduped(spark: SparkSession, d: str) -> DataFrame:
    return offers.one_per_shop(landed(spark, d))


def stats(spark: SparkSession, d: str) -> DataFrame:
    return offers.statistics(deduped(spark, d))


def num(df: DataFrame, *names: str) -> DataFrame:
    """Decimals as doubles, for comparison with other engines."""
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def seq() -> list[Column]:
    return [F.col("seq.l_orderkey").alias("order_key"), F.col("seq.l_linenumber").alias("line")]


@query(SQL + "SELECT product_key, shop_key, s1 AS order_key, s2 AS line, currency, CAST(amount_dkk AS DOUBLE) AS amount_dkk, CAST(shipping_dkk AS DOUBLE) AS shipping_dkk, shipping_verified, CAST(total_dkk AS DOUBLE) AS total_dkk FROM offers")
def landed_cost(spark: SparkSession, d: str) -> DataFrame:
    return num(landed(spark, d).select("product_key", "shop_key", *seq(), "currency", "amount_dkk", "shipping_dkk", "shipping_verified", "total_dkk"), "amount_dkk", "shipping_dkk", "total_dkk")


@query(SQL + "SELECT product_key, shop_key, in_stock, CAST(total_dkk AS DOUBLE) AS total_dkk, s1 AS order_key, s2 AS line FROM dedup")
def dedupe_per_shop(spark: SparkSession, d: str) -> DataFrame:
    return num(deduped(spark, d).select("product_key", "shop_key", "in_stock", "total_dkk", *seq()), "total_dkk")


@query(SQL + "SELECT product_key, shop_key, row_number() OVER (PARTITION BY product_key ORDER BY in_stock DESC, total_dkk, s1, s2, s3, s4) AS rank, CAST(total_dkk AS DOUBLE) AS total_dkk FROM dedup")
def offer_ranking(spark: SparkSession, d: str) -> DataFrame:
    return num(offers.ranked(deduped(spark, d)).select("product_key", "shop_key", F.col("rank").cast("long").alias("rank"), "total_dkk"), "total_dkk")


@query(SQL + "SELECT product_key, shop_key AS best_shop FROM best WHERE in_stock")
def best_offer_flag(spark: SparkSession, d: str) -> DataFrame:
    return offers.ranked(deduped(spark, d)).filter("best").select("product_key", F.col("shop_key").alias("best_shop"))


@query(SQL + "SELECT product_key, shop_key, in_stock, CAST(amount_dkk AS DOUBLE) AS amount_dkk, CAST(total_dkk AS DOUBLE) AS total_dkk FROM best")
def cheapest_offer(spark: SparkSession, d: str) -> DataFrame:
    return num(stats(spark, d).select("product_key", "cheapest.shop_key", "cheapest.in_stock", "cheapest.amount_dkk", "cheapest.total_dkk"), "amount_dkk", "total_dkk")


ITEM_SQL = ", item AS (SELECT * FROM dedup WHERE in_stock QUALIFY row_number() OVER (PARTITION BY product_key ORDER BY amount_dkk, s1, s2, s3, s4) = 1)"


@query(SQL + ITEM_SQL + " SELECT product_key, shop_key, CAST(amount_dkk AS DOUBLE) AS amount_dkk FROM item")
def cheapest_item_only(spark: SparkSession, d: str) -> DataFrame:
    return num(stats(spark, d).filter("cheapest_item is not null").select("product_key", "cheapest_item.shop_key", "cheapest_item.amount_dkk"), "amount_dkk")


@query(SQL + ITEM_SQL + " SELECT product_key, best.shop_key AS landed_shop, item.shop_key AS item_shop FROM best JOIN item USING (product_key) WHERE best.shop_key <> item.shop_key")
def shipping_flips_answer(spark: SparkSession, d: str) -> DataFrame:
    s = stats(spark, d).filter(F.col("cheapest.shop_key") != F.col("cheapest_item.shop_key"))
    return s.select("product_key", F.col("cheapest.shop_key").alias("landed_shop"), F.col("cheapest_item.shop_key").alias("item_shop"))


@query(SQL + "SELECT product_key, shop_key AS dearest_shop, CAST(total_dkk AS DOUBLE) AS total_dkk FROM dedup WHERE in_stock QUALIFY row_number() OVER (PARTITION BY product_key ORDER BY total_dkk DESC, s1, s2, s3, s4) = 1")
def dearest_in_stock(spark: SparkSession, d: str) -> DataFrame:
    return num(stats(spark, d).filter("dearest is not null").select("product_key", F.col("dearest.shop_key").alias("dearest_shop"), "dearest.total_dkk"), "total_dkk")


@query(SQL + "SELECT product_key, shop_count, n_in_stock, CAST(market AS DOUBLE) AS market FROM stats")
def market_price(spark: SparkSession, d: str) -> DataFrame:
    return num(stats(spark, d).select("product_key", "shop_count", "n_in_stock", "market"), "market")


@query(SQL + "SELECT product_key, CASE WHEN n_in_stock >= 2 THEN CAST(lo AS DOUBLE) END AS lo, CASE WHEN n_in_stock >= 2 THEN CAST(hi AS DOUBLE) END AS hi FROM stats")
def price_range(spark: SparkSession, d: str) -> DataFrame:
    two = lambda c: F.when(F.col("n_in_stock") >= 2, F.col(c).cast("double")).alias(c)
    return stats(spark, d).select("product_key", two("lo"), two("hi"))


@query(SQL + "SELECT product_key, CAST(hi - lo AS DOUBLE) AS spread_dkk, round(CAST(100 * (hi - lo) AS DOUBLE) / CAST(hi AS DOUBLE), 1) AS spread_pct FROM stats WHERE hi > lo")
def spread(spark: SparkSession, d: str) -> DataFrame:
    s = stats(spark, d).filter("spread is not null")
    return s.select("product_key", F.col("spread").cast("double").alias("spread_dkk"), F.round((100 * F.col("spread")).cast("double") / F.col("hi").cast("double"), 1).alias("spread_pct"))


@query(SQL + "SELECT product_key, discount_pct FROM market WHERE market IS NOT NULL")
def discount(spark: SparkSession, d: str) -> DataFrame:
    return stats(spark, d).filter("market is not null").select("product_key", "discount_pct")


@query(SQL + "SELECT product_key, discount_pct, CAST(market AS DOUBLE) AS market, CAST(best_total AS DOUBLE) AS total FROM market WHERE discount_pct >= 5 ORDER BY discount_pct DESC, market - best_total DESC, product_key LIMIT 60")
def deals(spark: SparkSession, d: str) -> DataFrame:
    """The report's top sixty."""
    return num(offers.deals(stats(spark, d)).limit(60).select("product_key", "discount_pct", "market", F.col("cheapest.total_dkk").alias("total")), "market", "total")


@query(SQL + "SELECT product_key, CAST(hi - lo AS DOUBLE) AS spread FROM stats WHERE hi > lo AND shops_in_stock >= 2 ORDER BY hi - lo DESC, product_key LIMIT 60")
def largest_savings(spark: SparkSession, d: str) -> DataFrame:
    """The report's top sixty."""
    return num(offers.savings(stats(spark, d)).limit(60).select("product_key", "spread"), "spread")


@query(SQL + "SELECT product_key, shop_key, round(CAST(100 * (total_dkk - lo) AS DOUBLE) / CAST(hi - lo AS DOUBLE), 1) AS tick, round(CAST(100 * (market - lo) AS DOUBLE) / CAST(hi - lo AS DOUBLE), 1) AS market_pos FROM dedup JOIN stats USING (product_key) WHERE in_stock AND market IS NOT NULL AND hi > lo")
def price_strip(spark: SparkSession, d: str) -> DataFrame:
    rows = deduped(spark, d)
    return offers.price_strip(rows, offers.statistics(rows)).select("product_key", "shop_key", "tick", "market_pos")


CARD_SQL = """, card AS (
  SELECT shop_key, count(*) AS offers, count(*) FILTER (in_stock) AS in_stock, count(*) FILTER (in_stock AND shops_in_stock >= 2) AS contested,
         count(*) FILTER (in_stock AND shops_in_stock >= 2 AND best_shop = shop_key) AS wins,
         CASE WHEN count(market) FILTER (in_stock) >= 3 THEN CAST(round(100 * quantile_cont(CASE WHEN in_stock AND market > 0 THEN CAST(total_dkk AS DOUBLE) / CAST(market AS DOUBLE) END, 0.5)) AS BIGINT) END AS price_index
  FROM dedup JOIN (SELECT product_key, shops_in_stock, best_shop, market FROM market) AS m USING (product_key) GROUP BY shop_key)"""


@query(SQL + CARD_SQL + " SELECT *, CASE WHEN contested > 0 THEN CAST(round(100 * wins / contested) AS BIGINT) END AS win_pct FROM card")
def shop_scorecard(spark: SparkSession, d: str) -> DataFrame:
    rows = deduped(spark, d)
    return offers.scorecard(rows, offers.statistics(rows)).select("shop_key", "offers", "in_stock", "contested", "wins", "price_index", "win_pct")


@query(SQL + "SELECT best_shop AS shop_key, row_number() OVER (PARTITION BY best_shop ORDER BY coalesce(discount_pct, 0) DESC, product_key) AS rank, product_key, discount_pct FROM market WHERE best_in_stock AND shops_in_stock >= 2 QUALIFY rank <= 40")
def shop_best_products(spark: SparkSession, d: str) -> DataFrame:
    rows = deduped(spark, d)
    return offers.won_products(rows, offers.statistics(rows)).select("shop_key", F.col("rank").cast("long").alias("rank"), "product_key", "discount_pct")


@query(SQL + "SELECT p_brand AS set_name, count(*) AS products, CAST(min(best_amount) AS DOUBLE) AS cheapest, CAST(sum(n_offers) AS BIGINT) AS offer_count FROM part JOIN market ON p_partkey = product_key GROUP BY p_brand")
def set_rollup(spark: SparkSession, d: str) -> DataFrame:
    return num(offers.set_rollup(stats(spark, d), tables.titles(spark, d)).drop("types"), "cheapest")


HISTORY_SQL = """, daily AS (
  SELECT product_key, captured_at AS day, amount_dkk AS dkk, total_dkk, shop_key, in_stock
  FROM (SELECT *, row_number() OVER (PARTITION BY product_key, captured_at, shop_key ORDER BY in_stock DESC, total_dkk, s1, s2, s3, s4) AS k FROM offers WHERE NOT stale) WHERE k = 1
  QUALIFY row_number() OVER (PARTITION BY product_key, captured_at ORDER BY in_stock DESC, total_dkk, s1, s2, s3, s4) = 1)"""


def daily(spark: SparkSession, d: str) -> DataFrame:
    """History of all days: of each product and day the cheapest fresh offer."""
    rows = landed(spark, d).filter("not stale").withColumn("product_key", F.struct("product_key", "captured_at"))
    s = offers.statistics(offers.one_per_shop(rows)).withColumn("day", F.col("product_key.captured_at")).withColumn("product_key", F.col("product_key.product_key"))
    return history.observe(s)


@query(SQL + HISTORY_SQL + " SELECT product_key, day, shop_key, in_stock, CAST(dkk AS DOUBLE) AS dkk, CAST(total_dkk AS DOUBLE) AS total_dkk FROM daily")
def history_upsert(spark: SparkSession, d: str) -> DataFrame:
    """History as two runs write it: the second run replaces the days that it sees again."""
    rows = daily(spark, d)
    first = rows.filter(F.year("day") <= 1998).withColumn("run", F.lit(1)).withColumn("dkk", F.col("dkk") + 1)
    out = history.upsert(first.withColumn("dkk", F.col("dkk").cast(money.MONEY)), rows.withColumn("run", F.lit(2)))
    return num(out.select("product_key", "day", "shop_key", "in_stock", "dkk", "total_dkk"), "dkk", "total_dkk")


@query(SQL + HISTORY_SQL + " SELECT product_key, count(*) AS observations, min(day) AS first_day, max(day) AS last_day, CAST(arg_max(dkk, day) AS DOUBLE) AS last_price FROM daily GROUP BY product_key")
def history_series(spark: SparkSession, d: str) -> DataFrame:
    out = history.series(daily(spark, d))
    return out.select("product_key", "observations", "first_day", "last_day", F.element_at("points", -1)["dkk"].cast("double").alias("last_price"))


@query(SQL + HISTORY_SQL + """, based AS (
  SELECT product_key, day, dkk, quantile_cont(CAST(dkk AS DOUBLE), 0.5) OVER (PARTITION BY product_key ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS baseline,
         row_number() OVER (PARTITION BY product_key ORDER BY day DESC) AS k, count(*) OVER (PARTITION BY product_key) AS days FROM daily)
SELECT product_key, CAST(dkk AS DOUBLE) AS today, CAST(round(CAST(baseline AS DECIMAL(18,3)), 2) AS DOUBLE) AS baseline,
       CAST(round(CAST(baseline AS DECIMAL(18,3)) - dkk, 2) AS DOUBLE) AS drop_dkk, round(100 * ((baseline - CAST(dkk AS DOUBLE)) / baseline), 1) AS drop_pct, days
FROM based WHERE k = 1 AND days >= 3 AND baseline > 0 AND (baseline - CAST(dkk AS DOUBLE)) / baseline >= 0.03""")
def price_drops(spark: SparkSession, d: str) -> DataFrame:
    return num(history.price_drops(daily(spark, d)), "today", "baseline", "drop_dkk")


@query(SQL + """, fresh AS (SELECT shop_key, count(*) AS n FROM offers WHERE NOT stale AND captured_at >= DATE '2001-06-01' GROUP BY shop_key),
last AS (SELECT shop_key, count(*) AS n FROM offers WHERE captured_at < DATE '2001-06-01' AND shop_key % 10 <> 7 GROUP BY shop_key)
SELECT shop.shop_key, CASE WHEN fresh.n > 0 THEN 'ok' WHEN last.n > 0 THEN 'stale' ELSE 'failed' END AS status, CAST(coalesce(fresh.n, last.n, 0) AS BIGINT) AS count
FROM shop LEFT JOIN (SELECT * FROM fresh WHERE shop_key % 4 <> 3) AS fresh USING (shop_key) LEFT JOIN last USING (shop_key)""")
def run_log(spark: SparkSession, d: str) -> DataFrame:
    fresh, last = _runs(spark, d)
    return offers.run_log(tables.shops(spark, d), fresh, last).select("shop_key", "status", "count")


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A run in which every fourth shop failed, and the last good snapshots, which every tenth shop lacks."""
    rows, day = tables.offers(spark, d), F.lit("2001-06-01").cast("date")
    return rows.filter(~F.col("stale") & (F.col("captured_at") >= day) & (F.col("shop_key") % 4 != 3)), rows.filter((F.col("captured_at") < day) & (F.col("shop_key") % 10 != 7))


@query(SQL + """, fresh AS (SELECT * FROM offers WHERE NOT stale AND captured_at >= DATE '2001-06-01' AND shop_key % 4 <> 3),
last AS (SELECT * FROM offers WHERE captured_at < DATE '2001-06-01' AND shop_key % 10 <> 7)
SELECT shop_key, stale, count(*) AS offers FROM (
  SELECT shop_key, false AS stale FROM fresh UNION ALL SELECT shop_key, true FROM last WHERE shop_key NOT IN (SELECT shop_key FROM fresh)) GROUP BY ALL""")
def stale_fallback(spark: SparkSession, d: str) -> DataFrame:
    return offers.fallback(*_runs(spark, d)).groupBy("shop_key", "stale").agg(F.count("*").alias("offers"))


@query(SQL + "SELECT count(*) AS products, CAST(sum(n_offers) AS BIGINT) AS offers, (SELECT count(DISTINCT shop_key) FROM dedup) AS shops, (SELECT count(DISTINCT country) FROM dedup) AS countries, count(*) FILTER (shop_count > 1) AS in_several_shops, count(*) FILTER (discount_pct >= 5) AS deals FROM market")
def site_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = deduped(spark, d)
    one = rows.agg(F.count_distinct("shop_key").alias("shops"), F.count_distinct("country").alias("countries"))
    two = offers.statistics(rows).agg(F.count("*").alias("products"), F.sum("n_offers").alias("offers"), F.count_if(F.col("shop_count") > 1).alias("in_several_shops"), F.count_if(F.col("discount_pct") >= 5).alias("deals"))
    return one.join(two)  # a row each


@query(SQL + "SELECT product_key, len(list(shop_key)) AS offers, CAST(sum(total_dkk) AS DOUBLE) AS total FROM dedup GROUP BY product_key")
def nested_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Offers nested by product, as a run's result holds them, and taken apart again."""
    rows = sinks.unnest(sinks.nest(offers.ranked(deduped(spark, d)).select("product_key", "rank", "shop_key", "total_dkk")))
    return num(rows.groupBy("product_key").agg(F.count("*").cast("long").alias("offers"), F.sum("total_dkk").alias("total")), "total")


@query(SQL + "SELECT product_key, shop_key, CAST(amount_dkk AS DOUBLE) AS amount_dkk, row_number() OVER (PARTITION BY product_key ORDER BY s1, s2, s3, s4) AS place FROM dedup WHERE in_stock")
def basket_data(spark: SparkSession, d: str) -> DataFrame:
    _, items = sinks.basket_data(deduped(spark, d), tables.shops(spark, d), tables.rates(spark))
    out = items.select("product_key", F.posexplode("offers").alias("place", "o")).select("product_key", "o.shop_key", "o.amount_dkk", (F.col("place") + 1).cast("long").alias("place"))
    return num(out, "amount_dkk")


@query(SQL + "SELECT shop_key, country, CASE WHEN verified THEN CAST(CAST(ship * factor AS DECIMAL(18,2)) AS DOUBLE) END AS ship, CASE WHEN verified THEN CAST(CAST(free_over * factor AS DECIMAL(18,2)) AS DOUBLE) END AS free_over FROM shop")
def shop_rules(spark: SparkSession, d: str) -> DataFrame:
    rules, _ = sinks.basket_data(deduped(spark, d), tables.shops(spark, d), tables.rates(spark))
    return num(rules.select("shop_key", "country", "ship", "free_over"), "ship", "free_over")
