"""Queries on whole classifications, scores of set names, and a report's overviews: sets in order, totals of a run, top lists, what has no rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import basket, classify, history, offers, runs
from cairn.plans.baskets import BASKET_SQL, FEE, basket_offers, rules
from cairn.plans.market import HISTORY_SQL, SQL, _runs, daily, deduped, num, stats
from cairn.plans.texts import NORM, REJECT_SQL, TYPE_SQL, words
from cairn.plans.titles import BARE, parts, written, written_sql
from cairn.registry import query
from cairn.rules import titles as T
from cairn.sources import feeds, tables

# -- titles ---------------------------------------------------------------------------

ENDINGS = (" Elite Trainer Box", " Booster Box Pokemon", " Booster Bundle Display", " Pokemon Center ETB (DE)", " Pokemon Display [JP]", " Sleeves 65 stk", " Yugioh Booster Box", " UPC Pokemon preorder", " Pokemon", " 6x Display", " ETB japansk", " Top Trainer Box (FR)")
SPOKEN_SQL = f"""coalesce({', '.join(f"CASE WHEN regexp_matches(norm, '{words(t)}') THEN '{c}' END" for c, t in T.LANGUAGES)},
 nullif(lower(regexp_extract(title, '(?i)(?:[\\(\\[]\\s*|\\s[-–|/]\\s*)({'|'.join(T.CODES)})\\s*(?:[\\)\\]]|$|\\s[-–|/])', 1)), ''), CASE WHEN list_contains({list(T.CODES)}, string_split(norm, ' ')[-1]) THEN string_split(norm, ' ')[-1] END)"""


@query(written_sql(ENDINGS) + f""", a AS (SELECT DISTINCT {NORM.format('p_name')} AS alias FROM part WHERE length(p_name) % 2 = 0),
w AS (SELECT *, list_filter(string_split_regex(trim({BARE}), ' +'), lambda x: x <> '' AND NOT list_contains({list(T.NOISE)}, x)) AS ws FROM n),
k AS (SELECT *, list_filter(ws, lambda x, i: NOT regexp_full_match(x, '[0-9]+') OR coalesce(list_contains({list(T.ORDINAL_LEAD)}, ws[i - 1]), false) OR coalesce(list_contains({list(T.ORDINAL_TRAIL)}, ws[i + 1]), false)) AS kept FROM w),
c AS (SELECT DISTINCT title, norm, array_to_string(CASE WHEN len(kept) > 0 THEN kept ELSE ws END, ' ') AS name, list_distinct({TYPE_SQL}) AS kinds FROM k),
r AS (SELECT c.*, a.alias, coalesce(CASE WHEN norm = '' THEN 'empty title' WHEN {parts(T.OTHER_GAMES)} THEN 'other game' END, {REJECT_SQL}, CASE len(kinds) WHEN 0 THEN 'no product type' WHEN 1 THEN NULL ELSE 'several product types' END,
  CASE WHEN NOT ({parts(T.BRAND)}) AND a.alias IS NULL THEN 'not of the brand' END) AS reason FROM c LEFT JOIN a ON a.alias = c.name)
SELECT title, reason IS NULL AS accepted, reason, CASE WHEN reason IS NULL THEN CASE WHEN kinds[1] = '{T.ELITE_TYPE}' AND regexp_matches(norm, '{words(T.CENTER_WORDS)}') THEN '{T.CENTER_TYPE}' ELSE kinds[1] END END AS product_type,
  CASE WHEN reason IS NULL THEN coalesce({SPOKEN_SQL}, CASE WHEN length(alias) % 4 = 0 THEN 'de' END, 'en') END AS language, CASE WHEN reason IS NULL THEN 'id ' || alias END AS set_id,
  CASE WHEN reason IS NULL THEN coalesce(upper(alias), array_to_string(list_transform(string_split(name, ' '), lambda x: upper(x[1]) || x[2:]), ' ')) END AS set_name, CASE WHEN reason IS NULL AND alias IS NOT NULL THEN '2024-01-01' END AS release_date,
  CASE WHEN reason IS NULL THEN alias IS NOT NULL END AS set_matched, CASE WHEN reason IS NULL THEN CASE WHEN alias IS NULL THEN 0 ELSE 100 END END AS match_score, regexp_matches(lower(title), '(^|[^a-z])pre[ -]?orders?([^a-z]|$)') AS pre_order FROM r""")
def classify_whole(spark: SparkSession, d: str) -> DataFrame:
    """Titles classified from end to end against half of the parts' names: every reason, type, language, set or name of none."""
    names = tables.table(spark, d, "part").filter(F.length("p_name") % 2 == 0).select(text.normalise(F.col("p_name")).alias("alias")).distinct()
    language = F.when(F.length("alias") % 4 == 0, "de").otherwise("en")
    aliases = names.select("alias", F.concat(F.lit("id "), "alias").alias("set_id"), F.upper("alias").alias("name"), F.lit("2024-01-01").alias("release_date"), language.alias("alias_lang"))
    return classify.classify(written(spark, d, ENDINGS).select("title"), aliases)


@query(f"""WITH a AS (SELECT {NORM.format('n_name')} AS nation, {NORM.format("n_name || ' ' || r_name || ' hidden treasures volume'")} AS alias, n_nationkey % 4 AS v FROM nation JOIN region ON r_regionkey = n_regionkey),
w AS (SELECT *, string_split(nation, ' ')[1] AS w, list_filter(list_distinct(string_split(alias, ' ')), lambda x: x <> string_split(nation, ' ')[1]) AS others FROM a),
t AS (SELECT *, CASE v WHEN 0 THEN w[1:2] || w[4:] WHEN 3 THEN w[1:3] || w[3] || w[4:] END AS typed, length(array_to_string(others, ' ')) AS n FROM w)
SELECT CASE v WHEN 2 THEN array_to_string(list_reverse(string_split(alias, ' ')), ' ') ELSE typed || substr(alias, length(w) + 1) END AS name, alias,
  CASE v WHEN 2 THEN 100 ELSE CAST(floor(200.0 * (n + 1 + least(length(w), length(typed))) / (2 * (n + 1) + length(w) + length(typed))) AS INTEGER) END AS score
FROM t WHERE v = 2 OR v IN (0, 3) AND length(w) >= 6 AND length(typed) >= 6 AND 200.0 * least(length(w), length(typed)) >= 90 * (length(w) + length(typed))""")
def alias_scores(spark: SparkSession, d: str) -> DataFrame:
    """Set names with a letter less or twice, turned around, or with too few of their words: scores under 100, and names that have no set."""
    nation, region = tables.table(spark, d, "nation"), tables.table(spark, d, "region")
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(text.normalise(F.concat_ws(" ", "n_name", "r_name", F.lit("hidden treasures volume"))).alias("alias"), (F.col("n_nationkey") % 4).alias("v"))
    ws, a = F.split("alias", " "), F.col("alias")
    first = F.get(ws, F.lit(0))
    cut = lambda n: F.substring(a, F.lit(n), F.length(a))
    forms = F.when(F.col("v") == 0, F.concat(F.substring(a, 1, 2), cut(4))).when(F.col("v") == 1, F.concat_ws(" ", first, F.lit("treasures"))).when(F.col("v") == 2, F.array_join(F.reverse(ws), " ")).otherwise(F.concat(F.substring(a, 1, 3), F.substring(a, 3, 1), cut(4)))
    return classify.match(rows.select(forms.alias("name")), rows.select("alias"))


# -- overviews ------------------------------------------------------------------------

SETS_SQL = """, own AS (SELECT p_partkey AS product_key, p_brand AS set_name, p_type AS product_type, CASE WHEN p_brand LIKE '%1' OR p_brand LIKE '%3' THEN 'id ' || p_brand END AS set_id, CASE WHEN p_brand LIKE '%3' THEN '20' || right(p_brand, 2) || '-01-01' END AS release_date FROM part),
sets AS (SELECT set_name, max(set_id) IS NOT NULL AS matched, max(release_date) AS release_date, count(*) AS products, CAST(min(best_amount) AS DOUBLE) AS cheapest, CAST(sum(n_offers) AS BIGINT) AS offer_count FROM own JOIN market USING (product_key) GROUP BY set_name)"""


def in_sets(spark: SparkSession, d: str) -> DataFrame:
    """Titles with their sets: brands that end in 1 or 3 are known sets, the latter with a release date."""
    b = F.col("set_name")
    return tables.titles(spark, d).withColumn("set_id", F.when(b.rlike("[13]$"), F.concat(F.lit("id "), b))).withColumn("release_date", F.when(b.endswith("3"), F.concat(F.lit("20"), F.right(b, F.lit(2)), F.lit("-01-01"))))


@query(SQL + SETS_SQL + " SELECT *, row_number() OVER (ORDER BY matched DESC, coalesce(release_date, '0000-00-00') DESC, offer_count DESC, set_name) AS place FROM sets")
def set_overview(spark: SparkSession, d: str) -> DataFrame:
    """Sets as the report lists them: matched first, the newest first, then those with most offers."""
    return num(runs.set_places(offers.set_overview(stats(spark, d), in_sets(spark, d))).withColumn("place", F.col("place").cast("long")), "cheapest")


@query(SQL + SETS_SQL + """, c AS (SELECT own.set_name, product_key, best_total, discount_pct FROM own JOIN market USING (product_key))
SELECT set_name, product_key, CAST(best_total AS DOUBLE) AS total, row_number() OVER (PARTITION BY set_name ORDER BY coalesce(discount_pct, 0) DESC, best_total, product_key) AS place FROM c QUALIFY place <= 6""")
def set_cards(spark: SparkSession, d: str) -> DataFrame:
    """The six products of each set that its card shows: the best discounts, then the cheapest."""
    return num(offers.cards(stats(spark, d), in_sets(spark, d)).select("set_name", "product_key", "total", F.col("place").cast("long").alias("place")), "total")


@query(SQL + HISTORY_SQL + """, based AS (
  SELECT product_key, day, dkk, quantile_cont(CAST(dkk AS DOUBLE), 0.5) OVER (PARTITION BY product_key ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS baseline,
         row_number() OVER (PARTITION BY product_key ORDER BY day DESC) AS k, count(*) OVER (PARTITION BY product_key) AS days FROM daily)
SELECT product_key, round(100 * ((baseline - CAST(dkk AS DOUBLE)) / baseline), 1) AS drop_pct FROM based WHERE k = 1 AND days >= 3 AND baseline > 0 AND (baseline - CAST(dkk AS DOUBLE)) / baseline >= 0.03 ORDER BY drop_pct DESC, product_key LIMIT 24""")
def top_drops(spark: SparkSession, d: str) -> DataFrame:
    """The report's 24 largest drops."""
    return history.price_drops(daily(spark, d)).select("product_key", "drop_pct").orderBy(F.desc("drop_pct"), "product_key").limit(24)


@query(SQL + SETS_SQL + """, fresh AS (SELECT shop_key, count(*) AS n FROM offers WHERE NOT stale AND captured_at >= DATE '2001-06-01' AND shop_key % 4 <> 3 GROUP BY shop_key),
last AS (SELECT shop_key, count(*) AS n FROM offers WHERE captured_at < DATE '2001-06-01' AND shop_key % 10 <> 7 GROUP BY shop_key),
log AS (SELECT CASE WHEN fresh.n > 0 THEN 'ok' WHEN last.n > 0 THEN 'stale' ELSE 'failed' END AS status FROM shop LEFT JOIN fresh USING (shop_key) LEFT JOIN last USING (shop_key))
SELECT (SELECT count(*) FROM sets) AS sets, (SELECT count(*) FROM sets WHERE matched) AS matched_sets, (SELECT count(*) FROM log WHERE status = 'failed') AS failed_shops, (SELECT count(*) FROM log WHERE status = 'stale') AS stale_shops, (SELECT count(*) FROM market WHERE shop_count > 1) AS in_several_shops""")
def run_totals(spark: SparkSession, d: str) -> DataFrame:
    """A run's totals: sets, matched ones, shops that failed or kept old offers, products in several shops."""
    log = offers.run_log(tables.shops(spark, d), *_runs(spark, d))
    return runs.totals(offers.set_overview(stats(spark, d), in_sets(spark, d)), log, stats(spark, d))


# -- what lacks its partner -----------------------------------------------------------

NO_SEK_SQL = ", priced2 AS (SELECT raw.*, CASE WHEN currency <> 'SEK' THEN amount END AS known FROM raw JOIN shop USING (shop_key))"


def without_sek(spark: SparkSession, d: str) -> DataFrame:
    """Landed offers where one currency has no rate."""
    return offers.land_cost(tables.offers(spark, d), tables.shops(spark, d), tables.rates(spark).filter("currency <> 'SEK'"), tables.assumed_shipping(spark, d))


@query(SQL + NO_SEK_SQL + " SELECT shop_key, count(*) AS offers, CAST(sum(amount) AS DOUBLE) AS amount FROM priced2 WHERE known IS NOT NULL GROUP BY shop_key")
def convertible_offers(spark: SparkSession, d: str) -> DataFrame:
    """Offers whose currency has a rate; others are left out."""
    return num(offers.convertible(without_sek(spark, d)).groupBy("shop_key").agg(F.count("*").alias("offers"), F.sum("amount").alias("amount")), "amount")


@query(SQL + NO_SEK_SQL + """ SELECT count(*) FILTER (ok AND known IS NOT NULL) AS accepted, count(*) FILTER (NOT ok) AS rejected, count(*) FILTER (ok AND known IS NULL) AS no_rate, count(DISTINCT product_key) FILTER (ok AND known IS NOT NULL AND product_key % 3 = 0) AS unmatched
FROM (SELECT *, product_key % 7 <> 2 AS ok FROM priced2)""")
def counters_without_rate(spark: SparkSession, d: str) -> DataFrame:
    """A run's counters where a currency lacks its rate."""
    rows = without_sek(spark, d).withColumn("accepted", F.col("product_key") % 7 != 2).withColumn("set_matched", F.col("product_key") % 3 != 0)
    return runs.counters(rows)


@query(f"SELECT n_nationkey AS nation_key, CASE n_nationkey % 12 {' '.join(f'WHEN {i} THEN {chr(39)}{name}{chr(39)}' for i, name in enumerate(runs.COUNTRIES.values()))} ELSE 'XX' END AS country_name FROM nation")
def country_names(spark: SparkSession, d: str) -> DataFrame:
    """Country codes by name; one that has no name stays a code."""
    code = F.element_at(F.array(*map(F.lit, [*runs.COUNTRIES, "XX"])), (F.col("n_nationkey") % 12 + 1).cast("int"))
    return tables.table(spark, d, "nation").select(F.col("n_nationkey").alias("nation_key"), runs.country_name(code).alias("country_name"))


@query(SQL + BASKET_SQL + f", l AS (SELECT basket_id, item_pos, min(price + {FEE.format('price', 'free_over', 'ship')}) AS landed FROM bo WHERE shop % 7 > 0 GROUP BY ALL) SELECT basket_id, CAST(sum(landed) AS DOUBLE) AS separately FROM l GROUP BY basket_id")
def basket_known_shops(spark: SparkSession, d: str) -> DataFrame:
    """Offers of shops that the shop table doesn't know take no part in baskets."""
    return num(basket.separately(basket_offers(spark, d), rules(spark, d).filter("shop_key % 7 > 0")), "separately")


@query("SELECT CAST(c_custkey AS BIGINT) AS shop_key FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def unknown_shops(spark: SparkSession, d: str) -> DataFrame:
    """Of the keys asked for, those that no shop has."""
    wanted = tables.table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("shop_key"))
    return feeds.unknown_shops(wanted, tables.shops(spark, d))
