"""Queries on feeds, rates, set lists and what a run writes. Line items are the feeds' rows, parts their products, suppliers the shops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import money
from cairn.operators import classify, history, offers, runs
from cairn.plans.market import SQL, _runs, deduped, landed, num
from cairn.plans.texts import FORM_SQL, NORM, REJECT_SQL, SLUG, forms
from cairn.registry import query
from cairn.sources import feeds, sinks, tables
from cairn.sources.staging import folder


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items with their parts' names."""
    return tables.table(spark, d, "lineitem").join(tables.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_size"), "l_partkey")


def stores(spark: SparkSession, d: str) -> DataFrame:
    return tables.shops(spark, d).withColumn("base_url", F.concat(F.lit("https://shop"), F.col("shop_key").cast("string"), F.lit(".example/")))


# -- feeds ----------------------------------------------------------------------------


def feed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of nested products: some without handle, some variants without a price, and pages that begin like an earlier one."""
    n = F.col("l_orderkey")
    price = F.when(n % 13 == 0, "").when(n % 17 == 0, "n/a").otherwise(F.col("l_extendedprice").cast(money.MONEY).cast("string"))
    name = F.when(n % 3 == 0, "Default Title").when(n % 3 == 1, F.concat(F.lit("Q"), F.col("l_quantity").cast("int").cast("string")))
    variant = F.struct(name.alias("title"), price.alias("price"), F.when(n % 5 != 0, F.col("l_linestatus") == "O").alias("available"))
    rows = lines(spark, d).groupBy("l_suppkey", "l_returnflag", "l_linenumber", "l_partkey", "p_name").agg(F.collect_list(variant).alias("variants"))
    product = F.struct(F.col("l_partkey").cast("bigint").alias("id"), F.when(F.col("l_partkey") % 11 == 0, "").otherwise(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("handle"), F.col("p_name").alias("title"), "variants")
    return rows.groupBy(F.col("l_suppkey").alias("shop_key"), F.col("l_returnflag").alias("path"), F.col("l_linenumber").alias("page")).agg(F.array_sort(F.collect_list(product)).alias("products"))


@query("""WITH f AS (SELECT l_suppkey, l_returnflag, l_linenumber, min(l_partkey) AS head FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
again AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_returnflag, head ORDER BY l_linenumber) > 1),
stop AS (SELECT l_suppkey, l_returnflag, min(l_linenumber) AS stop FROM again GROUP BY ALL)
SELECT l_suppkey AS shop_key, p_name || CASE WHEN l_orderkey % 3 = 1 THEN ' - Q' || CAST(l_quantity AS INT) ELSE '' END AS title, 'https://shop' || l_suppkey || '.example/products/' || replace(p_name, ' ', '-') AS url,
       round(l_extendedprice, 2) AS amount, l_orderkey % 5 <> 0 AND l_linestatus = 'O' AS in_stock
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey LEFT JOIN stop USING (l_suppkey, l_returnflag)
WHERE (stop IS NULL OR l_linenumber < stop) AND l_partkey % 11 <> 0 AND l_orderkey % 13 <> 0 AND l_orderkey % 17 <> 0 AND l_extendedprice > 0""")
def feed_variants(spark: SparkSession, d: str) -> DataFrame:
    return feeds.nested(feed_pages(spark, d), stores(spark, d)).select("shop_key", "title", "url", F.round("amount", 2).alias("amount"), "in_stock")


def flat_rows(spark: SparkSession, d: str) -> DataFrame:
    """Products with prices in minor units, of all forms that stock is told in."""
    n, i = F.col("l_orderkey"), F.col("l_linenumber")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")
    price = F.struct(F.when(n % 23 == 0, "x").otherwise(cents).alias("price"), F.when(n % 4 == 1, 2).when(n % 4 == 2, 0).when(n % 4 == 3, 3).alias("currency_minor_unit"), F.when(n % 6 != 0, "eur").alias("currency_code"))
    said = F.struct(F.when(n % 2 == 0, "In stock").otherwise("").alias("text"))
    return lines(spark, d).select(
        F.col("l_suppkey").alias("shop_key"), F.when(F.col("l_partkey") % 19 == 0, "").otherwise(F.concat("p_name", F.lit(" &amp; more "))).alias("name"), F.concat(F.lit("https://a.example/p/"), F.col("l_partkey").cast("string")).alias("permalink"),
        price.alias("prices"), F.when(i % 3 == 0, True).when(i % 3 == 1, False).alias("is_in_stock"), F.when(n % 7 == 0, False).when(n % 7 > 1, True).alias("is_purchasable"), said.alias("stock_availability"),
    )


FLAT_SQL = """WITH f AS (SELECT l_suppkey AS shop_key, p_name || ' &amp; more ' AS title, 'https://a.example/p/' || l_partkey AS url, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
  CASE l_orderkey % 4 WHEN 2 THEN 0 WHEN 3 THEN 3 ELSE 2 END AS minor, CASE WHEN l_orderkey % 6 <> 0 THEN 'eur' END AS currency,
  CASE l_linenumber % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE l_orderkey % 2 = 0 END AND l_orderkey % 7 <> 0 AS in_stock
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_partkey % 19 <> 0 AND l_orderkey % 23 <> 0 AND l_extendedprice > 0)"""


@query(FLAT_SQL + " SELECT shop_key, title, url, cents / pow(10, minor) AS amount, currency, in_stock FROM f")
def feed_minor_units(spark: SparkSession, d: str) -> DataFrame:
    return feeds.flat(flat_rows(spark, d), stores(spark, d))


@query(FLAT_SQL + """ SELECT shop_key, n_name AS country, trim(replace(title, '&amp;', '&')) AS title, url, CAST(round(CAST(cents AS DECIMAL(18,3)) * CASE minor WHEN 0 THEN 1 WHEN 2 THEN 0.01 ELSE 0.001 END, 2) AS DOUBLE) AS amount,
 upper(coalesce(currency, CASE shop_key % 3 WHEN 0 THEN 'DKK' WHEN 1 THEN 'EUR' ELSE 'SEK' END)) AS currency, in_stock, DATE '2026-01-01' AS captured_at, false AS stale
FROM f JOIN supplier ON s_suppkey = shop_key JOIN nation ON n_nationkey = s_nationkey""")
def feed_conformed(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the feed in minor units as offers of the common form."""
    shops = stores(spark, d)
    return num(feeds.conform(feeds.flat(flat_rows(spark, d), shops), shops, F.lit("2026-01-01")), "amount")


@query("SELECT s_suppkey AS shop_key, s_name AS shop_name FROM supplier WHERE s_suppkey IN (0, 1, 5)")
def shop_selection(spark: SparkSession, d: str) -> DataFrame:
    """A run of named shops only; an unknown key would be an error."""
    shops = tables.shops(spark, d).withColumn("shop_key", F.col("shop_key").cast("string"))
    return feeds.select_shops(shops, ["0", "1", "5"]).select(F.col("shop_key").cast("long").alias("shop_key"), "shop_name")


# -- rates ----------------------------------------------------------------------------


def rate_series(spark: SparkSession, d: str) -> DataFrame:
    """Event types as currencies; a tenth of the values is blank, a tenth no number."""
    value = F.when(F.col("event_id") % 10 == 0, "").when(F.col("event_id") % 10 == 1, "NaN").otherwise(F.col("value").cast("string"))
    return tables.table(spark, d, "events").select(F.col("event_type").alias("currency"), F.col("ts").alias("period"), value.alias("value"))


SERIES_SQL = "WITH s AS (SELECT event_type AS currency, max(ts) AS period, arg_max(value, ts) AS value FROM events WHERE event_id % 10 > 1 AND value IS NOT NULL AND NOT isnan(value) GROUP BY event_type)"


@query(SERIES_SQL + """, r AS (SELECT * FROM s UNION ALL SELECT 'EUR', max(period), 1.0 FROM s)
SELECT currency, period, CAST(CAST(CASE WHEN value > 0 THEN (SELECT value FROM s WHERE currency = 'purchase') / value END AS DECIMAL(12,5)) AS DOUBLE) AS factor, false AS stale FROM r""")
def fx_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of the last observations, against purchase as the base currency."""
    return num(feeds.last_rates(rate_series(spark, d), base="purchase"), "factor")


@query("""WITH s AS (SELECT CASE event_type WHEN 'view' THEN 'DKK' ELSE event_type END AS currency, min(ts) AS period, arg_min(value, ts) AS value FROM events GROUP BY event_type), r AS (SELECT * FROM s UNION ALL SELECT 'EUR', max(period), 1.0 FROM s)
SELECT currency, period, CAST(CAST(CASE WHEN value > 0 THEN (SELECT value FROM s WHERE currency = 'DKK') / value END AS DECIMAL(12,5)) AS DOUBLE) AS factor, true AS stale FROM r""")
def fx_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Without an observation of the base currency the stored rates, here the first ones, stand in, flagged stale."""
    currency = F.when(F.col("event_type") == "view", "DKK").otherwise(F.col("event_type"))
    cached = tables.table(spark, d, "events").groupBy(currency.alias("currency")).agg(F.min("ts").alias("period"), F.min_by("value", "ts").alias("value"))
    return num(feeds.last_rates(rate_series(spark, d), cached), "factor")


@query("""WITH q AS (SELECT CASE event_type WHEN 'view' THEN 'EUR' ELSE event_type END AS currency, max(value) AS per_100 FROM events GROUP BY event_type), e AS (SELECT per_100 / 100 AS euro FROM q WHERE currency = 'EUR')
SELECT currency, round(euro / (per_100 / 100), 6) AS value FROM q, e WHERE currency <> 'EUR' UNION ALL SELECT 'DKK', round(euro, 6) FROM e UNION ALL SELECT 'EUR', 1.0""")
def fx_rebase(spark: SparkSession, d: str) -> DataFrame:
    """Quotes for 100 units turned to units per euro."""
    currency = F.when(F.col("event_type") == "view", "EUR").otherwise(F.col("event_type"))
    quotes = tables.table(spark, d, "events").groupBy(currency.alias("currency")).agg(F.max("value").alias("per_100"))
    return runs.rebase(quotes).select("currency", F.round("value", 6).alias("value"))


# -- sets and products ----------------------------------------------------------------


@query(f"""WITH s AS (SELECT ['en', 'en', 'de', 'fr', 'es', 'it', 'pl'][p_size % 7 + 1] AS lang, p_partkey AS seq, 'set' || p_partkey % 400 AS id, p_partkey % 400 AS num,
   p_name || [' II', ' é', ''][p_size % 3 + 1] AS name, CASE WHEN p_partkey % 4 > 0 THEN CAST(2000 + p_size AS VARCHAR) END AS day FROM part),
n AS (SELECT *, {NORM.format('name')} AS alias, list_position(['en', 'de', 'fr', 'es', 'it'], lang) AS rank FROM s),
k AS (SELECT * FROM n WHERE rank > 0 AND id IN (SELECT id FROM n WHERE lang = 'en') QUALIFY row_number() OVER (PARTITION BY alias ORDER BY rank, CASE WHEN lang = 'en' THEN -seq ELSE seq END) = 1),
own AS (SELECT id, max(day) AS day FROM n WHERE lang = 'en' GROUP BY id)
SELECT alias, k.id AS set_id, name, coalesce(own.day, CASE WHEN num % 3 = 0 THEN 'detail ' || num END, CASE WHEN num % 2 = 0 THEN 'cache ' || num END) AS release_date, lang AS alias_lang FROM k LEFT JOIN own ON own.id = k.id""")
def set_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Set lists of several languages as one alias table, with release dates from details, then the cache."""
    p, num_ = tables.table(spark, d, "part"), F.col("p_partkey") % 400
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (F.col("p_size") % i + 1).cast("int"))
    ident = F.concat(F.lit("set"), num_.cast("string")).alias("id")
    sets = p.select(pick(("en", "en", "de", "fr", "es", "it", "pl"), 7).alias("lang"), F.col("p_partkey").alias("seq"), ident, F.concat("p_name", pick((" II", " é", ""), 3)).alias("name"), F.when(F.col("p_partkey") % 4 > 0, (2000 + F.col("p_size")).cast("string")).alias("releaseDate"))
    dates = lambda word, i: p.filter(num_ % i == 0).select(ident, F.concat(F.lit(word), num_.cast("string")).alias("release_date")).distinct()
    return feeds.set_aliases(sets, dates("detail ", 3), dates("cache ", 2))


@query(f"""WITH o AS (SELECT CASE WHEN l_partkey % 3 > 0 THEN 'S' || l_partkey % 50 END AS set_id, CASE WHEN l_orderkey % 2 = 0 THEN array_to_string(list_reverse(string_split(p_name, ' ')), ' ') ELSE p_name END AS set_name,
   lower(p_type) AS product_type, CASE WHEN p_size % 2 = 0 THEN 'de' ELSE 'en' END AS language, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS seq FROM lineitem JOIN part ON p_partkey = l_partkey),
g AS (SELECT *, coalesce(set_id, 'raw:' || array_to_string(list_sort(string_split({NORM.format('set_name')}, ' ')), ' ')) AS grp FROM o),
a AS (SELECT grp, product_type, language, arg_min({{'id': set_id, 'name': set_name}}, seq) AS f, count(*) AS n FROM g GROUP BY ALL),
k AS (SELECT *, f.id AS set_id, f.name AS set_name, {SLUG.format('f.name')} AS slug FROM a)
SELECT substr(slug, 1, 48) || '-' || product_type || '-' || language || '-' || substr(sha1(coalesce(set_id, 'raw:' || slug) || '|' || product_type || '|' || language), 1, 8) AS product_key, set_id, set_name, product_type, language, n FROM k""")
def product_groups(spark: SparkSession, d: str) -> DataFrame:
    """Offers grouped into products: by set where it is known, else by the sorted words of the name; the first offer names the product."""
    name = F.when(F.col("l_orderkey") % 2 == 0, F.array_join(F.reverse(F.split("p_name", " ")), " ")).otherwise(F.col("p_name"))
    rows = lines(spark, d).select(F.when(F.col("l_partkey") % 3 > 0, F.concat(F.lit("S"), (F.col("l_partkey") % 50).cast("string"))).alias("set_id"), name.alias("set_name"), F.lower("p_type").alias("product_type"), F.when(F.col("p_size") % 2 == 0, "de").otherwise("en").alias("language"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("seq"))
    return offers.group_products(rows).groupBy("product_key", "set_id", "set_name", "product_type", "language").agg(F.count("*").alias("n"))


KINDS = ("etb", "etb_pc", "booster_box", "booster_bundle", "upc", "case", "tin")


@query(f"""WITH p AS (SELECT p_partkey AS product_key, p_brand AS set_name, {list(KINDS)}[p_partkey % 7 + 1] AS product_type, ['en', 'de', 'ja'][p_partkey % 3 + 1] AS language FROM part)
SELECT *, row_number() OVER (PARTITION BY set_name ORDER BY coalesce(list_position({list(runs.TYPE_ORDER)}, product_type), 99), language, product_key) AS place FROM p""")
def products_in_set(spark: SparkSession, d: str) -> DataFrame:
    """Places of a set's products by type, unknown types last, then language."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int"))
    return runs.places_in_set(tables.table(spark, d, "part").select(F.col("p_partkey").alias("product_key"), F.col("p_brand").alias("set_name"), pick(KINDS).alias("product_type"), pick(("en", "de", "ja")).alias("language"))).withColumn("place", F.col("place").cast("long"))


# -- reports --------------------------------------------------------------------------


JUDGED_SQL = tables.SQL + ", " + FORM_SQL.removeprefix("WITH ") + f""", c AS (SELECT n.product_key, {REJECT_SQL} IS NULL AS ok FROM n),
j AS (SELECT offers.*, CASE WHEN ok THEN 'accepted' ELSE 'rejected' END AS outcome FROM offers JOIN c USING (product_key)) """


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Landed offers whose titles pass or fail the ladder of rejections."""
    return landed(spark, d).join(forms(spark, d).select("product_key", classify.rejection(F.col("norm"), F.col("title")).isNull().alias("accepted")), "product_key")


@query(JUDGED_SQL + "SELECT shop_key, outcome, count(*) AS n FROM j GROUP BY ALL")
def shop_check(spark: SparkSession, d: str) -> DataFrame:
    """Every shop's offers by outcome."""
    return runs.shop_reports(judged(spark, d))[0]


@query(JUDGED_SQL + "SELECT shop_key, product_key, CAST(total_dkk AS DOUBLE) AS total_dkk, row_number() OVER (PARTITION BY shop_key ORDER BY s1, s2, s3, s4) AS place FROM j WHERE outcome = 'accepted' QUALIFY place <= 25")
def shop_check_first(spark: SparkSession, d: str) -> DataFrame:
    """Every shop's first 25 accepted offers."""
    return num(runs.shop_reports(judged(spark, d))[1].select("shop_key", "product_key", "total_dkk", F.col("place").cast("long").alias("place")), "total_dkk")


@query("""SELECT o_orderkey, replace(format('{:,}', CAST(round(CAST(o_totalprice AS DECIMAL(18,2))) AS BIGINT)), ',', '.') || ' kr' AS whole, translate(format('{:,.2f}', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE)), ',.', '.,') || ' EUR' AS exact,
 day(o_orderdate) || '. ' || ['januar', 'februar', 'marts', 'april', 'maj', 'juni', 'juli', 'august', 'september', 'oktober', 'november', 'december'][month(o_orderdate)] || ' ' || year(o_orderdate) AS day FROM orders""")
def report_formats(spark: SparkSession, d: str) -> DataFrame:
    """Amounts and days of the orders as reports write them."""
    total = F.col("o_totalprice").cast(money.MONEY)
    return tables.table(spark, d, "orders").select("o_orderkey", money.whole(total).alias("whole"), money.exact(total, F.lit("EUR")).alias("exact"), money.long_date(F.col("o_orderdate")).alias("day"))


EURO = "translate(format('{{:,.2f}}', CAST({0} AS DOUBLE)), ',.', '.,') || ' ' || currency"


@query(SQL + f"""SELECT shop_key, country AS country_name, CASE WHEN verified THEN {EURO.format('ship')} || ' til Danmark' || coalesce(', fri fragt over ' || {EURO.format('free_over')}, '') WHEN assumed IS NULL THEN 'Oplyses ikke' ELSE 'Oplyses ikke. Antaget ' || CAST(assumed AS INT) || ' kr' END AS rule FROM shop""")
def shipping_texts(spark: SparkSession, d: str) -> DataFrame:
    """Each shop's shipping rule in words, and its country by name."""
    s = tables.shops(spark, d).join(tables.assumed_shipping(spark, d), "country", "left")
    return s.select("shop_key", runs.country_name(F.col("country")).alias("country_name"), money.shipping_rule_text(F.col("verified"), F.col("ship"), F.col("free_over"), F.col("currency"), F.col("assumed")).alias("rule"))


@query(SQL + """, c AS (SELECT product_key, list_sort(list(DISTINCT country)) AS l FROM dedup GROUP BY product_key)
SELECT product_key, CASE len(l) WHEN 1 THEN l[1] ELSE array_to_string(l[:-2], ', ') || ' og ' || l[-1] END AS countries FROM c""")
def country_prose(spark: SparkSession, d: str) -> DataFrame:
    """The countries that sell a product, as prose."""
    rows = landed(spark, d).groupBy("product_key").agg(F.array_sort(F.collect_set("country")).alias("_all"))
    return rows.select("product_key", money.countries_text(F.col("_all")).alias("countries"))


@query(f"SELECT p_partkey AS product_key, p_name || ' ' || p_type || ' (' || p_brand || ')' AS title, {SLUG.format('p_name')} || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '-uden-match' END AS slug FROM part")
def product_texts(spark: SparkSession, d: str) -> DataFrame:
    """Titles and slugs of products."""
    return tables.table(spark, d, "part").select(F.col("p_partkey").alias("product_key"), runs.product_title(F.col("p_name"), F.col("p_type"), F.col("p_brand")).alias("title"), runs.set_slug(F.col("p_name"), F.col("p_partkey") % 3 == 0).alias("slug"))


@query(SQL + """, s AS (SELECT l_orderkey AS order_key, l_suppkey AS shop_key, sum(CAST(l_quantity * 13 AS DECIMAL(18,2))) AS subtotal FROM lineitem GROUP BY ALL)
SELECT order_key, shop_key, CAST(CASE WHEN ship > 0 AND subtotal < free_over THEN free_over - subtotal END AS DOUBLE) AS lacking FROM s JOIN shop USING (shop_key)""")
def free_shipping_gap(spark: SparkSession, d: str) -> DataFrame:
    """What each shop's part of an order lacks to free shipping."""
    part = tables.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_key"), F.col("l_suppkey").alias("shop_key")).agg(F.sum((F.col("l_quantity") * 13).cast(money.MONEY)).alias("subtotal"))
    rows = part.join(tables.shops(spark, d), "shop_key").select("order_key", "shop_key", money.to_free_shipping(F.col("subtotal"), F.col("ship"), F.col("free_over")).alias("lacking"))
    return num(rows, "lacking")


# -- what users and runs store --------------------------------------------------------


@query("SELECT DISTINCT o_custkey AS user_id, CAST(o_orderkey AS VARCHAR) AS product_key FROM orders WHERE o_custkey % 9 > 0")
def watchlist_json(spark: SparkSession, d: str) -> DataFrame:
    """Watchlists read from JSON; malformed ones are empty."""
    own = tables.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.to_json(F.collect_list(F.col("o_orderkey").cast("string"))).alias("_all"))
    return feeds.parse_watchlist(own.select("user_id", F.when(F.col("user_id") % 9 == 0, "[oops").otherwise(F.col("_all")).alias("json")))


@query("""SELECT o_custkey AS user_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq, CAST(o_orderkey AS VARCHAR) AS product_key, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE o_orderkey % 7 END AS qty, round(o_totalprice, 2) AS cost
FROM orders WHERE o_custkey % 9 > 0""")
def holdings_json(spark: SparkSession, d: str) -> DataFrame:
    """Holdings read from JSON; a missing quantity is one, malformed lists are empty."""
    n = F.col("o_orderkey")
    own = F.struct(n.alias("n"), n.cast("string").alias("key"), F.when(n % 4 > 0, n % 7).cast("int").alias("qty"), F.round("o_totalprice", 2).alias("cost"))
    rows = tables.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.to_json(F.array_sort(F.collect_list(own))).alias("_all"))
    return feeds.parse_holdings(rows.select("user_id", F.when(F.col("user_id") % 9 == 0, "{}[").otherwise(F.col("_all")).alias("json")))


@query(SQL + """, fresh AS (SELECT * FROM offers WHERE NOT stale AND captured_at >= DATE '2001-06-01' AND shop_key % 4 <> 3), last AS (SELECT * FROM offers WHERE captured_at < DATE '2001-06-01' AND shop_key % 10 <> 7),
kept AS (SELECT shop_key, total_dkk FROM fresh UNION ALL SELECT shop_key, total_dkk FROM last WHERE shop_key NOT IN (SELECT shop_key FROM fresh))
SELECT shop_key, count(*) AS offers, CAST(sum(total_dkk) AS DOUBLE) AS total, true AS stale FROM kept GROUP BY shop_key""")
def last_good_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Two runs written as snapshots by shop, the later replacing the shops it has; then read."""
    fresh, last = _runs(spark, d)
    path = folder(spark, "last-good")
    for rows in (last, fresh):
        priced = offers.land_cost(rows, tables.shops(spark, d), tables.rates(spark), tables.assumed_shipping(spark, d))
        sinks.write_last_good(priced.select("shop_key", "product_key", "total_dkk"), path)
    got = sinks.read_last_good(spark, path).groupBy(F.col("shop_key").cast("long").alias("shop_key"), "stale").agg(F.count("*").alias("offers"), F.sum("total_dkk").alias("total"))
    return num(got, "total")


@query(SQL + """SELECT product_key, captured_at AS day, CAST(amount_dkk AS DOUBLE) AS dkk, shop_key, CASE WHEN stale THEN 1 ELSE 2 END AS run FROM offers WHERE year(captured_at) = 2001
QUALIFY row_number() OVER (PARTITION BY product_key, captured_at ORDER BY run DESC, amount_dkk, shop_key) = 1""")
def history_year(spark: SparkSession, d: str) -> DataFrame:
    """Observations of two runs appended to the log, compacted; one year of them read again, the later run's of each day."""
    path, schema = folder(spark, "history"), f"product_key long, day date, dkk {money.MONEY}, shop_key long, run int"
    rows = landed(spark, d).select("product_key", F.col("captured_at").alias("day"), F.col("amount_dkk").alias("dkk"), "shop_key", F.when(F.col("stale"), 1).otherwise(2).alias("run"))
    for run in (1, 2):
        history.append(rows.filter(F.col("run") == run), path)
    history.compact(spark, path, schema, 2001)
    return num(history.read(spark, path, schema, 2001), "dkk")


@query(SQL + """, fresh AS (SELECT shop_key, count(*) AS n FROM offers WHERE NOT stale AND captured_at >= DATE '2001-06-01' AND shop_key % 4 <> 3 GROUP BY shop_key),
last AS (SELECT shop_key, count(*) AS n FROM offers WHERE captured_at < DATE '2001-06-01' AND shop_key % 10 <> 7 GROUP BY shop_key)
SELECT 'products' AS part, CAST(product_key AS VARCHAR) AS key, len(list(shop_key)) AS n, CAST(sum(total_dkk) AS DOUBLE) AS value FROM dedup GROUP BY product_key
UNION ALL SELECT 'fx', currency, 1, CAST(any_value(factor) AS DOUBLE) FROM shop GROUP BY currency
UNION ALL SELECT 'log', CASE WHEN fresh.n > 0 THEN 'ok' WHEN last.n > 0 THEN 'stale' ELSE 'failed' END, count(*), CAST(sum(coalesce(fresh.n, last.n, 0)) AS DOUBLE) FROM shop LEFT JOIN fresh USING (shop_key) LEFT JOIN last USING (shop_key) GROUP BY 2
UNION ALL SELECT 'stats', 'offers', 1, CAST(count(*) AS DOUBLE) FROM dedup""")
def run_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A run's products, rates, log and counters written as files under one commit, and what readers find of each part."""
    path = folder(spark, "run")
    rows = deduped(spark, d)
    ranked = offers.ranked(rows).select("product_key", "rank", "shop_key", "total_dkk")
    log = offers.run_log(tables.shops(spark, d), *_runs(spark, d)).select("shop_key", "status", "count")
    counts = rows.agg(F.count("*").alias("offers"))
    sinks.write_run(path, ranked, tables.rates(spark), log, counts)
    part = lambda name, schema: sinks.read_run(spark, path, name, schema)
    products = sinks.unnest(part("products", f"product_key string, offers array<struct<rank:int,shop_key:long,total_dkk:{money.MONEY}>>"))
    one = lambda df, name, key, n, value: df.select(F.lit(name).alias("part"), key.alias("key"), n.cast("long").alias("n"), value.cast("double").alias("value"))
    by_product = products.groupBy("product_key").agg(F.count("*").alias("n"), F.sum("total_dkk").alias("v"))
    by_status = part("log", "shop_key long, status string, count long").groupBy("status").agg(F.count("*").alias("n"), F.sum("count").alias("v"))
    return (
        one(by_product, "products", F.col("product_key"), F.col("n"), F.col("v")).unionByName(one(part("fx", "currency string, factor double"), "fx", F.col("currency"), F.lit(1), F.col("factor")))
        .unionByName(one(by_status, "log", F.col("status"), F.col("n"), F.col("v"))).unionByName(one(part("stats", "offers long"), "stats", F.lit("offers"), F.lit(1), F.col("offers")))
    )
