"""Readers of shop feeds, rates and set lists, all to one offer schema. Rows that don't fit are left out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import money, text

NESTED = "shop_key string, path string, page int, products array<struct<id:bigint,handle:string,title:string,variants:array<struct<title:string,price:string,available:boolean>>>>"
FLAT = "shop_key string, name string, permalink string, prices struct<price:string,currency_minor_unit:int,currency_code:string>, is_in_stock boolean, is_purchasable boolean, stock_availability struct<text:string>"
LISTING = "shop_key string, page_id bigint, url string, html string"
SETS = "id string, name string, releaseDate string"
OFFERS = "shop_key string, title string, url string, amount decimal(18,2), currency string, in_stock boolean"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the schema; lines that are no such JSON are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.filter(F.col("_corrupt").isNull()).drop("_corrupt")


def without_repeats(pages: DataFrame) -> DataFrame:
    """Pages (shop_key, path, page, products) before the first one of a feed path whose first product came already."""
    first = pages.withColumn("_first", F.col("products").getItem(0)["id"])
    again = F.row_number().over(Window.partitionBy("shop_key", "path", "_first").orderBy("page")) > 1
    seen = first.withColumn("_again", F.when(F.col("_first").isNotNull() & again, F.col("page")))
    stop = F.min("_again").over(Window.partitionBy("shop_key", "path"))
    return seen.withColumn("_stop", stop).filter(F.col("_stop").isNull() | (F.col("page") < F.col("_stop"))).drop("_first", "_again", "_stop")


def nested(pages: DataFrame, shops: DataFrame) -> DataFrame:
    """A row per variant with a positive price, of products with handle and title; a default variant has no name of its own."""
    rows = without_repeats(pages).select("shop_key", F.explode("products").alias("p")).filter((F.col("p.handle") != "") & (F.col("p.title") != ""))
    rows = rows.select("shop_key", "p", F.explode("p.variants").alias("v")).withColumn("amount", F.col("v.price").try_cast("double")).filter("amount > 0")
    name = F.trim(F.coalesce("v.title", F.lit("")))
    plain = (name == "") | F.lower(name).isin("default title", "default")
    rows = rows.join(shops.select("shop_key", "base_url"), "shop_key")
    url = F.concat(F.regexp_replace("base_url", "/+$", ""), F.lit("/products/"), F.col("p.handle"))
    return rows.select("shop_key", F.when(plain, F.col("p.title")).otherwise(F.concat_ws(" - ", "p.title", name)).alias("title"), url.alias("url"), "amount", F.lit(None).cast("string").alias("currency"), F.coalesce("v.available", F.lit(False)).alias("in_stock"))


def flat(rows: DataFrame, shops: DataFrame) -> DataFrame:
    """A row per product; prices come in minor units, two digits unless said otherwise."""
    amount = F.col("prices.price").try_cast("double") / F.pow(F.lit(10.0), F.coalesce("prices.currency_minor_unit", F.lit(2)))
    stock = F.coalesce(F.col("is_in_stock"), F.coalesce("stock_availability.text", F.lit("")) != "") & F.coalesce("is_purchasable", F.lit(True))
    return rows.withColumn("amount", amount).filter("amount > 0 and name <> '' and permalink <> ''").select("shop_key", F.col("name").alias("title"), F.col("permalink").alias("url"), "amount", F.col("prices.currency_code").alias("currency"), stock.alias("in_stock"))


@dataclass(frozen=True)
class Listing:
    """Patterns of a listing page: of ``blocks`` the first that occurs cuts the page, of the others the first that matches a block counts (group 1)."""

    blocks: tuple[str, ...] = (r'(?s)<div class="product-listing-item".*?</div>', r'(?s)<li class="product".*?</li>')
    title: tuple[str, ...] = (r'(?s)<a class="product-name"[^>]*>(.*?)</a>', r"(?s)<h3[^>]*>\s*<a [^>]*>(.*?)</a>", r"(?s)<a [^>]*>(.*?)</a>")
    href: tuple[str, ...] = (r'<a class="product-name" href="([^"]*)"', r'(?s)<h3[^>]*>\s*<a [^>]*?href="([^"]*)"', r'<a [^>]*?href="([^"]*)"')
    price: tuple[str, ...] = (r'(?s)<span class="(?:productSpecialPrice|price)">(.*?)</span>', r"(?s)^(.*)$")
    # Markers of goods that are out of stock.
    sold_out: tuple[str, ...] = ("udsolgt", "ikke paa lager", "ikke på lager", "sold out", "out of stock", "restordre", "forudbestilling")
    # Whether only entities with their semicolon are decoded.
    closed: bool = False


def listing(pages: DataFrame, patterns: Listing = Listing()) -> DataFrame:
    """(page_id, seq, title, url, amount, in_stock) of the blocks of pages (page_id, url, html) that have title, link and price."""
    def first(column: Column, candidates: tuple[str, ...]) -> Column:
        return F.coalesce(*(F.when(F.regexp_extract(column, p, 1) != "", F.regexp_extract(column, p, 1)) for p in candidates), F.lit(""))

    found = [F.regexp_extract_all("html", F.lit(p), F.lit(0)) for p in patterns.blocks]
    blocks = F.coalesce(*(F.when(F.size(x) > 0, x) for x in found))
    rows = pages.select("page_id", F.col("url").alias("_page"), F.posexplode(blocks).alias("seq", "_block"))
    clean = lambda c: F.trim(text.unescape(text.strip_tags(c), patterns.closed))
    words = F.lower(clean(F.col("_block")))
    rows = rows.select("page_id", "seq", clean(first(F.col("_block"), patterns.title)).alias("title"), first(F.col("_block"), patterns.href).alias("_href"), text.price_of(clean(first(F.col("_block"), patterns.price))).alias("amount"), (~words.rlike(text.alternatives(patterns.sold_out))).alias("in_stock"), "_page")
    return rows.filter((F.col("title") != "") & (F.col("_href") != "") & F.col("amount").isNotNull()).select("page_id", "seq", "title", text.absolute(text.unescape(F.col("_href"), patterns.closed), F.col("_page")).alias("url"), "amount", "in_stock")


def conform(rows: DataFrame, shops: DataFrame, captured_at: Column) -> DataFrame:
    """Offers of any reader in one form: decoded title, upper-case currency (the feed's, else the shop's), cents, day, not stale."""
    known = rows.join(shops.select("shop_key", "country", F.col("currency").alias("_own")), "shop_key")
    return known.select("shop_key", "country", F.trim(text.unescape(F.col("title"))).alias("title"), "url", F.round("amount", 2).cast(money.MONEY).alias("amount"), F.upper(F.coalesce("currency", "_own")).alias("currency"), "in_stock", captured_at.cast("date").alias("captured_at"), F.lit(False).alias("stale"))


def listed(pages: DataFrame, shops: DataFrame) -> DataFrame:
    """A row per block of listing pages with title, link and price, in the shop's own currency."""
    rows = listing(pages).join(pages.select("page_id", "shop_key").distinct(), "page_id")
    return rows.select("shop_key", "title", "url", "amount", F.lit(None).cast("string").alias("currency"), "in_stock")


READERS: dict[str, tuple[str, Callable[[DataFrame, DataFrame], DataFrame]]] = {"nested": (NESTED, nested), "flat": (FLAT, flat), "listing": (LISTING, listed)}


def read_feed(spark: SparkSession, kind: str, path: str, shops: DataFrame) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"no reader {kind!r}; there are {', '.join(sorted(READERS))}")
    schema, transform = READERS[kind]
    return transform(read_json(spark, path, schema), shops)


def unknown_shops(wanted: DataFrame, shops: DataFrame) -> DataFrame:
    """The keys (shop_key) that no shop has."""
    return wanted.select("shop_key").distinct().join(shops, "shop_key", "left_anti")


def select_shops(shops: DataFrame, keys: list[str] | None) -> DataFrame:
    """The shops of these keys; a key that no shop has is an error."""
    if not keys:
        return shops
    wanted = shops.sparkSession.createDataFrame([(k,) for k in keys], "shop_key string")
    unknown = [r[0] for r in unknown_shops(wanted, shops).collect()]
    if unknown:
        raise ValueError(f"unknown shops: {', '.join(sorted(unknown))}")
    return shops.filter(F.col("shop_key").isin(keys))


def observations(series: DataFrame) -> DataFrame:
    """(currency, period, value): each currency's last observation of a series with values as text; blank ones and NaN don't count."""
    value = F.col("value").try_cast("double")
    return series.withColumn("value", value).filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("currency").agg(F.max("period").alias("period"), F.max_by("value", "period").alias("value"))


def last_rates(series: DataFrame, cached: DataFrame | None = None, base: str = "DKK") -> DataFrame:
    """(currency, period, factor, stale): each currency's last observation as units per euro, turned to base currency per unit.

    ``series`` has currency, period and value as text; blank and NaN observations don't count. Without an
    observation of the base currency the cached rates (currency, period, value) stand in, flagged stale.
    """
    fresh = observations(series)
    rows = fresh.withColumn("stale", F.lit(False))
    if cached is not None:
        has = fresh.filter(F.col("currency") == base).select(F.lit(1).alias("_has"))
        rows = rows.join(has, F.lit(True), "left_semi").unionByName(cached.select("currency", "period", "value").withColumn("stale", F.lit(True)).join(has, F.lit(True), "left_anti"))
    euro = rows.groupBy().agg(F.max("period").alias("period"), F.coalesce(F.max("stale"), F.lit(False)).alias("stale")).select(F.lit("EUR").alias("currency"), "period", F.lit(1.0).alias("value"), "stale")
    both = rows.filter("currency <> 'EUR'").unionByName(euro)
    of_base = F.max(F.when(F.col("currency") == base, F.col("value"))).over(Window.partitionBy(F.lit(1)))  # a row per currency
    return both.withColumn("factor", F.when(F.col("value") > 0, (of_base / F.col("value"))).cast(money.FACTOR)).select("currency", "period", "factor", "stale")


def set_aliases(sets: DataFrame, details: DataFrame | None = None, cache: DataFrame | None = None, languages: tuple[str, ...] = ("en", "de", "fr", "es", "it")) -> DataFrame:
    """(alias, set_id, name, release_date, alias_lang) of set lists (lang, seq, id, name, releaseDate).

    Of equal English names the later set wins; other languages count for sets known in English, and the first writer
    of an alias stays. A missing release date comes from ``details``, then ``cache`` (id, release_date).
    """
    rank = F.array_position(F.array(*map(F.lit, languages)), F.col("lang"))
    rows = sets.withColumn("alias", text.normalise(F.col("name"))).filter("alias <> ''").withColumn("_rank", rank).filter("_rank > 0")
    english = rows.filter(F.col("lang") == "en")
    rows = rows.join(english.select("id").distinct(), "id", "left_semi")
    w = Window.partitionBy("alias").orderBy("_rank", F.when(F.col("lang") == "en", -F.col("seq")).otherwise(F.col("seq")))
    rows = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    dates = english.groupBy("id").agg(F.max("releaseDate").alias("_own"))
    rows = rows.join(dates, "id", "left")
    found = [F.col("_own")]
    for i, more in enumerate(x for x in (details, cache) if x is not None):
        rows = rows.join(more.select("id", F.col("release_date").alias(f"_more{i}")), "id", "left")
        found.append(F.col(f"_more{i}"))
    return rows.select("alias", F.col("id").alias("set_id"), "name", F.coalesce(*found).alias("release_date"), F.col("lang").alias("alias_lang"))


def cached_aliases(cache: DataFrame) -> DataFrame:
    """The alias table of a cache (id, name, release_date) alone, for runs without set lists: names as cached, no language. Of equal names the larger id wins."""
    rows = cache.withColumn("alias", text.normalise(F.col("name"))).filter("alias <> ''")
    last = rows.groupBy("alias").agg(F.max_by(F.struct("id", "name", "release_date"), "id").alias("r"))
    return last.select("alias", F.col("r.id").alias("set_id"), "r.name", "r.release_date", F.lit(None).cast("string").alias("alias_lang"))


def parse_watchlist(rows: DataFrame, column: str = "json") -> DataFrame:
    """(user_id, product_key) of JSON arrays of keys; malformed ones are empty."""
    return rows.select("user_id", F.explode(F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))).alias("product_key")).filter("product_key is not null").distinct()


def parse_holdings(rows: DataFrame, column: str = "json") -> DataFrame:
    """(user_id, seq, product_key, qty, cost) of JSON arrays of holdings; malformed ones are empty."""
    parsed = F.from_json(column, "array<struct<key:string,qty:int,cost:double>>")
    out = rows.select("user_id", F.posexplode(F.coalesce(parsed, F.array().cast("array<struct<key:string,qty:int,cost:double>>"))).alias("seq", "h"))
    return out.filter("h.key is not null").select("user_id", "seq", F.col("h.key").alias("product_key"), F.coalesce("h.qty", F.lit(1)).alias("qty"), "h.cost")
