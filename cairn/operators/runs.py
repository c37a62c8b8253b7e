"""Reports on a run: counters, reasons of rejection, a shop's check, sets in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text

# Order of product types within a set.
TYPE_ORDER = ("etb", "etb_pc", "booster_box", "booster_bundle", "upc")


def outcome() -> Column:
    """rejected, no_rate (accepted, but its currency can't be converted) or accepted, of offers with accepted and amount_dkk."""
    return F.when(~F.col("accepted"), "rejected").when(F.col("amount_dkk").isNull(), "no_rate").otherwise("accepted")


def counters(offers: DataFrame) -> DataFrame:
    """One row: accepted, rejected, no_rate offers, and products without a matched set. Counts are before deduplication."""
    o = outcome()
    return offers.agg(F.count_if(o == "accepted").alias("accepted"), F.count_if(o == "rejected").alias("rejected"), F.count_if(o == "no_rate").alias("no_rate"), F.count_distinct(F.when((o == "accepted") & ~F.col("set_matched"), F.col("product_key"))).alias("unmatched"))


def rejections(offers: DataFrame, most: int = 20) -> DataFrame:
    """The most frequent reasons."""
    return offers.filter(~F.col("accepted")).groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(most)


def shop_reports(offers: DataFrame, most: int = 25) -> tuple[DataFrame, DataFrame]:
    """Of every shop: counts by outcome, and the first accepted offers in the feed's order, with their place."""
    first = offers.filter(outcome() == "accepted").withColumn("place", F.row_number().over(Window.partitionBy("shop_key").orderBy("seq")))
    return offers.groupBy("shop_key", outcome().alias("outcome")).agg(F.count("*").alias("n")), first.filter(F.col("place") <= most)


def shop_report(offers: DataFrame, shop_key: object, most: int = 25) -> tuple[DataFrame, DataFrame]:
    """Of one shop: counts by outcome, and the first accepted offers in the feed's order."""
    counts, first = shop_reports(offers.filter(F.col("shop_key") == F.lit(shop_key)), most)
    return counts.drop("shop_key"), first.orderBy("place").drop("place")


def shop_overview(log: DataFrame, shops: DataFrame, scores: DataFrame) -> DataFrame:
    """The run's log by shop name, with the shop's own columns and its statistics (shop_key, ...); what a shop lacks is null."""
    own = lambda df: df.select("shop_key", *(c for c in df.columns if c not in log.columns))
    out = log.join(own(shops), "shop_key", "left")
    more = scores.select("shop_key", *(c for c in scores.columns if c not in out.columns))
    return out.join(more, "shop_key", "left").orderBy("shop_name", "shop_key")


def newest_first(series: DataFrame) -> DataFrame:
    """Observations of a product (product_key, day, ...), the newest first."""
    return series.orderBy("product_key", F.desc("day"))


# Names of countries by code.
COUNTRIES = {"DK": "Danmark", "DE": "Tyskland", "NL": "Holland", "SE": "Sverige", "BE": "Belgien", "AT": "Østrig", "PL": "Polen", "FI": "Finland", "ES": "Spanien", "IT": "Italien", "FR": "Frankrig"}


def country_name(code: Column) -> Column:
    """The name of a country; a code without one stands for itself."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in COUNTRIES.items() for x in pair))[code], code)


def _set_order() -> list[Column]:
    return [F.desc("matched"), F.desc(F.coalesce("release_date", F.lit("0000-00-00"))), F.desc("offer_count"), F.col("set_name")]


def ordered_sets(sets: DataFrame) -> DataFrame:
    """Sets (matched, release_date, offer_count, set_name): matched first, the newest first, then those with most offers."""
    return sets.orderBy(*_set_order())


def set_places(sets: DataFrame) -> DataFrame:
    """Adds each set's place in that order, from 1. A list of sets has a row for each name, some hundreds: one task numbers them."""
    return sets.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*_set_order())))


def totals(sets: DataFrame, log: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: sets, matched sets, failed and stale shops, products in several shops."""
    one = sets.agg(F.count("*").alias("sets"), F.count_if("matched").alias("matched_sets"))
    two = log.agg(F.count_if(F.col("status") == "failed").alias("failed_shops"), F.count_if(F.col("status") == "stale").alias("stale_shops"))
    three = stats.agg(F.count_if(F.col("shop_count") > 1).alias("in_several_shops"))
    return one.crossJoin(F.broadcast(two)).crossJoin(F.broadcast(three))  # a row each


def type_place(kind: Column) -> Column:
    """Place of a product type within a set; unknown ones come last."""
    place = F.array_position(F.array(*map(F.lit, TYPE_ORDER)), kind)
    return F.when(place > 0, place).otherwise(F.lit(99).cast("long"))


def within_set(products: DataFrame) -> DataFrame:
    """Products of a set by type, unknown types last, then language."""
    return products.orderBy("set_name", type_place(F.col("product_type")), "language")


def places_in_set(products: DataFrame) -> DataFrame:
    """Adds each product's place within its set: by type, language, then product_key."""
    return products.withColumn("place", F.row_number().over(Window.partitionBy("set_name").orderBy(type_place(F.col("product_type")), "language", "product_key")))


def product_title(set_name: Column, type_label: Column, language_label: Column) -> Column:
    """Set Type (Language)"""
    return F.concat(set_name, F.lit(" "), type_label, F.lit(" ("), language_label, F.lit(")"))


def set_slug(set_name: Column, matched: Column) -> Column:
    return F.concat(text.slugify(set_name), F.when(matched, F.lit("")).otherwise(F.lit("-uden-match")))


def rebase(quotes: DataFrame, base: str = "DKK") -> DataFrame:
    """Quotes (currency, per_100: base currency for 100 units) as units per euro (currency, value)."""
    euro = quotes.filter("currency = 'EUR'").select((F.col("per_100") / 100).alias("_euro"))
    rows = quotes.filter("currency <> 'EUR' and per_100 > 0").join(euro).select("currency", (F.col("_euro") / (F.col("per_100") / 100)).alias("value"))
    return rows.unionByName(euro.select(F.lit(base).alias("currency"), F.col("_euro").alias("value"))).unionByName(euro.select(F.lit("EUR").alias("currency"), F.lit(1.0).alias("value")))
