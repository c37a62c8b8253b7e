"""Queries on the parts of a title's classification: candidate names, types, languages, brand, and retries of the join with set names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import classify
from cairn.plans.texts import NORM, TYPE_SQL, aliases, docs, words
from cairn.registry import query
from cairn.rules import titles as T
from cairn.sources import tables


def written(spark: SparkSession, d: str, endings: tuple[str, ...]) -> DataFrame:
    """(product_key, title, norm): the parts' names with one of the endings each."""
    end = F.element_at(F.array(*map(F.lit, endings)), (F.col("p_partkey") % len(endings) + 1).cast("int"))
    return tables.table(spark, d, "part").select(F.col("p_partkey").alias("product_key"), F.concat("p_name", end).alias("title")).withColumn("norm", text.normalise(F.col("title")))


def written_sql(endings: tuple[str, ...]) -> str:
    return f"WITH t AS (SELECT p_partkey AS product_key, p_name || {list(endings)}[p_partkey % {len(endings)} + 1] AS title FROM part), n AS (SELECT *, {NORM.format('title')} AS norm FROM t)"


NAMES = (" Elite Trainer Box vol 3", " 25 Jahre Booster Box", " sv03 Booster Bundle", " Pre-order Display 36 151", " EV04 EV05 Display (DE)", " S CHN Booster 30th", " UPC 2024 nr 7 8", " Booster Box", " kp08 & m3 Top-Trainer-Box", " 12 20 anniversary")
# words stand two blanks apart, so that neighbours don't share one
BARE = "regexp_replace(regexp_replace(regexp_replace(' ' || replace(norm, ' ', '  ') || ' ', ' pre *order ', '  ', 'g'), ' (" + T.SET_CODES + ") ', '  ', 'g'), ' [st] +(chn|chinese|chinesisch|chino) ', '  ', 'g')"


@query(written_sql(NAMES) + f""", w AS (SELECT product_key, list_filter(string_split_regex(trim({BARE}), ' +'), lambda x: x <> '' AND NOT list_contains({list(T.NOISE)}, x)) AS ws FROM n),
k AS (SELECT product_key, ws, list_filter(ws, lambda x, i: NOT regexp_full_match(x, '[0-9]+') OR coalesce(list_contains({list(T.ORDINAL_LEAD)}, ws[i - 1]), false) OR coalesce(list_contains({list(T.ORDINAL_TRAIL)}, ws[i + 1]), false)) AS kept FROM w)
SELECT product_key, array_to_string(CASE WHEN len(kept) > 0 THEN kept ELSE ws END, ' ') AS name FROM k""")
def set_candidates(spark: SparkSession, d: str) -> DataFrame:
    """What is left of titles as the set's name."""
    return written(spark, d, NAMES).select("product_key", classify.candidate(F.col("norm")).alias("name"))


KINDS = (" Elite Trainer Box", " Pokemon Center ETB", " PC ETB Display", " caja 36 sobres", " Booster Bundle Display", " UPC", " Sleeves", " 24 buste box", " Boosterdisplay 18", "")


@query(written_sql(KINDS) + f", k AS (SELECT product_key, norm, ({TYPE_SQL})[1] AS kind FROM n) SELECT product_key, CASE WHEN kind = '{T.ELITE_TYPE}' AND regexp_matches(norm, '{words(T.CENTER_WORDS)}') THEN '{T.CENTER_TYPE}' ELSE kind END AS product_type FROM k")
def title_type(spark: SparkSession, d: str) -> DataFrame:
    """The most specific type that a title names; an elite box of the centre is a type of its own."""
    return written(spark, d, KINDS).select("product_key", classify.product_type(F.col("norm")).alias("product_type"))


SPOKEN = (" Display", " (FR)", " - DE - Display", " [it] Booster", " ETB es", " Booster English", " Japansk (EN)", " (deluxe)", " | en", " de Booster")


@query(written_sql(SPOKEN) + f"""SELECT product_key, coalesce({', '.join(f"CASE WHEN regexp_matches(norm, '{words(t)}') THEN '{c}' END" for c, t in T.LANGUAGES)},
 nullif(lower(regexp_extract(title, '(?i)(?:[\\(\\[]\\s*|\\s[-–|/]\\s*)({'|'.join(T.CODES)})\\s*(?:[\\)\\]]|$|\\s[-–|/])', 1)), ''), CASE WHEN list_contains({list(T.CODES)}, string_split(norm, ' ')[-1]) THEN string_split(norm, ' ')[-1] END) AS language FROM n""")
def title_language(spark: SparkSession, d: str) -> DataFrame:
    """The language that a title declares: in words, by a tag, or by its last word."""
    return written(spark, d, SPOKEN).select("product_key", classify.language(F.col("norm"), F.col("title")).alias("language"))


def parts(terms: tuple[str, ...]) -> str:
    return f"len(list_filter({list(terms)}, lambda t: contains(norm, t))) > 0"


@query(f"WITH n AS (SELECT doc_id, {NORM.format('text')} AS norm FROM documents) SELECT doc_id, {parts(T.OTHER_GAMES)} AS other_game, {parts(T.BRAND)} AND NOT {parts(T.OTHER_GAMES)} AS of_brand, norm = '' AS blank FROM n")
def brand_gate(spark: SparkSession, d: str) -> DataFrame:
    """Texts that name another game, are of the brand, or blank."""
    norm = F.col("norm")
    return docs(spark, d).withColumn("norm", text.normalise(F.col("text"))).select("doc_id", text.has_part(norm, T.OTHER_GAMES).alias("other_game"), classify.of_brand(norm).alias("of_brand"), (norm == "").alias("blank"))


@query(f"""WITH a AS (SELECT DISTINCT {NORM.format('p_name')} AS alias FROM part)
SELECT CASE length(alias) % 3 WHEN 0 THEN 'sun moon ' || alias WHEN 1 THEN 'xy ' || alias ELSE alias END AS name, alias, 100 AS score, alias AS used FROM a""")
def series_retry(spark: SparkSession, d: str) -> DataFrame:
    """Names with a leading series find their set without it."""
    a = aliases(spark, d)
    n = F.length("alias") % 3
    return classify.match_series(a.select(F.when(n == 0, F.concat(F.lit("sun moon "), "alias")).when(n == 1, F.concat(F.lit("xy "), "alias")).otherwise(F.col("alias")).alias("name")), a)


@query(f"""WITH a AS (SELECT DISTINCT p_name, {NORM.format('p_name')} AS alias FROM part)
SELECT CASE length(alias) % 2 WHEN 0 THEN p_name || ' | Sword Shield' ELSE p_name || ' | Unheard Thing' END AS title, alias, 100 AS score, alias AS used FROM a WHERE length(alias) % 2 = 0 AND alias NOT LIKE 'new %'""")
def segment_retry(spark: SparkSession, d: str) -> DataFrame:
    """Titles of two parts find their set by one if the other is a series; another name beside it leaves them without, and so does a noise word in the part."""
    names = tables.table(spark, d, "part").select("p_name").distinct()
    title = F.concat("p_name", F.when(F.length(text.normalise(F.col("p_name"))) % 2 == 0, " | Sword Shield").otherwise(" | Unheard Thing"))
    rows = names.select(title.alias("title")).withColumn("name", text.normalise(F.col("title")))
    return classify.resolve(rows, aliases(spark, d))
