"""An inverted index of titles by runs of letters, for substring search over many names at once.

Every run of one to three letters of a title points to its product. Postings lie in files by bucket of the run, sorted:
a search reads the buckets of its names' runs and no others. A name is looked up by all its runs of three
letters, the rarest first: its postings are the candidates, the other runs thin them out, and the titles left are
compared with the name itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
POSTINGS, TITLES = "bucket int, run string, product_key {key}", "product_key {key}, title string"


def _runs(word: Column, sizes: tuple[int, ...]) -> Column:
    """The distinct runs of these lengths."""
    of = lambda n: F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.length(word) - (n - 1)), lambda i: F.substring(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*map(of, sizes))))


def _bucket(run: Column) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(BUCKETS)).cast("int")


def write(index: DataFrame, path: str) -> None:
    """Writes the index of (product_key, title) under path; titles count in lower case, null ones not at all."""
    titles = index.select("product_key", F.lower("title").alias("title")).filter(F.length("title") > 0)
    rows = titles.select("product_key", F.explode(_runs(F.col("title"), (1, 2, 3))).alias("run")).withColumn("bucket", _bucket(F.col("run")))
    # salted by product, so that a run of very many titles is no hot range
    rows.repartitionByRange("bucket", "run", "product_key").sortWithinPartitions("bucket", "run", "product_key").write.partitionBy("bucket").parquet(f"{path}/postings")
    titles.write.parquet(f"{path}/titles")


def asked(names: DataFrame) -> DataFrame:
    """(name, bucket, run) that decide each name: all its runs of three letters, or a shorter name itself."""
    low = F.lower("name")
    rows = names.select("name").distinct().filter(F.length("name") > 0)
    found = rows.select("name", F.explode(F.when(F.length(low) < 3, F.array(low)).otherwise(_runs(low, (3,)))).alias("run"))
    return found.select("name", _bucket(F.col("run")).alias("bucket"), "run")


def postings(spark: SparkSession, path: str, wanted: DataFrame, key: str) -> DataFrame:
    """The postings of the runs wanted, from their buckets' files alone."""
    buckets = [r[0] for r in wanted.select("bucket").distinct().collect()]  # BUCKETS numbers at most
    return spark.read.schema(POSTINGS.format(key=key)).parquet(f"{path}/postings").filter(F.col("bucket").isin(buckets)).join(wanted.select("bucket", "run").distinct(), ["bucket", "run"])


def search(spark: SparkSession, path: str, names: DataFrame, key: str = "long") -> DataFrame:
    """(name, product_key) of all titles that contain a name, in either case. An empty or null name finds nothing."""
    wanted = asked(names)
    met = postings(spark, path, wanted, key)
    often = met.groupBy("run").agg(F.count("*").alias("often"))
    # a run that no title has leaves its name without any
    ranked = wanted.join(often, "run", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    first = ranked.groupBy("name").agg(F.min_by("run", F.struct("often", "run")).alias("run"), F.min("often").alias("least"), F.count("*").alias("runs")).filter("least > 0")
    close = first.join(met.select("run", "product_key"), "run").select("name", "product_key", F.col("run").alias("first"), "runs")
    rest = close.filter("runs > 1").join(wanted.select("name", "run"), "name").filter("run <> first").join(met.select("run", "product_key"), ["run", "product_key"])
    whole = rest.groupBy("name", "product_key", "runs").agg(F.count("*").alias("n")).filter("n = runs - 1").select("name", "product_key")
    titles = spark.read.schema(TITLES.format(key=key)).parquet(f"{path}/titles")
    found = whole.unionByName(close.filter("runs = 1").select("name", "product_key")).join(titles, "product_key")
    return found.filter(F.col("title").contains(F.lower("name"))).select("name", "product_key")
