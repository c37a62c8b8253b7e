"""What a run writes: snapshots, results with nested offers, search index, basket data, log."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import money
from cairn.sources import commits


#: Runs that the log of last good snapshots holds before they are merged into one.
RUNS = 8


def write_last_good(offers: DataFrame, path: str) -> None:
    """Replaces the snapshots of the shops that have offers, and no others.

    Stored, they are a log: a run writes its rows as files of its own, as many as it has tasks and not one for each shop, and commits
    the list of runs that count; of each shop the last run with it does. More than ``RUNS`` are merged into one. What a merge has
    replaced goes at the next one, so that readers who have begun can end.
    """
    spark = offers.sparkSession
    state, folder = commits.current(spark, path), commits.new_folder(path)
    offers.write.parquet(folder)
    if spark.read.parquet(folder).isEmpty():
        return commits.drop(spark, folder)
    state = commits.commit(spark, path, {"live": [*(state.content["live"] if state else []), folder.rpartition("/")[2]]}, state)
    if len(state.content["live"]) > RUNS:
        merged = commits.new_folder(path)
        _last_runs(spark, path, state).write.parquet(merged)
        kept = {merged.rpartition("/")[2], *state.content["live"]}
        commits.commit(spark, path, {"live": [merged.rpartition("/")[2]]}, state)
        for name in commits.children(spark, path):
            if name.startswith("data-") and name not in kept:
                commits.drop(spark, f"{path}/{name}")


def _last_runs(spark: SparkSession, path: str, state: commits.Commit) -> DataFrame:
    """Of each shop the rows of the last run that has it; a run's shops are read from their column alone."""
    runs = [spark.read.parquet(f"{path}/{name}").withColumn("_run", F.lit(i)) for i, name in enumerate(state.content["live"])]
    rows = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)
    if len(runs) > 1:
        last = rows.groupBy(F.col("shop_key").alias("_shop")).agg(F.max("_run").alias("_last"))
        rows = rows.join(last, F.col("shop_key").eqNullSafe(F.col("_shop")) & (F.col("_run") == F.col("_last")), "left_semi")
    return rows.drop("_run")


def read_last_good(spark: SparkSession, path: str) -> DataFrame:
    """Each shop's last good snapshot, flagged stale."""
    state = commits.current(spark, path)
    if state is None:
        raise FileNotFoundError(f"no run is committed under {path}")
    return _last_runs(spark, path, state).withColumn("stale", F.lit(True))


def nest(offers: DataFrame) -> DataFrame:
    """Products with their ranked offers (product_key, rank, ...) as an array in order of rank."""
    own = [c for c in offers.columns if c not in ("product_key", "rank")]
    return offers.groupBy("product_key").agg(F.array_sort(F.collect_list(F.struct("rank", *own))).alias("offers"))


def unnest(products: DataFrame) -> DataFrame:
    return products.select("product_key", F.explode("offers").alias("o")).select("product_key", "o.*")


def write_result(offers: DataFrame, path: str) -> None:
    nest(offers).write.mode("overwrite").json(path)


def read_result(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return unnest(spark.read.schema(schema).json(path))


def write_run(path: str, offers: DataFrame, rates: DataFrame, log: DataFrame, counters: DataFrame) -> None:
    """A run's whole result as JSON under path: products with their ranked offers, rates, the log by shop, and counters.

    The parts lie in a folder of the run's own; readers see them, all at once, when the last is written and
    the run committed. Until then, and if the writer dies, they see the run before.
    """
    spark = offers.sparkSession
    state, folder = commits.current(spark, path), commits.new_folder(path)
    write_result(offers, f"{folder}/products")
    for name, rows in (("fx", rates), ("log", log), ("stats", counters)):
        rows.write.json(f"{folder}/{name}")
    commits.commit(spark, path, {"run": folder.rpartition("/")[2]}, state)


def read_run(spark: SparkSession, path: str, part: str, schema: str) -> DataFrame:
    """A part (products, fx, log or stats) of the run that was committed last. Products come as nested; see ``unnest``."""
    state = commits.current(spark, path)
    if state is None:
        raise FileNotFoundError(f"no run is committed under {path}")
    return spark.read.schema(schema).json(f"{path}/{state.content['run']}/{part}")


def basket_data(offers: DataFrame, shops: DataFrame, rates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shops with their published rates in base currency (null where none is), and products with their in-stock offers."""
    ok = F.coalesce("verified", F.lit(False)) & F.col("ship").isNotNull()
    base = lambda c: F.when(ok, money.convert(F.col(c), F.col("factor"))).alias(c)
    rules = shops.join(rates, "currency", "left").select("shop_key", "shop_name", "country", base("ship"), base("free_over"))
    kept = offers.filter(F.col("in_stock") & F.col("amount_dkk").isNotNull())
    items = kept.groupBy("product_key").agg(F.array_sort(F.collect_list(F.struct("seq", "shop_key", "amount_dkk"))).alias("o"))
    return rules, items.select("product_key", F.transform("o", lambda x: F.struct(x["shop_key"].alias("shop_key"), x["amount_dkk"].alias("amount_dkk"))).alias("offers"))
