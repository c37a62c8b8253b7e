"""Price history: a row per product and day, appended run by run.

Stored, it is a log: a run writes its own rows as files of new names, by year, and commits a list of the files that
count. Readers merge them by product and day, the latest run first; compaction puts one file list in a year's place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.sources import commits

#: Observations that a product's state holds: today's, and those of its trailing median.
RECENT = 8


def observe(stats: DataFrame) -> DataFrame:
    """Today's rows of product statistics with a day: item price, landed total, shop and stock of the cheapest offer; products without a price are left out."""
    c = "cheapest"
    return stats.filter(F.col(f"{c}.amount_dkk").isNotNull()).select("product_key", "day", F.col(f"{c}.amount_dkk").alias("dkk"), F.col(f"{c}.total_dkk").alias("total_dkk"), F.col(f"{c}.shop_key").alias("shop_key"), F.col(f"{c}.in_stock").alias("in_stock"))


def upsert(history: DataFrame, rows: DataFrame, by: str = "run") -> DataFrame:
    """Union of both with one row per product and day, that of the latest run. Rows of equal run go by price, then shop."""
    w = Window.partitionBy("product_key", "day").orderBy(F.desc(by), "dkk", "shop_key")
    return history.unionByName(rows).withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def series(history: DataFrame) -> DataFrame:
    """Per product: number of observations, first and last day, and prices in order of days; nulls are left out."""
    rows = history.filter(F.col("dkk").isNotNull())
    points = F.array_sort(F.collect_list(F.struct("day", "dkk")))
    return rows.groupBy("product_key").agg(F.count("*").alias("observations"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), points.alias("points"))


def _latest(points: Column, most: int) -> Column:
    """The latest points (day, dkk), the newest first."""
    return F.slice(F.reverse(F.array_sort(points)), 1, most)


def recent(history: DataFrame, most: int = RECENT) -> DataFrame:
    """(product_key, days, points): of each product the number of its observations and the latest of them, newest first; nulls are left out.

    Rows are unique by product and day, so that a product's year holds 366 at most; of each year the latest few go on. One shuffle, by product.
    """
    rows = history.filter(F.col("dkk").isNotNull()).select("product_key", F.year("day").alias("_year"), F.struct("day", "dkk").alias("_p")).repartition("product_key")
    years = rows.groupBy("product_key", "_year").agg(F.count("*").alias("_n"), _latest(F.collect_list("_p"), most).alias("_points"))
    return years.groupBy("product_key").agg(F.sum("_n").alias("days"), _latest(F.flatten(F.collect_list("_points")), most).alias("points"))


def merge_recent(state: DataFrame, more: DataFrame, most: int = RECENT) -> DataFrame:
    """``recent`` of both together, from ``recent`` of each; ``more`` holds none of the state's days."""
    both = state.unionByName(more)
    return both.groupBy("product_key").agg(F.sum("days").alias("days"), _latest(F.flatten(F.collect_list("points")), most).alias("points"))


def drops(state: DataFrame, least: float = 0.03, observations: int = 3) -> DataFrame:
    """Products of ``recent``'s rows whose last price is under the median of the observations before it by the share ``least``."""
    n = F.size("points") - 1
    prices = F.array_sort(F.transform(F.slice("points", 2, RECENT), lambda p: p["dkk"].cast("double")))
    middle = 0.5 * F.get("_before", F.floor((n - 1) / 2).cast("int")) + 0.5 * F.get("_before", F.floor(n / 2).cast("int"))
    rows = state.filter(F.col("days") >= observations).withColumn("_before", prices).withColumn("baseline", F.when(n > 0, middle)).withColumn("dkk", F.get("points", F.lit(0))["dkk"])
    change = (F.col("baseline") - F.col("dkk").cast("double")) / F.col("baseline")
    exact = F.col("baseline").cast("decimal(18,3)")
    kept = rows.filter(F.col("baseline") > 0).filter(change >= least)
    return kept.select("product_key", F.col("dkk").alias("today"), F.round(exact, 2).alias("baseline"), F.round(exact - F.col("dkk"), 2).alias("drop_dkk"), F.round(100 * change, 1).alias("drop_pct"), "days")


def price_drops(history: DataFrame, least: float = 0.03, observations: int = 3) -> DataFrame:
    """Products whose last price is under the median of up to seven observations before it by the share ``least``."""
    return drops(recent(history), least, observations)


def append(rows: DataFrame, path: str) -> None:
    """Commits rows (product_key, day, ..., run) to the log under path. Only their own files are written; an empty batch commits nothing."""
    spark, folder = rows.sparkSession, commits.new_folder(path)
    state = commits.current(spark, path)
    rows.withColumn("year", F.year("day")).write.partitionBy("year").parquet(folder)
    live = list(state.content["live"]) if state else []
    new = [[int(n.removeprefix("year=")), f"{folder.rpartition('/')[2]}/{n}"] for n in commits.children(spark, folder) if n.startswith("year=") and n[5:].isdigit()]
    if new:
        commits.commit(spark, path, {"live": live + new}, state)


def _live(spark: SparkSession, path: str, year: int | None) -> list[str]:
    state = commits.current(spark, path)
    return [f"{path.rstrip('/')}/{name}" for y, name in (state.content["live"] if state else []) if year is None or y == year]


def read(spark: SparkSession, path: str, schema: str, year: int | None = None) -> DataFrame:
    """The log's history, of one year or of all, one row per product and day: the latest run's. Files that can't be read are left out; if nothing is committed there are no rows."""
    files = _live(spark, path, year)
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(*files) if files else spark.createDataFrame([], schema)
    return upsert(rows, rows.limit(0))


def compact(spark: SparkSession, path: str, schema: str, year: int) -> int:
    """Puts one set of files in the place of a year's, and tells how many it replaces. Old files stay for readers that have begun; see ``vacuum``."""
    state = commits.current(spark, path)
    old = [e for e in state.content["live"] if e[0] == year] if state else []
    if len(old) > 1:
        folder = commits.new_folder(path)
        read(spark, path, schema, year).write.parquet(f"{folder}/year={year}")
        kept = [e for e in state.content["live"] if e[0] != year]
        commits.commit(spark, path, {"live": kept + [[year, f"{folder.rpartition('/')[2]}/year={year}"]]}, state)
    return len(old)


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes files that no longer count, those of writers that died among them, and tells the number of folders."""
    live = {tuple(name.split("/")) for _, name in commits.current(spark, path).content["live"]} if commits.current(spark, path) else set()
    gone = 0
    for folder in (n for n in commits.children(spark, path) if n.startswith("data-")):
        parts = [n for n in commits.children(spark, f"{path}/{folder}") if n.startswith("year=")]
        for part in parts:
            if (folder, part) not in live:
                commits.drop(spark, f"{path}/{folder}/{part}")
                gone += 1
        if not any((folder, p) in live for p in parts):
            commits.drop(spark, f"{path}/{folder}")
    return gone
