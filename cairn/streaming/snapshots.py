"""Daily snapshots as a stream: each micro-batch of offers goes to history by product and day, so that a replay changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.operators import history, offers


def observe_batch(batch: DataFrame) -> DataFrame:
    """History rows of a batch of landed offers (with captured_at and run): per day the cheapest offer of each product."""
    days = batch.withColumn("_product", F.col("product_key")).withColumn("product_key", F.struct(F.col("captured_at").alias("day"), F.col("_product").alias("key")))
    stats = offers.statistics(offers.one_per_shop(days.drop("_product"))).withColumn("day", F.col("product_key.day")).withColumn("product_key", F.col("product_key.key"))
    return history.observe(stats)


def follow(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Reads new Parquet files of landed offers under source and appends their history to the log under target until all are in.

    A batch writes its own rows alone. One that is replayed writes them again under the same run: readers keep one row.
    """

    def put(batch: DataFrame, number: int) -> None:
        history.append(observe_batch(batch).withColumn("run", F.lit(number).cast("long")), target)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
