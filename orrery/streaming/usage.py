"""Usage events as a stream: daily totals with late data, and idempotent appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.functions.measures import business_date


def events(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Files of events as they arrive. Their timestamps become instants, which watermarks need."""
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("tokens", F.get_json_object("props", "$.k").cast("long"))


def daily(rows: DataFrame, late: str = "15 minutes", zone: str = "Asia/Shanghai") -> DataFrame:
    """Totals by business day and type. An event that comes twice within the watermark counts once."""
    once = rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    day = F.window(F.from_utc_timestamp("ts", zone), "1 day")["start"].cast("date")
    return once.groupBy(day.alias("usage_date"), "event_type").agg(F.count("*").alias("calls"), F.sum("tokens").alias("total_tokens"))


def daily_batch(rows: DataFrame, zone: str = "Asia/Shanghai") -> DataFrame:
    """The same totals of a finite table."""
    return rows.groupBy(business_date(F.col("ts"), zone).alias("usage_date"), "event_type").agg(F.count("*").alias("calls"), F.sum("tokens").alias("total_tokens"))


def append_facts(rows: DataFrame, path: str, checkpoint: str):
    """Each micro-batch replaces its own partition, so a batch that runs again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
