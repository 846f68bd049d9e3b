"""Tables in the folder that all executors share, to cut lineage where a lost executor would cost much work."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from orrery.operators.lineage import ship  # noqa: F401  the operators send the package by it


def folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names; where none is named, one of our own if all runs on one machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="orrery-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder; shuffle files that only served to make it go at once.

    The table goes when the application ends.
    """
    spark, path = df.sparkSession, f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(clean, before)
    return spark.read.schema(df.schema).parquet(path)
