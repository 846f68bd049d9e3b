"""Tables in the shared folder, to cut lineage in loops of joins, and folders for indexes."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def place(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; on one machine without that setting, in a folder of our own. What is written there goes when the application ends."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="orrery-"))
        named = sc.getCheckpointDir()
    path = f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def cut(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = place(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def positions(df: DataFrame, *order: Column | str, out: str = "pos") -> DataFrame:
    """df with each row's place, from 1, in the order given. Rows are dealt by range, numbered within their range, and moved on by how many lie before it; no task sees them all."""
    dealt = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()))
    sizes = dealt.groupBy("range").agg(F.count("*").alias("n"))  # a row for each range
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return dealt.withColumn(out, within).join(sizes.select("range", before.alias("before")), "range").withColumn(out, F.col(out) + F.col("before")).drop("range", "before")


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the executors, once a session, for clusters where it isn't installed."""
    sc = spark.sparkContext
    if getattr(sc, "_orrery_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="orrery-")) / "orrery.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(top.rglob("*.py")):
            out.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(path))
    sc._orrery_shipped = True
