"""An inverted-list index of vectors: trained centroids, lists of unit vectors stored by partition, several probes, exact scores.

Centroids come from spherical k-means over a bounded sample; every vector goes to the list of its nearest centroid, and the
index knows each list's radius, the largest angle between its centroid and a member. A query looks into the ``probes`` lists whose centroids are
nearest. With ``exact`` it also looks into every other list that may hold something better than its k-th hit so far: no member of a list is
nearer to the query than its centroid's angle less its radius. A list of many rows is stored in parts of about ``PART``.

Vectors that are null, empty, zero, not finite, or of another length than the first (by id) have no cosine here and are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.operators.lineage import ship
from orrery.operators.retrieval import nearest, ranked, usable

#: Vectors of the training sample for each list and in all, lists at most, rows of a part, and rounds of k-means.
PER_LIST, SAMPLE, LISTS, PART, ROUNDS = 64, 100_000, 4096, 50_000, 10


@dataclass(frozen=True)
class Index:
    """lists: (list, part, doc_id, ud). centroids: (list, centroid, radius, parts), at most LISTS rows."""

    lists: DataFrame
    centroids: DataFrame


def _matrix(column: pa.Array):
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def train(vectors: DataFrame, lists: int, key: str = "doc_id") -> list[tuple[int, list[float]]]:
    """(list, unit centroid) of at most ``lists`` lists, from a sample of the vectors with the lowest hashes."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    sample = vectors.orderBy(F.xxhash64(F.col(key), F.lit(1)), key).limit(min(SAMPLE, PER_LIST * lists)).select(array_to_vector("ud").alias("features"))
    if sample.isEmpty():
        return []
    found = KMeans(k=lists, seed=1, maxIter=ROUNDS, distanceMeasure="cosine").fit(sample).clusterCenters()
    lengths = [math.sqrt(sum(x * x for x in c)) or 1.0 for c in found]
    return [(j, [float(x) / n for x in c]) for j, (c, n) in enumerate(zip(found, lengths))]


def build(df: DataFrame, path: str, key: str = "doc_id", vector: str = "embedding", lists: int | None = None) -> Index:
    """Writes the index of df's vectors below path. As many lists as the square root of the rows by default."""
    ship(df.sparkSession)
    spark, vectors = df.sparkSession, usable(df, key, vector).withColumnRenamed(key, "doc_id")
    lists = min(LISTS, lists or max(2, math.isqrt(vectors.count())))
    centroids = train(vectors, lists)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        c = np.array([x for _, x in centroids])
        for x in (batch.slice(j, 1024) for batch in batches for j in range(0, batch.num_rows, 1024)):
            if x.num_rows:
                s = _matrix(x.column("ud")) @ c.T
                best = s.argmax(axis=1)
                angle = np.arccos(np.clip(s[np.arange(len(best)), best], -1, 1))
                yield pa.RecordBatch.from_arrays([x.column("doc_id"), x.column("ud"), pa.array(best.astype(np.int32)), pa.array(angle)], names=["doc_id", "ud", "list", "angle"])

    kind = vectors.schema["doc_id"].dataType.simpleString()
    rows = vectors.mapInArrow(assigned, f"doc_id {kind}, ud array<double>, list int, angle double")
    sizes = rows.groupBy("list").agg(F.max("angle").alias("radius"), F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    known = spark.createDataFrame(centroids, "list int, centroid array<double>").join(sizes, "list")
    known.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    known = spark.read.parquet(f"{path}/centroids")
    parted = rows.join(known.select("list", "parts"), "list").withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts").cast("int"))
    parted.select("doc_id", "ud", "part", "list").repartition("list", "part").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    return read(spark, path, kind)


def read(spark: SparkSession, path: str, kind: str = "long") -> Index:
    """The index below path, of documents whose ids are of the kind given."""
    lists = spark.read.schema(f"doc_id {kind}, ud array<double>, part int, list int").parquet(f"{path}/lists")
    return Index(lists, spark.read.parquet(f"{path}/centroids"))


def _routed(queries: DataFrame, index: Index, probes: int, beyond: bool) -> DataFrame:
    """(query_id, uq, list, part): the lists that each query looks into first or, with ``beyond``, those after them that may reach its floor."""
    known = [(r["list"], r["centroid"], r["radius"], r["parts"]) for r in index.centroids.orderBy("list").collect()]  # LISTS at most
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        c, radius = np.array([k[1] for k in known]), np.array([k[2] for k in known])
        lists, parts = np.array([k[0] for k in known], np.int32), [k[3] for k in known]
        for batch in batches:
            for x in (batch.slice(j, 256) for j in range(0, batch.num_rows, 256)):
                if not x.num_rows:
                    continue
                s = np.clip(_matrix(x.column("uq")) @ c.T, -1, 1)
                place = np.argsort(np.argsort(-s, axis=1, kind="stable"), axis=1)
                if beyond:
                    bound = np.cos(np.maximum(0, np.arccos(s) - radius))
                    i, j = np.nonzero((place >= probes) & (bound + 2e-6 >= x.column("floor").to_numpy()[:, None]))
                else:
                    i, j = np.nonzero(place < probes)
                repeat = np.array([parts[k] for k in j], np.int64)
                part = np.concatenate([np.zeros(0, np.int32), *(np.arange(n, dtype=np.int32) for n in repeat)]).astype(np.int32)
                at = pa.array(np.repeat(i, repeat))
                yield pa.RecordBatch.from_arrays([x.column("query_id").take(at), x.column("uq").take(at), pa.array(np.repeat(lists[j], repeat)), pa.array(part)], names=["query_id", "uq", "list", "part"])

    return queries.mapInArrow(run, f"query_id {kind}, uq array<double>, list int, part int")


def _scored(routed: DataFrame, index: Index, k: int) -> DataFrame:
    return nearest(routed, index.lists, ["list", "part"], k)


def search(queries: DataFrame, index: Index, k: int, threshold: float = -1.0, probes: int = 8, exact: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): of each query (query_id, q) the k documents nearest by cosine among the lists it looks into, itself aside, from the threshold on."""
    asked = usable(queries, "query_id", "q").withColumnRenamed("ud", "uq")
    if index.centroids.isEmpty():
        return asked.select("query_id", F.col("query_id").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    found = _scored(_routed(asked, index, probes, False), index, k)
    if exact:
        least = found.groupBy("query_id").agg(F.min(F.when(F.col("rank") == k, F.col("score"))).alias("least"))
        floors = asked.join(least, "query_id", "left").withColumn("floor", F.greatest(F.coalesce("least", F.lit(-2.0)), F.lit(float(threshold))) - 1e-6)
        more = _scored(_routed(floors.select("query_id", "uq", "floor"), index, probes, True), index, k)
        found = ranked(found.drop("rank").unionAll(more.drop("rank")), k, F.desc("score"), F.col("doc_id"))
    return found.where(F.col("score") >= threshold)
