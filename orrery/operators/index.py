"""Index rows of document chunks, and their reconciliation with a vector store's points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from orrery.functions.text import embedding_text, fusion_key, uuid5

#: Fixed value: the namespace that chunk ids are derived in.
NAMESPACE = "5f3a9c1e-7b2d-4e8f-9a6c-1d0b4e7f2a83"


def payload(drafts: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """Index rows of drafts (document_id, drafts: an array of content, section_path, page_no, chunk_type)."""
    rows = drafts.select("document_id", F.posexplode("drafts").alias("k", "d")).select("document_id", (F.col("k") + 1).alias("seq_no"), "d.*")
    name = F.concat(F.lit("kbchunk:"), F.col("document_id"), F.lit(":"), F.col("seq_no"))
    return rows.select("*", uuid5(namespace, name).alias("id"), F.length("content").alias("char_count"), F.greatest(F.lit(1), F.floor(F.length("content") / 2).cast("int")).alias("token_count"), embedding_text(F.col("section_path"), F.col("content")).alias("embedding_text"))


def reconcile(chunks: DataFrame, points: DataFrame) -> DataFrame:
    """(kind, id): points without a chunk (orphan), chunks without a point (missing), chunks whose ids differ (stale), and without vector id."""
    own = chunks.select("id", F.when(F.col("vector_id").isNotNull(), fusion_key(F.col("vector_id"), F.col("id"))).alias("key"), fusion_key(F.col("id"), F.col("id")).alias("own"))
    there = points.select(fusion_key(F.col("chunk_id"), F.col("chunk_id")).alias("key"))
    kinds = [
        there.join(own, "key", "left_anti").select(F.lit("orphan").alias("kind"), F.col("key").alias("id")),
        own.where("key is not null").join(there, "key", "left_anti").select(F.lit("missing").alias("kind"), "id"),
        own.where("key is not null and key <> own").select(F.lit("stale").alias("kind"), "id"),
        own.where("key is null").select(F.lit("no vector id").alias("kind"), "id"),
    ]
    return kinds[0].unionAll(kinds[1]).unionAll(kinds[2]).unionAll(kinds[3])


def first_target(targets: DataFrame) -> DataFrame:
    """One row for each id of (id, reason, priority): the first by priority."""
    return targets.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("priority", "reason"))).where("n = 1").select("id", "reason")


def replace(index: DataFrame, fresh: DataFrame, by: str = "document_id") -> DataFrame:
    """The index with the documents of fresh replaced; to be written in one atomic overwrite."""
    return index.join(fresh.select(by).distinct(), by, "left_anti").unionByName(fresh)


def points(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Index rows with their vectors (id, embedding); raises if a row has none or several."""
    counted = rows.join(vectors.groupBy("id").agg(F.count("*").alias("n"), F.first("embedding").alias("embedding")), "id", "left")
    wrong = counted.where("n is null or n <> 1").limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0]['id']} has {wrong[0]['n'] or 0} vectors")
    return counted.drop("n")


def delete(index: DataFrame, by: str, *values: object) -> DataFrame:
    """The index without the points whose payload equals one of the values; points without that field stay."""
    return index.where(~F.coalesce(F.col(by).isin(*values), F.lit(False)))


def rebuilt(index: DataFrame, documents: DataFrame, drafts: DataFrame, vectors: DataFrame, longest: int = 500) -> tuple[DataFrame, DataFrame]:
    """(index, documents) after indexing the documents (document_id, error) that have drafts: those without an error replace
    their old points and are parsed, those with one keep them and are failed, with the error's first ``longest`` characters."""
    fine = documents.where("error is null").select("document_id")
    fresh = points(payload(drafts.join(fine, "document_id", "left_semi")), vectors)
    done = documents.withColumn("status", F.when(F.col("error").isNull(), "parsed").otherwise("failed")).withColumn("error", F.substring("error", 1, longest))
    kept = index.join(fine, "document_id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True), done


def check_dimension(vectors: DataFrame, vector: str = "embedding") -> int:
    """The one dimension of all vectors."""
    sizes = [r[0] for r in vectors.select(F.size(vector).alias("n")).distinct().limit(2).collect()]
    if len(sizes) != 1:
        raise ValueError(f"vectors have dimensions {sizes}")
    return sizes[0]
