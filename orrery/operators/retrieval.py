"""Hybrid retrieval for batches of queries.

Ranked lists are rows (query_id, doc_id, rank, score, retriever). A batch of queries is small beside the
corpus; it is broadcast only while ``spark.sql.autoBroadcastJoinThreshold`` allows (Spark decides), and
top-k windows keep no more than k rows a query and task before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.config import RagConfig
from orrery.operators.lineage import ship

#: Vectors and queries that meet in one task, and vectors and queries that are multiplied at once.
VECTORS, QUERIES, AT_ONCE, ASKED = 16_384, 8192, 1024, 2048
#: Pairs that one task of a scan of all scores tells, and queries whose scores go into one batch.
PAIRS, TOLD = 1 << 25, 64


def ranked(df: DataFrame, k: int, *order: Column, by: str = "query_id", out: str = "rank") -> DataFrame:
    """The first k rows of each query."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(out) <= k)


def keyword_matches(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, match_count, len): how many terms (query_id, term) each document holds, whatever their case.

    Terms that several queries share are looked for once: a document is matched against the distinct terms
    of the batch, and the hits are then joined to the queries.
    """
    wanted = terms.select("query_id", F.lower("term").alias("term")).where("term <> ''").distinct()
    hits = docs.select("doc_id", F.lower("text").alias("low"), F.length("text").alias("len")).join(wanted.select("term").distinct(), F.expr("contains(low, term)")).select("doc_id", "len", "term")
    return hits.join(wanted, "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("match_count"), F.min("len").alias("len"))


def keyword_top(docs: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    return ranked(keyword_matches(docs, terms), max(1, k), F.desc("match_count"), F.col("len"), F.col("doc_id"))


def unit(df: DataFrame, vector: str, out: str) -> DataFrame:
    """df with the unit vector of a column, computed once a row."""
    square = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return df.withColumn("norm", F.sqrt(square)).withColumn(out, F.transform(vector, lambda x: x.cast("double") / F.col("norm"))).drop("norm")


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, ud): unit vectors of the rows that have one."""
    rows = df.where(F.col(key).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    width = rows.select(F.min(F.struct(F.col(key).alias("k"), F.size("v").alias("n")))["n"].alias("n")).first()["n"]
    return unit(rows.where(F.size("v") == (width or 0)), "v", "ud").select(key, "ud")


def nearest(queries: DataFrame, docs: DataFrame, on: list[str], k: int, least: float = -2.0) -> DataFrame:
    """(query_id, doc_id, score, rank): of each query (on, query_id, uq) the k nearest documents (on, doc_id, ud) with equal ``on``, itself aside, from ``least`` on, by cosine with six decimals; ids are whole numbers.

    What is equal in ``on`` meets in one task as products of matrices of bounded size; k documents a query go on from there.
    """
    ship(docs.sparkSession)
    ids = (queries.schema["query_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString())
    side = lambda df, n, key, u: df.select(*on, F.lit(n).alias("side"), F.col(key).cast("long").alias("id"), F.col(u).alias("u"))
    met = side(queries, 0, "query_id", "uq").unionAll(side(docs, 1, "doc_id", "ud")).repartition(*on).sortWithinPartitions(*on, "side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        at, asked, best = None, [], None

        def told():
            if best is not None:
                q, j = np.nonzero(best[1] > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(best[0][q]), pa.array(best[2][q, j]), pa.array(best[1][q, j])], names=["query_id", "doc_id", "score"])

        for batch in batches:
            for x in (batch.slice(j, AT_ONCE) for j in range(0, batch.num_rows, AT_ONCE)):
                names = list(zip(*(x.column(c).to_pylist() for c in (*on, "side"))))
                edges = [0, *(j for j in range(1, len(names)) if names[j] != names[j - 1]), len(names)]
                for a, b in zip(edges, edges[1:]):
                    group, is_doc = names[a][:-1], names[a][-1]
                    if group != at:
                        yield from told()
                        at, asked, best = group, [], None
                    ids = x.column("id").to_numpy()[a:b]
                    u = x.column("u").slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)
                    if not is_doc:
                        asked.append((ids, u))
                        continue
                    if best is None and asked:
                        best = [np.concatenate([i for i, _ in asked]), np.full((n := sum(len(i) for i, _ in asked), k), -np.inf), np.zeros((n, k), np.int64)]
                        vectors, asked = np.concatenate([v for _, v in asked]), []
                    for c in range(0, len(best[0]) if best else 0, ASKED):
                        score = np.round(vectors[c : c + ASKED] @ u.T, 6) + 0.0
                        score[(best[0][c : c + ASKED, None] == ids) | (score < least)] = -np.inf
                        # vectors come by id, so one that is as near as the k-th so far comes too late
                        better = np.flatnonzero(score.max(axis=1) > best[1][c : c + ASKED, -1])
                        both = np.concatenate([best[1][c + better], score[better]], axis=1)
                        order = np.argsort(-both, axis=1, kind="stable")[:, :k]
                        found = np.concatenate([best[2][c + better], np.broadcast_to(ids, (len(better), len(ids)))], axis=1)
                        best[1][c + better] = np.take_along_axis(both, order, axis=1)
                        best[2][c + better] = np.take_along_axis(found, order, axis=1)
        yield from told()

    found = met.mapInArrow(run, "query_id long, doc_id long, score double")
    found = found.select(F.col("query_id").cast(ids[0]).alias("query_id"), F.col("doc_id").cast(ids[1]).alias("doc_id"), "score")
    return ranked(found, k, F.desc("score"), F.col("doc_id"))


def vector_top(queries: DataFrame, docs: DataFrame, k: int, threshold: float) -> DataFrame:
    """The k documents (doc_id, embedding) nearest to each query (query_id, q) by cosine, those of the threshold and above.

    Every query of the batch meets every document, in blocks: an exact scan of the stated batch, not a join of the corpus with itself. Vectors without a cosine are left out.
    """
    left, right = usable(queries, "query_id", "q").withColumnRenamed("ud", "uq"), usable(docs, "doc_id", "embedding")
    chunks, parts = max(1, -(-left.count() // QUERIES)), max(1, -(-right.count() // VECTORS))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = left.withColumn("chunk", dealt("query_id", chunks)).withColumn("part", every(parts))
    return nearest(asked, right.withColumn("part", dealt("doc_id", parts)).withColumn("chunk", every(chunks)), ["chunk", "part"], k, threshold)


def scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): of each query (query_id, q) and each document (doc_id, embedding) with another id the cosine with six decimals; ids are whole numbers.

    Queries and documents meet in blocks of bounded size, as products of matrices; a block's scores go on in small batches and are never held together.
    Where a vector is null or empty, holds a null or has another length there is no score; where one is zero or not finite it is NaN.
    """
    ship(docs.sparkSession)
    n_queries, n_docs = queries.count(), docs.count()
    chunks = max(1, -(-n_queries // QUERIES))
    parts = max(1, -(-n_docs // VECTORS), min(n_docs // AT_ONCE, -(-n_queries * n_docs // (PAIRS * chunks))))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def side(df: DataFrame, is_doc: bool, key: str, vector: str, chunk: Column, part: Column) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        rows = df.select(F.lit(is_doc).alias("is_doc"), F.col(key).cast("long").alias("id"), F.when(~F.exists(v, F.isnull), v).alias("v"))
        square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
        rows = rows.withColumn("norm", F.sqrt(square)).select("is_doc", "id", F.transform("v", lambda x: F.when(F.col("norm") > 0, x / F.col("norm")).otherwise(float("nan"))).alias("u"))
        return rows.withColumn("chunk", chunk).withColumn("part", part)

    left = side(queries, False, "query_id", "q", dealt("id", chunks), every(parts))
    right = side(docs, True, "doc_id", "embedding", every(chunks), dealt("id", parts))
    met = left.unionAll(right).withColumn("block", F.col("chunk") * parts + F.col("part")).select("block", "is_doc", "id", "u")
    met = met.repartitionById(chunks * parts, F.col("block")).sortWithinPartitions("block", "is_doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        at, asked, meets = None, [], None
        for batch in batches:
            for x in (batch.slice(j, AT_ONCE) for j in range(0, batch.num_rows, AT_ONCE)):
                kinds = x.column("block").to_numpy().astype(np.int64) * 2 + x.column("is_doc").to_numpy(zero_copy_only=False)
                edges = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
                for a, b in zip(edges, edges[1:]):
                    block, is_doc = divmod(int(kinds[a]), 2)
                    if block != at:
                        at, asked, meets = block, [], None
                    ids, u = x.column("id").to_numpy()[a:b], x.column("u").slice(a, b - a)
                    if not is_doc:
                        asked.append((ids, u))
                    elif asked:
                        if meets is None:
                            vectors = pa.concat_arrays([v for _, v in asked])
                            meets = np.concatenate([i for i, _ in asked]), *_matrix(vectors, pc.max(vectors.value_lengths()).as_py() or 0)
                        own, m, widths = meets
                        d, sizes = _matrix(u, m.shape[1])
                        for c in range(0, len(own), TOLD):
                            score = m[c : c + TOLD] @ d.T * 1e6
                            score = np.trunc(score + np.copysign(0.5, score)) / 1e6 + 0.0
                            none = (widths[c : c + TOLD, None] != sizes) | (sizes <= 0)
                            told = (own[c : c + TOLD, None] != ids).ravel()
                            q, e = np.repeat(own[c : c + TOLD], len(ids)), np.tile(ids, len(score))
                            columns = [q, e, score.ravel(), none.ravel()]
                            q, e, score, none = columns if told.all() else [v[told] for v in columns]
                            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(e), pa.array(score, mask=none, from_pandas=False)], names=["query_id", "doc_id", "score"])

    found = met.mapInArrow(run, "query_id long, doc_id long, score double")
    ids = (queries.schema["query_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString())
    return found.select(F.col("query_id").cast(ids[0]).alias("query_id"), F.col("doc_id").cast(ids[1]).alias("doc_id"), "score")


def _matrix(vectors: pa.Array, width: int):
    """Vectors as rows that are filled up with zeros or cut to the width, and their own lengths, -1 for null."""
    import numpy as np

    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, n = vectors.flatten().to_numpy(zero_copy_only=False), np.maximum(sizes, 0)
    if len(n) and (n == width).all():
        return flat.reshape(len(n), width), sizes
    row, place = np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    out = np.zeros((len(n), width))
    out[row[place < width], place[place < width]] = flat[place < width]
    return out, sizes


def rrf(lists: list[tuple[DataFrame, str, float]], k: int = 60, top: int = 0) -> DataFrame:
    """Weighted reciprocal rank fusion of ranked lists (frame, retriever, weight); ties by who is seen first; top 0 cuts nothing."""
    rows = None
    for n, (df, name, weight) in enumerate(lists):
        part = df.select("query_id", "doc_id", "rank", (F.col("score") if "score" in df.columns else F.lit(None)).cast("double").alias("score"), F.lit(n).alias("list_no"), F.lit(name).alias("retriever"), F.lit(float(weight)).alias("weight"))
        rows = part if rows is None else rows.unionAll(part)
    place = F.struct("list_no", F.col("rank").cast("long").alias("rank"))
    fused = rows.where("doc_id is not null").groupBy("query_id", "doc_id").agg(
        F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 12).alias("rrf_score"),
        F.min(place).alias("first_seen"),
        F.min_by("score", F.when(F.col("score").isNotNull(), place)).alias("score"),
        F.array_join(F.sort_array(F.collect_set("retriever")), ",").alias("retrievers"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "first_seen")
    return ranked(fused, top, F.desc("rrf_score"), F.col("first_seen")) if top > 0 else fused.withColumn("rank", F.row_number().over(order))


def hybrid(docs: DataFrame, vectors: DataFrame, queries: DataFrame, terms: DataFrame, config: RagConfig) -> DataFrame:
    """Vector and keyword lists, fused; the vector list alone where hybrid is off."""
    near = vector_top(queries, vectors, config.vector_fetch_k, config.score_threshold)
    if not config.hybrid:
        return near
    lists = [(near, "vector", config.vector_weight), (keyword_top(docs, terms, config.keyword_top_k), "keyword", config.keyword_weight)]
    return rrf(lists, config.rrf_k, config.candidate_k if config.rerank else config.top_k)


def lexical_score(query: Column, content: Column) -> Column:
    """A deterministic stand-in for a rerank model: the share of the query's words that the content holds."""
    words = lambda c: F.split(F.lower(F.trim(c)), r"\s+")
    return F.round(F.size(F.array_intersect(words(query), words(content))) / F.size(F.array_distinct(words(query))), 6)


def parsed_results(responses: DataFrame) -> DataFrame:
    """(query_id, pos, index, relevance_score) of a rerank service's answers (query_id, body): the items of ``results``, or of ``output.results``, in either of its shapes.

    An index is a whole number and a score a number, as JSON has them: strings, booleans and fractions that stand for an index are dropped.
    """
    v = responses.select("query_id", F.try_parse_json("body").alias("v"))
    at = lambda path: F.try_variant_get("v", path, "array<variant>")
    items = v.select("query_id", F.posexplode(F.coalesce(at("$.results"), at("$.output.results"))).alias("pos", "item"))
    kind = lambda k: F.schema_of_variant(F.try_variant_get("item", f"$.{k}", "variant"))
    whole, number = kind("index") == "BIGINT", kind("relevance_score").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    rows = items.where(whole & number).select("query_id", "pos", F.try_variant_get("item", "$.index", "long").alias("index"), F.try_variant_get("item", "$.relevance_score", "double").alias("relevance_score"))
    return rows


def sanitized(results: DataFrame, n_hits: Column, threshold: float) -> DataFrame:
    """Rerank results (query_id, pos, index, relevance_score), as parsed_results() gives them, that are usable: the first of each valid index, if it reaches the threshold."""
    valid = results.withColumn("i", F.col("index").cast("int")).withColumn("s", F.col("relevance_score").cast("double")).where(F.col("i").isNotNull() & F.col("s").isNotNull() & (F.col("i") >= 0) & (F.col("i") < n_hits))
    first = valid.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "i").orderBy("pos"))).where("n = 1")
    return first.where(F.col("s") >= threshold).select("query_id", F.col("i").alias("index"), F.col("s").alias("rerank_score"))


def noop_reranked(hits: DataFrame) -> DataFrame:
    """The hits as they are, in their order, none cut."""
    return hits.withColumn("new_rank", F.col("rank"))


def containment(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(key, item): documents that hold an item's text literally.

    An item's words, its first and last aside, stand in the document between the same white space. Documents give the
    hash of each two neighbouring words, once; an item is sought by its longest two, and only documents that hold these are searched.
    Items of fewer than four words have no two inner ones: they meet all documents.
    """
    words = lambda c: F.split(c, r"[ \t\n\r\f\u000b]", -1)
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.struct(F.length(a) + F.length(b), F.xxhash64(a, b).alias("h")))
    inner = lambda w: F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0)))
    wanted = items.select(F.col(item), F.col(text).alias("wanted"), words(F.col(text)).alias("w")).where(F.col("wanted").isNotNull())
    anchored = wanted.where(F.size("w") >= 4).select(item, F.array_max(pairs(inner(F.col("w"))))["h"].alias("h"))
    keys = docs.select(key, F.explode(F.array_distinct(F.transform(pairs(words(F.col(text))), lambda p: p["h"]))).alias("h"))
    found = keys.join(anchored, "h").select(key, item)
    hit = F.expr(f"contains({text}, wanted)")
    long = found.join(docs.select(key, text), key).join(wanted.select(item, "wanted"), item).where(hit).select(key, item)
    short = docs.select(key, text).join(wanted.where(F.size("w") < 4).select(item, "wanted"), hit).select(key, item)
    return long.unionByName(short)


def reranked(hits: DataFrame, scores: DataFrame, top: int) -> DataFrame:
    """Hits (query_id, rank) by the scores of their ordinals; those without a score go."""
    joined = hits.join(scores.withColumn("rank", F.col("index") + 1).drop("index"), ["query_id", "rank"])
    return ranked(joined, max(1, top), F.desc("rerank_score"), F.col("rank"), out="new_rank")


def sources(hits: DataFrame, start: int = 0, snippet: int = 200) -> DataFrame:
    """The source rows of hits (query_id, rank, and what is known of the fields below), numbered as context() numbers them after ``start`` others."""
    known = lambda c, kind: (F.col(c) if c in hits.columns else F.lit(None)).cast(kind)
    named = lambda c: F.coalesce(known(c, "string"), F.lit("")).alias(c)
    text = known("content" if "content" in hits.columns else "text", "string")
    return hits.select(
        "query_id", (F.col("rank") + start).alias("index"), F.lit("knowledge").alias("type"), known("chunk_id", "string").alias("chunk_id"), known("document_id", "string").alias("document_id"), named("document_name"),
        known("knowledge_base_id", "string").alias("knowledge_base_id"), named("knowledge_base_name"), known("seq_no", "int").alias("seq_no"), known("score", "double").alias("score"), known("file_id", "string").alias("file_id"),
        F.substring(F.coalesce(text, F.lit("")), 1, snippet).alias("content"),
    )


def context(hits: DataFrame, content: str = "text", name: str = "document_name") -> DataFrame:
    """(query_id, context): numbered passages in rank order."""
    line = F.concat(F.lit("["), F.col("rank"), F.lit("]（来源："), F.coalesce(F.nullif(name, F.lit("")), F.lit("未知文档")), F.lit("）"), F.col(content))
    rows = hits.select("query_id", F.struct("rank", line.alias("line")).alias("p")).groupBy("query_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    return rows.select("query_id", F.array_join(F.transform("ps", lambda p: p["line"]), "\n\n").alias("context"))
