"""Retrieval over documents (their source is the knowledge base), embeddings (vec_id stands for doc_id) and benchmark items as queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from orrery.config import RagConfig
from orrery.functions import text
from orrery.operators import contracts, retrieval, rewrite
from orrery.plans.base import query, table

TERMS = [(0, "the"), (0, "ing"), (50, "und"), (50, "sch"), (100, "ent"), (100, "que")]
TERMS_SQL = "(select * from (values " + ",".join(f"({a},'{b}')" for a, b in TERMS) + ") as q(query_id, term))"
MATCHES = f"""(select q.query_id, d.doc_id, count(*) as match_count, min(length(d.text)) as len
    from documents d join {TERMS_SQL} q on contains(lower(d.text), q.term) group by q.query_id, d.doc_id)"""
KEYWORD = f"""(select * from (select *, row_number() over (partition by query_id order by match_count desc, len, doc_id) as rank from {MATCHES}) where rank <= 8)"""
COSINES = """(select a.vec_id as query_id, b.vec_id as doc_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score
    from embeddings a join embeddings b on a.vec_id <> b.vec_id join documents d on d.doc_id = b.vec_id where a.vec_id % 50 = 0)"""
VECTOR = f"""(select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from {COSINES}) where rank <= 12 and score >= 0.3)"""
FUSED = f"""(select query_id, doc_id, round(sum(1.0e0 / (60 + rank)), 12) as rrf_score, min(struct_pack(l := list_no, r := rank)) as first_seen, max(score) as score,
    string_agg(distinct retriever, ',' order by retriever) as retrievers from (
    select query_id, doc_id, rank, score, 0 as list_no, 'vector' as retriever from {VECTOR} union all select query_id, doc_id, rank, null, 1, 'keyword' from {KEYWORD}) group by query_id, doc_id)"""
HYBRID = f"(select * from (select *, row_number() over (partition by query_id order by rrf_score desc, first_seen) as rank from {FUSED}) where rank <= 4)"


def _terms(spark):
    return spark.createDataFrame(TERMS, "query_id long, term string")


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    docs = e.select(F.col("vec_id").alias("doc_id"), "embedding").join(table(spark, sf, "documents").select("doc_id"), "doc_id", "left_semi")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), docs


@query(f"select query_id, doc_id, match_count, len from {MATCHES}")
def r2_keyword_match(spark, sf):
    return retrieval.keyword_matches(table(spark, sf, "documents"), _terms(spark))


@query(f"select query_id, doc_id, match_count, rank from {KEYWORD}")
def w3_keyword_top_k(spark, sf):
    return retrieval.keyword_top(table(spark, sf, "documents"), _terms(spark), 8).select("query_id", "doc_id", "match_count", "rank")


@query(f"select query_id, doc_id, score from {COSINES}")
def r5_vector_scan(spark, sf):
    return retrieval.scores(*_vectors(spark, sf))


@query(f"select query_id, doc_id, score, rank from {VECTOR}")
def w4_vector_top_k(spark, sf):
    return retrieval.vector_top(*_vectors(spark, sf), 12, 0.3)


@query(f"select query_id, doc_id, score from {VECTOR} where score >= 0.32")
def f8_similarity_threshold(spark, sf):
    return retrieval.vector_top(*_vectors(spark, sf), 12, 0.32).select("query_id", "doc_id", "score")


@query(f"select query_id, doc_id, rrf_score, score, retrievers, rank from {HYBRID}")
def r4_hybrid(spark, sf):
    queries, vectors = _vectors(spark, sf)
    out = retrieval.hybrid(table(spark, sf, "documents"), vectors, queries, _terms(spark), RagConfig())
    return out.select("query_id", "doc_id", "rrf_score", "score", "retrievers", "rank")


@query(f"""select query_id, doc_id, rrf_score, retrievers, row_number() over (partition by query_id order by rrf_score desc, first_seen) as rank from (
    select query_id, doc_id, round(sum(w / (60 + rank)), 12) as rrf_score, min(struct_pack(l := list_no, r := rank)) as first_seen, string_agg(distinct retriever, ',' order by retriever) as retrievers from (
    select query_id, doc_id, rank, 0 as list_no, 0.1e0 as w, 'vector' as retriever from {VECTOR} union all select query_id, doc_id, rank, 1, 10e0, 'keyword' from {KEYWORD}) group by query_id, doc_id)""")
def r3_rrf_fuse(spark, sf):
    queries, vectors = _vectors(spark, sf)
    lists = [(retrieval.vector_top(queries, vectors, 12, 0.3), "vector", 0.1), (retrieval.keyword_top(table(spark, sf, "documents"), _terms(spark), 8), "keyword", 10.0)]
    return retrieval.rrf(lists).select("query_id", "doc_id", "rrf_score", "retrievers", "rank")


@query(f"select query_id, doc_id, retrievers from {FUSED}")
def u5_label_union(spark, sf):
    queries, vectors = _vectors(spark, sf)
    lists = [(retrieval.vector_top(queries, vectors, 12, 0.3), "vector", 1.0), (retrieval.keyword_top(table(spark, sf, "documents"), _terms(spark), 8), "keyword", 1.0)]
    return retrieval.rrf(lists).select("query_id", "doc_id", "retrievers")


@query("""with m as (select doc_id, source, row_number() over (partition by source order by length(text) desc, doc_id) as rank from documents where source in ('src1', 'src2') and contains(lower(text), 'the'))
    select * from m where rank <= 5""")
def f7_kb_boundary(spark, sf):
    d = table(spark, sf, "documents").where(F.col("source").isin("src1", "src2") & F.lower("text").contains("the"))
    return retrieval.ranked(d.select("doc_id", "source", F.length("text").alias("n")), 5, F.desc("n"), F.col("doc_id"), by="source").select("doc_id", "source", "rank")


@query("""with t as (select item_id, text as t, regexp_replace(text, '[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)+', ' ', 'g') as r from benchmark),
    u as (select item_id, unnest(list_concat(regexp_extract_all(t, '[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)+'), regexp_extract_all(r, '[A-Za-z]{2,}'), regexp_extract_all(r, '[0-9]{2,}'))) as term,
        generate_subscripts(list_concat(regexp_extract_all(t, '[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)+'), regexp_extract_all(r, '[A-Za-z]{2,}'), regexp_extract_all(r, '[0-9]{2,}')), 1) as k from t),
    f as (select item_id, term, k from (select *, row_number() over (partition by item_id, lower(term) order by k) as n from u) where n = 1),
    o as (select item_id, term, row_number() over (partition by item_id order by k) as pos from f) select * from o where pos <= 8""")
def r1_keywords(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.posexplode(text.keywords(F.col("text"))).alias("pos", "term"))
    return b.select("item_id", "term", (F.col("pos") + 1).alias("pos"))


@query("select vec_id, lower(replace(printf('%08X-%04X', vec_id, label), '-', '')) as key from embeddings")
def r6_fusion_key(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("v", F.format_string("%08X-%04X", "vec_id", "label"))
    return e.select("vec_id", text.fusion_key(F.when(F.col("vec_id") % 2 == 0, F.col("v")).otherwise(F.lit("")), F.col("v")).alias("key"))


@query(f"""with h as (select query_id, doc_id, rank, d.text from {KEYWORD} k join documents d using (doc_id)),
    q as (select * from (values (0, 'the of and'), (50, 'und der die'), (100, 'le de que')) as q(query_id, q)),
    s as (select h.query_id, doc_id, rank, round(len(list_intersect(list_distinct(string_split_regex(lower(trim(q)), '\\s+')), list_distinct(string_split_regex(lower(trim(text)), '\\s+'))))::double
        / len(list_distinct(string_split_regex(lower(trim(q)), '\\s+'))), 6) as rerank_score from h join q on h.query_id = q.query_id),
    r as (select *, row_number() over (partition by query_id order by rerank_score desc, rank) as new_rank from s) select query_id, doc_id, rank, rerank_score, new_rank from r where new_rank <= 4""")
def r10_rerank(spark, sf):
    docs = table(spark, sf, "documents")
    hits = retrieval.keyword_top(docs, _terms(spark), 8).join(docs.select("doc_id", "text"), "doc_id")
    q = spark.createDataFrame([(0, "the of and"), (50, "und der die"), (100, "le de que")], "query_id long, q string")
    scores = hits.join(F.broadcast(q), "query_id").select("query_id", (F.col("rank") - 1).alias("index"), retrieval.lexical_score(F.col("q"), F.col("text")).alias("rerank_score"))
    return retrieval.reranked(hits, scores, 4).select("query_id", "doc_id", "rank", "rerank_score", "new_rank")


@query(f"""select k.query_id, k.rank, k.doc_id, coalesce(d.source, '') as document_name, l.quality from {KEYWORD} k left join documents d on d.doc_id = k.doc_id and d.source <> 'src3' left join labels l on l.doc_id = k.doc_id""")
def r11_enrichment(spark, sf):
    docs = table(spark, sf, "documents")
    top = retrieval.keyword_top(docs, _terms(spark), 8)
    out = top.join(docs.where("source <> 'src3'").select("doc_id", "source"), "doc_id", "left").join(table(spark, sf, "labels"), "doc_id", "left")
    return out.select("query_id", "rank", "doc_id", F.coalesce("source", F.lit("")).alias("document_name"), "quality")


@query(f"""select query_id, string_agg('[' || rank || ']（来源：' || coalesce(nullif(source, ''), '未知文档') || '）' || text, chr(10) || chr(10) order by rank) as context from {KEYWORD} k join documents d using (doc_id) group by query_id""")
def r12_context(spark, sf):
    docs = table(spark, sf, "documents")
    hits = retrieval.keyword_top(docs, _terms(spark), 8).join(docs.select("doc_id", F.col("source").alias("document_name"), "text"), "doc_id")
    return retrieval.context(hits)


@query(f"""select query_id, 10 + rank as idx, doc_id, source as document_name, substr(text, 1, 200) as content from {KEYWORD} k join documents d using (doc_id)""")
def r13_sources(spark, sf):
    docs = table(spark, sf, "documents")
    hits = retrieval.keyword_top(docs, _terms(spark), 8).join(docs, "doc_id")
    return hits.select("query_id", (F.col("rank") + 10).alias("idx"), "doc_id", F.col("source").alias("document_name"), F.substring("text", 1, 200).alias("content"))


@query("select source, count(*) - count(distinct text) as duplicates from documents group by source")
def r15_duplicate_contents(spark, sf):
    texts = table(spark, sf, "documents").groupBy("source", F.sha2("text", 256).alias("t")).agg(F.count("*").alias("n"))
    return texts.groupBy("source").agg((F.sum("n") - F.count("*")).alias("duplicates"))


@query("select doc_id, source from documents where source = 'src4' and contains(text, 'the') order by doc_id desc limit 10 offset 5")
def r16_keyword_browse(spark, sf):
    d = table(spark, sf, "documents").where((F.col("source") == "src4") & F.col("text").contains("the"))
    return d.orderBy(F.desc("doc_id")).offset(5).limit(10).select("doc_id", "source")


@query("""select d.doc_id, b.item_id from documents d join benchmark b on contains(d.text, b.text)""")
def j12_containment(spark, sf):
    return retrieval.containment(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query(f"select query_id, doc_id, rank as new_rank from {KEYWORD}")
def r8_noop_rerank(spark, sf):
    return retrieval.noop_reranked(retrieval.keyword_top(table(spark, sf, "documents"), _terms(spark), 8)).select("query_id", "doc_id", "new_rank")


@query("""with h as (select conv_id, max(turn) filter (where role = 'user') as last, count(*) as n from conversations group by conv_id)
    select c.conv_id, c.turn, h.n > 1 and (regexp_matches(c.text, '(这个|它|怎么办|呢[？?]?$|^那)')) as needs from conversations c join h on c.conv_id = h.conv_id where role = 'user'""")
def f11_rewrite_gate(spark, sf):
    c = table(spark, sf, "conversations")
    n = c.groupBy("conv_id").agg((F.count("*") - 1).alias("n"))
    return c.where("role = 'user'").join(n, "conv_id").select("conv_id", "turn", rewrite.needs_rewrite(F.col("text"), F.col("n")).alias("needs"))


@query("""select conv_id, turn, case when length(l) <= 200 then l end as line from (select conv_id, turn, nullif(trim(regexp_replace(coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')[1], ''), '^["'']+|["'']+$', '', 'g')), '') as l from conversations where role = 'assistant')""")
def x10_sanitized_rewrite(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'assistant'")
    return c.select("conv_id", "turn", rewrite.sanitized(F.col("text"), F.lit("a statement")).alias("line"))


BODIES = """(select doc_id, doc_id % 4 as n_hits, n_chars % 10 / 10.0e0 as score from documents)"""


@query(f"""select doc_id as query_id, cast(i as int) as index, s as rerank_score from (
    select doc_id, n_hits, unnest([0, 2, 0, 9]) as i, unnest([score, 0.9, 0.95, 1.0]) as s, unnest([0, 1, 2, 3]) as pos from {BODIES}) where i < n_hits and pos < 2 and s >= 0.3""")
def f14_rerank_results(spark, sf):
    """Answers in both shapes, with strings and booleans where numbers belong, an index that comes twice and one beyond the hits."""
    d = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 4).alias("n_hits"), (F.col("n_chars") % 10 / 10).alias("score"))
    items = F.concat(F.lit('[{"index": 0, "relevance_score": '), F.col("score").cast("string"), F.lit('}, {"index": "1", "relevance_score": 0.8}, {"index": 2, "relevance_score": 0.9}, {"index": 0, "relevance_score": 0.95}, {"index": true, "relevance_score": 1}, {"index": 1, "relevance_score": "0.7"}, {"index": 1.5, "relevance_score": 0.7}, {"index": 9, "relevance_score": 1}, 7]'))
    flat, nested = F.concat(F.lit('{"results": '), items, F.lit("}")), F.concat(F.lit('{"output": {"results": '), items, F.lit("}}"))
    body = F.when(F.col("doc_id") % 3 == 0, flat).otherwise(nested)
    results = retrieval.parsed_results(d.select(F.col("doc_id").alias("query_id"), body.alias("body"))).join(d.select(F.col("doc_id").alias("query_id"), "n_hits"), "query_id")
    return retrieval.sanitized(results, F.col("n_hits"), 0.3)


@query(f"""select query_id, 10 + rank as index, 'knowledge' as type, cast(doc_id as varchar) as document_id, coalesce(source, '') as document_name, lang as knowledge_base_id, '' as knowledge_base_name, cast(null as int) as seq_no,
    cast(match_count as double) as score, substr(text, 1, 200) as content from {KEYWORD} k join documents d using (doc_id)""")
def r13_source_rows(spark, sf):
    docs = table(spark, sf, "documents")
    top = retrieval.keyword_top(docs, _terms(spark), 8).join(docs, "doc_id").withColumnRenamed("source", "document_name").withColumnRenamed("lang", "knowledge_base_id").withColumnRenamed("match_count", "score").withColumnRenamed("doc_id", "document_id")
    return retrieval.sources(top, 10).drop("chunk_id", "file_id")


@query("""with t as (select item_id, text as t, regexp_replace(text, '[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)+', ' ', 'g') as r from benchmark),
    u as (select item_id, list_concat(regexp_extract_all(t, '[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)+'), regexp_extract_all(r, '[A-Za-z]{2,}'), regexp_extract_all(r, '[0-9]{2,}')) as l from t),
    v as (select item_id, unnest(l) as term, generate_subscripts(l, 1) as k from u),
    f as (select item_id, term, k from (select *, row_number() over (partition by item_id, lower(term) order by k) as n from v) where n = 1)
    select item_id, term, pos from (select item_id, term, row_number() over (partition by item_id order by k) as pos from f) where pos <= 6""")
def u8_lateral_terms(spark, sf):
    contracts.register(spark)
    table(spark, sf, "benchmark").createOrReplaceTempView("asked_items")
    return spark.sql("select item_id, t.term, cast(t.pos as long) as pos from asked_items, lateral query_terms(text, 6) t")


def _within(d, budget):
    """The rows (lang, n, doc_id, ...) that a budget for the longest of each lang may reach: of each length as many as what the longer ones leave has room for, and one more. No task sees a language."""
    sizes = d.groupBy("lang", "n").agg(F.count("*").alias("m"))  # a row for each length
    longer = Window.partitionBy("lang").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    room = sizes.withColumn("room", F.lit(budget) - F.coalesce(F.sum(F.col("n") * F.col("m")).over(longer), F.lit(0))).where("room >= 0").drop("m")
    some = d.join(room, ["lang", "n"]).withColumn("k", F.row_number().over(Window.partitionBy("lang", "n").orderBy("doc_id")))
    return some.where("n = 0 or k <= room div n + 1").drop("room", "k")


@query("""with r as (select lang, doc_id, length(text) as n, row_number() over (partition by lang order by length(text) desc, doc_id) as rank from documents where text is not null),
    s as (select *, sum(n) over (partition by lang order by rank) as used from r) select 0 as one, lang, doc_id, rank as n, cast(used as bigint) as used from s where rank = 1 or used <= 60000""")
def u9_context_budget(spark, sf):
    contracts.register(spark)
    d = table(spark, sf, "documents").where("text is not null")
    langs = d.select("lang").distinct().withColumn("query_id", F.xxhash64("lang"))
    d = _within(d.select("doc_id", "text", "lang", F.length("text").alias("n")), 60000)
    ranks = d.select("doc_id", "text", "lang", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc(F.length("text")), "doc_id")).alias("rank"))
    ranks.join(langs, "lang").select("query_id", "doc_id", "text", "rank").createOrReplaceTempView("ranked_hits")
    kept = spark.sql("select query_id, doc_id, n, used from within_budget(60000, table(ranked_hits) partition by query_id order by rank)")
    return kept.join(langs, "query_id").select(F.lit(0).cast("long").alias("one"), "lang", "doc_id", F.col("n").cast("long").alias("n"), "used")
