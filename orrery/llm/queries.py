"""The queries of this subpackage: each applies one operator, with its parameters for production, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm.shared import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm import licenses

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs, licenses.train(docs))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from orrery.llm import bpe

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded="decoded", keep_text=False)
    return docs.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm import simhash

    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm import embeddings

    return embeddings.near_groups(table(spark, sf_dir, "embeddings"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm import warc

    path = warc.archive_folder(spark)
    warc.write(table(spark, sf_dir, "pages"), path)
    rows = warc.transactions(warc.read(spark, path))
    note = lambda k: F.regexp_extract(F.decode(F.col("metadata")[0]["payload"], "UTF-8"), f"(?m)^{k}: (-?[0-9]+)", 1)
    digest = F.when(F.col("capture.type") == "response", F.sha1("capture.payload")).otherwise(F.substring_index("capture.payload_digest", ":", -1))
    return rows.select(
        F.nullif(note("page"), F.lit("")).cast("long").alias("page_id"),
        F.col("capture.payload_bytes").alias("payload_bytes"),
        digest.alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        F.nullif(note("refers-to-page"), F.lit("")).cast("long").alias("refers_to"),
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm import decontaminate

    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm import lines

    return lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm import langid

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.predict(docs.select("doc_id", "text"), model, keep_text=False)
    return found.select("doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm import substrings

    found = substrings.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm import pii

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs), keep_text=False)
    place = lambda s: F.struct(F.array_position(F.array(*map(F.lit, pii.KINDS)), s["kind"]).alias("k"), s["start"].alias("s"), s["end"].alias("e"), s["kind"].alias("kind"))
    joined = lambda spans: F.array_join(F.transform(F.array_sort(F.transform(spans, place)), lambda s: F.concat_ws(":", s["kind"], s["s"].cast("string"), s["e"].cast("string"))), ",")
    every = F.concat("base", "added")
    count = lambda kind: F.size(F.filter(every, lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in pii.KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm import fim

    found = fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    digests = sha(F.col("output")).alias("output_sha256"), sha(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm import prefixes

    return prefixes.trie(table(spark, sf_dir, "conversations"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm import neighbours

    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_warc": """
            with p as (select page_id, coalesce(html, '') as h from pages),
            k as (select h, max(page_id) as top from p where octet_length(encode(h)) >= 1000 group by h)
            select page_id, cast(octet_length(encode(p.h)) as bigint) as payload_bytes, sha1(p.h) as payload_digest,
                case when top is null or top = page_id then 'response' else 'revisit' end as record_type,
                case when top <> page_id then top end as refers_to
            from p left join k on p.h = k.h""",
        "op12_prefixes": """
            with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) as k
                from conversations where conv_id is not null),
            b as (select distinct conv_id, cast(conv_id as varchar) as s from t),
            c as (select conv_id, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, len(s) + 1), lambda i: ascii(s[i])::ubigint)),
                lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)::ubigint[]), lambda r, i: case when r & 1 = 1 then xor(r >> 1, 3988292384::ubigint) else r >> 1 end)), 4294967295::ubigint) % 6 as h from b),
            r as (select c.conv_id, k, role, text from c join t on t.conv_id = c.conv_id - c.conv_id % 100 where k <= h
                union all select c.conv_id, k, role, text from c join t on t.conv_id = c.conv_id where k > h),
            s as (select c.conv_id, list({'role': role, 'text': text} order by k) filter (where k is not null) as seq from c left join r on r.conv_id = c.conv_id group by c.conv_id),
            q as (select conv_id, coalesce(seq, []) as seq from s),
            p as (select conv_id, len(seq) as n, d, seq[1:d] as node from (select conv_id, seq, unnest(range(0, len(seq) + 1)) as d from q)),
            g as (select node, d, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where n = d), '') as ends,
                case when d > 0 then (count(*) - 1) * length(node[d].text) else 0 end as own from p group by node, d),
            e as (select g.*, (select count(*) from g x where x.d = g.d + 1 and x.node[1:g.d] = g.node) as n_children from g),
            f as (select a.node, a.d, sum(case when e.n_children = 0 then 1 else 0 end) as n_leaves, sum(e.own) as saved_tokens
                from e, unnest(range(0, e.d + 1)) as u(a_d) join g a on a.d = u.a_d and a.node = e.node[1:u.a_d] group by a.node, a.d)
            select e.conv_id, e.d as depth, u.conv_id as parent_conv_id, e.n_convs, e.n_children, cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, sha256(e.ends) as ends_sha256
            from e join f on e.node = f.node and e.d = f.d left join g u on u.d = e.d - 1 and u.node = e.node[1:e.d - 1]""",
        "op9_substrings": """
            with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
            p as (select doc_id, words, unnest(range(1, len(words) + 1)) as k from w),
            s as (select doc_id, k, array_to_string(words[k:k + 12], ' ') as s from p where k + 12 <= len(words)),
            f as (select s, min(doc_id) as first from s group by s having count(distinct doc_id) > 1),
            g as (select distinct doc_id, k + unnest(range(0, 13)) as k from s join f using (s) where doc_id > first),
            r as (select p.doc_id, count(g.k) as n_removed, coalesce(string_agg(p.words[p.k], ' ' order by p.k) filter (where g.k is null), '') as kept
                  from p left join g on p.doc_id = g.doc_id and p.k = g.k group by p.doc_id)
            select w.doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
            from w left join r on w.doc_id = r.doc_id""",
    }
