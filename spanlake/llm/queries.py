"""The registered queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanlake.llm.common import table


def vocabulary(name: str) -> str:
    """The text of a public tokenizer's file, from the installed package."""
    import public_tokenizers

    from spanlake.llm.bpe import read_tokenizer

    return read_tokenizer(public_tokenizers.path(name))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.llm.langid import held_out, identify, train

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs), keep=("doc_id",))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.llm.pii import detect, train

    docs = table(spark, sf_dir, "documents")
    return detect(docs, train(docs))


def op4_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.llm.wavelet import write_and_read

    return write_and_read(spark, table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op5_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from spanlake.llm.knn import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.llm.mixing import mix

    mixed, _ = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.llm.license import scan

    return scan(table(spark, sf_dir, "documents")).drop("matches")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.llm.warc import write_and_read

    return write_and_read(spark, table(spark, sf_dir, "pages"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.llm.simhash import hexadecimal, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexadecimal("fp").alias("fingerprint"), "component_id")


def op10_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.llm.hnsw import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_bpe": op2_bpe,
    "op3_pii": op3_pii,
    "op4_wavelet": op4_wavelet,
    "op5_knn": op5_knn,
    "op6_mix": op6_mix,
    "op7_license": op7_license,
    "op8_warc": op8_warc,
    "op9_simhash": op9_simhash,
    "op10_hnsw": op10_hnsw,
}

ORACLE: dict[str, str] = {
    "op5_knn": """
        with v as (
            select vec_id, embedding::double[] as e from embeddings
            where vec_id is not null and embedding is not null and len(embedding) > 0
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
              and len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), s as (
            select q.vec_id as query_id, c.vec_id, list_cosine_similarity(q.e, c.e) as score
            from v q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e) where q.vec_id % 50 = 0
        ), r as (
            select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from s
        )
        select query_id, rank::int as rank, vec_id, score from r where rank <= 5
    """,
    "op8_warc": """
        with p as (select page_id, encode(coalesce(html, '')) as b from pages),
        d as (select page_id, octet_length(b) as payload_bytes, sha1(b) as h, min(page_id) over (partition by b) as first_id from p)
        select page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((((strpos('0123456789abcdef', substr(h, 1 + (5 * i) // 4, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(h, 2 + (5 * i) // 4, 1)) - 1)
                        >> (3 - (5 * i) % 4)) & 31), 1)), '') as payload_digest,
               case when page_id > first_id then 'revisit' else 'response' end as record_type,
               case when page_id > first_id then first_id end as refers_to
        from d
    """,
}
