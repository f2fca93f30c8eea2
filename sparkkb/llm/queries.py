"""Registered queries on training text, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkkb.llm import encode, neardup, packing, pairs, splitting, truncation
from sparkkb.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kid, forced): chunks above the limit, and whether one of their pieces had to be cut without a boundary."""
    return splitting.forced(table(spark, sf_dir, "knowledge_chunk"), "kid", "chunk_text")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kid, chunk_no, start_line, end_line, chunk_text): the pieces of chunks above the limit."""
    return splitting.pieces(table(spark, sf_dir, "knowledge_chunk"), "kid", "chunk_text", "start_line")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kid_a, kid_b): all pairs of chunks that share 60 % or more of their three-word sequences."""
    return neardup.Join(table(spark, sf_dir, "knowledge_chunk"), "kid", "chunk_text", width=3, threshold=0.6, least_words=20).pairs()


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kid, group_id, links): the group of each chunk that has another one alike, by the least kid in it, and the number of different texts it is alike to."""
    join = neardup.Join(table(spark, sf_dir, "knowledge_chunk"), "kid", "chunk_text", width=3, threshold=0.6, least_words=20)
    return join.groups().withColumnRenamed("id", "kid")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, defect): answers that are no proper reply to their question."""
    return pairs.judged(table(spark, sf_dir, "inference_result"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids): the token ids of each document."""
    return encode.Corpus(table(spark, sf_dir, "documents")).ids()


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): the text of each document again, from its token ids."""
    return encode.decode(p6_ids(spark, sf_dir))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, piece, n_tokens, container): documents in containers of 2,048 tokens."""
    return packing.containers(encode.Corpus(table(spark, sf_dir, "documents")).lengths())


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id): documents that were cut off."""
    return truncation.truncated(table(spark, sf_dir, "documents")).where("cut").select("doc_id")


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, texts, truncated, share): how often each source cuts its texts."""
    documents = table(spark, sf_dir, "documents")
    return truncation.by_source(truncation.truncated(documents), documents)


def queries() -> dict:
    return {f.__name__: f for f in (p3_found, p3_pieces, p4_found, p4_groups, p5_found, p6_ids, p6_decoded, p7_containers, p8_found, p8_sources)}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": r"""SELECT kid, CASE WHEN list_max(list_transform(regexp_split_to_array(chunk_text, '[ \t\n\r\x{a0}\x{3000}。！？；]'), lambda x: length(x))) > 819 THEN 1 ELSE 0 END AS forced
            FROM knowledge_chunk WHERE length(chunk_text) > 819""",
        "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
