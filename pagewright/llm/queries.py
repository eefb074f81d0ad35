"""The ``opN_<name>`` queries, each an operator with production parameters over a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe_codec, chaining, langid, line_dedup, packing, secrets, sharding, simhash, vector_dedup
from .common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in shards of near equal bytes, tokens and rows."""
    dealt = sharding.shard(table(spark, sf_dir, "documents"), 40)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that repeat, exactly or nearly, across documents."""
    return chaining.passages(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learned from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    net = langid.fit(docs)
    said = langid.predict(docs.select("doc_id", "text"), net)
    return said.select("doc_id", F.coalesce(langid.fold_of() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in each document, by patterns and the random field."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document: its lines that are in a class with another line, their links, and those to remove."""
    docs = table(spark, sf_dir, "documents")
    found = line_dedup.duplicate_lines(docs)
    lines = found.groupBy("doc_id", "row").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(line_dedup.is_repeat("doc_id").cast("bigint")).alias("n_removed"),
        F.sum("n_links").alias("n_links"),
        F.sort_array(F.collect_list(F.struct("line", "class_id", "class_line"))).alias("classes"),
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"))
    joined = rows.join(lines.withColumnRenamed("doc_id", "id"), rows["doc_id"].eqNullSafe(F.col("id")) & (F.col("hash") == F.col("row")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return joined.select("doc_id", zero("n_lines"), zero("n_removed"), zero("n_links"), "classes")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each document and the bytes they decode to, as digests."""
    return bpe_codec.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors, by inner product, of each vector whose id is divisible by 20."""
    found = ann.search(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' token ids packed into sequences of at most 2048."""
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"))


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors with a cosine of at least 0.95."""
    return vector_dedup.link_vectors(table(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and their components."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_sharding, op2_passages, op3_language, op4_secrets, op5_line_dedup, op6_bpe, op7_nearest, op8_packing, op9_vector_dedup, op10_simhash)
    return {f.__name__: f for f in (*ops, pipeline)}


def oracle_sql() -> dict[str, str]:
    """None of the queries can be expressed in SQL; each has a brute-force test in tests/llm."""
    return {}
