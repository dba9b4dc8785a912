"""The registered corpus queries, one thin function for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, quality_classifier, quality_rules, secret_scan, simhash, source_mixing, sql, token_alignment, token_output, topk_search, toxicity, vector_codes, warc
from .common import fresh_path, table
from .token_counts import count_tokens

#: Weights of sources in turn, the share of all words to take, and the most copies of a source (op9).
MIX = {"weights": [3, 1, 2], "share": 1.5, "cap": 2.0}


def vocabulary(name: str) -> bytes:
    """A public vocabulary file, read on the driver and sent with the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are labelled good and not toxic."""
    return table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").selectExpr("doc_id as id")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = warc.responses_from_pages(table(spark, sf_dir, "pages"), date="2024-01-01T00:00:00Z")
    return warc.derivatives(responses).withColumnRenamed("key", "page_id").withColumn("refers_to", F.col("response_id"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), limit=4096)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))
    return byte_bpe.encode(table(spark, sf_dir, "documents"), ranks)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(table(spark, sf_dir, "documents"), trusted_ids(spark, sf_dir))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id as id", "quality as label")
    return quality_classifier.classify(table(spark, sf_dir, "documents"), labels)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(table(spark, sf_dir, "documents"), **MIX)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "tokens")
    token_output.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json").decode(), end_id=2)
    return token_output.token_index(spark, path)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.link_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json").decode(), vocabulary("piece_bpe_32k.model"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter(~held_out).selectExpr("doc_id as id", "toxic as label")
    return toxicity.classify(table(spark, sf_dir, "documents"), labels).withColumn("held_out", held_out)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_token_counts": op2_token_counts,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_simhash": op4_simhash,
    "op5_quality_rules": op5_quality_rules,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_secret_scan": op7_secret_scan,
    "op8_topk_search": op8_topk_search,
    "op9_source_mixing": op9_source_mixing,
    "op10_token_output": op10_token_output,
    "op11_token_alignment": op11_token_alignment,
    "op12_toxicity": op12_toxicity,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL = {
    "op8_topk_search": sql.topk_sql(k=10, scale=1024, every=100),
    "op9_source_mixing": sql.mix_sql(**MIX, rounds=source_mixing.ROUNDS),
    "op13_vector_codes": sql.codes_sql(parts=vector_codes.PARTS, entries=vector_codes.ENTRIES, rounds=vector_codes.ROUNDS, scale=1024),
}
