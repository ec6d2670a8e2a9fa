"""Registered queries of this package: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsemark.llm import conversations, credentials, decontaminate, embed_dedup, html_extract, langid, lexical, licenses, lsh_forest, packing, pii, quality, warc
from pulsemark.llm.common import crc_remainder, staged_path, table
from pulsemark.llm.oracles import ORACLE

__all__ = ["ORACLE", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", crc_remainder("doc_id", 5) == 0)
    profiles = langid.learn(docs.where("not held_out").select("text", "lang"))
    return langid.predict(docs, profiles, keep=["doc_id", "held_out"])


@query
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"), words=4)


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces)


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", crc_remainder("doc_id", 4) == 2)
    known = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(crc_remainder("doc_id", 4) != 2)
    model = quality.learn(quality.sample(known, docs))
    scored = quality.scores(docs, model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


@query
def op8_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staged_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.digest_rows(warc.captures(warc.read_records(spark, path)))


@query
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


@query
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("hamming")



@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find(table(spark, sf_dir, "documents"))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    return conversations.report(said, conversations.damaged(said))


@query
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.find(table(spark, sf_dir, "documents"))


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
