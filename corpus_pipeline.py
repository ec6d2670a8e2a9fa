"""A corpus pipeline over ``documents``: language ID, near-dedup, decontamination, redaction, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and reread as the next
stage's documents. All but the last return the columns they were given.

Edge cases hold for every stage as the operators state them: null and blank texts are rejected by the first stage,
ties keep the smallest doc_id and of equal ids the first row, rows with a null or repeated doc_id are judged by their text
like all others, empty tables give empty results, and further columns are passed through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsemark.llm import decontaminate, langid, lsh_forest, packing, pii
from pulsemark.llm.common import crc_remainder, sized_join, staged, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
FOREIGN = 0.9  # mean out-of-place share from which on a text fits no language profile


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that have no letters or fit no language learnt from the table."""
    names = docs.columns
    taught = docs.where(crc_remainder("doc_id", 5) != 0).select("text", "lang")
    prefix = "_"  # columns named like a verdict of the model get free names meanwhile
    while any(n.startswith(prefix) for n in names):
        prefix += "_"
    held = {n: f"{prefix}{n}" for n in names if n.lower() in ("lang_pred", "score", "distance")}
    judged = langid.predict(docs.withColumnsRenamed(held), langid.learn(taught), keep=[held.get(n, n) for n in names])
    good = judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("distance") < FOREIGN))
    return good.select(*[F.col(held.get(n, n)).alias(n) for n in names])


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows with a number of their own, which null and repeated ids don't give, and its column; written, so that it stays."""
    name = "_row"
    while name in docs.columns:
        name = "_" + name
    return staged(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every group of near-duplicates (five-word shingles, similarity 0.8): the smallest doc_id, null last."""
    rows, row = numbered(docs)
    found = lsh_forest.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "component_id", "kept")
    found = staged(found, "components")
    groups = staged(found.where("not kept").select("component_id").distinct(), "groups")
    members = sized_join(found.select(row, "component_id"), groups, "component_id", "left_semi")
    members = staged(members.join(rows.select(row, "doc_id"), row), "members")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col(row).alias("r"))
    best = members.groupBy("component_id").agg(F.min(order).alias("b")).select(F.col("b.r").alias(row))
    gone = staged(members.select(row).join(best, row, "left_anti"), "dropped")
    return sized_join(rows, gone, row, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    rows, row = numbered(docs)
    found = decontaminate.find(rows.select(F.col(row).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = staged(found.select(F.col("doc_id").alias(row)).distinct(), "contaminated")
    return sized_join(rows, gone, row, "left_anti").select(*docs.columns)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; n_chars follows."""
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences; one row per piece."""
    return packing.pack(packing.token_pieces(docs, TOKENIZER))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("redaction", redaction),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None  # signatures, learned profiles and packing are beyond SQL; tests hold stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
