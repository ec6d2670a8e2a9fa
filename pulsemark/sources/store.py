"""Incremental tables: replace by key, append unique, resume, reject split."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsemark.session import settle


def upsert(stored: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows whose key is not in the batch, then the batch (all its rows, also several per key)."""
    if stored.columns != batch.columns:
        raise ValueError(f"columns {batch.columns} differ from {stored.columns}")
    return stored.join(batch.select(*keys).distinct(), list(keys), "left_anti").select(*stored.columns).unionByName(batch)


def append_unique(stored: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """As ``upsert`` with one row per key: the batch row that is last in ``order`` wins."""
    rest = [c for c in batch.columns if c not in keys]
    last = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")
    return upsert(stored, last.select(*stored.columns), keys)


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def replace_buckets(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], buckets: int = 64) -> None:
    """Replace-by-key in a parquet table partitioned by key bucket.

    Only the buckets the batch touches are read, merged into the checkpoint folder
    and then swapped in by a dynamic partition overwrite: Spark's committer moves
    finished buckets into place at the end, one by one, and a failed write leaves
    the old ones.  A table that does not exist yet is created from the batch.
    """
    stamped = batch.withColumn("bucket", bucket_of(keys, buckets))
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stamped.write.partitionBy("bucket").parquet(path)
        return
    touched = [r["bucket"] for r in stamped.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    stored = spark.read.schema(stamped.schema).parquet(path).where(F.col("bucket").isin(touched))
    merged = settle(upsert(stored, stamped, keys))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append rows; a CSV target writes a header per part file, and doubles quotes within quotes."""
    writer = df.write.mode("append")
    (writer.option("header", True).option("escape", '"').csv(path) if fmt == "csv" else writer.format(fmt).save(path))


def completed_keys(
    results: DataFrame, key: str, children: Mapping[str, tuple[DataFrame, Column]], done: Sequence[str] = ("OK", "SKIP_CAPACITY")
) -> DataFrame:
    """Keys with a finished result row and all expected child rows; ERROR rows do not count.

    ``children`` maps a name to (table, completeness condition as an aggregate); a skipped
    unit needs no children.
    """
    status = results.groupBy(key).agg(F.max(F.col("status").isin(*done)).alias("_done"), F.max(F.col("status") == "SKIP_CAPACITY").alias("_skip"))
    out = status.where("_done")
    for name, (df, complete) in children.items():
        ok = df.groupBy(key).agg(complete.alias(f"_c_{name}"))
        out = out.join(ok, key, "left").where(F.col("_skip") | F.coalesce(F.col(f"_c_{name}"), F.lit(False)))
    return out.select(key)


def remaining(planned: DataFrame, completed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return planned.join(completed, list(keys), "left_anti")


def split_rejects(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejected rows with the first reason that applies."""
    reason = None
    for name, bad in rules.items():
        reason = F.when(bad, name) if reason is None else reason.when(bad, name)
    marked = df.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())
