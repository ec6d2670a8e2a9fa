"""Session settings the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

HOT_ROWS_CONF = "spark.pulsemark.hotRows"
DEFAULT_HOT_ROWS = 5_000_000
STRETCH_ROWS_CONF = "spark.pulsemark.stretchRows"
DEFAULT_STRETCH_ROWS = 8192
TASK_ROWS = 1_000_000  # rows that a task sorts or combines by keys that hardly repeat
BROADCAST_ROWS = 1_000_000  # a narrow table counted to so few rows may be broadcast; a larger one is shuffled

# settings the plans are written for; set them on the cluster's session builder
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key also where that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
}


def hot_rows(spark: SparkSession) -> int:
    """Rows of one key above which its ordered work is split over partitions."""
    return int(spark.conf.get(HOT_ROWS_CONF, str(DEFAULT_HOT_ROWS)))


def stretch_rows(spark: SparkSession) -> int:
    """Rows of a stretch when one long island is worked on by many tasks."""
    return int(spark.conf.get(STRETCH_ROWS_CONF, str(DEFAULT_STRETCH_ROWS)))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows hashed by ``keys`` into partitions of about TASK_ROWS, so that what a task holds does not grow with the table.

    Meant for rows that are cheap to count, such as those of a file.
    """
    return df.repartition(max(partitions(df.sparkSession), -(-df.count() // TASK_ROWS)), *keys)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder the cluster names; fall back to a scratch folder in local mode only."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="pulsemark-ckpt-")
    sc.setCheckpointDir(named)
    return named


def settle(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
