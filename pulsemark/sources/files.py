"""Content-addressed file indexes and manifest audits."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsemark.sources.tables import read_by_header

ROW_BYTES = 256 << 20  # files up to this size are hashed as one value
CHUNK = 4 << 20  # bytes that a worker holds of a larger file


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content) of every file below ``path``; a file must fit one row."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return df.select("path", "content")


def _opened(path: str) -> pa.NativeFile:
    """A stream of the file, by Arrow's file systems (local and mounted folders, hdfs, s3, gs)."""
    from pyarrow import fs

    if re.match("^(file:)?/", path):
        return fs.LocalFileSystem().open_input_stream("/" + path.removeprefix("file:").lstrip("/"))
    system, name = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return system.open_input_stream(name)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            md5, sha256 = hashlib.md5(), hashlib.sha256()
            with _opened(path) as stream:
                while chunk := stream.read(CHUNK):
                    md5.update(chunk)
                    sha256.update(chunk)
            yield pa.RecordBatch.from_pydict({"path": [path], "md5": [md5.hexdigest()], "sha256": [sha256.hexdigest()]})


def file_digests(spark: SparkSession, path: str, glob: str = "*", row_bytes: int = ROW_BYTES) -> DataFrame:
    """(path, md5, sha256) of every file below ``path``, whatever its size; Spark's scan passes over files without a byte.

    Files of at most ``row_bytes`` are hashed by built-in functions; a worker streams a larger one in chunks.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    small = files.where(F.col("length") <= row_bytes).select("path", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > row_bytes).select("path")  # reads no content
    return small.unionByName(large.mapInArrow(_streamed, "path string, md5 string, sha256 string"))


def _digest(files: DataFrame, name: str) -> Column:
    """The digest column where ``files`` has one (``file_digests``), else that of its content."""
    if name in files.columns:
        return F.col(name)
    return F.md5("content") if name == "md5" else F.sha2("content", 256)


def hash_index(files: DataFrame) -> DataFrame:
    """(md5, path): the first path of each content wins; a minimum, so it combines map-side."""
    return files.groupBy(_digest(files, "md5").alias("md5")).agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("copies"))


def with_sha256(files: DataFrame) -> DataFrame:
    return files.select("path", _digest(files, "sha256").alias("sha256"))


def audit_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Listed files missing or changed, and files not listed.

    ``files`` and ``manifest`` have path and sha256.
    """
    both = manifest.select("path", F.col("sha256").alias("want")).join(files.select("path", F.col("sha256").alias("have")), "path", "full")
    status = (
        F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("have") != F.col("want"), "changed").otherwise("ok")
    )
    return both.select("path", status.alias("status"))


def categorised(files: DataFrame, pattern: str, name: str = "category") -> DataFrame:
    """Category from the path by the pattern's first group; files outside the layout are dropped."""
    out = files.withColumn(name, F.regexp_extract("path", pattern, 1))
    return out.where(F.col(name) != "")


def valid_index(index: DataFrame, excluded_maps: DataFrame, excluded_users: DataFrame, max_version: int) -> DataFrame:
    """Usable rows of a corpus index, one per file hash.

    Hex hashes, not failed, mode 0, known version, matching content hash, not
    empty, map and user not excluded.  ``index`` has file_hash, map_hash,
    content_hash, user, failed, mode, version, n_events.
    """
    hexes = F.col("file_hash").rlike("^[0-9a-f]{32}$") & F.col("map_hash").rlike("^[0-9a-f]{32}$")
    failed = F.lower(F.col("failed").cast("string")).isin("true", "1")
    good = index.where(
        hexes & ~failed & (F.col("mode") == 0) & (F.col("version") <= max_version)
        & (F.col("content_hash") == F.col("map_hash")) & (F.col("n_events") > 0)
    ).withColumn("user", F.lower("user"))
    left = good.join(excluded_maps.select("map_hash"), "map_hash", "left_anti").join(excluded_users.select("user"), "user", "left_anti")
    return left.groupBy("file_hash").agg(F.min(F.struct("map_hash", "user")).alias("b")).select("file_hash", "b.map_hash", "b.user")


def historical_ids(tables: dict[str, DataFrame], entities: dict[str, list[str]]) -> DataFrame:
    """Every id seen in any table, by entity, with its sources.

    ``entities`` maps an entity to the columns that may hold it; a table without them is passed over.
    """
    out = None
    for source, df in tables.items():
        found = [(e, c) for e, cols in entities.items() for c in cols if c in df.columns]
        if not found:
            continue
        pairs = F.array(*[F.struct(F.lit(e).alias("entity"), F.lower(F.col(c).cast("string")).alias("id")) for e, c in found])
        ids = df.select(F.explode(pairs).alias("p")).select("p.*").where("id IS NOT NULL").distinct().withColumn("source", F.lit(source))
        out = ids if out is None else out.unionByName(ids)
    # sources are table names, a short list per id
    return out.groupBy("entity", "id").agg(
        F.count_distinct("source").alias("source_count"), F.sort_array(F.collect_set("source")).alias("sources")
    )


def historical_ids_in(spark: SparkSession, path: str, entities: dict[str, list[str]], glob: str = "*.csv", source: str = "^(.*)$") -> DataFrame:
    """As ``historical_ids`` over all CSV files below ``path``, each read by its own header.

    ``source`` is a pattern whose first group names the source within a file's path.
    """
    wanted = sorted({c for columns in entities.values() for c in columns})
    rows = read_by_header(spark, path, wanted, glob).withColumn("source", F.regexp_extract("file_path", source, 1))
    pairs = F.array(*[F.struct(F.lit(e).alias("entity"), F.lower(F.col(c)).alias("id")) for e, columns in entities.items() for c in columns])
    ids = rows.select("source", F.inline(pairs)).where("id IS NOT NULL").distinct()
    return ids.groupBy("entity", "id").agg(
        F.count_distinct("source").alias("source_count"), F.sort_array(F.collect_set("source")).alias("sources")
    )
