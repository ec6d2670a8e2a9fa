"""Table readers: explicit schemas, strict headers, offset maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsemark.session import BROADCAST_ROWS, settle


def read_table(spark: SparkSession, path: str, fmt: str, schema: T.StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV, JSON, ORC or parquet with an explicit schema; only ``columns`` reach the scan."""
    reader = spark.read.format(fmt).schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "FAILFAST")
    if fmt == "json":
        reader = reader.option("mode", "FAILFAST")
    df = reader.load(path)
    return df.select(*columns) if columns else df


def file_headers(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file_path, header) of every CSV file below ``path``: its first line that isn't blank, as a list of names.

    One scan; a file's lines come in order within its first block, and the least of them is found map-side.
    """
    lines = _lines(spark, path, glob).where("start = 0").withColumn("at", F.monotonically_increasing_id())
    first = lines.groupBy("file_path").agg(F.min_by("value", "at").alias("line"))
    names = F.transform(F.split("line", ","), lambda c: F.trim(F.regexp_replace(c, r'^\s*"|"\s*$|^\ufeff', "")))
    return first.select("file_path", "line", names.alias("header"))


def _lines(spark: SparkSession, path: str, glob: str) -> DataFrame:
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    at = text.select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("start"))
    return at.where(F.trim("value") != "")


def read_by_header(spark: SparkSession, path: str, wanted: Sequence[str], glob: str = "*.csv") -> DataFrame:
    """(file_path, *wanted) as text from CSV files whose headers differ; a column that a file lacks is NULL.

    Every file is read by its own header. A line equal to its file's header is a header, also further down. Files without
    any wanted column are passed over. Records are lines: quoted fields hold commas and doubled quotes, but no line breaks.
    """
    heads = file_headers(spark, path, glob)
    places = [F.array_position("header", c).cast("int").alias(f"_{i}") for i, c in enumerate(wanted)]
    heads = settle(heads.select("file_path", "line", F.size("header").alias("width"), *places).where(" or ".join(f"_{i} > 0" for i in range(len(wanted)))))
    files, width = heads.agg(F.count(F.lit(1)), F.max("width")).first()
    lines = _lines(spark, path, glob).join(F.broadcast(heads) if files <= BROADCAST_ROWS else heads, "file_path").where("value != line")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width or 1)])
    cells = F.from_csv("value", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"escape": '"'})
    row = lines.select("file_path", *[f"_{i}" for i in range(len(wanted))], cells.alias("cells"))
    every = F.array(*[F.col("cells")[f"c{i}"] for i in range(width or 1)])
    return row.select("file_path", *[F.when(F.col(f"_{i}") > 0, F.try_element_at(every, F.col(f"_{i}"))).alias(c) for i, c in enumerate(wanted)])


def read_strict_csv(spark: SparkSession, path: str, schema: T.StructType, glob: str = "*.csv") -> DataFrame:
    """CSV files that must all have the declared header; a malformed row fails the read."""
    expected = F.array(*[F.lit(n) for n in schema.names])
    wrong = file_headers(spark, path, glob).where(F.col("header") != expected).select("file_path", "header").first()
    if wrong is not None:
        raise ValueError(f"{wrong.file_path} has the header {wrong.header}, not {schema.names}")
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("escape", '"')
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", glob).csv(path)


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(map_id, offset_ms) from a JSON object that is flat or nested under "offsets"."""
    text = spark.read.text(path, wholetext=True)
    whole = F.from_json("value", "map<string,string>")
    nested = F.from_json(F.try_element_at(whole, F.lit("offsets")), "map<string,string>")
    entries = F.coalesce(nested, whole)
    return text.select(F.explode(entries).alias("map_id", "v")).select("map_id", F.col("v").cast("int").alias("offset_ms"))


def read_offset_diagnostics(spark: SparkSession, path: str, fields: str) -> DataFrame:
    """One row per map from the "diagnostics" object, with ``fields`` as a DDL struct."""
    text = spark.read.text(path, wholetext=True)
    whole = F.from_json("value", f"struct<diagnostics:map<string,struct<{fields}>>>")
    return text.select(F.explode(whole["diagnostics"]).alias("map_id", "d")).select("map_id", "d.*")


def parse_bool(column: str):
    """TRUE/true/1/yes and their opposites; anything else is NULL."""
    text = F.lower(F.trim(F.col(column).cast("string")))
    return F.when(text.isin("true", "1", "yes"), True).when(text.isin("false", "0", "no"), False)
