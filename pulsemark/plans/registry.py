"""Registry of named queries and, where SQL can say the same, their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 9, **special: int) -> DataFrame:
    """Round every double column, so that summation order does not show."""
    out = []
    for f in df.schema.fields:
        d = special.get(f.name, digits)
        if f.dataType.simpleString() in ("double", "float"):
            out.append((F.round(F.col(f.name).cast("double"), d) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def rnd(expr: str, digits: int = 9) -> str:
    """SQL twin of ``rounded`` for one expression."""
    return f"(round(({expr})::DOUBLE, {digits}) + 0.0::DOUBLE)"


def col(name: str) -> Column:
    return F.col(name)
