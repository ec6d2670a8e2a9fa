"""Explicit schemas of the tables the operators exchange."""

from pyspark.sql import types as T

FRAMES = T.StructType(
    [
        T.StructField("series_id", T.StringType(), False),
        T.StructField("frame_idx", T.LongType(), False),
        T.StructField("time_delta_ms", T.LongType(), False),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("keys", T.IntegerType(), False),
    ]
)
PRESSES = T.StructType(
    [
        T.StructField("series_id", T.StringType(), False),
        T.StructField("press_idx", T.LongType(), False),
        T.StructField("press_ms", T.LongType(), False),
        T.StructField("frame_idx", T.LongType()),
    ]
)
NOTES = T.StructType(
    [
        T.StructField("series_id", T.StringType(), False),
        T.StructField("note_idx", T.LongType(), False),
        T.StructField("note_ms", T.LongType(), False),
    ]
)
RESIDUALS = T.StructType(
    [
        T.StructField("series_id", T.StringType(), False),
        T.StructField("note_idx", T.LongType(), False),
        T.StructField("residual", T.DoubleType()),
        T.StructField("frame_idx", T.LongType()),
    ]
)
