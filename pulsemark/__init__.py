"""Timing-series analytics as Spark DataFrame operators."""
