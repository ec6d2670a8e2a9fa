"""Imports every query module so that the registry is complete."""

from pulsemark.plans import cohort_queries, score_queries, series, summary_queries, timing, words  # noqa: F401
from pulsemark.plans.registry import ORACLE, QUERIES  # noqa: F401
