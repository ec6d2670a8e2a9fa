"""Every query against its SQL on the smallest tables; the split path on a part of them."""

import os

import pytest

from oracle import compare, connect
from pulsemark.operators import order_repair
from pulsemark.plans.catalog import ORACLE, QUERIES
from pulsemark.session import HOT_ROWS_CONF, STRETCH_ROWS_CONF

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")

# queries whose keys are split over partitions when every key counts as hot
SPLIT = [
    "k01_absolute_times", "k03_key_downs", "k08_reused_frames", "k10_series_preparation", "j02_optimal_match", "j05_first_fit_counts",
    "f01_residual_statistics", "f06_features_events", "f12_error_runs", "w03_block_placement", "w13_keep_order", "w14_retime",
    "c01_evenly_spaced", "r01_group_percentile", "r08_median_normalised", "r12_adjacent_independence", "m05_document_auc", "m07_group_auc",
    "m11_spearman_matrix", "b05_auc_bootstrap", "d02_diverse_sample", "t02_top_per_group", "a10_metric_distribution",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [q for q in QUERIES if q in ORACLE])
def test_matches_sql(spark, con, name):
    error, _ = compare(QUERIES[name](spark, SF), con, ORACLE[name])
    assert error is None, error


@pytest.mark.parametrize("name", SPLIT)
def test_split_path_matches_sql(spark, con, name, monkeypatch):
    monkeypatch.setattr(order_repair, "PER_STRETCH", 1)
    spark.conf.set(HOT_ROWS_CONF, "3")
    spark.conf.set(STRETCH_ROWS_CONF, "6")
    try:
        error, _ = compare(QUERIES[name](spark, SF), con, ORACLE[name])
    finally:
        spark.conf.unset(HOT_ROWS_CONF)
        spark.conf.unset(STRETCH_ROWS_CONF)
    assert error is None, error
