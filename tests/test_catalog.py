"""Registered queries against their SQL twins on the smallest tables."""

import os

import pytest

import __spark_entry__ as E
import oracle

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
QUICK = ["auroc_by_category_with_mean", "detection_metrics_by_source", "object_score_stats", "percentiles_and_medians",
         "second_best_ratio", "knn_join", "coreset_bank", "voxel_centroid", "points_budget", "visible_cap",
         "seed_table", "category_differences", "record_keys", "log_error_lines", "density_clusters", "pose_selection"]


def test_every_sql_belongs_to_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(QUICK) <= set(E.oracle_sql())


def test_entry_runs(spark):
    assert E.entry(spark).count() > 0


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_sql(spark, name):
    assert oracle.compare(E.queries()[name](spark, SF), oracle.connect(SF), E.oracle_sql()[name]) is None
