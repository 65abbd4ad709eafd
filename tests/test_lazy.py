"""Building a registered query starts no Spark job but the reads of Parquet schemas."""

import uuid

import pytest
from pyspark.sql import DataFrameReader

from driver_queries import QUERIES

# Actions by nature: round trips through storage, and fits.
ACTIONS = {"scan_warehouse_tables", "stream_warehouse_tables", "topk_longest_encounters", "long_inpatient_stays", "impute_median", "impute_most_frequent", "standardise_features",
           "one_hot_categories", "encode_labels", "score_patients", "grid_search_forest", "cross_validate_forest", "cross_validate_boosted", "cross_validate_boosted_risk",
           "cross_validate_forest_risk", "grid_search_forest_risk",
           "train_forest_risk", "train_forest_readmission", "train_boosted_risk", "train_boosted_readmission"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ACTIONS))
def test_building_starts_no_job(spark, sf_small, monkeypatch, name):
    reads = []
    parquet = DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *a, **k: reads.append(a) or parquet(self, *a, **k))
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, name)
    try:
        QUERIES[name](spark, sf_small)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert len(jobs) <= len(reads)
