"""Plan shape: no Python UDFs, no cartesian products, top-k without a full sort."""

import pytest

from driver_queries import QUERIES

TRAINING = {"split_train_test", "impute_median", "standardise_features", "impute_most_frequent",
            "one_hot_categories", "encode_labels", "train_forest_risk", "train_forest_readmission",
            "train_boosted_risk", "train_boosted_readmission", "cross_validate_forest",
            "cross_validate_boosted", "cross_validate_boosted_risk", "cross_validate_forest_risk",
            "grid_search_forest", "grid_search_forest_risk", "score_patients", "regression_metrics", "scan_warehouse_tables",
            "stream_warehouse_tables"}
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TRAINING))
def test_no_python_or_cartesian(spark, sf_small, name):
    p = plan(QUERIES[name](spark, sf_small))
    for bad in FORBIDDEN:
        assert bad not in p, f"{name}: {bad}"
    for line in p.splitlines():
        if "Window [" in line:
            assert not line.rstrip().endswith(", []"), f"{name}: unpartitioned window"


@pytest.mark.parametrize("name", ["topk_cost_encounters", "topk_procedures", "topk_longest_encounters",
                                  "long_inpatient_stays"])
def test_topk_is_take_ordered(spark, sf_small, name):
    assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, sf_small))


def test_fanout_aggregate_does_not_join_raw_claims_to_encounters(spark, sf_small):
    # the weighted plan aggregates both sides before its joins
    p = QUERIES["cost_by_encounter_type"](spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
    first_join = p.index("Join")
    assert "Aggregate" in p[first_join:]


def test_no_collect_in_library():
    import pathlib
    root = pathlib.Path(__file__).resolve().parents[1] / "care_analytics"
    # The training-data operators (an optional part) use Arrow tasks and read back bounded rows; their tests are their own.
    for f in (f for f in root.rglob("*.py") if "llm" not in f.parts):
        text = f.read_text()
        for bad in (".collect()", ".toPandas()", "udf("):
            assert bad not in text, f"{f.name} uses {bad}"
