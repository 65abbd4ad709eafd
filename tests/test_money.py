import pytest
from pyspark.sql import functions as F

from care_analytics.functions.aggregates import audit_amounts, exact_sum, mean_money, sum_double
from care_analytics.operators import fanout


def total(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double").agg(sum_double("x").alias("s"), mean_money("x").alias("m")).first()


def test_small_amounts_are_not_lost(spark):
    r = total(spark, [0.00004] * 1000)
    assert r["s"] == 0.04 and r["m"] == 0.00004
    assert total(spark, [0.000001, 1e15, None])["s"] == 1e15 + 0.000001


def test_large_amounts_end_no_job(spark):
    assert total(spark, [1e15] * 1000)["s"] == 1e18
    r = total(spark, [1e25, float("inf"), float("nan"), 2.5])
    assert r["s"] == 2.5


def test_audit_counts_what_sums_round_or_leave_out(spark):
    df = spark.createDataFrame([(1.5, 1e25), (0.0000001, None), (None, float("inf")), (2.25, 3.0), (1e15, float("nan"))], "a double, b double")
    rows = {r["column"]: (r["amounts"], r["rounded"], r["rejected"]) for r in audit_amounts(df, "a", "b").collect()}
    assert rows == {"a": (4, 1, 0), "b": (4, 0, 3)}
    wide = {r["column"]: (r["amounts"], r["rounded"], r["rejected"]) for r in audit_amounts(df, "a", precision=38, scale=10).collect()}
    assert wide == {"a": (4, 0, 0)}
    assert audit_amounts(df.limit(0), "a").first()["amounts"] == 0


@pytest.mark.parametrize("amount", [0.000004, 1e15, 123456.654321])
def test_weighted_sums_equal_the_join(spark, amount):
    claims = spark.createDataFrame([("p", amount)] * 5 + [("q", amount * 2)], "patient_id string, total_amount double")
    encounters = spark.createDataFrame([("p", "t")] * 3 + [("p", "u")] * 2, "patient_id string, type_text string")
    fast, naive = (fanout.claim_encounter_cost(claims, encounters, "type_text", method=m) for m in ("weighted", "join"))
    assert sorted(map(tuple, fast.collect()), key=repr) == sorted(map(tuple, naive.collect()), key=repr)


def test_scale_is_a_parameter(spark):
    df = spark.createDataFrame([(0.123456789,)] * 3, "x double")
    assert df.agg(exact_sum("x", 38, 9).cast("double").alias("s")).first()["s"] == 0.370370367
    assert str(df.agg(exact_sum("x")).first()[0]) == "0.370371"
    assert df.filter(F.col("x") > 0).count() == 3
