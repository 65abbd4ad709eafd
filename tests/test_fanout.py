"""The weighted rewrites equal the naive fan-out joins (the main property)."""

from pyspark.sql import functions as F

from care_analytics.operators import fanout
from care_analytics.plans import cost, disparities
from driver_queries.core import cost_inputs, encounter_patients_kept
from driver_queries.roles import DriverTables


def same(a, b, key):
    ra = sorted(a.collect(), key=lambda r: str(r[key]))
    rb = sorted(b.select(*a.columns).collect(), key=lambda r: str(r[key]))
    assert ra == rb


def test_claim_encounter_cost_small(spark):
    claims = spark.createDataFrame(
        [("a", 10.0), ("a", 5.5), ("b", 1.25), (None, 7.0), ("z", None), ("a", None)],
        "patient_id string, total_amount double")
    enc = spark.createDataFrame(
        [("a", "T1"), ("a", "T1"), ("a", "T2"), ("b", None), ("c", "T3")],
        "patient_id string, type_text string")
    for post in (None, lambda c: F.coalesce(c, F.lit("Others"))):
        w = fanout.claim_encounter_cost(claims, enc, "type_text", post=post)
        n = fanout.claim_encounter_cost(claims, enc, "type_text", post=post, method="join")
        same(w, n, "type_text")


def test_procedure_cost_small(spark):
    claims = spark.createDataFrame([("a", 10.0), ("a", None), ("b", 2.5), (None, 1.0)],
                                   "patient_id string, total_amount double")
    enc = spark.createDataFrame([("e1", "a"), ("e1", "a"), ("e2", "b"), ("e3", "c"), ("e4", None)],
                                "encounter_id string, patient_id string")
    procs = spark.createDataFrame([("e1", "X"), ("e1", "Y"), ("e2", "X"), ("e3", "Z"), (None, "X"),
                                   ("e4", None), ("e9", "W")],
                                  "encounter_id string, procedure_code_display string")
    w = fanout.procedure_claim_cost(procs, enc, claims)
    n = fanout.procedure_claim_cost(procs, enc, claims, method="join")
    same(w, n, "procedure_code_display")


def test_benefit_mean_small(spark):
    lines = spark.createDataFrame(
        [("b1", "p1", "A", 1.5), ("b1", "p1", "A", 2.0), ("b1", "p1", "B", None), ("b2", "p2", "A", 4.0),
         ("b3", "p9", "A", 8.0)],
        "eob_id string, patient_reference string, category_display string, value double")
    eob = spark.createDataFrame([("b1",), ("b1",), ("b1",), ("b2",), ("b3",)], "eob_id string")
    demo = spark.createDataFrame([("p1", "male", "Senior"), ("p1", "male", "Senior"), ("p2", "female", "Child")],
                                 "patient_reference string, gender string, age_group string")
    for keys in (["category_display"], ["category_display", "gender", "age_group"]):
        w = fanout.weighted_benefit_mean(lines, eob, demo, keys)
        n = fanout.weighted_benefit_mean(lines, eob, demo, keys, method="join")
        assert sorted(map(tuple, w.collect())) == sorted(map(tuple, n.select(*w.columns).collect()))


def test_rewrites_equal_naive_on_driver_tables(spark, sf_small):
    t = DriverTables(spark, sf_small)
    claims, encounters, _, procedures = cost_inputs(t)
    same(cost.cost_by_encounter_type(claims, encounters),
         cost.cost_by_encounter_type(claims, encounters, method="join"), "type_text")
    same(cost.cost_by_provider(claims, encounters),
         cost.cost_by_provider(claims, encounters, method="join"), "service_provider_display")
    same(cost.cost_by_procedure(procedures, claims, encounters),
         cost.cost_by_procedure(procedures, claims, encounters, method="join"), "procedure_code_display")
    kept = encounter_patients_kept(t)
    keys = ["category_display", "gender", "age_group", "marital_status"]
    w = disparities.benefit_by(t.eob(), kept, keys)
    n = disparities.benefit_by(t.eob(), kept, keys, method="join")
    assert sorted(map(tuple, w.collect()), key=repr) == sorted(map(tuple, n.select(*w.columns).collect()), key=repr)


def test_top_cost_encounters_equals_full_sort(spark, sf_small):
    t = DriverTables(spark, sf_small)
    claims, encounters, _, _ = cost_inputs(t)
    fast = cost.top_cost_encounters(claims, encounters)
    full = (cost.claim_encounters(claims, encounters)
            .orderBy(F.col("total_amount").desc(), "claim_id", "encounter_id").limit(10))
    assert [tuple(r) for r in fast.collect()] == [tuple(r) for r in full.select(*fast.columns).collect()]


def test_hot_patient_third_of_rows(spark):
    """One patient holds a third of claims and encounters: same numbers, and the
    weighted plan joins per-patient summaries, never the raw rows."""
    n = 900
    claims = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("p"), (F.col("id") % 97).cast("string")))
        .alias("patient_id"),
        ((F.col("id") * 7919) % 100000 / F.lit(100.0)).alias("total_amount"))
    encounters = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("p"), (F.col("id") % 89).cast("string")))
        .alias("patient_id"),
        F.concat(F.lit("T"), (F.col("id") % 5).cast("string")).alias("type_text"))
    w = fanout.claim_encounter_cost(claims, encounters, "type_text")
    naive = fanout.claim_encounter_cost(claims, encounters, "type_text", method="join")
    same(w, naive, "type_text")
    plan = w._jdf.queryExecution().optimizedPlan().toString()
    join_at = plan.index("Join")
    below = plan[join_at:]
    assert below.count("Aggregate") >= 2   # both join inputs are aggregates
