"""The encounter cube against the joined rows it replaces."""

import random

import pytest
from pyspark.sql import functions as F

from care_analytics.operators import cleaning
from care_analytics.plans import cube, disparities


def tables(spark, seed, hot=0):
    rng = random.Random(seed)
    patients = [(f"p{i}", rng.choice(["male", "female", "other", "unknown", "x", None]), rng.choice([None, 5, 30, 45, 80]),
                 rng.choice(["Married", "Single"])) for i in range(12)]
    stays = [(f"e{i}", rng.choice([p[0] for p in patients] + ["nobody", None]), rng.choice(["Ambulatory", "Inpatient", "Emergency", None]),
              rng.choice([None, 60, 600, 90_000, 10_000_000])) for i in range(150)]
    stays += [(f"h{i}", "p0", "Inpatient", 60 * (i % 50)) for i in range(hot)]
    p = spark.createDataFrame(patients, "patient_id string, gender string, age int, marital_status string")
    e = spark.createDataFrame(stays, "encounter_id string, patient_reference string, class_code string, encounter_seconds long") \
        .withColumn("encounter_duration", F.col("encounter_seconds") / 60.0)
    return e, p


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("seed, hot", [(1, 0), (2, 0), (3, 3000)])
def test_cube_equals_the_join(spark, seed, hot):
    e, p = tables(spark, seed, hot)
    joined = disparities.encounter_patients(e, p)
    kept = cleaning.keep_short_stays(joined)
    c = cube.encounter_cube(e, p)
    assert rows(cube.count_by(c, "gender", "class_code")) == rows(joined.groupBy("gender", "class_code").count())
    assert cube.overlap_count(c).first()[0] == joined.count()
    for keys in (["gender"], ["class_code", "age_group"], ["marital_status", "gender", "age_group"]):
        for source, k in ((joined, False), (kept, True)):
            assert rows(cube.duration_by(c, keys, kept=k, with_max=True)) == rows(disparities.duration_by(source, keys, with_max=True))
    weights = cube.kept_weights(e, p)
    assert weights.agg(F.sum("_w")).first()[0] == kept.count()


def test_every_stay_is_in_a_column_of_the_pivot(spark):
    e, p = tables(spark, 4)
    got = cube.pivot_duration_all(cube.encounter_cube(e, p), ["class_code"], "gender", ["female", "male"])
    assert got.columns == ["class_code", "female", "male", "(other)", "(missing)"]
    kept = cleaning.keep_short_stays(disparities.encounter_patients(e, p))
    want = {}
    for r in kept.filter(F.col("gender").isNotNull() & ~F.col("gender").isin("female", "male")).groupBy("class_code") \
            .agg(F.avg("encounter_seconds").alias("m")).collect():
        want[r["class_code"]] = (r["m"] or 0.0) / 60.0
    assert {r["class_code"]: r["(other)"] for r in got.collect() if r["class_code"] in want} == pytest.approx(want)


def test_a_hot_patient_reaches_the_join_as_one_row_per_class(spark):
    e, p = tables(spark, 5, hot=5000)
    assert cube.patient_stays(e).filter("patient_reference = 'p0' AND class_code = 'Inpatient'").count() == 1
    plan = cube.encounter_cube(e, p)._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join"):]
    assert "Aggregate [patient_reference" in join          # encounters are summed below the join
