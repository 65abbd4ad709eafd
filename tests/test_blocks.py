import pytest
from pyspark.sql import functions as F

from care_analytics.operators import blocks
from care_analytics.plans import cost

LEFT = "k string, a int, x string"
RIGHT = "k string, b int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def tables(spark):
    left = [("hot", i, "l") for i in range(60)] + [("left only", i, None) for i in range(50)] + [(None, i, "n") for i in range(40)] + [(f"k{i % 20}", i, "x") for i in range(40)]
    right = [("hot", i) for i in range(45)] + [("right only", i) for i in range(50)] + [(None, i) for i in range(30)] + [(f"k{i}", i) for i in range(0, 30, 2)]
    left += [("k1", 1, "same")] * 3                                     # repeated rows
    return spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("size", [7, 10, 1000])
def test_equals_the_plain_join(spark, how, size):
    left, right = tables(spark)
    got = blocks.block_join(left, right, "k", how, size)
    want = left.join(right, "k", how)
    assert got.columns == want.columns and rows(got) == rows(want)


def test_empty_sides(spark):
    left, right = tables(spark)
    assert rows(blocks.block_join(left, right.limit(0), "k", "left", 5)) == rows(left.join(right.limit(0), "k", "left"))
    assert blocks.block_join(left.limit(0), right, "k", "left", 5).count() == 0
    with pytest.raises(ValueError):
        blocks.block_join(left, right, "k", "full")


def test_no_task_holds_more_than_its_share_of_a_hot_key(spark):
    """A third of both sides on one key: 3000 x 3000 rows of it, in 36 pairs of blocks."""
    left = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("a"))
    right = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("b"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for c, v in zip(old, ("64", "false", "-1")):
        spark.conf.set(c, v)
    try:
        def largest(df):
            sizes = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
            assert sizes[0] == 9_000_000 + 6000
            return sizes[1] / sizes[0]
        assert largest(left.join(right, "k", "left")) > 0.9
        assert largest(blocks.block_join(left, right, "k", "left", 500)) < 0.2
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_row_joins_of_the_cost_analysis_take_blocks(spark):
    claims = spark.createDataFrame([("p", "c1", 1.0, "x", "y"), (None, "c2", 2.0, "x", "y"), ("q", "c3", None, "x", "y")],
                                   "patient_id string, claim_id string, total_amount double, currency string, insurance_coverage_display string")
    encounters = spark.createDataFrame([("e1", "p", "t"), ("e2", "p", "u"), ("e3", None, "v")], "encounter_id string, patient_id string, type_text string")
    procedures = spark.createDataFrame([("x1", "e1", "d"), ("x2", None, "d"), ("x3", "e9", "d")], "procedure_id string, encounter_id string, procedure_code_display string")
    ce = cost.claim_encounters(claims, encounters)
    assert rows(ce) == rows(claims.join(encounters, "patient_id", "left"))
    assert rows(cost.procedure_claims(procedures, claims, encounters)) == rows(procedures.join(claims.join(encounters, "patient_id", "left"), "encounter_id", "left"))
    patients = spark.createDataFrame([("p", "f", "2000-01-01")], "patient_id string, gender string, birth_date string")
    got = {(r["claim_id"], r["patient_id_clean"], r["gender"]) for r in cost.claim_patients(claims.withColumn("patient_id", F.concat(F.lit("urn:uuid:"), "patient_id")), patients).collect()}
    assert got == {("c1", "p", "f"), ("c2", None, None), ("c3", "q", None)}


@pytest.mark.parametrize("size", [7, 1000])
def test_known_counts_need_not_be_exact(spark, size):
    left, right = tables(spark)
    guess = spark.createDataFrame([("hot", 500), ("right only", 90), ("k1", 200)], "__key string, __rows long")
    for how, counts in (("inner", (guess, guess)), ("left", (guess, None))):
        assert rows(blocks.block_join(left, right, "k", how, size, counts)) == rows(left.join(right, "k", how))
    with pytest.raises(ValueError):
        blocks.block_join(left, right, "k", "left", size, (None, guess))


def test_each_side_is_computed_once(spark):
    """A side that is itself a product was computed four times: for its counts, their total, the light and the heavy keys."""
    left, right = tables(spark)
    seen = spark.sparkContext.accumulator(0)

    def noted(x):
        seen.add(1)
        return x
    made = left.withColumn("a", F.udf(noted, "int")("a"))
    assert rows(blocks.block_join(made, right, "k", "inner", 10)) == rows(left.join(right, "k", "inner"))
    assert seen.value <= left.count()


def test_copies_are_made_again(spark):
    df = spark.createDataFrame([("a", 1)] * 25 + [("b", None)] * 3 + [(None, 2)], "k string, v int")
    few = blocks.copies(df, "n", 10)
    assert sorted((tuple(r) for r in few.collect()), key=repr) == sorted([("a", 1, 10, 0), ("a", 1, 10, 1), ("a", 1, 5, 2), ("b", None, 3, 0), (None, 2, 1, 0)], key=repr)
    assert blocks.repeated(few, "n").columns == ["k", "v"] and rows(blocks.repeated(few, "n")) == rows(df)


def test_products_are_not_shuffled(spark):
    """The joins whose rows are wanted shuffle their sources, not the product of two of them."""
    from care_analytics.plans import disparities
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        claims = spark.createDataFrame([("p", f"c{i}", float(i)) for i in range(200)] + [(None, "c", 1.0), ("q", "cq", 2.0)], "patient_id string, claim_id string, total_amount double")
        encounters = spark.createDataFrame([(f"e{i % 150}", "p") for i in range(200)] + [("eq", "r"), ("en", None), (None, "p")], "encounter_id string, patient_id string")
        procedures = spark.createDataFrame([("x1", "e1"), ("x2", "e9"), ("x2", "e9"), ("x3", "eq"), ("x4", "en"), ("x5", None), ("x6", "none")], "procedure_id string, encounter_id string")
        got = cost.procedure_claims(procedures, claims, encounters)
        assert rows(got) == rows(procedures.join(claims.join(encounters, "patient_id", "left"), "encounter_id", "left").select(got.columns))
        line = "struct<amount:struct<value:double,currency:string>,category:struct<coding:array<struct<system:string,code:string,display:string>>>>"
        a = [((1.25, "USD"), ([("s", "0", "Line Submitted Charge Amount")],)), ((None, "USD"), ([("s", "1", "Line Allowed Charge Amount")],))]
        eob = spark.createDataFrame([("b", "urn:uuid:p", d, a) for d in ("x", "x", None)] + [("b2", "urn:uuid:q", "y", []), (None, "urn:uuid:p", "z", a)],
                                    f"eob_id string, patient_reference string, billable_period_start string, adjudication array<{line}>")
        kept = spark.createDataFrame([("p", "f", 3, "Single", "Child")] * 40 + [("q", None, 4, "Single", "Child")], "patient_reference string, gender string, age int, marital_status string, age_group string")
        want = disparities.benefit_lines(eob).drop("category_code").join(eob.select("eob_id", "billable_period_start"), "eob_id").join(kept, "patient_reference")
        joined = disparities.benefit_rows(eob, kept)
        assert joined.columns == want.columns and rows(joined) == rows(want) and joined.count() == 3 * 2 * 3 * 40
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate") < plan.index("Join")                                     # copies are made above the joins
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
