"""Random tables: the weighted rewrites equal the naive fan-out joins."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from care_analytics.operators import fanout

PATIENTS = st.one_of(st.none(), st.sampled_from(["a", "b", "c", "d"]))
AMOUNTS = st.one_of(st.none(), st.integers(0, 100000).map(lambda c: c / 100))
GROUPS = st.one_of(st.none(), st.sampled_from(["G1", "G2", "G3"]))
ENCOUNTERS = st.one_of(st.none(), st.sampled_from(["e1", "e2", "e3", "e4"]))

claims_st = st.lists(st.tuples(PATIENTS, AMOUNTS), min_size=1, max_size=25)
encounters_st = st.lists(st.tuples(ENCOUNTERS, PATIENTS, GROUPS), min_size=0, max_size=25)
procedures_st = st.lists(st.tuples(ENCOUNTERS, GROUPS), min_size=1, max_size=25)


def rows(df, key):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: str(r))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(claims=claims_st, encounters=encounters_st, procedures=procedures_st)
def test_random_fanout_equals_naive(spark, claims, encounters, procedures):
    c = spark.createDataFrame(claims, "patient_id string, total_amount double")
    e = spark.createDataFrame(encounters, "encounter_id string, patient_id string, type_text string")
    p = spark.createDataFrame(procedures, "encounter_id string, procedure_code_display string")
    w = fanout.claim_encounter_cost(c, e, "type_text")
    n = fanout.claim_encounter_cost(c, e, "type_text", method="join")
    assert rows(w, 0) == rows(n.select(*w.columns), 0)
    w = fanout.procedure_claim_cost(p, e, c)
    n = fanout.procedure_claim_cost(p, e, c, method="join")
    assert rows(w, 0) == rows(n.select(*w.columns), 0)


LABELS = st.sampled_from(["Line Submitted Charge Amount", " line allowed charge amount",
                          "Line Beneficiary Part B Deductible Amount", "something else"])
ADJ = st.tuples(AMOUNTS, LABELS)
EOB_ROWS = st.tuples(st.sampled_from(["b1", "b2", "b3"]),
                     st.sampled_from(["urn:uuid:a", "urn:uuid:b", "c"]),
                     st.one_of(st.none(), st.lists(ADJ, max_size=4)))
DEMO = st.tuples(st.sampled_from(["a", "b", "c", "z"]), st.sampled_from(["male", "female"]),
                 st.sampled_from(["Child", "Senior"]))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(eob_rows=st.lists(EOB_ROWS, min_size=1, max_size=12), demo_rows=st.lists(DEMO, max_size=12))
def test_random_benefit_means_equal_naive(spark, eob_rows, demo_rows):
    from care_analytics.plans import disparities
    data = [(e, p, None if adj is None else
             [((v, "USD"), ([("s", "c", label)],)) for v, label in adj]) for e, p, adj in eob_rows]
    eob = spark.createDataFrame(data, "eob_id string, patient_reference string, adjudication "
                                "array<struct<amount:struct<value:double,currency:string>,"
                                "category:struct<coding:array<struct<system:string,code:string,"
                                "display:string>>>>>")
    demo = spark.createDataFrame([(p, g, 30, "Single", a) for p, g, a in demo_rows],
                                 "patient_reference string, gender string, age int, "
                                 "marital_status string, age_group string")
    for keys in (["category_display"], ["category_display", "gender", "age_group"]):
        w = disparities.benefit_by(eob, demo, keys)
        n = disparities.benefit_by(eob, demo, keys, method="join")
        assert rows(w, 0) == rows(n.select(*w.columns), 0)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(claims=st.lists(st.tuples(PATIENTS, st.sampled_from([1.0, 2.0, 3.0, None])),
                       min_size=1, max_size=25),
       encounters=encounters_st, k=st.integers(1, 6))
def test_random_top_k_equals_full_sort(spark, claims, encounters, k):
    from pyspark.sql import functions as F
    from care_analytics.plans import cost
    c = spark.createDataFrame([(p, f"c{i}", a) for i, (p, a) in enumerate(claims)],
                              "patient_id string, claim_id string, total_amount double")
    # an encounter id names one encounter: ids are unique here, so the sort
    # keys (amount, claim id, encounter id) order the rows completely
    e = spark.createDataFrame([(f"e{i}", p, g) for i, (_, p, g) in enumerate(encounters)],
                              "encounter_id string, patient_id string, type_text string")
    fast = cost.top_cost_encounters(c, e, k)
    full = (cost.claim_encounters(c, e)
            .orderBy(F.col("total_amount").desc_nulls_last(), F.col("claim_id").asc_nulls_first(),
                     F.col("encounter_id").asc_nulls_first()).limit(k))
    assert [tuple(r) for r in fast.collect()] == [tuple(r) for r in full.select(*fast.columns).collect()]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pairs=st.lists(st.tuples(
    st.datetimes(min_value=__import__("datetime").datetime(1950, 1, 1),
                 max_value=__import__("datetime").datetime(2050, 1, 1)),
    st.datetimes(min_value=__import__("datetime").datetime(1950, 1, 1),
                 max_value=__import__("datetime").datetime(2050, 1, 1))), min_size=1, max_size=20))
def test_random_ntz_durations_match_wall_clock(spark, pairs):
    import datetime as dt
    from care_analytics.functions.columns import duration_seconds
    df = spark.createDataFrame([(a, b) for a, b in pairs], "a timestamp_ntz, b timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [r[0] for r in df.select(duration_seconds("a", "b", ntz=True)).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    floor = lambda t: t.replace(microsecond=0)
    want = [int((floor(b) - floor(a)) / dt.timedelta(seconds=1)) for a, b in pairs]
    assert got == want


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(claims=st.lists(st.tuples(PATIENTS, st.sampled_from(["c1", "c2", None]), st.sampled_from([1.0, 2.0, None]),
                                 st.sampled_from(["A", "B"])), min_size=1, max_size=15),
       encounters=encounters_st, k=st.integers(1, 6))
def test_random_top_k_with_missing_and_repeated_claim_ids(spark, claims, encounters, k):
    """Line-grain claims: ids are missing or repeated, insurances differ. All columns order the rows."""
    from pyspark.sql import functions as F
    from care_analytics.plans import cost
    c = spark.createDataFrame(claims, "patient_id string, claim_id string, total_amount double, insurance string")
    e = spark.createDataFrame([(f"e{i}", p, g) for i, (_, p, g) in enumerate(encounters)],
                              "encounter_id string, patient_id string, type_text string")
    fast = cost.top_cost_encounters(c, e, k)
    full = cost.claim_encounters(c, e).select(*fast.columns)
    full = full.orderBy(F.col("total_amount").desc_nulls_last(), F.col("claim_id").asc_nulls_first(),
                        F.col("encounter_id").asc_nulls_first()).collect()
    key = lambda r: (r["total_amount"], r["claim_id"], r["encounter_id"])
    got = [tuple(r) for r in fast.collect()]
    assert [key(r) for r in fast.collect()] == [key(r) for r in full[:k]]
    left = [tuple(r) for r in full]
    for row in got:
        left.remove(row)                # every row is a row of the join, no more often than there
