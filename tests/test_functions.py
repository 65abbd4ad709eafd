import datetime as dt

from pyspark.sql import functions as F

from care_analytics.functions import columns as C
from care_analytics.functions import aggregates as A


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_reference_id_both_flavours(spark):
    df = spark.createDataFrame([("urn:uuid:p1",), ("p2",), (None,), ("urn:uuid:",)], "r string")
    out = rows(df.select(C.reference_id("r"), C.reference_id("r", strict=True)))
    assert out == [("p1", "p1"), ("p2", None), (None, None), ("", "")]


def test_bands_and_null_age(spark):
    df = spark.createDataFrame([(17,), (18,), (39,), (40,), (64,), (65,), (None,)], "age int")
    care = [r[0] for r in df.select(C.care_age_group("age")).collect()]
    assert care == ["Child", "Young Adult", "Young Adult", "Middle Aged", "Middle Aged", "Senior", "Senior"]
    df2 = spark.createDataFrame([(18,), (19,), (35,), (50,), (65,), (66,), (None,)], "age int")
    cost = [r[0] for r in df2.select(C.cost_age_range("age")).collect()]
    assert cost == ["0-18", "19-35", "19-35", "36-50", "51-65", "66+", "66+"]


def test_map_codes_normalises_and_defaults(spark):
    df = spark.createDataFrame([(" M ",), ("s",), ("Never Married",), ("x",), (None,)], "m string")
    got = [r[0] for r in df.select(C.map_codes("m", C.MARITAL_STATUS_LABELS, "Unknown", normalise=True)).collect()]
    assert got == ["Married", "Single", "Never Married", "Unknown", "Unknown"]


def test_processing_indicator_stays_unmatched(spark):
    df = spark.createDataFrame([("Line Processing Indicator Code",), (" line beneficiary coinsurance amount",)], "c string")
    got = [r[0] for r in df.select(C.map_codes("c", C.BENEFIT_CATEGORY_LABELS, "Unknown", normalise=True)).collect()]
    assert got == ["Unknown", "Coinsurance Amount"]


def test_blank_to(spark):
    df = spark.createDataFrame([(None,), ("",), ("A",)], "p string")
    assert [r[0] for r in df.select(C.blank_to("p")).collect()] == ["Others", "Others", "A"]


def test_duration_and_bad_timestamp(spark):
    df = spark.createDataFrame([("2020-01-01T10:00:00-05:00", "2020-01-01T10:30:00-05:00"),
                                ("garbage", "2020-01-01T10:30:00-05:00")], "s string, e string")
    out = df.select(C.duration_minutes(C.to_timestamp_safe("s"), C.to_timestamp_safe("e"))).collect()
    assert out[0][0] == 30.0 and out[1][0] is None


def test_ages(spark):
    df = spark.createDataFrame([("1980-12-31",), ("bad",), (None,)], "b string")
    out = rows(df.select(C.age_calendar("b", "2024-12-01"), C.age_elapsed("b", "2024-12-01")))
    assert out[0] == (44, 43) and out[1] == (None, None) and out[2] == (None, None)


def test_exact_mean_matches_decimal_arithmetic(spark):
    vals = [(0.1,), (0.2,), (0.3,), (None,)]
    df = spark.createDataFrame(vals, "v double")
    r = df.agg(A.mean_money("v"), A.sum_double("v")).collect()[0]
    assert r[0] == 0.6 / 3 or abs(r[0] - 0.2) < 1e-15
    assert r[1] == 0.6


def test_first_where(spark):
    df = spark.createDataFrame([([("a", 1), ("b", 2)],)], "arr array<struct<k:string,v:int>>")
    assert df.select(C.first_where("arr", "k", "b")["v"]).collect()[0][0] == 2
    assert df.select(C.first_where("arr", "k", "z")["v"]).collect()[0][0] is None


def test_ntz_durations_ignore_session_zone(spark):
    df = spark.sql("SELECT timestamp_ntz'1998-03-28 00:00:00' s, timestamp_ntz'1998-04-05 02:15:00' e")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        got = []
        for tz in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            got.append(df.select(C.duration_seconds("s", "e", ntz=True)).collect()[0][0])
        assert got == [8 * 86400 + 2 * 3600 + 15 * 60] * 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
