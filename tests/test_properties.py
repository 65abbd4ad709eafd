"""Properties from the test strategy: grains, count conservation, JSON tolerance."""

from pyspark.sql import functions as F

from care_analytics.operators import grouping
from care_analytics.operators.flatten import FLATTENERS, flatten
from driver_queries.core import encounter_patients, patients_clean
from driver_queries.resources import RoleResources
from driver_queries.roles import DriverTables


def test_header_grain_has_unique_ids(spark, sf_small):
    rr = RoleResources(DriverTables(spark, sf_small))
    for rtype, key in [("Claim", "claim_id"), ("ExplanationOfBenefit", "eob_id"),
                       ("CarePlan", "careplan_id"), ("Encounter", "encounter_id")]:
        res = rr.of_type(rtype)
        header = flatten(res, FLATTENERS[rtype], grain="header")
        assert header.count() == res.count()
        assert header.select(key).distinct().count() == res.count()


def test_grouped_counts_sum_to_input_rows(spark, sf_small):
    t = DriverTables(spark, sf_small)
    ep = encounter_patients(t)
    total = ep.count()
    for keys in (["gender"], ["gender", "class_code"], ["age_group", "marital_status"]):
        s = grouping.count_by(ep, *keys).agg(F.sum("count")).collect()[0][0]
        assert s == total
    p = patients_clean(t)
    assert grouping.count_by(p, "age").agg(F.sum("count")).collect()[0][0] == p.count()


def test_from_json_array_schema_accepts_single_object(spark):
    df = spark.createDataFrame([('{"k": 1}',), ('[{"k": 2}, {"k": 3}]',), ("oops",)], "j string")
    out = [r[0] for r in df.select(F.from_json("j", "array<struct<k:int>>")).collect()]
    assert [x.k for x in out[0]] == [1]
    assert [x.k for x in out[1]] == [2, 3]
    assert out[2] is None


def test_json_text_round_trip_equals_in_memory(spark, sf_small, tmp_path):
    """Bundles written as NDJSON and read back with the declared schema flatten
    to the same rows as the in-memory resources."""
    from care_analytics.sources.bundles import bundle_entries, read_bundles, resources
    rr = RoleResources(DriverTables(spark, sf_small))
    src = str(tmp_path / "bundles")
    rr.bundles().select(F.to_json(F.struct("entry")).alias("value")).write.text(src)
    entries = bundle_entries(read_bundles(spark, src, ndjson=True))
    for rtype in ("Patient", "Claim", "ExplanationOfBenefit", "Observation"):
        from_text = flatten(resources(entries, rtype), FLATTENERS[rtype]).drop("adjudication")
        direct = flatten(rr.of_type(rtype), FLATTENERS[rtype]).drop("adjudication")
        a = sorted(map(repr, from_text.collect()))
        b = sorted(map(repr, direct.collect()))
        assert a == b, rtype


def test_codeable_concepts_parse_object_or_list(spark):
    from care_analytics.functions.columns import parse_json_array
    from care_analytics.schemas import CODEABLE_CONCEPTS
    df = spark.createDataFrame([('{"coding": [{"code": "a"}], "text": "x"}',),
                                ('[{"text": "y"}, {"text": "z"}]',)], "t string")
    out = [r[0] for r in df.select(parse_json_array("t", CODEABLE_CONCEPTS)).collect()]
    assert out[0][0].coding[0].code == "a" and out[0][0].text == "x"
    assert [c.text for c in out[1]] == ["y", "z"]
