import json

import pytest

from care_analytics.operators.flatten import FLATTENERS, flatten
from care_analytics.plans import etl
from care_analytics.sources.bundles import bundle_entries, read_bundles, resource_counts, resources
from care_analytics.sources.warehouse import Warehouse

PATIENT = {"resourceType": "Patient", "id": "p1", "gender": "male", "birthDate": "1980-05-01",
           "maritalStatus": {"text": "M"},
           "address": [{"city": "Town", "state": "ON", "extension": [
               {"url": "other", "extension": [{"valueDecimal": 9.0}]},
               {"url": "http://hl7.org/fhir/StructureDefinition/geolocation",
                "extension": [{"url": "latitude", "valueDecimal": 43.5},
                              {"url": "longitude", "valueDecimal": -79.25}]}]}],
           "communication": [{"language": {"text": "English"}}, {"language": {"text": "French"}}]}
ENCOUNTER = {"resourceType": "Encounter", "id": "e1", "status": "finished", "class": {"code": "AMB"},
             "type": [{"text": "Check up"}], "subject": {"reference": "urn:uuid:p1"},
             "period": {"start": "2020-01-01T10:00:00-05:00", "end": "2020-01-01T10:30:00-05:00"},
             "participant": [{"individual": {"display": "Dr A"}}, {"individual": {"display": "Dr B"}}]}
CLAIM = {"resourceType": "Claim", "id": "c1", "type": {"coding": [{"code": "institutional"}]},
         "total": {"value": 12.5, "currency": "USD"}, "patient": {"reference": "urn:uuid:p1"},
         "supportingInfo": [], "insurance": [{"focal": True}], "item": [{}, {}], "diagnosis": [{}, {}]}
EOB = {"resourceType": "ExplanationOfBenefit", "id": "b1", "type": {"coding": [{"code": "x"}]},
       "total": [{"amount": {"value": 7.0, "currency": "USD"}}], "contained": [{}], "careTeam": [{}],
       "insurance": [{"coverage": {"display": "Plan"}}],
       "item": [{"adjudication": [{"amount": {"value": 3.5, "currency": "USD"},
                                   "category": {"coding": [{"code": "a", "display": "Line Allowed Charge Amount"}]}}]}]}


def write_bundles(tmp_path, bundles, ndjson=False):
    d = tmp_path / "bundles"
    d.mkdir()
    if ndjson:
        (d / "all.ndjson").write_text("\n".join(json.dumps(b) for b in bundles))
    else:
        for i, b in enumerate(bundles):
            (d / f"b{i}.json").write_text(json.dumps(b, indent=2))
    return str(d)


def entries_of(spark, tmp_path, bundles, ndjson=False):
    return bundle_entries(read_bundles(spark, write_bundles(tmp_path, bundles, ndjson), ndjson=ndjson))


def bundle(*res):
    return {"entry": [{"fullUrl": f"urn:uuid:{r['id']}", "resource": r} for r in res]}


def test_minimal_bundle(spark, tmp_path):
    other = {"resourceType": "Organization", "id": "o1"}
    e = entries_of(spark, tmp_path, [bundle(PATIENT, ENCOUNTER, CLAIM, other), {"entry": []}])
    assert e.count() == 4
    pat = flatten(resources(e, "Patient"), FLATTENERS["Patient"]).collect()
    assert len(pat) == 1
    p = pat[0]
    assert (p.patient_id, p.gender, p.city, p.latitude, p.longitude) == ("p1", "male", "Town", 43.5, -79.25)
    assert p.languages == ["English", "French"]
    enc = flatten(resources(e, "Encounter"), FLATTENERS["Encounter"]).collect()
    assert [r.participant_individual_display for r in enc] == ["Dr A", "Dr B"]
    assert {r.type_text for r in enc} == {"Check up"}
    claim = resources(e, "Claim")
    assert flatten(claim, FLATTENERS["Claim"]).count() == 0          # empty supportingInfo
    header = flatten(claim, FLATTENERS["Claim"], grain="header").collect()
    assert len(header) == 1 and header[0].total_amount == 12.5 and header[0].type_code == "institutional"
    counts = {r.resource_type: r.num_resources for r in resource_counts(e).collect()}
    assert counts == {"Patient": 1, "Encounter": 1, "Claim": 1}


def test_cross_product_grain(spark, tmp_path):
    claim = dict(CLAIM, supportingInfo=[{"category": {"coding": [{"code": "info"}]}}])
    e = entries_of(spark, tmp_path, [bundle(claim)], ndjson=True)
    rows = flatten(resources(e, "Claim"), FLATTENERS["Claim"]).collect()
    assert len(rows) == 1 * 1 * 2 * 2
    assert {r.supporting_info_code for r in rows} == {"info"}


def test_eob_total_array_and_adjudication(spark, tmp_path):
    e = entries_of(spark, tmp_path, [bundle(EOB)])
    r = flatten(resources(e, "ExplanationOfBenefit"), FLATTENERS["ExplanationOfBenefit"]).collect()
    assert len(r) == 1
    assert r[0].total_amount is None and r[0].total_first_amount == 7.0
    adj = r[0].adjudication[0]
    assert adj.amount.value == 3.5 and adj.category.coding[0].display == "Line Allowed Charge Amount"


def test_outer_explode_keeps_resources(spark, tmp_path):
    enc = dict(ENCOUNTER, participant=[])
    e = entries_of(spark, tmp_path, [bundle(enc)])
    assert flatten(resources(e, "Encounter"), FLATTENERS["Encounter"]).count() == 0
    assert flatten(resources(e, "Encounter"), FLATTENERS["Encounter"], outer=True).count() == 1


def test_malformed_document_is_skipped(spark, tmp_path):
    d = tmp_path / "bad"
    d.mkdir()
    (d / "a.json").write_text("{not json")
    (d / "b.json").write_text(json.dumps(bundle(PATIENT)))
    e = bundle_entries(read_bundles(spark, str(d)))
    assert e.count() == 1


def test_etl_round_trip(spark, tmp_path):
    src = write_bundles(tmp_path, [bundle(PATIENT, ENCOUNTER, CLAIM, EOB)])
    out = str(tmp_path / "wh")
    written = etl.run(spark, src, out)
    assert len(written) == 12
    wh = Warehouse(spark, out)
    assert wh.table("patient").count() == 1
    assert wh.table("encounter").count() == 2
    assert wh.table("claim").count() == 0
    counts = {r.table_name: r.num_rows for r in wh.row_counts().collect()}
    assert counts["explanation_of_benefit"] == 1 and counts["observation"] == 0


def test_table_check_rejects_wrong_schema(spark, tmp_path):
    p = str(tmp_path / "wh2")
    spark.range(1).write.parquet(p + "/patient")
    with pytest.raises(ValueError):
        Warehouse(spark, p).table("patient")


def test_encounter_grain(spark, tmp_path):
    from care_analytics.operators.cleaning import clean_encounters
    e = entries_of(spark, tmp_path, [bundle(ENCOUNTER)])
    flat = flatten(resources(e, "Encounter"), FLATTENERS["Encounter"])
    rows = clean_encounters(flat)
    assert rows.count() == 2                      # one per participant, as the original
    one = clean_encounters(flat, grain="encounter").collect()
    assert len(one) == 1 and one[0].encounter_duration == 30.0


def test_patient_extensions_by_url(spark, tmp_path):
    from care_analytics.operators.flatten import patient_spec
    p = dict(PATIENT, extension=[
        {"url": "u:qaly", "valueDecimal": 2.5},
        {"url": "u:maiden", "valueString": "Smith"},
        {"url": "u:daly", "valueDecimal": 1.5},
        {"url": "u:birth", "valueAddress": {"city": "Oslo", "country": "NO"}}])
    e = entries_of(spark, tmp_path, [bundle(p)])
    pos = flatten(resources(e, "Patient"), FLATTENERS["Patient"]).collect()[0]
    assert pos.mothers_maiden_name is None and pos.disability_adjusted_life_years == 1.5
    assert pos.quality_adjusted_life_years is None            # position 3 holds the birthplace
    spec = patient_spec({"mothers_maiden_name": "u:maiden", "birthplace_city": "u:birth",
                         "disability_adjusted_life_years": "u:daly",
                         "quality_adjusted_life_years": "u:qaly"})
    r = flatten(resources(e, "Patient"), spec).collect()[0]
    assert (r.mothers_maiden_name, r.birthplace_city, r.disability_adjusted_life_years,
            r.quality_adjusted_life_years) == ("Smith", "Oslo", 1.5, 2.5)


def test_object_or_array_shapes(spark, tmp_path):
    """A concept, its codings, and an exploded array, each as one object and as a list."""
    coding = {"code": "c1", "display": "d1"}
    shapes = [{"coding": [coding]}, [{"coding": [coding]}], {"coding": coding}, [{"coding": coding}]]
    claim = dict(CLAIM, supportingInfo=[{}], insurance=[{}], diagnosis=[{}])
    item = {"productOrService": {"coding": [{"code": "i"}]}}
    claims = [dict(claim, id=f"s{i}", type=shape) for i, shape in enumerate(shapes)]
    claims += [dict(claim, id="one", item=item), dict(claim, id="list", item=[item]), dict(claim, id="text", item="no list")]
    observations = [{"resourceType": "Observation", "id": f"o{i}", "category": shape} for i, shape in enumerate(shapes)]
    entries = entries_of(spark, tmp_path, [bundle(*claims, *observations)])
    rows = flatten(resources(entries, "Claim"), FLATTENERS["Claim"]).collect()
    assert {r.type_code for r in rows if r.claim_id.startswith("s")} == {"c1"}
    assert len([r for r in rows if r.claim_id.startswith("s")]) == 8
    by = {k: [r.item_code for r in rows if r.claim_id == k] for k in ("one", "list", "text")}
    assert by == {"one": ["i"], "list": ["i"], "text": []}
    found = flatten(resources(entries, "Observation"), FLATTENERS["Observation"]).collect()
    assert len(found) == 4 and {r.category_display for r in found} == {"d1"}


def test_bad_documents_are_kept_and_counted(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines = [json.dumps(bundle(PATIENT)), '{"entry": [{"fullUrl": "x", ', "not json", json.dumps(bundle(ENCOUNTER))]
    (source / "all.ndjson").write_text("\n".join(lines))
    root = str(tmp_path / "wh")
    etl.run(spark, str(source), root, ndjson=True)
    wh = Warehouse(spark, root)
    assert not list((tmp_path / "wh").rglob("_staging"))
    assert sorted(r.document for r in wh.table("_corrupt").collect()) == sorted(lines[1:3])
    assert wh.table("patient").count() == 1 and wh.table("encounter").count() == 2
