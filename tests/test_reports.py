"""Bundles -> warehouse -> every report, as a user of the original runs it."""

from pyspark.sql import functions as F

from care_analytics.plans import etl, reports
from driver_queries.resources import RoleResources
from driver_queries.roles import DriverTables
from care_analytics.sources.warehouse import Warehouse


def test_reports_from_etl_warehouse(spark, sf_small, tmp_path):
    src = str(tmp_path / "bundles")
    RoleResources(DriverTables(spark, sf_small)).bundles() \
        .select(F.to_json(F.struct("entry")).alias("value")).write.text(src)
    root = str(tmp_path / "warehouse")
    etl.run(spark, src, root, ndjson=True)
    frames = reports.reports(Warehouse(spark, root), as_of="2024-12-01")
    assert len(frames) >= 35
    written = reports.publish(frames, str(tmp_path / "results"))
    assert len(written) == len(frames)
    counts = {name: spark.read.parquet(p).count() for name, p in zip(frames, written)}
    for name in ("count_by_gender", "duration_by_age_group", "cost_by_encounter_type",
                 "benefit_by_category", "patient_features", "top_cost_encounters"):
        assert counts[name] > 0, name
    assert counts["top_cost_encounters"] == 10
    # encounters at participant grain: every encounter row has a participant
    enc = Warehouse(spark, root).table("encounter")
    assert enc.filter(F.col("participant_individual_display").isNull()).count() == 0


def test_edge_case_bundles_through_reports(spark, tmp_path):
    """Edge cases from the fixture list: nothing raises under ANSI mode."""
    import json
    patient = {"resourceType": "Patient", "id": "p1", "gender": "female",
               "maritalStatus": {"text": "S"}, "address": [{"state": "ON"}]}       # no birth date
    patient2 = {"resourceType": "Patient", "id": "p2", "gender": "male", "birthDate": "not-a-date",
                "address": [{"state": "CA"}]}
    enc = {"resourceType": "Encounter", "id": "e1", "status": "finished", "class": {"code": "IMP"},
           "type": [{"coding": [], "text": "Visit"}], "subject": {"reference": "p1"},   # no prefix
           "period": {"start": "garbage", "end": "2020-01-01T10:30:00Z"},
           "participant": [{"type": [{"coding": []}]}]}
    enc2 = {"resourceType": "Encounter", "id": "e2", "status": "planned", "class": {"code": "AMB"},
            "type": [], "subject": {"reference": "urn:uuid:p2"},
            "period": {"start": "2020-01-01T10:00:00Z", "end": "2020-01-03T10:00:00Z"},
            "participant": [{}]}
    claim = {"resourceType": "Claim", "id": "c1", "type": {"coding": []}, "patient": {"reference": "urn:uuid:p2"},
             "total": {"value": 10.0}, "supportingInfo": [{}], "insurance": [{}], "item": [{"encounter": []}],
             "diagnosis": [{}]}
    eob = {"resourceType": "ExplanationOfBenefit", "id": "b1", "patient": {"reference": "urn:uuid:p2"},
           "total": [], "contained": [{}], "careTeam": [{}], "insurance": [{}],
           "item": [{"adjudication": [{"amount": {"value": 5.0}, "category": {"coding": []}}]},
                    {"adjudication": None}]}
    plan = {"resourceType": "CarePlan", "id": "cp1", "careTeam": [{}], "activity": [{}],
            "category": ["assess-plan", "other"]}                                    # strings, not objects
    proc = {"resourceType": "Procedure", "id": "x1", "code": {"coding": []},
            "encounter": {"reference": "e1"}, "reasonReference": [{}]}
    src = tmp_path / "bundles"
    src.mkdir()
    (src / "b.ndjson").write_text(json.dumps({"entry": [{"resource": r} for r in
                                  (patient, patient2, enc, enc2, claim, eob, plan, proc)]}) + "\n")
    root = str(tmp_path / "warehouse")
    etl.run(spark, str(src), root, ndjson=True)
    wh = Warehouse(spark, root)
    assert wh.table("careplan").collect()[0].category_text is None
    frames = reports.reports(wh, as_of="2024-12-01")
    for name, df in frames.items():
        df.collect()                                          # every report evaluates
    ages = {r.patient_id: r.age for r in frames["patient_features"].collect()}
    assert ages == {"p1": 0, "p2": 0}                          # missing / bad dates -> NULL -> filled 0
    # NULLs are dropped before parsing, as in the original: e1's unparsable
    # start stays, with a NULL duration (sorted last among the longest).
    longest = frames["longest_encounters"].collect()
    assert [r.encounter_id for r in longest] == ["e2", "e1"]
    assert longest[0].encounter_duration == 2 * 24 * 60 and longest[1].encounter_duration is None


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_benefit_reports_read_one_cube(spark, sf_small, tmp_path):
    """With a scratch folder the EOB table is read for the cube, the totals and the audit only, not by the four means and the pivot."""
    from care_analytics.plans import disparities
    src = str(tmp_path / "bundles")
    RoleResources(DriverTables(spark, sf_small)).bundles() \
        .select(F.to_json(F.struct("entry")).alias("value")).write.text(src)
    root = str(tmp_path / "warehouse")
    etl.run(spark, src, root, ndjson=True)
    wh = Warehouse(spark, root)
    frames = reports.reports(wh, as_of="2024-12-01", scratch=str(tmp_path / "scratch"))
    plain = reports.reports(wh, as_of="2024-12-01")
    column = "adjudication"
    readers = [n for n, df in frames.items() if column in plan_of(df)]
    assert readers == [] and "benefit_totals" in frames                        # totals read two amount columns, no adjudication
    assert sum("_versions" in " ".join(df.inputFiles()) and "explanation_of_benefit" in " ".join(df.inputFiles()) for df in frames.values()) == 2
    names = [n for n in frames if n.startswith("benefit_by") or n == "pivot_benefit_groups"]
    assert len(names) == 5
    for n in names:
        assert sorted(map(str, frames[n].collect())) == sorted(map(str, plain[n].collect())) != [], n
    assert set(disparities.BENEFIT_KEYS) <= set(spark.read.parquet(str(tmp_path / "scratch" / "benefit_cube")).columns)


def test_longest_encounters_join_few_rows(spark, sf_small):
    """The join meets the best candidates only, and the answer is that of the whole join."""
    from care_analytics.operators import cleaning
    from care_analytics.plans import disparities
    from driver_queries import core
    t = DriverTables(spark, sf_small)
    e, p = core.encounters_clean(t), core.patients_clean(t)
    fast, naive = disparities.longest_encounters(e, p), disparities.longest(disparities.encounter_patients(e, p))
    assert [tuple(r) for r in fast.select("encounter_id", "encounter_duration").collect()] == [tuple(r) for r in naive.select("encounter_id", "encounter_duration").collect()]
    assert "GlobalLimit 40" in plan_of(fast) and "GlobalLimit 40" not in plan_of(naive)
    none = p.filter("false")                                                   # no partner: candidates grow, then all
    assert disparities.longest_encounters(e, none).count() == 0
    few = p.limit(3)
    got = disparities.longest_encounters(cleaning.long_stays(e, 0), few)
    want = disparities.longest(disparities.encounter_patients(cleaning.long_stays(e, 0), few))
    assert got.count() == want.count()
