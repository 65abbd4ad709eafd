import json

from care_analytics.plans import etl
from care_analytics.sources.warehouse import Warehouse
from care_analytics.streaming import ingest


def patient(i, gender="female", updated=None, version=None):
    meta = {k: v for k, v in (("lastUpdated", updated), ("versionId", version)) if v}
    return {"resourceType": "Patient", "id": i, "gender": gender, **({"meta": meta} if meta else {})}


def claim(i, lines, version=None):
    """A claim of several line rows."""
    meta = {"meta": {"versionId": version}} if version else {}
    return {"resourceType": "Claim", "id": i, **meta, "patient": {"reference": "urn:uuid:p"}, "total": {"value": 1.0}, "supportingInfo": [{}], "insurance": [{}],
            "diagnosis": [{}], "item": [{"sequence": n, "encounter": [{"reference": "urn:uuid:e"}]} for n in range(lines)]}


def put(folder, name, *resources):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps({"entry": [{"resource": r} for r in resources]}) + "\n")


def genders(wh):
    return sorted(((r["patient_id"], r["gender"]) for r in wh.table("patient").collect()), key=repr)


def test_batch_merge_keeps_the_newest_version(spark, tmp_path):
    src = tmp_path / "in"
    put(src, "a.ndjson", patient("p", "female", "2024-01-01T00:00:00Z"), patient("q", "male", version="9"), claim("c", 3), {"resourceType": "Patient", "gender": "other"})
    put(src, "b.ndjson", patient("p", "unknown", "2024-03-01T00:00:00Z"), patient("q", "female", version="10"), claim("c", 3), {"resourceType": "Patient", "gender": "other"})
    etl.run(spark, str(src), str(tmp_path / "once"), ndjson=True, merge=True)
    wh = Warehouse(spark, str(tmp_path / "once"))
    assert genders(wh) == sorted([("p", "unknown"), ("q", "female"), (None, "other"), (None, "other")], key=repr)   # no id: kept
    rows = wh.table("claim").count()
    etl.run(spark, str(src), str(tmp_path / "all"), ndjson=True)
    every = Warehouse(spark, str(tmp_path / "all"))
    assert every.table("patient").count() == 6 and every.table("claim").count() == 2 * rows and rows > 0


def run(spark, src, out, ckpt, **options):
    ingest.start(spark, str(src), out, checkpoint=ckpt, **options).awaitTermination(180)


def test_stream_sees_each_resource_once(spark, tmp_path):
    src, out, ckpt = tmp_path / "in", str(tmp_path / "wh"), str(tmp_path / "ckpt")
    wh, types = Warehouse(spark, out), ["Patient", "Claim"]
    put(src, "a.ndjson", patient("p", "female", "2024-02-01T00:00:00Z"), claim("c", 4, "1"))
    run(spark, src, out, ckpt, types=types)
    rows = wh.table("claim").count()
    put(src, "b.ndjson", patient("p", "female", "2024-02-01T00:00:00Z"), claim("c", 4, "1"), patient("q"))     # the same again
    run(spark, src, out, ckpt, types=types)
    assert genders(wh) == [("p", "female"), ("q", "female")] and wh.table("claim").count() == rows > 1
    put(src, "c.ndjson", patient("p", "male", "2024-03-01T00:00:00Z"), claim("c", 2, "2"), patient("q", "other"))  # newer; no version: the last one
    run(spark, src, out, ckpt, types=types)
    put(src, "d.ndjson", patient("p", "unknown", "2023-01-01T00:00:00Z"))                                        # an old version, late
    run(spark, src, out, ckpt, types=types)
    want = [("p", "male"), ("q", "other")]
    assert genders(wh) == want and wh.table("claim").count() == rows // 2
    before = sorted(map(str, wh.table("claim").collect()))
    assert wh.compact(["patient", "claim", "_corrupt"]) == 3
    assert genders(wh) == want and sorted(map(str, wh.table("claim").collect())) == before
    put(src, "e.ndjson", patient("q", "male"))
    run(spark, src, out, ckpt, types=types)
    assert genders(wh) == [("p", "male"), ("q", "male")]


def test_files_stay_few(spark, tmp_path):
    """60 batches, folded every 10: files and folders stay bounded, and a batch that runs again after it was folded adds nothing."""
    out = str(tmp_path / "wh")
    write = ingest.write_batch(out, ["Patient"], compact_every=10)
    for n in range(60):
        text = json.dumps({"entry": [{"resource": patient(f"p{n % 25}", "female" if n % 2 else "male")}]})
        write(batch_of(spark, text), n)
    wh = Warehouse(spark, out)
    assert wh.table("patient").count() == 25
    wh.vacuum(keep=1)
    files = [p for p in (tmp_path / "wh").rglob("*.parquet") if "_corrupt" not in str(p)]
    assert len(files) <= 2 * 10 + 4              # the last ten batches (two files each) and the folded table, of 120 files written
    write(batch_of(spark, text), 59)
    assert wh.table("patient").count() == 25


def batch_of(spark, text):
    from pyspark.sql import functions as F
    from care_analytics.schemas import BUNDLE
    from care_analytics.sources.bundles import bundle_entries
    rows = spark.createDataFrame([(text,)], "value string")
    entry = BUNDLE["entry"].dataType.simpleString()
    return bundle_entries(rows.select(F.from_json("value", f"entry {entry}").alias("b")).select("b.entry"))


def test_a_stored_model_scores_a_warehouse(spark, tmp_path):
    from care_analytics.plans import models, training
    src = tmp_path / "in"
    put(src, "a.ndjson", *[{**patient(f"p{i}", "female" if i % 2 else "male"), "birthDate": f"{1940 + i}-01-01", "address": [{"state": "CA" if i % 3 else "ON"}]} for i in range(40)])
    etl.run(spark, str(src), str(tmp_path / "wh"), ndjson=True)
    wh, out = Warehouse(spark, str(tmp_path / "wh")), str(tmp_path / "results")
    training.train(spark, wh, out, as_of="2024-12-01", chosen={"risk_forest": models.forest(numTrees=3, maxDepth=3)})
    want = sorted(map(tuple, spark.read.parquet(f"{out}/scores_risk_forest").collect()))
    got = training.score_stored(spark.newSession(), wh, out, "risk_forest", as_of="2024-12-01")
    assert sorted(map(tuple, got.collect())) == want and len(want) == 40


def test_only_repeated_ids_of_a_stored_batch_are_compared(spark, tmp_path, monkeypatch):
    from care_analytics.sources import merge
    from care_analytics.sources.warehouse import stage_entries
    text = json.dumps({"entry": [{"resource": r} for r in (
        patient("p", "female", version="1"), patient("p", "male", version="2"), patient("q"), patient("q"), patient("r", "other"), {"resourceType": "Patient"},
        {"resourceType": "Patient"}, claim("p", 1), claim("c", 2), {"resourceType": "Nothing", "id": "x"})]})
    entries = merge.keyed(batch_of(spark, text))
    stored = stage_entries(entries, ["Patient", "Claim"], str(tmp_path / "staged"), keep=(merge.ID, merge.VERSION))
    show = lambda df: sorted((r["resource"].toJson(), r[merge.ID]) for r in df.select("resource", merge.ID).collect())
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for few in (merge.FEW, 0):
        monkeypatch.setattr(merge, "FEW", few)
        with merge.newest_stored(stored) as newest_of:
            patients, claims = newest_of("Patient"), newest_of("Claim")
            assert "Window" in plan(patients) and "Join" not in plan(claims) and "Window" not in plan(claims)
            assert show(patients) == show(merge.newest(entries).filter("resource_type = 'Patient'")) and len(show(patients)) == 5
            assert show(claims) == show(entries.filter("resource_type = 'Claim'")) and len(show(claims)) == 2


def test_a_batch_is_parsed_once_and_leaves_no_staged_copy(spark, tmp_path):
    from pyspark.sql import functions as F
    parsed, out = spark.sparkContext.accumulator(0), str(tmp_path / "wh")

    def seen(x):
        parsed.add(1)
        return x
    entries = batch_of(spark, json.dumps({"entry": [{"resource": patient("p")}, {"resource": patient("p")}, {"resource": claim("c", 2)}]}))
    counted = entries.withColumn("resource_type", F.udf(seen, "string").asNondeterministic()("resource_type"))
    ingest.write_batch(out, ["Patient", "Claim"])(counted, 0)
    assert parsed.value == 3 and not list((tmp_path / "wh" / "_versions").iterdir())
    assert Warehouse(spark, out).table("patient").count() == 1
