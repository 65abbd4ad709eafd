import json

from care_analytics.sources.warehouse import Warehouse
from care_analytics.streaming import ingest

from test_flatten import CLAIM, ENCOUNTER, PATIENT, bundle


def test_stream_ingests_new_files_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    out = str(tmp_path / "wh")
    ckpt = str(tmp_path / "ckpt")
    (src / "a.ndjson").write_text(json.dumps(bundle(PATIENT, ENCOUNTER)) + "\n")
    q = ingest.start(spark, str(src), out, checkpoint=ckpt)
    q.awaitTermination(120)
    wh = Warehouse(spark, out)
    assert wh.table("patient").count() == 1
    assert wh.table("encounter").count() == 2
    # types absent from the batch still read back, as empty tables
    counts = {r.table_name: r.num_rows for r in wh.row_counts().collect()}
    assert len(counts) == 12 and counts["claim"] == 0 and counts["observation"] == 0

    p2 = dict(PATIENT, id="p2")
    (src / "b.ndjson").write_text(json.dumps(bundle(p2, CLAIM)) + "\n")
    q = ingest.start(spark, str(src), out, checkpoint=ckpt)
    q.awaitTermination(120)
    # second run only sees the new file; the first file is not ingested again
    assert sorted(r.patient_id for r in wh.table("patient").collect()) == ["p1", "p2"]
    assert wh.table("encounter").count() == 2

    # a restart with nothing new changes nothing
    q = ingest.start(spark, str(src), out, checkpoint=ckpt)
    q.awaitTermination(120)
    assert wh.table("patient").count() == 2
