import json

import pytest
from pyspark.sql import functions as F

from care_analytics.sources import snapshots, warehouse
from care_analytics.sources.contracts import conform
from care_analytics.sources.warehouse import Warehouse
from care_analytics.plans import etl


def bundle_file(tmp_path, name, ids):
    """An NDJSON file with one bundle for each patient: the patient and one encounter."""
    folder = tmp_path / name
    folder.mkdir(exist_ok=True)
    lines = [{"entry": [{"resource": {"resourceType": "Patient", "id": i, "gender": "female"}},
                        {"resource": {"resourceType": "Encounter", "id": f"e-{i}", "status": "finished", "subject": {"reference": f"urn:uuid:{i}"},
                                      "participant": [{"individual": {"display": "Dr"}}], "type": [{"text": "Visit"}]}}]} for i in ids]
    (folder / "b.ndjson").write_text("".join(json.dumps(b) + "\n" for b in lines))
    return str(folder)


@pytest.fixture
def built(spark, tmp_path):
    root = str(tmp_path / "wh")
    etl.run(spark, bundle_file(tmp_path, "one", ["p1"]), root, ndjson=True)
    return Warehouse(spark, root)


def patients(wh):
    return sorted(r["patient_id"] for r in wh.table("patient").collect())


def test_a_failed_build_leaves_the_old_set_whole(spark, tmp_path, built, monkeypatch):
    before = built.snapshots.current()
    done, write = [], Warehouse._write_table

    def fails_after_five(self, df, path):
        if len(done) == 5:
            raise OSError("lost")
        done.append(path)
        write(self, df, path)
    monkeypatch.setattr(Warehouse, "_write_table", fails_after_five)
    with pytest.raises(OSError):
        etl.run(spark, bundle_file(tmp_path, "two", ["p2", "p3"]), built.root, ndjson=True)
    assert built.snapshots.current() == before and patients(built) == ["p1"]
    assert {r["table_name"]: r["num_rows"] for r in built.row_counts().collect()}["encounter"] == 1
    monkeypatch.undo()
    etl.run(spark, bundle_file(tmp_path, "two", ["p2", "p3"]), built.root, ndjson=True)
    assert patients(built) == ["p2", "p3"]


def test_a_reader_keeps_its_set_while_another_is_published(spark, tmp_path, built):
    frame = built.table("patient")                                     # resolved before the rebuild
    etl.run(spark, bundle_file(tmp_path, "two", ["p2"]), built.root, ndjson=True)
    assert [r["patient_id"] for r in frame.collect()] == ["p1"] and patients(built) == ["p2"]


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    one, two = (snapshots.Snapshots(spark, str(tmp_path)) for _ in range(2))
    assert one.current() == {} and one.publish({"a": "x/a"}) == 1
    numbers, late = two._numbers, [True]
    monkeypatch.setattr(two, "_numbers", lambda: [] if late and late.pop() else numbers())   # has not seen the first
    assert two.publish({"b": "y/b"}) == 2
    assert one.current() == {"a": "x/a", "b": "y/b"}
    assert one.publish({"c": "z/c"}, replace=True) == 3 and two.current() == {"c": "z/c"}


def test_vacuum_keeps_the_last_sets(spark, tmp_path, built):
    for name in ("two", "three"):
        etl.run(spark, bundle_file(tmp_path, name, [name]), built.root, ndjson=True)
    left = built.snapshots.new_version()
    spark.range(1).write.parquet(f"{built.root}/{left}/patient")       # what a dead writer left
    gone = built.vacuum(keep=1)
    assert left in gone and len(gone) == 3 and patients(built) == ["three"]
    built.write(spark.range(3).select(F.col("id").alias("n")), "extra")
    assert built.table("extra").count() == 3 and patients(built) == ["three"]


def check(spark, actual, expected):
    empty = spark.createDataFrame([], expected)
    return conform(spark.createDataFrame(*actual), empty.schema, "t")


def test_types_are_widened_at_every_depth(spark):
    actual = ([(1, [(2, 1.5)], ("x", 3), 9)], "a int, b array<struct<n:int,f:float>>, c struct<s:string,n:int>, extra int")
    out = check(spark, actual, "a long, b array<struct<f:double,n:long>>, c struct<n:long,s:string>")
    assert out.schema.simpleString() == "struct<a:bigint,b:array<struct<f:double,n:bigint>>,c:struct<n:bigint,s:string>,extra:int>"
    r = out.first()
    assert r["a"] == 1 and r["b"][0]["n"] == 2 and r["b"][0]["f"] == 1.5 and r["c"]["s"] == "x" and r["c"]["n"] == 3
    nulls = check(spark, ([(None, None, None)], "a int, b array<struct<n:int>>, c struct<n:int>"), "a long, b array<struct<n:long>>, c struct<n:long>").first()
    assert tuple(nulls) == (None, None, None)


@pytest.mark.parametrize("actual, expected, path", [
    ("a struct<b:struct<c:int>>", "a struct<b:struct<c:int,d:int>>", "a.b.d is missing"),
    ("a array<struct<c:int>>", "a array<struct<c:int,d:int>>", r"a\[\].d is missing"),
    ("a string", "a struct<c:int>", "a is string, not struct"),
    ("a long", "a int", "a is bigint, not int"),
    ("b int", "a int", "a is missing"),
    ("a decimal(10,4)", "a decimal(10,2)", "a is decimal"),
])
def test_what_cannot_be_kept_is_named(spark, actual, expected, path):
    with pytest.raises(ValueError, match=path):
        check(spark, ([], actual), expected)


def test_a_table_of_another_shape_is_an_error(spark, built):
    built.write(built.table("patient").withColumn("gender", F.struct("gender")), "patient")
    with pytest.raises(ValueError, match="gender is struct"):
        built.table("patient")
    assert built.table("patient", check=False).count() == 1
    assert warehouse.expected_schema(spark, "nothing") is None


def test_counted_tables_are_held_to_their_types(spark, built):
    assert {r["table_name"]: r["num_rows"] for r in built.row_counts(["patient", "encounter"]).collect()} == {"patient": 1, "encounter": 1}
    built.write(built.table("encounter").withColumn("status", F.struct("status")), "encounter")
    with pytest.raises(ValueError, match="table encounter lacks columns or types: status is struct"):
        built.row_counts()
    built.write(built.table("encounter", check=False).drop("status"), "encounter")
    with pytest.raises(ValueError, match="status is missing"):
        built.row_counts()


def test_staged_parts_and_the_input_go_when_they_are_read(spark, tmp_path, monkeypatch):
    """The text, the staged copy and the tables all lay on disk until the last table was written."""
    from care_analytics.sources.bundles import bundle_entries, read_bundles
    src, root, left, write = bundle_file(tmp_path, "one", ["p1", "p2"]), tmp_path / "wh", [], Warehouse._write_table
    monkeypatch.setattr(warehouse, "TABLES_AT_ONCE", 1)
    monkeypatch.setattr(Warehouse, "_write_table", lambda self, df, path: (left.append(len(list(root.rglob("resource_type=*")))), write(self, df, path)))
    gone = []
    Warehouse(spark, str(root)).build(bundle_entries(read_bundles(spark, src, ndjson=True)), ["Patient", "Encounter"],
                                      staged=lambda: gone.append(warehouse._remove(spark, src)))
    assert left == [2, 1, 0] and len(gone) == 1 and not (tmp_path / "one").exists()
    assert patients(Warehouse(spark, str(root))) == ["p1", "p2"] and not list(root.rglob("_staging"))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_tables_and_staged_entries_are_packed(spark, tmp_path, built, monkeypatch):
    import pyarrow.parquet as pq
    from care_analytics.sources.bundles import bundle_entries, read_bundles
    src = bundle_file(tmp_path, "two", ["p1", "p2"])
    staged = warehouse.stage_entries(bundle_entries(read_bundles(spark, src, ndjson=True)), ["Patient"], str(tmp_path / "s"))
    assert staged.count() == 2 and staged.columns == ["resource", "resource_type", "wide"]
    for folder, column in ((tmp_path / "s", "resource"), (tmp_path / "wh", "gender")):
        for f in folder.rglob("*.parquet"):
            chunks = [pq.ParquetFile(f).metadata.row_group(0).column(i) for i in range(pq.ParquetFile(f).metadata.row_group(0).num_columns)] \
                if pq.ParquetFile(f).metadata.num_row_groups else []
            assert {c.compression for c in chunks} <= {"ZSTD"}
            assert not any("typed_value" in c.path_in_schema for c in chunks)


def test_bundle_text_holds_what_the_bundles_hold(spark, tmp_path):
    from care_analytics.sources.bundles import bundle_entries, read_bundles
    from driver_queries import etl as Q
    from driver_queries.resources import RoleResources
    tables = {
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, 'C"A\\', 1), (1, None, 2)]),
        "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
                     [(1, "a\nb", 0, 1.0, "x"), (7, None, 1, None, "é"), (7, "z", 1, 1e22, None), (None, "n", 0, -0.5, "y")]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
                   [(k, k % 4 + 1, "FOP"[k % 3], 10.5 * k, None, ("1-URGENT", "5-LOW", None)[k % 3]) for k in range(1, 8)] + [(None, None, None, None, None, None)]),
        "lineitem": ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_linestatus string, l_returnflag string, l_shipdate timestamp_ntz",
                     [(k, n, 1, None, 20.0 * n, "F", "NR"[n % 2], None) for k in range(1, 8) for n in range(3)]),
        "events": ("event_id long, user_id long, event_type string, value double, ts timestamp_ntz, props string",
                   [(i, i % 5 + 1, ("error", "signup", "view", "click", "else", None)[i % 6], 40.0 * i, None, '{"k": 1}') for i in range(13)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    Q._write_bundles(spark, str(tmp_path), f"{tmp_path}/text")
    assert list((tmp_path / "text").glob("*.gz")) and not list((tmp_path / "text").glob("*.txt"))
    RoleResources(Q._t(spark, str(tmp_path))).bundles().select(F.to_json(F.struct("entry")).alias("value")).write.text(f"{tmp_path}/before")
    of = lambda name: sorted((r["fullUrl"] or "", r["resource"].toJson() if r["resource"] else "") for r in bundle_entries(
        read_bundles(spark, f"{tmp_path}/{name}", ndjson=True)).select("fullUrl", "resource").collect())
    assert of("text") == of("before") and len(of("text")) > 90
