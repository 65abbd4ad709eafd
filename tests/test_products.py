"""Products of one resource's arrays: cut into slices, spread over tasks, the same rows."""

import pytest
from pyspark.sql import functions as F

from care_analytics.operators.flatten import FLATTENERS, explode_all, flatten, flatten_split, is_wide, spread_products
from care_analytics.sources.bundles import resources
from care_analytics.sources.warehouse import Warehouse
from tests.test_flatten import bundle, entries_of


def claim(name, a, b, c, d):
    """A claim with so many supporting infos, insurances, items and diagnoses (None: no such field)."""
    fields = {"supportingInfo": [{"valueReference": {"reference": f"s{i}"}} for i in range(a or 0)],
              "insurance": [{"coverage": {"display": f"i{i}"}} for i in range(b or 0)],
              "item": [{"productOrService": {"coding": [{"code": f"t{i}"}]}} for i in range(c or 0)],
              "diagnosis": [{"diagnosisReference": {"reference": f"d{i}"}} for i in range(d or 0)]}
    counts = dict(zip(fields, (a, b, c, d)))
    return {"resourceType": "Claim", "id": name, **{k: v for k, v in fields.items() if counts[k] is not None}}


CLAIMS = [claim("one", 1, 1, 1, 1), claim("many", 7, 5, 11, 3), claim("long", 1, 1, 40, 1), claim("none", 9, 0, 9, 9),
          claim("missing", None, 9, 9, 9), claim("same", 4, 4, 4, 4), claim("same", 4, 4, 4, 4)]


def as_text(df):
    return sorted(r.j for r in df.select(F.to_json(F.struct(*df.columns)).alias("j")).collect())


@pytest.mark.parametrize("rows", [1, 10, 100])
@pytest.mark.parametrize("outer", [False, True])
def test_rows_are_those_of_the_whole_product(spark, tmp_path, rows, outer):
    of = resources(entries_of(spark, tmp_path, [bundle(*CLAIMS)]), "Claim")
    spec = FLATTENERS["Claim"]
    assert as_text(flatten_split(of, spec, outer=outer, rows=rows)) == as_text(flatten(of, spec, outer=outer))


def test_no_slice_makes_more_rows_than_stated(spark):
    df = spark.createDataFrame([("a", [1] * 13, [2] * 9, [3] * 30), ("b", [], None, [4] * 50)], "id string, x array<int>, y array<int>, z array<int>")
    for rows in (1, 8, 30, 200):
        parts = spread_products(df, ["x", "y", "z"], rows)
        assert parts.columns == df.columns
        made = parts.select("id", (F.size("x") * F.size("y") * F.size("z")).alias("n")).filter("id = 'a'").collect()
        assert sum(r.n for r in made) == 13 * 9 * 30 and max(r.n for r in made) <= rows


def test_a_million_rows_of_one_resource_are_spread(spark, tmp_path):
    of = resources(entries_of(spark, tmp_path, [bundle(claim("huge", 32, 32, 32, 32), claim("small", 1, 1, 2, 1))]), "Claim")
    spec = FLATTENERS["Claim"]
    by_task = {r.p: r.n for r in flatten_split(of, spec, rows=4096).filter("claim_id = 'huge'")
               .groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(by_task.values()) == 32 ** 4
    assert len(by_task) > 1 and max(by_task.values()) < 0.5 * 32 ** 4
    key = F.xxhash64("supporting_info_value_reference", "insurance_coverage_display", "item_code", "diagnosis_reference")
    assert flatten_split(of, spec, rows=4096).filter("claim_id = 'huge'").select(key.alias("k")).distinct().count() == 32 ** 4


def test_explode_after_spreading_is_explode(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], ["a", "b"]), (2, [4], ["c"])], "id int, x array<int>, y array<string>")
    assert sorted(explode_all(spread_products(df, ["x", "y"], 2), ["x", "y"]).collect()) == sorted(explode_all(df, ["x", "y"]).collect())


@pytest.mark.parametrize("stage", ["parquet", "memory"])
def test_warehouse_reads_wide_resources_from_their_own_partition(spark, tmp_path, stage, monkeypatch):
    entries = entries_of(spark, tmp_path, [bundle(*CLAIMS)])
    monkeypatch.setattr(is_wide, "__defaults__", (100,))
    plans = {}
    write = Warehouse._write_table

    def explained(self, df, path):
        plans[path.rsplit("/", 1)[1]] = df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        write(self, df, path)
    monkeypatch.setattr(Warehouse, "_write_table", explained)
    wh = Warehouse(spark, str(tmp_path / "wh"))
    wh.build(entries, ["Claim", "Patient"], stage=stage)
    want = flatten(resources(entries, "Claim"), FLATTENERS["Claim"])
    assert as_text(wh.table("claim")) == as_text(want)
    assert "REPARTITION_BY_NUM" in plans["claim"] and "REPARTITION" not in plans["patient"]
    if stage == "parquet":
        filters = [x for x in plans["claim"].splitlines() if x.startswith("PartitionFilters")]
        assert len(filters) == 2 and all("wide" in x for x in filters)


def test_wide_products_count_elements_of_every_shape(spark):
    """An object is a list of one, and elements of any type, null too, are counted."""
    rows = ['{"activity":[{"a":1},null,"x",2,[3]],"careTeam":[1,{"b":[]}]}', '{"activity":{"a":1},"careTeam":[1,2,3]}', '{"activity":[],"careTeam":[1,2,3,4]}',
            '{"activity":"x"}', '{"careTeam":null}', 'null']
    res = spark.createDataFrame([(r,) for r in rows], "j string").select(F.parse_json("j").alias("resource"))
    counts = [max([n for n in range(13) if r[f"n{n}"]], default=-1) + 1
              for r in res.select(*[is_wide(F.col("resource"), FLATTENERS["CarePlan"], n).alias(f"n{n}") for n in range(13)]).collect()]
    assert counts == [10, 3, 4, 1, 1, 1]
