"""Fits read a stored, packed input; bundle sources reach all tasks; arrays are decoded once."""

from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from care_analytics.operators.flatten import FLATTENERS, flatten
from care_analytics.plans import features as FT
from care_analytics.plans import models as M
from driver_queries import models as Q
from driver_queries.resources import spread
from tests.test_models import planted, small


def test_few_rows_are_packed_into_few_partitions(spark):
    df = spark.range(0, 20_000, numPartitions=60).groupBy((F.col("id") % 10_000).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    one, more = M.packed(df, 32_768), M.packed(df, 4_000)
    try:
        assert one.rdd.getNumPartitions() == 1 and more.rdd.getNumPartitions() == 3
        assert one.count() == more.count() == 10_000
    finally:
        one.unpersist()
        more.unpersist()
    assert M.rows_per_task(GBTRegressor()) > M.rows_per_task(RandomForestRegressor())


def test_a_stored_table_is_not_derived_again(spark):
    derived = spark.sparkContext.accumulator(0)

    def seen(x):
        derived.add(1)
        return x
    data = M.stored(spark.range(100).select(F.udf(seen, "long")("id").alias("v"), F.lit(None).cast("string").alias("s")))
    assert sum(r["v"] for r in data.collect()) == 4950 and data.count() == 100 and data.filter("v > 5").count() == 94
    assert derived.value == 100 and data.dtypes == [("v", "bigint"), ("s", "string")]


def test_folds_run_beside_each_other(spark, monkeypatch):
    import threading
    import time
    at_once, most, lock = [0], [0], threading.Lock()
    fit = M.Pipeline.fit

    def slow(self, *args):
        with lock:
            at_once[0] += 1
            most[0] = max(most[0], at_once[0])
        time.sleep(0.5)
        try:
            return fit(self, *args)
        finally:
            with lock:
                at_once[0] -= 1
    monkeypatch.setattr(M, "prepare", lambda df: df)
    monkeypatch.setattr(M, "check_categories", lambda df: None)
    monkeypatch.setattr(M.Pipeline, "fit", slow)
    (mse,) = M.cross_validate(spark, small(M.encoded_stages, GBTRegressor(labelCol="label", maxIter=5, maxDepth=4, stepSize=0.5, seed=1)), planted(spark, 200), folds=3)
    assert most[0] > 1 and 0 < mse < 0.6


def test_source_rows_are_dealt_to_all_tasks(spark):
    dealt = spread(spark.range(0, 1000, numPartitions=1))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    sizes = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == tasks and dealt.agg(F.sum("id")).first()[0] == 499_500


def test_arrays_are_decoded_once(spark):
    rows = ['{"id":"a","dosageInstruction":[{"text":"x"},null,{}]}', '{"id":"b","dosageInstruction":[]}', '{"id":"c"}']
    res = spark.createDataFrame([(r,) for r in rows], "j string").select(F.parse_json("j").alias("resource"))
    flat = flatten(res, FLATTENERS["MedicationRequest"]).select("medication_request_id", "dosage_text")
    assert sorted(map(tuple, flat.collect()), key=str) == sorted([("a", "x"), ("a", None), ("a", None)], key=str)
    plan = flat._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(") == 1, plan


def test_boosted_fits_keep_no_node_ids(spark):
    assert not M.boosted(encoded=True).getStages()[-1].getCacheNodeIds()


def test_forest_fits_keep_node_ids_and_grow_the_same_trees(spark):
    from pyspark.ml.feature import VectorAssembler
    x = [(F.xxhash64("id", F.lit(i)) % 100).cast("double").alias(f"x{i}") for i in range(4)]
    rows = VectorAssembler(inputCols=[f"x{i}" for i in range(4)], outputCol="features").transform(
        spark.range(300).select(*x).withColumn("label", F.col("x0") + F.abs("x1"))).cache()
    try:
        kept = M.forest(numTrees=4, maxDepth=12).getStages()[-1]
        assert kept.getCacheNodeIds()
        walked = kept.copy().setParams(cacheNodeIds=False)
        assert kept.fit(rows).toDebugString.split("\n")[1:] == walked.fit(rows).toDebugString.split("\n")[1:]
    finally:
        rows.unpersist()


def test_the_medians_of_all_folds_take_one_set_of_passes(spark, monkeypatch):
    from care_analytics.plans import imputers
    passes, one_pass = [], imputers._pass
    monkeypatch.setattr(imputers, "_pass", lambda *a: (passes.append(1), one_pass(*a))[1])
    rows = [(i % 3 if i < 20 else None, float(i * i % 17) if i % 5 else None, float(-i), "a") for i in range(24)]
    df = spark.createDataFrame(rows, "fold int, x double, y double, s string")
    median = M.MedianImputer(inputCols=["x", "y"], outputCols=["x2", "y2"])
    of_fold = M.stages_of_folds([M.ModeImputer(["s"]), median], df, 3)
    assert len(passes) == 6
    for k, stages in enumerate(of_fold):
        assert isinstance(stages[0], M.ModeImputer) and stages[1].columns() == [("x", "x2"), ("y", "y2")]
        assert stages[1].getOrDefault("values") == median.fit(df.filter(F.col("fold") != k)).getOrDefault("values")
    again = M.MedianImputer(inputCols=["x2"], outputCols=["x3"])
    assert M.stages_of_folds([median, again], df, 3)[1][1] is again


def test_standardise_features_stores_only_what_it_scales(spark, tmp_path, monkeypatch):
    tables = {
        "nation": ("n_nationkey int, n_name string", [(0, "CA"), (1, "KENYA")]),
        "customer": ("c_custkey long, c_nationkey int, c_mktsegment string, c_acctbal double", [(k, k % 2, "x", 1.0) for k in range(1, 6)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
                   [(k, k % 4 + 1, "FOP"[k % 3], 10.5 * k, None, "1-URGENT") for k in range(1, 12)]),
        "lineitem": ("l_orderkey long, l_linenumber int, l_partkey long", [(k, n, 1) for k in range(1, 14) for n in range(k % 3)]),
        "part": ("p_partkey long, p_name string", [(1, "p")]),
        "events": ("event_id long, user_id long, event_type string, value double, ts timestamp_ntz, props string",
                   [(i, i % 5 + 1, ("error", "signup", "view")[i % 3], 40.0 * i, None, None) for i in range(17)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    kept, stored = [], M.stored
    monkeypatch.setattr(M, "stored", lambda df: (kept.append(df), stored(df))[1])
    got = Q.standardise_features(spark, str(tmp_path)).orderBy("patient_id").collect()
    assert kept[0].columns == ["patient_id", *FT.NUMERIC_FEATURES]
    assert "o_orderdate" not in kept[0]._jdf.queryExecution().executedPlan().toString()
    whole = Q._features(spark, str(tmp_path)).orderBy("patient_id").collect()
    assert [r["patient_id"] for r in got] == [r["patient_id"] for r in whole] == [f"p{k}" for k in range(1, 6)]
    for c in FT.NUMERIC_FEATURES:
        x = [float(r[c]) for r in whole]
        mean = sum(x) / 5
        sd = (sum((v - mean) ** 2 for v in x) / 4) ** 0.5
        assert [r[f"z_{c}"] for r in got] == [round((v - mean) / sd, 4) if sd else 0.0 for v in x], c
