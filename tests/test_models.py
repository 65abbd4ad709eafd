from pyspark.sql import functions as F

from care_analytics.plans import models as M


def test_split_disjoint_complete_and_stable(spark):
    df = spark.range(2000).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("patient_id"))
    train, test = M.split(df)
    n_train, n_test = train.count(), test.count()
    assert n_train + n_test == 2000 and 300 < n_test < 500
    assert train.join(test, "patient_id").count() == 0
    again = M.split(df.repartition(7))[1]
    assert sorted(r[0] for r in again.collect()) == sorted(r[0] for r in test.collect())


def test_folds_cover_range(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("patient_id"))
    folds = {r[0] for r in M.with_folds(df).select("fold").distinct().collect()}
    assert folds == {0, 1, 2, 3, 4}


def test_metrics_known_values(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.5), (1, 0.5), (0, 0.0)], "label int, prediction double")
    r = M.metrics(df).collect()[0]
    assert r.mse == 0.125 and r.r2 == 0.5 and r.num_rows == 4


def test_mode_impute_ties_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("a",)], "s string")
    out = [r[0] for r in M.mode_impute(df, ["s"]).collect()]
    assert out == ["b", "a", "a", "b", "a"]


def planted(spark, n=600, seed=3):
    """Patients whose label follows age and state, with gaps in both."""
    import random
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        age, state = rng.uniform(0, 90), rng.choice(["A", "B", "C"])
        label = 0.02 * age + {"A": 0.0, "B": 1.0, "C": 2.0}[state]
        rows.append((f"p{i}", None if i % 29 == 0 else state, None if i % 31 == 0 else age, label))
    return spark.createDataFrame(rows, "patient_id string, state string, age double, label double")


def small(stages, estimator):
    from pyspark.ml import Pipeline
    return Pipeline(stages=[*stages(["age"], ["state"]), estimator])


def test_models_find_a_planted_signal(spark, monkeypatch):
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
    monkeypatch.setattr(M, "prepare", lambda df: df)
    monkeypatch.setattr(M, "check_categories", lambda df: None)
    data = planted(spark)
    for stages, estimator in ((M.preprocess_stages, RandomForestRegressor(labelCol="label", numTrees=20, maxDepth=8, seed=1)),
                              (M.encoded_stages, GBTRegressor(labelCol="label", maxIter=20, maxDepth=4, seed=1))):
        model, m = M.fit_evaluate(spark, small(stages, estimator), data, "x")
        row = m.first()
        assert row["num_rows"] == M.split(data)[1].count() and row["r2"] > 0.8
        assert M.score(model, data).count() == 600


def test_grid_and_best_model(spark, monkeypatch):
    from pyspark.ml.regression import RandomForestRegressor
    from pyspark.ml.tuning import ParamGridBuilder
    monkeypatch.setattr(M, "prepare", lambda df: df)
    monkeypatch.setattr(M, "check_categories", lambda df: None)
    forest = RandomForestRegressor(labelCol="label", numTrees=5, seed=1)
    grid = ParamGridBuilder().addGrid(forest.maxDepth, [1, 6]).build()
    _, m, points = M.best_of_grid(spark, small(M.preprocess_stages, forest), planted(spark, 300), "x", grid, folds=3)
    assert [p["maxDepth"] for p, _ in points] == [6, 1] and points[0][1] < points[1][1]
    assert m.first()["r2"] > 0.5
    assert len(M.default_grid(M.forest().getStages()[-1])) == 54


def test_modes_are_learned_where_the_stage_is_fitted(spark):
    train = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "s string")
    other = spark.createDataFrame([("b",), ("b",), (None,)], "s string")
    model = M.ModeImputer(["s"]).fit(train)
    assert [r[0] for r in model.transform(other).collect()] == ["b", "b", "a"]


def test_too_many_categories_are_an_error(spark):
    import pytest
    df = spark.range(500).select(F.col("id").cast("string").alias("s"))
    with pytest.raises(ValueError, match="distinct"):
        M.check_categories(df, ["s"], limit=100)
