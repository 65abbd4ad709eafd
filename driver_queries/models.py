"""Registered model queries over the patient feature table.

Training, cross-validation and grid search are checked on row counts (the
numbers depend on the tree learner); preprocessing steps whose output is
exact are checked against SQL.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from care_analytics.plans import features as FT
from care_analytics.plans import models as M
from care_analytics.plans.imputers import MedianImputer
from .core import _features, register

# Parts that have gaps before they are filled: sums and flags of patients without claims, encounters or conditions.
GAPPED = ("total_healthcare_cost", "num_encounters", "num_claims", "num_conditions")


def _data(spark, sf) -> DataFrame:
    return _features(spark, sf)


def _stored(spark, sf, columns=FT.READMISSION_COLUMNS) -> DataFrame:
    """The feature table, derived once: fits pass over it many times."""
    return M.stored(_features(spark, sf, columns))


BUCKET = "CAST('0x' || substr(md5('{seed}:' || patient_id), 1, 8) AS BIGINT) % {n}"


@register("split_train_test", f"SELECT patient_id, {BUCKET.format(seed=M.SEED, n=10000)} < 2000 AS is_test FROM features")
def split_train_test(spark, sf):
    return M.with_split(_data(spark, sf)).select("patient_id", "is_test")


@register("fold_patients", f"SELECT patient_id, CAST({BUCKET.format(seed=M.SEED + 1, n=5)} AS INTEGER) AS fold FROM features")
def fold_patients(spark, sf):
    return M.with_folds(_data(spark, sf)).select("patient_id", "fold")


def _gapped(spark, sf) -> DataFrame:
    """The feature table with gaps where a count is 0 (and one in seven states), as it is before they are filled."""
    data = M.prepare(_stored(spark, sf, FT.RISK_COLUMNS))
    gaps = {c: F.when(F.col(c) != 0, F.col(c)) for c in GAPPED}
    state = F.when(F.conv(F.substring(F.md5("patient_id"), 1, 2), 16, 10).cast("int") % 7 != 0, F.col("state"))
    chronic = F.when(F.col("has_chronic_conditions") != "0", F.col("has_chronic_conditions"))
    return data.withColumns({**gaps, "state": state, "has_chronic_conditions": chronic})


IMPUTE_MEDIAN_SQL = "SELECT patient_id, " + ", ".join(
    f"COALESCE(NULLIF(CAST({c} AS DOUBLE), 0), quantile_disc(NULLIF(CAST({c} AS DOUBLE), 0), 0.5) OVER ()) AS {c}" for c in GAPPED) \
    + " FROM features"


@register("impute_median", IMPUTE_MEDIAN_SQL)
def impute_median(spark, sf):
    data = _gapped(spark, sf)
    out = [f"{c}__imp" for c in GAPPED]
    imp = MedianImputer(inputCols=list(GAPPED), outputCols=out)
    return imp.fit(data).transform(data).select("patient_id", *[F.col(o).alias(c) for o, c in zip(out, GAPPED)])


def _z_sql() -> str:
    cols = []
    for c in FT.NUMERIC_FEATURES:
        x = f"CAST({c} AS DOUBLE)"
        sd = f"STDDEV_SAMP({x}) OVER ()"
        cols.append(f"ROUND(CASE WHEN {sd} = 0 THEN 0.0 ELSE ({x} - AVG({x}) OVER ()) / {sd} END, 4)"
                    f" AS z_{c}")
    return "SELECT patient_id, " + ", ".join(cols) + " FROM features"


@register("standardise_features", _z_sql())
def standardise_features(spark, sf):
    data = M.prepare(_stored(spark, sf, FT.NUMERIC_FEATURES))     # no other column is read: first and last times would be shuffled and written
    imputed = [f"{c}__imp" for c in FT.NUMERIC_FEATURES]
    pipe = Pipeline(stages=[
        MedianImputer(inputCols=list(FT.NUMERIC_FEATURES), outputCols=imputed),
        VectorAssembler(inputCols=imputed, outputCol="num__vec"),
        StandardScaler(inputCol="num__vec", outputCol="num__scaled", withMean=True, withStd=True),
    ])
    return M.scaled_columns(pipe.fit(data), data)


@register("impute_most_frequent", """
SELECT * FROM (WITH gapped AS (
  SELECT patient_id, CASE WHEN CAST('0x' || substr(md5(patient_id), 1, 2) AS BIGINT) % 7 <> 0 THEN state END AS state,
    NULLIF(CAST(has_chronic_conditions AS VARCHAR), '0') AS has_chronic_conditions, CAST(is_senior AS VARCHAR) AS is_senior FROM features)
SELECT patient_id,
  COALESCE(state, (SELECT state FROM gapped WHERE state IS NOT NULL GROUP BY state ORDER BY COUNT(*) DESC, state LIMIT 1)) AS state,
  COALESCE(has_chronic_conditions, (SELECT has_chronic_conditions FROM gapped WHERE has_chronic_conditions IS NOT NULL
    GROUP BY has_chronic_conditions ORDER BY COUNT(*) DESC, has_chronic_conditions LIMIT 1), '') AS has_chronic_conditions,
  is_senior FROM gapped)""")
def impute_most_frequent(spark, sf):
    data = _gapped(spark, sf)
    return M.ModeImputer(FT.CATEGORICAL_FEATURES).fit(data).transform(data).select("patient_id", *FT.CATEGORICAL_FEATURES)


def _one_hot_sql() -> str:
    idx = ", ".join(
        f"CAST(DENSE_RANK() OVER (ORDER BY CAST({c} AS VARCHAR)) - 1 AS DOUBLE) AS {c}_index"
        for c in FT.CATEGORICAL_FEATURES)
    # one-hot width per column: every category, plus the indexer's slot for
    # unseen labels, plus the encoder's slot for invalid indices
    width = " + ".join(f"(SELECT COUNT(DISTINCT {c}) + 2 FROM features)"
                       for c in FT.CATEGORICAL_FEATURES)
    return (f"SELECT patient_id, {idx}, CAST({len(FT.NUMERIC_FEATURES)} + {width} AS INTEGER) "
            "AS num_features FROM features")


@register("one_hot_categories", _one_hot_sql())
def one_hot_categories(spark, sf):
    data = M.prepare(_stored(spark, sf, FT.RISK_COLUMNS))
    stages = M.preprocess_stages()
    model = Pipeline(stages=stages).fit(data)
    out = model.transform(data)
    return out.select("patient_id", *[F.col(f"{c}__idx").alias(f"{c}_index")
                                      for c in FT.CATEGORICAL_FEATURES],
                      F.size(vector_to_array("features")).alias("num_features"))


@register("encode_labels", """
SELECT patient_id, state, CAST(DENSE_RANK() OVER (ORDER BY state) - 1 AS DOUBLE) AS state_index
FROM features""")
def encode_labels(spark, sf):
    data = _data(spark, sf).select("patient_id", "state")
    idx = StringIndexer(inputCol="state", outputCol="state_index", stringOrderType="alphabetAsc")
    return idx.fit(data).transform(data)


def _fit_query(name: str, pipeline_fn, columns=FT.RISK_COLUMNS):
    @register(name)
    def q(spark, sf):
        data = _stored(spark, sf, columns)
        _, m = M.fit_evaluate(spark, pipeline_fn(), data, name)
        return m
    q.__name__ = name
    return q


_fit_query("train_forest_risk", lambda: M.forest())
_fit_query("train_forest_readmission",
           lambda: M.forest(numTrees=100, maxDepth=10, minInstancesPerNode=4,
                            featureSubsetStrategy="sqrt"), FT.READMISSION_COLUMNS)
_fit_query("train_boosted_risk", lambda: M.boosted(encoded=True))


def readmission_boosted():
    return M.boosted(100, 0.3, maxDepth=10, minInstancesPerNode=4, featureSubsetStrategy="sqrt")


_fit_query("train_boosted_readmission", readmission_boosted, FT.READMISSION_COLUMNS)


@register("regression_metrics", """
SELECT ROUND(AVG((CAST(label AS DOUBLE) - p) * (CAST(label AS DOUBLE) - p)), 6) AS mse,
  ROUND(1 - AVG((CAST(label AS DOUBLE) - p) * (CAST(label AS DOUBLE) - p)) / VAR_POP(CAST(label AS DOUBLE)), 6) AS r2,
  COUNT(*) AS num_rows
FROM (SELECT f.label, s.p FROM features f
      JOIN (SELECT state, CAST(SUM(label) AS DOUBLE) / COUNT(label) AS p FROM features GROUP BY state) s
      ON f.state = s.state)""")
def regression_metrics(spark, sf):
    """MSE and R-squared of a per-state mean-label baseline over all patients."""
    data = _data(spark, sf)
    baseline = data.groupBy("state").agg(
        (F.sum("label").cast("double") / F.count("label")).alias("prediction"))
    return M.metrics(data.join(baseline, "state"))


def _cv(spark, pipeline, data) -> DataFrame:
    mse = M.cross_validate(spark, pipeline, data, folds=5)
    return spark.createDataFrame([(5, float(mse[0]))], "folds int, cv_mse double")


@register("cross_validate_forest")
def cross_validate_forest(spark, sf):
    """The readmission forest, over folds of all rows."""
    return _cv(spark, M.forest(maxDepth=10, minInstancesPerNode=4, featureSubsetStrategy="sqrt"), _stored(spark, sf))


@register("cross_validate_forest_risk")
def cross_validate_forest_risk(spark, sf):
    """The risk forest, over folds of the training part."""
    return _cv(spark, M.forest(), M.split(_stored(spark, sf, FT.RISK_COLUMNS))[0])


@register("cross_validate_boosted")
def cross_validate_boosted(spark, sf):
    """The boosted readmission model, over folds of all rows."""
    return _cv(spark, readmission_boosted(), _stored(spark, sf))


@register("cross_validate_boosted_risk")
def cross_validate_boosted_risk(spark, sf):
    """The boosted risk model (1000 rounds), over folds of the training part."""
    return _cv(spark, M.boosted(encoded=True), M.split(_stored(spark, sf, FT.RISK_COLUMNS))[0])


def _grid(spark, data) -> DataFrame:
    """All 54 points on the training part, best first, and the held-out error of the best one, refitted."""
    _, m, points = M.best_of_grid(spark, M.forest(), data, "forest")
    held = m.first()
    rows = [(k, int(p["numTrees"]), int(p["maxDepth"]), int(p["minInstancesPerNode"]), str(p["featureSubsetStrategy"]), e,
             held["mse"] if k == 0 else None, held["r2"] if k == 0 else None) for k, (p, e) in enumerate(points)]
    return spark.createDataFrame(rows, "place int, num_trees int, max_depth int, min_leaf int, feature_subset string, "
                                       "cv_mse double, held_out_mse double, held_out_r2 double")


@register("grid_search_forest")
def grid_search_forest(spark, sf):
    """The readmission grid."""
    return _grid(spark, _stored(spark, sf))


@register("grid_search_forest_risk")
def grid_search_forest_risk(spark, sf):
    """The risk grid."""
    return _grid(spark, _stored(spark, sf, FT.RISK_COLUMNS))


@register("score_patients")
def score_patients(spark, sf):
    data = _stored(spark, sf)
    model, _ = M.fit_evaluate(spark, M.forest(), data, "forest")
    return M.score(model, data)
