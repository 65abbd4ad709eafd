"""Risk and readmission regressors on the patient feature table, with MLlib.

The original collects the feature table to one process and trains there.
Here every step is an MLlib stage or a DataFrame aggregate, so fitting runs
on executors and scales with the table:

- split and folds: an MD5 of the patient id, stable under any repartitioning
  (``randomSplit`` depends on partition layout) and the same in SQL;
- exact median imputation (``MedianImputer``), scaling (``StandardScaler``), most-frequent
  imputation of categoricals (``ModeImputer``), one-hot encoding (``StringIndexer`` +
  ``OneHotEncoder``), all stages of one ``Pipeline``, so they are fitted on the
  training rows of a split or fold only;
- ``RandomForestRegressor`` / ``GBTRegressor``; metrics as one aggregate;
  k-fold cross-validation and grid search fit the preprocessing once per fold and
  search over the last stage.

Long tree ensembles checkpoint their node ids to the session's shared
checkpoint folder, so a lost executor costs a few iterations, not the fit.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from . import nested
from .features import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from .imputers import MedianImputer, MedianImputerModel, ModeImputer, exact_medians

LABEL = "label"
SEED = 42


# -- splitting ------------------------------------------------------------------------

def hash_bucket(id_col: str, buckets: int, seed: int = SEED) -> Column:
    """First 32 bits of the MD5 of ``seed:id``, modulo ``buckets``."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(buckets)


def with_split(df: DataFrame, id_col: str = "patient_id", test: float = 0.2,
               seed: int = SEED) -> DataFrame:
    """Adds ``is_test``: about ``test`` of the ids, the same on every run."""
    return df.withColumn("is_test", hash_bucket(id_col, 10000, seed) < int(round(test * 10000)))


def split(df: DataFrame, id_col: str = "patient_id", test: float = 0.2,
          seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    s = with_split(df, id_col, test, seed)
    return s.filter(~F.col("is_test")).drop("is_test"), s.filter("is_test").drop("is_test")


def with_folds(df: DataFrame, id_col: str = "patient_id", folds: int = 5,
               seed: int = SEED) -> DataFrame:
    return df.withColumn("fold", hash_bucket(id_col, folds, seed + 1).cast("int"))


# -- preprocessing ----------------------------------------------------------------------

def mode_impute(df: DataFrame, columns: Sequence[str], source: DataFrame | None = None) -> DataFrame:
    """Fill NULLs of ``columns`` with the most frequent value (ties -> smallest).

    Each mode is a scalar subquery over ``source`` (default ``df``): one small
    aggregate, no join.
    """
    source = source if source is not None else df
    for c in columns:
        m = source.select(F.mode(c, deterministic=True)).scalar()
        df = df.withColumn(c, F.coalesce(F.col(c), m))
    return df


def as_double(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if c in columns else F.col(c)
                       for c in df.columns])


def preprocess_stages(numeric: Sequence[str] = NUMERIC_FEATURES,
                      categorical: Sequence[str] = CATEGORICAL_FEATURES,
                      features: str = "features") -> list:
    """Median impute + scale numerics; index + one-hot categoricals; assemble."""
    imputed = [f"{c}__imp" for c in numeric]
    idx = [f"{c}__idx" for c in categorical]
    ohe = [f"{c}__ohe" for c in categorical]
    return [
        ModeImputer(categorical),
        MedianImputer(inputCols=list(numeric), outputCols=imputed),
        VectorAssembler(inputCols=imputed, outputCol="num__vec", handleInvalid="keep"),
        StandardScaler(inputCol="num__vec", outputCol="num__scaled", withMean=True, withStd=True),
        StringIndexer(inputCols=list(categorical), outputCols=idx, handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=False, handleInvalid="keep"),
        VectorAssembler(inputCols=["num__scaled", *ohe], outputCol=features),
    ]


def encoded_stages(numeric: Sequence[str] = NUMERIC_FEATURES, categorical: Sequence[str] = CATEGORICAL_FEATURES,
                   features: str = "features") -> list:
    """Categoricals as label numbers, numerics unscaled (missing ones get the median: MLlib's trees take no NaN)."""
    imputed = [f"{c}__imp" for c in numeric]
    idx = [f"{c}__idx" for c in categorical]
    return [
        ModeImputer(categorical),
        MedianImputer(inputCols=list(numeric), outputCols=imputed),
        StringIndexer(inputCols=list(categorical), outputCols=idx, handleInvalid="keep", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=[*imputed, *idx], outputCol=features, handleInvalid="keep"),
    ]


def prepare(df: DataFrame, numeric: Sequence[str] = NUMERIC_FEATURES,
            categorical: Sequence[str] = CATEGORICAL_FEATURES) -> DataFrame:
    """Numeric inputs as DOUBLE, categoricals as text."""
    out = as_double(df, numeric)
    return out.select(*[F.col(c).cast("string").alias(c) if c in categorical else F.col(c)
                        for c in out.columns])


CATEGORIES = 10_000        # distinct values a categorical column may have: the indexer keeps them on the driver


def check_categories(df: DataFrame, categorical: Sequence[str] = CATEGORICAL_FEATURES, limit: int = CATEGORIES) -> None:
    """Raises when a categorical column has clearly more than ``limit`` distinct values (one aggregate)."""
    row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in categorical]).first()
    over = [c for c in categorical if row[c] > 1.2 * limit]
    if over:
        raise ValueError(f"columns {over} have more than {limit} distinct values: they are no categories")


# -- estimators -----------------------------------------------------------------------------

MAX_DEPTH = 30             # MLlib's limit; a depth without limit is asked for as this


def forest(numTrees: int = 100, maxDepth: int = MAX_DEPTH, minInstancesPerNode: int = 1,
           featureSubsetStrategy: str = "auto", seed: int = SEED,
           numeric=NUMERIC_FEATURES, categorical=CATEGORICAL_FEATURES, maxMemoryInMB: int = 1024) -> Pipeline:
    """Preprocessing + random forest. ``min_samples_split`` has no MLlib counterpart. The more memory for histograms, the
    fewer passes a level of many trees takes. Node ids are cached: without them every level walks every row through every tree
    from its root, also to leaves that are done."""
    rf = RandomForestRegressor(featuresCol="features", labelCol=LABEL, numTrees=numTrees,
                               maxDepth=maxDepth, minInstancesPerNode=minInstancesPerNode,
                               featureSubsetStrategy=featureSubsetStrategy, seed=seed, maxMemoryInMB=maxMemoryInMB,
                               cacheNodeIds=True)
    return Pipeline(stages=[*preprocess_stages(numeric, categorical), rf])


def boosted(maxIter: int = 1000, stepSize: float = 0.01, maxDepth: int = 6,
            minInstancesPerNode: int = 1, featureSubsetStrategy: str = "all", seed: int = SEED,
            checkpointInterval: int = 10, numeric=NUMERIC_FEATURES,
            categorical=CATEGORICAL_FEATURES, encoded: bool = False) -> Pipeline:
    """Preprocessing + gradient-boosted trees (squared loss).

    Defaults are the risk model's (1000 rounds at 0.01), which reads label-encoded states and unscaled
    numbers (``encoded``); the readmission model uses 100 rounds, depth 10, step 0.3, 4 rows per
    leaf, sqrt features. Node ids are not cached: a round grows one shallow tree, and walking it is less than
    keeping a set of ids for each of its levels.
    """
    gbt = GBTRegressor(featuresCol="features", labelCol=LABEL, maxIter=maxIter, stepSize=stepSize,
                       maxDepth=maxDepth, minInstancesPerNode=minInstancesPerNode,
                       featureSubsetStrategy=featureSubsetStrategy, seed=seed,
                       checkpointInterval=checkpointInterval)
    return Pipeline(stages=[*(encoded_stages if encoded else preprocess_stages)(numeric, categorical), gbt])


# -- evaluation ------------------------------------------------------------------------------

def metrics(predictions: DataFrame, label: str = LABEL, prediction: str = "prediction",
            digits: int | None = 6) -> DataFrame:
    """One row: ``mse``, ``r2`` (1 - SSE/SST), ``num_rows`` from one aggregate."""
    err = (F.col(label).cast("double") - F.col(prediction).cast("double"))
    y = F.col(label).cast("double")
    agg = predictions.agg(F.avg(err * err).alias("mse"), F.var_pop(y).alias("_var"),
                          F.count(F.lit(1)).alias("num_rows"))
    r2 = F.lit(1.0) - F.try_divide(F.col("mse"), F.col("_var"))
    out = agg.select(F.col("mse"), r2.alias("r2"), "num_rows")
    if digits is not None:
        out = out.select(F.round("mse", digits).alias("mse"), F.round("r2", digits).alias("r2"),
                         "num_rows")
    return out


def stored(df: DataFrame, name: str = "features") -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back (an action): fits pass over their input many times, and
    without this each pass derives the feature table anew. The folder stays, as lazy results read it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


FOREST_ROWS, BOOSTED_ROWS = 8_192, 32_768     # rows of a task: a forest does the work of all its trees on a row at once
TASKS = 4                                     # tasks for each core at most


def packed(df: DataFrame, rows: int = FOREST_ROWS) -> DataFrame:
    """``df`` cached in partitions of about ``rows`` rows, ``TASKS`` for each core at most: a tree learner runs a few jobs per level, so
    every near-empty partition costs a task each time, and every task sends histograms of all nodes (an action that counts rows)."""
    most = TASKS * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(most, -(-df.count() // rows)))).persist()


def rows_per_task(estimator) -> int:
    return BOOSTED_ROWS if isinstance(estimator, GBTRegressor) else FOREST_ROWS


def fit_evaluate(spark, pipeline: Pipeline, data: DataFrame, name: str,
                 id_col: str = "patient_id", test: float = 0.2) -> tuple[PipelineModel, DataFrame]:
    """Fit every stage on the hash-split training part; metrics on the held-out part."""
    spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    train, held_out = split(prepare(data), id_col, test)
    train = packed(train, rows_per_task(pipeline.getStages()[-1]))
    try:
        check_categories(train)
        model = pipeline.fit(train)
    finally:
        train.unpersist()
    m = metrics(model.transform(held_out)).withColumn("model", F.lit(name))
    return model, m.select("model", "mse", "r2", "num_rows")


def stages_of_folds(stages: list, folded: DataFrame, folds: int) -> list[list]:
    """The stages of each fold, with the medians of its training rows in place of the imputer that would learn them (an action): a column
    for each fold, NULL on its held-out rows, finds the medians of all folds in one set of passes. An imputer that reads what an earlier
    stage makes stays as it is."""
    out = [list(stages) for _ in range(folds)]
    for at, stage in enumerate(stages):
        if isinstance(stage, MedianImputer):
            names, outputs = map(list, zip(*stage.columns()))
            made = {o for s in stages[:at] if isinstance(s, (ModeImputer, MedianImputer)) for _, o in s.columns()}
            if made & set(names) or any(not isinstance(s, (ModeImputer, MedianImputer)) for s in stages[:at]):
                continue
            wide = folded.select(*[F.when(F.col("fold") != k, F.col(c)).alias(f"{k}_{i}") for k in range(folds) for i, c in enumerate(names)])
            found = exact_medians(wide, wide.columns, stage.getOrDefault(stage.mean))
            for k in range(folds):
                out[k][at] = MedianImputerModel(inputCols=names, outputCols=outputs, values=[found[f"{k}_{i}"] for i in range(len(names))])
    return out


FOLDS_AT_ONCE = 5          # a boosted fit is a chain of short jobs that leave most cores idle; folds run beside each other


def cross_validate(spark, pipeline: Pipeline, data: DataFrame, folds: int = 5,
                   id_col: str = "patient_id", grid=None, parallelism: int = 4) -> list[float]:
    """Mean squared error per grid point of the last stage, over ``folds`` hash folds (an action).

    The other stages are fitted once per fold, on its training rows, and their vectors kept for all
    points; ``parallelism`` points of a fold are fitted at once, and folds beside each other. Points of a forest that differ in trees and depth only
    share one fit (``nested``).
    """
    spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    *stages, estimator = pipeline.getStages()
    grid = grid or [{}]
    rows = rows_per_task(estimator)
    prepared = packed(with_folds(prepare(data), id_col, folds), rows)
    judge = RegressionEvaluator(labelCol=LABEL, metricName="mse")
    total = [0.0] * len(grid)
    try:
        check_categories(prepared)
        if isinstance(estimator, RandomForestRegressor) and len(grid) > 1:
            return nested.cross_validated(spark, stages, estimator, prepared, grid, folds, parallelism, packed, LABEL)
        prepared.count()                                 # cached once, before the folds share it
        of_fold = stages_of_folds(stages, prepared, folds)

        def judged(fold: int) -> list[float]:
            model = Pipeline(stages=of_fold[fold]).fit(prepared.filter(F.col("fold") != fold))
            train, valid = (packed(model.transform(prepared.filter(part)).select("features", LABEL), rows)
                            for part in (F.col("fold") != fold, F.col("fold") == fold))
            with ThreadPool(min(parallelism, len(grid))) as pool:
                errors = pool.map(lambda point: judge.evaluate(estimator.fit(train, point).transform(valid)), grid)
            train.unpersist()
            valid.unpersist()
            return errors
        with ThreadPool(min(folds, FOLDS_AT_ONCE)) as pool:
            for errors in pool.map(judged, range(folds)):
                total = [a + e / folds for a, e in zip(total, errors)]
    finally:
        prepared.unpersist()
    return total


def grid_search(spark, pipeline: Pipeline, data: DataFrame, grid=None, folds: int = 5,
                parallelism: int = 4, id_col: str = "patient_id") -> list[tuple[dict, float]]:
    """Cross-validated MSE for every grid point, best first (an action).

    ``grid`` defaults to ``default_grid`` over the pipeline's last stage.
    """
    grid = grid or default_grid(pipeline.getStages()[-1])
    mse = cross_validate(spark, pipeline, data, folds=folds, id_col=id_col, grid=grid,
                         parallelism=parallelism)
    points = [({p.name: v for p, v in point.items()}, float(m)) for point, m in zip(grid, mse)]
    return sorted(points, key=lambda x: x[1])


def best_of_grid(spark, pipeline: Pipeline, data: DataFrame, name: str, grid=None, folds: int = 5, parallelism: int = 4,
                 id_col: str = "patient_id", test: float = 0.2) -> tuple[PipelineModel, DataFrame, list[tuple[dict, float]]]:
    """Searches the grid on the training part, refits the best point on all of it and judges that on the
    held-out part: (model, metrics, points)."""
    points = grid_search(spark, pipeline, split(data, id_col, test)[0], grid, folds, parallelism, id_col)
    *stages, estimator = pipeline.getStages()
    best = estimator.copy({estimator.getParam(n): v for n, v in points[0][0].items()})
    model, m = fit_evaluate(spark, Pipeline(stages=[*stages, best]), data, name, id_col, test)
    return model, m, points


def default_grid(estimator) -> list:
    """The original's grid without ``min_samples_split``, which MLlib lacks: 54 points."""
    return (ParamGridBuilder()
            .addGrid(estimator.numTrees, [100, 200, 300])
            .addGrid(estimator.maxDepth, [10, 15, 20])
            .addGrid(estimator.minInstancesPerNode, [2, 4, 6])
            .addGrid(estimator.featureSubsetStrategy, ["sqrt", "log2"])
            .build())


def save(model: PipelineModel, path: str, overwrite: bool = False) -> str:
    """Stores a fitted pipeline, imputers included, under ``path`` on any Hadoop file system."""
    (model.write().overwrite() if overwrite else model.write()).save(path)
    return path


def load(spark, path: str) -> PipelineModel:
    """A stored pipeline, ready to score in this session."""
    return PipelineModel.read().session(spark).load(path)


def score(model: PipelineModel, data: DataFrame, id_col: str = "patient_id") -> DataFrame:
    """Predictions per patient; missing values are filled as in training."""
    return model.transform(prepare(data)).select(id_col, "prediction")


def scaled_columns(model: PipelineModel, data: DataFrame, numeric=NUMERIC_FEATURES,
                   id_col: str = "patient_id", digits: int = 4) -> DataFrame:
    """The standardised numeric features as columns ``z_<name>``."""
    arr = vector_to_array(F.col("num__scaled"))
    out = model.transform(data)
    return out.select(id_col, *[F.round(arr[i], digits).alias(f"z_{c}") for i, c in enumerate(numeric)])
