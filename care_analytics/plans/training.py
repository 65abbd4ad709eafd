"""Warehouse tables -> fitted risk and readmission models, their held-out metrics and scores.

    python -m care_analytics.plans.training <warehouse_root> <results_root> [as_of]
"""

from __future__ import annotations

import sys

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ..session import configure
from ..sources.warehouse import Warehouse, write_result
from . import features, models


def feature_table(wh: Warehouse, as_of=None, columns=features.READMISSION_COLUMNS) -> DataFrame:
    return features.patient_features(*(wh.table(n) for n in (
        "patient", "claim", "encounter", "condition", "procedure", "immunization", "diagnostic_report")),
        as_of=as_of, columns=columns)


def pipelines() -> dict[str, Pipeline]:
    """The four models of the analyses, by name."""
    return {
        "risk_forest": models.forest(),
        "risk_boosted": models.boosted(encoded=True),
        "readmission_forest": models.forest(maxDepth=10, minInstancesPerNode=4, featureSubsetStrategy="sqrt"),
        "readmission_boosted": models.boosted(100, 0.3, maxDepth=10, minInstancesPerNode=4, featureSubsetStrategy="sqrt"),
    }


def train(spark: SparkSession, wh: Warehouse, results_root: str, as_of=None,
          chosen: dict[str, Pipeline] | None = None) -> dict[str, PipelineModel]:
    """Fits each pipeline on the training part of the feature table and publishes ``model_metrics`` (held-out rows)
    and ``scores_<name>`` (every patient). The feature table is written once and read by all; the fitted models are stored
    under ``models``."""
    table = spark.read.parquet(write_result(feature_table(wh, as_of), results_root, "patient_features"))
    fitted, judged = {}, None
    for name, pipeline in (chosen or pipelines()).items():
        columns = features.RISK_COLUMNS if name.startswith("risk") else features.READMISSION_COLUMNS
        data = table.select(features.KEY, *columns)
        fitted[name], m = models.fit_evaluate(spark, pipeline, data, name)
        models.save(fitted[name], f"{results_root.rstrip('/')}/models/{name}", overwrite=True)
        write_result(models.score(fitted[name], data), results_root, f"scores_{name}")
        judged = m if judged is None else judged.unionByName(m)
    write_result(judged, results_root, "model_metrics")
    return fitted


def score_stored(spark: SparkSession, wh: Warehouse, results_root: str, name: str, as_of=None) -> DataFrame:
    """Predictions of a model that ``train`` stored, for the patients of ``wh``: no fit."""
    columns = features.RISK_COLUMNS if name.startswith("risk") else features.READMISSION_COLUMNS
    return models.score(models.load(spark, f"{results_root.rstrip('/')}/models/{name}"), feature_table(wh, as_of, columns))


def main(argv: list[str]) -> None:
    spark = configure(SparkSession.builder.appName("care_analytics_training").getOrCreate())
    train(spark, Warehouse(spark, argv[0]), argv[1], argv[2] if len(argv) > 2 else None)


if __name__ == "__main__":
    main(sys.argv[1:])
