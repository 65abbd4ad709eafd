"""Encounter cube: counts and durations by class and demographic group, from one pass.

Gender, age and marital status belong to the patient, so encounters are first summed
per (patient, class), for all stays and for those the outlier filter keeps. A patient with very
many encounters becomes a few rows per map task before anything is shuffled on the
patient key, and only these summaries meet the patient table. Every duration and count report is
an aggregate of the cube, whose size does not grow with the encounters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.aggregates import ratio
from ..operators import grouping

GROUPS = ("gender", "age_group", "marital_status", "class_code")


def patient_stays(encounters_clean: DataFrame, limit: float = C.OUTLIER_STAY_MINUTES,
                  class_label: str = C.INPATIENT_LABEL) -> DataFrame:
    """One row per (patient, class): stays, stays with a duration, seconds, longest; ``kept_`` for those that
    ``cleaning.keep_short_stays`` keeps."""
    kept = F.coalesce((F.col("encounter_duration") <= limit) | (F.col("class_code") != class_label), F.lit(False))
    seconds = F.col("encounter_seconds")
    mine = F.when(kept, seconds)
    return encounters_clean.groupBy("patient_reference", "class_code").agg(
        F.count(F.lit(1)).alias("stays"), F.count(seconds).alias("timed"), F.sum(seconds).alias("seconds"),
        F.max(seconds).alias("longest"),
        F.count(F.when(kept, 1)).alias("kept_stays"), F.count(mine).alias("kept_timed"), F.sum(mine).alias("kept_seconds"),
        F.max(mine).alias("kept_longest"))


def patient_summary(encounters_clean: DataFrame, patients_clean: DataFrame) -> DataFrame:
    """``patient_stays`` with the patient's demographics (inner join)."""
    p = patients_clean.select("patient_id", "gender", "marital_status", "age", C.care_age_group("age").alias("age_group"))
    s = patient_stays(encounters_clean)
    return s.join(p, s["patient_reference"] == p["patient_id"]).drop("patient_id")


def encounter_cube(encounters_clean: DataFrame, patients_clean: DataFrame) -> DataFrame:
    """One row per (gender, age group, marital status, class)."""
    add = [F.sum(c).alias(c) for c in ("stays", "timed", "seconds", "kept_stays", "kept_timed", "kept_seconds")]
    return patient_summary(encounters_clean, patients_clean).groupBy(*GROUPS).agg(
        *add, F.max("longest").alias("longest"), F.max("kept_longest").alias("kept_longest"))


def overlap_count(cube: DataFrame) -> DataFrame:
    """Rows of encounters joined to patients."""
    return cube.agg(F.coalesce(F.sum("stays"), F.lit(0)).alias("overlap_count"))


def count_by(cube: DataFrame, *keys: str) -> DataFrame:
    return cube.groupBy(*keys).agg(F.sum("stays").alias("count"))


def _minutes(prefix: str, where: Column | None = None) -> Column:
    part = (lambda c: F.sum(c)) if where is None else (lambda c: F.sum(F.when(where, F.col(c))))
    return ratio(part(f"{prefix}seconds"), part(f"{prefix}timed")) / F.lit(60.0)


def duration_by(cube: DataFrame, keys: Sequence[str], kept: bool = True, with_max: bool = False,
                order: bool = False) -> DataFrame:
    """Mean (and longest) duration in minutes by ``keys``. Groups without a kept stay have no row when ``kept``."""
    prefix = "kept_" if kept else ""
    aggs = {"avg_duration": _minutes(prefix)}
    if with_max:
        aggs["max_duration"] = F.max(f"{prefix}longest") / F.lit(60.0)
    rows = cube.filter("kept_stays > 0") if kept else cube
    return grouping.stats_by(rows, keys, aggs, order=order)


def pivot_counts(cube: DataFrame, rows: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    cells = [F.coalesce(F.sum(F.when(F.col(column) == F.lit(v), F.col("stays"))), F.lit(0)).alias(v) for v in values]
    return cube.groupBy(*rows).agg(*cells)


def pivot_duration(cube: DataFrame, rows: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """Mean kept duration, ``rows`` x ``values`` of ``column``; empty cells 0."""
    cells = [F.coalesce(_minutes("kept_", F.col(column) == F.lit(v)), F.lit(0.0)).alias(v) for v in values]
    return cube.filter("kept_stays > 0").groupBy(*rows).agg(*cells)


def pivot_duration_all(cube: DataFrame, rows: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """As ``pivot_duration``, plus one column for all other values and one for NULL."""
    return grouping.pivot_all(cube.filter("kept_stays > 0"), rows, column,
                              lambda where: F.coalesce(_minutes("kept_", where), F.lit(0.0)), values)


def kept_weights(encounters_clean: DataFrame, patients_clean: DataFrame) -> DataFrame:
    """Kept stays per patient and demographic group (``_w``): what the benefit means weight a patient by."""
    return patient_summary(encounters_clean, patients_clean).filter("kept_stays > 0") \
        .groupBy("patient_reference", "gender", "age", "marital_status", "age_group").agg(F.sum("kept_stays").alias("_w"))
