"""DataFrame -> DataFrame cleaning steps (lazy; usable with ``df.transform``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

# Fixed values.
PATIENT_VIEW_COLUMNS = (
    "patient_id", "gender", "birth_date", "state", "postal_code", "marital_status",
    "disability_adjusted_life_years", "quality_adjusted_life_years",
)

# Fixed values.
ENCOUNTER_HELPER_COLUMNS = (
    "service_provider_id", "service_provider_display",
    "participant_individual_display", "participant_individual_reference",
    "participant_period_start", "participant_period_end",
    "participant_type_code", "participant_type_display",
)


def project(df: DataFrame, columns: Sequence[str], strict: bool = False) -> DataFrame:
    """Keep ``columns`` (those present unless ``strict``), in that order."""
    present = [c for c in columns if strict or c in df.columns]
    return df.select(*present)


def clean_patients(patients: DataFrame, as_of=None,
                   columns: Sequence[str] = PATIENT_VIEW_COLUMNS) -> DataFrame:
    """Patient view: subset of columns, calendar age, marital status labels."""
    return (project(patients, columns)
            .withColumn("age", C.age_calendar("birth_date", as_of))
            .withColumn("marital_status",
                        C.map_codes("marital_status", C.MARITAL_STATUS_LABELS,
                                    C.MARITAL_STATUS_DEFAULT, normalise=True)))


PARTICIPANT_COLUMNS = tuple(c for c in ENCOUNTER_HELPER_COLUMNS if c.startswith("participant_"))


def clean_encounters(encounters: DataFrame, strip_reference: bool = True,
                     grain: str = "row") -> DataFrame:
    """Drop incomplete encounters, parse times, add durations, map labels.

    ``encounter_seconds`` (whole seconds) is kept next to
    ``encounter_duration`` (minutes) so that means can be taken exactly.
    ``grain="row"`` keeps the table's rows: the flattened encounter table has
    one per participant, and statistics count them as the original does.
    ``grain="encounter"`` drops the participant columns and keeps one row per
    encounter id (one shuffle on the id).
    """
    if grain == "encounter":
        encounters = (encounters.drop(*[c for c in PARTICIPANT_COLUMNS if c in encounters.columns])
                      .dropDuplicates(["encounter_id"]))
    elif grain != "row":
        raise ValueError(f"unknown grain {grain!r}")
    schema = {f.name: f.dataType for f in encounters.schema.fields}
    df = encounters.dropna(subset=["encounter_id", "patient_reference", "start_time"])
    df = (df.withColumn("start_time", C.to_timestamp_safe("start_time", schema["start_time"]))
            .withColumn("end_time", C.to_timestamp_safe("end_time", schema["end_time"])))
    ntz = C.is_ntz(df.schema["start_time"].dataType) and C.is_ntz(df.schema["end_time"].dataType)
    df = (df.withColumn("encounter_seconds", C.duration_seconds("start_time", "end_time", ntz))
            .withColumn("encounter_duration", F.col("encounter_seconds") / F.lit(60.0))
            .withColumn("status", C.map_codes("status", C.ENCOUNTER_STATUS_LABELS,
                                              C.ENCOUNTER_STATUS_DEFAULT))
            .withColumn("class_code", C.map_codes("class_code", C.CLASS_CODE_LABELS,
                                                  C.CLASS_CODE_DEFAULT)))
    if strip_reference:
        df = df.withColumn("patient_reference", C.reference_id("patient_reference"))
    return df


def null_count(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: number of NULLs in each column (``null_<col>``)."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns])


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def count_distinct(df: DataFrame, column: str, alias: str | None = None) -> DataFrame:
    return df.agg(F.count_distinct(column).alias(alias or f"num_{column}"))


def keep_short_stays(df: DataFrame, limit: float = C.OUTLIER_STAY_MINUTES,
                     class_label: str = C.INPATIENT_LABEL) -> DataFrame:
    """Keep stays within ``limit`` minutes, or not of ``class_label``.

    SQL three-valued logic as in the original: a NULL duration survives only
    outside the given class.
    """
    return df.filter((F.col("encounter_duration") <= limit) | (F.col("class_code") != class_label))


def outlier_stays(df: DataFrame, limit: float = C.OUTLIER_STAY_MINUTES) -> DataFrame:
    return df.filter(F.col("encounter_duration") > limit)


def long_stays(df: DataFrame, minutes: float = C.LONG_STAY_MINUTES,
               class_label: str = C.INPATIENT_LABEL) -> DataFrame:
    return df.filter((F.col("class_code") == class_label) & (F.col("encounter_duration") > minutes))
