"""Per-patient feature table for the risk and readmission models.

The original builds six per-patient aggregates and joins them one by one
(six shuffles of the patient key). Here every source contributes rows of one
narrow union, and a single ``groupBy(patient)`` computes all features at
once: one shuffle, with partial aggregation before it, so a patient holding
a large share of all rows leaves each map task as one row. The result is
then left-joined to the patient table once.

References are stripped of their ``urn:uuid:`` prefix before they meet the
bare patient id (the original compared the raw forms, which never match).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.aggregates import exact_sum, to_double

KEY = "patient_id"

# The columns of the feature tables and which of them the models read.
RISK_COLUMNS = (
    "state", "has_chronic_conditions", "total_healthcare_cost", "age", "is_senior",
    "region_risk", "label", "num_encounters", "completed_encounters", "num_claims",
    "total_claim_amount", "num_conditions", "num_procedures", "num_immunizations",
    "num_diagnostic_reports",
)
READMISSION_COLUMNS = RISK_COLUMNS + ("first_encounter", "last_encounter")

NUMERIC_FEATURES = (
    "total_healthcare_cost", "age", "region_risk", "num_encounters", "completed_encounters",
    "num_claims", "total_claim_amount", "num_conditions", "num_procedures", "num_immunizations",
    "num_diagnostic_reports",
)
CATEGORICAL_FEATURES = ("state", "has_chronic_conditions", "is_senior")


def _key(ref: str) -> Column:
    return C.reference_id(ref).alias(KEY)


def chronic_flag(conditions: DataFrame, pattern: str = C.CHRONIC_PATTERN,
                 ref: str = "patient_reference") -> DataFrame:
    """Patients with a condition matching ``pattern``: (patient_id, 1)."""
    return (conditions.filter(F.col("condition_code_display").rlike(pattern))
            .groupBy(_key(ref)).agg(F.lit(1).alias("has_chronic_conditions")))


def total_cost(claims: DataFrame, ref: str = "patient_reference") -> DataFrame:
    return claims.groupBy(_key(ref)).agg(
        to_double(exact_sum("total_amount")).alias("total_healthcare_cost"))


def encounter_features(encounters: DataFrame, completed: str = "finished",
                       ref: str = "patient_reference") -> DataFrame:
    return encounters.groupBy(_key(ref)).agg(
        F.count("encounter_id").alias("num_encounters"),
        F.sum(F.when(F.col("status") == completed, 1).otherwise(0)).cast("bigint")
         .alias("completed_encounters"),
        F.min("start_time").alias("first_encounter"),
        F.max("end_time").alias("last_encounter"))


def claim_features(claims: DataFrame, ref: str = "patient_reference") -> DataFrame:
    return claims.groupBy(_key(ref)).agg(
        F.count("claim_id").alias("num_claims"),
        to_double(exact_sum("total_amount")).alias("total_claim_amount"))


def activity_counts(conditions: DataFrame, procedures: DataFrame, immunizations: DataFrame,
                    diagnostic_reports: DataFrame) -> DataFrame:
    """Conditions, procedures, immunizations, reports per patient: one shuffle."""
    parts = [
        conditions.select(_key("patient_reference"), F.col("condition_id")),
        procedures.select(_key("subject_reference"), F.col("procedure_id")),
        immunizations.select(_key("patient_reference"), F.col("immunization_id")),
        diagnostic_reports.select(_key("subject_reference"), F.col("diagnostic_report_id")),
    ]
    u = _union(parts)
    return u.groupBy(KEY).agg(
        F.count("condition_id").alias("num_conditions"),
        F.count("procedure_id").alias("num_procedures"),
        F.count("immunization_id").alias("num_immunizations"),
        F.count("diagnostic_report_id").alias("num_diagnostic_reports"))


def patient_base(patients: DataFrame, as_of=None, **flag_args) -> DataFrame:
    """Patient id, state and the derived columns age, is_senior, region_risk, label."""
    p = patients.select(KEY, "state", C.age_elapsed("birth_date", as_of).alias("age"))
    flags = C.patient_flags("age", "state", **flag_args)
    return p.select(KEY, "state", "age", *[c.alias(n) for n, c in flags.items()])


def patient_features(patients: DataFrame, claims: DataFrame, encounters: DataFrame,
                     conditions: DataFrame, procedures: DataFrame, immunizations: DataFrame,
                     diagnostic_reports: DataFrame, as_of=None, completed: str = "finished",
                     chronic_pattern: str = C.CHRONIC_PATTERN,
                     columns: Sequence[str] = READMISSION_COLUMNS, fill=0,
                     **flag_args) -> DataFrame:
    """One row per patient: ``patient_id`` then ``columns``; NULL counts filled."""
    parts = [
        encounters.select(_key("patient_reference"), "encounter_id",
                          F.col("status").alias("_status"),
                          F.col("start_time").alias("_start"), F.col("end_time").alias("_end")),
        claims.select(_key("patient_reference"), "claim_id", F.col("total_amount").alias("_amount")),
        conditions.select(_key("patient_reference"), "condition_id",
                          F.when(F.col("condition_code_display").rlike(chronic_pattern), 1)
                           .alias("_chronic")),
        procedures.select(_key("subject_reference"), "procedure_id"),
        immunizations.select(_key("patient_reference"), "immunization_id"),
        diagnostic_reports.select(_key("subject_reference"), "diagnostic_report_id"),
    ]
    amount = to_double(exact_sum("_amount"))
    per_patient = _union(parts).groupBy(KEY).agg(
        F.max("_chronic").alias("has_chronic_conditions"),
        amount.alias("total_healthcare_cost"),
        F.count("encounter_id").alias("num_encounters"),
        F.count_if(F.col("_status") == completed).alias("completed_encounters"),
        F.count("claim_id").alias("num_claims"),
        amount.alias("total_claim_amount"),
        F.count("condition_id").alias("num_conditions"),
        F.count("procedure_id").alias("num_procedures"),
        F.count("immunization_id").alias("num_immunizations"),
        F.count("diagnostic_report_id").alias("num_diagnostic_reports"),
        F.min("_start").alias("first_encounter"),
        F.max("_end").alias("last_encounter"))
    base = patient_base(patients, as_of, **flag_args)
    out = base.join(per_patient, KEY, "left").select(KEY, *columns)
    return out.fillna(fill) if fill is not None else out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
