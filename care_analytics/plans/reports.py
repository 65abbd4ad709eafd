"""All analysis reports from warehouse tables, as result tables.

``reports(warehouse)`` returns every report of the cost, disparities and
feature analyses as lazy DataFrames keyed by name (the input tables of the
original's charts); ``publish`` writes them as Parquet, one folder each.

    python -m care_analytics.plans.reports <warehouse_root> <results_root> [as_of]
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.aggregates import audit_amounts
from ..operators import cleaning, grouping
from ..session import configure
from ..sources.warehouse import Warehouse, write_result
from . import cost, cube, disparities, features

CLASS_LABELS = ("Ambulatory", "Emergency", "Inpatient", "Unknown")
# The administrative genders of the record format; any other value has a column of its own.
GENDERS = ("female", "male", "other", "unknown")


def reports(wh: Warehouse, as_of=None, genders=GENDERS, scratch: str | None = None) -> dict[str, DataFrame]:
    """With ``scratch`` (a folder all executors share), the encounter cube, the patient weights and the benefit cube are
    written there first (three jobs), and the duration, count and benefit reports read them. The longest encounters are
    found by rank join, an action."""
    spark = wh.spark
    patient, encounter = wh.table("patient"), wh.table("encounter")
    claim, eob = wh.table("claim"), wh.table("explanation_of_benefit")

    # disparities: patients, encounters, benefits
    p = cleaning.clean_patients(patient, as_of)
    e = cleaning.clean_encounters(encounter)
    c = cube.encounter_cube(e, p)
    weights = cube.kept_weights(e, p)
    if scratch:                                # each is read by many reports: written once
        c = spark.read.parquet(write_result(c, scratch, "encounter_cube"))
        weights = spark.read.parquet(write_result(weights, scratch, "patient_weights"))
    out: dict[str, DataFrame] = {
        "count_by_gender": grouping.count_by(p, "gender"),
        "age_statistics": disparities.age_statistics(p),
        "count_by_marital_status": grouping.count_by(p, "marital_status"),
        "count_by_age": grouping.count_by(p, "age"),
        "age_by_gender_marital": disparities.age_by(p, "gender", "marital_status"),
        "age_box_statistics": grouping.box_statistics(p, "age"),
        "encounters_by_gender_class": cube.count_by(c, "gender", "class_code"),
        "pivot_gender_class": cube.pivot_counts(c, ["gender"], "class_code", CLASS_LABELS),
        "duration_by_gender": cube.duration_by(c, ["gender"], kept=False),
        "duration_by_age_group": cube.duration_by(c, ["age_group"], kept=False),
        "longest_encounters": disparities.longest_encounters(e, p),
        "long_inpatient_stays": disparities.longest_encounters(cleaning.long_stays(e), p),
        "duration_by_class": cube.duration_by(c, ["class_code"], kept=False, with_max=True),
        "duration_by_class_filtered": cube.duration_by(c, ["class_code"], with_max=True),
        "duration_by_class_age": cube.duration_by(c, ["class_code", "age_group"], order=True),
        "pivot_class_age_duration": cube.pivot_duration(c, ["class_code"], "age_group", C.CARE_AGE_LABELS),
        "duration_by_class_age_gender": cube.duration_by(c, ["class_code", "age_group", "gender"], order=True),
        "pivot_class_age_gender_duration": cube.pivot_duration_all(c, ["class_code", "age_group"], "gender", genders),
        "duration_by_marital": cube.duration_by(c, ["marital_status"]),
        "duration_by_marital_gender": cube.duration_by(c, ["marital_status", "gender"], order=True),
        "duration_by_marital_gender_age": cube.duration_by(c, ["marital_status", "gender", "age_group"], order=True),
        "benefit_totals": disparities.benefit_totals(eob),
        "benefit_amount_audit": audit_amounts(eob, "total_amount", "payment_amount"),
    }
    benefits = disparities.benefit_cube(eob, weights)
    if scratch:
        benefits = spark.read.parquet(write_result(benefits, scratch, "benefit_cube"))
    sets = disparities.benefit_sets(benefits, disparities.BENEFIT_SETS)
    for keys in disparities.BENEFIT_SETS:
        out["benefit_by_" + "_".join(k.replace("_display", "") for k in keys)] = disparities.benefit_of_set(sets, keys)
    labels = sorted(set(C.BENEFIT_CATEGORY_LABELS.values()) - set(C.BENEFIT_CATEGORY_EXCLUDED))
    out["pivot_benefit_groups"] = grouping.pivot_table(
        out["benefit_by_category_gender_age_group_marital_status"],
        ["gender", "age_group", "marital_status"], "category_display", F.first("avg_value"), labels)

    # cost
    claims, encounters = cost.select_claims(claim), cost.select_encounters(encounter)
    patients, procedures = cost.select_patients(patient), cost.select_procedures(wh.table("procedure"))
    top = cost.top_cost_encounters(claims, encounters)
    out.update({
        "top_cost_encounters": top,
        "mean_cost_of_top_by_type": cost.mean_by_type(top),
        "cost_by_encounter_type": cost.cost_by_encounter_type(claims, encounters),
        "cost_by_provider": cost.cost_by_provider(claims, encounters),
        "cost_by_gender": cost.cost_by_gender(claims, patients),
        "cost_share_by_gender": cost.cost_share_by_gender(claims, patients),
        "cost_by_age_range": cost.cost_by_age_range(claims, patients, as_of),
    })
    by_procedure = cost.cost_by_procedure(procedures, claims, encounters)
    out["cost_by_procedure"] = by_procedure
    out["top_procedures"] = cost.top_procedures(by_procedure)

    # features
    out["patient_features"] = features.patient_features(
        patient, claim, encounter, wh.table("condition"), wh.table("procedure"),
        wh.table("immunization"), wh.table("diagnostic_report"), as_of=as_of)
    return out


def publish(frames: dict[str, DataFrame], root: str) -> list[str]:
    """Write every report (one action each)."""
    return [write_result(df, root, name) for name, df in frames.items()]


def main(argv: list[str]) -> None:
    warehouse_root, results_root = argv[0], argv[1]
    as_of = argv[2] if len(argv) > 2 else None
    spark = SparkSession.builder.appName("care_analytics_reports").getOrCreate()
    configure(spark)
    publish(reports(Warehouse(spark, warehouse_root), as_of, scratch=f"{results_root}/_shared"), results_root)


if __name__ == "__main__":
    main(sys.argv[1:])
