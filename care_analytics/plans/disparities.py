"""Demographics, encounter durations and benefit amounts by demographic group.

Inputs are warehouse tables (``patient``, ``encounter``,
``explanation_of_benefit``) or frames of the same shape. Everything is lazy.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.aggregates import mean_integral, mean_money, money, stddev_rounded, sum_double
from ..operators import cleaning, fanout, grouping
from ..operators.blocks import block_join, copies, key_counts, repeated

DEMOGRAPHIC_COLUMNS = ("patient_reference", "gender", "age", "marital_status", "age_group")


# -- patients -----------------------------------------------------------------

def age_statistics(patients_clean: DataFrame) -> DataFrame:
    return patients_clean.agg(mean_integral("age").alias("average_age"),
                              stddev_rounded("age").alias("stddev_age"))


def age_by(patients_clean: DataFrame, *keys: str) -> DataFrame:
    return patients_clean.groupBy(*keys).agg(
        mean_integral("age").alias("average_age"),
        stddev_rounded("age").alias("stddev_age"),
        F.count(F.lit(1)).alias("count"))


# -- encounters ----------------------------------------------------------------

def encounter_patients(encounters_clean: DataFrame, patients_clean: DataFrame) -> DataFrame:
    """Encounters with their patient's demographics (inner join), age group added.

    Join strategy is left to the planner: a patient table under the
    broadcast threshold is broadcast after its size is measured, larger
    ones get a sort-merge join whose skewed partitions AQE splits.
    """
    e, p = encounters_clean, patients_clean
    return (e.join(p, e["patient_reference"] == p["patient_id"], "inner")
             .drop(*cleaning.ENCOUNTER_HELPER_COLUMNS)
             .withColumn("age_group", C.care_age_group("age")))


def duration_by(df: DataFrame, keys: Sequence[str], with_max: bool = False,
                order: bool = False) -> DataFrame:
    """Mean (and max) encounter duration in minutes by ``keys``."""
    aggs = {"avg_duration": mean_integral("encounter_seconds", 60.0)}
    if with_max:
        aggs["max_duration"] = F.max("encounter_seconds") / F.lit(60.0)
    return grouping.stats_by(df, keys, aggs, order=order)


def longest(df: DataFrame, k: int = 10) -> DataFrame:
    return grouping.top_k(df, k, [F.col("encounter_duration").desc_nulls_last(),
                                  F.col("encounter_id").asc_nulls_first()])


def longest_encounters(encounters_clean: DataFrame, patients_clean: DataFrame, k: int = 10) -> DataFrame:
    """``longest(encounter_patients(...))`` by rank join: no join of all encounters."""
    def meet(best: DataFrame) -> DataFrame:
        ids = F.broadcast(best.select(F.col("patient_reference").alias("__of")).distinct())     # as many as candidates at most
        return encounter_patients(best, patients_clean.join(ids, F.col("patient_id") == F.col("__of"), "left_semi"))
    return grouping.top_k_joined(encounters_clean, meet, lambda rows: longest(rows, k), k,
                                 [F.col("encounter_duration").desc_nulls_last(), F.col("encounter_id").asc_nulls_first()])


# -- benefits ------------------------------------------------------------------

def benefit_totals(eob: DataFrame) -> DataFrame:
    return eob.agg(mean_money("total_amount").alias("avg_total_amount"),
                   mean_money("payment_amount").alias("avg_payment_amount"),
                   sum_double("total_amount").alias("total_claimed"),
                   sum_double("payment_amount").alias("total_paid"))


def adjudication_lines(eob: DataFrame) -> DataFrame:
    """One row per adjudication: amount, currency, first category coding."""
    a = eob.select("eob_id", "patient_reference", F.explode("adjudication").alias("a"))
    coding = C.first(F.col("a.category.coding"))
    return a.select("eob_id", "patient_reference",
                    F.col("a.amount.value").alias("value"),
                    F.col("a.amount.currency").alias("currency"),
                    coding.getField("code").alias("category_code"),
                    coding.getField("display").alias("category_display"))


def benefit_lines(eob: DataFrame, mapping=C.BENEFIT_CATEGORY_LABELS,
                  default=C.BENEFIT_CATEGORY_DEFAULT,
                  excluded=C.BENEFIT_CATEGORY_EXCLUDED) -> DataFrame:
    """Adjudication lines, patient id stripped, category labelled and filtered."""
    lines = adjudication_lines(eob)
    return (lines.withColumn("patient_reference", C.reference_id("patient_reference"))
                 .withColumn("category_display",
                             C.map_codes("category_display", mapping, default, normalise=True))
                 .filter(~F.col("category_display").isin(*excluded)))


def demographics(encounter_patients_kept: DataFrame) -> DataFrame:
    """One row per kept encounter with its patient's demographic columns (counts of them, ``cube.kept_weights``,
    stay as they are)."""
    if "_w" in encounter_patients_kept.columns:
        return encounter_patients_kept
    return encounter_patients_kept.select(*DEMOGRAPHIC_COLUMNS)


def benefit_by(eob: DataFrame, encounter_patients_kept: DataFrame, keys: Sequence[str],
               method: str = "weighted") -> DataFrame:
    """Mean benefit value by category and demographic ``keys``."""
    if method == "join":
        return fanout.weighted_benefit_mean(benefit_lines(eob), eob.select("eob_id"),
                                            demographics(encounter_patients_kept), keys,
                                            method="join")
    per_patient = fanout.benefit_line_sums(
        eob, label=lambda c: C.map_codes(c, C.BENEFIT_CATEGORY_LABELS, C.BENEFIT_CATEGORY_DEFAULT,
                                         normalise=True),
        excluded=C.BENEFIT_CATEGORY_EXCLUDED, strip=C.reference_id)
    return fanout.weighted_group_mean(per_patient, demographics(encounter_patients_kept), keys)


BENEFIT_KEYS = ("category_display", "gender", "age_group", "marital_status")


BENEFIT_SETS = (("category_display",), ("category_display", "gender"), ("category_display", "age_group"), BENEFIT_KEYS)


def benefit_cube(eob: DataFrame, encounter_patients_kept: DataFrame) -> DataFrame:
    """(category, gender, age group, marital status, _s, _n): exact sums and counts of benefit values, from one pass over the
    EOB table. Every benefit mean and the pivot are sums of its few rows."""
    per_patient = fanout.benefit_line_sums(
        eob, label=lambda c: C.map_codes(c, C.BENEFIT_CATEGORY_LABELS, C.BENEFIT_CATEGORY_DEFAULT, normalise=True),
        excluded=C.BENEFIT_CATEGORY_EXCLUDED, strip=C.reference_id)
    return fanout.weighted_group_sums(per_patient, demographics(encounter_patients_kept), BENEFIT_KEYS)


def benefit_sets(cube: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """The means of all ``sets`` of keys by GROUPING SETS: the key columns, ``avg_value`` and ``grouping``, whose bits are the keys that
    a row sums over (the first key the highest bit)."""
    keys = [F.col(k) for k in BENEFIT_KEYS]
    return cube.groupingSets([[F.col(k) for k in s] for s in sets], *keys) \
        .agg(fanout.weighted_mean().alias("avg_value"), F.grouping_id(*BENEFIT_KEYS).alias("grouping"))


def benefit_of_set(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``benefit_sets`` for one set of keys."""
    code = sum(1 << i for i, k in enumerate(reversed(BENEFIT_KEYS)) if k not in keys)
    return sets.filter(F.col("grouping") == code).select(*keys, "avg_value")


def adjudication_rows(eob: DataFrame) -> DataFrame:
    """Every adjudication line with every row of its EOB. The rows grow with the square of an EOB's
    rows: for given EOBs, not for reports."""
    return block_join(adjudication_lines(eob), eob.select("eob_id", "insurance_coverage_display", "billable_period_start"), "eob_id", "inner")


def benefit_rows(eob: DataFrame, encounter_patients_kept: DataFrame, exact: bool = False) -> DataFrame:
    """The joined benefit rows themselves (lines x EOB rows x encounters), labelled and filtered. For given
    patients, not for reports: ``benefit_by`` gives the same means without the product.

    Equal EOB rows and equal encounter rows meet the lines as one row with their number; the rows of the product are made
    after the joins, in the tasks that read them. ``exact`` gives the value as DECIMAL (``money``), cast once for each line and not
    once for each row of the product."""
    amount = F.size("adjudication")
    per_patient = key_counts(eob.select(C.reference_id("patient_reference").alias("p"), amount.alias("n")).filter("n > 0"), "p", "n")
    periods = copies(eob.select("eob_id", "billable_period_start"), "__rows")
    stays = copies(demographics(encounter_patients_kept), "__stays")
    lines = benefit_lines(eob).drop("category_code")
    lines = block_join(lines.withColumn("value", money("value")) if exact else lines, periods, "eob_id", "inner")
    rows = block_join(lines, stays, "patient_reference", "inner", counts=(per_patient, key_counts(stays, "patient_reference", "__stays")))
    return repeated(rows, "__rows", "__stays")


__all__ = [
    "age_statistics", "age_by", "encounter_patients", "duration_by",
    "longest", "benefit_totals", "adjudication_lines",
    "benefit_lines", "demographics", "benefit_by", "benefit_rows", "adjudication_rows",
]
