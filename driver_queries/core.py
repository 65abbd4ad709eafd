"""Registered queries: one per operator of the inventory, over the driver tables.

Each entry is ``fn(spark, sf_dir) -> DataFrame`` plus, where the operator is
expressible in SQL, the DuckDB statement that must give the same rows
(``oracle.py``). Every query reads whole tables; ``limit`` appears only in
the top-k reports, where it is the feature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from care_analytics.functions import columns as C
from care_analytics.functions.aggregates import audit_amounts, sum_double, to_double
from care_analytics.operators import cleaning, grouping
from care_analytics.plans import cost, cube, disparities, features
from .roles import DriverTables

AS_OF = O.AS_OF
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CLASS_LABELS = ("Ambulatory", "Emergency", "Inpatient", "Unknown")
# The administrative genders of the record format; any other value has a column of its own.
GENDERS = ("female", "male", "other", "unknown")
BENEFIT_LABELS = tuple(sorted(set(C.BENEFIT_CATEGORY_LABELS.values()) - set(C.BENEFIT_CATEGORY_EXCLUDED)))


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = O.with_roles(sql)
        return fn
    return deco


# -- shared frames ---------------------------------------------------------------

def _t(spark, sf) -> DriverTables:
    return DriverTables(spark, sf)


def patients_clean(t: DriverTables) -> DataFrame:
    return cleaning.clean_patients(t.patient(), AS_OF)


def encounters_clean(t: DriverTables) -> DataFrame:
    return cleaning.clean_encounters(t.encounter())


def encounter_patients(t: DriverTables) -> DataFrame:
    return disparities.encounter_patients(encounters_clean(t), patients_clean(t))


def encounter_cube(t: DriverTables) -> DataFrame:
    return cube.encounter_cube(encounters_clean(t), patients_clean(t))


def kept_weights(t: DriverTables) -> DataFrame:
    return cube.kept_weights(encounters_clean(t), patients_clean(t))


def encounter_patients_kept(t: DriverTables) -> DataFrame:
    return cleaning.keep_short_stays(encounter_patients(t))


def cost_inputs(t: DriverTables):
    return (cost.select_claims(t.claim()), cost.select_encounters(t.encounter()),
            cost.select_patients(t.patient()), cost.select_procedures(t.procedure()))


def _avg(cond: str | None = None) -> str:
    return O.avg_minutes_sql(cond)


# -- 2.3 projections, filters, cleaning -------------------------------------------

@register("project_patient_view", """
SELECT patient_id, gender, birth_date, state, postal_code, marital_status,
       disability_adjusted_life_years, quality_adjusted_life_years FROM r_patient""")
def project_patient_view(spark, sf):
    return cleaning.project(_t(spark, sf).patient(), cleaning.PATIENT_VIEW_COLUMNS)


@register("age_calendar_years", "SELECT patient_id, age FROM p_clean")
def age_calendar_years(spark, sf):
    return _t(spark, sf).patient().select(
        "patient_id", C.age_calendar("birth_date", AS_OF).alias("age"))


@register("age_elapsed_years", "SELECT patient_id, age FROM features_base")
def age_elapsed_years(spark, sf):
    return _t(spark, sf).patient().select(
        "patient_id", C.age_elapsed("birth_date", AS_OF).alias("age"))


@register("map_marital_status", "SELECT patient_id, marital_status FROM p_clean")
def map_marital_status(spark, sf):
    return patients_clean(_t(spark, sf)).select("patient_id", "marital_status")


@register("map_encounter_status", """
SELECT encounter_id, CASE WHEN status = 'finished' THEN 'Completed' ELSE 'In-Progress' END AS status
FROM r_encounter""")
def map_encounter_status(spark, sf):
    return _t(spark, sf).encounter().select(
        "encounter_id", C.map_codes("status", C.ENCOUNTER_STATUS_LABELS,
                                    C.ENCOUNTER_STATUS_DEFAULT).alias("status"))


@register("map_class_code", """
SELECT encounter_id, CASE WHEN class_code = 'IMP' THEN 'Inpatient' WHEN class_code = 'AMB' THEN 'Ambulatory'
  WHEN class_code = 'EMER' THEN 'Emergency' ELSE 'Unknown' END AS class_code FROM r_encounter""")
def map_class_code(spark, sf):
    return _t(spark, sf).encounter().select(
        "encounter_id", C.map_codes("class_code", C.CLASS_CODE_LABELS,
                                    C.CLASS_CODE_DEFAULT).alias("class_code"))


@register("map_benefit_category", """
SELECT category_display, COUNT(*) AS num_lines FROM benefit_lines GROUP BY category_display""")
def map_benefit_category(spark, sf):
    lines = disparities.adjudication_lines(_t(spark, sf).eob())
    mapped = lines.select(C.map_codes("category_display", C.BENEFIT_CATEGORY_LABELS,
                                      C.BENEFIT_CATEGORY_DEFAULT, normalise=True)
                          .alias("category_display"))
    return grouping.count_by(mapped, "category_display", alias="num_lines")


@register("audit_null_keys", """
SELECT COUNT(*) FILTER (WHERE patient_id IS NULL) AS null_patient_id,
       COUNT(*) FILTER (WHERE birth_date IS NULL) AS null_birth_date,
       COUNT(*) FILTER (WHERE marital_status IS NULL) AS null_marital_status
FROM r_patient""")
def audit_null_keys(spark, sf):
    return cleaning.null_count(_t(spark, sf).patient(),
                               ["patient_id", "birth_date", "marital_status"])


@register("drop_incomplete_encounters", """
SELECT encounter_id, start_time FROM r_encounter
WHERE encounter_id IS NOT NULL AND patient_reference IS NOT NULL AND start_time IS NOT NULL""")
def drop_incomplete_encounters(spark, sf):
    return (_t(spark, sf).encounter()
            .dropna(subset=["encounter_id", "patient_reference", "start_time"])
            .select("encounter_id", "start_time"))


@register("encounter_duration_minutes", "SELECT encounter_id, encounter_duration FROM e_clean")
def encounter_duration_minutes(spark, sf):
    return encounters_clean(_t(spark, sf)).select("encounter_id", "encounter_duration")


@register("strip_reference_prefix", """
SELECT claim_id, replace(patient_reference, 'urn:uuid:', '') AS patient_id,
  CASE WHEN strpos(patient_reference, 'urn:uuid:') > 0
       THEN split_part(patient_reference, 'urn:uuid:', 2) END AS patient_id_strict
FROM r_claim""")
def strip_reference_prefix(spark, sf):
    return _t(spark, sf).claim().select(
        "claim_id", C.reference_id("patient_reference").alias("patient_id"),
        C.reference_id("patient_reference", strict=True).alias("patient_id_strict"))


@register("band_age_care", "SELECT patient_id, age, CASE WHEN age < 18 THEN 'Child' "
          "WHEN age < 40 THEN 'Young Adult' WHEN age < 65 THEN 'Middle Aged' ELSE 'Senior' END "
          "AS age_group FROM p_clean")
def band_age_care(spark, sf):
    return patients_clean(_t(spark, sf)).select(
        "patient_id", "age", C.care_age_group("age").alias("age_group"))


@register("band_age_cost", "SELECT patient_id, age, CASE WHEN age <= 18 THEN '0-18' "
          "WHEN age <= 35 THEN '19-35' WHEN age <= 50 THEN '36-50' WHEN age <= 65 THEN '51-65' "
          "ELSE '66+' END AS age_range FROM p_clean")
def band_age_cost(spark, sf):
    return patients_clean(_t(spark, sf)).select(
        "patient_id", "age", C.cost_age_range("age").alias("age_range"))


@register("default_blank_provider", """
SELECT encounter_id, CASE WHEN service_provider_display IS NULL OR service_provider_display = ''
  THEN 'Others' ELSE service_provider_display END AS service_provider_display FROM r_encounter""")
def default_blank_provider(spark, sf):
    return _t(spark, sf).encounter().select(
        "encounter_id", C.blank_to("service_provider_display").alias("service_provider_display"))


@register("filter_outlier_stays",
          "SELECT encounter_id, class_code, encounter_duration FROM ep_kept")
def filter_outlier_stays(spark, sf):
    return encounter_patients_kept(_t(spark, sf)).select(
        "encounter_id", "class_code", "encounter_duration")


@register("outlier_stays", """
SELECT encounter_id, class_code, encounter_duration FROM ep WHERE encounter_duration > 86400""")
def outlier_stays(spark, sf):
    return cleaning.outlier_stays(encounter_patients(_t(spark, sf))).select(
        "encounter_id", "class_code", "encounter_duration")


@register("long_inpatient_stays", """
SELECT encounter_id, patient_id, class_code, encounter_duration FROM ep
WHERE class_code = 'Inpatient' AND encounter_duration > 1440
ORDER BY encounter_duration DESC NULLS LAST, encounter_id ASC NULLS FIRST LIMIT 10""")
def long_inpatient_stays(spark, sf):
    t = _t(spark, sf)
    return disparities.longest_encounters(cleaning.long_stays(encounters_clean(t)), patients_clean(t)).select(
        "encounter_id", "patient_id", "class_code", "encounter_duration")


@register("fill_missing_features", """
SELECT patient_id, state, has_chronic_conditions, total_healthcare_cost, age, is_senior, region_risk,
  label, num_encounters, completed_encounters, num_claims, total_claim_amount, num_conditions,
  num_procedures, num_immunizations, num_diagnostic_reports FROM features""")
def fill_missing_features(spark, sf):
    return _features(spark, sf, features.RISK_COLUMNS)


@register("derive_patient_flags", """
SELECT patient_id, state, age, CASE WHEN age >= 65 THEN 1 ELSE 0 END AS is_senior,
  CASE WHEN state IN ('CA', 'NY') THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END AS region_risk,
  CASE WHEN age > 50 THEN 1 ELSE 0 END AS label FROM features_base""")
def derive_patient_flags(spark, sf):
    return features.patient_base(_t(spark, sf).patient(), AS_OF)


@register("match_chronic_conditions", """
SELECT condition_id, patient_reference, condition_code_display FROM r_condition
WHERE regexp_matches(condition_code_display, 'chronic', 'i')""")
def match_chronic_conditions(spark, sf):
    return (_t(spark, sf).condition()
            .filter(F.col("condition_code_display").rlike(C.CHRONIC_PATTERN))
            .select("condition_id", "patient_reference", "condition_code_display"))


# -- 2.4 joins -------------------------------------------------------------------------

@register("join_encounter_patient", """
SELECT encounter_id, patient_id, gender, age, marital_status, class_code, status,
  encounter_duration, age_group FROM ep""")
def join_encounter_patient(spark, sf):
    return encounter_patients(_t(spark, sf)).select(
        "encounter_id", "patient_id", "gender", "age", "marital_status", "class_code", "status",
        "encounter_duration", "age_group")


@register("count_encounter_patient_overlap", "SELECT COUNT(*) AS overlap_count FROM ep")
def count_encounter_patient_overlap(spark, sf):
    return cube.overlap_count(encounter_cube(_t(spark, sf)))


@register("join_claim_encounter", """
SELECT claim_id, patient_id, total_amount, encounter_id, type_text, service_provider_display
FROM claims_encounters""")
def join_claim_encounter(spark, sf):
    claims, encounters, _, _ = cost_inputs(_t(spark, sf))
    return cost.claim_encounters(claims, encounters).select(
        "claim_id", "patient_id", "total_amount", "encounter_id", "type_text",
        "service_provider_display")


@register("join_procedure_claim", """
SELECT p.procedure_id, p.encounter_id, p.procedure_code_display, ce.claim_id, ce.total_amount
FROM cost_procedures p LEFT JOIN claims_encounters ce ON p.encounter_id = ce.encounter_id""")
def join_procedure_claim(spark, sf):
    claims, encounters, _, procedures = cost_inputs(_t(spark, sf))
    return cost.procedure_claims(procedures, claims, encounters).select(
        "procedure_id", "encounter_id", "procedure_code_display", "claim_id", "total_amount")


@register("join_claim_patient", """
SELECT claim_id, patient_id_clean, gender, birth_date, total_amount FROM claim_patient""")
def join_claim_patient(spark, sf):
    claims, _, patients, _ = cost_inputs(_t(spark, sf))
    return cost.claim_patients(claims, patients).select(
        "claim_id", "patient_id_clean", "gender", "birth_date", "total_amount")


@register("join_adjudication_eob", """
SELECT l.eob_id, l.category_display, l.value, h.billable_period_start
FROM r_benefit l JOIN (SELECT eob_id, billable_period_start FROM r_eob) h ON l.eob_id = h.eob_id""")
def join_adjudication_eob(spark, sf):
    """The joined rows: every adjudication line with every row of its EOB."""
    return disparities.adjudication_rows(_t(spark, sf).eob()).select(
        "eob_id", "category_display", "value", "billable_period_start")


@register("join_benefit_demographics", """
SELECT category_display, gender, age_group, COUNT(*) AS num_rows, {s} AS total_value,
  COUNT(billable_period_start) AS num_periods, MIN(billable_period_start) AS first_period, MAX(billable_period_start) AS last_period
FROM benefit_joined GROUP BY category_display, gender, age_group""".format(s=O.sum_sql("value")))
def join_benefit_demographics(spark, sf):
    """The joined rows (lines x EOB rows x kept encounters), counted and summed by group only to be compared."""
    t = _t(spark, sf)
    rows = disparities.benefit_rows(t.eob(), encounter_patients_kept(t), exact=True)
    return rows.groupBy("category_display", "gender", "age_group").agg(
        F.count(F.lit(1)).alias("num_rows"), to_double(F.sum("value")).alias("total_value"), F.count("billable_period_start").alias("num_periods"),
        F.min("billable_period_start").alias("first_period"), F.max("billable_period_start").alias("last_period"))


@register("join_patient_chronic_flag", """
SELECT patient_id, has_chronic_conditions FROM features""")
def join_patient_chronic_flag(spark, sf):
    t = _t(spark, sf)
    p = t.patient().select("patient_id")
    return (p.join(features.chronic_flag(t.condition()), "patient_id", "left")
             .fillna({"has_chronic_conditions": 0}))


@register("join_patient_total_cost", "SELECT patient_id, total_healthcare_cost FROM features")
def join_patient_total_cost(spark, sf):
    t = _t(spark, sf)
    p = t.patient().select("patient_id")
    return (p.join(features.total_cost(t.claim()), "patient_id", "left")
             .fillna({"total_healthcare_cost": 0.0}))


def _features(spark, sf, columns=features.READMISSION_COLUMNS) -> DataFrame:
    t = _t(spark, sf)
    return features.patient_features(t.patient(), t.claim(), t.encounter(), t.condition(),
                                     t.procedure(), t.immunization(), t.diagnostic_report(),
                                     as_of=AS_OF, columns=columns)


@register("build_patient_features", "SELECT * FROM features")
def build_patient_features(spark, sf):
    return _features(spark, sf)


# -- 2.5 aggregations ----------------------------------------------------------------

@register("count_by_gender", "SELECT gender, COUNT(*) AS count FROM p_clean GROUP BY gender")
def count_by_gender(spark, sf):
    return grouping.count_by(patients_clean(_t(spark, sf)), "gender")


@register("age_statistics", f"""
SELECT {O.mean_int_sql('age')} AS average_age, ROUND(STDDEV_SAMP(CAST(age AS DOUBLE)), 6) AS stddev_age
FROM p_clean""")
def age_statistics(spark, sf):
    return disparities.age_statistics(patients_clean(_t(spark, sf)))


@register("count_by_marital_status",
          "SELECT marital_status, COUNT(*) AS count FROM p_clean GROUP BY marital_status")
def count_by_marital_status(spark, sf):
    return grouping.count_by(patients_clean(_t(spark, sf)), "marital_status")


@register("count_by_age", "SELECT age, COUNT(*) AS count FROM p_clean GROUP BY age")
def count_by_age(spark, sf):
    return grouping.count_by(patients_clean(_t(spark, sf)), "age")


@register("age_by_gender_marital", f"""
SELECT gender, marital_status, {O.mean_int_sql('age')} AS average_age,
  ROUND(STDDEV_SAMP(CAST(age AS DOUBLE)), 6) AS stddev_age, COUNT(*) AS count
FROM p_clean GROUP BY gender, marital_status""")
def age_by_gender_marital(spark, sf):
    return disparities.age_by(patients_clean(_t(spark, sf)), "gender", "marital_status")


@register("distinct_values", "SELECT DISTINCT state FROM r_patient")
def distinct_values(spark, sf):
    return cleaning.distinct_values(_t(spark, sf).patient(), "state")


@register("count_distinct_city", "SELECT COUNT(DISTINCT city) AS num_cities FROM r_patient")
def count_distinct_city(spark, sf):
    return cleaning.count_distinct(_t(spark, sf).patient(), "city", "num_cities")


@register("encounters_by_gender_class",
          "SELECT gender, class_code, COUNT(*) AS count FROM ep GROUP BY gender, class_code")
def encounters_by_gender_class(spark, sf):
    return cube.count_by(encounter_cube(_t(spark, sf)), "gender", "class_code")


def _duration_sql(keys: str, source: str = "ep_kept", with_max: bool = False) -> str:
    mx = ", MAX(encounter_seconds) / CAST(60 AS DOUBLE) AS max_duration" if with_max else ""
    return f"SELECT {keys}, {_avg()} AS avg_duration{mx} FROM {source} GROUP BY {keys}"


def _duration_query(name: str, keys: tuple[str, ...], kept: bool = True, with_max: bool = False):
    @register(name, _duration_sql(", ".join(keys), "ep_kept" if kept else "ep", with_max))
    def q(spark, sf):
        return cube.duration_by(encounter_cube(_t(spark, sf)), keys, kept=kept, with_max=with_max, order=True)
    q.__name__ = name
    return q


_duration_query("duration_by_gender", ("gender",), kept=False)
_duration_query("duration_by_age_group", ("age_group",), kept=False)
_duration_query("duration_by_class", ("class_code",), kept=False, with_max=True)
_duration_query("duration_by_class_filtered", ("class_code",), kept=True, with_max=True)
_duration_query("duration_by_class_age", ("class_code", "age_group"))
_duration_query("duration_by_class_age_gender", ("class_code", "age_group", "gender"))
_duration_query("duration_by_marital", ("marital_status",))
_duration_query("duration_by_marital_gender", ("marital_status", "gender"))
_duration_query("duration_by_marital_gender_age", ("marital_status", "gender", "age_group"))


@register("benefit_totals", f"""
SELECT {O.mean_sql('total_amount')} AS avg_total_amount, {O.mean_sql('payment_amount')} AS avg_payment_amount,
  {O.sum_sql('total_amount')} AS total_claimed, {O.sum_sql('payment_amount')} AS total_paid FROM r_eob""")
def benefit_totals(spark, sf):
    return disparities.benefit_totals(_t(spark, sf).eob())


def _benefit_query(name: str, keys: tuple[str, ...]):
    k = ", ".join(keys)

    @register(name, f"SELECT {k}, {O.mean_sql('value')} AS avg_value FROM benefit_joined GROUP BY {k}")
    def q(spark, sf):
        t = _t(spark, sf)
        return disparities.benefit_by(t.eob(), kept_weights(t), keys)
    q.__name__ = name
    return q


_benefit_query("benefit_by_category", ("category_display",))
_benefit_query("benefit_by_category_gender", ("category_display", "gender"))
_benefit_query("benefit_by_category_age", ("category_display", "age_group"))
_benefit_query("benefit_by_all_groups", ("category_display", "gender", "age_group", "marital_status"))


@register("cost_by_encounter_type", f"""
SELECT type_text, {O.mean_sql('total_amount')} AS avg_cost, {O.sum_sql('total_amount')} AS total_cost,
  COUNT(total_amount) AS num_encounters FROM claims_encounters GROUP BY type_text""")
def cost_by_encounter_type(spark, sf):
    claims, encounters, _, _ = cost_inputs(_t(spark, sf))
    return cost.cost_by_encounter_type(claims, encounters)


@register("cost_by_provider", f"""
SELECT service_provider_display, {O.sum_sql('total_amount')} AS total_cost,
  {O.mean_sql('total_amount')} AS avg_cost, COUNT(total_amount) AS num_encounters
FROM (SELECT CASE WHEN service_provider_display IS NULL OR service_provider_display = '' THEN 'Others'
             ELSE service_provider_display END AS service_provider_display, total_amount
      FROM claims_encounters) GROUP BY service_provider_display""")
def cost_by_provider(spark, sf):
    claims, encounters, _, _ = cost_inputs(_t(spark, sf))
    return cost.cost_by_provider(claims, encounters)


@register("cost_by_gender", f"""
SELECT gender, {O.sum_sql('total_amount')} AS total_cost FROM claim_patient GROUP BY gender
ORDER BY total_cost DESC NULLS LAST""")
def cost_by_gender(spark, sf):
    claims, _, patients, _ = cost_inputs(_t(spark, sf))
    return cost.cost_by_gender(claims, patients)


@register("cost_share_by_gender", f"""
SELECT gender, total_cost, total_cost * CAST(100.0 AS DOUBLE) / CAST(SUM(CAST(total_cost AS DECIMAL(38,6))) OVER () AS DOUBLE) AS share_pct
FROM (SELECT gender, {O.sum_sql('total_amount')} AS total_cost FROM claim_patient GROUP BY gender)""")
def cost_share_by_gender(spark, sf):
    claims, _, patients, _ = cost_inputs(_t(spark, sf))
    return cost.cost_share_by_gender(claims, patients)


@register("cost_by_age_range", f"""
SELECT CASE WHEN age <= 18 THEN '0-18' WHEN age <= 35 THEN '19-35' WHEN age <= 50 THEN '36-50'
            WHEN age <= 65 THEN '51-65' ELSE '66+' END AS age_range,
       {O.sum_sql('total_amount')} AS total_cost
FROM (SELECT total_amount, CAST(year(DATE '{AS_OF}') - year(CAST(birth_date AS DATE)) AS INTEGER) AS age FROM claim_patient)
GROUP BY 1 ORDER BY 1""")
def cost_by_age_range(spark, sf):
    claims, _, patients, _ = cost_inputs(_t(spark, sf))
    return cost.cost_by_age_range(claims, patients, AS_OF)


PROCEDURE_COST_SQL = f"""
SELECT procedure_code_display, {O.sum_sql('total_amount')} AS total_cost,
  {O.mean_sql('total_amount')} AS avg_cost, COUNT(procedure_code_display) AS frequency
FROM cost_procedures p LEFT JOIN claims_encounters ce ON p.encounter_id = ce.encounter_id
GROUP BY procedure_code_display"""


@register("cost_by_procedure", PROCEDURE_COST_SQL)
def cost_by_procedure(spark, sf):
    claims, encounters, _, procedures = cost_inputs(_t(spark, sf))
    return cost.cost_by_procedure(procedures, claims, encounters)


TOP_COST_SQL = """
SELECT patient_id, claim_id, total_amount, currency, insurance_coverage_display, encounter_id,
  start_time, end_time, service_provider_id, service_provider_display, type_text
FROM claims_encounters
ORDER BY total_amount DESC NULLS LAST, claim_id ASC NULLS FIRST, encounter_id ASC NULLS FIRST
LIMIT 10"""


@register("topk_mean_by_type", f"""
SELECT type_text, {O.mean_sql('total_amount')} AS avg_amount FROM ({TOP_COST_SQL}) GROUP BY type_text""")
def topk_mean_by_type(spark, sf):
    claims, encounters, _, _ = cost_inputs(_t(spark, sf))
    return cost.mean_by_type(cost.top_cost_encounters(claims, encounters))


@register("age_box_statistics", """
SELECT MIN(CAST(age AS DOUBLE)) AS min, quantile_cont(CAST(age AS DOUBLE), 0.25) AS q1,
  quantile_cont(CAST(age AS DOUBLE), 0.5) AS median, quantile_cont(CAST(age AS DOUBLE), 0.75) AS q3,
  MAX(CAST(age AS DOUBLE)) AS max FROM p_clean""")
def age_box_statistics(spark, sf):
    return grouping.box_statistics(patients_clean(_t(spark, sf)), "age")


@register("chronic_flag_per_patient", """
SELECT replace(patient_reference, 'urn:uuid:', '') AS patient_id, 1 AS has_chronic_conditions
FROM r_condition WHERE regexp_matches(condition_code_display, 'chronic', 'i') GROUP BY 1""")
def chronic_flag_per_patient(spark, sf):
    return features.chronic_flag(_t(spark, sf).condition())


@register("total_cost_per_patient", f"""
SELECT replace(patient_reference, 'urn:uuid:', '') AS patient_id,
  {O.sum_sql('total_amount')} AS total_healthcare_cost FROM r_claim GROUP BY 1""")
def total_cost_per_patient(spark, sf):
    return features.total_cost(_t(spark, sf).claim())


@register("features_encounter", """
SELECT replace(patient_reference, 'urn:uuid:', '') AS patient_id, COUNT(encounter_id) AS num_encounters,
  COUNT(CASE WHEN status = 'finished' THEN 1 END) AS completed_encounters,
  MIN(start_time) AS first_encounter, MAX(end_time) AS last_encounter
FROM r_encounter GROUP BY 1""")
def features_encounter(spark, sf):
    return features.encounter_features(_t(spark, sf).encounter())


@register("features_claim", f"""
SELECT replace(patient_reference, 'urn:uuid:', '') AS patient_id, COUNT(claim_id) AS num_claims,
  {O.sum_sql('total_amount')} AS total_claim_amount FROM r_claim GROUP BY 1""")
def features_claim(spark, sf):
    return features.claim_features(_t(spark, sf).claim())


@register("features_counts", """
SELECT patient_id, COUNT(c) AS num_conditions, COUNT(p) AS num_procedures, COUNT(i) AS num_immunizations,
  COUNT(d) AS num_diagnostic_reports
FROM (
  SELECT replace(patient_reference, 'urn:uuid:', '') AS patient_id, 1 AS c, NULL AS p, NULL AS i, NULL AS d FROM r_condition
  UNION ALL SELECT replace(subject_reference, 'urn:uuid:', ''), NULL, 1, NULL, NULL FROM r_procedure
  UNION ALL SELECT replace(patient_reference, 'urn:uuid:', ''), NULL, NULL, 1, NULL FROM r_immunization
  UNION ALL SELECT replace(subject_reference, 'urn:uuid:', ''), NULL, NULL, NULL, 1 FROM r_diagnostic)
GROUP BY patient_id""")
def features_counts(spark, sf):
    t = _t(spark, sf)
    return features.activity_counts(t.condition(), t.procedure(), t.immunization(),
                                    t.diagnostic_report())


# -- 2.6 pivots ----------------------------------------------------------------------

def _q(v: str) -> str:
    return '"' + v.replace('"', '""') + '"'


@register("pivot_gender_class", "SELECT gender, " + ", ".join(
    f"COUNT(CASE WHEN class_code = '{v}' THEN 1 END) AS {_q(v)}" for v in CLASS_LABELS)
    + " FROM ep GROUP BY gender")
def pivot_gender_class(spark, sf):
    return cube.pivot_counts(encounter_cube(_t(spark, sf)), ["gender"], "class_code", CLASS_LABELS)


@register("pivot_class_age_duration", "SELECT class_code, " + ", ".join(
    f"COALESCE({_avg(f'age_group = {chr(39)}{v}{chr(39)}')}, 0.0) AS {_q(v)}" for v in C.CARE_AGE_LABELS)
    + " FROM ep_kept GROUP BY class_code")
def pivot_class_age_duration(spark, sf):
    return cube.pivot_duration(encounter_cube(_t(spark, sf)), ["class_code"], "age_group", C.CARE_AGE_LABELS)


GENDER_CELLS = [(v, f"gender = '{v}'") for v in GENDERS] + [
    ("(other)", "gender NOT IN (" + ", ".join(f"'{v}'" for v in GENDERS) + ")"), ("(missing)", "gender IS NULL")]


@register("pivot_class_age_gender_duration", "SELECT class_code, age_group, " + ", ".join(
    f"COALESCE({_avg(w)}, 0.0) AS {_q(v)}" for v, w in GENDER_CELLS)
    + " FROM ep_kept GROUP BY class_code, age_group")
def pivot_class_age_gender_duration(spark, sf):
    return cube.pivot_duration_all(encounter_cube(_t(spark, sf)), ["class_code", "age_group"], "gender", GENDERS)


@register("pivot_benefit_groups", "SELECT gender, age_group, marital_status, " + ", ".join(
    f"MAX(CASE WHEN category_display = '{v}' THEN avg_value END) AS {_q(v)}" for v in BENEFIT_LABELS)
    + f" FROM (SELECT category_display, gender, age_group, marital_status, {O.mean_sql('value')} AS avg_value"
    " FROM benefit_joined GROUP BY 1, 2, 3, 4) GROUP BY gender, age_group, marital_status")
def pivot_benefit_groups(spark, sf):
    t = _t(spark, sf)
    keys = ["category_display", "gender", "age_group", "marital_status"]
    means = disparities.benefit_by(t.eob(), kept_weights(t), keys)
    return grouping.pivot_table(means, keys[1:], "category_display", F.first("avg_value"),
                                BENEFIT_LABELS)


@register("benefit_grouping_sets", f"""
SELECT category_display, gender, age_group, marital_status, {O.mean_sql('value')} AS avg_value,
  CAST(GROUPING(category_display, gender, age_group, marital_status) AS BIGINT) AS grouping
FROM benefit_joined GROUP BY GROUPING SETS ((category_display), (category_display, gender), (category_display, age_group),
  (category_display, gender, age_group, marital_status))""")
def benefit_grouping_sets(spark, sf):
    """All four benefit means from one cube."""
    t = _t(spark, sf)
    return disparities.benefit_sets(disparities.benefit_cube(t.eob(), kept_weights(t)), disparities.BENEFIT_SETS)


@register("audit_amounts", f"""
SELECT unnest(['total_amount', 'payment_amount']) AS column, unnest([COUNT(total_amount), COUNT(payment_amount)]) AS amounts,
  unnest([COUNT(*) FILTER (CAST(TRY_CAST(total_amount AS DECIMAL(28,6)) AS DOUBLE) <> total_amount), COUNT(*) FILTER (CAST(TRY_CAST(payment_amount AS DECIMAL(28,6)) AS DOUBLE) <> payment_amount)]) AS rounded,
  unnest([COUNT(*) FILTER (total_amount IS NOT NULL AND TRY_CAST(total_amount AS DECIMAL(28,6)) IS NULL), COUNT(*) FILTER (payment_amount IS NOT NULL AND TRY_CAST(payment_amount AS DECIMAL(28,6)) IS NULL)]) AS rejected
FROM r_eob""")
def audit_amounts_query(spark, sf):
    """Amounts that the exact sums round or leave out."""
    return audit_amounts(_t(spark, sf).eob(), "total_amount", "payment_amount")


# -- 2.7 top-k -----------------------------------------------------------------------

@register("topk_cost_encounters", TOP_COST_SQL)
def topk_cost_encounters(spark, sf):
    claims, encounters, _, _ = cost_inputs(_t(spark, sf))
    return cost.top_cost_encounters(claims, encounters)


@register("topk_procedures", PROCEDURE_COST_SQL
          + " ORDER BY total_cost DESC NULLS LAST, procedure_code_display ASC NULLS FIRST LIMIT 10")
def topk_procedures(spark, sf):
    claims, encounters, _, procedures = cost_inputs(_t(spark, sf))
    return cost.top_procedures(cost.cost_by_procedure(procedures, claims, encounters))


@register("topk_longest_encounters", """
SELECT encounter_id, patient_id, class_code, encounter_duration FROM ep
ORDER BY encounter_duration DESC NULLS LAST, encounter_id ASC NULLS FIRST LIMIT 10""")
def topk_longest_encounters(spark, sf):
    t = _t(spark, sf)
    return disparities.longest_encounters(encounters_clean(t), patients_clean(t)).select(
        "encounter_id", "patient_id", "class_code", "encounter_duration")


__all__ = ["QUERIES", "SQL"]
