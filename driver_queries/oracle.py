"""DuckDB SQL for every registered query, over the driver's tables.

The role views of ``roles.py`` and the cleaning steps are restated
as CTEs; each query appends its own SELECT. Where the Spark side uses a
rewrite (fan-out joins, top-k before join), the SQL here is the naive form:
the literal join then aggregate. Means are written as an exact sum divided
by a count, the same arithmetic as the Spark side, so results agree to the
last bit.
"""

from __future__ import annotations

AS_OF = "2024-12-01"


def mean_sql(x: str) -> str:
    """Exact mean of a money column."""
    return (f"CAST(SUM(CAST({x} AS DECIMAL(28,6))) AS DOUBLE) / "
            f"CAST(NULLIF(COUNT({x}), 0) AS DOUBLE)")


def sum_sql(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(28,6))) AS DOUBLE)"


def mean_int_sql(x: str, divisor: float | None = None) -> str:
    m = f"CAST(SUM({x}) AS DOUBLE) / CAST(NULLIF(COUNT({x}), 0) AS DOUBLE)"
    return f"{m} / CAST({divisor} AS DOUBLE)" if divisor else m


def avg_minutes_sql(cond: str | None = None) -> str:
    x = "encounter_seconds" if cond is None else f"CASE WHEN {cond} THEN encounter_seconds END"
    return mean_int_sql(x, 60)


def ref_sql(prefix: str, c: str) -> str:
    return f"'urn:uuid:{prefix}' || CAST({c} AS VARCHAR)"


ROLE_CTES = f"""
r_patient AS (
  SELECT 'p' || CAST(c_custkey AS VARCHAR) AS patient_id,
    CASE WHEN c_custkey % 41 = 7 THEN 'other' WHEN c_custkey % 43 = 9 THEN 'unknown' WHEN c_custkey % 47 = 5 THEN NULL WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender,
    CAST(DATE '1930-01-01' + CAST((c_custkey * 7919) % 33000 AS INTEGER) AS VARCHAR) AS birth_date,
    c_mktsegment AS city, n_name AS state, 'N' || CAST(c_nationkey AS VARCHAR) AS postal_code,
    CASE WHEN c_custkey % 4 = 0 THEN ' M ' WHEN c_custkey % 4 = 1 THEN 'S'
         WHEN c_custkey % 4 = 2 THEN 'Never Married' END AS marital_status,
    c_acctbal / CAST(1000.0 AS DOUBLE) AS disability_adjusted_life_years,
    c_acctbal / CAST(500.0 AS DOUBLE) AS quality_adjusted_life_years
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
r_encounter AS (
  SELECT 'e' || CAST(o_orderkey AS VARCHAR) AS encounter_id,
    CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'in-progress' END AS status,
    CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN 'EMER' WHEN substr(o_orderpriority, 1, 1) = '2' THEN 'IMP'
         WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'AMB' WHEN substr(o_orderpriority, 1, 1) = '4' THEN 'HH' END AS class_code,
    o_orderpriority AS type_text,
    CASE WHEN o_orderkey % 40 = 0 THEN NULL ELSE o_orderdate END AS start_time,
    o_orderdate + to_minutes(CAST((o_orderkey * 37) % 100000 AS BIGINT)) AS end_time,
    {ref_sql('p', 'o_custkey')} AS patient_reference,
    'org' || CAST(o_orderkey % 7 AS VARCHAR) AS service_provider_id,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN ''
         ELSE 'Clinic ' || CAST(o_orderkey % 7 AS VARCHAR) END AS service_provider_display
  FROM orders),
r_claim AS (
  SELECT 'c' || CAST(o_orderkey AS VARCHAR) AS claim_id,
    CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE {ref_sql('p', 'o_custkey')} END AS patient_reference,
    o_totalprice AS total_amount, 'USD' AS currency,
    'Plan ' || o_orderstatus AS insurance_coverage_display, o_orderdate AS created_date
  FROM orders),
r_procedure AS (
  SELECT 'x' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS procedure_id,
    {ref_sql('p', 'o_custkey')} AS subject_reference,
    {ref_sql('e', 'l_orderkey')} AS encounter_reference,
    p_name AS procedure_code_display, CAST(l_partkey AS VARCHAR) AS procedure_code
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey),
r_eob AS (
  SELECT 'b' || CAST(l_orderkey AS VARCHAR) AS eob_id, {ref_sql('p', 'o_custkey')} AS patient_reference,
    l_linenumber AS line, 'Plan ' || o_orderstatus AS insurance_coverage_display,
    o_orderdate AS billable_period_start, o_totalprice AS total_amount,
    l_extendedprice * (1 - l_discount) AS payment_amount,
    l_extendedprice, l_discount, l_tax
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r_benefit AS (
  SELECT eob_id, patient_reference, line, l_extendedprice AS value, 'USD' AS currency,
         '0' AS category_code, 'Line Submitted Charge Amount' AS category_display FROM r_eob
  UNION ALL
  SELECT eob_id, patient_reference, line, l_extendedprice * (1 - l_discount), 'USD',
         '1', 'Line Allowed Charge Amount' FROM r_eob
  UNION ALL
  SELECT eob_id, patient_reference, line, l_extendedprice * l_tax, 'USD',
         '2', ' line beneficiary coinsurance amount' FROM r_eob
  UNION ALL
  SELECT eob_id, patient_reference, line, CAST(0.0 AS DOUBLE), 'USD',
         '3', 'Line Beneficiary Part B Deductible Amount' FROM r_eob
  UNION ALL
  SELECT eob_id, patient_reference, line, CAST(NULL AS DOUBLE), 'USD',
         '4', 'Line Processing Indicator Code' FROM r_eob),
r_condition AS (
  SELECT 'k' || CAST(event_id AS VARCHAR) AS condition_id, {ref_sql('p', 'user_id')} AS patient_reference,
    CASE WHEN value > 100 THEN 'Chronic sinusitis' WHEN value > 50 THEN 'ACUTE ON CHRONIC pain'
         ELSE 'Sprain' END AS condition_code_display,
    ts AS onset_datetime
  FROM events WHERE event_type = 'error'),
r_observation AS (
  SELECT 'o' || CAST(event_id AS VARCHAR) AS observation_id, {ref_sql('p', 'user_id')} AS subject_reference,
    event_type AS observation_code_display, ts AS effective_date_time, value AS value_quantity_value,
    props AS payload
  FROM events WHERE event_type IN ('click', 'purchase')),
r_immunization AS (
  SELECT 'i' || CAST(event_id AS VARCHAR) AS immunization_id, {ref_sql('p', 'user_id')} AS patient_reference,
    ts AS occurrence_date_time
  FROM events WHERE event_type = 'signup'),
r_diagnostic AS (
  SELECT 'd' || CAST(event_id AS VARCHAR) AS diagnostic_report_id, {ref_sql('p', 'user_id')} AS subject_reference,
    ts AS effective_date_time
  FROM events WHERE event_type = 'view'),
p_clean AS (
  SELECT patient_id, gender, birth_date, state, postal_code,
    CASE WHEN trim(lower(marital_status)) = 'm' THEN 'Married'
         WHEN trim(lower(marital_status)) = 's' THEN 'Single'
         WHEN trim(lower(marital_status)) = 'never married' THEN 'Never Married'
         ELSE 'Unknown' END AS marital_status,
    disability_adjusted_life_years, quality_adjusted_life_years,
    CAST(year(DATE '{AS_OF}') - year(CAST(birth_date AS DATE)) AS INTEGER) AS age
  FROM r_patient),
e_clean AS (
  SELECT encounter_id,
    CASE WHEN status = 'finished' THEN 'Completed' ELSE 'In-Progress' END AS status,
    CASE WHEN class_code = 'IMP' THEN 'Inpatient' WHEN class_code = 'AMB' THEN 'Ambulatory'
         WHEN class_code = 'EMER' THEN 'Emergency' ELSE 'Unknown' END AS class_code,
    type_text, start_time, end_time,
    replace(patient_reference, 'urn:uuid:', '') AS patient_reference,
    service_provider_id, service_provider_display,
    date_diff('second', start_time, end_time) AS encounter_seconds,
    date_diff('second', start_time, end_time) / CAST(60 AS DOUBLE) AS encounter_duration
  FROM r_encounter
  WHERE encounter_id IS NOT NULL AND patient_reference IS NOT NULL AND start_time IS NOT NULL),
ep AS (
  SELECT e.encounter_id, e.status, e.class_code, e.type_text, e.start_time, e.end_time,
    e.patient_reference, e.encounter_seconds, e.encounter_duration,
    p.patient_id, p.gender, p.birth_date, p.state, p.postal_code, p.marital_status,
    p.disability_adjusted_life_years, p.quality_adjusted_life_years, p.age,
    CASE WHEN p.age < 18 THEN 'Child' WHEN p.age < 40 THEN 'Young Adult'
         WHEN p.age < 65 THEN 'Middle Aged' ELSE 'Senior' END AS age_group
  FROM e_clean e JOIN p_clean p ON e.patient_reference = p.patient_id),
ep_kept AS (
  SELECT * FROM ep WHERE encounter_duration <= 86400 OR class_code <> 'Inpatient'),
cost_claims AS (
  SELECT patient_reference AS patient_id, claim_id, total_amount, currency, insurance_coverage_display
  FROM r_claim),
cost_encounters AS (
  SELECT encounter_id, patient_reference AS patient_id, start_time, end_time, service_provider_id,
    service_provider_display, type_text
  FROM r_encounter),
cost_procedures AS (
  SELECT procedure_id,
    CASE WHEN strpos(encounter_reference, 'urn:uuid:') > 0
         THEN split_part(encounter_reference, 'urn:uuid:', 2) END AS encounter_id,
    procedure_code_display
  FROM r_procedure),
claims_encounters AS (
  SELECT c.patient_id, c.claim_id, c.total_amount, c.currency, c.insurance_coverage_display,
    e.encounter_id, e.start_time, e.end_time, e.service_provider_id, e.service_provider_display, e.type_text
  FROM cost_claims c LEFT JOIN cost_encounters e ON c.patient_id = e.patient_id),
claim_patient AS (
  SELECT c.claim_id, c.total_amount,
    CASE WHEN strpos(c.patient_id, 'urn:uuid:') > 0 THEN split_part(c.patient_id, 'urn:uuid:', 2) END AS patient_id_clean,
    p.gender, p.birth_date
  FROM cost_claims c LEFT JOIN r_patient p
    ON (CASE WHEN strpos(c.patient_id, 'urn:uuid:') > 0 THEN split_part(c.patient_id, 'urn:uuid:', 2) END) = p.patient_id),
benefit_lines AS (
  SELECT eob_id, replace(patient_reference, 'urn:uuid:', '') AS patient_reference, value,
    CASE WHEN trim(lower(category_display)) = 'line submitted charge amount' THEN 'Submitted Charge'
         WHEN trim(lower(category_display)) = 'line beneficiary coinsurance amount' THEN 'Coinsurance Amount'
         WHEN trim(lower(category_display)) = 'line allowed charge amount' THEN 'Allowed Charge'
         WHEN trim(lower(category_display)) = 'line provider payment amount' THEN 'Provider Payment'
         WHEN trim(lower(category_display)) = 'line beneficiary part b deductible amount' THEN 'Part B Deductible'
         WHEN trim(lower(category_display)) = 'line processing indicator Code' THEN 'Processing Indicator'
         ELSE 'Unknown' END AS category_display
  FROM r_benefit),
benefit_joined AS (
  SELECT l.category_display, l.value, h.billable_period_start, d.gender, d.age, d.marital_status, d.age_group
  FROM benefit_lines l
  JOIN (SELECT eob_id, billable_period_start FROM r_eob) h ON l.eob_id = h.eob_id
  JOIN (SELECT patient_reference, gender, age, marital_status, age_group FROM ep_kept) d
    ON l.patient_reference = d.patient_reference
  WHERE l.category_display NOT IN ('Unknown', 'Part B Deductible')),
features_base AS (
  SELECT patient_id, state,
    CAST(trunc(CAST(date_diff('day', CAST(birth_date AS DATE), DATE '{AS_OF}') AS DOUBLE) / CAST(365.25 AS DOUBLE)) AS INTEGER) AS age
  FROM r_patient),
features AS (
  SELECT b.patient_id, b.state,
    COALESCE(hc.has_chronic_conditions, 0) AS has_chronic_conditions,
    COALESCE(cl.total_claim_amount, 0.0) AS total_healthcare_cost,
    COALESCE(b.age, 0) AS age,
    CASE WHEN b.age >= 65 THEN 1 ELSE 0 END AS is_senior,
    CASE WHEN b.state IN ('CA', 'NY') THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END AS region_risk,
    CASE WHEN b.age > 50 THEN 1 ELSE 0 END AS label,
    COALESCE(en.num_encounters, 0) AS num_encounters,
    COALESCE(en.completed_encounters, 0) AS completed_encounters,
    COALESCE(cl.num_claims, 0) AS num_claims,
    COALESCE(cl.total_claim_amount, 0.0) AS total_claim_amount,
    COALESCE(co.num_conditions, 0) AS num_conditions,
    COALESCE(pr.num_procedures, 0) AS num_procedures,
    COALESCE(im.num_immunizations, 0) AS num_immunizations,
    COALESCE(dr.num_diagnostic_reports, 0) AS num_diagnostic_reports,
    en.first_encounter, en.last_encounter
  FROM features_base b
  LEFT JOIN (SELECT replace(patient_reference, 'urn:uuid:', '') AS pid, 1 AS has_chronic_conditions
             FROM r_condition WHERE regexp_matches(condition_code_display, 'chronic', 'i')
             GROUP BY 1) hc ON b.patient_id = hc.pid
  LEFT JOIN (SELECT replace(patient_reference, 'urn:uuid:', '') AS pid, COUNT(encounter_id) AS num_encounters,
                    COUNT(CASE WHEN status = 'finished' THEN 1 END) AS completed_encounters,
                    MIN(start_time) AS first_encounter, MAX(end_time) AS last_encounter
             FROM r_encounter GROUP BY 1) en ON b.patient_id = en.pid
  LEFT JOIN (SELECT replace(patient_reference, 'urn:uuid:', '') AS pid, COUNT(claim_id) AS num_claims,
                    {sum_sql('total_amount')} AS total_claim_amount
             FROM r_claim GROUP BY 1) cl ON b.patient_id = cl.pid
  LEFT JOIN (SELECT replace(patient_reference, 'urn:uuid:', '') AS pid, COUNT(condition_id) AS num_conditions
             FROM r_condition GROUP BY 1) co ON b.patient_id = co.pid
  LEFT JOIN (SELECT replace(subject_reference, 'urn:uuid:', '') AS pid, COUNT(procedure_id) AS num_procedures
             FROM r_procedure GROUP BY 1) pr ON b.patient_id = pr.pid
  LEFT JOIN (SELECT replace(patient_reference, 'urn:uuid:', '') AS pid, COUNT(immunization_id) AS num_immunizations
             FROM r_immunization GROUP BY 1) im ON b.patient_id = im.pid
  LEFT JOIN (SELECT replace(subject_reference, 'urn:uuid:', '') AS pid, COUNT(diagnostic_report_id) AS num_diagnostic_reports
             FROM r_diagnostic GROUP BY 1) dr ON b.patient_id = dr.pid)
"""


def with_roles(select: str) -> str:
    return "WITH " + ROLE_CTES.strip() + "\n" + select.strip()
