"""Registered ETL queries: bundles, entries, flatteners, warehouse round trip.

Resources are built from the driver tables (``resources.py``); the
oracle SQL states the flat rows each flattener must produce from them.
Array columns are compared as JSON text (``to_json`` on both sides), nested
adjudications by their length.
"""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from care_analytics.operators.flatten import FLATTENERS, flatten
from care_analytics.plans import disparities
from .core import _t, register
from care_analytics.functions.columns import parse_json_array
from care_analytics.schemas import TABLE_OF
from care_analytics.session import checkpoint_dir
from care_analytics.sources.bundles import bundle_entries, read_bundles, resource_counts
from .resources import RoleResources
from care_analytics.sources.warehouse import STAGING, Warehouse, _remove, set_conf


def _iso(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%S')"


def _s(prefix: str, c: str) -> str:
    return f"'{prefix}' || CAST({c} AS VARCHAR)"


END = _iso("o_orderdate + to_minutes(CAST((o_orderkey * 37) % 100000 AS BIGINT))")
START = _iso("o_orderdate")
SUBJECT = _s("urn:uuid:p", "o_custkey")
LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"


RAW_SQL: dict[str, str] = {}


def _reg(name: str, sql: str | None = None):
    if sql is not None:
        RAW_SQL[name] = sql
    return register(name, sql)


def _res(spark, sf, rtype: str) -> DataFrame:
    return RoleResources(_t(spark, sf)).of_type(rtype)


def _flat(spark, sf, rtype: str, **kw) -> DataFrame:
    return flatten(_res(spark, sf, rtype), FLATTENERS[rtype], **kw)


def _jsonify(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.to_json(c))
    return df


def _nested_len(df: DataFrame) -> DataFrame:
    return df.withColumn("num_adjudications", F.size("adjudication")).drop("adjudication")


# -- flatteners ------------------------------------------------------------------------

PATIENT_SQL = f"""
SELECT {_s('p', 'c_custkey')} AS patient_id,
  to_json(['Medical Record Number', c_mktsegment]) AS identifier_types,
  '[{{"family":"' || c_name || '","use":"official"}}]' AS name,
  CASE WHEN c_custkey % 41 = 7 THEN 'other' WHEN c_custkey % 43 = 9 THEN 'unknown' WHEN c_custkey % 47 = 5 THEN NULL WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender,
  strftime(DATE '1930-01-01' + CAST((c_custkey * 7919) % 33000 AS INTEGER), '%Y-%m-%d') AS birth_date,
  c_mktsegment AS city, n_name AS state, {_s('R', 'n_regionkey')} AS country,
  {_s('N', 'c_nationkey')} AS postal_code, c_acctbal AS latitude, CAST(n_nationkey AS DOUBLE) AS longitude,
  {_s('555-', 'c_custkey')} AS phone,
  CASE WHEN c_custkey % 4 = 0 THEN ' M ' WHEN c_custkey % 4 = 1 THEN 'S'
       WHEN c_custkey % 4 = 2 THEN 'Never Married' END AS marital_status,
  c_name AS mothers_maiden_name, c_mktsegment AS birthplace_city, n_name AS birthplace_state,
  'CA' AS birthplace_country, c_acctbal / CAST(1000.0 AS DOUBLE) AS disability_adjusted_life_years,
  c_acctbal / CAST(500.0 AS DOUBLE) AS quality_adjusted_life_years,
  c_custkey % 3 = 0 AS multiple_birth, to_json(['English', n_name]) AS languages
FROM customer JOIN nation ON c_nationkey = n_nationkey"""


@_reg("flatten_patient", PATIENT_SQL)
def flatten_patient(spark, sf):
    return _jsonify(_flat(spark, sf, "Patient"), "identifier_types", "languages")


def _encounter_part(i: int) -> str:
    if i == 1:
        disp, r, code, label = _s("Dr ", "o_orderkey % 13"), _s("urn:uuid:pr", "o_orderkey % 13"), \
            "PPRF", "primary performer"
    else:
        disp, r, code, label = _s("Nurse ", "o_custkey % 11"), _s("urn:uuid:nu", "o_custkey % 11"), \
            "ATND", "attender"
    return f"""
SELECT {_s('e', 'o_orderkey')} AS encounter_id,
  CASE WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'in-progress' END AS status,
  CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN 'EMER' WHEN substr(o_orderpriority, 1, 1) = '2' THEN 'IMP'
       WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'AMB' WHEN substr(o_orderpriority, 1, 1) = '4' THEN 'HH' END AS class_code,
  o_orderpriority AS type_text,
  CASE WHEN o_orderkey % 40 = 0 THEN NULL ELSE {START} END AS start_time, {END} AS end_time,
  {SUBJECT} AS patient_reference, {_s('urn:uuid:org', 'o_orderkey % 7')} AS service_provider_id,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN ''
       ELSE {_s('Clinic ', 'o_orderkey % 7')} END AS service_provider_display,
  {disp} AS participant_individual_display, {r} AS participant_individual_reference,
  {START} AS participant_period_start, {END} AS participant_period_end,
  '{code}' AS participant_type_code, '{label}' AS participant_type_display
FROM orders WHERE o_orderstatus <> 'P'"""


@_reg("flatten_encounter", _encounter_part(1) + "\nUNION ALL" + _encounter_part(2))
def flatten_encounter(spark, sf):
    return _flat(spark, sf, "Encounter")


EVENT_REF = _s("urn:uuid:p", "user_id")


@_reg("flatten_condition", f"""
SELECT {_s('k', 'event_id')} AS condition_id, 'active' AS clinical_status, 'confirmed' AS verification_status,
  CASE WHEN value > 100 THEN 'Chronic sinusitis' WHEN value > 50 THEN 'ACUTE ON CHRONIC pain'
       ELSE 'Sprain' END AS condition_code_display,
  {EVENT_REF} AS patient_reference, {_s('urn:uuid:e', 'event_id')} AS encounter_reference,
  {_iso('ts')} AS onset_datetime, CAST(NULL AS VARCHAR) AS abatement_datetime,
  strftime(ts, '%Y-%m-%d') AS recorded_date
FROM events WHERE event_type = 'error'""")
def flatten_condition(spark, sf):
    return _flat(spark, sf, "Condition")


def _med(text: str, where: str = "") -> str:
    return f"""
SELECT 'm' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS medication_request_id,
  CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'active' END AS status, 'order' AS intent,
  {_s('Part ', 'l_partkey')} AS medication_display, {SUBJECT} AS patient_reference,
  {_s('urn:uuid:s', 'l_suppkey')} AS requester_reference, {_s('Supplier ', 'l_suppkey')} AS requester_display,
  {_s('urn:uuid:e', 'l_orderkey')} AS encounter_reference, {_iso('l_shipdate')} AS authored_on,
  {text} AS dosage_text
FROM {LINES} {where}"""


@_reg("flatten_medication_request",
          _med("'Take ' || CAST(l_linenumber AS VARCHAR) || ' units'") + "\nUNION ALL"
          + _med("'With food'", "WHERE l_quantity > 25"))
def flatten_medication_request(spark, sf):
    return _flat(spark, sf, "MedicationRequest")


def _claim_item(i: int) -> str:
    net = "o_totalprice" if i == 1 else "CAST(0.0 AS DOUBLE)"
    return f"""
SELECT {_s('c', 'o_orderkey')} AS claim_id, 'active' AS status, 'institutional' AS type_code, 'claim' AS use,
  CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE {SUBJECT} END AS patient_reference,
  {_s('Patient ', 'o_custkey')} AS patient_display, {START} AS created_date,
  {START} AS billable_period_start, {END} AS billable_period_end,
  {_s('urn:uuid:org', 'o_orderkey % 7')} AS provider_reference, 'normal' AS priority,
  'info' AS supporting_info_code, {_s('urn:uuid:e', 'o_orderkey')} AS supporting_info_value_reference,
  {_s('Plan ', 'o_orderstatus')} AS insurance_coverage_display, true AS insurance_focal,
  o_totalprice AS total_amount, 'USD' AS currency, {_s('urn:uuid:k', 'o_orderkey')} AS diagnosis_reference,
  'svc{i}' AS item_code, 'Service {i}' AS item_description, o_orderpriority AS item_category,
  {net} AS item_net_value, 'USD' AS item_net_currency, {_s('urn:uuid:e', 'o_orderkey')} AS encounter_reference,
  {_s('Clinic ', 'o_orderkey % 7')} AS location_description, {START} AS service_period_start,
  {END} AS service_period_end, 1 AS num_adjudications
FROM orders WHERE o_orderpriority <> '5-LOW'"""


@_reg("flatten_claim", _claim_item(1) + "\nUNION ALL" + _claim_item(2))
def flatten_claim(spark, sf):
    return _nested_len(_flat(spark, sf, "Claim"))


def _eob_item(i: int) -> str:
    net = "o_totalprice" if i == 1 else "CAST(0.0 AS DOUBLE)"
    return f"""
SELECT {_s('b', 'o_orderkey')} AS eob_id, {_s('c', 'o_orderkey')} AS identifier_claim_id,
  {_s('g', 'o_custkey')} AS identifier_claim_group, 'active' AS status, 'institutional' AS code,
  'claim' AS use, {SUBJECT} AS patient_reference, {START} AS billable_period_start,
  {END} AS billable_period_end, {_s('Insurer ', 'o_orderstatus')} AS insurer_display,
  {_s('urn:uuid:org', 'o_orderkey % 7')} AS provider_reference, {_s('urn:uuid:r', 'o_orderkey')} AS referral_reference,
  {_s('urn:uuid:c', 'o_orderkey')} AS claim_reference, 'complete' AS outcome,
  {_s('urn:uuid:pr', 'o_orderkey % 13')} AS care_team_provider_reference, 'primary provider' AS care_team_role,
  {_s('urn:uuid:cov', 'o_orderkey')} AS insurance_coverage_reference,
  {_s('Plan ', 'o_orderstatus')} AS insurance_coverage_display, true AS insurance_focal,
  o_orderpriority AS item_category_display, 'svc{i}' AS item_service_code,
  'Service {i}' AS item_service_description, {net} AS item_net_value, 'USD' AS item_net_currency,
  {_s('Clinic ', 'o_orderkey % 7')} AS location_description, {START} AS service_period_start,
  {END} AS service_period_end, 2 AS num_adjudications,
  CAST(NULL AS DOUBLE) AS total_amount, CAST(NULL AS VARCHAR) AS total_currency,
  o_totalprice / CAST(2.0 AS DOUBLE) AS payment_amount, 'USD' AS payment_currency, {START} AS created_date,
  o_totalprice AS total_first_amount
FROM orders"""


@_reg("flatten_explanation_of_benefit", _eob_item(1) + "\nUNION ALL" + _eob_item(2))
def flatten_explanation_of_benefit(spark, sf):
    return _nested_len(_flat(spark, sf, "ExplanationOfBenefit"))


# The inventory's short name for the same flattener.
_reg("flatten_eob", RAW_SQL["flatten_explanation_of_benefit"])(flatten_explanation_of_benefit)


def _careplan(code: str, label: str) -> str:
    return f"""
SELECT {_s('cp', 'o_orderkey')} AS careplan_id,
  CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'active' END AS status, 'plan' AS intent,
  {SUBJECT} AS patient_reference, {_s('urn:uuid:e', 'o_orderkey')} AS encounter_reference,
  {START} AS period_start, {END} AS period_end, {START} AS created_date,
  {_s('urn:uuid:ct', 'o_orderkey')} AS care_team_reference, '{label}' AS activity_display,
  '{code}' AS activity_code, 'completed' AS activity_status,
  {_s('Clinic ', 'o_orderkey % 7')} AS activity_location,
  to_json([{_s('urn:uuid:k', 'o_orderkey')}]) AS addresses, o_orderpriority AS category_text
FROM orders"""


@_reg("flatten_careplan", _careplan("a1", "Diet") + "\nUNION ALL" + _careplan("a2", "Exercise"))
def flatten_careplan(spark, sf):
    return _jsonify(_flat(spark, sf, "CarePlan"), "addresses")


def _careteam(role: str, ref: str, disp: str) -> str:
    return f"""
SELECT {_s('ct', 'o_orderkey')} AS care_team_id, 'active' AS status, {SUBJECT} AS subject_reference,
  {_s('urn:uuid:e', 'o_orderkey')} AS encounter_reference, {START} AS period_start, {END} AS period_end,
  {_s('Clinic ', 'o_orderkey % 7')} AS managing_organization, '{role}' AS participant_role,
  {ref} AS participant_reference, {disp} AS participant_display
FROM orders"""


@_reg("flatten_careteam",
          _careteam("Physician", _s("urn:uuid:pr", "o_orderkey % 13"), _s("Dr ", "o_orderkey % 13"))
          + "\nUNION ALL" + _careteam("Patient", SUBJECT, _s("Patient ", "o_custkey")))
def flatten_careteam(spark, sf):
    return _flat(spark, sf, "CareTeam")


@_reg("flatten_procedure", f"""
SELECT 'x' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS procedure_id,
  'completed' AS status, {_s('Part ', 'l_partkey')} AS procedure_code_display,
  CAST(l_partkey AS VARCHAR) AS procedure_code, {SUBJECT} AS subject_reference,
  {_iso('l_shipdate')} AS performed_period_start,
  {_iso('l_shipdate + INTERVAL 30 MINUTE')} AS performed_period_end,
  {_s('urn:uuid:e', 'l_orderkey')} AS encounter_reference,
  {_s('urn:uuid:k', 'l_orderkey')} AS reason_reference, l_returnflag AS reason_reference_display
FROM {LINES} WHERE l_returnflag <> 'N'""")
def flatten_procedure(spark, sf):
    return _flat(spark, sf, "Procedure")


def _report(result: str) -> str:
    return f"""
SELECT {_s('d', 'event_id')} AS diagnostic_report_id, 'final' AS status, event_type AS code,
  {_s('LOINC-', 'event_id % 50')} AS code_system, {EVENT_REF} AS subject_reference,
  {_s('urn:uuid:e', 'event_id')} AS encounter_reference, {_iso('ts')} AS effective_date_time,
  {_iso('ts')} AS issued_date, {result} AS result_display, 'Laboratory' AS category_display
FROM events WHERE event_type = 'view'"""


@_reg("flatten_diagnostic_report", _report("'Result A'") + "\nUNION ALL" + _report("props"))
def flatten_diagnostic_report(spark, sf):
    return _flat(spark, sf, "DiagnosticReport")


@_reg("flatten_immunization", f"""
SELECT {_s('i', 'event_id')} AS immunization_id, 'completed' AS status, 'Influenza' AS vaccine_display,
  {_s('CVX-', 'event_id % 20')} AS vaccine_code, {EVENT_REF} AS patient_reference,
  {_s('urn:uuid:e', 'event_id')} AS encounter_reference, value > 50 AS primary_source,
  {_iso('ts')} AS occurrence_date_time
FROM events WHERE event_type = 'signup'""")
def flatten_immunization(spark, sf):
    return _flat(spark, sf, "Immunization")


@_reg("flatten_observation", f"""
SELECT {_s('o', 'event_id')} AS observation_id, 'final' AS status, event_type AS observation_code_display,
  {_s('obs-', 'event_type')} AS observation_code, {EVENT_REF} AS subject_reference,
  {_s('urn:uuid:e', 'event_id')} AS encounter_reference, {_iso('ts')} AS effective_date_time,
  {_iso('ts')} AS issued_date, value AS value_quantity_value, 'USD' AS value_quantity_unit,
  'vital-signs' AS category_display
FROM events WHERE event_type IN ('click', 'purchase')""")
def flatten_observation(spark, sf):
    return _flat(spark, sf, "Observation")


# -- bundles, entries, parsing, helpers ------------------------------------------------------

ENTRY_IDS_SQL = f"""
SELECT 'Patient' AS resource_type, {_s('p', 'c_custkey')} AS resource_id FROM customer
UNION ALL SELECT 'Encounter', {_s('e', 'o_orderkey')} FROM orders
UNION ALL SELECT 'Claim', {_s('c', 'o_orderkey')} FROM orders
UNION ALL SELECT 'ExplanationOfBenefit', {_s('b', 'o_orderkey')} FROM orders
UNION ALL SELECT 'CarePlan', {_s('cp', 'o_orderkey')} FROM orders
UNION ALL SELECT 'CareTeam', {_s('ct', 'o_orderkey')} FROM orders
UNION ALL SELECT 'MedicationRequest', 'm' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) FROM lineitem
UNION ALL SELECT 'Procedure', 'x' || CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) FROM lineitem
UNION ALL SELECT CASE event_type WHEN 'error' THEN 'Condition' WHEN 'view' THEN 'DiagnosticReport'
                 WHEN 'signup' THEN 'Immunization' ELSE 'Observation' END,
          CASE event_type WHEN 'error' THEN 'k' WHEN 'view' THEN 'd' WHEN 'signup' THEN 'i' ELSE 'o' END
          || CAST(event_id AS VARCHAR) FROM events"""


def _entries(spark, sf) -> DataFrame:
    return bundle_entries(RoleResources(_t(spark, sf)).bundles())


@_reg("flatten_bundle_entries", ENTRY_IDS_SQL)
def flatten_bundle_entries(spark, sf):
    return _entries(spark, sf).select(
        "resource_type", F.try_variant_get("resource", "$.id", "string").alias("resource_id"))


@_reg("demux_resource_counts",
          f"SELECT resource_type, COUNT(*) AS num_resources FROM ({ENTRY_IDS_SQL}) GROUP BY resource_type")
def demux_resource_counts(spark, sf):
    return resource_counts(_entries(spark, sf))


@_reg("parse_polymorphic_json", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def parse_polymorphic_json(spark, sf):
    """``from_json`` with an array schema: one object or a list both parse."""
    parsed = parse_json_array("props", "array<struct<k: bigint>>")
    return _t(spark, sf).table("events").select("event_id", F.get(parsed, 0).getField("k").alias("k"))


@_reg("explode_cross_product", f"""
SELECT {_s('c', 'o_orderkey')} AS claim_id, CAST(2 AS BIGINT) AS line_rows, CAST(1 AS BIGINT) AS header_rows
FROM orders WHERE o_orderpriority <> '5-LOW'""")
def explode_cross_product(spark, sf):
    """Rows per claim at grain ``line`` (cross product) and ``header``."""
    res = _res(spark, sf, "Claim")
    line = flatten(res, FLATTENERS["Claim"]).groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("line_rows"))
    header = flatten(res, FLATTENERS["Claim"], grain="header").groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("header_rows"))
    return line.join(header, "claim_id")


@_reg("array_filter_first", f"""
SELECT {_s('p', 'c_custkey')} AS patient_id, c_acctbal AS latitude, CAST(n_nationkey AS DOUBLE) AS longitude
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def array_filter_first(spark, sf):
    return _flat(spark, sf, "Patient").select("patient_id", "latitude", "longitude")


@_reg("array_transform", f"""
SELECT {_s('p', 'c_custkey')} AS patient_id, to_json(['Medical Record Number', c_mktsegment]) AS identifier_types,
  to_json(['English', n_name]) AS languages
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def array_transform(spark, sf):
    return _jsonify(_flat(spark, sf, "Patient").select("patient_id", "identifier_types", "languages"),
                    "identifier_types", "languages")


@_reg("flatten_adjudication", """
SELECT eob_id, patient_reference, value, currency, category_code, category_display FROM r_benefit""")
def flatten_adjudication(spark, sf):
    return disparities.adjudication_lines(_t(spark, sf).eob())


# -- warehouse round trip --------------------------------------------------------------

SCAN_SQL = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS num_rows FROM ({RAW_SQL['flatten_' + t]})"
    for t in TABLE_OF.values())


FILE_BUNDLES = 20_000      # of an NDJSON file: compressed text cannot be split, so files are kept small


def _write_bundles(spark, sf, path: str) -> None:
    """All bundles as compressed NDJSON text: a seventeenth of its plain size."""
    RoleResources(_t(spark, sf)).ndjson().write.mode("overwrite").option("compression", "gzip") \
        .option("maxRecordsPerFile", FILE_BUNDLES).text(path)


@_reg("scan_warehouse_tables", SCAN_SQL)
def scan_warehouse_tables(spark, sf):
    """ETL round trip: bundles written as NDJSON text, read back with the
    declared bundle schema, twelve Parquet tables built in the shared
    checkpoint folder, read back with their schema check, counted per table."""
    # Fixed folders per input, overwritten on every run: disk use stays bounded. The text goes when its entries are staged.
    base = f"{checkpoint_dir(spark)}/warehouse-{hashlib.sha1(sf.encode()).hexdigest()[:10]}"
    src = f"{base}/bundles"
    _write_bundles(spark, sf, src)
    wh = Warehouse(spark, f"{base}/tables")
    wh.build(bundle_entries(read_bundles(spark, src, ndjson=True)), staged=lambda: _remove(spark, src))
    return wh.row_counts()


@_reg("stream_warehouse_tables", SCAN_SQL)
def stream_warehouse_tables(spark, sf):
    """Streaming round trip: bundles written as NDJSON to the shared folder,
    ingested by Structured Streaming (``availableNow``), counted per table.

    Each run takes a fresh folder: a stream's checkpoint remembers the files
    it has read, so re-written input must not meet an old checkpoint."""
    from care_analytics.streaming import ingest
    base = f"{checkpoint_dir(spark)}/stream-{hashlib.sha1(sf.encode()).hexdigest()[:10]}"
    run = hashlib.sha1(str(time.time_ns()).encode()).hexdigest()[:8]
    src, out = f"{base}/{run}/in", f"{base}/{run}/out"
    _write_bundles(spark, sf, src)
    with set_conf(spark, STAGING):                       # a stream plans the reading of its files by the settings of the session that started it
        q = ingest.start(spark, src, out, checkpoint=f"{base}/{run}/ckpt")
        q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return Warehouse(spark, out).row_counts()

