"""Declared schemas: the bundle reader schema and the nested types kept in tables.

Bundles are read with a fixed schema instead of whole-dataset inference (an
extra pass over all input, and a result that depends on which resource types
happen to be present). Each resource is kept as VARIANT, so fields that are
an object in one resource type and an array in another need no merged
schema; paths are resolved per resource type by the flatteners.
"""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, DoubleType, StringType, StructField,
                               StructType, VariantType)

# The twelve resource types written to the warehouse.
RESOURCE_TYPES = (
    "CarePlan", "CareTeam", "Claim", "Condition", "DiagnosticReport",
    "Encounter", "ExplanationOfBenefit", "Immunization", "MedicationRequest",
    "Observation", "Patient", "Procedure",
)

# Warehouse table name per resource type.
TABLE_OF = {
    "Patient": "patient",
    "Encounter": "encounter",
    "Condition": "condition",
    "MedicationRequest": "medication_request",
    "Claim": "claim",
    "ExplanationOfBenefit": "explanation_of_benefit",
    "CarePlan": "careplan",
    "CareTeam": "careteam",
    "Procedure": "procedure",
    "DiagnosticReport": "diagnostic_report",
    "Immunization": "immunization",
    "Observation": "observation",
}

ENTRY = StructType([
    StructField("fullUrl", StringType()),
    StructField("resource", VariantType()),
])
# Documents that cannot be parsed arrive whole in this column, and as entries of this type.
CORRUPT = "_corrupt"
BUNDLE = StructType([StructField("entry", ArrayType(ENTRY)), StructField(CORRUPT, StringType())])

CODING = StructType([
    StructField("system", StringType()),
    StructField("code", StringType()),
    StructField("display", StringType()),
])
MONEY = StructType([StructField("value", DoubleType()), StructField("currency", StringType())])
ADJUDICATION = ArrayType(StructType([
    StructField("amount", MONEY),
    StructField("category", StructType([StructField("coding", ArrayType(CODING))])),
]))
ADJUDICATION_DDL = ("array<struct<amount:struct<value:double,currency:string>,"
                    "category:struct<coding:array<struct<system:string,code:string,display:string>>>>>")

# Parsing schema for a JSON text field that may hold one object or an array
# of them (``from_json`` with an array schema accepts both).
CODEABLE_CONCEPTS = ArrayType(StructType([
    StructField("coding", ArrayType(CODING)),
    StructField("text", StringType()),
]))
