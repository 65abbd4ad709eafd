"""Resources (VARIANT) -> flat warehouse tables, one declarative spec per type.

A spec lists header columns (paths into the resource), the arrays to
explode, and the columns taken from each array element. ``flatten`` turns a
spec into one projection per level, so the whole thing is a chain of
``Generate``/``Project`` nodes inside one stage: no shuffle, no Python.

Grain ``line`` explodes every listed array (inner): a resource with an empty
or missing array yields no row, and several arrays give their cross product,
as the original tables do. Grain ``header`` keeps one row per resource and
takes element columns from the first element of each array.

The product of one resource's arrays can be far larger than the resource. ``flatten_split`` sends
resources whose product has more than ``PRODUCT_ROWS`` rows another way: their arrays are
cut into slices, each combination of slices is one small row that makes at most that many rows, and these
rows are dealt to all tasks before they are exploded. Other resources never leave their task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ADJUDICATION_DDL

# Fixed value: extension URL that marks a geolocation on an address.
GEOLOCATION_URL = "http://hl7.org/fhir/StructureDefinition/geolocation"

# Rows of one resource's product that one task makes at a time.
PRODUCT_ROWS = 1 << 16

ColumnSpec = tuple  # (name, path, type) or (name, callable(root) -> Column)


CODED = re.compile(r"^(\$\.(?:\w+\.)*\w+)(?:\[0\])?\.coding\[0\]\.(\w+)$")
TEXT = re.compile(r"^(\$\.(?:\w+\.)*\w+)(?:\[0\])?\.text$")


def either_shape(path: str) -> list[str]:
    """The paths at which a coded value may stand: producers write a concept, and its
    codings, as one object or as a list. Other paths have one shape."""
    if coded := CODED.match(path):
        shapes = [f"{coded[1]}{one}.coding{two}.{coded[2]}" for one in ("", "[0]") for two in ("[0]", "")]
    elif text := TEXT.match(path):
        shapes = [f"{text[1]}{one}.text" for one in ("", "[0]")]
    else:
        return [path]
    return sorted(shapes, key=lambda x: x != path)


def vget(root: Column, path: str, dtype: str = "string") -> Column:
    """Value at a JSON path of a VARIANT; NULL when missing. A coded value is found in either shape."""
    return F.coalesce(*[F.try_variant_get(root, x, dtype) for x in either_shape(path)])


def varray(root: Column, path: str) -> Column:
    """The array at a path; an object there counts as a list of one, and anything else as missing."""
    one = F.try_variant_get(root, path, "variant")
    return F.coalesce(F.try_variant_get(root, path, "array<variant>"),
                      F.when(F.schema_of_variant(one).startswith("OBJECT"), F.array(one)))


def raw_json(path: str) -> Callable[[Column], Column]:
    return lambda r: F.to_json(F.try_variant_get(r, path, "variant"))


def each(path: str, inner: str, dtype: str = "string") -> Callable[[Column], Column]:
    """``transform(path, x -> x.inner)``."""
    return lambda r: F.transform(varray(r, path), lambda x: vget(x, inner, dtype))


def first_where(path: str, field_path: str, value: str, inner: str,
                dtype: str = "string") -> Callable[[Column], Column]:
    """``filter(path, x -> x.field = value)[0].inner``."""
    def build(r: Column) -> Column:
        hit = F.get(F.filter(varray(r, path), lambda x: vget(x, field_path) == F.lit(value)), 0)
        return vget(hit, inner, dtype)
    return build


@dataclass(frozen=True)
class Spec:
    resource_type: str
    head: Sequence[ColumnSpec]
    arrays: Sequence[tuple[str, str]] = ()
    items: Mapping[str, Sequence[ColumnSpec]] = field(default_factory=dict)
    order: Sequence[str] | None = None

    def names(self) -> list[str]:
        if self.order:
            return list(self.order)
        out = [c[0] for c in self.head]
        for alias, _ in self.arrays:
            out += [c[0] for c in self.items.get(alias, ())]
        return out


def _column(root: Column, spec: ColumnSpec) -> Column:
    if len(spec) == 2:
        name, build = spec
        return build(root).alias(name)
    name, path, dtype = spec
    return vget(root, path, dtype).alias(name)


def explode_all(df: DataFrame, columns: Sequence[str], outer: bool = False) -> DataFrame:
    """Explode several array columns in turn: their cross product per row."""
    gen = F.explode_outer if outer else F.explode
    for c in columns:
        df = df.withColumn(c, gen(c))
    return df


def _explode_typed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``explode_all`` for arrays whose elements are never NULL. An inner ``explode`` makes the optimizer infer ``size(array) > 0`` and push it below the
    projection that builds the array, which then decodes every array twice; a filter on the exploded element stays above."""
    for c in columns:
        df = df.withColumn(c, F.explode_outer(c)).filter(F.col(c).isNotNull())
    return df


def _length(array: Column) -> Column:
    """Number of elements; an empty or missing array counts as one."""
    return F.greatest(F.coalesce(F.size(array), F.lit(0)), F.lit(1)).cast("long")


def is_wide(root: Column, spec: Spec, rows: int = PRODUCT_ROWS) -> Column:
    """Whether the product of a resource's arrays has more than ``rows`` rows; false for types with fewer than two arrays,
    whose rows are no more than their elements."""
    if len(spec.arrays) < 2:
        return F.lit(False)
    product = F.lit(1.0)
    for _, path in spec.arrays:
        # Only the number of elements is wanted: as flags they are not copied, and an object, a list of one, counts one as a missing array does.
        product = product * _length(F.try_variant_get(root, path, "array<boolean>"))
    return F.coalesce(product > rows, F.lit(False))


def _slices(array: Column, length: Column) -> Column:
    """An array of (place, slice); an empty or missing array is one slice."""
    starts = F.sequence(F.lit(1).cast("long"), _length(array), length)
    return F.transform(starts, lambda at: F.struct(at.alias("at"), F.slice(array, at.cast("int"), length.cast("int")).alias("part")))


def spread_products(df: DataFrame, columns: Sequence[str], rows: int = PRODUCT_ROWS) -> DataFrame:
    """Cuts array columns into slices so that each row's product has at most ``rows`` rows, one row for each combination of slices,
    and deals these rows to ``spark.sql.shuffle.partitions`` tasks. Exploding them gives the product of the
    whole arrays. Lengths are chosen from the last column on, so the first columns are cut first."""
    rest = F.lit(rows).cast("long")
    for c in reversed(columns):
        df = df.withColumn(f"__len_{c}", F.least(_length(F.col(c)), rest))
        rest = F.greatest(F.floor(rest / F.col(f"__len_{c}")), F.lit(1)).cast("long")
    for c in columns:
        df = df.withColumn(f"__cut_{c}", F.explode(_slices(F.col(c), F.col(f"__len_{c}")))).withColumn(c, F.col(f"__cut_{c}.part")) \
            .withColumn(f"__at_{c}", F.col(f"__cut_{c}.at")).drop(f"__cut_{c}", f"__len_{c}")
    # A stated number of partitions: adaptive execution would merge them by the bytes of the slices, not of their product.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = [f"__at_{c}" for c in columns]
    return df.repartition(tasks, *at, *[c for c in df.columns if c not in {*columns, *at}][:1]).drop(*at)


def _typed_items(root: Column, path: str, items: Sequence[ColumnSpec]) -> Column:
    """The array at ``path`` with each element decoded once into a typed struct."""
    if not items:
        return F.transform(varray(root, path), lambda x: F.lit(True))
    return F.transform(varray(root, path), lambda x: F.struct(*[_column(x, c) for c in items]))


def flatten(resources: DataFrame, spec: Spec, grain: str = "line", outer: bool = False,
            resource_col: str = "resource", keep: Sequence[str] = (), block_rows: int | None = None) -> DataFrame:
    """One flat table from one resource type; ``keep`` are further input columns, put last. With ``block_rows``, products
    are made in blocks of so many rows, spread over all tasks (a shuffle; see ``flatten_split``).

    Each array is first mapped to typed structs (``transform``), so an
    element is decoded once and the exploded rows carry compact values, not
    VARIANT copies.
    """
    root = F.col(resource_col)
    head = [_column(root, c) for c in spec.head]
    aliases = [a for a, _ in spec.arrays]
    arrays = [_typed_items(root, path, spec.items.get(alias, ())).alias(alias)
              for alias, path in spec.arrays]
    df = resources.select(*head, *arrays, *keep)
    if grain == "line":
        if block_rows and aliases:
            df = spread_products(df, aliases, block_rows)
        df = explode_all(df, aliases, outer=True) if outer else _explode_typed(df, aliases)
    elif grain == "header":
        for a in aliases:
            df = df.withColumn(a, F.get(F.col(a), 0))
    else:
        raise ValueError(f"unknown grain {grain!r}")
    cols = [F.col(c[0]) for c in spec.head]
    for alias in aliases:
        cols += [F.col(alias).getField(c[0]).alias(c[0]) for c in spec.items.get(alias, ())]
    return df.select(*cols, *keep).select(*spec.names(), *keep)


def flatten_split(resources: DataFrame, spec: Spec, grain: str = "line", outer: bool = False, keep: Sequence[str] = (),
                  rows: int = PRODUCT_ROWS, wide: Column | None = None) -> DataFrame:
    """The rows of ``flatten``; resources that are ``wide`` (by default: whose product has more than ``rows`` rows) are spread over tasks.

    The input is read twice, once for each kind, so it should be stored or shared; where ``wide`` is a partition column of a
    stored input, each resource is read once. Types with fewer than two arrays are flattened as they are.
    """
    if grain != "line" or len(spec.arrays) < 2:
        return flatten(resources, spec, grain, outer, keep=keep)
    wide = is_wide(F.col("resource"), spec, rows) if wide is None else wide
    return flatten(resources.filter(~wide), spec, grain, outer, keep=keep) \
        .unionByName(flatten(resources.filter(wide), spec, grain, outer, keep=keep, block_rows=rows))


S, D, B = "string", "double", "boolean"

PATIENT = Spec("Patient", head=[
    ("patient_id", "$.id", S),
    ("identifier_types", each("$.identifier", "$.type.coding[0].display")),
    ("name", raw_json("$.name")),
    ("gender", "$.gender", S),
    ("birth_date", "$.birthDate", S),
    ("city", "$.address[0].city", S),
    ("state", "$.address[0].state", S),
    ("country", "$.address[0].country", S),
    ("postal_code", "$.address[0].postalCode", S),
    ("latitude", first_where("$.address[0].extension", "$.url", GEOLOCATION_URL,
                             "$.extension[0].valueDecimal", D)),
    ("longitude", first_where("$.address[0].extension", "$.url", GEOLOCATION_URL,
                              "$.extension[1].valueDecimal", D)),
    ("phone", "$.telecom[0].value", S),
    ("marital_status", "$.maritalStatus.text", S),
    ("mothers_maiden_name", "$.extension[0].valueString", S),
    ("birthplace_city", "$.extension[1].valueAddress.city", S),
    ("birthplace_state", "$.extension[1].valueAddress.state", S),
    ("birthplace_country", "$.extension[1].valueAddress.country", S),
    ("disability_adjusted_life_years", "$.extension[2].valueDecimal", D),
    ("quality_adjusted_life_years", "$.extension[3].valueDecimal", D),
    ("multiple_birth", "$.multipleBirthBoolean", B),
    ("languages", each("$.communication", "$.language.text")),
])

# Patient columns read from ``extension[i]`` by position, with the field read.
PATIENT_EXTENSION_COLUMNS = {
    "mothers_maiden_name": (0, "$.valueString", S),
    "birthplace_city": (1, "$.valueAddress.city", S),
    "birthplace_state": (1, "$.valueAddress.state", S),
    "birthplace_country": (1, "$.valueAddress.country", S),
    "disability_adjusted_life_years": (2, "$.valueDecimal", D),
    "quality_adjusted_life_years": (3, "$.valueDecimal", D),
}


def patient_spec(by_url: Mapping[str, str] | None = None) -> Spec:
    """The patient spec; ``by_url`` maps extension columns to extension URLs.

    By default extensions are read by position, as the original does. With
    ``by_url``, a named column takes the first extension whose ``url``
    matches, so producers that order extensions differently still fill the
    right column.
    """
    if not by_url:
        return PATIENT
    head = []
    for spec in PATIENT.head:
        name = spec[0]
        if name in by_url and name in PATIENT_EXTENSION_COLUMNS:
            _, inner, dtype = PATIENT_EXTENSION_COLUMNS[name]
            head.append((name, first_where("$.extension", "$.url", by_url[name], inner, dtype)))
        else:
            head.append(spec)
    return Spec("Patient", head=head)


ENCOUNTER = Spec("Encounter", head=[
    ("encounter_id", "$.id", S),
    ("status", "$.status", S),
    ("class_code", "$.class.code", S),
    ("type_text", "$.type[0].text", S),
    ("start_time", "$.period.start", S),
    ("end_time", "$.period.end", S),
    ("patient_reference", "$.subject.reference", S),
    ("service_provider_id", "$.serviceProvider.reference", S),
    ("service_provider_display", "$.serviceProvider.display", S),
], arrays=[("participant", "$.participant")], items={"participant": [
    ("participant_individual_display", "$.individual.display", S),
    ("participant_individual_reference", "$.individual.reference", S),
    ("participant_period_start", "$.period.start", S),
    ("participant_period_end", "$.period.end", S),
    ("participant_type_code", "$.type[0].coding[0].code", S),
    ("participant_type_display", "$.type[0].coding[0].display", S),
]})

CONDITION = Spec("Condition", head=[
    ("condition_id", "$.id", S),
    ("clinical_status", "$.clinicalStatus.coding[0].code", S),
    ("verification_status", "$.verificationStatus.coding[0].code", S),
    ("condition_code_display", "$.code.text", S),
    ("patient_reference", "$.subject.reference", S),
    ("encounter_reference", "$.encounter.reference", S),
    ("onset_datetime", "$.onsetDateTime", S),
    ("abatement_datetime", "$.abatementDateTime", S),
    ("recorded_date", "$.recordedDate", S),
])

MEDICATION_REQUEST = Spec("MedicationRequest", head=[
    ("medication_request_id", "$.id", S),
    ("status", "$.status", S),
    ("intent", "$.intent", S),
    ("medication_display", "$.medicationCodeableConcept.coding[0].display", S),
    ("patient_reference", "$.subject.reference", S),
    ("requester_reference", "$.requester.reference", S),
    ("requester_display", "$.requester.display", S),
    ("encounter_reference", "$.encounter.reference", S),
    ("authored_on", "$.authoredOn", S),
], arrays=[("dosage", "$.dosageInstruction")], items={"dosage": [
    ("dosage_text", "$.text", S),
]})

CLAIM = Spec("Claim", head=[
    ("claim_id", "$.id", S),
    ("status", "$.status", S),
    ("type_code", "$.type.coding[0].code", S),
    ("use", "$.use", S),
    ("patient_reference", "$.patient.reference", S),
    ("patient_display", "$.patient.display", S),
    ("created_date", "$.created", S),
    ("billable_period_start", "$.billablePeriod.start", S),
    ("billable_period_end", "$.billablePeriod.end", S),
    ("provider_reference", "$.provider.reference", S),
    ("priority", "$.priority.coding[0].code", S),
    ("total_amount", "$.total.value", D),
    ("currency", "$.total.currency", S),
], arrays=[("supporting_info", "$.supportingInfo"), ("insurance", "$.insurance"),
           ("item", "$.item"), ("diagnosis", "$.diagnosis")], items={
    "supporting_info": [
        ("supporting_info_code", "$.category.coding[0].code", S),
        ("supporting_info_value_reference", "$.valueReference.reference", S),
    ],
    "insurance": [
        ("insurance_coverage_display", "$.coverage.display", S),
        ("insurance_focal", "$.focal", B),
    ],
    "item": [
        ("item_code", "$.productOrService.coding[0].code", S),
        ("item_description", "$.productOrService.coding[0].display", S),
        ("item_category", "$.category.coding[0].display", S),
        ("item_net_value", "$.net.value", D),
        ("item_net_currency", "$.net.currency", S),
        ("encounter_reference", "$.encounter[0].reference", S),
        ("location_description", "$.locationCodeableConcept.coding[0].display", S),
        ("service_period_start", "$.servicedPeriod.start", S),
        ("service_period_end", "$.servicedPeriod.end", S),
        ("adjudication", "$.adjudication", ADJUDICATION_DDL),
    ],
    "diagnosis": [
        ("diagnosis_reference", "$.diagnosisReference.reference", S),
    ],
}, order=[
    "claim_id", "status", "type_code", "use", "patient_reference", "patient_display",
    "created_date", "billable_period_start", "billable_period_end", "provider_reference",
    "priority", "supporting_info_code", "supporting_info_value_reference",
    "insurance_coverage_display", "insurance_focal", "total_amount", "currency",
    "diagnosis_reference", "item_code", "item_description", "item_category", "item_net_value",
    "item_net_currency", "encounter_reference", "location_description", "service_period_start",
    "service_period_end", "adjudication",
])

EXPLANATION_OF_BENEFIT = Spec("ExplanationOfBenefit", head=[
    ("eob_id", "$.id", S),
    ("identifier_claim_id", "$.identifier[0].value", S),
    ("identifier_claim_group", "$.identifier[1].value", S),
    ("status", "$.status", S),
    ("code", "$.type.coding[0].code", S),
    ("use", "$.use", S),
    ("patient_reference", "$.patient.reference", S),
    ("billable_period_start", "$.billablePeriod.start", S),
    ("billable_period_end", "$.billablePeriod.end", S),
    ("insurer_display", "$.insurer.display", S),
    ("provider_reference", "$.provider.reference", S),
    ("referral_reference", "$.referral.reference", S),
    ("claim_reference", "$.claim.reference", S),
    ("outcome", "$.outcome", S),
    # ``total`` is an array in this resource: an object path gives NULL, as in
    # the original tables; the first total is offered as an extra column.
    ("total_amount", "$.total.value", D),
    ("total_currency", "$.total.currency", S),
    ("total_first_amount", "$.total[0].amount.value", D),
    ("payment_amount", "$.payment.amount.value", D),
    ("payment_currency", "$.payment.amount.currency", S),
    ("created_date", "$.created", S),
], arrays=[("contained", "$.contained"), ("care_team", "$.careTeam"),
           ("insurance", "$.insurance"), ("item", "$.item")], items={
    "care_team": [
        ("care_team_provider_reference", "$.provider.reference", S),
        ("care_team_role", "$.role.coding[0].display", S),
    ],
    "insurance": [
        ("insurance_coverage_reference", "$.coverage.reference", S),
        ("insurance_coverage_display", "$.coverage.display", S),
        ("insurance_focal", "$.focal", B),
    ],
    "item": [
        ("item_category_display", "$.category.coding[0].display", S),
        ("item_service_code", "$.productOrService.coding[0].code", S),
        ("item_service_description", "$.productOrService.coding[0].display", S),
        ("item_net_value", "$.net.value", D),
        ("item_net_currency", "$.net.currency", S),
        ("location_description", "$.locationCodeableConcept.coding[0].display", S),
        ("service_period_start", "$.servicedPeriod.start", S),
        ("service_period_end", "$.servicedPeriod.end", S),
        ("adjudication", "$.adjudication", ADJUDICATION_DDL),
    ],
}, order=[
    "eob_id", "identifier_claim_id", "identifier_claim_group", "status", "code", "use",
    "patient_reference", "billable_period_start", "billable_period_end", "insurer_display",
    "provider_reference", "referral_reference", "claim_reference", "outcome",
    "care_team_provider_reference", "care_team_role", "insurance_coverage_reference",
    "insurance_coverage_display", "insurance_focal", "item_category_display", "item_service_code",
    "item_service_description", "item_net_value", "item_net_currency", "location_description",
    "service_period_start", "service_period_end", "adjudication", "total_amount", "total_currency",
    "payment_amount", "payment_currency", "created_date", "total_first_amount",
])

CAREPLAN = Spec("CarePlan", head=[
    ("careplan_id", "$.id", S),
    ("status", "$.status", S),
    ("intent", "$.intent", S),
    ("patient_reference", "$.subject.reference", S),
    ("encounter_reference", "$.encounter.reference", S),
    ("period_start", "$.period.start", S),
    ("period_end", "$.period.end", S),
    ("created_date", "$.created", S),
    ("addresses", each("$.addresses", "$.reference")),
    ("category_text", "$.category[0].text", S),
], arrays=[("care_team", "$.careTeam"), ("activity", "$.activity")], items={
    "care_team": [("care_team_reference", "$.reference", S)],
    "activity": [
        ("activity_display", "$.detail.code.coding[0].display", S),
        ("activity_code", "$.detail.code.coding[0].code", S),
        ("activity_status", "$.detail.status", S),
        ("activity_location", "$.detail.location.display", S),
    ],
}, order=[
    "careplan_id", "status", "intent", "patient_reference", "encounter_reference",
    "period_start", "period_end", "created_date", "care_team_reference", "activity_display",
    "activity_code", "activity_status", "activity_location", "addresses", "category_text",
])

CARETEAM = Spec("CareTeam", head=[
    ("care_team_id", "$.id", S),
    ("status", "$.status", S),
    ("subject_reference", "$.subject.reference", S),
    ("encounter_reference", "$.encounter.reference", S),
    ("period_start", "$.period.start", S),
    ("period_end", "$.period.end", S),
], arrays=[("participant", "$.participant"), ("organization", "$.managingOrganization")], items={
    "participant": [
        ("participant_role", "$.role[0].text", S),
        ("participant_reference", "$.member.reference", S),
        ("participant_display", "$.member.display", S),
    ],
    "organization": [("managing_organization", "$.display", S)],
}, order=[
    "care_team_id", "status", "subject_reference", "encounter_reference", "period_start",
    "period_end", "managing_organization", "participant_role", "participant_reference",
    "participant_display",
])

PROCEDURE = Spec("Procedure", head=[
    ("procedure_id", "$.id", S),
    ("status", "$.status", S),
    ("procedure_code_display", "$.code.coding[0].display", S),
    ("procedure_code", "$.code.coding[0].code", S),
    ("subject_reference", "$.subject.reference", S),
    ("performed_period_start", "$.performedPeriod.start", S),
    ("performed_period_end", "$.performedPeriod.end", S),
    ("encounter_reference", "$.encounter.reference", S),
], arrays=[("reason", "$.reasonReference")], items={"reason": [
    ("reason_reference", "$.reference", S),
    ("reason_reference_display", "$.display", S),
]})

DIAGNOSTIC_REPORT = Spec("DiagnosticReport", head=[
    ("diagnostic_report_id", "$.id", S),
    ("status", "$.status", S),
    ("code", "$.code.coding[0].display", S),
    ("code_system", "$.code.coding[0].code", S),
    ("subject_reference", "$.subject.reference", S),
    ("encounter_reference", "$.encounter.reference", S),
    ("effective_date_time", "$.effectiveDateTime", S),
    ("issued_date", "$.issued", S),
    ("category_display", "$.category[0].coding[0].display", S),
], arrays=[("result", "$.result")], items={"result": [
    ("result_display", "$.display", S),
]}, order=[
    "diagnostic_report_id", "status", "code", "code_system", "subject_reference",
    "encounter_reference", "effective_date_time", "issued_date", "result_display",
    "category_display",
])

IMMUNIZATION = Spec("Immunization", head=[
    ("immunization_id", "$.id", S),
    ("status", "$.status", S),
    ("vaccine_display", "$.vaccineCode.coding[0].display", S),
    ("vaccine_code", "$.vaccineCode.coding[0].code", S),
    ("patient_reference", "$.patient.reference", S),
    ("encounter_reference", "$.encounter.reference", S),
    ("primary_source", "$.primarySource", B),
    ("occurrence_date_time", "$.occurrenceDateTime", S),
])

OBSERVATION = Spec("Observation", head=[
    ("observation_id", "$.id", S),
    ("status", "$.status", S),
    ("observation_code_display", "$.code.coding[0].display", S),
    ("observation_code", "$.code.coding[0].code", S),
    ("subject_reference", "$.subject.reference", S),
    ("encounter_reference", "$.encounter.reference", S),
    ("effective_date_time", "$.effectiveDateTime", S),
    ("issued_date", "$.issued", S),
    ("value_quantity_value", "$.valueQuantity.value", D),
    ("value_quantity_unit", "$.valueQuantity.unit", S),
    ("category_display", "$.category[0].coding[0].display", S),
])

FLATTENERS: dict[str, Spec] = {s.resource_type: s for s in (
    PATIENT, ENCOUNTER, CONDITION, MEDICATION_REQUEST, CLAIM, EXPLANATION_OF_BENEFIT,
    CAREPLAN, CARETEAM, PROCEDURE, DIAGNOSTIC_REPORT, IMMUNIZATION, OBSERVATION)}
