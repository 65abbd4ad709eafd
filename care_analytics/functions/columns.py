"""Column -> Column helpers for cleaning clinical records.

Every function here returns a Catalyst expression: nothing runs until an
action, and everything stays inside whole-stage codegen (no Python UDFs).
Spark 4 runs with ANSI mode on, so every lookup that may miss uses the
NULL-returning variant (``get``, ``try_to_timestamp``, ``try_divide``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, TimestampNTZType

# ---------------------------------------------------------------------------
# Fixed values. These must equal the original pipeline's for equal results.
# ---------------------------------------------------------------------------

# Prefix carried by references between resources in a bundle.
REFERENCE_PREFIX = "urn:uuid:"

# Marital status: lower-cased, trimmed text -> label; anything else "Unknown".
MARITAL_STATUS_LABELS = {
    "m": "Married",
    "s": "Single",
    "never married": "Never Married",
}
MARITAL_STATUS_DEFAULT = "Unknown"

# Encounter status: raw value -> label; anything else "In-Progress".
ENCOUNTER_STATUS_LABELS = {"finished": "Completed"}
ENCOUNTER_STATUS_DEFAULT = "In-Progress"

# Encounter class code (HL7 ActEncounterCode) -> label; anything else "Unknown".
CLASS_CODE_LABELS = {
    "IMP": "Inpatient",
    "AMB": "Ambulatory",
    "EMER": "Emergency",
}
CLASS_CODE_DEFAULT = "Unknown"

# Benefit adjudication category, matched after lower-casing and trimming.
# The processing-indicator key keeps its capital "C" as in the original, so it
# never matches lower-cased text and those lines fall to "Unknown".
BENEFIT_CATEGORY_LABELS = {
    "line submitted charge amount": "Submitted Charge",
    "line beneficiary coinsurance amount": "Coinsurance Amount",
    "line allowed charge amount": "Allowed Charge",
    "line provider payment amount": "Provider Payment",
    "line beneficiary part b deductible amount": "Part B Deductible",
    "line processing indicator Code": "Processing Indicator",
}
BENEFIT_CATEGORY_DEFAULT = "Unknown"
# Categories left out of the benefit averages.
BENEFIT_CATEGORY_EXCLUDED = ("Unknown", "Part B Deductible")

# Care age bands: age < 18, < 40, < 65, everything else (NULL age included).
CARE_AGE_EDGES = (18, 40, 65)
CARE_AGE_LABELS = ("Child", "Young Adult", "Middle Aged", "Senior")

# Cost age ranges: age <= 18, <= 35, <= 50, <= 65, everything else.
COST_AGE_EDGES = (18, 35, 50, 65)
COST_AGE_LABELS = ("0-18", "19-35", "36-50", "51-65", "66+")

# Label used for a blank or missing service provider.
BLANK_PROVIDER_LABEL = "Others"

# Outlier limits, in minutes: 1440 = one day, 86400 = sixty days.
LONG_STAY_MINUTES = 1440
OUTLIER_STAY_MINUTES = 86400
INPATIENT_LABEL = "Inpatient"

# Patient flags for the feature table.
SENIOR_AGE = 65
RISK_STATES = ("CA", "NY")
RISK_HIGH = 0.8
RISK_LOW = 0.4
LABEL_AGE = 50
DAYS_PER_YEAR = 365.25
CHRONIC_PATTERN = "(?i)chronic"

# ---------------------------------------------------------------------------


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reference_id(c: Column | str, strict: bool = False) -> Column:
    """Strip the ``urn:uuid:`` prefix from a resource reference.

    ``strict=False`` removes every occurrence and keeps other text as is
    (an unprefixed id survives). ``strict=True`` takes the text after the
    first prefix and gives NULL when there is none.
    """
    c = col_(c)
    if strict:
        return F.get(F.split(c, REFERENCE_PREFIX), 1)
    return F.regexp_replace(c, REFERENCE_PREFIX, "")


def as_of_date(as_of: str | Column | None) -> Column:
    if as_of is None:
        return F.current_date()
    return F.to_date(F.lit(as_of)) if isinstance(as_of, str) else as_of


def age_calendar(birth: Column | str, as_of: str | Column | None = None) -> Column:
    """Age as the difference of calendar years."""
    return F.year(as_of_date(as_of)) - F.year(to_date_safe(birth))


def age_elapsed(birth: Column | str, as_of: str | Column | None = None) -> Column:
    """Age as whole elapsed years of 365.25 days."""
    days = F.datediff(as_of_date(as_of), to_date_safe(birth))
    return (days / F.lit(DAYS_PER_YEAR)).cast("int")


def to_date_safe(c: Column | str) -> Column:
    """Dates, timestamps and ISO strings to DATE; unparsable text to NULL."""
    c = col_(c)
    return c.try_cast("date")


def to_timestamp_safe(c: Column | str, dtype=None) -> Column:
    """ISO text (with or without offset) to TIMESTAMP; NULL when malformed.

    Columns that already hold timestamps are passed through unchanged.
    """
    c = col_(c)
    if dtype is not None and not isinstance(dtype, StringType):
        return c
    return F.try_to_timestamp(c)


def map_codes(c: Column | str, mapping: Mapping[str, str], default: str | None,
              normalise: bool = False) -> Column:
    """Map codes to labels with a ``CASE WHEN`` chain (Catalyst folds it)."""
    c = col_(c)
    if normalise:
        c = F.trim(F.lower(c))
    expr = None
    for code, label in mapping.items():
        expr = (F.when(c == code, label) if expr is None
                else expr.when(c == code, label))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default))


def band(c: Column | str, edges: Sequence[float], labels: Sequence[str],
         right_closed: bool = False) -> Column:
    """Bucket a number: ``labels[i]`` for values below (or up to) ``edges[i]``.

    The last label takes everything else, NULL included.
    """
    assert len(labels) == len(edges) + 1
    c = col_(c)
    expr = None
    for edge, label in zip(edges, labels):
        cond = (c <= edge) if right_closed else (c < edge)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr.otherwise(labels[-1])


def care_age_group(age: Column | str) -> Column:
    return band(age, CARE_AGE_EDGES, CARE_AGE_LABELS, right_closed=False)


def cost_age_range(age: Column | str) -> Column:
    return band(age, COST_AGE_EDGES, COST_AGE_LABELS, right_closed=True)


def blank_to(c: Column | str, default: str = BLANK_PROVIDER_LABEL) -> Column:
    """NULL or empty text -> ``default``."""
    c = col_(c)
    return F.when(c.isNull() | (c == ""), F.lit(default)).otherwise(c)


def epoch_seconds(c: Column | str, ntz: bool = False) -> Column:
    """Whole seconds since 1970-01-01, independent of the session time zone.

    TIMESTAMP values are instants (``unix_seconds``). TIMESTAMP_NTZ values
    are wall-clock readings and are counted from their calendar fields as if
    in UTC; a cast to TIMESTAMP would move readings that fall in a local
    daylight-saving gap.
    """
    c = col_(c)
    if not ntz:
        return F.unix_seconds(c)
    day = F.unix_date(F.to_date(c)).cast("long")
    return day * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def duration_seconds(start: Column | str, end: Column | str, ntz: bool = False) -> Column:
    """Whole seconds from ``start`` to ``end``: the difference of the two
    epoch readings, each truncated to the second."""
    return epoch_seconds(end, ntz) - epoch_seconds(start, ntz)


def duration_minutes(start: Column | str, end: Column | str, ntz: bool = False) -> Column:
    return duration_seconds(start, end, ntz) / F.lit(60.0)


def parse_json_array(c: Column | str, schema) -> Column:
    """JSON text that holds one object or a list of them -> array of structs.

    ``from_json`` with an array schema accepts both shapes, so fields that a
    producer writes either way need no second parser. Malformed text gives
    NULL.
    """
    return F.from_json(col_(c), schema)


def first(c: Column | str, field: str | None = None) -> Column:
    """First element of an array (NULL when empty or missing), then a field."""
    e = F.get(col_(c), 0)
    return e.getField(field) if field else e


def first_where(arr: Column | str, field: str, value) -> Column:
    """First element whose ``field`` equals ``value``."""
    return F.get(F.filter(col_(arr), lambda x: x.getField(field) == F.lit(value)), 0)


def patient_flags(age: Column | str, state: Column | str,
                  senior_age: int = SENIOR_AGE,
                  risk_states: Sequence[str] = RISK_STATES,
                  label_age: int = LABEL_AGE) -> dict[str, Column]:
    """Derived patient columns of the feature table."""
    age, state = col_(age), col_(state)
    return {
        "is_senior": F.when(age >= senior_age, 1).otherwise(0),
        "region_risk": F.when(state.isin(*risk_states), F.lit(RISK_HIGH)).otherwise(F.lit(RISK_LOW)),
        "label": F.when(age > label_age, 1).otherwise(0),
    }


def is_ntz(dtype) -> bool:
    return isinstance(dtype, TimestampNTZType)
