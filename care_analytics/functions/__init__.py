"""Column-level building blocks: cleaning expressions and exact aggregates."""

from .aggregates import (exact_sum, mean_integral, mean_money, money, ratio,
                         stddev_rounded, sum_double)
from .columns import (age_calendar, age_elapsed, band, blank_to, care_age_group,
                      cost_age_range, duration_minutes, duration_seconds, first,
                      first_where, map_codes, patient_flags, reference_id,
                      to_date_safe, to_timestamp_safe)

__all__ = [
    "age_calendar", "age_elapsed", "band", "blank_to", "care_age_group",
    "cost_age_range", "duration_minutes", "duration_seconds", "exact_sum",
    "first", "first_where", "map_codes", "mean_integral", "mean_money",
    "money", "patient_flags", "ratio", "reference_id", "stddev_rounded",
    "sum_double", "to_date_safe", "to_timestamp_safe",
]
