"""Aggregates over many-to-many joins without building the join.

The original analyses aggregate after joins that multiply rows: every claim
of a patient meets every encounter of that patient; every benefit line meets
every header row of its EOB and every encounter of its patient. The product
grows with (rows per key)^2, which at warehouse scale is the dominant cost
and, for a hot key, one task holding a large share of all pairs.

Each aggregate here gives the same numbers from small sides instead:
pre-aggregate each input per join key (map-side partial aggregation makes a
hot key one row per partition before any shuffle), join the per-key
summaries, and weight each summary by the number of partners it would have
met. Sums stay exact (DECIMAL), so the result equals the naive join
bit for bit; ``method="join"`` runs the naive join for comparison.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import exact_sum, money, ratio, to_double



def _weighted(c: Column, w: Column) -> Column:
    return c * w.cast("decimal(20,0)")


def claim_encounter_cost(claims: DataFrame, encounters: DataFrame, group: str,
                         key: str = "patient_id", amount: str = "total_amount",
                         post: Callable[[Column], Column] | None = None,
                         method: str = "weighted") -> DataFrame:
    """Cost statistics of ``claims LEFT JOIN encounters USING (key)`` by ``group``.

    ``group`` is an encounter column; ``post`` maps it after the join (claims
    without an encounter carry NULL there). Output: ``group``, ``total_cost``,
    ``avg_cost``, ``num_encounters`` (non-NULL amounts, as ``count(amount)``).
    """
    post = post or (lambda c: c)
    if method == "join":
        j = claims.select(key, amount).join(encounters.select(key, group), key, "left")
        return (j.groupBy(post(F.col(group)).alias(group))
                 .agg(exact_sum(amount).alias("_s"), F.count(amount).alias("_n"))
                 .select(group, to_double(F.col("_s")).alias("total_cost"),
                         ratio(F.col("_s"), F.col("_n")).alias("avg_cost"),
                         F.col("_n").alias("num_encounters")))
    per_patient = claims.groupBy(key).agg(exact_sum(amount).alias("_s"), F.count(amount).alias("_n"))
    per_group = encounters.groupBy(key, group).agg(F.count(F.lit(1)).alias("_w"))
    j = per_patient.join(per_group, key, "left")
    w = F.coalesce(F.col("_w"), F.lit(1).cast("bigint"))
    return (j.groupBy(post(F.col(group)).alias(group))
             .agg(F.sum(_weighted(F.col("_s"), w)).alias("_s"),
                  F.sum(F.col("_n") * w).alias("_n"))
             .select(group, to_double(F.col("_s")).alias("total_cost"),
                     ratio(F.col("_s"), F.col("_n")).alias("avg_cost"),
                     F.col("_n").alias("num_encounters")))


def procedure_claim_cost(procedures: DataFrame, encounters: DataFrame, claims: DataFrame,
                         group: str = "procedure_code_display", enc_key: str = "encounter_id",
                         key: str = "patient_id", amount: str = "total_amount",
                         method: str = "weighted") -> DataFrame:
    """Cost by procedure over ``procedures LEFT JOIN (claims LEFT JOIN encounters)``.

    Output: ``group``, ``total_cost``, ``avg_cost``, ``frequency``
    (``count(group)`` over the joined rows).
    """
    if method == "join":
        ce = claims.select(key, amount).join(encounters.select(key, enc_key), key, "left")
        j = procedures.select(enc_key, group).join(ce, enc_key, "left")
        return (j.groupBy(group)
                 .agg(exact_sum(amount).alias("_s"), F.count(amount).alias("_n"),
                      F.count(group).alias("frequency"))
                 .select(group, to_double(F.col("_s")).alias("total_cost"),
                         ratio(F.col("_s"), F.col("_n")).alias("avg_cost"), "frequency"))
    per_patient = claims.groupBy(key).agg(exact_sum(amount).alias("_s"), F.count(amount).alias("_n"),
                                          F.count(F.lit(1)).alias("_c"))
    enc_rows = encounters.groupBy(enc_key, key).agg(F.count(F.lit(1)).alias("_r"))
    r = F.col("_r")
    per_encounter = (enc_rows.join(per_patient, key)
                     .groupBy(enc_key)
                     .agg(F.sum(_weighted(F.col("_s"), r)).alias("_ws"),
                          F.sum(F.col("_n") * r).alias("_wn"),
                          F.sum(F.col("_c") * r).alias("_wc")))
    per_proc = procedures.groupBy(enc_key, group).agg(F.count(F.lit(1)).alias("_k"))
    j = per_proc.join(per_encounter, enc_key, "left")
    k = F.col("_k")
    matched = F.col("_wc").isNotNull()
    rows = F.when(matched, k * F.col("_wc")).otherwise(k)
    return (j.groupBy(group)
             .agg(F.sum(_weighted(F.col("_ws"), k)).alias("_s"),
                  F.sum(F.coalesce(F.col("_wn"), F.lit(0)) * k).alias("_n"),
                  F.sum(rows).alias("_rows"))
             .select(group, to_double(F.col("_s")).alias("total_cost"),
                     ratio(F.col("_s"), F.col("_n")).alias("avg_cost"),
                     F.when(F.col(group).isNull(), F.lit(0).cast("bigint"))
                      .otherwise(F.col("_rows")).alias("frequency")))


def weighted_benefit_mean(lines: DataFrame, eob_rows: DataFrame, demographics: DataFrame,
                          keys: Sequence[str], value: str = "value",
                          category: str = "category_display", eob_key: str = "eob_id",
                          patient_key: str = "patient_reference",
                          out: str = "avg_value", method: str = "weighted") -> DataFrame:
    """Mean benefit value by ``keys`` over lines x EOB rows x patient encounters.

    ``lines`` (``eob_key``, ``patient_key``, ``category``, ``value``) meet the
    EOB table on ``eob_key`` and the demographic rows (one per encounter) on
    ``patient_key``, both inner joins as in the original. ``keys`` may name
    ``category`` and demographic columns.
    """
    demo_cols = [c for c in keys if c != category]
    if method == "join":
        j = (lines.select(eob_key, patient_key, category, value)
             .join(eob_rows.select(eob_key), eob_key)
             .join(demographics.select(patient_key, *demo_cols), patient_key))
        return (j.groupBy(*keys).agg(exact_sum(value).alias("_s"), F.count(value).alias("_n"))
                 .select(*keys, ratio(F.col("_s"), F.col("_n")).alias(out)))
    per_line = (lines.groupBy(eob_key, patient_key, category)
                .agg(F.sum(money(value)).alias("_s"), F.count(value).alias("_n")))
    per_eob = eob_rows.groupBy(eob_key).agg(F.count(F.lit(1)).alias("_r"))
    r = F.col("_r")
    per_patient = (per_line.join(per_eob, eob_key)
                   .groupBy(patient_key, category)
                   .agg(F.sum(_weighted(F.col("_s"), r)).alias("_s"),
                        F.sum(F.col("_n") * r).alias("_n")))
    return weighted_group_mean(per_patient, demographics, keys, category=category,
                               patient_key=patient_key, out=out)


def benefit_line_sums(eob: DataFrame, label: Callable[[Column], Column],
                      excluded: Sequence[str] = (), strip: Callable[[Column], Column] | None = None,
                      eob_key: str = "eob_id", patient_key: str = "patient_reference",
                      adjudication: str = "adjudication") -> DataFrame:
    """Per (patient, category): value sum and count over lines x EOB rows, in one pass.

    Equivalent to joining the exploded adjudication lines back to the EOB
    table on ``eob_key`` (each line meets every row of its EOB), without
    reading the EOB table twice. ``posexplode_outer`` gives every EOB row
    either its lines (positions 0..n-1) or one empty line, so "position 0 or
    none" marks exactly one output per EOB row; summed over a window on the
    EOB id, the marks are the row count that weights the line sums. The
    window runs over rows already reduced to one per (EOB, category).
    """
    strip = strip or (lambda c: c)
    x = eob.select(F.col(eob_key), strip(F.col(patient_key)).alias(patient_key),
                   F.posexplode_outer(adjudication).alias("_pos", "_a"))
    first = F.col("_pos").isNull() | (F.col("_pos") == 0)
    lab = label(F.get(F.col("_a.category.coding"), 0).getField("display"))
    x = (x.select(eob_key, patient_key, first.alias("_first"), lab.alias("_label"),
                  F.col("_a.amount.value").alias("_value"))
         .filter(F.col("_first") | ~F.col("_label").isin(*excluded)))
    per_eob_label = x.groupBy(eob_key, patient_key, "_label").agg(
        F.sum(money("_value")).alias("_s"), F.count("_value").alias("_n"),
        F.count_if("_first").alias("_m"))
    rows = F.sum("_m").over(Window.partitionBy(eob_key))
    weighted = (per_eob_label.withColumn("_r", rows)
                .filter(~F.col("_label").isin(*excluded))
                .select(patient_key, F.col("_label").alias("category_display"),
                        _weighted(F.col("_s"), F.col("_r")).alias("_s"),
                        (F.col("_n") * F.col("_r")).alias("_n")))
    return weighted.groupBy(patient_key, "category_display").agg(
        F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))


def weighted_group_mean(per_patient: DataFrame, demographics: DataFrame, keys: Sequence[str],
                        category: str = "category_display", patient_key: str = "patient_reference",
                        out: str = "avg_value") -> DataFrame:
    """Weight per-(patient, category) sums by each patient's demographic rows. ``demographics`` has one row per
    kept encounter, or a count of them in ``_w``."""
    return weighted_group_sums(per_patient, demographics, keys, category, patient_key) \
        .select(*keys, ratio(F.col("_s"), F.col("_n")).alias(out))


def weighted_mean() -> Column:
    """The mean over groups of rows (_s, _n)."""
    return ratio(F.sum("_s"), F.sum("_n"))


def weighted_group_sums(per_patient: DataFrame, demographics: DataFrame, keys: Sequence[str],
                        category: str = "category_display", patient_key: str = "patient_reference") -> DataFrame:
    """(keys, _s, _n): the sums and counts whose ratio is the mean of ``weighted_group_mean``."""
    demo_cols = [c for c in keys if c != category]
    weight = F.sum("_w") if "_w" in demographics.columns else F.count(F.lit(1))
    per_demo = demographics.groupBy(patient_key, *demo_cols).agg(weight.alias("_w"))
    w = F.col("_w")
    return (per_patient.join(per_demo, patient_key)
            .groupBy(*keys)
            .agg(F.sum(_weighted(F.col("_s"), w)).alias("_s"), F.sum(F.col("_n") * w).alias("_n")))
