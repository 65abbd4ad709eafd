"""Benchmark: headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR.

Each query runs to completion through the ``noop`` sink (all rows computed,
nothing collected): once untimed, to warm up code generation and the JIT,
then three times; the median counts. Prints one JSON line. Bundle queries read an
NDJSON fixture that is written once, outside the timing. The naive fan-out joins
are timed once, for their length (``*_naive``, not in the total), to show what the
weighted rewrites save.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from care_analytics.session import local_session  # noqa: E402

HEADLINE = [
    "duration_by_age_group",
    "pivot_class_age_duration",
    "benefit_by_all_groups",
    "pivot_benefit_groups",
    "cost_by_encounter_type",
    "cost_by_provider",
    "cost_by_procedure",
    "topk_cost_encounters",
    "cost_share_by_gender",
    "build_patient_features",
    "flatten_claim",
    "flatten_explanation_of_benefit",
    "demux_resource_counts",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", "16")),
                          app="care_analytics_bench")
    from care_analytics.plans import cost, disparities
    from care_analytics.operators.flatten import FLATTENERS, flatten
    from care_analytics.sources.bundles import bundle_entries, read_bundles, resource_counts, resources
    from driver_queries import QUERIES
    from driver_queries.core import cost_inputs, encounter_patients_kept
    from driver_queries.resources import RoleResources
    from driver_queries.roles import DriverTables
    from pyspark.sql import functions as F

    run(spark.read.parquet(f"{sf_dir}/orders.parquet"))  # warm-up: JVM, codegen caches

    def timed(build, runs: int = 3) -> float:
        if runs > 1:
            run(build())                  # warm-up
        times = []
        for _ in range(runs):
            t0 = time.perf_counter()
            run(build())
            times.append(time.perf_counter() - t0)
        return round(statistics.median(times), 3)

    fixture = f"{tempfile.mkdtemp(prefix='care-bench-')}/bundles"
    RoleResources(DriverTables(spark, sf_dir)).bundles().select(F.to_json(F.struct("entry")).alias("value")) \
        .write.option("compression", "none").text(fixture)

    def entries():
        return bundle_entries(read_bundles(spark, fixture, ndjson=True))

    def flat(kind):
        return flatten(resources(entries(), kind), FLATTENERS[kind])

    from_disk = {"flatten_claim": lambda: flat("Claim"), "flatten_explanation_of_benefit": lambda: flat("ExplanationOfBenefit"),
                 "demux_resource_counts": lambda: resource_counts(entries())}
    times = {name: timed(from_disk.get(name) or (lambda name=name: QUERIES[name](spark, sf_dir))) for name in HEADLINE}

    t = DriverTables(spark, sf_dir)
    claims, encounters, _, procedures = cost_inputs(t)
    naive = {
        "cost_by_procedure_naive": lambda: cost.cost_by_procedure(procedures, claims, encounters,
                                                                  method="join"),
        "benefit_by_all_groups_naive": lambda: disparities.benefit_by(
            t.eob(), encounter_patients_kept(t),
            ["category_display", "gender", "age_group", "marital_status"], method="join"),
    }
    extra = {name: timed(build, runs=1) for name, build in naive.items()}

    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec",
                      "queries": {**times, **extra}, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
