"""Role views: the driver's star-schema tables read as clinical tables.

The test data is a TPC-H-like schema plus an ``events`` table. Each view
below derives one clinical table from it, row for row, with built-in column
expressions only. The only selection is the role itself (events of a type
stand for one resource type); no key is sampled and no row is capped. Work
grows linearly with the input tables; the only joins are key lookups.

| view          | from                          | grain            |
| ------------- | ----------------------------- | ---------------- |
| patient       | customer + nation             | customer         |
| encounter     | orders                        | order            |
| claim         | orders                        | order            |
| procedure     | lineitem + orders + part      | line             |
| eob           | lineitem + orders             | line             |
| condition     | events (error)                | event            |
| observation   | events (click, purchase)      | event            |
| immunization  | events (signup)               | event            |
| diagnostic    | events (view)                 | event            |

The same views are written in SQL for the DuckDB oracle (``oracle.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

# Fixed values of the role mapping (shared with the SQL in oracle.py).
BIRTH_EPOCH = "1930-01-01"
# Adjudication categories attached to every benefit line, in this order.
BENEFIT_CATEGORIES = (
    "Line Submitted Charge Amount",
    "Line Allowed Charge Amount",
    " line beneficiary coinsurance amount",
    "Line Beneficiary Part B Deductible Amount",
    "Line Processing Indicator Code",
)


def gender_role(key: Column) -> Column:
    """Gender of a customer: every administrative value occurs, and NULL."""
    return (F.when(key % 41 == 7, "other").when(key % 43 == 9, "unknown").when(key % 47 == 5, F.lit(None))
            .when(key % 2 == 0, "male").otherwise("female"))


class DriverTables:
    """Lazy access to the driver's Parquet tables in one directory."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")

    # -- role views -------------------------------------------------------

    def patient(self) -> DataFrame:
        c = self.table("customer")
        n = self.table("nation")
        k = F.col("c_custkey")
        birth = F.date_add(F.lit(BIRTH_EPOCH).cast("date"), ((k * 7919) % 33000).cast("int"))
        return (c.join(n, c.c_nationkey == n.n_nationkey)
                .select(
                    _id("p", k).alias("patient_id"),
                    gender_role(k).alias("gender"),
                    birth.cast("string").alias("birth_date"),
                    F.col("c_mktsegment").alias("city"),
                    F.col("n_name").alias("state"),
                    _id("N", F.col("c_nationkey")).alias("postal_code"),
                    F.when(k % 4 == 0, " M ").when(k % 4 == 1, "S")
                     .when(k % 4 == 2, "Never Married").alias("marital_status"),
                    (F.col("c_acctbal") / F.lit(1000.0)).alias("disability_adjusted_life_years"),
                    (F.col("c_acctbal") / F.lit(500.0)).alias("quality_adjusted_life_years"),
                ))

    def encounter(self) -> DataFrame:
        o = self.table("orders")
        k = F.col("o_orderkey")
        prio = F.substring("o_orderpriority", 1, 1)
        return o.select(
            _id("e", k).alias("encounter_id"),
            F.when(F.col("o_orderstatus") == "F", "finished").otherwise("in-progress").alias("status"),
            F.when(prio == "1", "EMER").when(prio == "2", "IMP").when(prio == "3", "AMB")
             .when(prio == "4", "HH").alias("class_code"),
            F.col("o_orderpriority").alias("type_text"),
            F.when(k % 40 == 0, F.lit(None)).otherwise(F.col("o_orderdate")).alias("start_time"),
            F.timestamp_add("MINUTE", (k * 37) % 100000, F.col("o_orderdate")).alias("end_time"),
            _ref("p", F.col("o_custkey")).alias("patient_reference"),
            _id("org", k % 7).alias("service_provider_id"),
            F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, "")
             .otherwise(_id("Clinic ", k % 7)).alias("service_provider_display"),
        )

    def claim(self) -> DataFrame:
        o = self.table("orders")
        k = F.col("o_orderkey")
        return o.select(
            _id("c", k).alias("claim_id"),
            F.when(k % 50 == 0, F.lit(None)).otherwise(_ref("p", F.col("o_custkey"))).alias("patient_reference"),
            F.col("o_totalprice").alias("total_amount"),
            F.lit("USD").alias("currency"),
            _id("Plan ", F.col("o_orderstatus")).alias("insurance_coverage_display"),
            F.col("o_orderdate").alias("created_date"),
        )

    def procedure(self) -> DataFrame:
        """One row per line. Subject and display are lookups: left joins
        against sides made unique on their key, which the optimizer drops
        entirely from queries that read neither column."""
        li = self.table("lineitem")
        o = self.table("orders").select("o_orderkey", "o_custkey").dropDuplicates(["o_orderkey"])
        p = self.table("part").select("p_partkey", "p_name").dropDuplicates(["p_partkey"])
        return (li.join(o, li.l_orderkey == o.o_orderkey, "left")
                .join(p, li.l_partkey == p.p_partkey, "left")
                .select(
                    F.concat(F.lit("x"), F.col("l_orderkey").cast("string"), F.lit("-"),
                             F.col("l_linenumber").cast("string")).alias("procedure_id"),
                    _ref("p", F.col("o_custkey")).alias("subject_reference"),
                    _ref("e", F.col("l_orderkey")).alias("encounter_reference"),
                    F.col("p_name").alias("procedure_code_display"),
                    F.col("l_partkey").cast("string").alias("procedure_code"),
                ))

    def eob(self) -> DataFrame:
        """Explanation-of-benefit rows, one per line, each with its adjudications."""
        li = self.table("lineitem")
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_totalprice",
                                        "o_orderdate", "o_orderstatus")
        price, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
        values = [price, price * (F.lit(1) - disc), price * tax, F.lit(0.0), F.lit(None).cast("double")]
        adjudication = F.array(*[
            F.struct(
                F.struct(v.alias("value"), F.lit("USD").alias("currency")).alias("amount"),
                F.struct(F.array(F.struct(
                    F.lit("adjudication").alias("system"),
                    F.lit(str(i)).alias("code"),
                    F.lit(label).alias("display"))).alias("coding")).alias("category"),
            )
            for i, (v, label) in enumerate(zip(values, BENEFIT_CATEGORIES))
        ])
        return (li.join(o, li.l_orderkey == o.o_orderkey)
                .select(
                    _id("b", F.col("l_orderkey")).alias("eob_id"),
                    _ref("p", F.col("o_custkey")).alias("patient_reference"),
                    F.col("l_linenumber").alias("line"),
                    _id("Plan ", F.col("o_orderstatus")).alias("insurance_coverage_display"),
                    F.col("o_orderdate").alias("billable_period_start"),
                    F.col("o_totalprice").alias("total_amount"),
                    (price * (F.lit(1) - disc)).alias("payment_amount"),
                    adjudication.alias("adjudication"),
                ))

    def _events(self, types) -> DataFrame:
        return self.table("events").filter(F.col("event_type").isin(*types))

    def condition(self) -> DataFrame:
        v = F.col("value")
        return self._events(["error"]).select(
            _id("k", F.col("event_id")).alias("condition_id"),
            _ref("p", F.col("user_id")).alias("patient_reference"),
            F.when(v > 100, "Chronic sinusitis").when(v > 50, "ACUTE ON CHRONIC pain")
             .otherwise("Sprain").alias("condition_code_display"),
            F.col("ts").alias("onset_datetime"),
        )

    def observation(self) -> DataFrame:
        return self._events(["click", "purchase"]).select(
            _id("o", F.col("event_id")).alias("observation_id"),
            _ref("p", F.col("user_id")).alias("subject_reference"),
            F.col("event_type").alias("observation_code_display"),
            F.col("ts").alias("effective_date_time"),
            F.col("value").alias("value_quantity_value"),
            F.col("props").alias("payload"),
        )

    def immunization(self) -> DataFrame:
        return self._events(["signup"]).select(
            _id("i", F.col("event_id")).alias("immunization_id"),
            _ref("p", F.col("user_id")).alias("patient_reference"),
            F.col("ts").alias("occurrence_date_time"),
        )

    def diagnostic_report(self) -> DataFrame:
        return self._events(["view"]).select(
            _id("d", F.col("event_id")).alias("diagnostic_report_id"),
            _ref("p", F.col("user_id")).alias("subject_reference"),
            F.col("ts").alias("effective_date_time"),
        )


def _id(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), c.cast("string"))


def _ref(prefix: str, c: Column) -> Column:
    return F.concat(F.lit("urn:uuid:" + prefix), c.cast("string"))
