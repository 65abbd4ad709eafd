"""Filter interaction audit by relations of failing ids.

Method. Each filter stores one table of the ids that fail it. Starting from all ids, a left-anti join with the first
table keeps the survivors of the prefix and a left-semi join keeps what it removes; both parts go on to the next
table, so that after the last one every document carries the set of filters that it fails, from ten joins of ids. Documents
of one part with one such set and equal labels are a class (at most 2^filters times nine for each part), and classes have failing-id
tables of their own: for every set of earlier filters and every filter, left-anti joins of classes give the survivors of
the prefix, left-semi joins what the filter then removes and what an earlier filter had already removed, and sums of class sizes the
counts and the label losses. An order's step depends on the set of its earlier filters only, so the 120 orders of five
filters share 80 (set, filter) pairs. Nothing is collected; no join meets texts.

A failing-id row holds the id and the text's 64-bit hash, so that rows that share an id are told apart.

Defined cases: a null text counts as empty and a null part as the empty string; a document with a null id neither
repeats nor is repeated by another one, and has no labels; rows that repeat an id and text are documents of their own, and none
is a smaller id than the other; of several labels of an id the largest counts; null labels are not 1; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from care_analytics.llm.common import text_or_empty, written

SPACE = r"[\x20\x09-\x0D]+"
_TRIMMED = r"trim(BOTH concat(' ', char(9), char(10), char(11), char(12), char(13)) FROM __text)"
_WORDS = f"if({_TRIMMED} = '', array(), split({_TRIMMED}, r'{SPACE}', -1))"
# Failure conditions over __text and __words, in whole numbers.
CONDITIONS = {
    "A": "size(__words) < 50",
    "B": "100 * size(array_distinct(__words)) < 65 * size(__words)",
    "C": "100L * length(regexp_replace(__text, '[^A-Z]+', '')) > 5L * length(__text)",
    "D": "__text rlike '[#$%&*|]'",
}
REPEATS = "E"                                   # identical to the text of a smaller id


def failing(docs: DataFrame, conditions: Mapping[str, str] = CONDITIONS, repeats: str | None = REPEATS, id_col: str = "doc_id",
            text_col: str = "text", part_col: str = "source") -> tuple[DataFrame, dict[str, DataFrame]]:
    """(all rows as (__id, __key, __part), one written table (__fid, __fkey) for each filter by its letter)."""
    read = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("__part"))
    rows = read.select("__id", F.xxhash64("__text").alias("__key"), "__part", F.sha2("__text", 256).alias("__sha"), "__text", F.expr(_WORDS).alias("__words"))
    # One scan of the texts decides every condition; each table is then a filter of these verdicts.
    verdicts = written(rows.select("__id", "__key", "__part", "__sha", *[F.expr(c).alias(f"__is{f}") for f, c in conditions.items()]), "audit-verdicts")
    pair = (F.col("__id").alias("__fid"), F.col("__key").alias("__fkey"))
    tables = {f: written(verdicts.filter(f"__is{f}").select(*pair).distinct(), f"audit-{f}") for f in conditions}
    if repeats:
        known = verdicts.filter("__id is not null")
        first = known.groupBy(F.col("__sha").alias("__fsha")).agg(F.min("__id").alias("__min"), F.max("__id").alias("__max")).filter("__min < __max")
        later = known.join(first, F.col("__sha") == F.col("__fsha")).filter("__id > __min")
        tables[repeats] = written(later.select(*pair).distinct(), f"audit-{repeats}")
    return verdicts.select("__id", "__key", "__part"), tables


def classes(rows: DataFrame, tables: Mapping[str, DataFrame], labels: DataFrame) -> DataFrame:
    """(__part, __fails, __docs, __good, __toxic): documents counted by part and the set of filters that they fail."""
    by_id = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__lid")) \
        .agg(F.coalesce(F.max(F.col("quality").cast("int")) == 1, F.lit(False)).alias("__good"),
             F.coalesce(F.max(F.col("toxic").cast("int")) == 1, F.lit(False)).alias("__toxic"))
    at = rows.join(by_id, F.col("__id") == F.col("__lid"), "left") \
        .select("__id", "__key", "__part", F.coalesce("__good", F.lit(False)).alias("__good"), F.coalesce("__toxic", F.lit(False)).alias("__toxic"), F.lit("").alias("__fails"))
    for letter, table in tables.items():
        same = F.col("__id").eqNullSafe(F.col("__fid")) & (F.col("__key") == F.col("__fkey"))
        survive = at.join(table, same, "left_anti")
        removed = at.join(table, same, "left_semi").withColumn("__fails", F.concat("__fails", F.lit(letter)))
        at = written(survive.unionByName(removed), "audit-split")
    return at.groupBy("__part", "__fails").agg(F.count(F.lit(1)).alias("__docs"), F.count_if("__good").alias("__good"), F.count_if("__toxic").alias("__toxic"))


def orders(spark: SparkSession, letters: str) -> DataFrame:
    """(filter_order, step, __prefix, __filter): every step of every order; ``__prefix`` are the earlier filters, sorted."""
    rows = [("".join(o), i + 1, "".join(sorted(o[:i])), o[i]) for o in permutations(letters) for i in range(len(o))]
    return spark.createDataFrame(rows, "filter_order string, step int, __prefix string, __filter string")


def interactions(counted: DataFrame, letters: str) -> DataFrame:
    """(__part, __prefix, __filter, kept, removed, redundant, good_lost, toxic_lost): each filter after each set of earlier ones."""
    spark = counted.sparkSession
    sets = [""]
    for letter in letters:
        sets += [s + letter for s in sets]
    prefixes = spark.createDataFrame([(s, c) for s in sets for c in s], "__pset string, __pfilter string")       # members of each set
    steps = spark.createDataFrame([(s, c) for s in sets for c in letters if c not in s], "__prefix string, __filter string")
    every = F.array(*[F.lit(s) for s in sets])
    # Failing-id tables of the classes: which filter a class fails.
    fails = counted.select(F.col("__part").alias("__fpart"), F.col("__fails").alias("__ffails"), F.explode(F.array(*[F.lit(c) for c in letters])).alias("__ffilter")) \
        .filter("contains(__ffails, __ffilter)")
    gone = fails.join(F.broadcast(prefixes), F.col("__ffilter") == F.col("__pfilter")) \
        .select("__fpart", "__ffails", "__pset").distinct()
    of_prefix = (F.col("__part") == F.col("__fpart")) & (F.col("__fails") == F.col("__ffails")) & (F.col("__prefix") == F.col("__pset"))
    sized = counted.withColumn("__prefix", F.explode(every))
    left = written(sized.join(gone, of_prefix, "left_anti"), "audit-left")
    earlier = sized.join(gone, of_prefix, "left_semi")
    of_filter = (F.col("__part") == F.col("__fpart")) & (F.col("__fails") == F.col("__ffails")) & (F.col("__filter") == F.col("__ffilter"))
    left_steps, gone_steps = left.join(F.broadcast(steps), "__prefix"), earlier.join(F.broadcast(steps), "__prefix")
    none = F.lit(0).cast("long")
    keep = left_steps.join(fails, of_filter, "left_anti").select("__part", "__prefix", "__filter", F.col("__docs").alias("kept"), none.alias("removed"), none.alias("redundant"), none.alias("good_lost"), none.alias("toxic_lost"))
    take = left_steps.join(fails, of_filter, "left_semi").select("__part", "__prefix", "__filter", none.alias("kept"), F.col("__docs").alias("removed"), none.alias("redundant"), F.col("__good").alias("good_lost"), F.col("__toxic").alias("toxic_lost"))
    again = gone_steps.join(fails, of_filter, "left_semi").select("__part", "__prefix", "__filter", none.alias("kept"), none.alias("removed"), F.col("__docs").alias("redundant"), none.alias("good_lost"), none.alias("toxic_lost"))
    # Every part has a row for every step, zeros included.
    whole = counted.select("__part").distinct().withColumn("__prefix", F.explode(every)).join(F.broadcast(steps), "__prefix") \
        .select("__part", "__prefix", "__filter", *[none.alias(c) for c in ("kept", "removed", "redundant", "good_lost", "toxic_lost")])
    return reduce(DataFrame.unionByName, [keep, take, again, whole]).groupBy("__part", "__prefix", "__filter") \
        .agg(*[F.sum(c).alias(c) for c in ("kept", "removed", "redundant", "good_lost", "toxic_lost")])


def audit(docs: DataFrame, labels: DataFrame, conditions: Mapping[str, str] = CONDITIONS, repeats: str | None = REPEATS,
          id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step: (part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley)."""
    spark = docs.sparkSession
    rows, tables = failing(docs, conditions, repeats, id_col, text_col, part_col)
    letters = "".join(tables)
    counted = written(classes(rows, tables, labels), "audit-classes")
    pairs = written(interactions(counted, letters), "audit-pairs")
    order = orders(spark, letters)
    uses = order.groupBy(F.col("__prefix").alias("__up"), F.col("__filter").alias("__uf")).agg(F.count(F.lit(1)).alias("__uses"))
    # What a filter alone removes after all the others, and its removals over all orders.
    whole = pairs.join(F.broadcast(uses), (F.col("__prefix") == F.col("__up")) & (F.col("__filter") == F.col("__uf"))) \
        .groupBy(F.col("__part").alias("__wpart"), F.col("__filter").alias("__wfilter")) \
        .agg(F.sum(F.when(F.length("__prefix") == len(letters) - 1, F.col("removed")).otherwise(F.lit(0))).cast("long").alias("unique_fails"),
             F.sum(F.col("removed") * F.col("__uses")).alias("shapley"))
    return pairs.join(F.broadcast(order), ["__prefix", "__filter"]) \
        .join(whole, (F.col("__part") == F.col("__wpart")) & (F.col("__filter") == F.col("__wfilter"))) \
        .select(F.col("__part").alias("part"), "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
