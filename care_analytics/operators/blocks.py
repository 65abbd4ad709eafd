"""Equi-joins whose rows are wanted, with keys that hold a large share of both sides.

A hash join sends all rows of a key to one task. Here a count of each side finds the heavy keys first. Rows of a heavy key are
cut into blocks on both sides (by hash of the row); each left block meets each right block, as the join's key is (key, left block,
right block), so no task holds more than a block of either side. Rows of other keys have block 0 on both sides and are not
repeated. Each side is computed once for the join, however it was made, and once for its counts unless the caller knows them. In a
left join, rows whose key is NULL are dealt by hash of the row, as they have nothing to meet. The result is that of the plain join.

The heavy keys are broadcast: a key is heavy when it holds more than ``block_rows`` rows and more than a 10,000th of its side, so
there are fewer than 20,000.

``copies`` and ``repeated`` keep equal rows of one side as one row with their number until after a join, so that only rows of the
other side are shuffled, and the rows of the product are made where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 100_000
MOST_HEAVY = 10_000         # heavy keys of one side at most
NULL_BLOCKS = 10_000        # blocks of the rows whose key is NULL
MOST_COPIES = BLOCK_ROWS // 10   # copies that one row of ``copies`` stands for


def _heavy(counts: DataFrame, block_rows: int) -> DataFrame:
    """(key, rows) of the keys of one side that are heavy."""
    return counts.filter((F.col("__rows") > block_rows) & (F.col("__rows") * MOST_HEAVY > counts.agg(F.sum("__rows")).scalar()))


def key_counts(df: DataFrame, key: str, rows: str | None = None) -> DataFrame:
    """(__key, __rows): the rows of each key, or the sum of ``rows`` over them."""
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg((F.count(F.lit(1)) if rows is None else F.sum(rows)).alias("__rows"))


def heavy_keys(left: DataFrame, right: DataFrame, key: str, block_rows: int = BLOCK_ROWS,
               counts: tuple[DataFrame | None, DataFrame | None] = (None, None)) -> DataFrame:
    """(__key, __lb, __rb): keys that are heavy on either side, with the number of blocks on each."""
    def blocks(c: str) -> Column:
        return F.coalesce(F.ceil(F.col(c) / block_rows), F.lit(1)).cast("int")
    a, b = (_heavy(key_counts(df, key) if known is None else known, block_rows) for df, known in zip((left, right), counts))
    a, b = a.withColumnsRenamed({"__key": "__lkey", "__rows": "__lrows"}), b.withColumnsRenamed({"__key": "__rkey", "__rows": "__rrows"})
    return a.join(b, F.col("__lkey") == F.col("__rkey"), "full") \
        .select(F.coalesce("__lkey", "__rkey").alias("__key"), blocks("__lrows").alias("__lb"), blocks("__rrows").alias("__rb"))


def block_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", block_rows: int = BLOCK_ROWS,
               counts: tuple[DataFrame | None, DataFrame | None] = (None, None)) -> DataFrame:
    """``left.join(right, key, how)`` for ``how`` inner or left, in blocks where a key is heavy: the key, the columns of
    ``left``, the columns of ``right``. ``counts`` may give ``key_counts`` of a side whose own would be dear; they need not be
    exact, but those of the right side of a left join must be left out."""
    if how not in ("inner", "left"):
        raise ValueError(f"block_join does not do {how} joins")
    if how == "left" and counts[1] is not None:
        raise ValueError("the right side of a left join is counted here")
    mine, theirs = [c for c in left.columns if c != key], [c for c in right.columns if c != key]
    heavy = heavy_keys(left, right, key, block_rows, counts)

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        """Rows with their own block, once for each block of the other side."""
        row = F.xxhash64(*df.columns)
        block = F.when(F.col(key).isNull(), F.pmod(row, F.lit(NULL_BLOCKS))) \
            .when(F.col(f"__{own}b") > 1, F.pmod(row, F.col(f"__{own}b"))).otherwise(0).cast("int")
        return df.join(F.broadcast(heavy), F.col(key) == F.col("__key"), "left").drop("__key").withColumn(f"__{own}", block) \
            .withColumn(f"__{other}", F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"__{other}b"), F.lit(1)) - 1)))

    partners = dealt(right.filter(F.col(key).isNotNull()), "r", "l").drop("__lb", "__rb")
    if how == "inner":
        left = left.filter(F.col(key).isNotNull())
    else:
        partners = partners.withColumn("__met", F.lit(True))
    out = dealt(left, "l", "r").join(partners, [key, "__l", "__r"], how)
    if how == "left":
        # A key in several right blocks has partners; a block of them that is empty, or left alone, is no missing partner.
        out = out.filter(F.col("__met").isNotNull() | (F.coalesce(F.col("__rb"), F.lit(1)) == 1))
    return out.select(key, *mine, *theirs)


def copies(df: DataFrame, number: str, most: int = MOST_COPIES) -> DataFrame:
    """The different rows of ``df`` with their ``number``; a row with over ``most`` copies comes in parts of as many at most (``<number>__part``
    counts them, so that ``block_join`` can deal the parts)."""
    n, part = F.col(number), F.col(f"{number}__part")
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(number)) \
        .withColumn(f"{number}__part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / most)))) \
        .withColumn(number, F.least(F.lit(most).cast("bigint"), n - part * most).cast("int"))


def repeated(df: DataFrame, *numbers: str) -> DataFrame:
    """The rows of ``df`` as often as the product of ``numbers`` (columns of ``copies``), which are dropped."""
    columns = [c for c in df.columns if c not in numbers and c not in [f"{n}__part" for n in numbers]]
    for n in numbers:
        df = df.select("*", F.explode(F.sequence(F.lit(1), F.col(n))).alias(f"__copy_{n}"))
    return df.select(*columns)
