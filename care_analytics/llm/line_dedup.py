"""Line dedup by winnowing over line hashes.

Method. A document is the sequence of its lines, outer white space and blank lines aside, each with a
hash and a number of words. A window is a shortest stretch of lines with at least ``MIN_WORDS`` words: one from each
line on, and one up to each line. The least line hash of a window is its fingerprint, so two equal stretches
of so many words always share a fingerprint at the same place. Positions are joined on fingerprints: only a
fingerprint at two or more positions can be part of a repeat. Around each such position the match is extended
both ways by its windows, which are compared as a whole (a hash of all their lines) with the first place they occur. Every
line of a window that occurs earlier, by (id, line), belongs to a later repeated run and is deleted; the
windows of a run overlap and together cover the run.

First places are group minima, pre-aggregated per task, joined back: a line or passage that a third of the
documents share is never gathered, and no pairs of positions are made.

Defined cases: a null text has no lines and stays null; a repeat within a document is a repeat; rows repeated with the same id
and text are one document; a null id comes before all others; an empty table gives an empty result; blank lines inside a
deleted run go with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from care_analytics.llm.common import slices, text_or_empty, written

MIN_WORDS = 50
CHUNK_BYTES = 4_000_000
PRIME = 0x9E3779B97F4A7C15
INVERSE = pow(PRIME, -1, 2 ** 64)


def lines_of(text: str) -> list[tuple[int, str]]:
    """Number and content of each line that counts."""
    return [(i, s) for i, line in enumerate(text.split("\n")) if (s := line.strip())]


def _least(order: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least of ``order[first..last]`` for each window, by a table of minima over powers of two."""
    out = np.empty(len(first), order.dtype)
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    table = order
    for k in range(int(level.max()) + 1 if len(level) else 0):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[first[at]], table[last[at] - (1 << k) + 1])
    return out


def windows_of(texts: list[str], min_words: int) -> dict[str, np.ndarray]:
    """The windows of several texts: text number, first and last line, line and hash of the fingerprint, hash of
    the whole window."""
    per = [lines_of(t) for t in texts]
    text = np.repeat(np.arange(len(per)), [len(p) for p in per])
    number = np.array([i for p in per for i, _ in p], np.int64)
    content = [s for p in per for _, s in p]
    h = np.array([xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) for s in content], np.uint64)
    words = np.array([len(s.split()) for s in content], np.int64)
    n = len(h)
    total = np.r_[0, np.cumsum(words)]
    start = np.searchsorted(text, text, side="left")              # first line of the same text
    stop = np.searchsorted(text, text, side="right")
    here = np.arange(n)
    ahead = np.searchsorted(total, total[:-1] + min_words) - 1    # last line of the window from each line on
    back = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    first = np.r_[here[ahead < stop], back[(back >= start)]]
    last = np.r_[ahead[ahead < stop], here[back >= start]]
    both = np.unique(np.stack([first, last], axis=1), axis=0) if n else np.zeros((0, 2), np.int64)
    first, last = both[:, 0], both[:, 1]
    order = np.empty(n, np.int64)
    ranked = np.lexsort((-here, h))                               # ties: the last one is the least
    order[ranked] = here
    chosen = ranked[_least(order, first, last)] if len(first) else first
    power = np.cumprod(np.r_[np.uint64(1), np.full(n, PRIME, np.uint64)])
    undo = np.cumprod(np.r_[np.uint64(1), np.full(n, INVERSE, np.uint64)])
    summed = np.r_[np.uint64(0), np.cumsum(h * power[:n], dtype=np.uint64)]
    whole = (summed[last + 1] - summed[first]) * undo[first] + (last - first + 1).astype(np.uint64)
    return {"text": text[first], "first": number[first], "last": number[last], "at": number[chosen],
            "print": h[chosen], "whole": (whole ^ (whole >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)}


def windows(rows: DataFrame, min_words: int) -> DataFrame:
    """rows(__id, __key, __text) -> (__id, __key, __first, __last, __at, __print, __whole)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, batch.column(2), CHUNK_BYTES):
                w = windows_of(texts, min_words)
                who = pa.array(w["text"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(who), part.column(1).take(who), pa.array(w["first"].astype(np.int32)), pa.array(w["last"].astype(np.int32)),
                     pa.array(w["at"].astype(np.int32)), pa.array(w["print"].view(np.int64)), pa.array(w["whole"].view(np.int64))],
                    names=["__id", "__key", "__first", "__last", "__at", "__print", "__whole"])

    schema = T.StructType([T.StructField("__id", rows.schema["__id"].dataType), T.StructField("__key", T.LongType()),
                           T.StructField("__first", T.IntegerType()), T.StructField("__last", T.IntegerType()),
                           T.StructField("__at", T.IntegerType()), T.StructField("__print", T.LongType()), T.StructField("__whole", T.LongType())])
    return rows.mapInArrow(run, schema)


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(__id, __key, __runs): for documents with later repeated runs, the lines (first, last) of their windows."""
    rows = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text")) \
        .withColumn("__key", F.xxhash64("__text")).select("__id", "__key", "__text")
    found = written(windows(rows, min_words), "line-windows")
    place = F.struct("__id", "__key", "__at")
    prints = written(found.groupBy(F.col("__print").alias("__p")).agg(F.min(place).alias("__a"), F.max(place).alias("__z"))
                     .filter("__a <> __z").select("__p"), "line-prints")
    matched = written(found.join(prints, F.col("__print") == F.col("__p"), "left_semi").drop("__print", "__at"), "line-matches")
    start = F.struct("__id", "__key", "__first")
    firsts = written(matched.groupBy(F.col("__whole").alias("__w")).agg(F.min(start).alias("__a"), F.max(start).alias("__z"))
                     .filter("__a <> __z").select("__w", "__a"), "line-firsts")
    later = matched.join(firsts, F.col("__whole") == F.col("__w")).filter(start > F.col("__a"))
    return later.groupBy("__id", "__key").agg(F.sort_array(F.collect_set(F.struct(F.col("__first").alias("a"), F.col("__last").alias("b")))).alias("__runs"))


_CLEANED = T.StructType([T.StructField("text", T.StringType()), T.StructField("lines", T.IntegerType()),
                         T.StructField("deleted", T.IntegerType()), T.StructField("runs", T.IntegerType())])


@F.arrow_udf(_CLEANED)
def _without(texts: pa.Array, runs: pa.Array) -> pa.Array:
    out = []
    for text, spans in zip(texts.to_pylist(), runs.to_pylist()):
        if text is None:
            out.append({"text": None, "lines": 0, "deleted": 0, "runs": 0})
            continue
        lines = text.split("\n")
        kept, at, n = [], 0, 0
        for span in spans or []:
            if span["a"] >= at or n == 0:
                n += 1
            kept += lines[at:span["a"]]
            at = max(at, span["b"] + 1)
        kept += lines[at:]
        out.append({"text": "\n".join(kept), "lines": len(lines), "deleted": len(lines) - len(kept), "runs": n})
    return pa.array(out, pa.struct([("text", pa.string()), ("lines", pa.int32()), ("deleted", pa.int32()), ("runs", pa.int32())]))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per input row: (id, text without later repeated runs, n_lines, n_deleted, n_runs)."""
    runs = written(repeated_runs(docs, id_col, text_col, min_words).select(
        F.col("__id").alias("__rid"), F.col("__key").alias("__rkey"), "__runs"), "line-runs")
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")) \
        .withColumn("__hash", F.xxhash64(text_or_empty("__text")))
    # merged at every size: whether the runs of a small table fit a broadcast says nothing about a large one
    return rows.join(runs.hint("merge"), F.col("__id").eqNullSafe(F.col("__rid")) & (F.col("__hash") == F.col("__rkey")), "left") \
        .withColumn("__new", _without("__text", "__runs")) \
        .select(F.col("__id").alias(id_col), F.col("__new.text").alias(text_col), F.col("__new.lines").alias("n_lines"),
                F.col("__new.deleted").alias("n_deleted"), F.col("__new.runs").alias("n_runs"))
