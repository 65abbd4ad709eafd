"""License scans by diagonal voting.

Method. Words of a text are hashed, and all rolling grams of two and of five words are joined in Spark to
the positions of the same grams in the templates. A hit at document position p and template position q lies on
diagonal p - q; hits are counted per diagonal, which is one placement of the template. Short templates
(phrases) count where every gram of theirs lies on one diagonal. For long ones, neighbouring diagonals are merged (an
inserted or missing word shifts the rest); of what is then not verified, each band is merged with the bands that lie
beyond it by at most the words a stretch may add, and the best of overlapping spans counts. A merged span is verified: the words its hits cover must be
at least 0.8 of the template's (all of them for a notice under 20 words), on a stretch of at most 1.25 times its length.

Templates are the constants below or the caller's, counted before they are broadcast (at most ``MAX_GRAMS`` grams).

Defined cases: null and empty texts have no words and no labels; a text shorter than a gram has no hits; rows repeated
get equal results; rows that share an id but not the text are told apart by the text's hash; an empty table gives an empty
result; without templates nothing is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from care_analytics.llm.common import slices, text_or_empty, written

SHORT_GRAM, LONG_GRAM = 2, 5
MIN_COVER, MAX_STRETCH = 0.8, 1.25
WHOLE_WORDS = 20           # notices of fewer words must be covered whole: their last word may be the version
MAX_SHIFT = 4              # diagonals at most so far apart are neighbours
STEP = 1 << 20             # over the words any stretch may add
MAX_GRAMS = 200_000        # template grams that may be broadcast (a few MB)
CHUNK_BYTES = 4_000_000
PRIME = 0x9E3779B97F4A7C15
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"      # A-Z count as a-z

# Base phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Public license notices and texts, and their labels.
TEXTS = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("released under the mit license", "mit"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction including without limitation the rights to "
     "use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
     "software is furnished to do so subject to the following conditions the above copyright notice and this permission notice "
     "shall be included in all copies or substantial portions of the software", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
     "provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following "
     "conditions are met", "bsd"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache "
     "org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license "
     "is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache-2.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license "
     "as published by the free software foundation", "gpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]

_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Words with A-Z lower-cased: runs of digits, letters a-z and everything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_KEPT).split()


def grams(texts: list[list[bytes]], size: int) -> list[np.ndarray]:
    """Hashes of all rolling grams of ``size`` words of each text."""
    code: dict[bytes, int] = {}
    flat = np.array([code.setdefault(w, len(code)) for ws in texts for w in ws], np.int64)
    one = np.array([xxhash.xxh64_intdigest(w) for w in code], np.uint64)[flat] if code else np.zeros(0, np.uint64)
    n = len(one) - size + 1
    rolled, factor = np.full(max(n, 0), size, np.uint64), 1
    for k in range(size):
        rolled += one[k:k + max(n, 0)] * np.uint64(factor)
        factor = factor * PRIME % 2 ** 64
    rolled = ((rolled ^ (rolled >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)
    out, at = [], 0
    for ws in texts:
        out.append(rolled[at:at + max(len(ws) - size + 1, 0)])
        at += len(ws)
    return out


@dataclass(frozen=True)
class Template:
    words: str
    label: str
    base: bool

    @property
    def gram(self) -> int:
        return LONG_GRAM if len(words_of(self.words)) >= LONG_GRAM else SHORT_GRAM


TEMPLATES = [Template(w, label, True) for w, label in PHRASES] + [Template(w, label, False) for w, label in TEXTS]


def positions(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """(__gram, __q, __t, __size, __width, __base, __label): every gram of every template and its place."""
    rows = []
    for t, template in enumerate(templates):
        words = words_of(template.words)
        if len(words) < SHORT_GRAM:
            raise ValueError("a template has at least two words")
        rows += [(int(g), q, t, len(words), template.gram, template.base, template.label)
                 for q, g in enumerate(grams([words], template.gram)[0])]
    if len(rows) > MAX_GRAMS:
        raise ValueError(f"more than {MAX_GRAMS} template grams: scan with several sets of templates")
    return docs.sparkSession.createDataFrame(
        rows, "__gram long, __q int, __t int, __size int, __width int, __base boolean, __label string")


def rolling_grams(rows: DataFrame) -> DataFrame:
    """rows(__id, __key, __text) -> (__id, __key, __short int, __grams): hashes of all two-word grams, ``__short`` of
    them, then of all five-word grams."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, batch.column(2), CHUNK_BYTES):
                words = [words_of(t) for t in texts]
                short, long = grams(words, SHORT_GRAM), grams(words, LONG_GRAM)
                both = [np.concatenate(x) for x in zip(short, long)]
                ends = np.r_[0, np.cumsum([len(x) for x in both])].astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(both)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) for x in short], pa.int32()), found],
                                                 names=["__id", "__key", "__short", "__grams"])

    schema = T.StructType([T.StructField("__id", rows.schema["__id"].dataType), T.StructField("__key", T.LongType()),
                           T.StructField("__short", T.IntegerType()), T.StructField("__grams", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(run, schema)


def _verified(merged: DataFrame) -> DataFrame:
    """``merged`` with ``__cover``, and in ``__whole`` whether the span is a placement of its template."""
    least = F.when(F.col("__size") < WHOLE_WORDS, 1.0).otherwise(MIN_COVER)
    return merged \
        .withColumn("__covered", F.expr("size(array_distinct(flatten(transform(__places, q -> sequence(q, q + __width - 1)))))")) \
        .withColumn("__cover", F.col("__covered") / F.col("__size")) \
        .withColumn("__whole", (F.col("__cover") >= least) & (F.col("__to") - F.col("__from") <= F.ceil(F.col("__size") * MAX_STRETCH)))


def spans(rows: DataFrame, templates: list[Template]) -> DataFrame:
    """(__id, __key, __t, __base, __label, __from, __to, __cover): verified placements; words from 0, end exclusive."""
    table = positions(rows, templates)
    rolled = rolling_grams(rows).select("__id", "__key", "__short", F.posexplode("__grams").alias("__at", "__g"))
    hits = rolled.join(F.broadcast(table), F.col("__g") == F.col("__gram")) \
        .withColumn("__p", F.when(F.col("__at") < F.col("__short"), F.col("__at")).otherwise(F.col("__at") - F.col("__short"))) \
        .withColumn("__line", F.col("__p") - F.col("__q"))
    template = ["__id", "__key", "__t", "__size", "__width", "__base", "__label"]
    lines = hits.groupBy(*template, "__line").agg(
        F.count_distinct("__q").alias("__votes"), F.min("__p").alias("__first"), F.max("__p").alias("__last"),
        F.collect_set("__q").alias("__places"))                       # at most a template's length
    lines = written(lines, "license-lines")
    exact = lines.filter(F.col("__votes") == F.col("__size") - F.col("__width") + 1)
    phrases = exact.filter(F.col("__size") < LONG_GRAM).select(
        *template, F.col("__first").alias("__from"), (F.col("__first") + F.col("__size")).alias("__to"), F.lit(1.0).alias("__cover"))
    by_line = Window.partitionBy("__id", "__key", "__t").orderBy("__line")
    opened = F.coalesce(F.col("__line") - F.lag("__line").over(by_line) > MAX_SHIFT, F.lit(True))
    bands = lines.filter(F.col("__size") >= LONG_GRAM).withColumn("__new", opened.cast("int")) \
        .withColumn("__band", F.sum("__new").over(by_line.rowsBetween(Window.unboundedPreceding, 0))) \
        .groupBy(*template, "__band").agg(
            F.min("__line").alias("__line"), F.min("__first").alias("__from"), F.max(F.col("__last") + F.col("__width")).alias("__to"),
            F.array_distinct(F.flatten(F.collect_list("__places"))).alias("__places"))
    bands = _verified(bands)
    # Places scaled by the words a stretch may add, so that one range frame serves all templates.
    near = Window.partitionBy("__id", "__key", "__t").orderBy("__scaled").rangeBetween(0, STEP)
    wide = bands.filter("not __whole").withColumn("__reach", F.ceil(F.col("__size") * (MAX_STRETCH - 1))) \
        .filter(F.col("__reach") > MAX_SHIFT) \
        .withColumn("__scaled", F.expr(f"((bigint(__line) + __size) * {STEP}) div __reach")) \
        .select(*template, F.min("__from").over(near).alias("__from"), F.max("__to").over(near).alias("__to"),
                F.array_distinct(F.flatten(F.collect_list("__places").over(near))).alias("__places"))
    wide = _verified(wide).filter("__whole")
    in_order = Window.partitionBy("__id", "__key", "__t").orderBy("__from", "__to")
    apart = F.coalesce(F.col("__from") >= F.max("__to").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    wide = wide.withColumn("__new", apart.cast("int")) \
        .withColumn("__span", F.sum("__new").over(in_order.rowsBetween(Window.unboundedPreceding, 0))) \
        .groupBy(*template, "__span").agg(F.max(F.struct("__cover", (-F.col("__from")).alias("f"), "__to")).alias("__best")) \
        .select(*template, (-F.col("__best.f")).alias("__from"), F.col("__best.__to").alias("__to"), F.col("__best.__cover").alias("__cover"))
    columns = ["__id", "__key", "__t", "__base", "__label", "__from", "__to", "__cover"]
    return phrases.select(*columns).union(bands.filter("__whole").select(*columns)).union(wide.select(*columns))


def scan(docs: DataFrame, templates: list[Template] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, n_words, n_base, first_word, last_word, base_labels, labels, score): places of base
    templates and their smallest and largest start, labels of base and of all templates, and the best cover."""
    rows = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text")) \
        .withColumn("__key", F.xxhash64("__text")).select("__id", "__key", "__text")
    base = F.when(F.col("__base"), F.col("__from"))
    found = spans(rows, TEMPLATES if templates is None else templates) \
        .groupBy(F.col("__id").alias("__fid"), F.col("__key").alias("__fkey")).agg(
            F.count(base).alias("__n"), F.min(base).alias("__first"), F.max(base).alias("__last"),
            F.array_join(F.sort_array(F.collect_set(F.when(F.col("__base"), F.col("__label")))), ",").alias("__own"),
            F.array_join(F.sort_array(F.collect_set("__label")), ",").alias("__all"), F.max("__cover").alias("__score"))
    found = written(found, "license-documents")
    counted = rows.select("__id", "__key", F.regexp_count("__text", F.lit(WORD)).cast("long").alias("n_words"))
    return counted.join(found, F.col("__id").eqNullSafe(F.col("__fid")) & (F.col("__key") == F.col("__fkey")), "left").select(
        F.col("__id").alias(id_col), "n_words", F.coalesce("__n", F.lit(0)).alias("n_base"),
        F.col("__first").cast("long").alias("first_word"), F.col("__last").cast("long").alias("last_word"),
        F.coalesce("__own", F.lit("")).alias("base_labels"), F.coalesce("__all", F.lit("")).alias("labels"),
        F.coalesce("__score", F.lit(0.0)).alias("score"))
