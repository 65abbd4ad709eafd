"""Benchmark decontamination on canonical templates.

Method. Text is cut into tokens; numbers, units and names become typed placeholders (slots), all
other words are lower-cased literals. Every window of five template tokens is hashed, and document
windows are hash-joined to benchmark windows. Windows on one alignment (document position minus item position) bind
slots. Numbers and units are parameters, bound by place, so equal numbers may become different ones. A name must meet
one value: where it meets several, windows count that hold the value it meets at over half of its places. So a
re-parameterised question (other names, numbers, units) matches, while one that mixes up its names does not. An item is
found in a document when windows cover at least 0.8 of its windows.

Each window is hashed a second time by its values without case, and either hash may match, so a copy in other case is found,
whose names cannot be told; windows equal by value count without binding slots.

A unit is a listed word after a number, or a currency or per cent sign. A name is a title-case word; at the
start of a sentence only if the benchmark never has the word in lower case. The shape of a
window with fewer than two literals says nothing: it is widened until it has two, to the right and to the left.

The benchmark's window hashes are broadcast as a filter only while there are at most ``FILTER_WINDOWS``
(their number is counted first); beyond, all document windows go to the join.

Defined cases: null or empty texts have no windows; an item of fewer tokens than a window is one window of its
whole length, which documents have too; an item of one token only equals a text of one token; rows repeated under one id count as one
document; an empty benchmark finds nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from care_analytics.llm.common import slices, text_or_empty, written

WINDOW = 5
MIN_TOKENS = 2                 # items of fewer tokens equal whole texts only
MIN_COVERAGE = 0.8
FILTER_WINDOWS = 4_000_000     # 32 MB of hashes
LEXICON_WORDS = 500_000        # lower-case benchmark words that are shipped; more are joined
CHUNK_BYTES = 2_000_000

# Words that are units after a number, and signs that are units anywhere.
UNITS = """mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons tonne tonnes oz ounce
ounces lb lbs pound pounds ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr
hour hours day days week weeks month months year years k hz khz mhz ghz w kw mw v a j kj cal kcal pa kpa b kb mb gb tb
percent dollar dollars cent cents euro euros mph kph""".split()
SIGNS = "%$€£¥°"

TOKEN = re.compile(rf"[0-9]+(?:[.,][0-9]+)*|[^\W\d_]+|[{SIGNS}]|[.!?\n]+")
MARK, LITERAL, NUMBER, UNIT, SIGN, TITLE, TITLE_KNOWN = range(7)
PLACEHOLDER = {NUMBER: "<number>", UNIT: "<unit>", TITLE: "<name>"}
PRIME = 0x9E3779B97F4A7C15


def _kind(token: str, lexicon: frozenset[str]) -> int:
    if token[0].isdigit():
        return NUMBER
    if token[0] in SIGNS:
        return SIGN
    if token[0] in ".!?\n":
        return MARK
    if len(token) > 1 and token[0].isupper() and token[1:].islower():
        return TITLE_KNOWN if token.lower() in lexicon else TITLE
    return UNIT if token.lower() in UNIT_SET else LITERAL


UNIT_SET = frozenset(UNITS)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


class Templates:
    """The template tokens of several texts and their windows."""

    def __init__(self, texts: list[str], lexicon: frozenset[str], window: int = WINDOW, widths: tuple[int, ...] = ()):
        per = [TOKEN.findall(t) for t in texts]
        code: dict[str, int] = {}
        flat = np.array([code.setdefault(t, len(code)) for ts in per for t in ts], np.int64)
        self.text = np.repeat(np.arange(len(per)), [len(ts) for ts in per])
        words = list(code)
        kind = np.array([_kind(w, lexicon) for w in words], np.int64)[flat] if words else flat
        lower = np.array([_hash(w.casefold()) for w in words], np.uint64)[flat] if words else flat.astype(np.uint64)
        before = np.r_[MARK, kind[:-1]] if len(kind) else kind
        before[np.r_[True, self.text[1:] != self.text[:-1]][:len(before)]] = MARK
        kind = np.where((kind == UNIT) & (before != NUMBER), LITERAL, kind)
        kind = np.where(kind == TITLE_KNOWN, np.where(before == MARK, LITERAL, TITLE), kind)
        kind = np.where(kind == SIGN, UNIT, kind)
        keep = kind != MARK
        self.words, self.flat, self.text, kind, lower = words, flat[keep], self.text[keep], kind[keep], lower[keep]
        shape = lower.copy()
        for k, name in PLACEHOLDER.items():
            shape[kind == k] = _hash(name)
        self.slot, self.name = kind != LITERAL, kind == TITLE
        self._windows(shape, lower, window, len(per), widths)

    def _windows(self, shape: np.ndarray, value: np.ndarray, window: int, texts: int, widths: tuple[int, ...]) -> None:
        """By shape: windows with two literals, and wider ones for those without; by value: all. Windows of other
        ``widths`` are added to texts that are longer."""
        n = len(shape)
        size = np.bincount(self.text, minlength=texts)
        start = np.cumsum(size) - size

        def places(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            first = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            return first, np.repeat(np.arange(texts), count)

        self.start, self.count = start, np.where(size > 0, np.maximum(size - window, 0) + 1, 0)
        first, of = places(self.count)
        end = np.minimum(first + window, (start + size)[of])
        for width in widths:
            more, owner = places(np.where(size > width, size - width + 1, 0))
            first, end, of = np.r_[first, more], np.r_[end, more + width], np.r_[of, owner]
        literals = np.r_[0, np.cumsum(~self.slot)]
        rich = np.flatnonzero(literals[end] - literals[first] >= 2)
        poor = np.flatnonzero((literals[end] - literals[first] < 2) & (end - first == window))
        right = np.searchsorted(literals, literals[first[poor]] + 2)
        left = np.searchsorted(literals, literals[end[poor]] - 2, side="right") - 1
        to_right, to_left = right <= (start + size)[of[poor]], left >= start[of[poor]]
        use = np.r_[rich, poor[to_right], poor[to_left]]
        begin = np.r_[first[rich], first[poor[to_right]], left[to_left]]
        stop = np.r_[end[rich], right[to_right], end[poor[to_left]]]
        power, back = (np.cumprod(np.r_[np.uint64(1), np.full(n, x, np.uint64)]) for x in (PRIME, pow(PRIME, -1, 2 ** 64)))

        def rolled(tokens: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            total = np.r_[np.uint64(0), np.cumsum(tokens * power[:n], dtype=np.uint64)]
            return (total[b] - total[a]) * back[a] + (b - a).astype(np.uint64)

        key = np.r_[rolled(shape, begin, stop), rolled(value, first, end) ^ np.uint64(0xA0761D6478BD642F)]
        self.key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        self.exact = np.arange(len(key)) >= len(use)
        self.of, self.window = np.r_[of[use], of], np.r_[first[use], first] - start[np.r_[of[use], of]]
        self.first, self.width = np.r_[begin, first], np.r_[stop, end] - np.r_[begin, first]
        self.place = self.first - start[self.of]

    def names(self, w: int) -> list[tuple[int, str]]:
        """Places and values of the names in window ``w``, in order, lower case; none where it is hashed by value."""
        a = int(self.first[w])
        inside = [] if self.exact[w] else np.flatnonzero(self.name[a:a + int(self.width[w])]).tolist()
        return [(int(self.place[w]) + i, self.words[self.flat[a + i]].lower()) for i in inside]


def template_windows(rows: DataFrame, id_col: str, text_col: str, lexicon, only=None, window: int = WINDOW,
                     widths: tuple[int, ...] = ()) -> DataFrame:
    """(__id, __window, __place, __width, __n, __key, __exact, __names, __at): the windows of each text, ``__n`` in all, by
    shape and by value, with values and places of names. ``widths`` are those of shorter windows to add. ``only`` is a broadcast sorted
    array of hashes: other windows are left out. ``lexicon`` is a broadcast set of words, or a table (__word) of them."""
    texts = rows.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"))
    joined = isinstance(lexicon, DataFrame)
    texts, shipped = (_with_known(texts, lexicon), None) if joined else (texts, lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None
        if only is not None:
            bits = np.zeros(1 << 24, np.bool_)
            bits[only.value >> np.uint64(40)] = True
        for batch in batches:
            for part, some in slices(batch, batch.column(1), CHUNK_BYTES):
                words = shipped.value if shipped is not None else frozenset(w for ws in part.column(2).to_pylist() for w in ws or ())
                found = Templates(some, words, window, widths)
                at = np.arange(len(found.key))
                if bits is not None:
                    at = at[bits[found.key >> np.uint64(40)]]
                    near = np.searchsorted(only.value, found.key[at])
                    at = at[(near < len(only.value)) & (only.value[np.minimum(near, len(only.value) - 1)] == found.key[at])] \
                        if len(only.value) else at[:0]
                if len(at):
                    who = found.of[at]
                    names = [found.names(w) for w in at.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(who)), pa.array(found.window[at]), pa.array(found.place[at]),
                         pa.array(found.width[at]), pa.array(found.count[who]), pa.array(found.key[at].view(np.int64)),
                         pa.array(found.exact[at]), pa.array([[v for _, v in x] for x in names], pa.list_(pa.string())),
                         pa.array([[i for i, _ in x] for x in names], pa.list_(pa.int64()))],
                        names=["__id", "__window", "__place", "__width", "__n", "__key", "__exact", "__names", "__at"])

    schema = T.StructType([T.StructField("__id", rows.schema[id_col].dataType)]
                          + [T.StructField(c, T.LongType()) for c in ("__window", "__place", "__width", "__n", "__key")]
                          + [T.StructField("__exact", T.BooleanType()), T.StructField("__names", T.ArrayType(T.StringType())),
                             T.StructField("__at", T.ArrayType(T.LongType()))])
    return texts.mapInArrow(run, schema)


def lexicon_words(benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """(__word): the words the benchmark has in lower case."""
    return benchmark.select(F.explode(F.split(text_or_empty(text_col), r"[^\p{L}]+")).alias("__word")) \
        .filter((F.col("__word") != "") & (F.col("__word") == F.lower("__word"))).distinct()


def lexicon_of(benchmark: DataFrame, text_col: str = "text", limit: int = LEXICON_WORDS) -> frozenset[str] | None:
    """``lexicon_words`` as a set to ship; None beyond ``limit``, when they are joined instead."""
    words = lexicon_words(benchmark, text_col).limit(limit + 1).collect()
    return frozenset(r["__word"] for r in words) if len(words) <= limit else None


def _with_known(texts: DataFrame, words: DataFrame) -> DataFrame:
    """texts(__id, __text) -> (__id, __text, __known): ``__known`` are the title-case words at sentence starts of the row,
    in lower case, that are in ``words(__word)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, some in slices(batch, batch.column(2), CHUNK_BYTES):
                tokens = [TOKEN.findall(t) for t in some]
                starts = [sorted({w.lower() for before, w in zip(["."] + ts, ts) if before[0] in ".!?\n"
                                  and len(w) > 1 and w[0].isupper() and w[1:].islower()}) for ts in tokens]
                who = pa.array(np.repeat(np.arange(len(starts)), [len(x) for x in starts]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(who), part.column(1).take(who),
                                                  pa.array([w for x in starts for w in x], pa.string())], names=["__sid", "__skey", "__start"])

    keyed = texts.select("__id", F.xxhash64("__text").alias("__hash"), "__text")
    schema = T.StructType([T.StructField("__sid", texts.schema["__id"].dataType), T.StructField("__skey", T.LongType()),
                           T.StructField("__start", T.StringType())])
    known = keyed.mapInArrow(run, schema).join(words, F.col("__start") == F.col("__word")) \
        .groupBy("__sid", "__skey").agg(F.collect_set("__start").alias("__known"))
    return keyed.join(known, F.col("__id").eqNullSafe(F.col("__sid")) & (F.col("__hash") == F.col("__skey")), "left") \
        .select("__id", "__text", "__known")


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
            min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(__id, __item, __coverage): items found in documents."""
    sc = docs.sparkSession.sparkContext
    lexicon = lexicon_of(benchmark, item_text_col)
    lexicon = lexicon_words(benchmark, item_text_col) if lexicon is None else sc.broadcast(lexicon)
    items = template_windows(benchmark, item_col, item_text_col, lexicon, window=window) \
        .select(F.col("__id").alias("__item"), F.col("__window").alias("__iwindow"), F.col("__place").alias("__iplace"),
                F.col("__width").alias("__iwidth"), F.col("__n").alias("__in"), F.col("__key").alias("__ikey"),
                F.col("__names").alias("__inames"), F.col("__at").alias("__iat"))
    short = items.filter(F.col("__iwidth").between(MIN_TOKENS, window - 1)).agg(F.collect_set("__iwidth").alias("w")).first()
    widths = tuple(sorted(short["w"]))
    keys = items.select("__ikey").distinct().limit(FILTER_WINDOWS + 1)
    only = None
    if keys.count() <= FILTER_WINDOWS:
        only = sc.broadcast(np.unique(np.array([r[0] for r in keys.toLocalIterator()], np.int64).view(np.uint64)))
    windows = template_windows(docs, id_col, text_col, lexicon, only, window, widths) \
        .select("__id", "__place", "__key", "__exact", "__names")
    hits = written(windows.join(items, F.col("__key") == F.col("__ikey"))
                   .withColumn("__line", F.col("__place") - F.col("__iplace")), "template-hits")
    alignment = ["__id", "__item", "__line"]
    # A place of the item meets one place of the document, so the sets are at most as long as the item.
    bound = hits.select(*alignment, F.explode(F.arrays_zip(F.col("__inames").alias("i"), F.col("__iat").alias("at"), F.col("__names").alias("d"))).alias("__s")) \
        .groupBy(*alignment, F.col("__s.i").alias("__value")) \
        .agg(F.collect_set(F.struct("__s.at", "__s.d")).alias("__met")) \
        .withColumn("__met", F.col("__met.d")).withColumn("__kinds", F.array_distinct("__met")).filter(F.size("__kinds") > 1) \
        .withColumn("__most", F.expr("get(filter(__kinds, k -> 2 * size(filter(__met, m -> m = k)) > size(__met)), 0)")) \
        .groupBy(*[F.col(c).alias(f"{c}_odd") for c in alignment]) \
        .agg(F.collect_list(F.struct(F.col("__value").alias("i"), F.col("__most").alias("d"))).alias("__odd"))
    clash = F.lit(True)
    for c in alignment:
        clash = clash & F.col(c).eqNullSafe(F.col(f"{c}_odd"))
    return hits.join(bound, clash, "left") \
        .filter("__odd is null or not exists(arrays_zip(__inames, __names), s -> "
                "exists(__odd, o -> o.i = s.__inames and not (o.d <=> s.__names)))") \
        .groupBy("__id", "__item", "__iwindow").agg(F.max("__in").alias("__in")) \
        .groupBy("__id", "__item").agg((F.count(F.lit(1)) / F.max("__in")).alias("__coverage")) \
        .filter(F.col("__coverage") >= min_coverage)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per input row: (id, contaminated, n_items, items comma-joined in order, coverage of the best one)."""
    found = matches(docs, benchmark, id_col, text_col, item_col, item_text_col, window, min_coverage) \
        .groupBy(F.col("__id").alias("__found")).agg(
            F.count(F.lit(1)).alias("__n"), F.max("__coverage").alias("__c"),
            F.concat_ws(",", F.transform(F.sort_array(F.collect_set("__item")), lambda x: x.cast("string"))).alias("__items"))
    return docs.select(F.col(id_col)).join(found, F.col(id_col).eqNullSafe(F.col("__found")), "left") \
        .select(F.col(id_col), F.col("__n").isNotNull().alias("contaminated"), F.coalesce("__n", F.lit(0)).alias("n_items"),
                F.coalesce("__items", F.lit("")).alias("items"), F.coalesce("__c", F.lit(0.0)).alias("coverage"))
