"""Ranked lexical search by exact inner products over sparse ball trees.

Method. A document is the sparse vector of g = (10^9 tf) div (1000 tf + 8 m) over its terms and an item the vector of its term
weights w, repeats added, so that a score is their inner product. Only terms of items can add to it, so vectors hold these.
Documents are dealt by range of their heaviest terms (and id, so a group of copies of any size spreads over tasks); every task
cuts its rows into blocks of at most ``BLOCK_DOCS`` documents and ``BLOCK_TERMS`` coordinates and grows a ball tree in each: a
node is split at the median between two far documents, down to leaves of ``LEAF`` documents. A node has the centroid of its
documents and, for each of ``GROUPS`` groups of coordinates, the largest distance of a document from the centroid within the
group. By Cauchy-Schwarz no document below it scores over q.c + sum over groups of |q_g| r_g (coordinates are scaled by the square root of
the weight on both sides, which leaves the product as it is). Each item walks a block best-first and stops when the largest bound
left is under the least of its best k scores; what is left in the queue is pruned. Leaves are scored in 64-bit integers.

Safe rounding: all products q.c are sums of terms that are not negative, so their relative error is at most the number of terms
times 2^-52; squared distances get that share of everything added or subtracted in them added on; the bound is raised by
2^-40 and by one. A bound equal to the least score is still searched, because a smaller id wins a tie.

The items are a stated query set, taken in blocks of about ``ITEM_ENTRIES`` (item, term) pairs, which are broadcast; documents are read once
for each block. Statistics cover all documents. A sample of about ``SEED_DOCS`` documents (by hash of the id) is searched first: the k-th score in
it is a lower bound of the k-th score of all, from which every task starts. It changes no result.

Defined cases: a null text has no terms and is in no result; documents without a term are not counted; rows that repeat an
id are documents of their own; a null id comes after all others of its score; rows of items with equal id and text are one item,
others that share an id are ranked each for itself; an item without terms has no row; empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from care_analytics.llm.common import written

ITEM_ENTRIES = 1_000_000
BLOCK_DOCS, BLOCK_TERMS = 1024, 100_000
LEAF = 32
GROUPS = 256
SEED_DOCS = 16_384
PIECE = 1 << 20          # bytes of a text that are words at a time

# Bytes that are no part of a term become spaces; A-Z become a-z.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(text: bytes) -> Counter:
    """Terms of a text in UTF-8 with their numbers, read in pieces that end between terms."""
    counts: Counter = Counter()
    begin = 0
    while begin < len(text):
        piece = text[begin:begin + PIECE].translate(_TABLE)
        if begin + PIECE < len(text):
            end = piece.rfind(b" ") + 1
            while not end:                                        # a term longer than the piece
                piece = text[begin:begin + 2 * len(piece)].translate(_TABLE)
                end = len(piece) if begin + len(piece) >= len(text) else piece.rfind(b" ") + 1
            piece = piece[:end]
        counts.update(piece.split())
        begin += len(piece)
    return counts


def _texts(column: pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.large_binary()):
        yield value.as_buffer().to_pybytes() if value.is_valid else b""


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, text in enumerate(_texts(batch.column("__text"))):
            counts = term_counts(text)
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("__item")[i].as_py()] * len(counts), batch.column("__item").type),
                                                  pa.array([batch.column("__key")[i].as_py()] * len(counts)), pa.array([len(text)] * len(counts), pa.int64()),
                                                  pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                                 names=["__item", "__key", "__size", "__term", "__times"])


def vectors(vocabulary):
    """mapInArrow: documents -> (id, n, term numbers, tf) over the broadcast ``vocabulary``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        names = number.keys()
        for batch in batches:
            sizes, terms, times, ends = [], [], [], [0]
            for text in _texts(batch.column("__text")):
                counts = term_counts(text)
                sizes.append(counts.total())
                known = counts.keys() & names
                terms.extend(number[t] for t in known)
                times.extend(counts[t] for t in known)
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                                              pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))], names=["__id", "__n", "__terms", "__tf"])
    return run


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Block:
    """Documents as rows of sparse vectors: ``impact`` in integers, ``x`` scaled for the geometry."""

    def __init__(self, ids: np.ndarray, absent: np.ndarray, ends: np.ndarray, terms: np.ndarray, impact: np.ndarray, root: np.ndarray):
        self.ids, self.absent, self.impact = ids, absent, impact
        self.start = np.concatenate([[0], ends])
        self.columns, self.col = np.unique(terms, return_inverse=True)
        self.x = impact * root[terms]
        self.group = self.columns % GROUPS

    def flat(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the coordinates of ``docs``, and which of ``docs`` each belongs to."""
        lengths = self.start[docs + 1] - self.start[docs]
        owner = np.repeat(np.arange(len(docs)), lengths)
        shift = np.cumsum(lengths) - lengths
        return np.arange(len(owner)) + (self.start[docs] - shift)[owner], owner

    def dot(self, at: np.ndarray, owner: np.ndarray, size: int, dense: np.ndarray) -> np.ndarray:
        return np.bincount(owner, self.x[at] * dense[self.col[at]], size)


class Tree:
    """Nodes in the order they are made: ``centroids`` (column x node), ``radii`` (group x node), children, documents of leaves."""

    def __init__(self, block: Block, leaf: int):
        self.block = block
        self.children: dict[int, tuple[int, int]] = {}
        self.leaves: dict[int, np.ndarray] = {}
        centroids, radii, todo = [], [], [np.arange(len(block.ids))]
        for docs in todo:                                         # grows while it is read
            node = len(centroids)
            at, owner = block.flat(docs)
            centre = np.bincount(block.col[at], block.x[at], len(block.columns)) / len(docs)
            centroids.append(centre)
            radii.append(self._radii(at, owner, len(docs), centre))
            if len(docs) <= leaf:
                self.leaves[node] = docs
                continue
            self.children[node] = (len(todo), len(todo) + 1)
            todo.extend(self._halves(docs, at, owner, centre))
        self.centroids, self.radii = np.array(centroids).T, np.array(radii).T

    def _radii(self, at: np.ndarray, owner: np.ndarray, size: int, centre: np.ndarray) -> np.ndarray:
        b = self.block
        x, c = b.x[at], centre[b.col[at]]
        cell = owner * GROUPS + b.group[b.col[at]]
        own = np.bincount(b.group, centre * centre, GROUPS)
        change = np.bincount(cell, x * x - 2 * x * c, size * GROUPS).reshape(size, GROUPS)
        moved = np.bincount(cell, x * x + 2 * x * c, size * GROUPS).reshape(size, GROUPS)
        error = (len(b.columns) + 8) * 2.0 ** -52 * (own + moved)
        return np.sqrt(np.maximum(own + change, 0.0) + error).max(axis=0)

    def _halves(self, docs: np.ndarray, at: np.ndarray, owner: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = self.block
        norm = np.bincount(owner, b.x[at] ** 2, len(docs))

        def far(dense: np.ndarray) -> tuple[int, np.ndarray]:
            away = norm - 2 * b.dot(at, owner, len(docs), dense)
            return int(np.argmax(away)), away

        def row(i: int) -> np.ndarray:
            dense = np.zeros(len(b.columns))
            begin, end = b.start[docs[i]], b.start[docs[i] + 1]
            dense[b.col[begin:end]] = b.x[begin:end]
            return dense
        first, _ = far(centre)
        second, to_first = far(row(first))
        _, to_second = far(row(second))
        order = np.argsort(to_first - to_second, kind="stable")
        return docs[order[:len(docs) // 2]], docs[order[len(docs) // 2:]]


class Items:
    """The broadcast block of items: term numbers and integer weights (w times repeats) of each, by (item, term)."""

    def __init__(self, start: np.ndarray, terms: np.ndarray, weights: np.ndarray, root: np.ndarray, least: np.ndarray, k: int):
        self.start, self.terms, self.weights, self.root, self.least, self.k = start, terms, weights, root, least, k


def search_block(tree: Tree, items: Items, best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], counts: Counter) -> None:
    """Walks the tree for every item; ``best`` holds (scores, absent, ids) of the best k of each item."""
    b = tree.block
    place = np.searchsorted(b.columns, items.terms)
    place[place == len(b.columns)] = 0
    here = b.columns[place] == items.terms
    owner = np.repeat(np.arange(len(items.start) - 1), np.diff(items.start))[here]
    if not len(owner):
        return
    col, integer = place[here], items.weights[here]
    q = integer / items.root[items.terms[here]]                    # w * repeats / sqrt(w)
    cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    cuts = np.append(cuts, len(owner))
    leaf_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    step = max(1, 4_000_000 // max(len(tree.leaves) * 2, GROUPS))    # entries whose bounds are computed at a time
    begin = 0
    while begin < len(cuts) - 1:
        end = max(begin + 1, int(np.searchsorted(cuts, cuts[begin] + step, side="right")) - 1)
        span = slice(cuts[begin], cuts[end])
        starts = cuts[begin:end] - cuts[begin]
        row = np.repeat(np.arange(end - begin), np.diff(np.append(starts, cuts[end] - cuts[begin])))
        groups = np.sqrt(np.bincount(row * GROUPS + b.group[col[span]], q[span] ** 2, (end - begin) * GROUPS)).reshape(-1, GROUPS)
        bounds = np.add.reduceat(q[span, None] * tree.centroids[col[span]], starts, axis=0) + groups @ tree.radii
        bounds = bounds * (1 + 2.0 ** -40) + 1
        for i in range(begin, end):
            item = int(owner[cuts[i]])
            mine = slice(cuts[i], cuts[i + 1])
            _walk(tree, leaf_tables, item, bounds[i - begin], col[mine], integer[mine], items, best, counts)
        begin = end


def _walk(tree: Tree, tables: dict, item: int, bound: np.ndarray, col: np.ndarray, integer: np.ndarray, items: Items, best: dict, counts: Counter) -> None:
    kept = best.get(item)
    least = max(1, int(items.least[item]))
    if kept is not None and len(kept[0]) == items.k:
        least = max(least, int(kept[0][-1]))
    queue = [(-bound[0], 0)]
    while queue and -queue[0][0] >= least:
        _, node = heapq.heappop(queue)
        if node in tree.children:
            for child in tree.children[node]:
                if bound[child] >= least:
                    heapq.heappush(queue, (-bound[child], child))
            continue
        counts["leaves"] += 1
        docs = tree.leaves[node]
        if node not in tables:
            tables[node] = _leaf_table(tree.block, docs)
        columns, impact = tables[node]
        at = np.searchsorted(columns, col)
        at[at == len(columns)] = 0
        hit = columns[at] == col
        scores = integer[hit] @ impact[at[hit]]
        good = np.flatnonzero(scores >= least)
        if len(good):
            s, a, d = scores[good], tree.block.absent[docs[good]], tree.block.ids[docs[good]]
            if kept is not None:
                s, a, d = np.concatenate([kept[0], s]), np.concatenate([kept[1], a]), np.concatenate([kept[2], d])
            order = np.lexsort((d, a, -s))[:items.k]
            kept = (s[order], a[order], d[order])
            best[item] = kept
            if len(order) == items.k:
                least = max(least, int(kept[0][-1]))


def _leaf_table(block: Block, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, owner = block.flat(docs)
    columns, row = np.unique(block.col[at], return_inverse=True)
    table = np.zeros((max(1, len(columns)), len(docs)), dtype=np.int64)
    table[row, owner] = block.impact[at]
    return (columns if len(columns) else np.array([-1])), table


def impacts(sizes: list[int], ends: np.ndarray, tf: np.ndarray, documents: int, total: int) -> np.ndarray:
    m = np.array([100 - 75 + (75 * n * documents) // total for n in sizes], dtype=np.int64)
    m = np.repeat(m, np.diff(np.concatenate([[0], ends])))
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def searched(shared, documents: int, total: int, leaf: int, block_docs: int, block_terms: int):
    """mapInArrow: a task's documents -> the best of each item among them, and one row (item -1) of leaves visited and all."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, docs, terms = [], 0, 0
        for batch in batches:
            ends = batch.column("__terms").offsets.to_numpy().astype(np.int64)
            ends = ends[1:] - ends[0]
            begin = 0
            while begin < batch.num_rows:
                base = ends[begin - 1] if begin else 0
                end = min(begin + block_docs - docs, int(np.searchsorted(ends, base + block_terms - terms, side="right")))
                if end <= begin and held:
                    yield pa.Table.from_batches(held)
                    held, docs, terms = [], 0, 0
                    continue
                end = min(max(end, begin + 1), batch.num_rows)
                held.append(batch.slice(begin, end - begin))
                docs, terms, begin = docs + end - begin, terms + int(ends[end - 1] - base), end
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        best: dict[int, tuple] = {}
        counts: Counter = Counter()
        for table in pieces(batches):
            table = table.combine_chunks()
            lists = table.column("__terms").chunk(0) if table.num_rows else None
            if lists is None:
                continue
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            terms = lists.flatten().to_numpy(zero_copy_only=False)
            tf = table.column("__tf").chunk(0).flatten().to_numpy(zero_copy_only=False)
            ids = table.column("__id")
            absent = ids.is_null().to_numpy()
            block = Block(ids.fill_null(0).to_numpy(), absent, ends, terms,
                          impacts(table.column("__n").to_pylist(), ends, tf, documents, total), items.root)
            tree = Tree(block, leaf)
            counts["all"] += len(tree.leaves) * (len(items.start) - 1)
            search_block(tree, items, best, counts)
        for item, (scores, absent, ids) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(ids), pa.int32()), pa.array(ids, mask=absent), pa.array(scores)], names=["__q", "__d", "__score"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([counts["leaves"]], pa.int64()), pa.array([counts["all"]], pa.int64())], names=["__q", "__d", "__score"])
    return run


def best_terms(shared, documents: int, total: int):
    """mapInArrow: rows with their three heaviest terms, by which similar documents come together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = shared.value.root
        for batch in batches:
            heavy = np.full((batch.num_rows, 3), -1, dtype=np.int32)
            for i in range(batch.num_rows):
                terms = batch.column("__terms")[i].values.to_numpy()
                tf = batch.column("__tf")[i].values.to_numpy()
                n = batch.column("__n")[i].as_py()
                w = impacts([n], np.array([len(terms)]), tf, documents, total) * root[terms] ** 2
                top = terms[np.lexsort((terms, -w))[:3]]
                heavy[i, :len(top)] = top
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(heavy[:, j]) for j in range(3)]], names=[*batch.schema.names, "__h0", "__h1", "__h2"])
    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", leaf: int = LEAF, block_docs: int = BLOCK_DOCS, block_terms: int = BLOCK_TERMS, item_entries: int = ITEM_ENTRIES,
           seed_docs: int = SEED_DOCS, visits: list | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score over 0 of each item. ``visits``, if given, is
    filled with (leaves scored, leaves in all, over items) of each block of items."""
    spark, kind = docs.sparkSession, items.schema[item_col].dataType.simpleString()
    read = items.select(F.col(item_col).alias("__item"), F.col(item_text).cast("string").alias("__text")).withColumn("__key", F.xxhash64("__text")) \
        .dropDuplicates(["__item", "__text"])
    asked = written(read.mapInArrow(item_terms, f"__item {kind}, __key long, __size long, __term binary, __times long"), "lexical-items")
    blocks = max(1, math.ceil(asked.count() / (item_entries / 2)))
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    answers = []
    for part in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("__item", "__key"), F.lit(blocks)) == part)
        answers.append(_answer(rows, block, k, leaf, block_docs, block_terms, seed_docs, visits))
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out.select(F.col("__item").alias("item_id"), "rank", F.col("__d").alias("doc_id"), F.col("__score").alias("score"))


def _answer(rows: DataFrame, block: DataFrame, k: int, leaf: int, block_docs: int, block_terms: int, seed_docs: int, visits: list | None) -> DataFrame:
    """The answers to one block of items, which is small enough for the driver and a broadcast."""
    spark = rows.sparkSession
    kind = block.schema["__item"].dataType.simpleString()
    entries = block.orderBy("__item", "__key", "__size", "__term").collect()
    if not entries:
        return spark.createDataFrame([], f"__item {kind}, rank int, __d long, __score long")
    vocabulary = {t: i for i, t in enumerate(sorted({bytes(r["__term"]) for r in entries}))}
    keys = sorted({(r["__item"] is None, r["__item"], r["__key"], r["__size"]) for r in entries}, key=repr)
    number = {key[1:]: i for i, key in enumerate(keys)}
    held = written(rows.mapInArrow(vectors(spark.sparkContext.broadcast(vocabulary)), "__id long, __n long, __terms array<int>, __tf array<long>"), "lexical-vectors")
    stats = held.agg(F.count_if(F.col("__n") > 0).alias("documents"), F.sum("__n").alias("total")).first()
    documents, total = stats["documents"], stats["total"] or 0
    df = np.zeros(max(1, len(vocabulary)), dtype=np.int64)
    for r in held.select(F.explode("__terms").alias("__t")).groupBy("__t").agg(F.count(F.lit(1)).alias("__df")).collect():     # a row for each term of the block at most
        df[r["__t"]] = r["__df"]
    w = np.array([weight(documents, int(n)) for n in df], dtype=np.int64)
    of = sorted((number[r["__item"], r["__key"], r["__size"]], vocabulary[bytes(r["__term"])], r["__times"]) for r in entries)
    of = [e for e in of if w[e[1]] > 0]                                             # weight 0 adds nothing
    start = np.searchsorted([e[0] for e in of], np.arange(len(keys) + 1)) if of else np.zeros(len(keys) + 1, dtype=np.int64)
    terms = np.array([e[1] for e in of], dtype=np.int64)
    query = Items(start, terms, np.array([int(w[t]) * n for _, t, n in of], dtype=np.int64), np.sqrt(np.maximum(w, 1)), np.zeros(len(keys), dtype=np.int64), k)
    schema = "__q int, __d long, __score long"
    some = held.filter(F.size("__terms") > 0)
    best = Window.partitionBy("__q").orderBy(F.desc("__score"), F.asc_nulls_last("__d"))

    def ranked(found: DataFrame) -> DataFrame:
        return found.filter("__q >= 0").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    walk = (documents, total, leaf, block_docs, block_terms)
    sample = some.filter(F.pmod(F.xxhash64("__id", "__n"), F.lit(max(1, math.ceil(documents / seed_docs)))) == 0)
    seeds = ranked(sample.mapInArrow(searched(spark.sparkContext.broadcast(query), *walk), schema)).filter(F.col("rank") == k)
    for r in seeds.collect():                                                       # one row for each item of the block at most
        query.least[r["__q"]] = r["__score"]
    shared = spark.sparkContext.broadcast(query)
    order = ["__h0", "__h1", "__h2", "__id", "__n"]
    near = some.mapInArrow(best_terms(shared, documents, total), "__id long, __n long, __terms array<int>, __tf array<long>, __h0 int, __h1 int, __h2 int") \
        .repartitionByRange(*order).sortWithinPartitions(*order)
    found = written(near.mapInArrow(searched(shared, *walk), schema), "lexical-found")
    if visits is not None:
        visits.append(tuple(n or 0 for n in found.filter("__q = -1").agg(F.sum("__d"), F.sum("__score")).first()))
    names = spark.createDataFrame([(i, key[1]) for i, key in enumerate(keys)], f"__n int, __item {kind}")
    return ranked(found).join(F.broadcast(names), F.col("__q") == F.col("__n")).select("__item", "rank", "__d", "__score")
