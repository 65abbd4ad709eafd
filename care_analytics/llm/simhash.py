"""SimHash near-dedup: fingerprints, links within a Hamming distance by the generalised
pigeonhole principle, components.

Method. A text's fingerprint is the bitwise majority of its shingle hashes. Equal fingerprints
are first reduced to one row. For distinct ones, the correlation of all bit
pairs is counted over the whole table; correlated bits are put in one partition. If the
thresholds of the partitions (each -1 or more) sum to ``max_distance - partitions + 1``, two
fingerprints within ``max_distance`` agree within the threshold in one of them, whatever
the choice. Each fingerprint takes its own cheapest choice by dynamic programming
on estimated candidate counts (histograms of 8-bit blocks over the whole table, taken
as independent between blocks), probes the partitions at every value within its
thresholds, and candidates are verified on all 64 bits. The number of partitions is the one of least
estimated total.

Crowded partition values (over ``CROWD`` distinct fingerprints) are not paired. All fingerprints
that lie in or probe such a value are linked exactly through midpoints instead: two
values within an even distance 2r share a value within r of both, so each emits all values
within r of itself, and all that meet at a value link to the least of them. The work
is linear in the fingerprints and no group is gathered or paired.

What reaches the driver has a fixed size (64 x 64 bit counts, 256-cell histograms, one cost
per number of partitions).

Defined cases: a null or empty text, or one without words, has fingerprint zero and links like
any other; fewer words than a shingle count as one shingle; repeated rows get equal
results; an empty table gives an empty result; ``max_distance`` must be even.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from care_analytics.llm.common import components, slices, text_or_empty, written

SHINGLE_WORDS = 3
MAX_DISTANCE = 2
SEED = 42
CROWD = 64                 # distinct fingerprints a partition value may hold and still be paired
PARTITIONS = (2, 3, 4)     # numbers of partitions that are weighed
BLOCK_BITS = 8
CHUNK_BYTES = 8_000_000
HASHES = 1 << 17           # shingle hashes counted at once


def _words(text: str) -> list[bytes]:
    """Words of ``text`` with A-Z lower-cased (bytes methods touch ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def fingerprints_of(texts: list[str], words: int) -> np.ndarray:
    """Fingerprint of each text, unsigned 64-bit."""
    digest = partial(xxhash.xxh64_digest, seed=SEED)
    ones = np.zeros((len(texts), 64), np.int64)
    total = np.zeros(len(texts), np.int64)
    held: list[bytes] = []
    owner: list[int] = []
    sizes: list[int] = []

    def count() -> None:
        bits = np.unpackbits(np.frombuffer(b"".join(held), np.uint8)).view(np.uint64).reshape(-1, 8)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        cuts = np.unique(np.concatenate([np.arange(a, b, 255) for a, b in zip(starts, ends)]))   # byte lanes hold 255
        lanes = np.add.reduceat(bits, cuts, axis=0).view(np.uint8).reshape(-1, 64)
        who = np.array(owner)[np.searchsorted(ends, cuts, side="right")]
        np.add.at(ones, who, lanes)
        held.clear(), owner.clear(), sizes.clear()

    held_n = 0
    for i, text in enumerate(texts):
        tokens = _words(text)
        if not tokens:
            continue
        if len(tokens) < words:
            shingles: Iterator[bytes] = iter([b" ".join(tokens)])
            n = 1
        else:
            shingles = map(b" ".join, zip(*(tokens[k:] for k in range(words))))
            n = len(tokens) - words + 1
        total[i] = n
        done = 0
        while done < n:
            take = min(n - done, HASHES - held_n)
            held.append(b"".join(map(digest, islice(shingles, take))))
            owner.append(i), sizes.append(take)
            done, held_n = done + take, held_n + take
            if held_n >= HASHES:
                count()
                held_n = 0
    if held:
        count()
    return np.packbits(ones * 2 > total[:, None], axis=1).view(">u8").reshape(-1).astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 words: int = SHINGLE_WORDS) -> DataFrame:
    """(__id, __fp long) for each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, batch.column(1), CHUNK_BYTES):
                fp = fingerprints_of(texts, words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], names=["__id", "__fp"])

    schema = T.StructType([T.StructField("__id", docs.schema[id_col].dataType), T.StructField("__fp", T.LongType())])
    return docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text")).mapInArrow(run, schema)


def _bits(fps: np.ndarray) -> np.ndarray:
    """(n, 64) zeros and ones; column b is the bit of weight 2^b."""
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)


def bit_pairs(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows, and how many have both bits i and j (64 x 64)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((64, 64)), 0
        for fp in _columns(batches):
            bits = _bits(fp).astype(np.float32)
            both += bits.T @ bits
            n += len(fp)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(4097, dtype=np.int32)), pa.array(np.r_[both.reshape(-1), n].astype(np.int64))],
                names=["cell", "n"])

    rows = fps.select("__fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(4097)
    for r in rows:                                             # 4,097 rows at most
        flat[r["cell"]] = r["n"]
    return int(flat[4096]), flat[:4096].reshape(64, 64)


def partitions_of(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """``m`` partitions of the 64 bits, correlated bits together: each starts with the most
    correlated pair left and takes the bit most correlated with it until it is full."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    scale = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    phi = np.abs(cov / np.outer(scale, scale))
    np.fill_diagonal(phi, 0)
    left, out = list(range(64)), []
    for k in range(m):
        size = len(left) // (m - k)
        sub = phi[np.ix_(left, left)]
        group = [left[int(sub.sum(axis=1).argmax())]] if len(left) < 2 else [left[i] for i in np.unravel_index(sub.argmax(), sub.shape)]
        group = list(dict.fromkeys(group))[:size]
        while len(group) < size:
            rest = [b for b in left if b not in group]
            group.append(rest[int(phi[np.ix_(rest, group)].sum(axis=1).argmax())])
        out.append(group)
        left = [b for b in left if b not in group]
    return out


@dataclass
class Cover:
    """A set of partitions and, per 8-bit block of a partition, the histogram of its values."""

    groups: list[list[int]]
    max_distance: int
    near: list[list[np.ndarray]] | None = None     # [partition][block][value, e]: share of rows at distance e
    rows: int = 0

    def blocks(self, k: int) -> list[list[int]]:
        g = self.groups[k]
        return [g[i:i + BLOCK_BITS] for i in range(0, len(g), BLOCK_BITS)]

    def values(self, bits: np.ndarray, k: int) -> list[np.ndarray]:
        return [bits[:, b].astype(np.int64) @ (1 << np.arange(len(b))) for b in self.blocks(k)]

    def mask(self, k: int) -> int:
        return sum(1 << b for b in self.groups[k])

    def flips(self, k: int, distance: int) -> np.ndarray:
        """Every change of exactly ``distance`` bits of partition ``k``."""
        return np.array([sum(1 << b for b in c) for c in combinations(self.groups[k], distance)] if distance else [0], np.uint64)

    def learn(self, histograms: list[list[np.ndarray]], rows: int) -> None:
        far = np.array([[bin(a ^ b).count("1") for b in range(256)] for a in range(256)])
        at = [(far == e).astype(float) for e in range(self.max_distance + 1)]
        self.rows = rows
        self.near = [[np.stack([a @ h for a in at], axis=1) / max(rows, 1) for h in blocks] for blocks in histograms]

    def costs(self, bits: np.ndarray) -> np.ndarray:
        """(n, partitions, max_distance + 2): probes and estimated candidates at thresholds -1, 0, ..."""
        t = self.max_distance
        out = np.zeros((len(bits), len(self.groups), t + 2))
        for k in range(len(self.groups)):
            share = None
            for value, near in zip(self.values(bits, k), self.near[k]):
                here = near[value]
                share = here if share is None else np.stack(
                    [sum(share[:, a] * here[:, e - a] for a in range(e + 1)) for e in range(t + 1)], axis=1)
            probes = np.cumsum([len(self.flips(k, e)) for e in range(t + 1)])
            out[:, k, 1:] = probes + self.rows * np.cumsum(share, axis=1)
        return out

    def thresholds(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, partitions) thresholds of least cost that sum to max_distance - partitions + 1, and the cost."""
        cost, t = self.costs(bits), self.max_distance
        n, m, _ = cost.shape
        best, back = np.full((n, t + 2), np.inf), np.zeros((m, n, t + 2), np.int64)
        best[:, 0] = 0
        for k in range(m):
            grown = np.full((n, t + 2), np.inf)
            for units in range(t + 2):
                options = np.stack([best[:, units - u] + cost[:, k, u] for u in range(units + 1)], axis=1)
                back[k, :, units] = options.argmin(axis=1)
                grown[:, units] = options.min(axis=1)
            best = grown
        chosen, units = np.zeros((n, m), np.int64), np.full(n, t + 1)
        for k in range(m - 1, -1, -1):
            chosen[:, k] = back[k, np.arange(n), units]
            units = units - chosen[:, k]
        return chosen - 1, best[:, t + 1]


def plan_cover(fps: DataFrame, max_distance: int) -> Cover | None:
    """The cheapest cover for the whole table of distinct fingerprints (None for an empty one)."""
    n, both = bit_pairs(fps)
    if not n:
        return None
    covers = [Cover(partitions_of(n, both, m), max_distance) for m in PARTITIONS]
    index = [(c, k, b) for c, cover in enumerate(covers) for k in range(len(cover.groups)) for b in range(len(cover.blocks(k)))]

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(index), 256), np.int64)
        for fp in _columns(batches):
            bits, row = _bits(fp), 0
            for cover in covers:
                for k in range(len(cover.groups)):
                    for value in cover.values(bits, k):
                        counts[row] += np.bincount(value, minlength=256)
                        row += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts.reshape(-1)[at])], names=["cell", "n"])

    flat = np.zeros(len(index) * 256, np.int64)
    for r in fps.select("__fp").mapInArrow(histogram, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        flat[r["cell"]] = r["n"]                               # 256 cells a block at most
    tables = iter(flat.reshape(-1, 256))
    for cover in covers:
        cover.learn([[next(tables) for _ in cover.blocks(k)] for k in range(len(cover.groups))], n)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = np.zeros(len(covers))
        for fp in _columns(batches):
            bits = _bits(fp)
            cost += [c.thresholds(bits)[1].sum() for c in covers]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(covers), dtype=np.int32)), pa.array(cost)], names=["cell", "n"])

    costs = fps.select("__fp").mapInArrow(total, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    return covers[min(costs, key=lambda r: (r["n"], r["cell"]))["cell"]]


def probes_of(fps: DataFrame, cover: Cover) -> DataFrame:
    """(__part, __key, __fp): every partition value that a fingerprint looks up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp in _columns(batches):
            limits, _ = cover.thresholds(_bits(fp))
            for k in range(len(cover.groups)):
                home = fp & np.uint64(cover.mask(k))
                for e in range(cover.max_distance + 1):
                    who = np.flatnonzero(limits[:, k] >= e)
                    flips = cover.flips(k, e)
                    for part in np.array_split(who, max(1, len(who) * len(flips) // 500_000 + 1)):
                        if len(part):
                            keys = (home[part][:, None] ^ flips[None, :]).reshape(-1)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(keys), k, np.int32)), pa.array(keys.view(np.int64)),
                                 pa.array(np.repeat(fp[part], len(flips)).view(np.int64))], names=["__part", "__key", "__fp"])

    return fps.select("__fp").mapInArrow(run, "__part int, __key long, __fp long")


def links(fps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """Edges (a, b) among distinct fingerprints ``fps(__fp)`` whose components are those of all pairs
    within ``max_distance``; every edge joins two fingerprints within that distance."""
    if max_distance % 2:
        raise ValueError("max_distance must be even")
    spark = fps.sparkSession
    cover = plan_cover(fps, max_distance)
    if cover is None:
        return spark.createDataFrame([], "a long, b long")
    masks = [np.uint64(cover.mask(k)).astype(np.int64).item() for k in range(len(cover.groups))]
    index = fps.select("__fp", F.explode(F.array(*[
        F.struct(F.lit(k).alias("__part"), F.col("__fp").bitwiseAND(F.lit(m)).alias("__key")) for k, m in enumerate(masks)])).alias("__x")) \
        .select(F.col("__x.__part").alias("__ipart"), F.col("__x.__key").alias("__ikey"), F.col("__fp").alias("__ifp"))
    probes = written(probes_of(fps, cover), "simhash-probes")
    crowded = written(index.groupBy("__ipart", "__ikey").agg(F.count(F.lit(1)).alias("__n"))
                      .filter(F.col("__n") > CROWD).select(F.col("__ipart").alias("__cpart"), F.col("__ikey").alias("__ckey")), "simhash-crowded")
    in_crowd = (F.col("__part") == F.col("__cpart")) & (F.col("__key") == F.col("__ckey"))
    pairs = probes.join(crowded, in_crowd, "left_anti") \
        .join(index, (F.col("__part") == F.col("__ipart")) & (F.col("__key") == F.col("__ikey"))) \
        .filter((F.col("__fp") != F.col("__ifp")) & (F.bit_count(F.col("__fp").bitwiseXOR(F.col("__ifp"))) <= max_distance)) \
        .select(F.greatest("__fp", "__ifp").alias("a"), F.least("__fp", "__ifp").alias("b")).distinct()
    dense = probes.join(crowded, in_crowd, "left_semi").select("__fp").union(
        index.join(crowded, (F.col("__ipart") == F.col("__cpart")) & (F.col("__ikey") == F.col("__ckey")), "left_semi").select("__ifp")).distinct()
    return pairs.union(midpoint_links(dense, max_distance))


def midpoint_links(fps: DataFrame, max_distance: int) -> DataFrame:
    """Edges (a, b) that connect all of ``fps(__fp)`` within ``max_distance`` of one another (each edge within it)."""
    flips = [sum(1 << b for b in c) for e in range(max_distance // 2 + 1) for c in combinations(range(64), e)]
    signed = np.array(flips, np.uint64).view(np.int64).tolist()
    middle = fps.select("__fp", F.explode(F.array(*[F.lit(x) for x in signed])).alias("__x")) \
        .select("__fp", F.col("__fp").bitwiseXOR(F.col("__x")).alias("__mid"))
    least = middle.groupBy("__mid").agg(F.min("__fp").alias("__least"), F.count(F.lit(1)).alias("__n")) \
        .filter("__n > 1").select(F.col("__mid").alias("__m"), "__least")
    return middle.join(least, F.col("__mid") == F.col("__m")).filter("__fp <> __least") \
        .select(F.col("__fp").alias("a"), F.col("__least").alias("b")).distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
               max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per input row: (id, fingerprint 16 hex digits, component_id, the smallest id reachable)."""
    fps = written(fingerprints(docs, id_col, text_col, words), "simhash-fingerprints")
    distinct = written(fps.groupBy("__fp").agg(F.min("__id").alias("__least")), "simhash-distinct")
    roots = components(links(distinct.select("__fp"), max_distance))
    named = roots.join(distinct, F.col("node") == F.col("__fp")).groupBy("root").agg(F.min("__least").alias("__component"))
    of_node = roots.join(named.withColumnRenamed("root", "__root"), F.col("root") == F.col("__root")).select("node", "__component")
    table = written(distinct.join(of_node, F.col("__fp") == F.col("node"), "left")
                    .select(F.col("__fp").alias("__tfp"), F.coalesce("__component", "__least").alias("component_id")), "simhash-table")
    return fps.join(table, F.col("__fp") == F.col("__tfp")) \
        .select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")
