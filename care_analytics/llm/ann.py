"""Approximate nearest neighbours by multiprobe p-stable hashing.

Method. Nearness is the largest inner product. Vectors are put into bands of equal length of vector and of norm (powers
of two); within a band of largest norm M a candidate x becomes (x / M, sqrt(1 - |x|^2 / M^2)) and a query q becomes
(q / |q|, 0), so that the Euclidean distance of the two falls as the inner product grows. Each of ``TABLES`` tables hashes a
candidate by k functions floor((a.x + b) / W) with Gaussian (2-stable) a. A neighbour at distance r differs from its query by N(0, r^2) along every a,
which gives each slot of each function a probability and each bucket their product. A query visits the buckets in order
of that product, its own and perturbed ones alike, until they hold ``MASS`` of the probability in each table; there is no
cap on their number. W, r and k are fitted on about ``SAMPLE`` rows of each band (chosen by hash of the id): r is the 0.9 quantile of
the distance to the nearest rows within the sample, which is larger than in the whole band, and k makes the work least, a
visit counted as ``VISIT`` inner products. Every row is indexed.

The visits come in two rounds, the likeliest buckets first (up to ``FIRST`` of the probability). What a query finds there bounds what
a later bucket has to offer: of its candidates only those that beat the query's worst so far are sent on.

Rows that share a bucket are packed into blocks of at most ``BLOCK`` vectors, dealt by (bucket, id), and so are the queries of a task that
visit it. A bucket that holds a third of all rows is many blocks; blocks meet blocks in one join, each pair gives the best of its block
for each query, and the tables' candidates are merged by id. Equal vectors are one class, of which the k + 1 smallest ids
can ever be in a result. A query that finds too few candidates visits all buckets of one table, which is exact.
Nothing is collected.

Defined cases: rows whose id is null, or whose vector is null, empty, zero or holds a null or a non-finite component, take no
part. Of rows that share an id the least vector in array order counts. Vectors of different length are never compared.
Equal scores rank by the smaller id. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from care_analytics.llm.common import written

TABLES = 2
VISIT = 1000         # inner products that cost as much as a visit of a bucket
FIRST = 0.2          # probability of the buckets that are visited first
MASS = 0.65          # probability that the visited buckets of one table hold a neighbour
SAMPLE = 2048        # rows of a band on which W, r and k are fitted
BLOCK = 256          # vectors that are scored together
WIDTH = 2.0          # W in standard deviations of the projections
MOST = 24            # functions of a table
SEED = 20_240
HELD = 1_000_000     # rows that a task merges before it sends them on
KEY = ["__dim", "__band", "__table", "__bucket"]

_erf = np.frompyfunc(math.erf, 1, 1)


def projections(dim: int, table: int, k: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """k Gaussian directions over dim + 1 coordinates, and their offsets: the same on every executor."""
    rng = np.random.default_rng([SEED, dim, table])
    return rng.standard_normal((MOST, dim + 1))[:k], rng.random(MOST)[:k] * width


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Candidates with the coordinate that turns inner products into distances."""
    unit = x / most
    return np.hstack([unit, np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(axis=1)))[:, None]])


def directed(q: np.ndarray) -> np.ndarray:
    q = q / np.abs(q).max(axis=1, keepdims=True)
    return np.hstack([q / np.sqrt((q * q).sum(axis=1, keepdims=True)), np.zeros((len(q), 1))])


def bucket_ids(slots: np.ndarray) -> np.ndarray:
    """64-bit numbers of rows of slots. Two buckets that share a number are one bucket, which adds candidates only."""
    out = np.full(len(slots), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for column in slots.T:
        out = (out ^ (column.astype(np.int64).astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def success_order(place: np.ndarray, width: float, near: float, mass: float) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the buckets to visit and their probabilities, largest first, until they sum to ``mass``.

    ``place`` is the query's a.q + b for each function. All buckets of at least some probability are listed by extending
    partial products (a partial below it cannot rise again); the bound falls until the list holds the mass.
    """
    home = np.floor(place / width).astype(np.int64)
    reach = max(1, math.ceil(3.0 * near / width))
    step = np.arange(-reach, reach + 2)
    edges = (home[:, None] + step[None, :]) * width - place[:, None]
    cdf = 0.5 * (1.0 + _erf(edges / (near * math.sqrt(2.0))).astype(float))
    chance = np.diff(cdf, axis=1)
    held = float(np.prod(chance.sum(axis=1)))
    least = float(np.prod(chance.max(axis=1))) * (1 - 1e-9)
    while True:
        product, slots = np.ones(1), np.zeros((1, 0), dtype=np.int64)
        for i in range(len(place)):
            grown = product[:, None] * chance[i][None, :]
            at, d = np.nonzero(grown >= least)
            product, slots = grown[at, d], np.hstack([slots[at], (home[i] + step[d])[:, None]])
        if product.sum() >= mass * held or least < 1e-300:
            order = np.argsort(-product, kind="stable")
            upto = int(np.searchsorted(np.cumsum(product[order]), mass * held)) + 1
            return slots[order[:upto]], product[order[:upto]]
        least *= 0.6


def fitted(x: np.ndarray, near_th: int, rows: int, mass: float) -> tuple[float, float, int]:
    """(W, r, k) of a band from a sample of its rows, scaled to the largest norm."""
    dim = x.shape[1]
    up, q = lifted(x, max(1.0, np.sqrt((x * x).sum(axis=1)).max())), directed(x[:256])
    a, b = projections(dim, 0, MOST, 1.0)
    width = max(WIDTH * float((up @ a.T).std()), 1e-3)
    near = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (q @ up.T)))
    near.sort(axis=1)
    r = max(float(np.quantile(near[:, min(near_th + 1, near.shape[1] - 1)], 0.9)), 1e-3)
    slots, places = np.floor((up @ a.T + b * width) / width), q[:24] @ a.T + b * width
    best, cost = 1, math.inf
    for k in range(1, MOST + 1):
        ids = bucket_ids(slots[:, :k])
        found = [bucket_ids(success_order(p[:k], width, r, mass)[0]) for p in places]
        now = float(np.mean([len(f) + np.isin(ids, f).mean() * rows / VISIT for f in found]))
        if now >= 2 * cost:
            break
        if now < cost:
            best, cost = k, now
    return width, r, best


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(__id, __vec, __dim, __norm, __band) of the rows that take part, one for each id."""
    kind = rows.schema[vec_col].dataType.elementType
    vec = F.col(vec_col) if isinstance(kind, (T.FloatType, T.DoubleType)) else F.col(vec_col).cast("array<double>")
    least = rows.select(F.col(id_col).cast("long").alias("__id"), vec.alias("__vec")) \
        .filter("__id is not null and exists(__vec, x -> x <> 0) and forall(__vec, x -> x is not null and x > -double('inf') and x < double('inf'))") \
        .groupBy("__id").agg(F.min("__vec").alias("__vec"))
    most = least.withColumn("__most", F.expr("double(greatest(array_max(__vec), -array_min(__vec)))"))
    norm = F.expr("__most * sqrt(aggregate(__vec, 0d, (acc, x) -> acc + (x / __most) * (x / __most)))")
    return most.select("__id", "__vec", F.size("__vec").alias("__dim"), norm.alias("__norm")) \
        .withColumn("__band", F.round(F.log2("__norm")).cast("int"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim).astype(np.float64)


def parts(batch: pa.RecordBatch, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with equal values of ``names``."""
    if not batch.num_rows:
        return
    new = np.zeros(batch.num_rows, dtype=bool)
    for name in names:
        v = batch.column(name).to_numpy(zero_copy_only=False)
        new[1:] |= v[1:] != v[:-1]
    cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
    for begin, end in zip(cuts, cuts[1:]):
        if end > begin:
            yield batch.slice(begin, end - begin)


def parameters(classes: DataFrame, near_th: int, mass: float) -> DataFrame:
    """A row for each band: its rows, largest norm, W, r and k."""
    sizes = classes.groupBy("__dim", "__band").agg(F.count(F.lit(1)).alias("__rows"), F.max("__norm").alias("__most"))
    sample = classes.join(F.broadcast(sizes), ["__dim", "__band"]) \
        .filter(F.pmod(F.xxhash64("__id"), F.ceil(F.col("__rows") / SAMPLE)) == 0).select("__dim", "__band", "__rows", "__most", "__vec")

    def fit(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).select(["__dim", "__band", "__rows", "__most"])
        at = first.to_pylist()[0]
        fits = fitted(matrix(table.column("__vec").combine_chunks(), at["__dim"]) / at["__most"], near_th, at["__rows"], mass)
        for name, value in zip(("__width", "__near", "__k"), fits):
            first = first.append_column(name, pa.array([value]))
        return first
    return written(sample.groupBy("__dim", "__band").applyInArrow(
        fit, "__dim int, __band int, __rows long, __most double, __width double, __near double, __k long"), "ann-bands")


def bands_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, dict]]:
    for part in parts(batch.sort_by([("__dim", "ascending"), ("__band", "ascending")]), ["__dim", "__band"]):
        yield part, part.slice(0, 1).select(["__dim", "__band", "__most", "__width", "__near", "__k"]).to_pylist()[0]


def indexed(tables: int):
    """mapInArrow: candidates with their band's parameters -> one row for each table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, band in bands_of(batch):
                x = lifted(matrix(part.column("__vec"), band["__dim"]), band["__most"])
                for table in range(tables):
                    a, b = projections(band["__dim"], table, band["__k"], band["__width"])
                    yield pa.RecordBatch.from_arrays(
                        [part.column("__dim"), part.column("__band"), pa.array(np.full(part.num_rows, table, np.int32)),
                         pa.array(bucket_ids(np.floor((x @ a.T + b) / band["__width"]))), part.column("__id"), part.column("__vec")], names=[*KEY, "__id", "__vec"])
    return run


def probed(tables: int, after: float, mass: float):
    """mapInArrow: queries (__id, __vec, __least), each with the parameters of a band -> blocks of queries for the buckets that
    hold their probability from ``after`` to ``mass``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for whole, band in bands_of(batch):
                for begin in range(0, whole.num_rows, 1024):
                    part = whole.slice(begin, 1024)
                    q = directed(matrix(part.column("__vec"), band["__dim"]))
                    rows = []
                    for table in range(tables):
                        a, b = projections(band["__dim"], table, band["__k"], band["__width"])
                        for i, place in enumerate(q @ a.T + b):
                            ids = bucket_ids(success_order(place, band["__width"], band["__near"], mass)[0])
                            if after:
                                ids = ids[len(success_order(place, band["__width"], band["__near"], after)[0]):]
                            ids = np.unique(ids)
                            rows.append((np.full(len(ids), table, np.int32), ids, np.full(len(ids), i)))
                    table, bucket, at = (np.concatenate(c) for c in zip(*rows))
                    order = np.lexsort((at, bucket, table))
                    taken = pa.array(at[order])
                    yield from blocks([pa.RecordBatch.from_arrays(
                        [part.column("__dim").take(taken), part.column("__band").take(taken), pa.array(table[order]), pa.array(bucket[order]),
                         part.column("__id").take(taken), part.column("__vec").take(taken), part.column("__least").take(taken)],
                        names=[*KEY, "__id", "__vec", "__least"])], BLOCK, "q")
    return run


def blocks(batches, size: int, prefix: str) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their buckets -> blocks of at most ``size`` vectors of one bucket."""
    for batch in batches:
        least = "__least" in batch.schema.names
        rows = {name: [] for name in [*KEY, "ids", "vecs", *(["least"] if least else [])]}
        for part in parts(batch, KEY):
            head = part.slice(0, 1).select(KEY).to_pylist()[0]
            for begin in range(0, part.num_rows, size):
                piece = part.slice(begin, size)
                for name in KEY:
                    rows[name].append(head[name])
                rows["ids"].append(piece.column("__id").to_numpy())
                rows["vecs"].append(piece.column("__vec").flatten().to_numpy(zero_copy_only=False).tobytes())
                if least:
                    rows["least"].append(piece.column("__least").to_numpy())
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)],
                                         names=[*KEY, *[f"__{prefix}{name}" for name in list(rows)[len(KEY):]]])


KEYS = "__dim int, __band int, __table int, __bucket long"


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Candidates dealt and sorted by (bucket, id), so that a large bucket spreads over tasks, then packed."""
    return rows.repartitionByRange(*KEY, "__id").sortWithinPartitions(*KEY, "__id") \
        .mapInArrow(lambda batches: blocks(batches, size, "x"), KEYS + ", __xids array<long>, __xvecs binary")


def best_of(k_th: int, q: np.ndarray, x: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (query, candidate, score) the ``k_th`` best different candidates of each query, by query and score."""
    order = np.lexsort((x, -score, q))
    q, x, score = q[order], x[order], score[order]
    new = np.ones(len(q), dtype=bool)
    new[1:] = (q[1:] != q[:-1]) | (x[1:] != x[:-1])                    # equal pairs have equal scores, so they are neighbours
    q, x, score = q[new], x[new], score[new]
    good = np.arange(len(q)) - np.searchsorted(q, q) < k_th
    return q[good], x[good], score[good]


def listed(q: np.ndarray, x: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    """One row for each query of rows sorted by query: (__q, __xs, __scores)."""
    starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, dtype=np.int64)
    offsets = pa.array(np.append(starts, len(q)), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(q[starts], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())),
                                       pa.ListArray.from_arrays(offsets, pa.array(score, pa.float64()))], names=["__q", "__xs", "__scores"])


LISTS = "__q long, __xs array<long>, __scores array<double>"


def merged(k_th: int):
    """mapInArrow: lists in the order of their queries -> the ``k_th`` best of each query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        for batch in batches:
            xs = batch.column("__xs")
            q = np.repeat(batch.column("__q").to_numpy(), xs.value_lengths().to_numpy(zero_copy_only=False))
            rows = (q, xs.flatten().to_numpy(zero_copy_only=False), batch.column("__scores").flatten().to_numpy(zero_copy_only=False))
            held = best_of(k_th, *[np.concatenate(c) for c in zip(held, rows)])
            if len(held[0]):
                open_at = np.searchsorted(held[0], held[0][-1])               # the last query may go on in the next batch
                yield listed(*[c[:open_at] for c in held])
                held = tuple(c[open_at:] for c in held)
        yield listed(*held)
    return run


def reranked(k_th: int, single: bool):
    """mapInArrow: pairs of blocks -> for each query of the task a list of the ``k_th`` best candidates by exact inner product, of those
    that reach its least score. A product of matrices chooses them, with a margin for its rounding; the scores are summed for each pair alike."""
    kind = np.float32 if single else np.float64

    def pair(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dim = batch.column("__dim")[i].as_py()
        q, x = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=kind).reshape(-1, dim).astype(np.float64) for c in ("__qvecs", "__xvecs"))
        qids, xids, least = (batch.column(c)[i].values.to_numpy() for c in ("__qids", "__xids", "__qleast"))
        rough = q @ x.T
        margin = dim * 2.0 ** -50 * np.sqrt((q * q).sum(axis=1) * (x * x).sum(axis=1).max())
        bar = least
        if len(x) > k_th:
            bar = np.maximum(bar, np.partition(rough, len(x) - k_th, axis=1)[:, len(x) - k_th])
        at, to = np.nonzero(rough >= (bar - 2 * margin)[:, None])
        score = (q[at] * x[to]).sum(axis=1)
        good = score >= least[at]
        return best_of(k_th, qids[at[good]], xids[to[good]], score[good])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0                                                  # a task merges what its blocks give for a query
        for batch in batches:
            for i in range(batch.num_rows):
                held.append(pair(batch, i))
                size += len(held[-1][0])
                if size > HELD:
                    held = [best_of(k_th, *map(np.concatenate, zip(*held)))]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield listed(*held[0])
                        held, size = [], 0
        if size:
            yield listed(*best_of(k_th, *map(np.concatenate, zip(*held))))
    return run


def nearest(visits: DataFrame, index: DataFrame, k_th: int, single: bool, known: DataFrame | None = None) -> DataFrame:
    """(__q, __xs, __scores): of the candidates that the visited buckets hold (and those ``known``), the ``k_th`` best of each query."""
    lists = visits.join(index, KEY).select("__dim", "__qids", "__qvecs", "__qleast", "__xids", "__xvecs").mapInArrow(reranked(k_th, single), LISTS)
    if known is not None:
        lists = lists.unionByName(known)
    return lists.repartition("__q").sortWithinPartitions("__q").mapInArrow(merged(k_th), LISTS)


def search(rows: DataFrame, is_query: str, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", tables: int = TABLES,
           mass: float = MASS, first: float = FIRST, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id meets the SQL condition ``is_query`` (over ``__id``) the ``k`` nearest rows found."""
    found = written(usable(rows, id_col, vec_col), "ann-rows")
    kind = found.schema["__vec"].dataType
    single, visit = isinstance(kind.elementType, T.FloatType), KEYS + ", __qids array<long>, __qvecs binary, __qleast array<double>"
    alike = Window.partitionBy("__vec").orderBy("__id")
    # Classes of equal vectors: the least id, and the k + 1 least of a class, which are all that a result can hold.
    members = written(found.withColumn("__n", F.row_number().over(alike)).filter(F.col("__n") <= k + 1)
                      .withColumn("__class", F.min("__id").over(Window.partitionBy("__vec"))), "ann-members")
    classes = members.filter("__n = 1")
    bands = parameters(classes, k, mass)
    of_band = [c for c in bands.columns if c not in ("__dim", "__band", "__rows")]
    index = written(packed(classes.select("__id", "__vec", "__dim", "__band").join(bands, ["__dim", "__band"])
                           .select("__id", "__vec", "__dim", "__band", *of_band).mapInArrow(indexed(tables), KEYS + f", __id long, __vec {kind.simpleString()}"), block), "ann-index")
    queries = found.filter(is_query).select("__id", "__vec", "__dim")

    def visits(asked: DataFrame, after: float, upto: float) -> DataFrame:
        return asked.join(bands, "__dim").select("__id", "__vec", "__least", "__dim", "__band", *of_band).mapInArrow(probed(tables, after, upto), visit)
    lowest = F.lit(float("-inf")).alias("__least")
    start = written(nearest(visits(queries.select("*", lowest), 0.0, min(first, mass)), index, k + 1, single), "ann-first")
    bar = start.filter(F.size("__xs") == k + 1).select(F.col("__q").alias("__bq"), F.element_at("__scores", -1).alias("__bar"))
    barred = queries.join(bar, F.col("__id") == F.col("__bq"), "left").select("__id", "__vec", "__dim", F.coalesce("__bar", lowest).alias("__least"))
    done = written(nearest(visits(barred, min(first, mass), mass), index, k + 1, single, start), "ann-found")
    full = done.filter(F.size("__xs") == k + 1).select("__q")
    if full.count() < queries.count():
        # Queries that found too few (all of a small table do) visit every bucket of one table.
        short = written(queries.join(full, F.col("__id") == F.col("__q"), "left_anti").select("*", lowest), "ann-short")
        one = index.filter("__table = 0")
        every = short.join(one.select(*KEY).distinct(), "__dim").select(*KEY, "__id", "__vec", "__least") \
            .repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(lambda batches: blocks(batches, BLOCK, "q"), visit)
        again = nearest(every, one, k + 1, single)
        done = done.join(short.select(F.col("__id").alias("__s")), F.col("__q") == F.col("__s"), "left_anti").unionByName(again)
    # Classes become rows again; the query itself is none of its neighbours.
    more = members.filter("__n > 1").select(F.col("__class").alias("__c"), F.col("__id").alias("__member"))
    done = done.select("__q", F.explode(F.arrays_zip("__xs", "__scores")).alias("__e")).select("__q", F.col("__e.__xs").alias("__x"), F.col("__e.__scores").alias("__score"))
    rows_of = done.select("__q", F.col("__x").alias("__member"), "__score") \
        .unionByName(done.join(more, F.col("__x") == F.col("__c")).select("__q", "__member", "__score")).filter("__member <> __q")
    last = Window.partitionBy("__q").orderBy(F.desc("__score"), "__member")
    return rows_of.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k) \
        .select(F.col("__q").alias("query_id"), "rank", F.col("__member").alias("vec_id"), F.col("__score").alias("score"))
