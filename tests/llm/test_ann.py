import math

import numpy as np
import pytest

from care_analytics.llm import ann


def brute(rows, k):
    """Exact lists by query id; rows that share an id count with their least vector."""
    least = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            least[i] = min(least.get(i, list(v)), list(v))
    out = {}
    for q in (i for i in least if i % 20 == 0):
        scored = sorted((-math.fsum(a * b for a, b in zip(least[q], v)), i) for i, v in least.items() if i != q and len(v) == len(least[q]))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def same(got, want):
    assert set(got) == {q for q in want if want[q]}
    for q in got:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)


def test_query_reaches_the_recall(spark, small):
    from care_analytics.llm.queries.ann import op11_nearest_neighbours
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got, want = found(op11_nearest_neighbours(spark, small)), brute(rows, 20)
    assert set(got) == set(want) and all(len(got[q]) == min(20, len(rows) - 1) for q in got)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]) >= 0.9


def test_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(120)]                     # many ties and equal vectors
    rows += [(200, [1e200, 0.0, 0.0, 0.0]), (201, [1e-200, 1e-200, 0.0, 0.0]), (220, [0.0, 0.0, 0.0, -5.0])]   # far norms
    rows += [(300, None), (320, []), (340, [0.0] * 4), (360, [1.0, None, 1.0, 1.0]), (380, [1.0, math.nan, 0.0, 0.0]),
             (400, [math.inf, 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    rows += [(420, [1.0, 2.0]), (421, [3.0, 1.0]), (440, [1.0, 2.0, 3.0])]                            # other lengths; a query alone
    rows += [(3, [9.0, 9.0, 9.0, 9.0]), rows[5]]                                                      # an id twice; a row twice
    docs = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, rank string")
    got = found(ann.search(docs, "__id % 20 = 0", 20, mass=0.999999))
    same(got, brute(rows, 20))


def test_equal_vectors_and_a_hot_vector(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 0.5, 0.25] if i % 3 == 0 else rng.standard_normal(3).tolist()) for i in range(900)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(ann.search(docs, "__id % 20 = 0", 20, mass=0.999999, block=16))
    same(got, brute(rows, 20))
    assert got[0][0][1] >= got[0][-1][1] and 0 not in {i for i, _ in got[0]}


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 2.0]), (20, [2.0, 1.0]), (7, [1.0, 1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    same(found(ann.search(docs, "__id % 20 = 0", 20)), brute(rows, 20))
    assert ann.search(docs.limit(0), "__id % 20 = 0", 20).count() == 0


def test_queries_with_too_few_candidates_visit_all_buckets(spark):
    """Visits of nearly no bucket: what they lack, the exact way brings."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(60)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, 59)
    got = found(ann.search(docs, "__id % 20 = 0", 59, mass=0.05, tables=1))
    same(got, want)


@pytest.mark.parametrize("mass", [0.3, 0.9])
def test_buckets_come_in_the_order_of_success(mass):
    rng = np.random.default_rng(4)
    place, width, near = rng.uniform(-3, 3, 3), 1.5, 0.8
    slots, chance = ann.success_order(place, width, near, mass)
    assert (np.diff(chance) <= 1e-15).all()
    neighbours = place + near * rng.standard_normal((40_000, 3))                    # what the probabilities stand for
    at = {tuple(s): p for s, p in zip(slots.tolist(), chance)}
    hits = [tuple(r) for r in np.floor(neighbours / width).astype(int).tolist()]
    assert abs(sum(h in at for h in hits) / len(hits) - sum(at.values())) < 0.01
    counts = {s: hits.count(s) / len(hits) for s in list(at)[:3]}
    assert all(abs(counts[s] - at[s]) < 0.01 for s in counts)
    assert min(place // width == slots[0]) or chance[0] > 0                           # the first is the likeliest of all
    assert slots.shape[0] == len({tuple(s) for s in slots.tolist()})
