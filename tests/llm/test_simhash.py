import random

import numpy as np
import xxhash

from care_analytics.llm import simhash as S

from .conftest import words


def fingerprint(text):
    w = words(text, r"[^\x20\x09-\x0D]+")
    shingles = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def components(prints, distance):
    """id -> smallest id reachable, by comparing all pairs."""
    ids = sorted(prints)
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    values = np.array([prints[i] for i in ids], np.uint64)
    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1:] ^ values[k]) <= distance):
            a, b = root(k), root(k + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    return {i: ids[root(k)] for k, i in enumerate(ids)}


def test_query_equals_brute_force(spark, small, texts):
    from care_analytics.llm.queries.simhash import op6_simhash
    prints = {i: fingerprint(t) for i, t in texts.items()}
    want = {i: (f"{prints[i]:016x}", c) for i, c in components(prints, 2).items()}
    assert {r[0]: (r[1], r[2]) for r in op6_simhash(spark, small).select("doc_id", "fingerprint", "component_id").collect()} == want


def clustered(seed, n, spread):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    out = set()
    while len(out) < n:
        x = rng.choice(centres)
        for b in rng.sample(range(64), rng.randint(0, spread)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


def linked(spark, values, distance):
    signed = [(int(np.uint64(v).astype(np.int64)),) for v in values]
    edges = S.links(spark.createDataFrame(signed, "__fp long"), distance)
    got = {r["node"]: r["root"] for r in S.components(edges).collect()}
    groups = {}
    for (v,) in signed:
        groups.setdefault(got.get(v, v), set()).add(v)
    return {frozenset(g) for g in groups.values()}


def wanted(values, distance):
    groups = {}
    for i, c in components(dict(enumerate(values)), distance).items():
        groups.setdefault(c, set()).add(int(np.uint64(values[i]).astype(np.int64)))
    return {frozenset(g) for g in groups.values()}


def test_links_find_every_component(spark, monkeypatch):
    values = clustered(1, 300, 5)
    assert linked(spark, values, 2) == wanted(values, 2)
    monkeypatch.setattr(S, "CROWD", 2)                       # now most values are crowded: midpoints
    assert linked(spark, values, 2) == wanted(values, 2)


def test_thresholds_cover_the_distance():
    values = np.array(clustered(2, 200, 6), np.uint64)
    bits = S._bits(values)
    both = bits.astype(float).T @ bits
    for m in S.PARTITIONS:
        cover = S.Cover(S.partitions_of(len(values), both, m), 2)
        assert sorted(b for g in cover.groups for b in g) == list(range(64))
        cover.learn([[np.bincount(v, minlength=256) for v in cover.values(bits, k)] for k in range(m)], len(values))
        limits, cost = cover.thresholds(bits)
        assert (limits.sum(axis=1) == 2 - m + 1).all() and (limits >= -1).all() and np.isfinite(cost).all()


def test_odd_rows(spark, odd):
    got = S.near_dedup(odd).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    prints = {k: fingerprint(t) for k, (_, t) in enumerate(rows)}
    assert sorted(r["fingerprint"] for r in got) == sorted(f"{x:016x}" for x in prints.values())
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[1] == 1 and by[4] == 1 and by[None] == 1 and by[2] == by[3] == 2
    assert S.near_dedup(odd.limit(0)).count() == 0
