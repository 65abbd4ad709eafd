import heapq
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from care_analytics.llm import ball_tree as bt
from tests.llm.conftest import LOWER

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """[(item_id, doc_id, score)] as rows of (item, text) rank them, by the stated formula."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    out = []
    for item, text in {(i, t): None for i, t in items}:
        q = Counter(terms(text))
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in c for _, c in counts) + 1))) for t in q}
        scored = []
        for i, c in counts:
            m = 100 - 75 + (75 * c.total() * n) // total
            s = sum(q[t] * w[t] * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t in q if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(heapq.nsmallest(k, scored, key=lambda x: x[:3]))]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_equals_sql(spark, small):
    from care_analytics.llm.queries import lexical
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    assert rows(lexical.op13_lexical_search(spark, small)) == sorted(con.execute(lexical.SQL["op13_lexical_search"]).fetchall(), key=repr)


def test_small_blocks_prune_and_stay_exact(spark, small, texts):
    """Many trees, many blocks of items, no seeds; the copies of a hot text spread over tasks."""
    docs = list(texts.items()) + [(100_000 + i, "the and thation of the onst " * 3) for i in range(150)]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()] + [(900, "the and onst"), (901, docs[5][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    seen = []
    got = rows(bt.search(frame, asked, leaf=2, block_docs=64, block_terms=2000, item_entries=400, seed_docs=40, visits=seen))
    assert got == brute(docs, items)
    assert len(seen) > 1 and sum(v for v, _ in seen) < 0.6 * sum(a for _, a in seen)          # most leaves are pruned


def test_odd_rows(spark, odd):
    items = [(1, "alpha BETA gamma gamma"), (2, None), (3, ""), (4, "word 123 \U0001f600"), (5, "äé Äé"), (1, "alpha BETA gamma gamma"), (6, "absent"), (None, "delta"), (1, "delta")]
    asked = spark.createDataFrame([(i, t, "x", 0) for i, t in items], "item_id long, text string, term string, rank int")
    got = rows(bt.search(odd, asked))
    want = brute([(r["doc_id"], r["text"]) for r in odd.collect()], items)
    assert got == want and any(r[2] is None for r in got)
    assert bt.search(odd.limit(0), asked).count() == 0 and bt.search(odd, asked.limit(0)).count() == 0


def test_long_texts_are_read_in_pieces():
    rng = np.random.default_rng(0)
    text = "".join(rng.choice(list("aB9é-\n ¿x"), 40_000).tolist())
    for cut in (7, 64, 5000):
        old, bt.PIECE = bt.PIECE, cut
        try:
            got = bt.term_counts(text.encode())
        finally:
            bt.PIECE = old
        assert {t.decode(): n for t, n in got.items()} == Counter(terms(text))
    assert bt.term_counts(b"x" * 3_000_000) == {b"x" * 3_000_000: 1}


@pytest.mark.parametrize("seed", range(3))
def test_no_score_is_over_its_bound(seed):
    """Random trees: every node's bound is at least the exact score of every document below it."""
    rng = np.random.default_rng(seed)
    docs, width = 200, 500
    lengths = rng.integers(1, 40, docs)
    cols = np.concatenate([np.sort(rng.choice(width, n, replace=False)) for n in lengths])
    impact = rng.integers(1, 10 ** 6, len(cols))
    root = np.sqrt(rng.integers(1, 20_000, width))
    block = bt.Block(np.arange(docs), np.zeros(docs, bool), np.cumsum(lengths), cols, impact, root)
    tree = bt.Tree(block, 4)
    below = {}

    def collect(node):
        below[node] = tree.leaves[node] if node in tree.leaves else np.concatenate([collect(c) for c in tree.children[node]])
        return below[node]
    assert sorted(collect(0).tolist()) == list(range(docs))
    for _ in range(20):
        t = np.sort(rng.choice(width, 12, replace=False))
        weight = (root[t] ** 2).round().astype(np.int64) * rng.integers(1, 3, 12)
        exact = np.zeros(docs, dtype=np.int64)
        for d in range(docs):
            at = {c: v for c, v in zip(cols[block.start[d]:block.start[d + 1]], impact[block.start[d]:block.start[d + 1]])}
            exact[d] = sum(int(w) * int(at.get(c, 0)) for c, w in zip(t, weight))
        items = bt.Items(np.array([0, 12]), t, weight, root, np.zeros(1, dtype=np.int64), 10)
        best, visits = {}, Counter()
        bt.search_block(tree, items, best, visits)
        want = sorted(((-s, d) for d, s in enumerate(exact.tolist()) if s > 0))[:10]
        got = list(zip((-best[0][0]).tolist(), best[0][2].tolist())) if 0 in best else []
        assert got == want
