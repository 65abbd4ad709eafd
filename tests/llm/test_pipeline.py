import hashlib

import corpus_pipeline
from care_analytics.llm import decontaminate as D
from care_analytics.llm import language as L

from .test_bpe import LIBRARY, ids
from .test_simhash import components, fingerprint


def test_run_equals_the_stages_by_brute_force(spark, small, texts):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = L.train(docs)
    order = sorted(texts)
    names, scores = model.predict([texts[i] for i in order])
    kept = {i: texts[i] for i, n, s in zip(order, names, scores) if n != "und" and s >= L.MIN_SCORE}
    kept = {i: t for i, t in kept.items() if i == max(j for j, u in kept.items() if u == t)}
    first = components({i: fingerprint(t) for i, t in kept.items()}, 2)
    kept = {i: t for i, t in kept.items() if first[i] == i}
    items = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    kept = {i: t for i, t in kept.items() if not any(b in t for b in items)}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, small).collect()}
    assert set(got) == set(kept)
    for i, text in kept.items():
        assert ids(got[i]["ids"]) == LIBRARY.encode_ordinary(text)
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_stages_keep_the_columns(spark, odd, small):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == odd.columns, name
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()} <= {1, 4, 5, 6, None}


def test_empty_table(spark, odd, small):
    docs = odd.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0


def test_entry_lists_every_operator():
    import __spark_entry__ as entry
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert D.WINDOW == 5 and D.MIN_COVERAGE == 0.8


def test_rows_that_share_an_id_are_judged_each_for_itself(spark, tmp_path):
    """Of (1, A), (7, A'), (7, B), (null, A'') the copies go and B stays; a leak takes no namesake with it."""
    a = "the quick brown fox jumps over the lazy dog and runs far away from here to the old house by the river " * 6
    b = "nothing of this text is like the other one because it tells about ships and harbours and the sea " * 6
    leak = "how many apples does the farmer have when 12 baskets hold 30 apples each and 7 are lost"
    rows = [(1, a), (7, a), (7, b), (None, a), (8, leak), (8, b + "x y z " * 40)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert sorted((r["doc_id"], r["text"]) for r in stages["near_dedup"](spark, docs, str(tmp_path)).collect()) == sorted((i, t) for i, t in rows if (i, t) in ((1, a), (7, b), (8, leak), rows[-1]))
    assert {(r["doc_id"], r["text"]) for r in stages["decontamination"](spark, docs, str(tmp_path)).collect()} == set(rows) - {(8, leak)}
