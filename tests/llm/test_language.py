from care_analytics.llm import language as L


def test_query_on_held_out_rows(spark, small):
    from care_analytics.llm.queries.language import op3_language_id
    got = op3_language_id(spark, small).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    held = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and held
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_words_of_mixed_text(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    lines = L.training_lines(docs)
    model = L.fit(lines)
    pure = {lang: [w for line, of in lines if of == lang for w in L.words_of(line)][:40] for lang in model.labels}
    (mixed,), (post,) = model.word_labels([" ".join(w for lang in model.labels for w in pure[lang])])
    want = [lang for lang in model.labels for _ in pure[lang]]
    assert len(mixed) == len(want)
    assert sum(model.labels[p.argmax()] == w for p, w in zip(post, want)) >= 0.9 * len(want)
    row = L.label_words(spark.createDataFrame([(1, "Uno dos"), (2, None)], "doc_id long, text string"), model).collect()
    assert [w["word"] for w in row[0]["words"]] == ["uno", "dos"] and row[1]["words"] == []


def test_forward_backward_equals_sums_over_all_paths():
    import itertools
    import numpy as np
    rng = np.random.default_rng(3)
    model = L.Crf(["a", "b", "c"], np.zeros((1, 3)), rng.normal(size=(3, 3)))
    lengths = np.array([4, 1, 3])
    score = rng.normal(size=(8, 3))
    got, at = model.posteriors(score, lengths), 0
    for n in lengths:
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            weight = np.exp(sum(score[at + i, y] for i, y in enumerate(path)) + sum(model.step[a, b] for a, b in zip(path, path[1:])))
            for i, y in enumerate(path):
                want[i, y] += weight
        assert np.allclose(got[at:at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def test_odd_rows(spark, odd, small):
    model = L.train(spark.read.parquet(f"{small}/documents.parquet"))
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in L.identify(odd, model).collect()]
    assert len(got) == 9
    by = {i: p for i, p, _ in got}
    assert by[2] == by[3] == by[7] == "und" and by[5] != "und" and by[6] != "und"
    assert L.accepted(odd, model).schema == odd.schema
    assert {r["doc_id"] for r in L.accepted(odd, model).collect()} <= {1, 4, 5, 6, None}
    assert L.identify(odd.limit(0), model).count() == 0
    none = L.train(odd.limit(0))
    assert {r["lang_pred"] for r in L.identify(odd, none).collect()} == {"und"}
    one = L.fit([("solo texto", "es")])
    assert one.predict(["hola", None]) == (["es", "und"], [1.0, 0.0])
