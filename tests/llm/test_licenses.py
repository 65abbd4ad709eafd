from care_analytics.llm import licenses as L

from .conftest import words

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute(text):
    w, starts, labels = words(text, WORD), [], set()
    for phrase, label in L.PHRASES:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def base(rows):
    return {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows}


def test_query(spark, small, texts):
    from care_analytics.llm.queries.licenses import op9_license_scan
    rows = op9_license_scan(spark, small).collect()
    assert base(rows) == {i: brute(t) for i, t in texts.items()}
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in rows)


def test_places_and_templates(spark):
    mit = next(t for t, label in L.TEXTS if label == "mit" and len(t.split()) > 50)
    w = mit.split()
    texts = [None, "", "MIT", "mit license mit license, MIT-License Apache\x00license general public license général public license",
             "The MIT LICENSE " * 300, "x " + mit.upper(), "x " + " ".join(w[:30] + ["other", "words"] + w[31:]), " ".join(w[:len(w) // 2]),
             " ".join(w[:20] + ["pad"] * 200 + w[20:]), "This is licensed under the GNU General Public License, version 3."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in L.scan(docs).collect()}
    assert base(rows.values()) == {i: brute(t) for i, t in enumerate(texts)}
    assert rows[5]["labels"] == "mit" and rows[5]["score"] == 1.0 and rows[5]["base_labels"] == ""
    assert rows[6]["labels"] == "mit" and 0.8 <= rows[6]["score"] < 1
    assert rows[7]["labels"] == "" and rows[9]["labels"] == "gpl,gpl-3.0"
    assert rows[8]["labels"] == ""                              # two halves far apart are no license


def test_insertions_and_omissions_up_to_the_stretch(spark):
    mit = next(t for t, label in L.TEXTS if label == "mit" and len(t.split()) > 50).split()
    half, most = len(mit) // 2, -(-len(mit) // 4)
    texts = [" ".join(["a"] * 9 + mit[:half] + ["pad"] * k + mit[half:] + ["b"] * 9) for k in (1, 5, 12, most, most + 1)]
    texts += [" ".join(mit[:half] + mit[half + 8:]), " ".join(mit[:30] + ["x"] * 9 + mit[30:60] + ["y"] * 8 + mit[60:]),
              " ".join((mit[:half] + ["pad"] * 9 + mit[half:]) * 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = L.Template(" ".join(mit), "mit", True)
    got = {r["doc_id"]: (r["labels"], r["n_base"]) for r in L.scan(docs, [own]).collect()}
    assert got == {i: ("", 0) if i == 4 else ("mit", 3 if i == 7 else 1) for i in range(8)}


def test_own_templates(spark):
    docs = spark.createDataFrame([(1, "red green blue red green")], "doc_id long, text string")
    row = L.scan(docs, [L.Template("red green", "rg", True), L.Template("blue red green x", "no", False)]).first()
    assert (row["n_base"], row["first_word"], row["last_word"], row["labels"]) == (2, 0, 3, "rg")
    assert L.scan(docs, []).first()["labels"] == ""


def test_odd_rows(spark, odd):
    got = L.scan(odd)
    assert sorted((r["n_words"] for r in got.collect())) == sorted(brute(r["text"])[0] for r in odd.collect())
    assert L.scan(odd.limit(0)).count() == 0
