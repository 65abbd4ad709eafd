import hashlib
import random

from care_analytics.llm import line_dedup as L


def brute(docs, least):
    """Every shortest stretch of ``least`` words, from and up to each line, compared as plain text."""
    first, windows = {}, []
    for i in sorted(docs):
        lines = [(k, x.strip()) for k, x in enumerate((docs[i] or "").split("\n")) if x.strip()]
        count = [len(x.split()) for _, x in lines]
        spans = set()
        for a in range(len(lines)):
            for ends in (range(a, len(lines)), range(a, -1, -1)):
                total = 0
                for b in ends:
                    total += count[b]
                    if total >= least:
                        spans.add((min(a, b), max(a, b)))
                        break
        for a, b in sorted(spans):
            key = tuple(x for _, x in lines[a:b + 1])
            first.setdefault(key, (i, lines[a][0]))
            windows.append((key, i, lines[a][0], lines[b][0]))
    gone = {}
    for key, i, a, b in windows:
        if first[key] != (i, a):
            gone.setdefault(i, set()).update(range(a, b + 1))
    return {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in docs.items()}


def test_random_documents(spark):
    rng = random.Random(5)
    lines = ["a b c", "d e", "f g h i", "x", "y z", " ", "q q q q q", "long " * 14]
    docs = {k: "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 30))) for k in range(80)} | {90: None, 91: "", 92: "x\n" * 200}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for least in (1, 12):
        got = {r["doc_id"]: r["text"] for r in L.dedup_lines(frame, min_words=least).collect()}
        assert got == brute(docs, least)


def test_query(spark, small, texts):
    from care_analytics.llm.queries.line_dedup import op4_line_dedup
    want = brute(texts, 50)
    got = {r["doc_id"]: r for r in op4_line_dedup(spark, small).collect()}
    assert {i: r["text_sha256"] for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    assert sum(r["n_deleted"] for r in got.values()) > 0


def test_shared_passage_goes_from_all_but_the_first(spark):
    passage = "\n".join(f"line {k} of a passage that many documents share between them" for k in range(6))
    docs = {i: f"own words of {i}\n{passage}\n  \nmore of {i}" for i in range(40)}
    got = {r["doc_id"]: r for r in L.dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert got[0]["text"] == docs[0] and all(got[i]["text"] == f"own words of {i}\n  \nmore of {i}" and got[i]["n_runs"] == 1 for i in range(1, 40))


def test_odd_rows(spark, odd):
    got = L.dedup_lines(odd, min_words=1).collect()
    assert len(got) == 9 and sum(r["text"] is None for r in got) == 1
    by = {r["doc_id"]: r["text"] for r in got}
    assert by[None] == "Alpha beta gamma delta." and by[1] == by[4] == "" and by[6].startswith("word word")
    assert L.dedup_lines(odd.limit(0)).count() == 0
