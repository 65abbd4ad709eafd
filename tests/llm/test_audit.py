import re
from itertools import permutations

import duckdb
import pytest

from care_analytics.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = "ABCDE"


def fails(rows):
    """For each row (id, text, source) the set of filters it fails, from the statement of the filters."""
    out = []
    for i, text, _ in rows:
        text = text or ""
        words = WORD.findall(text)
        bad = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
               "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)}
        out.append({f for f in LETTERS if bad[f]})
    return out


def brute(rows, good, toxic):
    out, bad = {}, fails(rows)
    for part in {s or "" for _, _, s in rows}:
        here = [(i, b) for (i, _, s), b in zip(rows, bad) if (s or "") == part]
        sums = dict.fromkeys(LETTERS, 0)
        for order in permutations(LETTERS):
            left = here
            for n, f in enumerate(order):
                gone = [(i, b) for i, b in left if f in b]
                sums[f] += len(gone)
                left = [(i, b) for i, b in left if f not in b]
                out[part, "".join(order), n + 1] = [len(left), len(gone), sum(f in b and bool(b & set(order[:n])) for _, b in here), sum(b == {f} for _, b in here),
                                                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, n), v in out.items():
            if p == part:
                v.append(sums[order[n - 1]])
    return {k: tuple(v) for k, v in out.items()}


def table(df):
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
           for r in df.collect()}
    return out


def test_odd_rows(spark):
    varied = " ".join(f"w{i}" for i in range(60))
    rows = [(5, varied, "x"), (6, varied, "x"), (6, varied, "y"), (7, varied + " #", None), (8, None, "x"), (9, "", ""), (None, varied, "x"), (None, None, None),
            (10, "word " * 70, "x"), (11, "A" * 500, "y"), (12, "\x85 " + varied, "y"), (13, "\t\n " + varied + " \x0b\x0c\r", "y"), (14, "word " * 40_000, "z"),
            (7, "other text | here", "z"), (15, varied.upper(), "z"), (5, varied, "x"), (16, "Word word " * 20 + varied, "x")]
    docs = spark.createDataFrame([(i, t, s, 1, "q", "p") for i, t, s in rows], "doc_id long, text string, source string, quality int, part string, __fid string")
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 1), (6, 1, None), (7, None, 1), (8, 1, 1), (None, 1, 1), (99, 1, 1), (10, 0, 0)], "doc_id long, quality int, toxic int")
    got = table(audit.audit(docs, labels))
    assert got == brute(rows, {5, 6, 8}, {6, 7, 8})
    assert len(got) == 4 * 600


def test_empty_tables(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(odd.limit(0), labels).count() == 0
    assert {r["good_lost"] for r in audit.audit(odd, labels).select("good_lost").distinct().collect()} == {0}


def test_failing_tables_hold_the_ids(spark, small, texts):
    rows, tables = audit.failing(spark.read.parquet(f"{small}/documents.parquet"))
    bad = dict(zip(texts, fails([(i, t, "") for i, t in sorted(texts.items())]))) if list(texts) == sorted(texts) else None
    want = {i: b for (i, _), b in zip(sorted(texts.items()), fails([(i, t, "") for i, t in sorted(texts.items())]))}
    assert bad is None or bad == want
    for f, t in tables.items():
        assert {r["__fid"] for r in t.collect()} == {i for i, b in want.items() if f in b}, f
    assert rows.count() == len(texts)


@pytest.mark.parametrize("hot", [False, True])
def test_query_equals_sql(spark, small, tmp_path, hot):
    from care_analytics.llm.queries import audit as q
    if hot:                                     # a third of all rows are copies from one source
        docs = spark.read.parquet(f"{small}/documents.parquet")
        copies = spark.range(100_000, 100_300).selectExpr("id as doc_id", "'one and the same' as text", "'en' as lang", "'src0' as source", "16L as n_chars")
        docs.unionByName(copies).write.parquet(f"{tmp_path}/documents.parquet")
        spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    at = str(tmp_path) if hot else small
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{at}/{t}.parquet{'/*.parquet' if hot else ''}'")
    want = con.execute(q.SQL["op12_filter_audit"]).fetchall()
    got = [tuple(r) for r in q.op12_filter_audit(spark, at).collect()]
    assert sorted(got) == sorted(want) and len(got) > 0
