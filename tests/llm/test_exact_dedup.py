import hashlib

from care_analytics.llm import exact_dedup as E


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        same = groups[t or ""]
        keep = max((x for x in same if x is not None), default=None)
        out.append((i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def test_equals_brute_force(spark, texts):
    rows = list(texts.items()) + [(10_000 + i, t) for i, t in list(texts.items())[:40]]
    got = E.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), max_depth=8, bucket_keys=3)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_odd_rows(spark, odd):
    got = E.exact_dedup(odd)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert E.exact_dedup(odd.limit(0)).count() == 0


def test_distinct_rows_leaves_one_of_each(spark, odd):
    got = E.distinct_rows(odd)
    assert got.schema == odd.schema
    assert sorted(r["doc_id"] for r in got.collect()) == [3, 4, 5, 6, 7]


def test_directory_splits_only_overfull_buckets(spark):
    cells = spark.createDataFrame([(c, 10 if c < 2 else 1) for c in range(16)], "__cell int, __n long")
    got = {r["__c"]: (r["__bucket"], r["__depth"]) for r in E.directory(cells, 4, 8).collect()}
    assert got[0] == (0, 4) and got[1] == (1, 4)              # overfull to the end: they stay at full depth
    assert got[2] == (2, 3) and got[3] == (2, 3) and got[4] == (4, 2) and got[7] == (4, 2)
    assert all(got[c] == (8, 1) for c in range(8, 16))


def test_colliding_keys_are_chained(spark):
    keyed = spark.createDataFrame([(1, 7, "a"), (2, 7, "b"), (3, 7, "a")], "__id long, __key long, __text string")
    rows = sorted((r["__chain"], r["__keep"], r["__n"]) for r in E.build_index(keyed).collect())
    assert rows == [(1, 2, 1), (2, 3, 2)]


def keyed(spark, rows):
    return spark.createDataFrame(rows, "__id long, __text string").selectExpr("__id", "xxhash64(__text) AS __key", "__text")


def test_documents_added_give_the_index_of_all(spark):
    rows = [(i, f"text {i % 90}") for i in range(150)]
    index = E.open_index(keyed(spark, rows[:20]), bucket_keys=4)
    grown = E.add_documents(index, keyed(spark, rows[20:]))
    whole = E.open_index(keyed(spark, rows), bucket_keys=4)
    assert grown.depth == whole.depth > index.depth               # the directory doubled
    assert sorted(map(tuple, grown.rows.collect())) == sorted(map(tuple, whole.rows.collect()))
    assert sorted(map(tuple, grown.slots.collect())) == sorted(map(tuple, whole.slots.collect()))
    held = [r["n"] for r in grown.rows.groupBy("__bucket").count().withColumnRenamed("count", "n").collect()]
    assert sum(held) == 90 and max(held) <= 4 and len(held) > 20


def test_the_directory_routes_probes(spark):
    """A document finds its text only in the bucket that the directory names."""
    base = keyed(spark, [(i, f"text {i}") for i in range(60)])
    index = E.open_index(base, bucket_keys=4)
    assert E.locate(base, index).count() == 60
    wrong = E.Index(index.rows, index.slots.selectExpr("__c", "__bucket + 1 AS __bucket", "__depth"), index.depth, 4)
    assert E.locate(base, wrong).count() < 60


def test_depth_grows_with_the_entries():
    assert [E.depth_for(n, 4096) for n in (0, 1, 256, 257, 10 ** 6)] == [0, 0, 0, 1, 12]
    assert E.depth_for(10 ** 11, 4096) == 29
