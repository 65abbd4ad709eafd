import pytest

from care_analytics.llm import decontaminate as D

ITEM = "Tom has 3 apples and 5 km to walk. How many apples does Tom share with Ann after 3 hours of walking to the city?"


@pytest.fixture
def bench(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, "the")], "item_id long, text string")


def found(spark, texts, bench, **kw):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["items"] for r in D.decontaminate(docs, bench, **kw).collect()}


def test_other_values_match_when_they_are_consistent(spark, bench):
    new = ITEM.replace("Tom", "Alice").replace("Ann", "Bob").replace("5 km", "9 miles").replace("3", "7")
    mixed = new.replace("Alice share", "Zed share")              # Tom cannot be both Alice and Zed
    changed = new.replace("walking", "running").replace("apples", "pears")
    got = found(spark, ["Well. " + new + " Ok", mixed, changed, None, "", "the", "Something else entirely.", (ITEM + " ") * 50, ITEM.upper()], bench)
    assert got == {0: "1", 1: "", 2: "", 3: "", 4: "", 5: "3", 6: "", 7: "1", 8: got[8]}


def test_copies_in_other_case_are_found(spark, bench):
    assert found(spark, [ITEM.upper(), "so " + ITEM.lower() + " ok", ITEM.lower()[:60]], bench) == {0: "1", 1: "1", 2: ""}


def test_parameters_near_copies_dense_numbers_and_short_items(spark):
    items = ["Tom has 3 apples and 3 pears", "Compute 12 + 7 * 5 - 9 and then add 4 to 13", "Who wrote Hamlet", ITEM.replace("Ann", "Tom"),
             "add up all of 1 2 3 4 5 6 7 8"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = ["Ann has 5 apples and 8 pears", "Tom has 3 apples and 4 pears", "So: compute 1 + 2 * 8 - 9 and then add 4 to 13",
             "I ask who wrote Hamlet, and when.", items[3].replace("with Tom", "with Zed"), "Now add up all of 9 8 7 6 5 4 3 2 1 0 at once", "Who wrote it?",
             "who wrote", items[3].replace("Tom", "Alice").replace("with Alice", "with Zed")]
    want = {0: "0", 1: "0", 2: "1", 3: "2", 5: "4", 6: "", 7: ""}
    got = found(spark, texts, bench)
    assert {i: got[i] for i in want} == want
    assert got[4] == got[8] == ("3" if 16 / 21 >= D.MIN_COVERAGE else "")                # five of 21 windows hold the odd name


def test_without_the_filter_the_join_finds_the_same(spark, bench, monkeypatch):
    texts = [ITEM, "x " * 50 + ITEM, "the", "nothing here at all"]
    want = found(spark, texts, bench)
    monkeypatch.setattr(D, "FILTER_WINDOWS", 0)
    assert found(spark, texts, bench) == want == {0: "1", 1: "1", 2: "3", 3: ""}


def test_a_joined_lexicon_gives_the_same(spark, monkeypatch):
    item = "The box has 3 red apples and 4 green pears. The crate holds 7 plums of the farm and 2 figs"
    bench = spark.createDataFrame([(1, item), (2, ITEM)], "item_id long, text string")
    texts = [item, item.replace("The box", "This box"), "Well. " + item.replace("The", "Then"), None, "", ITEM.replace("Tom", "Ann Lee"), ITEM.upper()]
    docs = spark.createDataFrame([*enumerate(texts), (None, item), (0, item)], "doc_id long, text string")
    want = sorted(map(str, D.decontaminate(docs, bench).collect()))
    real = D.lexicon_of
    monkeypatch.setattr(D, "lexicon_of", lambda b, c="text": real(b, c, 1))
    assert sorted(map(str, D.decontaminate(docs, bench).collect())) == want and any("coverage=0.9" in r for r in want)


def test_query_finds_all_items_that_stand_in_documents(spark, small, texts):
    from care_analytics.llm.queries.decontaminate import op5_decontamination
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    got = {r["doc_id"]: r for r in op5_decontamination(spark, small).collect()}
    want = {i for i, t in texts.items() if any(b in t for b in items.values())}
    assert want and want == {i for i, r in got.items() if r["contaminated"]}


def test_coverage_equals_brute_force(spark, bench):
    """Every window of the items against every window of the documents, on plain lists."""
    texts = [ITEM[:k] for k in range(10, len(ITEM), 9)]
    whole = D.Templates([ITEM], D.lexicon_of(bench))
    keys = set(whole.key.tolist())
    want = {}
    for i, t in enumerate(texts):
        share = len(keys & set(D.Templates([t], D.lexicon_of(bench)).key.tolist())) / len(keys)
        if share >= 0.8:
            want[i] = "1"
    got = found(spark, texts, bench)
    assert {i: x for i, x in got.items() if x} == want and want


def test_odd_rows(spark, odd, bench):
    got = D.decontaminate(odd, bench)
    assert got.columns == ["doc_id", "contaminated", "n_items", "items", "coverage"] and got.count() == 9
    assert not any(r["contaminated"] for r in got.collect())
    assert D.decontaminate(odd, bench.limit(0)).filter("contaminated").count() == 0
    assert D.decontaminate(odd.limit(0), bench).count() == 0
