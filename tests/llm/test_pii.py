import hashlib
import math
import random
import re

import regex

from care_analytics.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in value.split(".")),
            "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def brute(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k in PATTERNS for m in re.finditer(PATTERNS[k], text or "") if good(k, m[0]))


def test_base_spans_on_random_texts(spark):
    rng = random.Random(3)
    parts = ["a", "@", ".", "+", "1", "23", "4111111111111111", " ", "-", "(", ")", "é", "b-c", "%", "_", "255", "😀", "\n"]
    texts = [None, "", "a@b.c+d@e.f é x@y.zz", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 " + "1" * 5000,
             "+1 (988) 555-2485, +49 30 1234567 +1 2 ++1 234 567 89 01", "a" * 30_000 + "@x.y", "9" * 20_000 + " +1" + "()" * 3000]
    texts += ["".join(rng.choice(parts) for _ in range(rng.choice([5, 20, 60]))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r[1] for r in pii.find_base(docs).select("__id", pii.joined(pii.KINDS)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def brute_all(rows):
    """For each (id, text) of rows with different ids: base spans, term spans with disclosures, and the sanitised text."""
    spans, words = {}, {}
    for i, text in rows:
        text = text or ""
        spans[i] = [(k, m.start(), m.end(), m[0]) for k in PATTERNS for m in re.finditer(PATTERNS[k], text) if good(k, m[0])]
        out = list(text)
        for _, a, b, _ in spans[i]:
            out[a:b] = " " * (b - a)
        words[i] = [(m.start(), m.end(), m[0].lower()) for m in regex.finditer(r"[\p{L}\p{N}]+", "".join(out))]
    n = len(rows)
    held, docs_of = {}, {}
    for i in spans:
        for e in {(k, v) for k, _, _, v in spans[i]}:
            held.setdefault(e, set()).add(i)
        for w in {w for _, _, w in words[i]}:
            docs_of.setdefault(w, set()).add(i)
    over = {}
    for ids in (ids for ids in held.values() if pii.MIN_DOCS <= len(ids) < n):
        for w in {w for i in ids for _, _, w in words[i]}:
            both = len(docs_of[w] & ids)
            if both >= pii.MIN_DOCS:
                d = math.log2(both * n / (len(docs_of[w]) * len(ids))) / math.log2(n / len(ids))
                if d >= pii.GENERALISE:
                    over[w] = max(d, over.get(w, 0))
    out = {}
    for i, text in rows:
        terms = [(a, b, over[w]) for a, b, w in words[i] if w in over]
        marks = sorted([(a, -b, f"[{k}]") for k, a, b, _ in spans[i]] + [(a, -b, "" if d >= pii.REMOVE else None) for a, b, d in terms], key=lambda m: m[:2])
        at, clean = 0, ""
        for a, b, put in marks:
            if a >= at:
                piece = text[a:-b]
                put = put if put is not None else "[number]" if regex.match(r"\p{N}", piece) else "[name]" if regex.match(r"\p{Lu}", piece) else "[word]"
                clean, at = clean + text[at:a] + put, -b
        out[i] = ([f"{k}:{a}:{b}" for k, a, b, _ in spans[i]], [f"term:{a}:{b}" for a, b, _ in terms], clean + (text or "")[at:])
    return out


def same_as_brute(got, rows):
    want = brute_all(rows)
    assert len(got) == len(rows)
    for r in got:
        base, terms, clean = want[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert r["spans"] == ",".join(base + terms) and r["n_term"] == len(terms)
        assert r["sanitized_sha256"] == hashlib.sha256(clean.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(k + ":") for s in base) for k in pii.KINDS]
    return want


def test_query(spark, small, texts):
    from care_analytics.llm.queries.pii import op10_pii
    same_as_brute(op10_pii(spark, small).collect(), list(texts.items()))


def test_query_with_terms_and_without_broadcasts(spark, tmp_path, monkeypatch):
    from care_analytics.llm.queries.pii import op10_pii
    rng = random.Random(5)
    people = [(f"name{i}", f"n{i}@mail.org", f"Street{i} {i}7") for i in range(6)]
    rows = []
    for i in range(150):
        name, mail, street = rng.choice(people)
        filler = " ".join(rng.choice("the of and to in it was on a for".split()) for _ in range(8))
        rows.append((i, rng.choice([f"{name.title()} {filler} {mail}, {street}.", f"{filler} {street} {name}", filler, f"{name} +49 30 1234567{i % 3} {mail}", "", None])))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    first = op10_pii(spark, str(tmp_path)).collect()
    want = same_as_brute(first, rows)
    assert sum(bool(terms) for _, terms, _ in want.values()) > 30 and any("[name]" in c or "[word]" in c for _, _, c in want.values())
    assert any(not base and terms for base, terms, _ in want.values())                       # terms only: no comma before them
    monkeypatch.setattr(pii, "TERMS", 0)
    monkeypatch.setattr(pii, "DOCUMENTS", 0)
    assert sorted(map(tuple, op10_pii(spark, str(tmp_path)).collect())) == sorted(map(tuple, first))


def test_disclosure_of_terms(spark):
    texts = [f"Zorblatt writes from zor@blatt.org on the {i}th" for i in range(4)] + [f"the pen of the {i}" for i in range(12)] + ["once ann@x.org only"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["__id"]: r for r in pii.find(docs).collect()}
    found = {texts[0][x["s"]:x["e"]].lower(): x["d"] for x in rows[0]["term"]}
    assert {"zorblatt", "writes", "from", "on"} == set(found) and math.isclose(found["zorblatt"], 1.0)
    assert not rows[5]["term"] and not rows[16]["term"]         # no entity; an entity seen once
    n, ne, nt, te = 17, 4, 16, 4                                # "the", by hand: far under the threshold
    assert math.log2(te * n / (nt * ne)) / math.log2(n / ne) < pii.GENERALISE
    clean = {r["doc_id"]: r["text"] for r in pii.sanitize(docs).collect()}
    assert clean[0] == "   [email]  the 0th" and clean[5] == texts[5] and clean[16] == "once [email] only"
    general = {r["doc_id"]: r["text"] for r in pii.sanitize(docs, remove=1.1).collect()}
    assert general[0] == "[name] [word] [word] [email] [word] the 0th"


def test_terms_count_and_are_marked_in_whole_documents(spark):
    far = "far and away " * 20
    texts = [f"Quimby asks {'' if i < 2 else far}q@u.org" for i in range(10)]            # near the email in 2 of its 10 documents
    texts += [f"Quimby {far}quimby, İzmir QUIMBY 4111111111111111"] + [f"far and away asks {i}" for i in range(989)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["__id"]: [(texts[r["__id"]][x["s"]:x["e"]], x["d"]) for x in r["term"]] for r in pii.find(docs).collect()}
    want = math.log2(10 * 1000 / (11 * 10)) / math.log2(1000 / 10)                       # also without the email: n(t) = 11
    assert all([w for w, _ in rows[i]] == ["Quimby"] and math.isclose(rows[i][0][1], want) for i in range(10))
    assert [w for w, _ in rows[10]] == ["Quimby", "quimby", "QUIMBY"] and not any(rows[i] for i in range(11, 1000))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitize(docs).collect()}
    assert not any("quimby" in t.lower() for t in clean.values()) and clean[10].endswith(", İzmir  [card]")


def test_many_words_keep_their_places(spark):
    text = " ".join(f"w{i}é" for i in range(1500))
    docs = spark.createDataFrame([(0, text + " a@b.cc"), (1, "ü " + text + " a@b.cc")] + [(i, "other") for i in range(2, 500)], "doc_id long, text string")
    row = next(r for r in pii.find(docs).collect() if r["__id"] == 1)
    assert [("ü " + text)[x["s"]:x["e"]] for x in row["term"]] == text.split()


def test_odd_rows(spark, odd):
    rows = pii.find(odd).collect()
    assert len(rows) == 9 and not any(r[k] for r in rows for k in [*pii.KINDS, "term"])
    same = spark.createDataFrame([(1, "x a@b.c y", 0), (1, "x a@b.c y", 0), (1, "other", 0), (None, "x a@b.c y", 0)], "doc_id long, text string, email int")
    got = [(r["__id"], len(r["email"])) for r in pii.find(same).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1), (1, 1), (1, 0), (None, 1)], key=repr)
    assert sorted(r["text"] for r in pii.sanitize(same).collect()).count("other") == 1
    assert pii.find(odd.limit(0)).count() == 0
