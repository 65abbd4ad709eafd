import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken

from care_analytics.llm import bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
RAW = open(RANKS, "rb").read()
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={},
                            mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())})


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_random_texts_as_the_library(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 50)
    merger = bpe.Merger(RAW)
    rng = random.Random(1)
    alphabet = "ab st re'''vellmd  \n\t\r0123 !?.,éßñ中文　\xa0😀'sS'"
    for _ in range(120):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 5, 30, 300]))) for _ in range(15)]
        for text, got in zip(texts, merger.encode_all(texts)):
            assert ids(got) == LIBRARY.encode_ordinary(text), text
            assert merger.decode(got) == text.encode()


def test_long_words_use_the_heap():
    text = "x" * 3000 + "qzj" * 500 + " " + "é" * 700
    assert ids(bpe.Merger(RAW).encode_all([text])[0]) == LIBRARY.encode_ordinary(text)


def test_rows_of_the_scan_do_not_matter(monkeypatch):
    text = "It's  a test\n\n of 'tis we'll 12 x''s  " * 7
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    first = np.zeros(len(points), bool)
    first[0] = True
    want = bpe.token_starts(points, first).tolist()
    for width in (1, 2, 7, 500):
        monkeypatch.setattr(bpe, "ROW_CHARS", width)
        assert bpe.token_starts(points, first).tolist() == want


def test_offsets_and_decode(spark, odd):
    tokens = bpe.encode(odd, RANKS)
    rows = bpe.decode(tokens, RANKS).collect()
    assert sorted((r["decoded"].decode() for r in rows)) == sorted(r["text"] or "" for r in odd.collect())
    merger = bpe.Merger(RAW)
    for r in tokens.collect():
        size = [len(merger.token[i]) for i in ids(r["ids"])]
        assert ids(r["offsets"]) == list(np.cumsum([0, *size])[:-1]) if size else r["offsets"] == b""


def test_query_equals_the_library(spark, small, texts):
    from care_analytics.llm.queries.bpe import op7_byte_bpe
    got = {r["doc_id"]: r for r in op7_byte_bpe(spark, small).collect()}
    assert len(got) == len(texts)
    for i, text in texts.items():
        want = LIBRARY.encode_ordinary(text)
        assert got[i]["n_tokens"] == len(want)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(spark.read.parquet(f"{small}/documents.parquet").limit(0), RANKS).count() == 0


def test_tables_of_one_length_have_mergers_of_their_own():
    """Two tables that differ in one token far behind: the second is not encoded by the first."""
    import base64
    from care_analytics.llm import bpe
    letters = [bytes([i]) for i in range(256)]
    tables = [b"".join(base64.b64encode(t) + b" " + str(i).encode() + b"\n" for i, t in enumerate([*letters, last])) for last in (b"ab", b"cd")]
    assert len(tables[0]) == len(tables[1])
    one, two = (bpe.own(bpe.Merger, t) for t in tables)
    assert one is not two and bpe.own(bpe.Merger, tables[0]) is one
