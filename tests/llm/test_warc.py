import base64
import gzip
import hashlib
import io
import random

from care_analytics.llm import warc as W
from care_analytics.llm.common import scratch_path


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def archive(n, packed):
    bodies = [f"payload {i} ".encode() * (40 + i) + b"\r\n\r\nWARC/1.1\r\nfake" for i in range(n)]
    records = [W.record(i, f"http://x/{i}", b, digest(b), None) for i, b in enumerate(bodies)]
    return [W.member(r) + W.EMPTY_MEMBER if packed else r for r in records]


def read(data):
    ok, gaps = {}, []
    for offset, size, what in W.Salvage(io.BytesIO(data)):
        if isinstance(what, str):
            gaps.append((offset, size, what))
        else:
            ok[int(what.headers["warc-record-id"][10:-1])] = (offset, what.payload)
    return ok, gaps


def test_whole_archives_have_no_gaps():
    for packed in (False, True):
        parts = archive(30, packed)
        ok, gaps = read(b"".join(parts))
        assert sorted(ok) == list(range(30)) and not gaps
        assert all(digest(p) == digest(f"payload {i} ".encode() * (40 + i) + b"\r\n\r\nWARC/1.1\r\nfake") for i, (_, p) in ok.items())


def test_damage_costs_only_what_it_touches(monkeypatch):
    monkeypatch.setattr(W, "READ_BYTES", 97)                  # records span many reads
    rng = random.Random(4)
    for packed in (False, True):
        for _ in range(25):
            parts = archive(12, packed)
            hit = sorted(rng.sample(range(12), 3))
            data, where = bytearray(), {}
            for i, part in enumerate(parts):
                part = bytearray(part)
                if i == hit[0]:                                # a byte of the body, under checksum or digest
                    part[len(part) // 2] ^= 0x55
                if i == hit[1]:
                    del part[len(part) // 3:len(part) // 3 + 9]
                if i == hit[2]:
                    data += b"junk \x1f\x8b\x08 WARC/1.1\r\nnot a record"
                where[i] = (len(data), len(part))
                data += part
            ok, gaps = read(bytes(data))
            assert set(range(12)) - set(ok) <= {hit[0], hit[1]}, (packed, hit, sorted(ok), gaps)
            assert hit[0] not in ok and hit[1] not in ok and hit[2] in ok
            for i in (hit[0], hit[1]):                         # the lost record lies in reported gaps
                a, n = where[i]
                assert any(o <= a + n // 2 < o + s for o, s, _ in gaps)
            assert any(o < where[hit[2]][0] <= o + s for o, s, _ in gaps)


def test_headers_of_any_length(spark):
    url = "data:text/html," + "x" * 100_000
    for packed in (False, True):
        parts = [W.record(i, url if i % 2 else "u", b"body", digest(b"body"), None) for i in range(4)]
        ok, gaps = read(b"".join(W.member(r) if packed else r for r in parts))
        assert sorted(ok) == [0, 1, 2, 3] and not gaps
    path = scratch_path(spark, "warc-test")
    W.write_archives(spark.createDataFrame([(1, url, "a"), (2, "u", "b")], "page_id long, url string, html string"), path)
    rows = W.read_archives(spark, path).collect()
    assert sorted((r["record_id"], r["reason"], r["target_uri"]) for r in rows) == [("1", None, url), ("2", None, "u")]


def test_cut_off_archive_and_foreign_bytes():
    for packed in (False, True):
        data = b"".join(archive(5, packed))
        ok, gaps = read(data[:-60])
        assert sorted(ok) == [0, 1, 2, 3] and len(gaps) == 1
    assert read(b"") == ({}, [])
    assert read(b"no archive at all" * 500)[1][0][:2] == (0, 8500)
    whole = gzip.compress(b"".join(archive(5, False)))         # many records in one member
    assert sorted(read(whole)[0]) == list(range(5))


def expected(pages, least=0):
    first, out = {}, []
    for i, html in sorted(pages, key=lambda r: r[0]):
        if len((html or "").encode()) >= least:
            first.setdefault(html or "", i)
    for i, html in pages:
        data = (html or "").encode()
        refers = first.get(html or "", i)
        refers = None if refers == i else refers
        out.append((i, len(data), digest(data), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def round_trip(spark, pages, least=0):
    path = scratch_path(spark, "warc-test")
    W.write_archives(pages, path, min_bytes=least)
    rows = W.read_archives(spark, path).collect()
    assert all(r["reason"] is None for r in rows)
    for r in rows:
        assert (r["payload"] is None) == (r["record_type"] == "revisit")
    return sorted(((int(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] and int(r["refers_to"])) for r in rows), key=repr)


def test_round_trip_with_copies(spark):
    rows = [(i, f"http://h/{i}?\r\nq=ü ", ["", None, "same", "same", "é" * 3000, "\r\n\r\nWARC/1.1\r\n", f"own {i}"][i % 7], "x") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    for least in (0, 5):
        assert round_trip(spark, pages, least) == expected([(i, h) for i, _, h, _ in rows], least)


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, digest string"
    pages = spark.createDataFrame([(3, None, None, "a"), (3, None, None, "a"), (None, "u", "z", "b"), (9, "u", "x" * 400_000, "c")], schema)
    path = scratch_path(spark, "warc-test")
    W.write_archives(pages, path)
    got = sorted(((r["record_id"], r["record_type"], r["payload_bytes"], r["target_uri"]) for r in W.read_archives(spark, path).collect()), key=repr)
    assert got == sorted([("3", "response", 0, None), ("3", "response", 0, None), (None, "response", 1, "u"), ("9", "response", 400_000, "u")], key=repr)
    assert round_trip(spark, pages.limit(0)) == []


def test_query(spark, small):
    from care_analytics.llm.queries.warc import op2_warc
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    got = op2_warc(spark, small).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == expected(pages)


def test_a_wrong_length_does_not_read_the_rest(tmp_path):
    """A plain record that states far too long a block: the gap is logged after four bytes, and later records are found."""
    import pyarrow as pa
    good = W.record(5, "http://x/5", b"payload", W.digest_of(b"payload"), None)
    bad = W.record(6, "http://x/6", b"p" * 100, W.digest_of(b"p" * 100), None)
    length = [line for line in bad.split(b"\r\n") if line.lower().startswith(b"content-length")][0]
    for told in (b"999999999999", b"5000000"):
        bent = bad.replace(length, b"Content-Length: " + told, 1)
        data = bent + b"filler " * 3_000_000 + b"\r\n\r\n" + good
        name = tmp_path / f"{told.decode()}.warc"
        name.write_bytes(data)
        with pa.OSFile(str(name), "rb") as stream:
            salvage = W.Salvage(stream)
            largest, found = 0, []
            for item in salvage:
                largest = max(largest, len(salvage.buffer))
                found.append(item)
        assert [f[2].headers["warc-target-uri"] for f in found if not isinstance(f[2], str)] == ["http://x/5"]
        assert isinstance(found[0][2], str) and largest < 6_000_000
