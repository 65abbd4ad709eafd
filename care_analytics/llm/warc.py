"""WARC archives: a writer with revisit records and a salvage reader.

Writer. Pages are grouped by the SHA-1 of their payload; the page of smallest id is the
response and the others of its group are revisits that refer to it. Every record is one gzip
member. Spark's own text writer puts the members on the file system (any that Hadoop
knows, with its commit protocol), one after another; the separator that the writer wants is an
empty gzip member, which holds no data.

Salvage reader. Files are listed by Spark and streamed in tasks, with memory for a record at a time. At each place a
reader expects a gzip member or a version line. A member must inflate with its checksum; a record must have
headers, its whole block, the closing blank lines, and a payload of its digest. When a check fails, the next
member or version line that passes all checks is searched byte by byte, reading goes on there, and the bytes
between are reported as a gap with the reason.

Defined cases: a null payload is empty; a null url is left out; a null id reads back as null; rows repeated with the
smallest id of their group are responses each; ids and urls with control characters are percent-encoded; an empty
table gives an empty archive, and a folder without files an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from care_analytics.llm.common import slices, text_or_empty, written

MIN_REVISIT_BYTES = 0      # smaller payloads are always responses
DATE = "2024-01-01T00:00:00Z"
CHUNK_BYTES = 4_000_000
READ_BYTES = 1 << 20

# Words of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
MAGIC = b"\x1f\x8b\x08"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a text column (forty hexadecimal digits are four groups of forty bits)."""
    hexes = F.sha1(text)
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(hexes, at, 10), 16, 32), 8, "0") for at in (1, 11, 21, 31)]),
                       "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
            min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(__id, __url, __payload, __digest, __refers): ``__refers`` is the id of the response, null for a response."""
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("__url"),
                        text_or_empty(payload_col).alias("__payload")) \
        .withColumn("__digest", base32_sha1(F.col("__payload")))
    firsts = written(rows.filter(F.octet_length("__payload") >= min_bytes).groupBy(F.col("__digest").alias("__d"))
                     .agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
                     .filter("__n > 1").select("__d", "__first"), "warc-firsts")
    return rows.join(firsts, F.col("__digest") == F.col("__d"), "left") \
        .select("__id", "__url", "__payload", "__digest",
                F.when(~F.col("__id").eqNullSafe(F.col("__first")), F.col("__first")).alias("__refers"))


def _uri(value: object) -> str:
    return f"<urn:page:{'' if value is None else quote(str(value), safe='')}>"


def record(ident: object, url: str | None, payload: bytes, digest: str, refers: object) -> bytes:
    """One record, uncompressed. A revisit has the HTTP header of its response but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    lines = [VERSION, f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {_uri(ident)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {re.sub('[\x00-\x20]', lambda m: quote(m[0]), url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers is not None:
        lines += [f"WARC-Refers-To: {_uri(refers)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Writes a record for each page, as gzip members, to files in the folder ``path``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, payloads in slices(batch, batch.column(2), CHUNK_BYTES):
                rows = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), payloads, part.column(3).to_pylist(), part.column(4).to_pylist())
                members = [member(record(i, u, p.encode("utf-8", "surrogatepass"), d, r)) for i, u, p, d, r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], names=["member"])

    planned(pages, id_col, url_col, payload_col, min_bytes).mapInArrow(run, "member binary") \
        .select(F.col("member").cast("string")) \
        .write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


class Broken(Exception):
    """A check failed; the text is the reason."""


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes | None
    payload_bytes: int
    size: int


def parse(data: bytes, at: int) -> Record:
    """The record at ``data[at:]``; raises Broken when a check fails."""
    if not VERSION_LINE.match(data, at):
        raise Broken("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Broken("header not closed")
    headers = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken("header line without a colon")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not {"warc-type", "warc-record-id", "warc-date"} <= headers.keys():
        raise Broken("a mandatory header is missing")
    length = headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length):
        raise Broken("no content length")
    start = end + 4
    stop = start + int(length)
    if stop + 4 > len(data):
        raise Broken("block cut off")
    if data[stop:stop + 4] != b"\r\n\r\n":
        raise Broken("block of another length")
    block = data[start:stop]
    payload, size = block, len(block)
    if headers.get("content-type", "").startswith("application/http"):
        head, blank, body = block.partition(b"\r\n\r\n")
        if not blank:
            raise Broken("HTTP header not closed")
        payload, size = body, len(body)
        if headers.get("warc-type") == "revisit":
            told = re.search(rb"(?mi)^content-length: *([0-9]{1,18})\r?$", head)
            payload, size = None, int(told[1]) if told else 0
    elif headers.get("warc-type") == "revisit":
        payload, size = None, 0
    told = headers.get("warc-payload-digest", "")
    if payload is not None and told.startswith("sha1:") and told[5:] != digest_of(payload):
        raise Broken("payload of another digest")
    return Record(headers, payload, size, stop + 4 - at)


@dataclass
class Salvage:
    """Reads one stream: yields (offset, raw length, Record) and (offset, raw length, reason) for gaps."""

    stream: object
    buffer: bytearray = field(default_factory=bytearray)
    base: int = 0            # offset of buffer[0]
    ended: bool = False

    def _more(self) -> bool:
        if not self.ended:
            data = self.stream.read(READ_BYTES)
            self.ended = not data
            self.buffer += data
        return not self.ended

    def _have(self, n: int) -> bool:
        while len(self.buffer) < n and self._more():
            pass
        return len(self.buffer) >= n

    def _member(self, at: int) -> tuple[bytes, int]:
        """Data of the gzip member at ``buffer[at:]`` and its raw length."""
        unpack, out, fed = zlib.decompressobj(31), [], at
        while not unpack.eof:
            if fed >= len(self.buffer) and not self._more():
                raise Broken("member cut off")
            piece = bytes(self.buffer[fed:fed + READ_BYTES])
            fed += len(piece)
            try:
                out.append(unpack.decompress(piece))
            except zlib.error as why:
                raise Broken("member does not inflate") from why
        return b"".join(out), fed - len(unpack.unused_data) - at

    def _check_length(self, at: int, end: int) -> None:
        """Looks at the stated end of a plain record before its block is read, where the stream can be read at any place: a wrong
        length then costs four bytes, not the rest of the stream."""
        told = re.search(rb"(?mi)^content-length: *([0-9]{1,18})\r?$", bytes(self.buffer[at:end]))
        stop = end + 4 + int(told[1]) if told else 0
        if stop + 4 <= len(self.buffer) or not self.stream.seekable():
            return
        here = self.stream.tell()
        self.stream.seek(min(self.base + stop, self.stream.seek(0, 2)))
        after = self.stream.read(4)
        self.stream.seek(here)
        if bytes(after) != b"\r\n\r\n":
            raise Broken("block cut off" if len(after) < 4 else "block of another length")

    def _plain(self, at: int) -> tuple[Record, int]:
        seen = at
        while True:
            end = self.buffer.find(b"\r\n\r\n", seen)             # a header may have any length
            if end >= 0 or not VERSION_LINE.match(self.buffer, at):
                break
            binary = self.buffer.find(b"\0", seen) >= 0             # no header has such a byte: do not read on for its end
            seen = max(at, len(self.buffer) - 3)
            if binary or not self._more():
                break
        if end >= 0:
            self._check_length(at, end)
        while True:
            try:
                found = parse(self.buffer, at)
                found.payload = bytes(found.payload) if found.payload is not None else None
                return found, found.size
            except Broken as why:
                if str(why) != "block cut off" or not self._more():
                    raise

    def _unit(self, at: int) -> tuple[list[tuple[int, Record]], list[tuple[int, str]], int]:
        """What starts at ``buffer[at:]``: records and gaps (by place inside the unit) and its raw length."""
        self._have(at + 10)
        if self.buffer[at:at + 3] == MAGIC:
            data, size = self._member(at)
            records, gaps, place, bad = [], [], 0, ""
            while place < len(data):
                try:
                    found = parse(data, place)
                    records.append((place, found))
                    place += found.size
                except Broken as why:
                    bad = bad or str(why)
                    after = VERSION_LINE.search(data, place + 1)
                    place = after.start() if after else len(data)
            if bad:
                if not records:
                    raise Broken(bad)
                gaps.append((0, bad))
            return records, gaps, size
        found, size = self._plain(at)
        return [(0, found)], [], size

    def __iter__(self) -> Iterator[tuple[int, int, Record | str]]:
        gap, reason = None, ""
        while self._have(1):
            if gap is None and self.buffer[:1] in (b"\0", b"\r", b"\n"):      # padding between records
                pad = len(self.buffer) - len(self.buffer.lstrip(b"\0\r\n"))
                self._drop(pad)
                continue
            try:
                records, gaps, size = self._unit(0)
            except Broken as why:
                if gap is None:
                    gap, reason = self.base, str(why)
                self._search()
                continue
            if gap is not None and (records or size):
                yield gap, self.base - gap, reason
                gap = None
            for place, found in records:
                yield self.base, size, found
            for _, why in gaps:
                yield self.base, size, why
            self._drop(size)
        if gap is not None:
            yield gap, self.base - gap, reason

    def _drop(self, n: int) -> None:
        del self.buffer[:n]
        self.base += n

    def _search(self) -> None:
        """Drops bytes up to the next place where a member or a version line may start."""
        at = 1
        while True:
            found = START.search(self.buffer, at)
            if found:
                self._drop(found.start())
                return
            at = max(1, len(self.buffer) - 10)
            if not self._more():
                self._drop(len(self.buffer))
                return
            if at > READ_BYTES:
                self._drop(at - 1)
                at = 1


FIELDS = "path string, offset long, raw_bytes long, reason string, record_id string, record_type string, target_uri string, " \
         "refers_to string, payload_digest string, payload_bytes long, payload binary"


def _page(uri: str | None) -> str | None:
    """The id in ``<urn:page:...>``; other record ids as they are."""
    if uri is None:
        return None
    own = re.fullmatch(r"<urn:page:(.*)>", uri)
    return (unquote(own[1]) or None) if own else uri


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record and per gap (``reason`` is null for records). ``payload_digest`` and ``payload_bytes`` are those of the
    full payload, of revisits as their record tells; ``payload`` is null for revisits and unless ``payloads``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("raw_bytes", pa.int64()), ("reason", pa.string()),
                           ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
                           ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, where = fs.FileSystem.from_uri(name)
                with store.open_input_file(where) as stream:
                    for offset, size, what in Salvage(stream):
                        row = {"path": name, "offset": offset, "raw_bytes": size}
                        if isinstance(what, str):
                            row["reason"] = what
                        else:
                            head = what.headers
                            row |= {"record_id": _page(head.get("warc-record-id")), "record_type": head.get("warc-type"),
                                    "target_uri": head.get("warc-target-uri"), "refers_to": _page(head.get("warc-refers-to")),
                                    "payload_digest": digest_of(what.payload) if what.payload is not None
                                    else head.get("warc-payload-digest", "").removeprefix("sha1:"),
                                    "payload_bytes": what.payload_bytes, "payload": what.payload if payloads else None}
                            held += len(what.payload or b"") if payloads else 0
                        rows.append(row)
                        if len(rows) >= 5000 or held >= CHUNK_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, FIELDS)
