"""Byte-level BPE encoding and decoding.

Pre-tokenisation without regex: every code point gets a class (letter, number, white
space, apostrophe that opens a contraction, other), and a machine of eight states
reads the classes. Its step on a class is a function from states to states, and
functions compose associatively, so a text is cut into equal rows, all rows
compose their functions side by side, one short scan over rows gives the state each
row starts in, and a second pass over the rows marks the token starts. The slices feed
pair merging: words not seen before are merged side by side, lowest rank first and
leftmost on ties, and kept in a bounded cache per worker.

The rank table is a parameter (a path read on the driver) and has a fixed size of
about a megabyte, which bounds the broadcast.

Defined cases: a null text counts as empty and has no tokens; a text of any length is
encoded whole; rows repeated are encoded each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from care_analytics.llm.common import slices, text_or_empty

# Unicode White_Space, and the contraction endings of the pattern.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200,
               8201, 8202, 8232, 8233, 8239, 8287, 12288]
ENDINGS_OF_ONE = "stmd"
ENDINGS_OF_TWO = ["re", "ve", "ll"]

CACHE_WORDS = 250_000     # words a worker remembers
CHUNK_BYTES = 2_000_000   # bytes of text scanned side by side
ROW_CHARS = 1024          # steps of a scan

# Classes of code points; + 8 marks the first code point of a text.
LETTER, NUMBER, OTHER, SPACE_RUN, LAST_WHITE, LAST_SPACE, QUOTE_ONE, QUOTE_TWO = range(8)
# States: nothing open, inside a run, after a space that joins the next run, inside a contraction.
NONE, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, AFTER_SPACE, ONE_LEFT, TWO_LEFT = range(8)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, token starts here) at index class * 8 + state."""
    step, starts = np.zeros(128, np.uint8), np.ones(128, np.bool_)
    run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, SPACE_RUN: IN_WHITE,
           LAST_WHITE: NONE, LAST_SPACE: AFTER_SPACE, QUOTE_ONE: ONE_LEFT, QUOTE_TWO: TWO_LEFT}
    for kind in range(8):
        for state in range(8):
            to, start = run[kind], True
            if kind in (QUOTE_ONE, QUOTE_TWO) and state in (IN_OTHER, AFTER_SPACE):
                to, start = IN_OTHER, False
            elif kind == LETTER and state in (ONE_LEFT, TWO_LEFT):
                to, start = (NONE if state == ONE_LEFT else ONE_LEFT), False
            elif kind in (LETTER, NUMBER, OTHER) and state in (run[kind], AFTER_SPACE):
                start = False
            elif kind == SPACE_RUN and state == IN_WHITE:
                start = False
            step[kind * 8 + state], starts[kind * 8 + state] = to, start
        step[(kind + 8) * 8:(kind + 9) * 8] = run[kind]
    return step, starts


STEP, STARTS = _machine()


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    major = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(0x110000)).encode(), np.uint8)
    table = np.full(0x110000, OTHER, np.uint8)
    table[major == ord("L")] = LETTER
    table[major == ord("N")] = NUMBER
    table[WHITE_SPACE] = SPACE_RUN
    return table


def classes(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Class of each code point; ``first`` marks the first one of each text."""
    kind = class_table()[points]
    n = len(points)
    ahead = np.zeros(n + 2, np.uint32)          # code points, 0 behind the end
    ahead[:n] = points
    closed = np.ones(n + 2, np.bool_)           # a text starts here, or all end
    closed[:n] = first
    white = kind == SPACE_RUN
    joined = np.zeros(n + 1, np.bool_)
    joined[:n] = white
    last = white & ~(joined[1:] | closed[1:n + 1])
    kind[last] = LAST_WHITE
    kind[last & (points == 32)] = LAST_SPACE
    at = np.flatnonzero((points == 39) & ~closed[1:n + 1])
    if len(at):
        one = ahead[at + 1]
        kind[at[np.isin(one, [ord(c) for c in ENDINGS_OF_ONE])]] = QUOTE_ONE
        pair = (one.astype(np.uint64) << np.uint64(32)) | ahead[at + 2]
        two = np.isin(pair, np.array([ord(a) << 32 | ord(b) for a, b in ENDINGS_OF_TWO], np.uint64))
        kind[at[two & ~closed[at + 2]]] = QUOTE_TWO
    kind[first] += 8
    return kind


def token_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks the code points at which a token of the pattern starts."""
    n = len(points)
    if not n:
        return np.zeros(0, np.bool_)
    width = min(ROW_CHARS, int(n ** 0.5) + 1)
    rows = -(-n // width)
    kind = np.zeros(rows * width, np.uint8)
    kind[:n] = classes(points, first)
    steps = np.ascontiguousarray(kind.reshape(rows, width).T) * np.uint8(8)
    whole = np.repeat(np.arange(8, dtype=np.uint8)[:, None], rows, axis=1)     # state before a row -> after it
    for column in steps:
        whole = STEP[column + whole]
    state, entry = NONE, np.empty(rows, np.uint8)
    for r, to in enumerate(whole.T.tolist()):
        entry[r] = state
        state = to[state]
    marks = np.empty((width, rows), np.bool_)
    now = entry
    for c, column in enumerate(steps):
        at = column + now
        marks[c] = STARTS[at]
        now = STEP[at]
    return np.ascontiguousarray(marks.T).reshape(-1)[:n]


class Decoder:
    """The bytes of each token."""

    def __init__(self, table: bytes):
        lines = [line.split() for line in table.splitlines() if line]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.size = max(self.rank.values()) + 1
        self.token: list[bytes | None] = [None] * self.size
        for token, rank in self.rank.items():
            self.token[rank] = token

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Merger(Decoder):
    """Pair merging by a rank table, with a bounded cache of words."""

    def __init__(self, table: bytes):
        super().__init__(table)
        self.length = np.array([len(t or b"") for t in self.token], np.int64)
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        keys, ranks = [], []
        for token, rank in self.rank.items():
            for cut in range(1, len(token)):
                left, right = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left * self.size + right)
                    ranks.append(rank)
        self._hash(np.array(keys, np.int64), np.array(ranks, np.int64))
        self.known: dict[str, bytes] = {}

    def _hash(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.size, np.int64)
        slot = self._slot(keys)
        while len(keys):
            put = np.flatnonzero(self.keys[slot] == -1)
            _, one = np.unique(slot[put], return_index=True)
            put = put[one]
            self.keys[slot[put]], self.ranks[slot[put]] = keys[put], ranks[put]
            rest = np.ones(len(keys), np.bool_)
            rest[put] = False
            keys, ranks, slot = keys[rest], ranks[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``size`` where the pair makes no token."""
        key = left * self.size + right
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], self.size)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def merge_long(self, word: bytes) -> bytes:
        """One word by a heap of pairs: the cost stays near-linear in its length."""
        ids = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        token, rank_of = self.token, self.rank.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_of(token[ids[i]] + token[ids[i + 1]])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank_of(token[rank] + token[ids[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[after[i]]))
            if before[i] >= 0 and (r := rank_of(token[ids[before[i]]] + token[rank])) is not None:
                heapq.heappush(heap, (r, before[i], ids[before[i]], rank))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Token ids (little-endian, four bytes each) of each word, all words merged side by side."""
        lengths = np.array([len(w) for w in words], np.int64)
        symbol = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        rank = np.full(len(symbol), self.size, np.int64)       # of the pair that starts here
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.ranks_of(symbol[inner], symbol[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank * len(rank) + np.arange(len(rank)), begin)
            least, at = best // len(rank), best % len(rank)
            active = least < self.size
            if not active.all():
                size = np.diff(np.r_[begin, len(symbol)])
                stay = np.repeat(active, size)
                done.append((word[~stay], symbol[~stay]))
                place = np.cumsum(stay) - 1
                at, least = place[at[active]], least[active]
                symbol, word, rank = symbol[stay], word[stay], rank[stay]
                if not len(symbol):
                    break
            symbol[at] = least
            keep = np.ones(len(symbol), np.bool_)
            keep[at + 1] = False
            at = at - np.arange(len(at))                       # one symbol goes per word, in order
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            for left in (at - 1, at):
                ok = (left >= 0) & (left + 1 < len(symbol))
                some = left[ok]
                same = word[some] == word[some + 1]
                rank[some[same]] = self.ranks_of(symbol[some[same]], symbol[some[same] + 1])
            ends = np.flatnonzero(np.r_[word[1:] != word[:-1], True])
            rank[ends] = self.size
        owner, ids = (np.concatenate(x) for x in zip(*done)) if done else (np.zeros(0, np.int64),) * 2
        ids = ids[np.argsort(owner, kind="stable")].astype("<u4").tobytes()
        cuts = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(words)))] * 4
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of ``words``, which go to the cache too."""
        fresh, rest_words, rest = {}, [], []
        for text in words:
            data = text.encode("utf-8")
            rank = self.rank.get(data)
            if rank is not None:
                fresh[text] = rank.to_bytes(4, "little")
            elif len(data) > 256:
                fresh[text] = self.merge_long(data)
            else:
                rest_words.append(text)
                rest.append(data)
        if rest:
            fresh.update(zip(rest_words, self.merge_many(rest)))
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.known.clear()
        if len(fresh) <= CACHE_WORDS:
            self.known.update(fresh)
        return fresh

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text, as little-endian unsigned 32-bit integers."""
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        first = np.zeros(len(points) + 1, np.bool_)
        first[np.r_[0, ends]] = True
        at = np.flatnonzero(token_starts(points, first[:-1])).tolist()
        pieces = [whole[a:b] for a, b in zip(at, at[1:] + [len(whole)])]
        ids = list(map(self.known.get, pieces))
        new = list(dict.fromkeys([w for w, i in zip(pieces, ids) if i is None]))
        if new:
            fresh = self.learn(new)
            ids = [i or fresh[w] for w, i in zip(pieces, ids)]
        cuts = np.searchsorted(at, np.r_[0, ends]).tolist()
        return [b"".join(ids[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]

    def offsets(self, ids: bytes) -> bytes:
        """First byte of each token in the encoded text, little-endian unsigned 32-bit integers."""
        size = self.length[np.frombuffer(ids, "<u4")]
        return (np.cumsum(size) - size).astype("<u4").tobytes()


_OWN: dict[tuple[type, bytes], Merger | Decoder] = {}


def own(kind: type, table: bytes) -> Merger | Decoder:
    """One merger or decoder per worker and rank table."""
    key = (kind, hashlib.sha256(table).digest())
    if key not in _OWN:
        _OWN[key] = kind(table)
    return _OWN[key]


def _table(docs: DataFrame, ranks_path: str):
    with open(ranks_path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text",
           decoded: bool = False) -> DataFrame:
    """(id, ids binary, offsets binary): the tokens of each whole text and the byte each starts at. With ``decoded``,
    also the bytes that the ids decode to, from the same worker."""
    table = _table(docs, ranks_path)
    names = [id_col, "ids", "offsets"] + ["decoded"] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = own(Merger, table.value)
        for batch in batches:
            for part, texts in slices(batch, batch.column(1), CHUNK_BYTES):
                ids = merger.encode_all(texts)
                columns = [part.column(0), pa.array(ids, pa.binary()), pa.array(map(merger.offsets, ids), pa.binary())]
                if decoded:
                    columns.append(pa.array(map(merger.decode, ids), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)]
                          + [T.StructField(name, T.BinaryType()) for name in names[1:]])
    return docs.select(F.col(id_col), text_or_empty(text_col).alias("__text")).mapInArrow(run, schema)


def decode(tokens: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded binary): the bytes that the ids stand for; null ids decode to no bytes."""
    table = _table(tokens, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = own(Decoder, table.value)
        for batch in batches:
            for part, ids in slices(batch, batch.column(1), CHUNK_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(map(decoder.decode, ids), pa.binary())],
                                                 names=[id_col, "ids", "decoded"])

    schema = T.StructType([T.StructField(id_col, tokens.schema[id_col].dataType),
                           T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    return tokens.select(F.col(id_col), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids")).mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, n_tokens, ids_sha256, decoded_sha256) of each text, encoded and decoded again."""
    return encode(docs, ranks_path, id_col, text_col, decoded=True) \
        .select(F.col(id_col), "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
