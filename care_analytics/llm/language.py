"""Language identification by a linear-chain conditional random field over words.

Method. Each word has hashed features: all character 1- to 3-grams of the word with its
borders marked (those at a border are affixes), longer affixes of four characters, and the
word itself (the learned lexicon). A weight per feature and label and a transition weight
per pair of labels are fitted to code-switched chains, spans of training lines in different
languages joined, by gradient steps on the chain's log-likelihood. Words of a text are
then labelled by forward-backward over its whole chain; a text's language is the label of
largest mean posterior and its score is that mean.

Only the classifier is fitted on a sample: at most ``SAMPLE_LINES`` different lines per
label, those of least hash among all lines of the labelled training rows; everything else
runs over all rows and whole texts. The weights have a fixed size (a few MB at most for
tens of labels), which bounds the broadcast. ``lang``, source and id are never inputs of a prediction.

Defined cases: ``und`` with score 0 for a null text, a text without a letter, and every text when no
row can be learned from; equal means take the alphabetically first label; repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from care_analytics.llm.common import slices, text_or_empty

UNKNOWN = "und"
SAMPLE_LINES = 400         # different lines a label is fitted on
SAMPLE_WORDS = 60          # words of a sampled line that are used
LINE_CHARS = 4000          # characters of a line that can be sampled: the driver holds at most so many for each sampled line
MOST_LABELS = 256          # labels a model is fitted for: 2^16 weights each; more are an error
FEATURE_BITS = 16
CHAIN_WORDS = 48           # length of a training chain
SPAN_WORDS = (4, 24)       # words of one language in a row, in a training chain
EPOCHS = 12
CHUNK_BYTES = 3_000_000
MIN_SCORE = 0.3            # a text below is rejected: no language stands out
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower case."""
    return [w for w in WORD.findall((text or "").lower()) if w.isalpha() or any(c.isalpha() for c in w)]


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - FEATURE_BITS)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) pairs of all words: hashed feature numbers and the place of the word."""
    points = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), size)
    start = np.cumsum(size) - size
    place = np.arange(len(points)) - start[word]
    found, owner = [], []
    gram = np.zeros(len(points), np.uint64)
    for n in range(1, 5):
        count = len(points) - n + 1
        if count <= 0:
            break
        gram = gram[:count] * np.uint64(0x100000001B3) + points[n - 1:n - 1 + count]
        inside = word[:count] == word[n - 1:]
        if n == 1:
            inside = inside & (points > 3)
        if n == 4:                                              # affixes only
            inside = inside & ((place[:count] == 0) | (place[:count] + n == size[word[:count]]))
        at = np.flatnonzero(inside)
        found.append(_mixed(gram[at], n))
        owner.append(word[at])
    power = np.cumprod(np.r_[np.uint64(1), np.full(int(size.max()), np.uint64(0x5851F42D4C957F2D), np.uint64)])
    whole = np.add.reduceat(points * power[place], start)
    found.append(_mixed(whole, 9))
    owner.append(np.arange(len(words)))
    return np.concatenate(found).astype(np.int64), np.concatenate(owner)


@dataclass
class Crf:
    """Labels and weights; ``weight[feature, label]``, ``step[from, to]`` in log space."""

    labels: list[str]
    weight: np.ndarray
    step: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """(words, labels) scores; each different word is scored once."""
        code: dict[str, int] = {}
        place = np.array([code.setdefault(w, len(code)) for w in words], np.int64)
        feature, owner = features(list(code))
        order = np.argsort(owner, kind="stable")
        begin = np.searchsorted(owner[order], np.arange(len(code)))
        return np.add.reduceat(self.weight[feature[order]], begin, axis=0)[place]

    def posteriors(self, score: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(words, labels) posterior of each word; chains lie one after another in ``score``.

        All chains step together, longest first, so a step works on the chains still open.
        """
        move = np.exp(self.step)
        order = np.argsort(-lengths, kind="stable")
        start = (np.cumsum(lengths) - lengths)[order]
        longest = int(lengths.max())
        open_at = np.searchsorted(-lengths[order], -np.arange(longest), side="left")     # chains longer than t
        begin = np.r_[0, np.cumsum(open_at)]
        flat = np.concatenate([start[:n] + t for t, n in enumerate(open_at.tolist())]) if longest else np.zeros(0, np.int64)
        near = np.exp(score - score.max(axis=1, keepdims=True))[flat]
        forward, backward = np.empty_like(near), np.ones_like(near)
        cuts = begin.tolist()
        now = None
        for t in range(longest):
            a, b = cuts[t], cuts[t + 1]
            now = near[a:b] if now is None else (now[:b - a] @ move) * near[a:b]
            now = now / now.sum(axis=1, keepdims=True)
            forward[a:b] = now
        for t in range(longest - 2, -1, -1):
            a, b, c = cuts[t], cuts[t + 1], cuts[t + 2]
            back = (near[b:c] * backward[b:c]) @ move.T
            backward[a:a + c - b] = back / back.sum(axis=1, keepdims=True)
        both = forward * backward
        out = np.empty_like(both)
        out[flat] = both / both.sum(axis=1, keepdims=True)
        return out

    def word_labels(self, texts: list[str | None]) -> tuple[list[list[str]], list[np.ndarray]]:
        """Words and posteriors of each text."""
        words = [words_of(t) for t in texts]
        lengths = np.array([len(w) for w in words], np.int64)
        flat = [w for ws in words for w in ws]
        if not flat or not self.labels:
            return words, [np.zeros((len(w), len(self.labels))) for w in words]
        post = self.posteriors(self.emissions(flat), lengths[lengths > 0])
        ends = np.cumsum(lengths)
        return words, [post[b - n:b] for b, n in zip(ends.tolist(), lengths.tolist())]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        _, post = self.word_labels(texts)
        names, scores = [], []
        for p in post:
            if not len(p) or not self.labels:
                names.append(UNKNOWN), scores.append(0.0)
                continue
            mean = p.mean(axis=0, dtype=np.float64)
            best = int(mean.argmax())
            names.append(self.labels[best]), scores.append(min(1.0, max(0.0, float(mean[best]))))
        return names, scores


def fit(lines: list[tuple[str, str]], seed: int = 7) -> Crf:
    """A model from (line, label) pairs, on chains of spans in different languages."""
    labels = sorted({label for _, label in lines})
    per = {label: [w for line, of in sorted(lines) if of == label for w in words_of(line)[:SAMPLE_WORDS]] for label in labels}
    labels = [label for label in labels if per[label]]
    k = len(labels)
    size = 1 << FEATURE_BITS
    model = Crf(labels, np.zeros((size, k), np.float64), np.zeros((k, k)))
    if k < 2:
        return model
    rng = np.random.default_rng(seed)
    spans = []                                                   # every sampled word is in one span
    for y, label in enumerate(labels):
        words, at = per[label], 0
        while at < len(words):
            n = int(rng.integers(*SPAN_WORDS))
            spans.append((y, words[at:at + n]))
            at += n
    rng.shuffle(spans)
    flat = [w for _, ws in spans for w in ws]
    gold = np.concatenate([np.full(len(ws), y) for y, ws in spans])
    chains = max(1, len(flat) // CHAIN_WORDS)
    length = min(CHAIN_WORDS, len(flat))
    flat, gold = flat[:chains * length], gold[:chains * length]
    code: dict[str, int] = {}
    place = np.array([code.setdefault(w, len(code)) for w in flat]).reshape(chains, length)
    gold = gold.reshape(chains, length)
    feature, owner = features(list(code))
    order = np.argsort(owner, kind="stable")
    feature, owner = feature[order], owner[order]
    begin = np.searchsorted(owner, np.arange(len(code) + 1))
    seen, seen_step = np.full((size, k), 1e-3), np.full((k, k), 1e-3)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(chains), max(1, chains // 128)):
            used, local = np.unique(place[part], return_inverse=True)
            width = begin[used + 1] - begin[used]
            pairs = np.repeat(begin[used] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
            feat = feature[pairs]
            first = np.cumsum(width) - width
            score = np.add.reduceat(model.weight[feat], first, axis=0)[local].reshape(len(part), length, k)
            grad, grad_step = _gradient(score, model.step, gold[part])
            by_word = np.zeros((len(used), k))
            np.add.at(by_word, local.reshape(-1), grad.reshape(-1, k))
            spread = np.repeat(by_word, width, axis=0)
            g = np.stack([np.bincount(feat, weights=spread[:, y], minlength=size) for y in range(k)], axis=1) / len(part)
            g += 1e-4 * model.weight * (g != 0)
            seen += g * g
            model.weight -= 0.2 * g / np.sqrt(seen)
            gs = grad_step / len(part)
            seen_step += gs * gs
            model.step -= 0.1 * gs / np.sqrt(seen_step)
    return model


def _gradient(score: np.ndarray, step: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the negative log-likelihood by scores and by transitions, chains of one length."""
    chains, length, k = score.shape
    near = np.exp(score - score.max(axis=2, keepdims=True))
    move = np.exp(step)
    forward, backward = np.empty_like(near), np.ones_like(near)
    for t in range(length):
        now = near[:, t] if t == 0 else (forward[:, t - 1] @ move) * near[:, t]
        forward[:, t] = now / now.sum(axis=1, keepdims=True)
    for t in range(length - 2, -1, -1):
        back = (near[:, t + 1] * backward[:, t + 1]) @ move.T
        backward[:, t] = back / back.sum(axis=1, keepdims=True)
    post = forward * backward
    post /= post.sum(axis=2, keepdims=True)
    target = np.eye(k)[gold]
    expected = np.zeros((k, k))
    for t in range(1, length):
        pair = forward[:, t - 1][:, :, None] * move[None] * (near[:, t] * backward[:, t])[:, None, :]
        expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    counted = np.zeros((k, k))
    np.add.at(counted, (gold[:, :-1].reshape(-1), gold[:, 1:].reshape(-1)), 1.0)
    return post - target, expected - counted


def training_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   sample_lines: int = SAMPLE_LINES) -> list[tuple[str, str]]:
    """The sampled (line, label) pairs: different lines of least hash per label, of rows whose
    crc32(id) mod 4 is not 2. Copies of a line are merged in the map tasks."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
                       & ~F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))) \
        .select(F.col(lang_col).cast("string").alias("__lang"), F.explode(F.split(text_col, "\n")).alias("__line")) \
        .withColumn("__line", F.substring("__line", 1, LINE_CHARS)) \
        .filter(F.col("__line").rlike(r"\p{L}")) \
        .withColumn("__place", F.shiftrightunsigned(F.xxhash64("__line"), 1) / F.lit(float(2 ** 63)))
    counts = {r[0]: r[1] for r in rows.groupBy("__lang").agg(F.approx_count_distinct("__line").alias("n")).limit(MOST_LABELS + 1).collect()}
    if not counts:
        return []
    if len(counts) > MOST_LABELS:
        raise ValueError(f"{len(counts)} labels; a model is fitted for {MOST_LABELS} at most")
    share = {lang: min(1.0, 1.5 * sample_lines / max(n, 1)) for lang, n in counts.items()}
    limit = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("__lang")]
    picked = rows.filter(F.col("__place") < limit).groupBy("__lang", "__line").agg(F.min("__place").alias("__place")).collect()
    out: list[tuple[str, str]] = []
    for lang in sorted(counts):
        own = sorted((r["__place"], r["__line"]) for r in picked if r["__lang"] == lang)
        out += [(line, lang) for _, line in own[:sample_lines]]
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_lines: int = SAMPLE_LINES) -> Crf:
    return fit(training_lines(docs, id_col, text_col, lang_col, sample_lines))


def _small(model: Crf) -> Crf:
    return Crf(model.labels, model.weight.astype(np.float32), model.step.astype(np.float32))


def language_of(docs: DataFrame, model: Crf) -> Callable[[Column], Column]:
    """Text column -> struct (lang_pred, score) of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(_small(model))      # fixed size: 2^16 weights a label

    @F.arrow_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(texts: pa.Array) -> pa.Array:
        names: list[str] = []
        scores: list[float] = []
        for _, part in slices(texts, texts, CHUNK_BYTES):
            n, s = shared.value.predict(part)
            names += n
            scores += s
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return lambda text: predict(text_or_empty(text))


def identify(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each whole text."""
    return docs.select(F.col(id_col), language_of(docs, model)(F.col(text_col)).alias("__p")) \
        .select(F.col(id_col), F.col("__p.lang_pred").alias("lang_pred"), F.col("__p.score").alias("score"))


def accepted(docs: DataFrame, model: Crf, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns as they were, whose language is known with ``min_score`` or more."""
    return docs.withColumn("__language", language_of(docs, model)(docs[text_col])) \
        .filter((F.col("__language.lang_pred") != UNKNOWN) & (F.col("__language.score") >= min_score)) \
        .select(*[docs[c] for c in docs.columns])


def label_words(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, words array of (word, label, score)): the language of every word in order."""
    shared = docs.sparkSession.sparkContext.broadcast(_small(model))
    kind = pa.list_(pa.struct([("word", pa.string()), ("label", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows: list[list[dict]] = []
            for _, part in slices(batch, batch.column(1), CHUNK_BYTES):
                for words, post in zip(*own.word_labels(part)):
                    best = post.argmax(axis=1).tolist() if own.labels and len(words) else []
                    rows.append([{"word": w, "label": own.labels[b], "score": float(p[b])} for w, b, p in zip(words, best, post)]
                                if own.labels else [{"word": w, "label": UNKNOWN, "score": 0.0} for w in words])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=[id_col, "words"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType),
                           T.StructField("words", T.ArrayType(T.StructType([
                               T.StructField("word", T.StringType()), T.StructField("label", T.StringType()),
                               T.StructField("score", T.DoubleType())])))])
    return docs.select(F.col(id_col), text_or_empty(text_col).alias("__text")).mapInArrow(run, schema)
