"""Toxicity by subword-bag embeddings and a linear softmax, trained together in numpy.

A word is a bag of the hashed character n-grams of ``<word>`` and of the whole of it, so a
misspelling that training never met shares most of its vectors with the known word. The
vectors of a window of ``WINDOW`` words are averaged and go through a linear softmax of two
classes; a text shorter than a window is filled up with empty words, whose vector is zero,
and a word that repeats inside a window's length counts once. A document is as toxic as its
most toxic window, which keeps a few words from drowning in a long text. Embeddings and
softmax are fitted by one gradient descent: first on all windows with their document's
label, then with only the most toxic windows of toxic documents as positives. A last
logistic step maps the document's margin to a probability at the labels' own rate.

Training takes at most about ``train_toxic`` and ``train_clean`` documents, chosen by a
hash of their id, of each id and label at most ``train_rows`` rows, and only texts up to
``train_chars`` characters: the documented bound of the sample that the driver holds, as
numbers of words. Scoring reads whole texts.

Since all of it is linear up to the softmax, a word's contribution is one number; words
met before come from a cache, which is bounded in words and keeps none longer than
``CACHED`` characters.

Defined cases: a null, empty or blank text gets the score of a margin without words; null
labels and labels of unknown documents are not trained on; a document with several labels
counts once for each; null and repeated ids keep their rows; without both labels in the
training rows every score is the share of toxic ones, or 0; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm import workercache
from sheaf.llm.langid import fold
from sheaf.runtime import quoted, ship

WINDOW = 8
CACHED = 64
BUCKETS = 1 << 17
SIZES = (3, 4, 5)
_EDGE = " \t\n\r\x0b\x0c.,;:!?\"'()[]{}<>|/\\*#%&$@^~`+=-_"
_PRIMES = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)


def clean(word: str) -> str:
    return word.lower().strip(_EDGE)


def word_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words one after another, number of buckets of each word)."""
    wrapped = [b"<" + w.encode("utf-8", "replace") + b">" for w in words]
    data = np.frombuffer(b"".join(wrapped), dtype=np.uint8).astype(np.uint32)
    sizes = np.array([len(w) for w in wrapped])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    room = np.repeat(ends, sizes) - np.arange(len(data))  # bytes left in the word
    found, owners = [], []
    for n in SIZES:
        h = np.zeros(max(0, len(data) - n + 1), dtype=np.uint32)
        for k in range(n):
            h = (h ^ (data[k : len(data) - n + 1 + k] + np.uint32(1))) * _PRIMES[k]
            h ^= h >> np.uint32(15)
        at = np.flatnonzero(room[: len(h)] >= n)
        found.append(h[at] ^ np.uint32(n))
        owners.append(owner[at])
    place = (np.arange(len(data)) - np.repeat(ends - sizes, sizes)).astype(np.uint32)
    mixed = (data + np.uint32(1)) * ((place + np.uint32(7)) * _PRIMES[4] ^ (place << np.uint32(9)))
    whole = np.add.reduceat(mixed ^ (mixed >> np.uint32(11)), ends - sizes, dtype=np.uint32)
    found.append(whole ^ (whole >> np.uint32(13)))
    owners.append(np.arange(len(words)))
    owner, bucket = np.concatenate(owners), np.concatenate(found)
    bucket = ((bucket * np.uint32(0x2C1B3C6D)) >> np.uint32(15)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.bincount(owner, minlength=len(words))


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    return np.add.reduceat(values, starts, axis=0)


class Model:
    """One number for each bucket: its embedding times the difference of the two softmax rows.
    ``layers`` keeps what was fitted: buckets, their embeddings, softmax rows and biases."""

    def __init__(self, weight: np.ndarray, bias: float, scale: float, shift: float, layers: tuple | None = None):
        self.weight, self.bias, self.scale, self.shift, self.layers = weight.astype(np.float32), bias, scale, shift, layers

    def word_scores(self, words: list[str]) -> np.ndarray:
        bucket, size = word_buckets(words)
        return _sums(self.weight[bucket].astype(np.float64), size) / size

    def probability(self, margin: float) -> float:
        z = max(-40.0, min(40.0, self.scale * margin + self.shift))
        return float(1 / (1 + np.exp(-z)))


class Scorer:
    """Margins of texts. Words are numbered by what :func:`clean` leaves of them."""

    def __init__(self, model: Model, cache_words: int = 300_000):
        self.model, self.limit = model, cache_words
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}  # of a word as it stands in a text
        self.cleaned: dict[str, int] = {}
        self.scores = np.zeros(1024)
        self.known = 0

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            fresh: list[str] = []
            for w in words[at : at + 20_000]:
                c = clean(w)
                if c not in self.cleaned:
                    self.cleaned[c] = self.known + len(fresh)
                    fresh.append(c)
                self.number[w] = self.cleaned[c]
            if fresh:
                while self.known + len(fresh) > len(self.scores):
                    self.scores = np.concatenate((self.scores, np.zeros(len(self.scores))))
                self.scores[self.known : self.known + len(fresh)] = self.model.word_scores(fresh)
                self.known += len(fresh)

    def margins(self, texts: list[str | None]) -> list[float]:
        split = [t.split() if t else [] for t in texts]
        if max(len(self.number), self.known) > self.limit:
            self._forget()
        new = list(set().union(*split).difference(self.number))
        self._learn(new)
        numbers = self.number
        out = [document_margin(np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)), self.scores) + self.model.bias for w in split]
        for w in new:
            if len(w) > CACHED:
                del numbers[w]
                self.cleaned.pop(clean(w), None)
        return out


def document_margin(words: np.ndarray, scores: np.ndarray) -> float:
    """The greatest mean of windows of WINDOW words, half a window apart, without the bias.

    A word that repeats within a window's length counts once, so that one word over and over
    is not taken for a passage."""
    n = len(words)
    if not n:
        return 0.0
    values = scores[words]
    again = np.zeros(n, dtype=bool)
    for d in range(1, min(WINDOW, n)):
        again[d:] |= words[d:] == words[:-d]
    values[again] = 0.0
    if n <= WINDOW:
        return float(values.sum() / WINDOW)
    total = np.concatenate(([0.0], np.cumsum(values)))
    at = np.arange(0, n - WINDOW + 1, WINDOW // 2)
    if at[-1] != n - WINDOW:
        at = np.append(at, n - WINDOW)
    return float((total[at + WINDOW] - total[at]).max() / WINDOW)


class Sample:
    """Training documents as numbers of their words."""

    def __init__(self) -> None:
        self.cleaned: dict[str, int] = {}
        self._raw: dict[str, int] = {}
        self.documents: list[np.ndarray] = []
        self.labels: list[int] = []

    def add(self, text: str, label: int) -> None:
        words, raw, cleaned = text.split(), self._raw, self.cleaned
        for w in set(words).difference(raw):
            raw[w] = cleaned.setdefault(clean(w), len(cleaned))
        self.documents.append(np.fromiter(map(raw.__getitem__, words), np.int32, len(words)))
        self.labels.append(label)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words of all windows one after another, number of words of each window, its
        document); words that repeat in a window count once."""
        flat, sizes, of = [], [], []
        for d, words in enumerate(self.documents):
            if len(words):
                rows = np.pad(words, (0, -len(words) % WINDOW), constant_values=-1).reshape(-1, WINDOW)
                rows = np.sort(rows, axis=1)
                rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = -1
                flat.append(rows[rows >= 0])
                sizes.append((rows >= 0).sum(axis=1))
                of.append(np.full(len(rows), d))
        if not flat:
            return (np.zeros(0, dtype=np.int32),) * 3
        return np.concatenate(flat), np.concatenate(sizes), np.concatenate(of)


def _buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [word_buckets(words[at : at + 20_000]) for at in range(0, len(words), 20_000)]
    return np.concatenate([b.astype(np.int32) for b, _ in parts]), np.concatenate([n for _, n in parts])


def fit(sample: Sample, share: float, *, dim: int = 8, steps: tuple[int, int] = (25, 45),
        rate: float = 0.05, decay: float = 2e-3, seed: int = 11) -> Model:
    """Fit on the sample; ``share`` is the labels' own rate of toxic documents."""
    zero = np.zeros(BUCKETS)
    labels = np.array(sample.labels, dtype=np.int64)
    word_at, sizes, doc = sample.windows()
    if not len(doc) or labels.min() == labels.max():
        odds = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return Model(zero, 0.0, 1.0, float(np.clip(odds, -40, 40)))
    y = labels[doc].astype(np.float32)
    bucket, per = _buckets(list(sample.cleaned))
    used = np.flatnonzero(np.bincount(bucket, minlength=BUCKETS))
    name = np.zeros(BUCKETS, dtype=np.int32)
    name[used] = np.arange(len(used), dtype=np.int32)
    bucket = name[bucket]
    owner = np.repeat(np.arange(len(per), dtype=np.int32), per)[np.argsort(bucket, kind="stable")]  # words by bucket
    bucket_sizes = np.bincount(bucket, minlength=len(used))
    window_of = np.repeat(np.arange(len(doc), dtype=np.int32), sizes)[np.argsort(word_at, kind="stable")]  # windows by word
    word_sizes = np.bincount(word_at, minlength=len(per))
    met = np.flatnonzero(word_sizes)
    per = per.astype(np.float32)
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.1, (len(used), dim)).astype(np.float32)
    w = rng.normal(0, 0.1, (2, dim)).astype(np.float32)
    b = np.zeros(2, dtype=np.float32)
    params, first = [e, w, b], [np.zeros_like(p) for p in (e, w, b)]
    second = [np.zeros_like(p) for p in (e, w, b)]
    starts = np.concatenate(([0], np.flatnonzero(doc[1:] != doc[:-1]) + 1))
    spans = np.diff(np.append(starts, len(doc)))
    toxic = y == 1
    flat = np.where(toxic, 0.5 / max(1, int(toxic.sum())), 0.5 / max(1, int((~toxic).sum()))).astype(np.float32)
    g_word = np.zeros(len(per), dtype=np.float32)
    for step in range(sum(steps)):
        # averaging and the softmax's difference are linear, so sums of products do
        scores = _sums((e @ (w[1] - w[0]))[bucket], per.astype(np.int64)) / per
        margin = _sums(scores[word_at], sizes) / WINDOW + (b[1] - b[0])
        p = 1 / (1 + np.exp(-margin))
        weight = flat
        if step >= steps[0]:  # positives: the most toxic window of each toxic document, and what comes near it
            best = np.repeat(np.maximum.reduceat(margin, starts), spans)
            pick = toxic & (margin >= best - 1e-6)
            weight = np.where(pick, 0.5 / pick.sum(), np.where(toxic, 0.0, 0.5 / (~toxic).sum())) * np.where(~toxic & (margin > 0), 20.0, 1.0)
        g = ((p - y) * weight).astype(np.float32)
        diff = w[1] - w[0]
        g_word[met] = _sums((g / np.float32(WINDOW))[window_of], word_sizes[met])
        g_bucket = _sums((g_word / per)[owner], bucket_sizes)
        gw = g_bucket @ e
        grads = [g_bucket[:, None] * diff[None, :] + np.float32(decay / len(used)) * e, np.stack((-gw, gw)), np.array([-g.sum(), g.sum()], dtype=np.float32)]
        for x, gx, m, v in zip(params, grads, first, second):
            m *= 0.9
            m += 0.1 * gx
            v *= 0.99
            v += 0.01 * gx * gx
            x -= rate * (m / (1 - 0.9 ** (step + 1))) / (np.sqrt(v / (1 - 0.99 ** (step + 1))) + 1e-7)
    table = zero.copy()
    table[used] = e @ (w[1] - w[0])
    model = Model(table, float(b[1] - b[0]), 1.0, 0.0, (used, e, w, b))
    scores = _sums(model.weight[used][bucket].astype(np.float64), per.astype(np.int64)) / per
    margins = np.array([document_margin(d, scores) + model.bias for d in sample.documents])
    model.scale, model.shift = _calibrate(margins, labels, share)
    return model


def _calibrate(margin: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float]:
    """A logistic of the margin with softened targets, at the labels' own rate."""
    pos, neg = int(labels.sum()), int((1 - labels).sum())
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(labels == 1, share / pos, (1 - share) / neg)
    x = np.stack((margin, np.ones_like(margin)), axis=1)
    theta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        grad = x.T @ ((p - target) * weight) + np.array([1e-6, 0]) * theta
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-8 * np.eye(2)
        theta -= np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(max(theta[0], 1e-3)), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, *, train_toxic: int = 1000, train_clean: int = 3000, train_chars: int = 30_000,
          train_rows: int = 2) -> Model:
    """``docs``: doc_id, text. ``labels``: doc_id, toxic (0 or 1)."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    most = F.when(F.col("toxic") == 1, F.lit(train_toxic / max(1, counts.get(1, 0)))).otherwise(F.lit(train_clean / max(1, counts.get(0, 0))))
    chosen = known.where(draw < most).withColumn("turn", F.monotonically_increasing_id())
    # the sample is bounded by its parameters, so it may be broadcast
    rows = docs.where(F.length("text") <= train_chars).join(F.broadcast(chosen), "doc_id").withColumn("h", F.xxhash64("text"))
    place = F.row_number().over(Window.partitionBy("doc_id", "turn").orderBy("h"))
    rows = rows.withColumn("place", place).where(F.col("place") <= train_rows)
    found = rows.select("doc_id", "h", "turn", "toxic", "text").toArrow()
    sample = Sample()
    keys = [found.column(c).to_numpy() for c in ("toxic", "turn", "h", "doc_id")]
    for at in np.lexsort((keys[0], keys[2], keys[3])).tolist():
        sample.add(found.column("text")[at].as_py(), int(keys[0][at]))
    del found
    return fit(sample, share)


def _scorer(state: tuple) -> Scorer:
    """The worker's scorer for a model; its cache outlives a task, another model replaces it."""
    weight, bias, scale, shift = state
    key = ("toxicity", zlib.crc32(weight.tobytes()), bias, scale, shift)
    return workercache.keep(key, lambda: Scorer(Model(*state)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of rows ``doc_id, text``."""
    ship(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias, model.scale, model.shift))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(given.value)
        own = scorer.model
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [own.probability(m) for m in scorer.margins(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.mapInArrow(scan, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
             threshold: float = 0.3, **sample: int) -> DataFrame:
    """doc_id, held_out, score, predicted; documents of fold 2 of 4 are never trained on."""
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    marks = labels.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(label_col)).alias("toxic"))
    model = train(rows, marks.where(fold(F.col("doc_id"), 4) != 2), **sample)
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    found = score(rows, model)
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def with_scores(docs: DataFrame, model: Model, text_col: str, keep) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose probability ``keep`` accepts."""
    spark = docs.sparkSession
    ship(spark)
    place = docs.columns.index(text_col)
    given = spark.sparkContext.broadcast((model.weight, model.bias, model.scale, model.shift))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(given.value)
        own = scorer.model
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [keep(own.probability(m)) for m in scorer.margins(part.column(place).to_pylist())]
                yield part.filter(pa.array(found, pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
