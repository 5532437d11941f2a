"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's features are its byte n-grams with its borders, hashed to rows of an embedding
table; a window of words is the mean of its features' embeddings, and a linear softmax tells
toxic windows from clean ones.  Table and softmax are trained jointly in numpy.  The word as
a whole is no feature of its own, which would take weight from the n-grams: a misspelt word
shares most n-grams with the word it stands for.  A document is judged by its most toxic
window, so a long text does not hide a short insult.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainwise.llm.common import BLOCK_BYTES, keep, remainder, word_blocks

BUCKET_BITS, DIM, LENGTHS = 17, 8, (3, 4, 5)
#: Words of a window.
WINDOW = 4
#: Bound of the fit: labelled documents per class, and bytes of text after which a class takes
#: no further document.  Documents that take part are read whole.
DOCS_PER_CLASS, BYTES_PER_CLASS = 3_000, 1 << 25
#: Windows that a step of the fit handles at once.
STEP = 1 << 16
#: Epochs, those that trust every label, step and decay of the fit, and how steeply belief counts.
EPOCHS, TRUSTING, RATE, DECAY, BELIEF = 40, 12, 0.08, 1e-5, 4
FOLDS = 5

_BREAKS = b".,;:!?\"()[]{}<>|/\\*%&#"
_CLEAN = bytes(ord(" ") if i < 32 or i in _BREAKS else i for i in range(256)).lower()


def clean(text: bytes | None) -> list[bytes]:
    """Words in lower case (A-Z); punctuation breaks words."""
    return (text or b"").translate(_CLEAN).split()


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all words in order of the words, and each word's number of them."""
    text = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    word_of = np.repeat(np.arange(len(words)), lengths + 1)  # of the blank before a word, and its letters
    letters, blank = text.astype(np.uint32), text == 32
    hashes, owner = [], []
    inner = blank[1:]
    mixed, crossed = letters, np.zeros(len(text), bool)
    for n in range(2, max(LENGTHS) + 1):
        size = len(text) - n + 1
        if size <= 0:
            break
        mixed = mixed[:size] * np.uint32(0x01000193) ^ letters[n - 1:]
        crossed = crossed[:size] | (inner[n - 3:n - 3 + size] if n > 2 else False)
        if n in LENGTHS:
            good = np.nonzero(~crossed)[0]
            hashes.append(mixed[good] + np.uint32(n))
            owner.append(word_of[good])
    hashes, owner = np.concatenate(hashes), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    buckets = (hashes * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
    return buckets[order].astype(np.int64), np.bincount(owner, minlength=len(words))


def numbered(words: list[bytes]) -> tuple[bytes, bytes]:
    """A text's distinct words in order, joined by blanks, and each word's number among them."""
    distinct = list(dict.fromkeys(words))
    place = dict(zip(distinct, range(len(distinct))))
    return b" ".join(distinct), np.fromiter(map(place.__getitem__, words), np.int32, len(words)).tobytes()


def windows_of(numbers: np.ndarray) -> np.ndarray:
    """All windows of a text given as word numbers from 1: a grid, and one that ends at the last
    word if the grid does not.  0 stands beyond the end of a text shorter than a window."""
    if len(numbers) < WINDOW:
        return np.pad(numbers, (0, WINDOW - len(numbers)))[None] if len(numbers) else np.zeros((0, WINDOW), np.int32)
    grid = numbers[:len(numbers) // WINDOW * WINDOW].reshape(-1, WINDOW)
    return np.concatenate([grid, numbers[None, -WINDOW:]]) if len(numbers) % WINDOW else grid


@dataclass
class Model:
    """``weight``: what a feature adds to the log odds of its window's mean; then the
    calibration of a document's highest window and number of windows."""

    weight: np.ndarray
    bias: float = 0.0
    scale: tuple[float, float, float] = (1.0, 0.0, 0.0)
    floor: float = 0.0  #: log odds that stand for a text without words

    def highest(self, text: bytes | None) -> tuple[float, int]:
        """Log odds of the most toxic window, and the number of words."""
        top, total, carried = -np.inf, 0, []
        for words in word_blocks((text or b"").translate(_CLEAN), BLOCK_BYTES):
            if not words:
                continue
            part = carried + words
            buckets, n = features(part)
            total += len(part) - len(carried)
            ends = np.cumsum(n)
            sums = np.concatenate([[0.0], np.cumsum(self.weight[buckets], dtype=np.float64)])[np.concatenate([[0], ends])]
            counts = np.concatenate([[0], ends])
            size = min(WINDOW, len(part))
            mean = (sums[size:] - sums[:-size]) / (counts[size:] - counts[:-size])
            top = max(top, float(mean.max()))
            carried = part[len(part) - WINDOW + 1:] if len(part) >= WINDOW else part
        return (top + self.bias if total else self.floor), total

    def score(self, text: bytes | None) -> float:
        top, n = self.highest(text)
        a, b, c = self.scale
        return float(1 / (1 + np.exp(-np.clip(a * top + b * np.log1p(n) + c, -30, 30))))


def fit_windows(words: list[bytes], windows: list[np.ndarray], seed: int = 11) -> Model:
    """Full-batch Adam on the embedding table and the softmax, half of the weight to each class.
    ``windows``: the clean ones and the toxic ones, as numbers from 1 into ``words``.  Windows of
    toxic documents carry no insult of their own in most cases; after ``TRUSTING`` epochs each
    counts by the model's belief in it."""
    buckets, n = features(words)
    used, compact = np.unique(buckets, return_inverse=True)
    first = np.cumsum(n) - n
    lengths = np.concatenate([[0], n]).astype(np.float32)
    rng = np.random.default_rng(seed)
    parameters = [rng.normal(0, 0.1, (DIM, len(used))).astype(np.float32), rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    table, softmax, bias = parameters
    for epoch in range(EPOCHS):
        vectors = np.zeros((len(words) + 1, DIM), np.float32)
        for d, row in enumerate(table):  # one dimension at a time fits the processor's cache
            vectors[1:, d] = np.add.reduceat(row[compact], first)
        by_word, slopes = np.zeros((DIM, len(words) + 1)), [DECAY * table, DECAY * softmax, 0.0]
        for label, own in enumerate(windows):
            total, of_class, by_own = 1e-9, [0.0, 0.0], np.zeros_like(by_word)
            for i in range(0, len(own), STEP):
                ids = own[i:i + STEP]
                size = lengths[ids].sum(axis=1, keepdims=True)
                mean = vectors[ids].sum(axis=1) / size
                odds = mean @ softmax + bias
                chance = np.exp(odds - odds.max(axis=1, keepdims=True))
                chance /= chance.sum(axis=1, keepdims=True)
                share = np.ones(len(ids))
                if label and epoch >= TRUSTING:
                    share = np.clip(BELIEF * (chance[:, 1] - 0.5), 0, 1) + 0.01
                total += share.sum()
                error = (chance - np.eye(2)[label]) * share[:, None]
                of_class[0] += mean.T @ error
                of_class[1] += error.sum(axis=0)
                back = np.repeat((error @ softmax.T) / size, WINDOW, axis=0)
                flat = ids.ravel()
                for d in range(DIM):
                    by_own[d] += np.bincount(flat, back[:, d], len(words) + 1)
            by_word += by_own / (2 * total)
            slopes[1] = slopes[1] + of_class[0] / (2 * total)
            slopes[2] = slopes[2] + of_class[1] / (2 * total)
        for d, own in enumerate(by_word):
            slopes[0][d] += np.bincount(compact, np.repeat(own[1:], n), len(used))
        for p, g, (m, v) in zip(parameters, slopes, moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= RATE * (m / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(v / (1 - 0.99 ** (epoch + 1))) + 1e-8)
    weight = np.zeros(1 << BUCKET_BITS)
    weight[used] = (softmax[:, 1] - softmax[:, 0]) @ table
    return Model(weight, float(bias[1] - bias[0]))


def gather(texts: list[tuple[int, bytes, bytes]]) -> tuple[list[bytes], list[np.ndarray]]:
    """Words and windows (see :func:`fit_windows`) of texts given as mark and :func:`numbered`."""
    vocabulary: dict[bytes, int] = {}
    found: list[list[np.ndarray]] = [[np.zeros((0, WINDOW), np.int32)], [np.zeros((0, WINDOW), np.int32)]]
    for mark, words, numbers in texts:
        place = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words.split()], np.int32)
        own = np.frombuffer(numbers, np.int32)
        found[mark].append(windows_of(place[own] if len(own) else own))
    return list(vocabulary), [np.concatenate(x) for x in found]


def calibrate(tops: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression of the label on a document's highest window and length."""
    x = np.stack([tops, np.log1p(sizes), np.ones(len(tops))], axis=1)
    centre, spread = x[:, :2].mean(axis=0), x[:, :2].std(axis=0) + 1e-9
    x[:, :2] = (x[:, :2] - centre) / spread
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weights * (p - labels)) + 1e-3 * weights.sum() * w * [1, 1, 0] * 0.01
        curve = (x * (weights * (p * (1 - p) + 1e-9))[:, None]).T @ x + 1e-5 * weights.sum() * np.eye(3)
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -2, 2)
    a, b = w[:2] / spread
    return float(a), float(b), float(w[2] - a * centre[0] - b * centre[1])


def constant(total: dict[int, int]) -> Model:
    """A model that gives every text the share of toxic labels."""
    share = min(max(total.get(1, 0) / max(sum(total.values()), 1), 1e-6), 1 - 1e-6)
    return Model(np.zeros(1 << BUCKET_BITS), 0.0, (0.0, 0.0, float(np.log(share / (1 - share)))))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """Fits on labelled documents whose crc32(doc_id) is not 0 modulo ``FOLDS``.

    At most ``DOCS_PER_CLASS`` documents a class take part, those with the smallest hash of
    their id: half give all their windows to the embeddings, as word numbers and in that order
    until a class has ``BYTES_PER_CLASS`` of text, half calibrate; there classes count by their
    numbers in all labels.  A document with several labels has the highest, an id with several
    texts gives the smallest.  Without both
    classes among them the score is the share of toxic labels for every text."""
    marked = (labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("mark")).where("id is not null and mark in (0, 1)")
              .where(remainder(F.col("id"), FOLDS) != 0).groupBy("id").agg(F.max("mark").alias("mark")))
    total = {r.mark: r.n for r in marked.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("id")
    chosen = None
    for mark in (0, 1):
        own = marked.where(F.col("mark") == mark).orderBy(order, "id").limit(DOCS_PER_CLASS)
        chosen = own if chosen is None else chosen.union(own)
    rows = [(r.id, r.mark) for r in chosen.collect()]
    if len(total) < 2:
        return constant(total)
    spark = docs.sparkSession
    wanted = spark.createDataFrame(rows, f"id {marked.schema['id'].dataType.simpleString()}, mark int")
    own = keep(docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
               .join(F.broadcast(wanted), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("mark").alias("mark"))
               .withColumn("fit", F.pmod(F.xxhash64(F.col("id"), F.lit(3)), F.lit(2)) == 0))
    before = Window.partitionBy("mark").orderBy(order, "id").rowsBetween(Window.unboundedPreceding, -1)  # of DOCS_PER_CLASS rows
    sizes = own.where("fit").select("id", "mark", F.length("text").alias("bytes"))
    within = sizes.withColumn("before", F.sum("bytes").over(before)).where(F.coalesce("before", F.lit(0)) < BYTES_PER_CLASS)

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(int(m), *numbered(clean(t))) for t, m in zip(b.text, b.mark)], columns=["mark", "words", "numbers"])

    texts = own.where("fit").join(F.broadcast(within.select("id")), "id", "left_semi")
    found = texts.mapInPandas(numbers, "mark int, words binary, numbers binary").toPandas()
    words, windows = gather(sorted((m, bytes(w), bytes(n)) for m, w, n in found.itertuples(index=False)))
    if not all(map(len, windows)):
        return constant(total)
    model = fit_windows(words, windows)

    def tops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [model.highest(t) for t in b.text]
            yield pd.DataFrame({"mark": b.mark, "top": [t for t, _ in own], "size": [n for _, n in own]})

    held = own.where("not fit").mapInPandas(tops, "mark int, top double, size bigint").toPandas().sort_values(["mark", "top", "size"])
    seen = held.mark.value_counts()
    if len(seen) == 2:
        weights = held.mark.map({m: total[m] / seen[m] for m in seen.index}).to_numpy(float)
        model.floor = float(held.top.min())
        model.scale = calibrate(held.top.to_numpy(), held["size"].to_numpy(float), held.mark.to_numpy(float), weights)
    return model


def toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5); columns of these names
    are replaced.  NULL and empty texts get the score of a text without words."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    scored = docs.drop("score", "predicted").withColumn("score", score(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
