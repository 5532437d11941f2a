"""Quality by weak labels: heuristic labellers, their accuracies by EM, a hashed linear scorer.

Each labeller votes good, bad or not at all.  Votes of all documents are counted by pattern;
expectation-maximisation on the counts estimates how often each labeller votes what for good
and for bad documents, and gives every pattern a posterior.  Posteriors of a bounded sample
train a linear scorer on hashed features, which also judges texts on which no labeller votes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.llm.common import BLOCK_BYTES, word_blocks

#: Documents whose features train the scorer: those with the smallest hash of their text.
SAMPLE_DOCS = 4_000
BUCKET_BITS = 16
#: Rounds of expectation-maximisation at most; epochs, step and decay of the scorer's fit.
ROUNDS, EPOCHS, RATE, DECAY = 200, 120, 0.3, 1e-4
GOOD, BAD, NONE = 2, 1, 0

_UPPER = bytes(range(65, 91))
_NOT_UPPER_OR_LOWER = bytes(i for i in range(256) if not (65 <= i <= 90 or 97 <= i <= 122))
_NOT_SYMBOL = bytes(i for i in range(256) if chr(i) not in "*#$%&@^~=+<>_\\")
_PLAIN = frozenset(i for i in range(256) if 48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122 or i >= 128) | frozenset(b".,;:'-")
_NOT_ODD = bytes(i for i in range(256) if i in _PLAIN or i in b" \t\n\x0b\x0c\r\"()?!")
#: What counts as bad from, and as good up to, per labeller.  They overlap: each sort of
#: noise is seen by two or three of them.
LABELLERS = {
    "symbols": (0.30, 0.05),        # decorative symbols per word
    "odd": (0.30, 0.08),            # bytes per word that prose does not use
    "endings": (0.40, 0.15),        # words that do not end in a letter, digit or . , ; : ' -
    "shouting": (0.50, 0.15),       # capitals among the letters
    "marks": (0.25, 0.05),          # "!!" and "??" per word
    "bars": (0.20, 0.02),           # "|" per word
    "repeats": (0.20, 0.05),        # words equal to the one before
    "variety": (0.60, 0.45),        # 1 - distinct words among words, in blocks of 64
    "hoard": (0.25, 0.15),          # share of the most frequent word, in blocks of 64
}


def measures(text: bytes | None) -> list[float] | None:
    """The labellers' measures, None for a text without words.  Texts are read in blocks."""
    n = same = fresh = odd_ends = most = 0
    last = None
    for words in word_blocks(text or b""):
        if not words:
            continue
        n += len(words)
        same += sum(map(bytes.__eq__, words, words[1:])) + (words[0] == last)
        last = words[-1]
        odd_ends += sum(w[-1] not in _PLAIN for w in words)
        for i in range(0, len(words), 64):
            block = words[i:i + 64]
            distinct = set(block)
            fresh += len(distinct)
            most += max(Counter(block).values()) if 2 * len(distinct) < len(block) else 1
    if not n:
        return None
    letters = text.translate(None, _NOT_UPPER_OR_LOWER)
    capitals = len(letters) - len(letters.translate(None, _UPPER))
    return [len(text.translate(None, _NOT_SYMBOL)) / n, len(text.translate(None, _NOT_ODD)) / n, odd_ends / n,
            capitals / max(len(letters), 1), (text.count(b"!!") + text.count(b"??")) / n, text.count(b"|") / n,
            same / n, 1 - fresh / n, most / n]


def votes(text: bytes | None) -> int:
    """Votes of all labellers as digits of a number to base 3; a text without words is bad
    to every labeller."""
    found, code = measures(text), 0
    for i, (bad, good) in enumerate(LABELLERS.values()):
        x = 1.0 if found is None else found[i]
        code = 3 * code + (BAD if x >= bad else GOOD if x <= good else NONE)
    return code


def digits(codes: np.ndarray) -> np.ndarray:
    """Votes (rows: patterns; columns: labellers)."""
    powers = 3 ** np.arange(len(LABELLERS) - 1, -1, -1)
    return codes[:, None] // powers % 3


@dataclass
class WeakLabels:
    """Share of good documents, each labeller's chances of its votes (labeller, class, vote),
    and the posterior of being good for every pattern that occurs."""

    prior: float
    chances: np.ndarray
    posterior: dict[int, float] = field(default_factory=dict)


def estimate(codes: np.ndarray, counts: np.ndarray) -> WeakLabels:
    """Expectation-maximisation on pattern counts, from the vote of the labellers: a pattern
    starts as bad if any of them says so."""
    ballots, weight = digits(codes), counts / counts.sum()
    good = np.where((ballots == BAD).any(axis=1), 0.1, 0.9)
    for _ in range(ROUNDS):
        classes = np.stack([1 - good, good], axis=1) * weight[:, None]
        share = classes.sum(axis=0)
        chances = np.stack([[(classes * (ballots[:, j] == v)[:, None]).sum(axis=0) for v in (NONE, BAD, GOOD)]
                            for j in range(ballots.shape[1])])  # labeller, vote, class
        chances = (chances + 1e-4) / (share + 3e-4)
        log = np.log(share + 1e-9) + sum(np.log(chances[j][ballots[:, j]]) for j in range(ballots.shape[1]))
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -40, 40)))
        done = np.abs(new - good).max() < 1e-9
        good = new
        if done:
            break
    return WeakLabels(float(share[1]), chances.transpose(0, 2, 1), dict(zip(codes.tolist(), good.tolist())))


# -- hashed linear scorer ------------------------------------------------------------
_SHAPE = np.array([1 if 65 <= i <= 90 else 2 if 97 <= i <= 122 or i >= 128 else 3 if 48 <= i <= 57 else 4 if i in (9, 10, 11, 12, 13)
                   else i for i in range(256)], np.uint32)
_PLACE = np.random.default_rng(5).integers(1, 1 << 32, 64, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def feature_blocks(text: bytes | None) -> Iterator[np.ndarray]:
    """Buckets of a text's features, block by block: shapes of four bytes in a row, and
    whether a word equals the one before, per word."""
    text = text or b""
    for start in range(0, len(text), BLOCK_BYTES):
        part = np.frombuffer(text[start:start + BLOCK_BYTES + 3], np.uint8)
        shape = _SHAPE[part]
        mixed = shape.copy()
        for i in range(1, min(4, len(part))):
            mixed = mixed[:len(part) - i] * np.uint32(0x01000193) ^ shape[i:]
        space = np.nonzero((part == 32) | (shape == 4))[0]
        ends = np.append(space, len(part))
        starts = np.concatenate([[0], space + 1])
        some = ends > starts
        starts, ends = starts[some], ends[some]
        found = [mixed * np.uint32(2) + np.uint32(1)]
        if len(starts):
            lengths = np.repeat(starts, np.diff(np.append(starts, len(part))))
            place = np.arange(starts[0], len(part)) - lengths
            inside = np.where((part[starts[0]:] == 32) | (shape[starts[0]:] == 4), 0, part[starts[0]:]).astype(np.uint32)
            words = np.add.reduceat(inside * _PLACE[place & 63], starts - starts[0], dtype=np.uint32)
            same = (words[1:] == words[:-1]).astype(np.uint32)
            found.append(np.uint32(0xABCD00) + same)
        yield ((np.concatenate(found) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def profile(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and the square roots of their shares, scaled to length one."""
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for buckets in feature_blocks(text):
        total += np.bincount(buckets, minlength=len(total))
    some = np.nonzero(total)[0]
    return some, np.sqrt(total[some] / max(total.sum(), 1))


@dataclass
class Scorer:
    weight: np.ndarray
    bias: float

    def score(self, text: bytes | None) -> float:
        buckets, values = profile(text)
        return float(1 / (1 + np.exp(-np.clip(self.weight[buckets] @ values + self.bias, -30, 30))))


def fit(profiles: list[tuple[np.ndarray, np.ndarray]], goal: np.ndarray) -> Scorer:
    """Logistic regression on soft labels, full batches with momentum scaled per weight."""
    index = np.concatenate([b for b, _ in profiles]).astype(np.int64)
    value = np.concatenate([v for _, v in profiles])
    row = np.repeat(np.arange(len(profiles)), [len(b) for b, _ in profiles])
    weight, bias = np.zeros(1 << BUCKET_BITS), 0.0
    pace, pace_bias = np.full(len(weight), 1e-8), 1e-8
    for _ in range(EPOCHS):
        odds = np.bincount(row, weight[index] * value, len(profiles)) + bias
        error = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - goal) / len(profiles)
        slope = np.bincount(index, error[row] * value, len(weight)) + DECAY * weight / len(profiles)
        pace += slope ** 2
        pace_bias += error.sum() ** 2
        weight -= RATE * slope / np.sqrt(pace)
        bias -= RATE * error.sum() / np.sqrt(pace_bias)
    return Scorer(weight, bias)


def binary(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit("")).cast("binary")


def vote_code(text: Column) -> Column:
    @F.pandas_udf("bigint")
    def code(texts: pd.Series) -> pd.Series:
        return pd.Series([votes(t) for t in texts], dtype="int64")

    return code(text)


def learn(docs: DataFrame, text_col: str = "text") -> tuple[WeakLabels, Scorer]:
    """Weak labels from the votes on all documents, and the scorer from a sample of them.

    An empty table gives a prior of one half and a scorer that says so."""
    found = docs.select(vote_code(binary(text_col)).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    rows = sorted((r.code, r.n) for r in found.collect())  # at most 3 ** labellers
    if not rows:
        return WeakLabels(0.5, np.zeros((len(LABELLERS), 2, 3))), Scorer(np.zeros(1 << BUCKET_BITS), 0.0)
    weak = estimate(np.array([c for c, _ in rows]), np.array([n for _, n in rows], float))

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [(votes(t), *profile(t)) for t in batch["text"]]
            yield pd.DataFrame([(c, b.astype(np.int32), v.astype(np.float32)) for c, b, v in own], columns=["code", "buckets", "shares"])

    texts = docs.select(binary(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    top = texts.select("hash").distinct().orderBy("hash").limit(SAMPLE_DOCS).agg(F.max("hash")).first()[0]
    chosen = texts.where(F.col("hash") <= top).dropDuplicates(["hash"])
    sample = chosen.select("text").mapInPandas(described, "code bigint, buckets array<int>, shares array<float>").collect()
    sample = sorted(sample, key=lambda r: (r.code, len(r.buckets), r.buckets[:8]))
    profiles = [(np.array(r.buckets, np.int64), np.array(r.shares, float)) for r in sample]
    return weak, fit(profiles, np.array([weak.posterior[r.code] for r in sample]))


def quality(docs: DataFrame, weak: WeakLabels, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """``docs`` with ``weak_label`` (posterior of its votes), ``score`` (of the scorer, 0 to 1)
    and ``keep`` (1 from 0.5); columns of these names are replaced.  A NULL text is empty.
    A pattern of votes that the fit did not meet has the prior."""
    @F.pandas_udf("weak_label double, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"weak_label": [weak.posterior.get(votes(t), weak.prior) for t in texts],
                             "score": [scorer.score(t) for t in texts]}, dtype="float64")

    bare = docs.drop("weak_label", "score", "keep")
    judged = bare.select(F.struct(*bare.columns).alias("doc"), judge(binary(text_col)).alias("judged"))
    return judged.select("doc.*", "judged.weak_label", "judged.score", (F.col("judged.score") >= 0.5).cast("int").alias("keep"))
