"""Quality classifier: a weak-label model over heuristic labellers trains a hashed linear scorer.

Labellers vote good, bad or nothing on each text; they overlap and no one is trusted. Expectation-maximisation over
the counts of all vote patterns of the whole corpus estimates how often each labeller casts each vote on good and on
bad texts, hence the probability that a text with a pattern is good. A linear scorer over hashed features (shapes of
tokens, shapes after the same token, sizes) is then trained on a bounded sample with those probabilities as labels,
and scores every text.

Defined results: a null or blank text gets no votes and no features, so its score is the scorer's offset; no labeller
votes on texts of fewer than 5 words, those of packed size and stop words not below 25 (ABSENT: shares of so few words
say nothing; the scorer still scores them); repeated rows are scored alike; empty tables and partitions give no rows;
without any bad vote everything is kept; columns besides the id and the text aren't read by `classify`, and further
columns, whatever their names, pass through `keep_good` untouched. Words are runs without white space; texts and words are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.quality_rules import STOP_FORMS
from sieveline.llm.text import free_name, keep_columns, ship_package, small_batches

#: NONE: the labeller found nothing to object to; ABSENT: the text is too short for it to be asked.
GOOD, BAD, NONE, ABSENT = 1, 0, -1, -2

#: Rows the linear scorer is trained on at most, the first by a hash of the id and the text.
TRAIN_ROWS = 6_000
#: Rows whose hash lets them be considered, in expectation, as a multiple of TRAIN_ROWS: the rest never leaves its task.
CONSIDERED = 4
BUCKETS = 1 << 11
KEEP_SCORE = 0.5
#: Words that every share is drawn towards its usual value by: a short text tells little.
SHORT = 20

STOPS = frozenset(STOP_FORMS)
SYMBOL = re.compile(r"[#*$%&|<>^~=_\\{}]")
PLAIN = re.compile(r"[\"'(\[«“„¿¡]*[^\W\d_]+(?:[-'’][^\W\d_]+)*[\"')\]»”.,;:!?…]*")


@cache
def letter_kinds() -> np.ndarray:
    """For each code point: a for letters, A for capitals, 0 for digits, as numbers; 0 for all others."""
    out = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalnum():
            out[code] = ord("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c)
    return out


def shapes(text: str) -> list[str]:
    """The words' shapes: letters as a or A, digits as 0, runs of these cut to two, other characters as they are."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = letter_kinds()[codes]
    out = np.where(kinds, kinds, codes)
    if len(out) > 2:
        same = (out[1:] == out[:-1]) & (kinds[1:] > 0)
        out = out[~np.concatenate(([False, False], same[1:] & same[:-1]))]
    return out.tobytes().decode("utf-32-le", "surrogatepass").split()


@lru_cache(maxsize=100_000)
def traits(shape: str) -> tuple[bool, bool, bool]:
    """Whether words of this shape are plain, all capitals, at a sentence's end."""
    return PLAIN.fullmatch(shape) is not None, "A" in shape and "a" not in shape and len(shape) > 1, shape[-1] in ".!?"


def vote(value: float, bad: float, good: float | None) -> int:
    """Bad beyond `bad`, good on the other side of `good`; bad > good means that high values are bad."""
    if good is None:
        return BAD if value > bad else NONE
    if bad > good:
        return BAD if value > bad else GOOD if value < good else NONE
    return BAD if value < bad else GOOD if value > good else NONE


#: Names of the labellers, in the order of their votes.
LABELLERS = ("symbols", "plain_words", "adjacent_repeats", "variety", "repeated_pairs", "packed_size", "capitals", "shouting", "stop_words", "sentence_ends")


def repeated_pairs(words: list[str]) -> float:
    """Share of word pairs that occur more than twice, beyond what frequent words cause."""
    pairs = Counter(zip(words, words[1:]))
    return sum(k for k in pairs.values() if k > 2) / max(len(words) - 1, 1)


def variety(words: list[str]) -> float:
    """Distinct words over the number that clean text of this length has at least."""
    return len(set(words)) / min(len(words), 3 * len(words) ** 0.5)


def packed_size(text: str) -> float:
    """Deflated over plain size; repetition packs well at every length."""
    raw = text.encode("utf-8", "surrogatepass")
    return len(zlib.compress(raw, 1)) / len(raw)


def votes(text: str | None) -> tuple[int, ...]:
    words = (text or "").split()
    n = len(words)
    if n < 5:
        return (ABSENT,) * len(LABELLERS)
    plain, upper, ends = np.array([(k * p, k * u, k * e) for s, k in Counter(shapes(text)).items() for p, u, e in [traits(s)]]).sum(axis=0) / n
    return (
        vote(len(SYMBOL.findall(text)) / n, 0.25, None),
        vote(1 - plain, 0.4, None),
        vote(sum(map(eq, words, words[1:])) / n, 0.2, None),
        vote(variety(words), 0.45, 0.9),
        vote(repeated_pairs(words), 0.5, 0.25),
        vote(packed_size(text), 0.2, 0.35) if n >= 25 else ABSENT,
        vote(upper, 0.3, None),
        vote(text.count("!") / n, 0.3, None),
        vote(sum(map(STOPS.__contains__, words)) / n, 0.03, 0.12) if n >= 25 else ABSENT,
        vote(ends, 0.5, None),
    )


@dataclass(frozen=True)
class VoteModel:
    """prior: share of good texts; table[l, c, v + 1]: how often labeller l votes v on class c."""

    prior: float
    table: np.ndarray

    def good(self, patterns: np.ndarray) -> np.ndarray:
        at, asked = np.arange(patterns.shape[1]), patterns != ABSENT
        logs = np.log(self.table)
        bad = np.log(1 - self.prior) + (logs[at, 0, patterns + 1] * asked).sum(axis=1)
        good = np.log(self.prior) + (logs[at, 1, patterns + 1] * asked).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> VoteModel:
    """EM from majority votes in which a bad vote counts double; smoothing keeps all rates above 0."""
    share_good = (patterns == GOOD).sum(axis=1) + 1.0
    share_bad = 2.0 * (patterns == BAD).sum(axis=1) + 0.1
    good, model = share_good / (share_good + share_bad), None
    for _ in range(rounds):
        table = np.empty((patterns.shape[1], 2, 3))
        for c, mass in ((0, counts * (1 - good)), (1, counts * good)):
            for v in (NONE, BAD, GOOD):
                table[:, c, v + 1] = ((patterns == v) * mass[:, None]).sum(axis=0) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        model = VoteModel(float(np.clip((counts * good).sum() / counts.sum(), 1e-4, 1 - 1e-4)), table)
        now = model.good(patterns)
        if np.abs(now - good).max() < 1e-7:
            break
        good = now
    return model


@lru_cache(maxsize=200_000)
def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def features(text: str | None) -> dict[int, float]:
    """Shares of hashed token shapes, of tokens that repeat the one before, of frequent words, and the variety."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return {}
    out: dict[int, float] = {}
    for s, k in Counter(shapes(text)).items():
        out[bucket(f"shape {s}")] = out.get(bucket(f"shape {s}"), 0.0) + (k / (n + SHORT)) ** 0.5
    repeats = sum(map(eq, words, words[1:])) / n
    stops = (sum(map(STOPS.__contains__, words)) + 0.2 * SHORT) / (n + SHORT)
    for name, value in (("repeat", repeats**0.5), ("pairs", repeated_pairs(words) ** 0.5), ("stop", min(stops, 0.3) / 0.3), ("variety", min(variety(words), 1.0))):
        out[bucket(name)] = out.get(bucket(name), 0.0) + value
    return out


def fit_linear(rows: list[dict[int, float]], good: np.ndarray, steps: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Weights and offset (last) of a logistic scorer, by accelerated gradient steps."""
    x = np.zeros((len(rows), BUCKETS + 1), np.float32)
    for i, r in enumerate(rows):
        x[i, list(r)] = list(r.values())
    x[:, -1] = 1
    used = np.flatnonzero(x.any(axis=0))
    x = x[:, used].astype(np.float64)
    rate = 4.0 / float(np.linalg.norm(x.T @ x / len(x), 2) + 4 * ridge)
    w, ahead = np.zeros(len(used)), np.zeros(len(used))
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - rate * (x.T @ (p - good) / len(x) + ridge * ahead)
        ahead, w = new + k / (k + 3) * (new - w), new
    out = np.zeros(BUCKETS + 1)
    out[used] = w
    return out


def train(documents: DataFrame) -> tuple[VoteModel, np.ndarray]:
    """The vote model over all rows and the scorer's weights. At most 4 ** 10 patterns and TRAIN_ROWS reach the driver."""
    spark = documents.sparkSession
    ship_package(spark)
    small_batches(spark)
    rows = keep_columns(documents, "doc_id", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Counter(votes(t) for batch in batches for t in batch["text"])
        if seen:  # a partition may be empty
            yield pd.DataFrame({"pattern": [list(p) for p in seen], "n": list(seen.values())})

    tallies = rows.select("text").mapInPandas(count, "pattern array<int>, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).toPandas()
    if not len(tallies):
        tallies = pd.DataFrame({"pattern": [[ABSENT] * len(LABELLERS)], "n": [1]})
    tallies = tallies.iloc[sorted(range(len(tallies)), key=lambda i: list(tallies["pattern"].iloc[i]))]  # sums in one order, for equal reruns
    model = fit_votes(np.array([list(p) for p in tallies["pattern"]]), tallies["n"].to_numpy(float))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [features(t) for t in batch["text"]]
            yield pd.DataFrame({"votes": [list(votes(t)) for t in batch["text"]], "at": [list(f) for f in found], "value": [list(f.values()) for f in found]})

    place = F.xxhash64("doc_id", "text")
    share = min(1.0, CONSIDERED * TRAIN_ROWS / max(float(tallies["n"].sum()), 1.0))

    def described(considered: DataFrame) -> pd.DataFrame:
        chosen = considered.orderBy(place, "doc_id").limit(TRAIN_ROWS)
        return chosen.select("text").mapInPandas(describe, "votes array<int>, at array<int>, value array<float>").toPandas()

    sample = described(rows.where(F.pmod(place, F.lit(1 << 40)) < int(share * (1 << 40))))
    if not len(sample):  # few different rows, repeated so often that none has a low hash
        sample = described(rows)
    if not len(sample):
        return model, np.concatenate((np.zeros(BUCKETS), [1.0]))
    good = model.good(np.array([list(v) for v in sample["votes"]]))
    weights = fit_linear([dict(zip(a, v, strict=True)) for a, v in zip(sample["at"], sample["value"], strict=True)], good)
    return model, weights


def score_quality(documents: DataFrame, weights: np.ndarray, into: str = "quality_score") -> DataFrame:
    """All columns of the documents and `into`, the scorer's probability that the text is good."""
    ship_package(documents.sparkSession)
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = shared.value
        for batch in batches:
            z = []
            for text in batch:
                f = features(text)
                z.append(float(w[list(f)] @ np.array(list(f.values())) + w[-1]) if f else float(w[-1]))
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -500, 500))))

    return documents.select(*[documents[c] for c in documents.columns if c != into], score(documents["text"]).alias(into))


def keep_good(documents: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, all columns untouched."""
    _, weights = train(documents)
    free = free_name(documents, "quality_score")
    return score_quality(documents, weights, free).where(F.col(free) >= KEEP_SCORE).drop(free)


def classify(documents: DataFrame) -> DataFrame:
    """Digest columns: doc_id, score, kept."""
    rows = keep_columns(documents, "doc_id", "text")
    _, weights = train(rows)
    return score_quality(rows, weights).select("doc_id", F.col("quality_score").alias("score"), (F.col("quality_score") >= KEEP_SCORE).alias("kept"))
