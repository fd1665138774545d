"""Toxicity: maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

Training learns from labelled rows only. (1) Token log-odds: document counts of each word and of its leading letters
in toxic and clean rows, hashed into a fixed number of buckets; a Dirichlet prior draws the rate of a feature towards
the rate of the next shorter one, and that of the shortest towards the base rate. (2) A token's score is its log-odds
less a margin, so that clean text scores below zero on average. All maximal scoring segments of a text are found in
one linear scan. (3) The best segment of n clean tokens follows an extreme-value law with the rate and constant
fitted on clean rows; a segment is a passage if so good a one is expected less than once in `1 / expected` such
texts. A logistic curve over the extreme-value statistic turns it into a score; it is fitted on labelled rows that the
log-odds weren't counted on. All of these are fitted on labelled rows chosen by a hash of the id, TRAIN_ROWS in
expectation (all, if fewer): their ids are broadcast, so no text is shuffled.

Defined results: null and blank texts have no tokens, no passages and the score of the least toxic statistic; repeated
rows are scored alike; labels without a text, and null labels, are left out of training; without any labelled row all
scores are 0; an empty table gives an empty result; columns besides the id and the text aren't read. A row with a null
id is scored, never held out and never learnt from. Texts are scored whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.text import arrow_rows, keep_columns, ship_package, small_batches
from sieveline.plans.lineage import cut

FOLDS = 5
#: The fold that is never learnt from, and the one that only the calibration uses.
HELD_OUT, CALIBRATION = 0, 1

BUCKETS = 1 << 18
PREFIXES = (4, 5, 6)
PRIOR = 8.0
MARGIN = 0.7
#: Labelled ids that the model is fitted on, in expectation; at most 16 bytes each are broadcast.
TRAIN_ROWS = 100_000
EXPECTED = 0.05
#: Beyond these values the extreme-value statistic tells no more; else a few wrong labels would flatten the curve.
STATISTIC_RANGE = (-5.0, 12.0)
#: Scores of words that a worker keeps at most; the least recent half goes when there are more.
CACHE_WORDS = 200_000

TOKEN = re.compile(r"[^\W\d_]+")


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def tokens_of(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def chain(token: str) -> list[int]:
    """Buckets of the token's features, from the shortest prefix to the word itself."""
    pieces = [f"{token[:n]}*" for n in PREFIXES if len(token) > n] + [token]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in pieces]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score), left to right, in linear time.

    A stack holds candidate segments with the total before and after each. A new positive run joins back to the last
    candidate that starts lower, unless that one also ends at least as high; then it is a candidate of its own.
    """
    gains = np.flatnonzero(scores > 0)
    if not len(gains):
        return []
    totals = np.concatenate(([0.0], np.cumsum(scores)))
    breaks = np.flatnonzero(np.diff(gains) > 1)
    starts, ends = gains[np.concatenate(([0], breaks + 1))], gains[np.concatenate((breaks, [len(gains) - 1]))] + 1
    lows, highs = totals[starts].tolist(), totals[ends].tolist()
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, low, high, index of the last lower-starting candidate
    for start, end, low, high in zip(starts.tolist(), ends.tolist(), lows, highs, strict=True):
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((start, end, low, high, j))
                break
            start, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, high - low) for a, b, low, high, _ in stack]


@dataclass
class Model:
    """Bounded by BUCKETS: the document counts by bucket, and six numbers."""

    toxic: np.ndarray
    clean: np.ndarray
    n_toxic: int
    n_clean: int
    rate: float = 1.0
    constant: float = 0.1
    slope: float = 1.0
    offset: float = 0.0
    _scores: dict[str, float] = field(default_factory=dict, repr=False, compare=False)
    _older: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_scores": {}, "_older": {}}

    def log_odds(self, token: str) -> float:
        base = (self.n_toxic + 0.5) / (self.n_toxic + self.n_clean + 1)
        share = base
        for b in chain(token):
            t, c = float(self.toxic[b]), float(self.clean[b])
            share = (t + PRIOR * share) / (t + c + PRIOR)
        return float(np.log(share / (1 - share)) - np.log(base / (1 - base)))

    def token_score(self, token: str) -> float:
        found = self._older.get(token)
        if found is None:
            found = self.log_odds(token) - MARGIN
        if len(self._scores) >= CACHE_WORDS:
            self._older, self._scores = self._scores, {}
        self._scores[token] = found
        return found

    def token_scores(self, tokens: list[str]) -> np.ndarray:
        known = self._scores.get
        return np.array([s if (s := known(t)) is not None else self.token_score(t) for t in tokens], dtype=np.float64)

    def statistic(self, best: float, n: int) -> float:
        """Minus the log of the number of segments this good that n clean tokens are expected to hold."""
        return self.rate * best - float(np.log(max(self.constant * max(n, 1), 1e-12)))

    def judge(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Score, and the significant passages as token intervals."""
        tokens = tokens_of(text)
        found = segments(self.token_scores(tokens))
        best = max((s for _, _, s in found), default=0.0)
        floor = -float(np.log(EXPECTED))
        passages = [x for x in found if self.statistic(x[2], len(tokens)) >= floor]
        if not self.n_toxic:
            return 0.0, passages
        z = np.clip(self.slope * np.clip(self.statistic(best, len(tokens)), *STATISTIC_RANGE) + self.offset, -30, 30)
        return float(1 / (1 + np.exp(-z))), passages


def count_features(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """rows: text, toxic. Document counts by bucket; each task sends a bucket once, the driver gets BUCKETS rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, BUCKETS + 1), np.int64)
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                buckets = {b for t in set(tokens_of(text)) for b in chain(t)}
                seen[int(toxic), list(buckets)] += 1
                seen[int(toxic), BUCKETS] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield pd.DataFrame({"bucket": at, "clean": seen[0, at], "toxic": seen[1, at]})

    sums = rows.mapInPandas(count, "bucket int, clean bigint, toxic bigint").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()
    clean, toxic = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
    clean[sums["bucket"]], toxic[sums["bucket"]] = sums["clean"], sums["toxic"]
    return toxic[:-1], clean[:-1], int(toxic[-1]), int(clean[-1])


def best_segments(model: Model, rows: DataFrame) -> pd.DataFrame:
    """toxic, n, best of some rows: three numbers each come to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            token_lists = [tokens_of(t) for t in batch["text"]]
            best = [max((s for _, _, s in segments(model.token_scores(t))), default=0.0) for t in token_lists]
            yield pd.DataFrame({"toxic": batch["toxic"], "n": [len(t) for t in token_lists], "best": best})

    return rows.mapInPandas(run, "toxic int, n bigint, best double").toPandas()


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset by Newton steps with a small ridge."""
    a, b = 0.0, 0.0
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + 1e-3 * np.array([a, b])
        hessian = design.T @ (design * (weight * p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-9:
            break
    return a, b


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """documents: doc_id, text; labels: doc_id, toxic. Rows of the held-out fold aren't read."""
    spark = documents.sparkSession
    ship_package(spark)
    small_batches(spark)
    marked = keep_columns(labels, "doc_id", "toxic").where(F.col("toxic").isin(0, 1) & (fold_of(F.col("doc_id")) != HELD_OUT))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, TRAIN_ROWS / max(marked.count(), 1))
    chosen = cut(marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40))))
    rows = keep_columns(documents, "doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    model = Model(*count_features(rows.where(fold_of(F.col("doc_id")) != CALIBRATION).select("text", "toxic")))
    return calibrate(model, best_segments(model, rows.where(fold_of(F.col("doc_id")) == CALIBRATION).select("text", "toxic")))


def calibrate(model: Model, sample: pd.DataFrame) -> Model:
    """The extreme-value law of the clean rows by regression of their segment quantiles, then the logistic curve."""
    clean = sample[(sample["toxic"] == 0) & (sample["n"] > 0)]
    if len(clean) >= 20 and clean["best"].std() > 0:
        # For best of n: P(best < s) = exp(-K n exp(-rate s)). Moments of the Gumbel law, sizes taken off by two passes.
        best, sizes = clean["best"].to_numpy(), np.log(clean["n"].to_numpy())
        low, high = np.quantile(best, [0.01, 0.99])  # label noise doesn't set the spread
        inner = (best >= low) & (best <= high)
        best, sizes = best[inner], sizes[inner]
        for _ in range(20):
            model.rate = float(np.pi / (np.sqrt(6) * max((best - sizes / model.rate).std(), 1e-3)))
        model.rate = min(model.rate, 5.0)
        model.constant = float(np.exp(model.rate * (best - sizes / model.rate).mean() - 0.5772156649))
    if model.n_toxic and sample["toxic"].nunique() == 2:
        x = np.clip([model.statistic(b, n) for b, n in zip(sample["best"], sample["n"], strict=True)], *STATISTIC_RANGE)
        model.slope, model.offset = fit_logistic(x, sample["toxic"].to_numpy(float), np.ones(len(sample)))
    return model


def passages_of(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, passages: significant toxic passages as intervals of tokens (runs of letters), end exclusive."""
    ship_package(documents.sparkSession)
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def judge(text: str | None) -> tuple:
        score, found = shared.value.judge(text)
        return score, [{"start": a, "end": b, "score": s} for a, b, s in found]

    return arrow_rows(keep_columns(documents, "doc_id", "text"), "text", judge, "score double, passages array<struct<start:bigint,end:bigint,score:double>>")


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Digest columns: doc_id, held_out, score, predicted, n_passages."""
    found = passages_of(documents, train(documents, labels))
    return found.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))
