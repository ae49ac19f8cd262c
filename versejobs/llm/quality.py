"""Quality classifier: Bradley-Terry pairwise ranking over shape features of a whole text.

A document of label 1 is preferred to one of label 0. The probability of that is the logistic function of the weighted
difference of their features; the weights are fitted on all pairs of a labelled row of each label. The cut is a quantile of
the scores: as large a share of the labelled rows scores below it as has label 0.

A pair's probability depends on its two scores alone, so the slope over all pairs is had from the rows: those of a label
with nearly the same score (BINS ranges of scores) are counted, by Spark, and what one label's counts give at each score
is added up over the rows of the other; within a bin of counts the scores' mean stands for each. Newton steps go on from there to where the loss over all pairs is
least, up to SMALL. They begin at what START rows of each label give, which saves steps and doesn't move the end. What reaches the
driver is bounded by BINS and START, whatever the number of rows.

Features are shares and ratios of characters, words and lines, so nothing depends on lang, source or doc_id.

Defined results: null and empty texts have all features 0 and still get a score; labels other than 0 and 1, or null, and
labels without a document are not learnt from; a doc_id counts once, with the greater of several labels and the least of
several rows' features; without both labels every score is 0.5; repeated rows are scored alike; an empty table gives an
empty result; columns named score and predicted are replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered

#: Preference pairs for each row of label 0, where the rows are at hand.
PAIRS = 12
#: Rows of each label that give where the Newton steps begin; bins of scores, narrow where these are many; most steps.
START, BINS, STEPS = 3000, 1024, 25
#: Weight of the ridge, a pair; a step that moves no weight further than this is the last.
RIDGE, SMALL = 1e-3, 1e-3
#: A score from this on predicts label 1.
CUT = 0.3
FEATURES = 28


def features(text: str | None) -> list[float]:
    """Shape of one whole text."""
    if not text:
        return [0.0] * FEATURES
    n = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size = n.sum()
    words = text.split()
    many = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    # The 33rd to 64th byte values are marks and digits, the letters A-Z follow at 65, a-z at 97, others from 128.
    upper, lower, wide, digits = n[65:91].sum(), n[97:123].sum(), n[128:].sum(), n[48:58].sum()
    commas = n[44] + n[46]
    marks = n[33:128].sum() - upper - lower - digits - commas
    alike = sum(map(eq, words, words[1:])) / many
    shares = [
        upper / size, digits / size, wide / size, commas / many, marks / many, n[33] / many, (n[35] + n[36] + n[37] + n[38] + n[42]) / many,
        n[10] / many, alike, 1 - len(set(words)) / many, 1 - len(set(lines)) / max(1, len(lines)), sum(n[[60, 62, 123, 125, 47, 95]]) / many,
        (n[40] + n[41]) / many, n[9] / many,
    ]
    return [float(x) for x in shares] + [float(np.sqrt(max(0.0, x))) for x in shares]


def described(texts: pd.Series) -> np.ndarray:
    return np.array([features(x) for x in texts], dtype=float).reshape(-1, FEATURES)


def feature_column(text: str) -> Column:
    return F.pandas_udf(lambda texts: pd.Series(list(described(texts))), "array<double>")(text)


class Ranking:
    """Fitted weights; scores are logistic, with the cut at CUT.

    fit() learns them from tables; this constructor does from rows at hand, each of label 0 with PAIRS others.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, share: float, pairs: int = PAIRS, seed: int = 7):
        """low, high: features of rows of label 0 and 1; share: that of label 0 among all labelled rows."""
        both = np.vstack([low, high])
        self.constant = not len(low) or not len(high)
        self.mean, self.scale, self.weight, self.shift, self.steep = 0.0, 1.0, np.zeros(both.shape[1]), 0.0, 1.0
        if self.constant:
            return
        self.mean, self.scale = both.mean(axis=0), both.std(axis=0) + 1e-6
        rng = np.random.default_rng(seed)
        a, b = self._even(low), self._even(high)
        d = b[rng.integers(0, len(b), len(a) * pairs)] - np.repeat(a, pairs, axis=0)
        ridge = 1e-3 * len(d)
        for _ in range(25):  # Newton steps on the logistic loss of the differences
            p = 1 / (1 + np.exp(-np.clip(d @ self.weight, -30, 30)))
            h = (d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(d.shape[1])
            step = np.linalg.solve(h, d.T @ (1 - p) - ridge * self.weight)
            self.weight = self.weight + step
            if np.abs(step).max() < 1e-6:
                break
        scores = np.concatenate([a @ self.weight, b @ self.weight])
        mass = np.concatenate([np.full(len(a), share / len(a)), np.full(len(b), (1 - share) / len(b))])
        order = np.argsort(scores, kind="stable")
        self.shift = float(scores[order][min(len(order) - 1, np.searchsorted(np.cumsum(mass[order]), share))])
        self.steep = 4 / max(1e-9, float(np.std(scores)))

    @classmethod
    def of(cls, mean: np.ndarray, scale: np.ndarray, weight: np.ndarray, shift: float, steep: float) -> Ranking:
        """A ranking whose weights are known."""
        self = cls(np.zeros((0, len(weight))), np.zeros((0, len(weight))), 0.0)
        self.constant, self.mean, self.scale, self.weight, self.shift, self.steep = False, mean, scale, weight, shift, steep
        return self

    def _even(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Weighted features, before the cut's place and the steepness."""
        return np.sum(self._even(x) * self.weight, axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant:
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        return 1 / (1 + np.exp(-np.clip(self.steep * (raw - self.shift) + np.log(CUT / (1 - CUT)), -500, 500)))


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether the remainder of crc32 of the id's text is `part`; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, keep: Column, sample: int) -> tuple[DataFrame, dict]:
    """doc_id, text, label of at most `sample` rows of each label, taken by a hash of the id; ids by label altogether.

    A doc_id counts once: of several labels the greater counts, of several texts the least.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & keep).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    usable = usable.join(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi")
    counts = {r[0]: r[1] for r in usable.groupBy("label").count().collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = usable.where("label = 0").orderBy(*order).limit(sample).unionByName(usable.where("label = 1").orderBy(*order).limit(sample))
    # 2 * sample ids at most, so the broadcast has a bound.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")), counts


def labelled_points(docs: DataFrame, labels: DataFrame, label: str, keep: Column) -> DataFrame:
    """label, f (features) of every labelled doc_id that `keep` allows. Features are exchanged, texts aren't."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & keep).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    rows = docs.where(F.col("doc_id").isNotNull() & keep).select("doc_id", feature_column("text").alias("f"))
    return rows.join(usable, "doc_id").groupBy("doc_id").agg(F.min("f").alias("f"), F.first("label").alias("label")).select("label", "f")


def over(points: DataFrame, one: Callable[[np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """What `one` makes of labels and features of each batch of points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
                yield pa.RecordBatch.from_pandas(one(batch.column("label").to_numpy(zero_copy_only=False), x), preserve_index=False)

    return points.select("label", "f").mapInArrow(run, schema)


def totals(points: DataFrame, one: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all points of the numbers that `one` makes of labels and features."""

    def placed(y: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        s = one(y, x)
        return pd.DataFrame({"k": np.arange(len(s), dtype=np.int32), "s": s})

    found = over(points, placed, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    return np.array([r["s"] for r in sorted(found)])


def fit(docs: DataFrame, labels: DataFrame, keep: Column) -> Ranking:
    """The ranking learnt from all labelled rows that `keep` allows, and all their pairs."""
    points = cut(labelled_points(docs, labels, "quality", keep))
    by_hash = points.orderBy(F.xxhash64("f"), "f")
    some = [np.array([r.f for r in by_hash.where(F.col("label") == y).limit(START).collect()], dtype=float).reshape(-1, FEATURES) for y in (0, 1)]
    start = Ranking(*some, 0.5)
    if start.constant:
        return start

    def moments(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.concatenate([[(y == 0).sum(), (y == 1).sum()], (x - start.mean).sum(axis=0), ((x - start.mean) ** 2).sum(axis=0)])

    found = totals(points, moments)
    lows, n, off = int(found[0]), found[:2].sum(), found[2 : 2 + FEATURES] / found[:2].sum()
    # Sums of doubles differ in their last bits by the order of rows; what is kept of them doesn't.
    mean = np.round(start.mean + off, 12)
    scale = np.round(np.sqrt(np.maximum(0, found[2 + FEATURES :] / n - off**2)) + 1e-6, 12)
    weight = start.weight * scale / start.scale
    for _ in range(STEPS):
        step = newton_step(points, Ranking.of(mean, scale, weight, 0.0, 1.0), np.vstack(some))
        weight = weight + step
        if np.abs(step).max() < SMALL:
            break
    ranking = Ranking.of(mean, scale, np.round(weight, 6), 0.0, 1.0)
    raw = cut(over(points, lambda _, x: pd.DataFrame({"raw": ranking.raw(x)}), "raw double"))
    # As many rows of the least scores as have label 0.
    ranking.shift = numbered(raw, [], ["raw"]).where(F.col("row_no") == lows - 1).first()["raw"]
    ranking.steep = 4 / max(1e-9, round(raw.agg(F.stddev_pop("raw")).first()[0], 9))
    return ranking


def newton_step(points: DataFrame, ranking: Ranking, some: np.ndarray) -> np.ndarray:
    """The step from a ranking's weights to where the loss over all pairs, with the ridge, is least by its slope and curvature.

    The scores of `some` rows tell where bins are to be narrow.
    """
    middle, spread = ranking.raw(some).mean(), max(2 * ranking.raw(some).std(), 1e-9)

    def bins(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Each row's bin, those of label 1 behind those of label 0."""
        return y * BINS + np.clip((np.arctan((ranking.raw(x) - middle) / spread) / np.pi + 0.5) * BINS, 0, BINS - 1).astype(int)

    columns = [f"s{k}" for k in range(FEATURES + 1)]

    def sums(y: np.ndarray, x: np.ndarray) -> pd.DataFrame:
        """Number and sums of features, of each bin."""
        at = bins(y, x)
        order = np.argsort(at, kind="stable")
        own, starts = np.unique(at[order], return_index=True)
        rows = np.hstack([np.ones((len(x), 1)), ranking._even(x)])[order]
        return pd.DataFrame(np.add.reduceat(rows, starts), columns=columns).assign(bin=own.astype(np.int32))[["bin", *columns]]

    found = over(points, sums, "bin int, " + ", ".join(f"{c} double" for c in columns)).groupBy("bin").agg(*[F.sum(c) for c in columns])
    rows = np.array([list(r) for r in sorted(found.collect())])  # 2 * BINS at most
    sides = [rows[rows[:, 0] // BINS == y] for y in (0, 1)]
    at, n, total = [x[:, 0].astype(int) for x in sides], [x[:, 1] for x in sides], [x[:, 2:] for x in sides]
    score = [t @ ranking.weight / k for t, k in zip(total, n, strict=True)]
    pairs = n[0].sum() * n[1].sum()
    p = 1 / (1 + np.exp(-np.clip(score[1][:, None] - score[0], -30, 30)))  # rows of label 1 first
    wrong, both = (1 - p) / pairs, p * (1 - p) / pairs
    lost = n[1] @ wrong, wrong @ n[0]  # what a row of label 0, or 1, adds to the slope, at the bins' scores
    weights = np.zeros(2 * BINS)  # of a row, by its bin
    weights[at[0]], weights[at[1]] = n[1] @ both, both @ n[0]

    def both_of(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Curvature and slope, that at each row's own score."""
        even, raw = ranking._even(x), ranking.raw(x)
        own = np.where(y == 1, np.interp(raw, score[1], lost[1]), -np.interp(raw, score[0], lost[0]))
        return np.concatenate([((even * weights[bins(y, x)][:, None]).T @ even).reshape(-1), own @ even])

    found = totals(points, both_of)
    curved, slope = found[:-FEATURES].reshape(FEATURES, FEATURES), found[-FEATURES:] - RIDGE * ranking.weight
    cross = total[1].T @ both @ total[0]
    return np.linalg.solve(curved - cross - cross.T + RIDGE * np.eye(FEATURES), slope)


def scored(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """docs with score and predicted."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(ranking.scores(described(texts)))

    return docs.withColumn("score", score("text")).withColumn("predicted", (F.col("score") >= CUT).cast("int"))
