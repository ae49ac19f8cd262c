"""Toxic spans by a linear-chain conditional random field over the words of a whole text.

A word is marked or not; its features are itself, its first and last letters and its length. Labelled tokens come from the
labelled documents of a bounded sample: in documents of label 1 those words are marked whose form or beginning stands in
many different surroundings there and in next to none of the documents of label 0. These counts are sums over the whole
texts of the sample, made by Spark. The field is fitted on a few windows of each text, from anywhere in it; forward and
backward messages then give each word's marginal. A document's score is a logistic function, fitted on the same sample, of
what the marginals of its whole text add up to: their sum, greatest and density, those from FLOOR on counting. Spans are
runs of words whose marginal is CUT or more. Only marked forms, windows and four numbers a document reach the driver.

Defined results: null and empty texts, and texts without words, score as documents without marked words, with no spans; labels other than 0 and 1, or null,
and labels without a document are not learnt from; without both labels every score is 0; repeated rows are scored
alike; an empty table gives an empty result; other columns are not read.
"""

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .quality import training_rows

#: Most labelled rows of each label that the field is fitted on.
SAMPLE = 1500
#: A word with a marginal from this on counts for its document's score; from CUT on it belongs to a span.
FLOOR, CUT = 0.05, 0.3
#: Hashed features.
SLOTS = 1 << 18
#: Words of a training window, and windows for each document, and as many again around marked words.
WINDOW, WINDOWS = 24, 6
#: Most words whose scores one Python worker remembers.
MEMO = 300_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SPANS = "array<struct<start:int,end:int>>"


def word_features(word: str) -> list[int]:
    w = word.lower()
    forms = ("w" + w, "3" + w[:3], "4" + w[:4], "5" + w[:5], "s" + w[-3:], "n" + str(min(len(w), 12)))
    return [zlib.crc32(x.encode("utf-8", "replace")) % SLOTS for x in forms]


def chain(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, width: int = 64) -> np.ndarray:
    """x[t] = (a[t] * x[t-1] + b[t]) / (c[t] * x[t-1] + d[t]) for all t, from x[-1] = 1.

    Blocks of `width` steps are composed side by side, their ends are chained, then all blocks run side by side.
    """
    n = len(a)
    rows = -(-n // width)
    a, b, c, d = (np.concatenate([x, np.full(rows * width - n, fill)]).reshape(rows, width).T.copy() for x, fill in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0)))
    p, q, r, s = np.ones(rows), np.zeros(rows), np.zeros(rows), np.ones(rows)
    for t in range(width):
        p, q, r, s = a[t] * p + b[t] * r, a[t] * q + b[t] * s, c[t] * p + d[t] * r, c[t] * q + d[t] * s
        if t % 4 == 3:
            top = np.maximum(np.maximum(p, q), np.maximum(r, s))
            p, q, r, s = p / top, q / top, r / top, s / top
    enter, x = [], 1.0
    for i, j, k, m in zip(p.tolist(), q.tolist(), r.tolist(), s.tolist(), strict=True):
        enter.append(x)
        x = (i * x + j) / (k * x + m)
    x, out = np.array(enter), np.empty((width, rows))
    for t in range(width):
        x = (a[t] * x + b[t]) / (c[t] * x + d[t])
        out[t] = x
    return out.T.reshape(-1)[:n]


def marginals(emission: np.ndarray, first: np.ndarray, last: np.ndarray, step: np.ndarray, start: float) -> np.ndarray:
    """Probability that each word is marked. emission: log odds; first, last: where sequences begin and end; step: 2 x 2 factors."""
    e = np.exp(np.clip(emission, -25, 25))
    forward = chain(np.where(first, 0, e * step[1, 1]), np.where(first, e * start, e * step[0, 1]), np.where(first, 0, step[1, 0]), np.where(first, 1, step[0, 0]))
    after = np.concatenate([e[1:], [1.0]])[::-1]
    end = last[::-1]
    back = chain(np.where(end, 0, after * step[1, 1]), np.where(end, 1, step[1, 0]), np.where(end, 0, after * step[0, 1]), np.where(end, 1, step[0, 0]))[::-1]
    odds = forward * back
    return odds / (1 + odds)


class Field:
    """Weights of the features, of the steps between labels and of the start."""

    def __init__(self):
        self.weight = np.full(SLOTS, 0.0)
        self.step, self.start, self.blank = np.zeros((2, 2)), -4.0, True
        self.sums = np.array([0.0, 0.0, 0.0, 0.0, -30.0])

    def fit(self, words: list[str], x: np.ndarray, y: np.ndarray, rounds: int = 80) -> None:
        """words: vocabulary; x, y: windows of word numbers (-1: no word) and labels."""
        index = np.array([word_features(w) for w in words])
        used, at = np.unique(index, return_inverse=True)
        at = at.reshape(index.shape)
        here = x >= 0
        number = np.where(here, x, 0)
        gold_step = np.zeros((2, 2))
        pairs = here[:, 1:]
        for i in (0, 1):
            for j in (0, 1):
                gold_step[i, j] = ((y[:, :-1] == i) & (y[:, 1:] == j) & pairs).sum()
        params = np.concatenate([np.zeros(len(used)), np.zeros(4), [self.start]])
        mean, square, n = np.zeros_like(params), np.zeros_like(params), max(1, len(x))
        gold = np.bincount(number[here], weights=y[here], minlength=len(words))
        for k in range(1, rounds + 1):
            w, step, start = params[:-5], params[-5:-1].reshape(2, 2), params[-1]
            e = np.where(here, w[at].sum(axis=1)[number], 0.0)
            p, joint = self._expect(e, here, step, start)
            lack = gold - np.bincount(number[here], weights=p[here], minlength=len(words))
            slope = np.concatenate([np.bincount(at.reshape(-1), weights=np.repeat(lack, at.shape[1]), minlength=len(used)), (gold_step - joint).reshape(-1), [y[:, 0].sum() - p[:, 0].sum()]])
            slope = slope / n - 1e-5 * params
            mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
            params = params + 0.25 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.999**k)) + 1e-8)
        self.weight[used] = params[:-5]
        self.step, self.start, self.blank = params[-5:-1].reshape(2, 2), float(params[-1]), False

    def fit_sums(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """x: summaries of documents by summed(), y: their labels."""
        x = np.hstack([x, np.ones((len(x), 1))])
        w = np.array([0.0, 0.0, 0.0, 0.0, -2.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(5)
            w = w + np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-2 * w)
        self.sums = w

    def score(self, summary: list[float]) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.sums[:4], summary) + self.sums[4], -500, 500))))

    @staticmethod
    def _expect(e: np.ndarray, here: np.ndarray, step: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all windows at once, and expected steps."""
        n, width = e.shape
        score = np.stack([np.zeros_like(e), e], axis=-1)
        a, b = np.zeros((width, n, 2)), np.zeros((width, n, 2))
        a[0] = score[:, 0] + np.array([0, start])
        add = np.logaddexp
        for t in range(1, width):
            new = np.stack([add(a[t - 1][:, 0] + step[0, j], a[t - 1][:, 1] + step[1, j]) for j in (0, 1)], axis=-1) + score[:, t]
            a[t] = np.where(here[:, t, None], new, a[t - 1])
        z = add(a[-1][:, 0], a[-1][:, 1])
        joint = np.zeros((2, 2))
        for t in range(width - 1, 0, -1):
            on = here[:, t]
            follow = b[t] + score[:, t]
            for i in (0, 1):
                for j in (0, 1):
                    joint[i, j] += np.exp(a[t - 1][:, i] + step[i, j] + follow[:, j] - z)[on].sum()
            new = np.stack([add(step[i, 0] + follow[:, 0], step[i, 1] + follow[:, 1]) for i in (0, 1)], axis=-1)
            b[t - 1] = np.where(on[:, None], new, b[t])
        p = np.exp(a[:, :, 1] + b[:, :, 1] - z).T
        return np.where(here, p, 0.0), joint


def summed(p: np.ndarray, words: int) -> list[float]:
    """Summary of a document's marginals from FLOOR on."""
    total = float(p.sum())
    return [np.log1p(total), float(p.max(initial=0)), np.sqrt(100 * total / max(1, words)), np.log1p(words) / 4]


def forms(word: str) -> set[str]:
    """What a word is marked by: itself in lower case, and its first five letters."""
    return {word.lower(), word.lower()[:5] + "*"}


def marked_forms(rows: DataFrame) -> list[str]:
    """Forms that stand in at least five different surroundings (the words beside them) in texts of label 1, and there more
    than thirty times as usual as in texts of label 0. rows: text, label."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n: Counter = Counter()  # occurrences of label 0; surroundings of label 1, each once
            for text, label in zip(batch.text, batch.label, strict=True):
                low = [w.lower() for w in WORD.findall(text)]
                n[None, int(label), 0] += len(low)
                for k, w in enumerate(low):
                    beside = zlib.crc32(f"{low[k - 1] if k else ''} {low[k + 1] if k + 1 < len(low) else ''}".encode()) if label else 0
                    for form in forms(w):
                        n[form, int(label), beside] += 1
            yield pd.DataFrame([(*key, many) for key, many in n.items()], columns=["form", "label", "beside", "n"])

    each = rows.select("text", "label").mapInPandas(count, "form string, label int, beside long, n long")
    each = cut(each.groupBy("form", "label", "beside").agg(F.sum("n").alias("n")))
    sizes = {r.label: r.n for r in each.where("form IS NULL").groupBy("label").agg(F.sum("n").alias("n")).collect()}
    bad, good = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    sums = each.where("form IS NOT NULL").groupBy("form").agg(F.count_if(F.col("label") == 1).alias("inside"), F.coalesce(F.sum(F.when(F.col("label") == 0, F.col("n"))), F.lit(0)).alias("outside"))
    found = sums.where((F.col("inside") >= 5) & (F.col("inside") / bad > (F.col("outside") + 0.6) * 30 / good))
    return sorted(r.form for r in found.select("form").collect())


def windows(rows: DataFrame, marked: list[str]) -> DataFrame:
    """doc_id, at, words and marks of 2 * WINDOWS windows of a text at most. rows: doc_id, text, label."""
    own = set(marked)

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for doc_id, text, label in zip(batch.doc_id, batch.text, batch.label, strict=True):
                words = WORD.findall(text)
                mark = np.array([int(bool(label) and not own.isdisjoint(forms(w))) for w in words], np.int8)
                if not words or label and not mark.any():
                    continue
                rng = np.random.default_rng([3, zlib.crc32(str(doc_id).encode())])
                starts = rng.integers(0, max(1, len(words) - WINDOW // 2), WINDOWS).tolist()
                if label:
                    starts += [max(0, int(i) - int(rng.integers(0, WINDOW))) for i in rng.permutation(np.flatnonzero(mark))[:WINDOWS]]
                found += [(str(doc_id), s, words[s : s + WINDOW], mark[s : s + WINDOW].tolist()) for s in sorted({*starts})]
            yield pd.DataFrame(found, columns=["doc_id", "at", "words", "marks"])

    return rows.select("doc_id", "text", "label").mapInPandas(take, "doc_id string, at int, words array<string>, marks array<int>")


def fit(docs: DataFrame, labels: DataFrame, keep: Column, sample: int = SAMPLE) -> Field:
    """The field learnt from the labelled rows that `keep` allows."""
    rows, counts = training_rows(docs.where("text IS NOT NULL"), labels, "toxic", keep, sample)
    rows, field = cut(rows), Field()
    marked = marked_forms(rows)
    if not marked:
        return field
    number: dict[str, int] = {}
    parts = windows(rows, marked).orderBy("doc_id", "at").collect()  # 2 * sample * 2 * WINDOWS of WINDOW words at most
    x, y = np.full((len(parts), WINDOW), -1), np.zeros((len(parts), WINDOW), int)
    for k, part in enumerate(parts):
        x[k, : len(part.words)] = [number.setdefault(w.lower(), len(number)) for w in part.words]
        y[k, : len(part.marks)] = part.marks
    field.fit(list(number), x, y)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(field)
        for batch in batches:
            yield pd.DataFrame({"label": batch.label, "x": tagger.summaries(batch.text.tolist())[0]})

    got = rows.select("text", "label").mapInPandas(sums, "label int, x array<double>").orderBy("label", "x").collect()
    labelled = np.array([r.label for r in got])
    share = np.array([counts.get(k, 0) / max(1, (labelled == k).sum()) for k in (0, 1)])
    field.fit_sums(np.array([r.x for r in got]), labelled, (share / share.max())[labelled])
    return field


class Tagger:
    """A field at work in one Python worker."""

    def __init__(self, field: Field):
        self.field, self.memo = field, {}

    def emissions(self, words: list[str]) -> np.ndarray:
        got = list(map(self.memo.get, words))
        if None in got:
            new = {w: float(self.field.weight[word_features(w)].sum()) for w, x in zip(words, got, strict=True) if x is None}
            if len(self.memo) < MEMO:
                self.memo |= new
            got = [new[w] if x is None else x for w, x in zip(words, got, strict=True)]
        return np.array(got)

    def summaries(self, texts: list[str | None]) -> tuple[list[list[float]], dict[int, np.ndarray]]:
        """Summary of each text, and the marginals of those texts where some word reaches FLOOR."""
        words = [WORD.findall(x) if x else [] for x in texts]
        sizes = np.array([len(w) for w in words])
        found, kept = [summed(np.zeros(0), n) for n in sizes.tolist()], {}
        if self.field.blank or not sizes.sum():
            return found, kept
        e = np.concatenate([self.emissions(w) for w in words if w])
        ends = np.cumsum(sizes)
        first, last = np.zeros(len(e), bool), np.zeros(len(e), bool)
        first[(ends - sizes)[sizes > 0]], last[(ends - 1)[sizes > 0]] = True, True
        p = marginals(e, first, last, np.exp(self.field.step), float(np.exp(self.field.start)))
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(p >= FLOOR), side="right")).tolist():
            kept[k] = p[ends[k] - sizes[k] : ends[k]]
            found[k] = summed(kept[k][kept[k] >= FLOOR], int(sizes[k]))
        return found, kept

    def tag(self, texts: list[str | None]) -> tuple[list[float], list[list[dict]]]:
        """Score and spans of each text."""
        found, kept = self.summaries(texts)
        spans: list[list[dict]] = [[] for _ in texts]
        for k, p in kept.items():
            if (p >= CUT).any():
                places = [m.span() for m in WORD.finditer(texts[k])]
                on = np.flatnonzero(np.diff(np.concatenate([[0], p >= CUT, [0]])))
                spans[k] = [{"start": places[i][0], "end": places[j - 1][1]} for i, j in zip(on[::2], on[1::2], strict=True)]
        return [self.field.score(x) for x in found], spans


def scored(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score, predicted and spans (character offsets, end exclusive) of each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(field)
        for batch in batches:
            for i in range(0, len(batch), 256):
                some = batch.iloc[i : i + 256]
                scores, spans = tagger.tag(some.text.tolist())
                yield pd.DataFrame({"doc_id": some.doc_id.astype("Int64").to_numpy(dtype=object, na_value=None), "score": scores, "spans": spans})

    got = docs.select("doc_id", "text").mapInPandas(run, f"doc_id long, score double, spans {SPANS}")
    return got.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
