"""Toxicity: cumulative-link ordinal regression on sparse word features.

    P(grade <= k) = sigmoid(threshold_k - w . x),   x = log(1 + occurrences) of each mark

One weight vector, not negative, serves all thresholds, which are kept in order by being a first
one and positive steps; the output is the expected grade. Marks are words and beginnings of words
(for languages that inflect) that occur in toxic documents significantly more often than in
others, found on a bounded sample of labelled rows; a further feature counts the words with any
mark. Of copies of a document (by the least hash of its runs of four words) one counts, so that a
large group of copies doesn't make its common words look toxic.

Grades: if the labels have more than two values, they are the grades. With only 0 and 1, toxic
rows are graded 1 to 3 by thirds of their log odds under a model of two grades, fitted with marks
of its own on the other half of the sample (copies fall into one half). So no document is graded by
a model that has seen it, and the thresholds aren't cuts of a feature. Expected severity then says
how strongly others' labels speak for toxicity, on a scale from 0 to 3.

Defined results: a null text is empty; an empty text has the grade of a text without marked
words; texts of any length are read whole; a probability equal to ``TOXIC`` is toxic; equal
log odds have equal grades; without labels of both kinds, or without any mark, every document has
expected grade 0 and isn't toxic; repeated rows count and are scored each; of several rows of a
labelled doc_id one is learnt from; a null doc_id stays null; an empty table gives no rows; only
``doc_id`` and ``text`` are read, and other columns stay, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldra.llm.common import checkpoint, release, released, settle, text_or_empty
from veldra.llm.labelled import SAMPLE, sample

#: A document is toxic if the probability of grade 1 or more is at least this.
TOXIC = 0.5
#: Lengths of beginnings; they end with a star, which no word has.
BEGINNINGS = range(3, 9)
#: Toxic documents, and share of them, that a mark needs; log odds, and standard errors that they must exceed.
LEAST_ROWS, LEAST_SHARE, LEAST_ODDS, ERRORS = 4, 0.02, 2.5, 3.0
#: Words remembered by a worker with their marks; it bounds memory only.
MEMO = 400_000
#: Grades made from labels of two values.
GRADES = 3
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def vote_of(words: list[str]) -> int:
    """Least hash of the runs of four words; copies with few changes mostly share it."""
    import xxhash

    runs = {" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))}
    return min(xxhash.xxh64_intdigest(r) >> 1 for r in runs)


def marks_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n)]


class Marks:
    """Numbers of a text's marks; number 0 is that of any mark."""

    def __init__(self, names: list[str]):
        self.names = names
        self.index = {name: k for k, name in enumerate(names, 1)}
        self.memo: dict[str, tuple[int, ...]] = {}

    def _of(self, word: str) -> tuple[int, ...]:
        found = tuple(self.index[m] for m in marks_of(word) if m in self.index)
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[word] = found = (0, *found) if found else ()
        return found

    def counts(self, words: list[str]) -> Counter:
        out: Counter = Counter()
        for word, found in zip(words, map(self.memo.get, words), strict=True):
            if found is None:
                found = self._of(word)
            if found:
                out.update(found)
        return out

    def __getstate__(self):
        return self.names

    def __setstate__(self, names):
        self.__init__(names)


@dataclass
class Ordinal:
    marks: Marks
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; one fewer than grades

    def assess(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and probability of grade 1 or more."""
        w = self.weights
        score = np.array([sum(w[i] * math.log1p(n) for i, n in self.marks.counts(words_of(t)).items()) for t in texts], np.float64)
        if not len(self.thresholds):
            return np.zeros(len(score)), np.zeros(len(score))
        above = 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -40, 40)))
        return above.sum(axis=1), above[:, 0]


@dataclass
class Sparse:
    """Rows of few features: entry k stands in ``row[k]``, ``column[k]``."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    shape: tuple[int, int]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.shape[0])

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * g[self.row], self.shape[1])


def sparse(x: np.ndarray) -> Sparse:
    row, column = np.nonzero(x)
    return Sparse(row, column, x[row, column], x.shape)


def cuts_of(raw: np.ndarray) -> np.ndarray:
    """Thresholds in order: the first one, and steps whose softplus is above zero."""
    return raw[0] + np.concatenate([[0.0], np.cumsum(np.log1p(np.exp(raw[1:])))])


def likelihood(theta: np.ndarray, x: Sparse, grades: np.ndarray, levels: int, penalty: float) -> tuple[float, np.ndarray]:
    """Mean log likelihood less the penalty, and its gradient by weights and raw thresholds."""
    n, d = x.shape
    w, raw, rows = theta[:d], theta[d:], np.arange(n)
    cuts = np.concatenate([[-np.inf], cuts_of(raw), [np.inf]])
    z = x.times(w)
    hi, lo = (1 / (1 + np.exp(-np.clip(c - z, -40, 40))) for c in (cuts[grades + 1], cuts[grades]))
    p = np.maximum(hi - lo, 1e-12)
    dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
    by_cut = np.zeros((n, levels + 1))
    by_cut[rows, grades + 1] += dhi
    by_cut[rows, grades] -= dlo
    cut_gradient = by_cut.mean(axis=0)[1:levels]
    later = np.cumsum(cut_gradient[::-1])[::-1]
    gradient = np.concatenate([x.transposed_times((dlo - dhi) / n) - penalty * w, later[:1], later[1:] / (1 + np.exp(-raw[1:]))])
    return float(np.log(p).mean() - penalty * (w @ w) / 2), gradient


def fit_ordinal(x: Sparse, grades: np.ndarray, levels: int, penalty: float = 3e-5, steps: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ordered thresholds that maximize the penalized likelihood, by Adam on all rows."""
    d = x.shape[1]
    share = np.clip([(grades <= k).mean() for k in range(levels - 1)], 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(d), start[:1], np.log(np.expm1(np.maximum(np.diff(start), 0.1)))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        _, gradient = likelihood(theta, x, grades, levels, penalty)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta + 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        theta[:d] = np.maximum(theta[:d], 0)
    return theta[:d], cuts_of(theta[d:])


def _words(rows: DataFrame) -> DataFrame:
    """``doc_id, label, vote, words`` of a sample with ``doc_id, label, text``: one row of each group of copies."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            words = [words_of(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([vote_of(w) for w in words], pa.int64()), pa.array(words, pa.list_(pa.string()))], ["doc_id", "label", "vote", "words"])

    made = rows.mapInArrow(released(run), "doc_id long, label int, vote long, words array<string>")
    first = F.min_by(F.struct("doc_id", "words"), F.struct("doc_id", F.hash("words")))
    return made.groupBy("vote", "label").agg(first.alias("r")).select("r.doc_id", "label", "vote", "r.words")


def _table(rows: DataFrame, sets: list[Marks]) -> DataFrame:
    """``doc_id, vote, label, marks``: for each set the numbers of its marks in the row, and how often they occur."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            texts = [w.as_py() for w in b.column(3)]
            flat = [[[list(x) for x in zip(*sorted(m.counts(w).items()), strict=True)] or [[], []] for m in sets] for w in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(1), pa.array(flat, pa.list_(pa.list_(pa.list_(pa.int32()))))], ["doc_id", "vote", "label", "marks"])

    return rows.mapInArrow(released(run), "doc_id long, vote long, label int, marks array<array<array<int>>>")


def _matrix(pairs: list, width: int) -> Sparse:
    of = np.repeat(np.arange(len(pairs)), [len(p[0]) for p in pairs])
    return Sparse(of, np.array([i for p in pairs for i in p[0]], np.int64), np.log1p(np.array([c for p in pairs for c in p[1]], np.float64)), (len(pairs), width))


def _significant(a: Column, b: Column, bad: float, good: float) -> Column:
    """Of a mark in a of the toxic and b of the other rows: its log odds are high, beyond their error."""
    seen = a >= max(LEAST_ROWS, LEAST_SHARE * bad)
    a, b = a + 0.5, b + 0.5
    odds = F.log(a / (bad + 1 - a)) - F.log(b / (good + 1 - b))
    error = F.sqrt(1 / a + 1 / (bad + 1 - a) + 1 / b + 1 / (good + 1 - b))
    return seen & (odds >= LEAST_ODDS) & (odds > ERRORS * error)


def graded(labels: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Labels of more than two values as they are; of two, toxic rows by thirds of their log odds."""
    if len(np.unique(labels)) > 2:
        return labels
    toxic = labels > 0
    cuts = np.quantile(odds[toxic], np.arange(1, GRADES) / GRADES) if toxic.any() else np.zeros(GRADES - 1)
    return np.where(toxic, 1 + (odds[:, None] > cuts[None, :]).sum(axis=1), 0)


def crossed_odds(half: np.ndarray, toxic: np.ndarray, features: list[Sparse]) -> np.ndarray:
    """Of each row, by the model of two grades fitted on the other half; ``features[h]`` are all rows' for the model of half h.

    Zero where that half has rows of one kind only.
    """
    out = np.zeros(len(half))
    for h in (0, 1):
        own = np.flatnonzero(half == h)
        if len(np.unique(toxic[own])) < 2:
            continue
        x, place = features[h], np.full(len(half), -1)
        place[own] = np.arange(len(own))
        mine = place[x.row] >= 0
        weights, _ = fit_ordinal(Sparse(place[x.row[mine]], x.column[mine], x.value[mine], (len(own), x.shape[1])), toxic[own].astype(int), 2)
        out[half != h] = x.times(weights)[half != h]
    return out


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Ordinal:
    """On at most ``rows`` labelled documents; to the driver come the marks, which no row has more of than words, and their counts in each."""
    import pyarrow as pa

    got = checkpoint(_words(sample(docs, labels, "toxic", rows)))
    half = F.pmod("vote", F.lit(2)).cast("int")
    size = {(bool(r["bad"]), r["half"]): float(r["n"]) for r in got.groupBy((F.col("label") > 0).alias("bad"), half.alias("half")).agg(F.count("*").alias("n")).collect()}
    in_half = lambda bad, k: size.get((bad, k), 0.0)
    bad, good = (in_half(x, 0) + in_half(x, 1) for x in (True, False))
    none = Ordinal(Marks([]), np.zeros(1), np.zeros(0))
    if not bad or not good:
        return none

    def distinct(batches):
        for b in batches:
            for label, vote, words in zip(b.column(0), b.column(1), b.column(2), strict=True):
                found = sorted({m for w in set(words.as_py()) for m in marks_of(w)})
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), label.as_py() > 0)), pa.array(np.full(len(found), vote.as_py() % 2, np.int32)), pa.array(found, pa.string())], ["bad", "half", "mark"])

    each = got.select("label", "vote", "words").mapInArrow(released(distinct), "bad boolean, half int, mark string")
    counted = each.groupBy("mark").agg(*[F.count_if(F.col("bad") == bool(x) if h is None else (F.col("bad") == bool(x)) & (F.col("half") == h)).alias(f"{'ba'[x]}{'' if h is None else h}") for x in (1, 0) for h in (None, 0, 1)])
    tests = {"": (bad, good), "0": (in_half(True, 0), in_half(False, 0)), "1": (in_half(True, 1), in_half(False, 1))}
    flags = [_significant(F.col(f"a{h}"), F.col(f"b{h}"), *sizes).alias(f"is{h}") for h, sizes in tests.items()]
    flagged = counted.select("mark", *flags).where("is or is0 or is1").collect()
    chosen, *halves = (sorted(r["mark"] for r in flagged if r[f"is{h}"]) for h in tests)
    if not chosen:
        return none
    sets = [Marks(x) for x in (chosen, *halves)]
    table = sorted(_table(got, sets).collect(), key=lambda r: (r["doc_id"], r["vote"], r["label"]))
    x, *others = (_matrix([r["marks"][k] for r in table], len(m.names) + 1) for k, m in enumerate(sets))
    y = np.array([r["label"] for r in table])
    grades = graded(y, crossed_odds(np.array([r["vote"] % 2 for r in table]), y > 0, others))
    values = np.unique(grades)
    return Ordinal(sets[0], *fit_ordinal(x, np.searchsorted(values, grades), len(values)))


def _udf(model: Ordinal):
    import pandas as pd

    def run(texts: pd.Series) -> pd.DataFrame:
        settle()
        severity, p = model.assess(texts)
        release()
        return pd.DataFrame({"severity": severity, "p_toxic": p})

    run.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    run = F.pandas_udf(run, T.StructType([T.StructField("severity", T.DoubleType()), T.StructField("p_toxic", T.DoubleType())]))

    return run


def score(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """``doc_id, expected_severity, p_toxic, toxic`` for each document."""
    made = docs.select("doc_id", _udf(fit(docs, labels, rows))(text_or_empty()).alias("m"))
    return made.select("doc_id", F.col("m.severity").alias("expected_severity"), F.col("m.p_toxic").alias("p_toxic"), (F.col("m.p_toxic") >= TOXIC).alias("toxic"))


def keep_civil(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, all columns as they are."""
    return docs.where(_udf(fit(docs, labels, rows))(text_or_empty())["p_toxic"] < TOXIC)
