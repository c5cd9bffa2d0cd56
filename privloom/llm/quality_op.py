"""Document quality by a linear-chain conditional random field over lines.

Each line that isn't blank is good or bad; its features are shares of character classes and word repetition of itself and
of the lines beside it. Forward-backward gives each line's probability of being good, and their mean, weighted by
length, the document's quality. Training has labels of documents only: lines start with their document's label, and lines of bad
documents are relabelled by the model between rounds, each such document keeping a bad line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from privloom.llm.common import durable, remainder, sample_rows, slices, table

#: Labelled documents that teach, and most steps of one of them: a longer document teaches by the length-weighted means of so many runs of lines.
TRAIN_DOCS, TRAIN_LINES = 6_000, 1_000
#: Rounds of relabelling, steps of each fit.
ROUNDS, STEPS = 3, 150
#: Character classes, in the order of the features: fixed values.
CLASSES = ("upper", "lower", "digit", "space", "pipe", "stop", "bang", "symbol", "other")
WIDTH = len(CLASSES) + 5
#: Documents whose lines go through forward-backward together.
CHUNK = 64


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.full(0x110000, 8, np.uint8)
    for i in range(0x3000):
        c = chr(i)
        if c.isupper():
            out[i] = 0
        elif c.isalpha():
            out[i] = 1
        elif c.isdigit():
            out[i] = 2
        elif c.isspace():
            out[i] = 3
        elif c in "|\t":
            out[i] = 4
        elif c in ".,;:'\"-()":
            out[i] = 5
        elif c in "!?":
            out[i] = 6
        elif i < 0x80:
            out[i] = 7
    out[0x3000:0xE000] = 1  # letters of scripts without case, mostly
    return out


def lines_of(text: str | None) -> list[str]:
    return [x for x in (text or "").split("\n") if x and not x.isspace()]


def line_features(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features (n x WIDTH) and lengths in code points of lines that aren't blank."""
    if not lines:
        return np.zeros((0, WIDTH)), np.zeros(0)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    kinds = _classes()[np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")]
    starts = np.concatenate(([0], np.cumsum(size)[:-1]))
    shares = [np.add.reduceat(kinds == k, starts, dtype=np.int64) / size for k in range(len(CLASSES))]
    words = np.ones((4, len(lines)))
    for i, line in enumerate(lines):
        found = line.split()
        n = len(found)
        words[:, i] = n, len(set(found)), sum(map(str.__eq__, found, found[1:])), sum(map(len, found))
    n = np.maximum(words[0], 1)
    extra = [words[1] / n, words[2] / n, np.minimum(words[3] / n, 30) / 10, np.log1p(words[0]) / 5, np.minimum(size, 2000) / 1000]
    return np.column_stack(shares + extra), size.astype(float)


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and after in its document (zeros at the ends), and a one."""
    starts = np.zeros(len(x) + 1, bool)
    starts[first] = True
    before = np.vstack([np.zeros((1, x.shape[1])), x[:-1]]) * ~starts[:-1, None]
    after = np.vstack([x[1:], np.zeros((1, x.shape[1]))]) * ~np.append(starts[1:-1], True)[:, None]
    return np.column_stack([x, before, after, np.ones(len(x))])


def forward_backward(unary: np.ndarray, lengths: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected counts of the four transitions (bad, good) x (bad, good).

    ``unary`` are log odds of the lines of all documents in turn, ``lengths`` their numbers, ``pair`` transition scores.
    """
    good, moves = np.zeros(len(unary)), np.zeros((2, 2))
    first = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    order = np.argsort(lengths, kind="stable")
    step = np.exp(pair - pair.max())
    for at in range(0, len(order), CHUNK):
        docs = order[at : at + CHUNK]
        docs = docs[lengths[docs] > 0]
        if not len(docs):
            continue
        n, start = lengths[docs], first[docs]
        top = int(n.max())
        grid = start[:, None] + np.arange(top)
        inside = np.arange(top) < n[:, None]
        u = np.where(inside, unary[np.where(inside, grid, 0)], 0)
        psi = np.stack([1 / (1 + np.exp(np.clip(u, -30, 30))), 1 / (1 + np.exp(-np.clip(u, -30, 30)))], axis=2)
        psi[~inside] = 1
        alpha, beta = np.empty((top, len(docs), 2)), np.ones((top, len(docs), 2))
        a = psi[:, 0]
        alpha[0] = a = a / a.sum(1, keepdims=True)
        for t in range(1, top):
            a = np.where(inside[:, t, None], (a @ step) * psi[:, t], a)
            alpha[t] = a = a / a.sum(1, keepdims=True)
        b = beta[top - 1]
        for t in range(top - 2, -1, -1):
            b = np.where(inside[:, t + 1, None], (b * psi[:, t + 1]) @ step.T, b)
            beta[t] = b = b / b.sum(1, keepdims=True)
        both = alpha * beta
        p = (both[:, :, 1] / both.sum(2)).T
        good[grid[inside]] = p[inside]
        if top > 1:
            m = alpha[:-1, :, :, None] * step * (psi.transpose(1, 0, 2)[1:] * beta[1:])[:, :, None, :]
            m /= m.sum((2, 3), keepdims=True)
            moves += (m * inside.T[1:, :, None, None]).sum((0, 1))
    return good, moves


@dataclass
class LineField:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    pair: np.ndarray
    slope: float = 1.0
    bias: float = 0.0
    prior: float = 0.5

    def unary(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        first = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        return with_neighbours((x - self.mean) / self.scale, first[lengths > 0]) @ self.weight

    def raw(self, x: np.ndarray, size: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Length-weighted mean of the lines' probabilities; nan for a document without lines."""
        good, _ = forward_backward(self.unary(x, lengths), lengths, self.pair) if len(x) else (np.zeros(0), None)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        total = np.bincount(doc, size, len(lengths))
        return np.where(total > 0, np.bincount(doc, size * good, len(lengths)) / np.maximum(total, 1), np.nan)

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        p = np.clip(raw, 1e-4, 1 - 1e-4)
        out = 1 / (1 + np.exp(-(self.slope * np.log(p / (1 - p)) + self.bias)))
        return np.where(np.isnan(raw), self.prior, out)

    def score(self, texts: list[str | None]) -> np.ndarray:
        each = [lines_of(t) for t in texts]
        x, size = line_features([line for lines in each for line in lines])
        return self.calibrated(self.raw(x, size, np.array([len(e) for e in each], np.int64)))


def train(x: np.ndarray, size: np.ndarray, lengths: np.ndarray, label: np.ndarray) -> LineField:
    """A field from the lines of labelled documents (each with a line at least)."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-2)
    first = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    full = with_neighbours((x - mean) / scale, first)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    y = label[doc].astype(float)
    starts = np.zeros(len(x), bool)
    starts[first] = True
    weight, pair = np.zeros(full.shape[1]), np.zeros((2, 2))
    for _ in range(ROUNDS):
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:-1][~starts[1:]].astype(int), y[1:][~starts[1:]].astype(int)), 1)
        m1, m2 = np.zeros(len(weight) + 4), np.zeros(len(weight) + 4)
        for t in range(1, STEPS + 1):
            good, moves = forward_backward(full @ weight, lengths, pair)
            grad = np.append(full.T @ (y - good) / len(y) - 1e-3 * weight, (seen - moves).ravel() / len(y) - 1e-3 * pair.ravel())
            m1, m2 = 0.9 * m1 + 0.1 * grad, 0.98 * m2 + 0.02 * grad**2
            step = 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.98**t)) + 1e-8)
            weight, pair = weight + step[:-4], pair + step[-4:].reshape(2, 2)
        good, _ = forward_backward(full @ weight, lengths, pair)
        new = np.where(label[doc] == 1, 1.0, good > 0.5)
        worst = np.full(len(lengths), np.inf)
        np.minimum.at(worst, doc, good)
        new[(label[doc] == 0) & (good <= worst[doc])] = 0
        if (new == y).all():
            break
        y = new
    field = LineField(mean, scale, weight, pair, prior=float(label.mean()))
    p = np.clip(field.raw(x, size, lengths), 1e-4, 1 - 1e-4)
    z = np.log(p / (1 - p))
    a, b = 1.0, 0.0
    target = np.where(label == 1, 1 - 0.5 / (label.sum() + 1), 0.5 / (len(label) - label.sum() + 1))
    for _ in range(60):  # Newton's steps of a two-parameter logistic regression, lightly held
        q = 1 / (1 + np.exp(-(a * z + b)))
        g = np.array([((q - target) * z).sum() + 1e-2 * (a - 1), (q - target).sum() + 1e-2 * b])
        w = q * (1 - q)
        h = np.array([[(w * z * z).sum() + 1e-2, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    field.slope, field.bias = max(float(a), 0.05), float(b)
    return field


def runs(x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and lengths of a document's lines; of more than ``TRAIN_LINES``, so many runs of lines in a row: each run's length-weighted means and
    mean length, so that every line teaches."""
    if len(x) <= TRAIN_LINES:
        return x, size
    starts = np.linspace(0, len(x), TRAIN_LINES + 1).astype(int)[:-1]
    total = np.add.reduceat(size, starts)
    return np.add.reduceat(x * size[:, None], starts) / total[:, None], total / np.diff(np.append(starts, len(x)))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, modulus: int = 5, held: int = 0) -> LineField | None:
    """A field from labelled documents whose crc32(doc_id) mod ``modulus`` isn't ``held``: a bounded sample of both labels, of those
    with the smallest hashes; None if they don't have both labels. Longer documents teach by ``runs`` of lines.
    Of several rows of a doc_id the smallest text teaches."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id is not null and quality in (0, 1)")
    marks = marks.filter(remainder(F.col("doc_id"), modulus) != held).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = durable(sample_rows(marks, F.col("doc_id"), train_docs), "quality_sample")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, 256):
            each = [lines_of(t) for t in batch.column(0).to_pylist()]
            x, size = line_features([line for lines in each for line in lines])
            edge = np.concatenate(([0], np.cumsum([len(e) for e in each])))
            packed = [np.column_stack(runs(x[a:b], size[a:b])).astype("<f4").tobytes() for a, b in zip(edge, edge[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(packed, pa.binary())], ["quality", "lines"])

    teach = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))  # train_docs rows at most
    got = teach.select("text", "quality").mapInArrow(look, "quality int, lines binary").toPandas()
    got = got[got["lines"].map(len) > 0]
    if got["quality"].nunique() < 2:
        return None
    each = [np.frombuffer(b, "<f4").reshape(-1, WIDTH + 1).astype(float) for b in got["lines"]]
    both = np.concatenate(each)
    return train(both[:, :-1], both[:, -1], np.array([len(e) for e in each]), got["quality"].to_numpy())


def quality_of(spark: SparkSession, field: LineField | None, text: Column) -> Column:
    """Score of a text column; 1 throughout without a field, as nothing is known to be bad."""
    if field is None:
        return F.lit(1.0)
    shared = spark.sparkContext.broadcast(field)  # a few hundred numbers

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        values = [t if isinstance(t, str) else None for t in texts]
        parts = [shared.value.score(values[at : at + 256]) for at in range(0, len(values), 256)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs`` (doc_id, text).

    Null and empty texts and texts of blank lines get the share of label 1 among the labels; with labels of one kind only, or none, all
    get 1. Very long texts are scored whole; an empty table gives an empty one. Of several labels of a document the smallest counts; null labels don't. Repeated rows give repeated rows. Other columns are not read.
    """
    field = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), quality_of(docs.sparkSession, field, F.col("text")).alias("score"))
    return rows.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
