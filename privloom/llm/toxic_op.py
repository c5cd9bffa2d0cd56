"""Toxicity by weak supervision.

Many voters look at a text: words and word beginnings of a lexicon (a fixed one, and those that the training labels
single out) and a few patterns. A generative label model estimates each voter's accuracy by expectation
maximisation and the correlations between voters, so that voters that repeat each other don't count twice. A linear
classifier is trained on the posterior labels, and scores every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from privloom.llm.common import durable, remainder, sample_rows, slices, table

#: Plain insults that vote even where no label mentions them: fixed values.
LEXICON = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "imbecile", "dumbass", "bastard", "filth", "vermin", "scumbag", "freak", "degenerate")
#: Whole-text patterns: name and regular expression over the lower-cased text.
PATTERNS = (
    ("address", r"\b(?:you|ihr|vous|ustedes)\s+(?:are\s+)?(?:all\s+)?(?:such\s+)?(?:a\s+)?(?:stupid|pathetic|worthless|disgusting)\b"),
    ("shut_up", r"\b(?:shut\s+up|go\s+to\s+hell|drop\s+dead)\b"),
    ("masked", r"\b[a-z][*@#$]{2,}[a-z]*\b"),
    ("shouting", r"!{3,}"),
)
#: Labelled documents that teach: the bound of the model.
TRAIN_DOCS = 20_000
#: Clean documents with a vote that each voter is charged with beforehand: a rare word isn't sure of itself.
DOUBT = 4.0
#: Lengths of word beginnings that may become voters.
STEMS = (4, 5, 6)
#: A learned voter's toxic documents at least, and the chance (over all candidates) that a useless one gets so far.
LEAST_DOCS, CHANCE = 4, 0.01
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Voters:
    """What may vote: whole words, and word beginnings (ending in ``*``)."""

    names: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._automaton = None

    def __getstate__(self):
        return {"names": self.names}

    def __setstate__(self, state):
        self.names, self._automaton = state["names"], None

    @property
    def width(self) -> int:
        return len(self.names) + len(PATTERNS)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Occurrences of each voter in each whole text."""
        if self._automaton is None and self.names:
            self._automaton = ahocorasick.Automaton()
            for i, name in enumerate(self.names):
                stem = name.rstrip("*")
                self._automaton.add_word(stem, self._automaton.get(stem, ()) + ((len(stem), i, name.endswith("*")),))
            self._automaton.make_automaton()
        out = np.zeros((len(texts), self.width), np.float64)
        for row, text in enumerate(texts):
            text = (text or "").lower()
            if not text:
                continue
            if self.names:
                last = len(text) - 1
                for end, found in self._automaton.iter(text):
                    for n, i, stem in found:
                        before = end - n
                        if (before < 0 or not text[before].isalpha()) and (stem or end == last or not text[end + 1].isalpha()):
                            out[row, i] += 1
            for k, rx in enumerate(_patterns()):
                out[row, len(self.names) + k] = sum(1 for _ in rx.finditer(text))
        return out


@lru_cache(maxsize=1)
def _patterns() -> list[re.Pattern]:
    return [re.compile(rx) for _, rx in PATTERNS]


@dataclass
class LabelModel:
    """P(vote | label) of each voter, the prior, and weights that discount correlated voters."""

    prior: float
    yes: np.ndarray
    no: np.ndarray
    weight: np.ndarray

    @classmethod
    def fit(cls, votes: np.ndarray, prior: float, start: np.ndarray, clean: np.ndarray | None = None, rounds: int = 50) -> "LabelModel":
        """``votes`` 0/1 (rows x voters), ``start`` a first guess of each row's posterior. ``clean``: rows known to be clean; no voter is taken to
        err less often than it does there."""
        floor = 0.0 if clean is None else (votes[clean].sum(0) + DOUBT) / (clean.sum() + DOUBT)
        post = start.astype(float)
        weight = np.ones(votes.shape[1])
        for _ in range(rounds):
            one, zero = post.sum(), (1 - post).sum()
            yes = (votes.T @ post + 0.05) / (one + 1)
            no = np.maximum((votes.T @ (1 - post) + DOUBT) / (zero + DOUBT), floor)
            # correlations given the label: what is left of the votes when the label's mean is taken away
            rest = votes - (post[:, None] * yes + (1 - post)[:, None] * no)
            sd = np.sqrt((rest**2).mean(0)) + 1e-9
            corr = np.clip((rest.T @ rest) / len(votes) / np.outer(sd, sd), 0, 1)
            np.fill_diagonal(corr, 0)
            corr[corr < 0.5] = 0
            weight = 1 / (1 + corr.sum(1))
            model = cls(prior, np.clip(yes, 1e-6, 1 - 1e-6), np.clip(no, 1e-6, 1 - 1e-6), weight)
            new = model.posterior(votes)
            if np.abs(new - post).max() < 1e-4:
                post = new
                break
            post = new
        return model

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        # a voter that doesn't vote abstains: its silence says nothing, as each knows one language and few words
        z = np.log(self.prior / (1 - self.prior)) + votes @ (np.log(self.yes / self.no) * self.weight)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class ToxicModel:
    voters: Voters
    strength: np.ndarray  # log odds of each voter in the label model, 0 for one that doesn't point to toxic
    coef: np.ndarray
    bias: float

    def features(self, counts: np.ndarray) -> np.ndarray:
        """Weighted sums over the voters, and each voter's count."""
        some = np.log1p(counts)
        good = self.strength > 0
        total = counts[:, good].sum(1)
        return np.column_stack([np.log1p(total), np.log1p((counts[:, good] > 0) @ self.strength[good]), total > 0, total > 1, some])

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        z = self.features(self.voters.counts(texts)) @ self.coef + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train_linear(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels ``y`` by accelerated gradient descent."""
    scale = np.maximum(np.sqrt((x**2).mean(0)), 1e-3)
    xs = x / scale
    step = 4 / (np.linalg.norm(xs, 2) ** 2 / len(xs) + 1)
    w = v = np.zeros(x.shape[1] + 1)
    w, v = w.copy(), v.copy()
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(xs @ v[:-1] + v[-1], -40, 40)))
        g = np.append(xs.T @ (p - y) / len(y) + l2 * v[:-1], (p - y).mean())
        new = v - step * g
        v, w = new + (t - 1) / (t + 2) * (new - w), new
    return w[:-1] / scale, float(w[-1])


def candidates(text: str | None) -> set[str]:
    words = set(WORD.findall((text or "").lower()))
    return {w for w in words if len(w) > 2} | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}


def learn_voters(teach: DataFrame) -> list[str]:
    """Names of the voters that the labels of ``teach`` (text, toxic) single out; only counts by name reach the driver."""
    spark = teach.sparkSession

    def spell(only: set[str] | None):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 64):
                    total: dict[str, int] = {}
                    for text in whole.slice(at, 64).column(0).to_pylist():
                        found = candidates(text)
                        for name in found if only is None else found & only:
                            total[name] = total.get(name, 0) + 1
                    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["name", "n"])

        return work

    sizes = {r.toxic: r["count"] for r in teach.groupBy("toxic").count().collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return []
    base = bad / (bad + good)
    of = lambda label, only: teach.filter(F.col("toxic") == label).select("text").mapInArrow(spell(only), "name string, n long").groupBy("name").agg(F.sum("n").alias("n"))
    toxic = durable(of(1, None), "toxic_words")
    tried = max(1, toxic.count())
    least = max(LEAST_DOCS, int(np.ceil(np.log(CHANCE / tried) / np.log(base))))
    # by chance a name of d toxic documents has d / base documents; far rarer ones in clean texts are what is sought
    often = toxic.filter(F.col("n") >= least).toPandas()  # at most the candidates of train_docs documents, over least
    hits = dict(zip(often["name"], often["n"].tolist()))
    clean = of(0, set(hits)).toPandas() if hits else pd.DataFrame({"name": [], "n": []})
    false = dict(zip(clean["name"], clean["n"].tolist()))
    kept = []
    for name, n in hits.items():
        ratio = (n / bad) / ((false.get(name, 0) + 0.5) / good)
        if ratio >= 25:
            kept.append((-n, name))
    return [name for _, name in sorted(kept)]


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, modulus: int = 3, held: int = 1) -> ToxicModel:
    """A model from the labelled documents whose crc32(doc_id) mod ``modulus`` isn't ``held``: a bounded sample of them, those with
    the smallest hashes. Without any, the fixed lexicon decides."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    marks = marks.filter(remainder(F.col("doc_id"), modulus) != held).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = durable(sample_rows(marks, F.col("doc_id"), train_docs), "toxic_sample")
    teach = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))
    teach = durable(teach, "toxic_teach")  # train_docs rows at most

    learned = learn_voters(teach)
    voters = Voters(list(dict.fromkeys([*LEXICON, *learned])))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, 256):
            counts = voters.counts(batch.column(0).to_pylist())
            where, who = np.nonzero(counts)
            first = np.searchsorted(where, np.arange(len(counts) + 1))
            lists = lambda v, t: pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(v, t))
            yield pa.RecordBatch.from_arrays([batch.column(1), lists(who, pa.int32()), lists(counts[where, who], pa.float64())], ["toxic", "who", "n"])

    got = teach.select("text", "toxic").mapInArrow(vote, "toxic int, who array<int>, n array<double>").toPandas()  # train_docs rows at most
    counts = np.zeros((len(got), voters.width))
    for i, (who, n) in enumerate(zip(got["who"], got["n"])):
        counts[i, who] = n
    label = got["toxic"].to_numpy(float)
    if not len(got) or label.min() == label.max():
        # nothing to learn from: one voter tells nothing for sure, two do
        strength = np.append(np.ones(len(voters.names)), np.zeros(len(PATTERNS)))
        coef = np.zeros(4 + voters.width)
        coef[0], coef[3] = 2.0, 1.0
        return ToxicModel(voters, strength, coef, -3.0)
    votes = (counts > 0).astype(float)
    words = votes[:, : len(voters.names)].any(1)
    # one more voter, for clean: no word or stem was seen. The labels chose the voters, give the prior and bound
    # error rates from below; they don't vote
    votes = np.column_stack([votes, ~words])
    prior = float(np.clip(label.mean(), 1e-3, 1 - 1e-3))
    model = LabelModel.fit(votes, prior, np.where(words, 0.9, 0.02), label == 0)
    strength = (np.log(model.yes / model.no) * model.weight)[:-1]
    strength[(strength < 0.5) | (votes[:, :-1].sum(0) < 2)] = 0
    post = model.posterior(votes)
    out = ToxicModel(voters, strength, np.zeros(4 + voters.width), 0.0)
    out.coef, out.bias = train_linear(out.features(counts), post)
    return out


def toxicity_of(spark: SparkSession, model: ToxicModel, text: Column) -> Column:
    shared = spark.sparkContext.broadcast(model)  # names and weights of the voters, which the labelled sample bounds

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        values = [t if isinstance(t, str) else None for t in texts]
        parts = [shared.value.score(values[at : at + 256]) for at in range(0, len(values), 256)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return score(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs`` (doc_id, text).

    Null and empty texts get the score of a text in which no voter votes; very long texts are read whole; an empty table gives an empty one. Repeated rows give repeated rows; of several labels of a
    document the largest counts; null labels don't. Other columns are not read.
    """
    model = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), toxicity_of(docs.sparkSession, model, F.col("text")).alias("score"))
    return rows.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
