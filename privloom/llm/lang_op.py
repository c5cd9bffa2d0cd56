"""Language identification by language-bitmask n-gram filters.

One Bloom filter for each language, bit-sliced: a slot holds a word with one bit for each language, so that the AND of an n-gram's slots
says at once which languages hold it. A text's score for a language is its share of n-grams in that filter, corrected
for the filter's false positives.
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
from pyspark.sql.window import Window

from privloom.llm.common import durable, remainder, slices, table

UNKNOWN = "und"
#: Documents of each language that teach the filters: the bound of the model.
TRAIN_DOCS = 3_000
#: An n-gram belongs to a language if at least this share of its documents (and two) holds it.
LEAST_SHARE = 0.02
#: Least slots (a power of two) of the filters, slots for each n-gram of the largest language, hashes, and languages of a mask word.
SLOTS, ROOM, HASHES, WORD = 1 << 20, 12, 3, 64
#: Code points of a block of a very long text, whose blocks give the n-grams of the whole.
BLOCK = 400_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@dataclass(frozen=True)
class Piece:
    """A block of a lower-cased text. ``runs_on``: its word began in the block before, whose last three letters it starts with; ``open_end``: its
    last word goes on."""

    text: str
    runs_on: bool = False
    open_end: bool = False


def blocks(text: str, size: int | None = None) -> Iterator[Piece]:
    """Blocks end after a space where there is one in their second half, else inside a word with an overlap of three letters."""
    size = size or BLOCK
    text, at, runs_on = text.lower(), 0, False
    while at < len(text):
        end = min(at + size, len(text))
        cut = text.rfind(" ", at + size // 2, end) if end < len(text) else -1
        if cut > 0:
            end = cut + 1
        own = 0  # letters before the end, of a word that goes on behind it
        while end < len(text) and text[end].isalpha() and own < 3 and text[end - 1 - own].isalpha():
            own += 1
        if own < 3:
            end -= own
        yield Piece(text[at:end], runs_on, own == 3)
        runs_on = own == 3
        at = end - 3 if runs_on else end


def grams(pieces: list[Piece | str]) -> tuple[np.ndarray, np.ndarray]:
    """(piece index, hash) of each three- and four-gram of lower-cased letters; a space stands for what is beside a word, and no
    n-gram spans two words. The three-gram that a block repeats of the one before is left out."""
    pieces = [Piece(p.lower()) if isinstance(p, str) else p for p in pieces]
    lowered = [("" if p.runs_on else " ") + p.text + ("" if p.open_end else " ") for p in pieces]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.array([len(t) for t in lowered], np.int64)
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    again = np.zeros(len(codes), bool)
    again[starts] = np.array([p.runs_on for p in pieces], bool)[sizes > 0]
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[starts] = True
    codes, owner, again, letter = np.where(letter, codes, 32)[keep].astype(np.uint64), owner[keep], again[keep], letter[keep]
    out_owner, out_hash = [], []
    mix = np.uint64(0x9E3779B97F4A7C15)
    for n in (3, 4):
        m = len(codes) - n + 1
        if m <= 0:
            continue
        ok = owner[:m] == owner[n - 1 :]
        for i in range(1, n - 1):
            ok &= letter[i : m + i]
        if n == 3:
            ok &= ~again[:m]
        at = np.flatnonzero(ok)
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = (h ^ codes[at + i]) * mix
            h ^= h >> np.uint64(29)
        out_owner.append(owner[at])
        out_hash.append(h)
    return (np.concatenate(out_owner), np.concatenate(out_hash)) if out_owner else (np.zeros(0, np.int32), np.zeros(0, np.uint64))


def slots_of(h: np.ndarray, i: int, slots: int) -> np.ndarray:
    h = (h ^ np.uint64(0xA0761D6478BD642F * (i + 1) & (2**64 - 1))) * np.uint64(0xE7037ED1A0B428DB)
    return (h >> np.uint64(33)).astype(np.int64) & (slots - 1)


@dataclass
class LanguageFilters:
    languages: list[str]
    masks: np.ndarray  # slots x words of uint64, a bit for each language
    wrong: np.ndarray  # each language's false positive rate

    @classmethod
    def build(cls, by_language: dict[str, np.ndarray], slots: int | None = None) -> "LanguageFilters":
        """``slots`` (a power of two) follow the largest language's n-grams unless given."""
        languages = sorted(by_language)
        slots = slots or max(SLOTS, 1 << (ROOM * max(map(len, by_language.values()), default=0)).bit_length())
        masks = np.zeros((slots, max(1, -(-len(languages) // WORD))), np.uint64)
        for i, name in enumerate(languages):
            for k in range(HASHES):
                masks[slots_of(by_language[name], k, slots), i // WORD] |= np.uint64(1 << i % WORD)
        fill = np.array([np.count_nonzero(masks[:, i // WORD] >> np.uint64(i % WORD) & np.uint64(1)) / slots for i in range(len(languages))])
        return cls(languages, masks, fill**HASHES)

    def counts(self, pieces: list[Piece | str]) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of each piece, and of those how many each language's filter holds."""
        owner, h = grams(pieces)
        slots = len(self.masks)
        at = [slots_of(h, k, slots) for k in range(HASHES)]
        hits = np.zeros((len(pieces), len(self.languages)), np.int64)
        for word in range(self.masks.shape[1]):
            column = self.masks[:, word]
            found = column[at[0]]
            for k in range(1, HASHES):
                found &= column[at[k]]
            for i in range(word * WORD, min(len(self.languages), (word + 1) * WORD)):
                hits[:, i] = np.bincount(owner[(found >> np.uint64(i % WORD) & np.uint64(1)) > 0], minlength=len(pieces))
        return np.bincount(owner, minlength=len(pieces)), hits

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text: the corrected share of its n-grams that the language's filter holds."""
        n, hits = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        group: list[tuple[int, Piece]] = []
        size = 0

        def flush() -> None:
            if group:
                a, b = self.counts([t for _, t in group])
                at = [i for i, _ in group]
                np.add.at(n, at, a)
                np.add.at(hits, at, b)

        for i, text in enumerate(texts):
            for part in blocks(text or ""):
                group.append((i, part))
                size += len(part.text)
                if size >= BLOCK:
                    flush()
                    group, size = [], 0
        flush()
        share = np.clip((hits / np.maximum(n, 1)[:, None] - self.wrong) / (1 - self.wrong), 0, 1)
        names, scores = [], []
        for i, text in enumerate(texts):
            if not self.languages or not text or not any(c.isalpha() for c in text):
                names.append(UNKNOWN)
                scores.append(0.0)
            else:
                best = int(share[i].argmax())
                names.append(self.languages[best])
                scores.append(float(share[i, best]))
        return names, scores


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, modulus: int = 5) -> LanguageFilters:
    """Filters from text and lang of a bounded sample of documents of each language (those with the smallest hashes) whose crc32(doc_id) mod
    ``modulus`` isn't 0 and whose lang isn't null."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    teach = rows.filter(F.col("lang").isNotNull() & (remainder(F.col("doc_id"), modulus) != 0))
    # most rows go by a threshold on the hash, so that the ranks see little more than train_docs rows of a language
    share = teach.groupBy("lang").agg((F.lit(1.2 * train_docs + 100) / F.count("*")).alias("share"))
    h = F.xxhash64("doc_id")
    near = teach.select("doc_id", "lang").join(F.broadcast(share), "lang").filter(h.cast("double") / F.lit(2.0**64) + F.lit(0.5) <= F.col("share"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(h, "doc_id"))
    chosen = durable(near.distinct().withColumn("rank", rank).filter(F.col("rank") <= train_docs).select("doc_id", "lang"), "lang_sample")
    teach = teach.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # train_docs rows a language at most

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, 256):
            seen: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                found = [np.unique(grams([part])[1]) for part in blocks(text or "")]
                seen.setdefault(lang, []).append(np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64))
            for lang, each in seen.items():
                gram, n = np.unique(np.concatenate(each), return_counts=True)
                gram, n = np.append(gram.view(np.int64), 0), np.append(n, len(each))  # gram 0 counts the documents
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])

    counts = teach.select("text", "lang").mapInArrow(learn, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = durable(counts, "lang_grams")
    totals = counts.filter("gram = 0").select("lang", F.greatest(F.when(F.col("n") > 1, 2.0).otherwise(1.0), LEAST_SHARE * F.col("n")).alias("least"))
    # at least LEAST_SHARE of a language's documents hold each: at most 1 / LEAST_SHARE of the n-grams that one of them has on average
    kept = counts.filter("gram <> 0").join(F.broadcast(totals), "lang").filter("n >= least").select("lang", "gram").toPandas()
    by_language = {lang: np.zeros(0, np.uint64) for lang in (r.lang for r in totals.select("lang").collect())}
    by_language.update({lang: each.to_numpy(np.int64).view(np.uint64) for lang, each in kept.groupby("lang")["gram"]})
    return LanguageFilters.build(by_language)


def language_of(docs_session: SparkSession, filters: LanguageFilters, text: Column) -> Column:
    """struct(lang string, score double) of a text column."""
    shared = docs_session.sparkContext.broadcast(filters)  # a word for each slot and 64 languages; slots follow the n-grams that 1 / LEAST_SHARE bounds

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        out: list[list] = [[], []]
        values = [None if not isinstance(t, str) else t for t in texts]
        for at in range(0, len(values), 256):
            names, scores = shared.value.predict(values[at : at + 256])
            out[0] += names
            out[1] += scores
        return pd.DataFrame({"lang": out[0], "score": out[1]})

    return predict(text.cast("string"))


def identify(docs: DataFrame, filters: LanguageFilters | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of ``docs`` (doc_id, text, lang; lang only to learn from).

    ``und`` with score 0 if the text is null or has no letter, or if nothing was learned; ties go to the first language by name. Very
    long texts are counted in blocks that give the n-grams of the whole. An empty table gives an empty one. Repeated rows give repeated rows. Other columns are not read.
    """
    filters = filters or fit(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), language_of(docs.sparkSession, filters, F.col("text")).alias("found"))
    return rows.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
