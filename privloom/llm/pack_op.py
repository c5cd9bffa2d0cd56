"""Packing tokens into sequences: shortest-pack-first over the length histogram.

Each document's ids are cut into pieces at multiples of the sequence length. Only the histogram of piece lengths (one row
for each length, so bounded by the sequence length) goes to the driver, where lengths are placed longest first, each into the
patterns with the most room left, updating pattern counts. Patterns join back to pieces by length and rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from privloom.llm.byte_bpe import TextEncoder, load_ranks
from privloom.llm.common import durable, slices, table
from privloom.llm.encode_op import split_pattern, vocabulary

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SEQUENCE, END_ID = 2048, 1
#: Pieces of one length that are ranked in one group, on average.
GROUP = 5_000


@lru_cache(maxsize=1)
def _worker(tokenizer: str, ranks: str):
    """Encoders of a worker: the rank file has the same vocabulary and is several times faster; the tokenizer itself
    takes the texts that spell one of its special tokens."""
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary(tokenizer))
    special = tuple(t.content for t in slow.get_added_tokens_decoder().values())
    fast = tiktoken.Encoding("ranks", pat_str=split_pattern(), mergeable_ranks=load_ranks(vocabulary(ranks)), special_tokens={})
    plain = TextEncoder(lambda units: [np.array(fast.encode_ordinary(unit), "<u4").tobytes() for unit in units])

    def ids(texts: list[str]) -> list[bytes]:
        spell = [any(s in text for s in special) for text in texts]
        fine = iter(plain.batch([text for text, odd in zip(texts, spell) if not odd]))
        return [np.array(slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if odd else next(fine) for text, odd in zip(texts, spell)]

    return ids


def pieces(docs: DataFrame, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids and the end id, cut at multiples of ``sequence``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = _worker(TOKENIZER, RANKS), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, 1):
            rows: list[tuple] = []
            for doc_id, packed in zip(batch.column(0).to_pylist(), ids([text or "" for text in batch.column(1).to_pylist()])):
                packed += end
                n = len(packed) // 4
                rows += [(doc_id, s, min(sequence, n - s), zlib.crc32(packed[4 * s : 4 * (s + sequence)]), n) for s in range(0, n, sequence)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[list[tuple[int, int]], int]]:
    """[(pattern, count)]: a pattern is [(length, copies)] in order; it is used ``count`` times.

    Lengths go longest first, each into the patterns with the most room left. If none has room, new packs are filled with as
    many copies of the length as they hold.
    """
    room: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    most = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        most = max((r for r, p in room.items() if p), default=0)
        while left > 0:
            while most >= length and not room.get(most):
                most -= 1
            if most >= length:
                pattern, count = room[most].pop()
                used = min(count, left)
                if used < count:
                    room[most].append((pattern, count - used))
                new = pattern[:-1] + [(length, pattern[-1][1] + 1)] if pattern[-1][0] == length else pattern + [(length, 1)]
                room.setdefault(most - length, []).append((new, used))
                left -= used
            else:
                each = sequence // length
                for copies, count in ((each, left // each), (left % each, 1 if left % each else 0)):
                    if count:
                        room.setdefault(sequence - copies * length, []).append(([(length, copies)], count))
                left = 0
    return [p for r in sorted(room) for p in room[r]]


def slots(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[int, list[tuple[int, ...]]]:
    """For each length the slots in rank order: (first rank, copies in a sequence, first sequence_id, offset, sequence's tokens)."""
    out: dict[int, list[tuple[int, ...]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for pattern, count in patterns:
        offset, total = 0, sum(length * copies for length, copies in pattern)
        for length, copies in pattern:
            at = ranks.get(length, 0)
            out.setdefault(length, []).append((at, copies, first, offset, total))
            ranks[length] = at + count * copies
            offset += length * copies
        first += count
    return out


def pack(docs: DataFrame, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, padded_to) of each piece of each row.

    A null or empty text is the end id alone; very long texts become many pieces. Repeated rows are packed each; an empty table gives an empty one. Sequences are
    padded to ``sequence`` unless their length is a power of two. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    cut = durable(pieces(docs, sequence, end_id), "pieces")
    by_length = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}  # one row a length
    patterns = shortest_pack_first(by_length, sequence)
    placed = slots(patterns)
    shape = "length long, firsts array<long>, copies array<long>, sequences array<long>, offsets array<long>, totals array<long>"
    rows = [(length, *map(list, zip(*at))) for length, at in placed.items()]
    where = F.broadcast(spark.createDataFrame(rows, shape))  # a pattern's slots: bounded by the histogram's lengths

    # ranks among the pieces of a length: groups of a bounded size, and the sizes of those before
    groups = max(1, -(-max(by_length.values(), default=1) // GROUP))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)).cast("int"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy("length", "part").count()
    sizes = sizes.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("inside", F.row_number().over(inside) - 1).join(sizes, ["length", "part"]).withColumn("rank", F.col("base") + F.col("inside"))

    at = F.size(F.filter("firsts", lambda x: x <= F.col("rank")))
    ranked = ranked.join(where, "length").withColumn("at", at)
    value = lambda name: F.element_at(name, F.col("at"))
    within = F.col("rank") - value("firsts")
    each = value("copies")
    out = ranked.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (value("sequences") + F.floor(within / each)).cast("long").alias("sequence_id"),
        (value("offsets") + F.pmod(within, each) * F.col("length")).cast("long").alias("offset"),
        value("totals").alias("sequence_tokens"),
    )
    power = F.col("sequence_tokens").bitwiseAND(F.col("sequence_tokens") - 1) == 0
    return out.withColumn("padded_to", F.when(power, F.col("sequence_tokens")).otherwise(F.lit(sequence).cast("long")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
