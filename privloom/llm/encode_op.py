"""Byte-level BPE encoding and decoding of whole texts on Spark."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from privloom.llm import byte_bpe
from privloom.llm.common import slices, table

RANKS = "byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=2)
def _worker(path: str, pattern: str):
    return byte_bpe.monoid_text_encoder(byte_bpe.load_ranks(path), pattern)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, name: str = RANKS, pattern: str | None = None, keep_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of each row of ``docs`` (doc_id, text).

    One row for each input row; a null text is an empty one, with no ids. Very long texts are encoded whole, up
    the tree; an empty table gives an empty one. Other columns of ``docs`` are not read. ``keep_ids=False`` leaves out the array of ids.
    """
    pattern = pattern or split_pattern()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, text_ids = _worker(vocabulary(name), pattern)
        for batch in slices(batches, 1):
            out: list[list] = [[], [], [], []]
            for packed in text_ids.batch([text or "" for text in batch.column(1).to_pylist()]):
                ids = np.frombuffer(packed, "<u4")
                out[0].append(len(ids))
                out[1].append(ids.astype(np.int64) if keep_ids else None)
                out[2].append(hashlib.sha256(packed).hexdigest())
                out[3].append(hashlib.sha256(bpe.decode(ids.tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())],
                ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = rows.mapInArrow(encode, "doc_id long, n_tokens long, ids array<long>, ids_sha256 string, decoded_sha256 string")
    return out if keep_ids else out.drop("ids")


def decode_ids(df: DataFrame, name: str = RANKS) -> DataFrame:
    """(doc_id, decoded binary) from (doc_id, ids array<long>); null ids give empty bytes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = _worker(vocabulary(name), split_pattern())
        for batch in batches:
            decoded = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], ["doc_id", "decoded"])

    return df.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<long>")).mapInArrow(decode, "doc_id long, decoded binary")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), keep_ids=False)
