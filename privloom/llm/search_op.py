"""Ranked lexical search by pipelined term partitioning.

The terms of the items at hand are dealt to owners, the rarest terms to the first. An item's bundle holds sparse
accumulators (document, score so far) and goes from owner to owner: at each a cogroup brings it together with that
owner's postings, and their integer contributions are added. Long posting lists are never in one place: documents are in
blocks, an owner's postings and the bundles are split by block, and a task has one block. A bundle leaves out a document
only if even the largest contribution of all later terms can't lift it to the tenth best score that the block already
has, which loses none of the ten. After the last owner each block sends its ten best, and a window ranks these.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from privloom.llm.common import durable, slices, table

#: Owners of terms, documents of a block, and documents returned for an item.
OWNERS, BLOCK_DOCS, TOP = 4, 2_048, 10
#: Items that are searched together: so many, of so many bytes on average; more items are searched in blocks.
ITEMS, ITEM_BYTES = 1_000, 4_000_000
#: A posting's value is below this whatever the counts are.
MOST_VALUE = 1_000_000
#: Bytes that are not in terms become blanks, A-Z become small; all bytes of longer characters stay.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_POSTINGS = "block long, n_docs int, n_terms long, ids array<long>, lengths array<long>, terms array<int>, places array<int>, counts array<long>"


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a text's UTF-8, in order, with repeats."""
    return (text or b"").translate(_TERM_BYTES).split()


def _postings(vocabulary: dict[bytes, int]):
    """Documents to blocks: the postings of the vocabulary's terms sorted by term, with all documents' lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, lengths, terms, places, counts = [], [], [], [], []

        def block():
            nonlocal made, ids, lengths, terms, places, counts
            order = np.argsort(np.array(terms, np.int32), kind="stable")
            out = pa.record_batch(
                {
                    "block": pa.array([(part << 32) + made], pa.int64()), "n_docs": pa.array([sum(n > 0 for n in lengths)], pa.int32()),
                    "n_terms": pa.array([sum(lengths)], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "lengths": pa.array([lengths], pa.list_(pa.int64())),
                    "terms": pa.array([np.array(terms, np.int32)[order]], pa.list_(pa.int32())), "places": pa.array([np.array(places, np.int32)[order]], pa.list_(pa.int32())),
                    "counts": pa.array([np.array(counts, np.int64)[order]], pa.list_(pa.int64())),
                }
            )
            made += 1
            ids, lengths, terms, places, counts = [], [], [], [], []
            return out

        for batch in slices(batches, 1):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                found = terms_of(text)
                for term, count in Counter(found).items():
                    at = vocabulary.get(term)
                    if at is not None:
                        terms.append(at)
                        places.append(len(ids))
                        counts.append(count)
                ids.append(doc_id)
                lengths.append(len(found))
                if len(ids) == BLOCK_DOCS:
                    yield block()
        if ids:
            yield block()

    return run


def _values(owner_of: np.ndarray, owner: int, n: int, total: int):
    """An owner's postings of each block: (block, owner, ids, terms, places, values), the value a posting's count against its document's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, None, 1):
            row = {name: batch.column(name)[0].values.to_numpy(zero_copy_only=False) for name in ("lengths", "terms", "places", "counts")}
            own = owner_of[row["terms"]] == owner
            places, counts = row["places"][own], row["counts"][own]
            share = np.array([25 + 75 * int(x) * n // total for x in row["lengths"]], np.int64)
            values = (1_000_000_000 * counts) // (1_000 * counts + 8 * share[places])
            yield pa.record_batch(
                {
                    "block": batch.column("block"), "owner": pa.array([owner], pa.int32()), "ids": batch.column("ids"), "terms": pa.array([row["terms"][own]], pa.list_(pa.int32())),
                    "places": pa.array([places], pa.list_(pa.int32())), "values": pa.array([values], pa.list_(pa.int64())),
                }
            )

    return run


def _arrays(row: pa.Table, *names: str) -> list[np.ndarray]:
    return [row.column(n).combine_chunks().values.to_numpy(zero_copy_only=False) for n in names]


def _stage(needs: list[list[tuple[int, int]]], rest: np.ndarray, last: bool):
    """The work of one owner in one block: bundles take the contributions of ``needs`` (term, factor) of their items, and go on.

    ``rest``: the most that later owners can add to an item. After the last owner the best documents of the block.
    """

    def add(bundles: pa.Table, postings: pa.Table) -> pa.Table:
        items = bundles.column("item").to_numpy()
        out_items, out_a, out_b = [], [], []
        if postings.num_rows:
            ids = postings.column("ids").combine_chunks().values
            terms, places, values = _arrays(postings, "terms", "places", "values")
            docs, scores = bundles.column("docs").combine_chunks(), bundles.column("scores").combine_chunks()
            cuts, known_docs, known_scores = docs.offsets.to_numpy(), docs.values.to_numpy(), scores.values.to_numpy()
            # documents by id, those without one last: so equal scores are cut in that order
            order = np.lexsort((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False))) if last else None
            for k, item in enumerate(items):
                total = np.zeros(len(ids), np.int64)
                total[known_docs[cuts[k] : cuts[k + 1]]] = known_scores[cuts[k] : cuts[k + 1]]
                for term, factor in needs[item]:
                    lo, hi = np.searchsorted(terms, (term, term + 1))
                    total[places[lo:hi]] += factor * values[lo:hi]
                held = np.flatnonzero(total)
                if last:
                    ranked = order[np.argsort(-total[order], kind="stable")][: min(TOP, len(held))]
                    out_items += [item] * len(ranked)
                    out_a.append(ranked)
                    out_b.append(total[ranked])
                    continue
                if len(held) > TOP:
                    least = np.partition(total[held], -TOP)[-TOP]
                    held = held[total[held] + rest[item] >= least]
                out_items.append(item)
                out_a.append(held.astype(np.int32))
                out_b.append(total[held])
        if last:
            best = np.concatenate(out_a) if out_a else np.zeros(0, np.int64)
            found = ids.take(pa.array(best)) if len(best) else pa.array([], pa.int64())
            return pa.table({"item": pa.array(out_items, pa.int32()), "doc_id": found, "score": pa.array(np.concatenate(out_b) if out_b else [], pa.int64())})
        block, owner = (bundles.column(c)[0].as_py() if len(items) else 0 for c in ("block", "owner"))
        return pa.table(
            {
                "block": pa.array([block] * len(out_items), pa.int64()), "owner": pa.array([owner + 1] * len(out_items), pa.int32()), "item": pa.array(out_items, pa.int32()),
                "docs": pa.array(out_a, pa.list_(pa.int32())), "scores": pa.array(out_b, pa.list_(pa.int64())),
            }
        )

    return add


def _search(docs: DataFrame, items: list[bytes | None]) -> DataFrame:
    """(item, doc_id, score): for each place of ``items`` the best documents of each block."""
    spark = docs.sparkSession
    wanted = [Counter(terms_of(text)) for text in items]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*wanted)))}
    index = durable(docs.mapInArrow(_postings(vocabulary), _POSTINGS), "postings")
    nothing = spark.createDataFrame([], "item int, doc_id long, score long")
    n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    if not n or not vocabulary:
        return nothing
    df = np.zeros(len(vocabulary), np.int64)
    for row in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a term of the items
        df[row.term] = row["count"]
    weight = [math.floor(1_000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df]

    # rarest first, about as many postings to each owner
    order = np.argsort(df, kind="stable")
    before = np.cumsum(df[order]) - df[order]
    owner_of = np.zeros(len(df), np.int32)
    owner_of[order] = np.minimum(before * OWNERS // max(int(df.sum()), 1), OWNERS - 1)
    needs = [[[] for _ in items] for _ in range(OWNERS)]
    most = np.zeros((OWNERS, len(items)), np.int64)
    for item, counter in enumerate(wanted):
        for term, repeats in counter.items():
            at = vocabulary[term]
            if df[at] and weight[at]:
                needs[owner_of[at]][item].append((at, repeats * weight[at]))
                most[owner_of[at], item] += repeats * weight[at] * MOST_VALUE

    empty = F.array().cast("array<int>").alias("docs"), F.array().cast("array<long>").alias("scores")
    bundles = index.select("block", F.lit(0).alias("owner"), F.explode(F.sequence(F.lit(0), F.lit(len(items) - 1))).alias("item"), *empty)
    for owner in range(OWNERS):
        last = owner == OWNERS - 1
        held = index.mapInArrow(_values(owner_of, owner, int(n), int(total)), "block long, owner int, ids array<long>, terms array<int>, places array<int>, values array<long>")
        work = _stage(needs[owner], most[owner + 1 :].sum(0), last)
        schema = "item int, doc_id long, score long" if last else "block long, owner int, item int, docs array<int>, scores array<long>"
        bundles = bundles.groupBy("block", "owner").cogroup(held.groupBy("block", "owner")).applyInArrow(work, schema)
    return bundles


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``top`` (at most 10) best of ``docs`` (doc_id, text) for each row of ``items`` (item_id, text).

    Null and empty texts have no terms: such an item has no rows, such a document is in none. Very long texts are taken whole. Equal
    scores go by ascending doc_id, documents without one last; repeated documents each have a rank, repeated items each have their rows. Either
    table may be empty. Other columns are not read.
    """
    spark = docs.sparkSession
    if not 1 <= top <= TOP:
        raise ValueError(f"top is from 1 to {TOP}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    distinct = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).groupBy("item_id", "text").agg(F.count("*").cast("int").alias("copies"))
    rows, size = distinct.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-rows // ITEMS), -(-size // ITEM_BYTES))
    distinct = distinct.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    if blocks > 1:
        distinct = durable(distinct, "items")
    out = spark.createDataFrame([], "item_id long, copies int, rank int, doc_id long, score long")
    for part in range(blocks):
        held = distinct.filter(F.col("part") == part).orderBy("item_id", "text").collect()  # a block of items
        if not held:
            continue
        best = _search(docs, [r["text"].encode() for r in held])
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        names = F.broadcast(spark.createDataFrame([(i, r["item_id"], r["copies"]) for i, r in enumerate(held)], "item int, item_id long, copies int"))
        out = out.unionByName(best.join(names, "item").select("item_id", "copies", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS w FROM benchmark),
size AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS total FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM df, size),
value AS (SELECT r, term, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(w) * n_docs) // total)) AS value FROM tf JOIN d USING (r), size),
score AS (SELECT q, item_id, r, sum(weight * value)::BIGINT AS score
  FROM (SELECT q, item_id, unnest(w) AS term FROM i) JOIN weight USING (term) JOIN value USING (term) GROUP BY q, item_id, r),
ranked AS (SELECT q, item_id, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM score JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {TOP}"""
