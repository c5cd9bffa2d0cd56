"""Ranked search against sums over all documents, and the edge cases."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import privloom.llm.search_op as search_op
from privloom.llm.search_op import OP11_SQL, op11_lexical_search, search, terms_of
from tests.llm.sql import same_rows


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    bags = [(i, Counter(plain_terms(t))) for i, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for doc, bag in bags:
            if total:
                m = 25 + 75 * sum(bag.values()) * n // total
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in plain_terms(text) if t in bag)
                if s > 0:
                    scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def ask(spark, docs, items, **more):
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in search(d, i, **more).collect()), key=str)


def test_against_sql(spark, sf_dir):
    same_rows(op11_lexical_search(spark, sf_dir), OP11_SQL, sf_dir)


def test_terms():
    for text in (None, "", "A-b_c9\x00\x7fÉté É x", "it's 1.5", "\U0001f600 ok"):
        assert [t.decode() for t in terms_of(text and text.encode())] == plain_terms(text)


@pytest.fixture
def small_blocks(monkeypatch):
    # pruning and several blocks of documents and of items, in this process and in what it sends to workers
    monkeypatch.setattr(search_op, "BLOCK_DOCS", 16)
    monkeypatch.setattr(search_op, "ITEMS", 3)


def test_against_brute_force_with_ties_copies_and_a_term_everywhere(spark, small_blocks):
    words = [f"w{i}" for i in range(60)]
    docs = [(i % 97, "the " + " ".join(words[(i * k * k + k) % (7 + i % 53)] for k in range(1 + i % 40))) for i in range(400)]
    docs += [(5, "the w1 w2")] * 30 + [(None, "w1 w2 the")] * 3 + [(700, None), (701, ""), (702, "-- !"), (703, "W3 " * 3000)]
    items = [(1, "the w1 W2 w2"), (1, "the w1 W2 w2"), (2, None), (3, ""), (4, "absent"), (None, "w3 w4 w5"), (6, "the"), (7, " ".join(words))]
    assert ask(spark, docs, items) == brute(docs, items)
    assert ask(spark, docs, items, top=3) == brute(docs, items, 3)


def test_empty_tables(spark):
    assert ask(spark, [], [(1, "a")]) == [] == ask(spark, [(1, "a")], [])
    assert ask(spark, [(1, None), (2, "?")], [(1, "a")]) == []


def test_clashing_columns_and_bounds(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string").select("*", *[F.lit(9).alias(c) for c in ("item", "block", "score", "item_id", "owner")])
    items = spark.createDataFrame([(4, "b")], "item_id long, text string").select("*", *[F.lit(9).alias(c) for c in ("rank", "doc_id", "part", "copies")])
    assert [(r.item_id, r.rank, r.doc_id) for r in search(docs, items).orderBy("rank").collect()] == [(4, 1, 2), (4, 2, 1)]
    with pytest.raises(ValueError):
        search(docs, items, top=11)
