import zlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

from privloom.llm import pack_op  # noqa: E402


def check(rows, docs, sequence=2048):
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {}
    for d, text in docs:
        want.setdefault(d, []).append(t.encode(text or "", add_special_tokens=False).ids + [1])
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(want)
    for d, found in by_doc.items():
        ids = want[d][0]
        copies = len(want[d])
        assert sum(r.length for r in found) == copies * len(ids)
        for r in found:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    tokens = padded = 0
    for found in by_seq.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= sequence and {r.sequence_tokens for r in found} == {at}
        tokens, padded = tokens + at, padded + found[0].padded_to
    assert sorted(by_seq) == list(range(len(by_seq)))
    return tokens / max(padded, 1)


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert check(pack_op.op4_packing(spark, sf_dir).collect(), docs) > 0.97


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "word and " * 9000), (5, "<|endoftext|> x"), (6, "  double  spaces \n")] + [(10 + i, "same text") for i in range(40)]
    df = spark.createDataFrame([(*d, 5, 6) for d in docs], "doc_id long, text string, length int, rank int")
    check(pack_op.pack(df).collect(), docs)
    assert pack_op.pack(df.limit(0)).count() == 0


def test_packer_places_everything():
    for histogram in ({5: 1000}, {2048: 3, 2000: 10, 1: 7}, {100: 5000, 1500: 100}, {}, {i: i % 7 for i in range(1, 2049) if i % 7}):
        patterns = pack_op.shortest_pack_first(histogram)
        got = {}
        for pattern, count in patterns:
            assert sum(a * b for a, b in pattern) <= 2048
            for length, copies in pattern:
                got[length] = got.get(length, 0) + copies * count
        assert got == histogram
