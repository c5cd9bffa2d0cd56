import random

import numpy as np
import pytest

xxhash = pytest.importorskip("xxhash")

from privloom.llm import simhash_op  # noqa: E402


def brute_fp(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode()
    import re

    words = re.findall(rb"[^\x20\x09-\x0D]+", words)
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [brute_fp(t) for _, t in rows]
    comp = {i: i for i in range(len(rows))}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    lowest = {}
    for i, (d, _) in enumerate(rows):
        lowest[find(i)] = min(lowest.get(find(i), d), d)
    return sorted((d, f"{fps[i]:016x}", lowest[find(i)]) for i, (d, _) in enumerate(rows))


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in simhash_op.op9_simhash(spark, sf_dir).collect()) == brute(rows)


def test_edge_rows(spark):
    rows = [(9, None), (4, ""), (4, ""), (7, " \n\t"), (1, "one"), (2, "One"), (3, "a b"), (5, "x y z " * 30000), (6, "x y z " * 30000 + "q")]
    df = spark.createDataFrame([(*r, "k", 0) for r in rows], "doc_id long, text string, key string, fp int")
    assert sorted(tuple(r) for r in simhash_op.near_duplicates(df).collect()) == brute(rows)
    assert simhash_op.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [8, 1024])
def test_links_of_a_ball(spark, block):
    rng = random.Random(5)
    centre = [rng.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centre for _ in range(25)}
    fps = sorted(fps | {rng.getrandbits(64) for _ in range(100)})
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    found = simhash_op.links(spark.createDataFrame(signed, "fp long"), block=block)
    got = {r.id: r.component for r in simhash_op.components(found).collect()}
    comp = {f: f for (f,) in signed}
    for _ in range(len(fps)):
        before = dict(comp)
        for (a,), x in zip(signed, fps):
            for (b,), y in zip(signed, fps):
                if (x ^ y).bit_count() <= 3:
                    comp[a] = comp[b] = min(comp[a], comp[b])
        if before == comp:
            break
    assert {f: got.get(f, f) for (f,) in signed} == comp
