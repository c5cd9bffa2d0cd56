import hashlib
import random
import re

import pytest

xxhash = pytest.importorskip("xxhash")

from privloom.llm import omh_op  # noqa: E402


def spark_hash(*values):
    """XXH64 of longs in turn, the seed of each being the hash so far."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True) if isinstance(v, int) else v.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute_part(tokens, k, bins=64):
    """Draws from a circle of occurrence-numbered k-mers: the two next from each place, in text order."""
    if not tokens:
        return "-" * 8 * bins
    mask = (1 << 29) - 1
    clear = ~mask & (2**63 - 1)
    seen, circle = {}, []
    for i in range(max(len(tokens) - k + 1, 1)):
        h = (spark_hash(*tokens[i : i + k]) & clear) >> 29
        o = seen[h] = seen.get(h, -1) + 1
        # occurrence is an int for the engine, hashed as four bytes
        mixed = xxhash.xxh64_intdigest(o.to_bytes(4, "little"), spark_hash(h) % (1 << 64))
        circle.append((mixed & clear) | i)
    circle.sort()
    out = []
    for b in range(bins):
        at = next((j for j, x in enumerate(circle) if x >> 57 >= b), 0)
        pair = sorted({at, (at + 1) % len(circle)}, key=lambda j: circle[j] & mask)
        out.append(f"{spark_hash(*[circle[j] >> 29 for j in pair]) % (1 << 64):016x}"[:8])
    return "".join(out)


def brute(text):
    text = text or ""
    out = brute_part(re.findall(r"[^ \t\n\x0b\f\r]{1,8}", text, re.S), 2)
    return out + brute_part(list(re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ")), 3) if len(text) <= 400 else out


def like(a, b):
    if a == b:
        return 1.0
    part = slice(512, 1024) if len(a) > 512 and len(b) > 512 else slice(0, 512)
    pa, pb = [[x[part][i : i + 8] for i in range(0, 512, 8)] for x in (a, b)]
    return sum(x == y and "-" not in x for x, y in zip(pa, pb)) / 64


def check(got, docs):
    """docs in the order of the ids."""
    prints = {t: brute(t) for _, t in docs}
    assert len(got) == len(docs)
    rows = {r.doc_id: r for r in got}
    for i, (d, t) in enumerate(docs):
        nxt = docs[(i + 1) % len(docs)][1] or ""
        text = t or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        r = rows[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest()), d
        assert r.fingerprint == prints[t] and r.edited_fingerprint == brute(edited)
        assert r.near_edited == pytest.approx(like(r.fingerprint, r.edited_fingerprint)) and r.near_next == pytest.approx(like(r.fingerprint, prints[docs[(i + 1) % len(docs)][1]]))


def test_query(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = omh_op.op2_order_minhash(spark, sf_dir).collect()
    check(got, docs)
    text = dict(docs)
    # a next text that is this one or shares its half is no edit's rival
    apart = [r for i, r in enumerate(sorted(got, key=lambda r: r.doc_id)) if r.near_next < 0.2 and len((text[r.doc_id] or "").split()) > 3]
    assert len(apart) > 0.9 * len(got)
    assert sum(r.near_edited > r.near_next for r in apart) >= 0.995 * len(apart)


def test_edges_across_groups(spark):
    docs = [(-5, None), (1, ""), (4, "one"), (7, "a b c d"), (9, " \n\t "), (11, "x y " * 30000), (30, "é🙂 ß" * 40), (31, "same words here"), (32, "same words here"), (77, "z" * 5000), (1000, "the end of it all")]
    df = spark.createDataFrame([(*d, "q", 1) for d in docs], "doc_id long, text string, fingerprint string, part int")
    check(omh_op.fingerprint_edits(df).collect(), docs)
    assert omh_op.fingerprint_edits(df.limit(0)).count() == 0
    one = omh_op.fingerprint_edits(df.filter("doc_id = 7")).collect()
    assert one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"a b a b"[:7].replace(b"a b a b", b"a b aa b")[:0] + ("a b c d"[:4] + "a b").encode()).hexdigest()
    assert omh_op.fingerprint_edits(df.union(df)).count() == 22


def test_order_matters(spark):
    words = [f"word{i}" for i in range(60)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[30:] + words[:30])), (3, " ".join(words[::-1]))], "doc_id long, text string")
    near = {r.doc_id: r.near_next for r in omh_op.fingerprint_edits(df).collect()}
    assert near[1] < 1 and near[2] < near[1]


@pytest.mark.parametrize("n", [15, 30, 60, 120])
def test_order_counts_in_short_texts(spark, n):
    rng = random.Random(n)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(n)]
    rows = [(i, " ".join(x)) for i, x in enumerate([words, words[n // 2 :] + words[: n // 2], words[::-1]])]
    near = {r.doc_id: r.near_next for r in omh_op.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 0.2 < near[0] < 0.75


def test_repeated_and_missing_ids(spark):
    """A third of the rows without an id, a third with one id: both are cut by their texts' hashes, and each row meets the next."""
    rows = [(None, f"text {i} of none") for i in range(60)] + [(5, f"text {i} of five") for i in range(60)] + [(100 + i, f"text {i} alone") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    parts = omh_op.with_next(df).filter("not guest").groupBy("part", "sub").count().collect()
    assert max(r["count"] for r in parts) < 40
    got = omh_op.fingerprint_edits(df).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, spark_hash(r[1])))
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 2] + order[(i + 1) % 180][1][: len(t) // 2]).encode()).hexdigest() for i, (_, t) in enumerate(order))
    assert sorted(r.edited_sha256 for r in got) == want
