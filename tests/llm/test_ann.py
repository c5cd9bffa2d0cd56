import numpy as np
import pytest

from privloom.llm import ann_op


def brute(rows, k=20, every=20):
    ok = [(i, np.array(x, float)) for i, x in rows if x is not None and all(v is not None and np.isfinite(v) for v in x) and any(x)]
    if not ok:
        return {}
    size = max(sorted({len(x) for _, x in ok}), key=lambda n: sum(len(x) == n for _, x in ok))
    ok = list({(i, tuple(x)): (i, x) for i, x in ok if len(x) == size}.values())
    out = {}
    for q, x in ok:
        if q % every == 0:
            out[q] = sorted(((-float((y * x).sum()), i) for i, y in ok if i != q))[:k]
    return out


def recall(got, want):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    hit = n = 0
    for q, top in want.items():
        found = sorted(by.get(q, []), key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, len(top) + 1))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hit += len({r.vec_id for r in found} & {i for _, i in top})
        n += len(top)
    assert set(by) <= set(want)
    return hit / max(n, 1)


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = ann_op.op1_ann(spark, sf_dir).collect()
    assert recall(got, brute(rows)) >= 0.9
    vec = {i: np.array(x, float) for i, x in rows}
    assert all(r.score == (vec[r.query_id] * vec[r.vec_id]).sum() for r in got)


def test_many_blocks_lengths_and_copies(spark, monkeypatch):
    monkeypatch.setattr(ann_op, "BLOCK", 40)
    monkeypatch.setattr(ann_op, "QUERIES", 10)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 12)) * rng.uniform(0.2, 3, size=(900, 1))
    x[100:400] = x[100]  # a third are copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = ann_op.nearest(spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, cell int, block int")).collect()
    assert recall(got, brute(rows)) >= 0.9
    copies = [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 100]
    want = [i for _, i in brute(rows)[100]]
    assert len(set(copies) & set(want)) >= 18


def test_share_verified_and_recall():
    """Of unclustered unit vectors, the hardest case: less than a fifth is compared in full, and recall holds."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(8000, 64))
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    block = ann_op.Block(ann_op.new_space(64, float((x**2).sum(1).max()) * (1 + 1e-9)), np.arange(len(x)), x)
    q = x[::80]
    found = block.search(np.arange(0, len(x), 80), q, np.full(len(q), np.inf), 20)
    score = q @ x.T
    score[np.arange(len(q)), np.arange(0, len(x), 80)] = -np.inf
    want = np.argsort(-score, axis=1)[:, :20]
    assert np.mean([len(set(a.tolist()) & set(b.tolist())) / 20 for a, b in zip(found.rows, want)]) >= 0.9
    assert found.verified < 0.2 * len(q) * len(x)


def test_lengths_meet_their_own(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (20, [1.0, 2.0, 3.0]), (3, [0.0, 0.0, 1.0]), (40, [2.0])]
    got = ann_op.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 1, 1.0), (20, 1, 3, 3.0)]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]), (100, [inf, 1.0]), (120, [None, 1.0]), (140, []), (160, [1.0, 2.0, 3.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann_op.nearest(df).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (0, 4, 3, -1.0), (20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 0, 0.0), (20, 4, 3, 0.0)]
    assert ann_op.nearest(df.limit(0)).count() == 0
    assert ann_op.nearest(df.filter("vec_id = 0")).count() == 0


def test_chi_square():
    assert ann_op.chi_square_quantile(0.95, 1) == pytest.approx(3.841459, abs=1e-5)
    assert ann_op.chi_square_quantile(0.95, 10) == pytest.approx(18.307038, abs=1e-5)
