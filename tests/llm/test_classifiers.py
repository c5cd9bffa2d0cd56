import zlib

import numpy as np
import pytest

pytest.importorskip("ahocorasick")

from privloom.llm import quality_op, toxic_op  # noqa: E402

LABELS = "doc_id long, quality int, toxic int"
DOCS = "doc_id long, text string, score double, label int"


def test_quality_held_out(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = quality_op.op10_quality(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) > 0.95


def test_quality_edges(spark):
    good, bad = "The men went to the old house by the sea.\nIt was late, and they were tired.", "buy | now | cheap | x | y\n%%% $$$ &&& ### !!!"
    docs = [(i, good if i % 3 else bad, 0.0, 1) for i in range(60)] + [(100, None, 0.0, 1), (101, "", 0.0, 1), (102, " \n\t\n", 0.0, 1), (103, (good + "\n") * 3000, 0.0, 1), (103, (good + "\n") * 3000, 0.0, 1), (104, "x" * 300000, 0.0, 1)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(60)] + [(1, None, None), (None, 0, 0)]
    df, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    got = quality_op.classify(df, lab).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(docs)
    assert all(by[i].predicted == int(i % 3 > 0) for i in range(60)) and by[103].predicted == 1
    assert by[100].score == by[101].score == by[102].score == pytest.approx(2 / 3, abs=0.15)
    assert quality_op.classify(df.limit(0), lab).count() == 0
    assert {r.score for r in quality_op.classify(df, lab.filter("quality = 1")).collect()} == {1.0}


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    lengths, pair = np.array([3, 1, 5, 0, 4]), rng.normal(size=(2, 2))
    u = rng.normal(size=lengths.sum())
    good, moves = quality_op.forward_backward(u, lengths, pair)
    at, want_moves = 0, np.zeros((2, 2))
    for n in lengths:
        total, each, m = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n if n else 0):
            y = [code >> i & 1 for i in range(n)]
            w = np.exp(sum(u[at + i] * y[i] for i in range(n)) + sum(pair[a, b] for a, b in zip(y, y[1:])))
            total += w
            each += w * np.array(y)
            for a, b in zip(y, y[1:]):
                m[a, b] += w
        if n:
            assert np.allclose(good[at : at + n], each / total)
            want_moves += m / total
        at += n
    assert np.allclose(moves, want_moves)


def test_toxic_query(spark, sf_dir):
    rows = toxic_op.op5_toxicity(spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_toxic_learns_unknown_words(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdeioprst"), 6)) for _ in range(300)]
    docs, labels = [], []
    for i in range(600):
        text = " ".join(rng.choice(words, 40))
        toxic = int(i % 5 == 0)
        if toxic:
            text += " " + " ".join("zorgk" + rng.choice(list("abcde")) for _ in range(2))
        docs.append((i, text, 0.0, 1))
        labels.append((i, 1, toxic))
    odd = [(1000, None, 0.0, 1), (1001, "", 0.0, 1), (1002, "zorgka zorgkb " * 50000, 0.0, 1), (1002, "zorgka zorgkb " * 50000, 0.0, 1), (1003, "?!", 0.0, 1)]
    df, lab = spark.createDataFrame(docs + odd, DOCS), spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], LABELS)
    got = toxic_op.classify(df, lab).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 605
    held = [i for i in range(600) if by[i].held_out]
    assert np.mean([by[i].predicted == int(i % 5 == 0) for i in held]) > 0.98
    assert by[1002].predicted == 1 and by[1000].score == by[1001].score < 0.3 and by[1003].predicted == 0
    assert toxic_op.classify(df.limit(0), lab).count() == 0
    plain = {r.doc_id: r for r in toxic_op.classify(spark.createDataFrame([(1, "you idiot, you moron", 0.0, 1), (2, "fine", 0.0, 1)], DOCS), lab.limit(0)).collect()}
    assert plain[1].score > plain[2].score


def test_whole_words_and_stems():
    v = toxic_op.Voters(["loser", "abc*"])
    n = v.counts(["Loser losers closer", "abcd xabc abc", None, "x!!! ###"])
    assert n[0, 0] == 1 and n[1, 1] == 2 and n[2].sum() == 0


def test_quality_learns_from_long_documents(spark):
    good = [(i, "\n".join(f"The people of town {i} walked to the river and sat there, talking for {j} hours." for j in range(5)), 0.0, 1) for i in range(30)]
    bad = [(i, "\n".join(f"$$ >> {j} || ## {i}" for j in range(1200)), 0.0, 1) for i in range(30, 60)]
    labels = spark.createDataFrame([(i, int(i < 30), 0) for i in range(60)], LABELS)
    field = quality_op.fit(spark.createDataFrame(good + bad, DOCS), labels)
    assert field is not None
    score = field.score([good[0][1], bad[0][1]])
    assert score[0] > 0.7 and score[1] < 0.3


def test_long_documents_teach(spark):
    """Documents of more lines than a model's bound, the bad ones junk throughout."""
    from privloom.llm import quality_op

    rows = [(i, "\n".join([f"The report of day {j} was read and filed in the {i}th room." for j in range(8)]), 1) for i in range(30)]
    rows += [(100 + i, "\n".join([f"{j}|{i}|##|{j * 7}|==" for j in range(1500)]), 0) for i in range(30)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, q) for d, _, q in rows], "doc_id long, quality int")
    got = {r.doc_id: r.predicted for r in quality_op.classify(docs, labels).collect()}
    assert all(got[d] == q for d, _, q in rows)


def test_label_model_on_few_voters():
    """Expectation maximisation against the same steps written out row by row."""
    import math

    import numpy as np

    from privloom.llm.toxic_op import LabelModel

    rng = np.random.default_rng(4)
    truth = rng.random(400) < 0.3
    votes = np.column_stack([np.where(truth, rng.random(400) < a, rng.random(400) < b) for a, b in ((0.8, 0.05), (0.7, 0.1), (0.6, 0.02))]).astype(float)
    start = np.where(votes.any(1), 0.9, 0.02)
    model = LabelModel.fit(votes, 0.3, start, ~truth)
    post = start.tolist()
    for _ in range(50):
        one, zero = sum(post), sum(1 - p for p in post)
        yes = [(sum(p * v[j] for p, v in zip(post, votes)) + 0.05) / (one + 1) for j in range(3)]
        no = [max((sum((1 - p) * v[j] for p, v in zip(post, votes)) + 4) / (zero + 4), (votes[~truth, j].sum() + 4) / ((~truth).sum() + 4)) for j in range(3)]
        new = [1 / (1 + math.exp(-(math.log(0.3 / 0.7) + sum(v[j] * math.log(yes[j] / no[j]) for j in range(3))))) for v in votes]
        done = max(abs(a - b) for a, b in zip(new, post)) < 1e-4
        post = new
        if done:
            break
    assert np.allclose(model.posterior(votes), post, atol=1e-6) and (model.weight == 1).all()
    assert np.mean((model.posterior(votes) > 0.5) == truth) > 0.85
    twice = LabelModel.fit(np.column_stack([votes, votes[:, 0]]), 0.3, start)
    assert twice.weight[0] == twice.weight[3] and twice.weight[0] < 0.55
