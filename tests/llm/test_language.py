import zlib

import numpy as np

from privloom.llm import lang_op


def test_held_out_accuracy(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = lang_op.op6_language_id(spark, d).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97


def test_edges(spark):
    teach = [(i, "the cat sat on the mat with the hat", "en", 1) for i in range(20)] + [(i, "der hund und die katze sind nicht hier", "de", 1) for i in range(20, 40)]
    odd = [(100, None, "en", 1), (101, "", None, 1), (102, "123 %% \n", "de", 1), (103, "der hund " * 100000, None, 1), (103, "der hund " * 100000, None, 1), (104, "hund", "de", 1), (105, "猫", "zz", 1)]
    df = spark.createDataFrame(teach + odd, "doc_id long, text string, lang string, n int")
    got = lang_op.identify(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 47
    assert {by[i].lang_pred for i in (100, 101, 102)} == {"und"} and by[103].lang_pred == "de" and by[1].lang_pred == "en"
    assert lang_op.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in lang_op.identify(df.withColumn("lang", df.lang.substr(9, 9))).collect()} <= {"und", ""}


def test_filters_have_no_false_negatives():
    rng = np.random.default_rng(1)
    grams = {name: rng.integers(0, 2**63, 5000).astype(np.uint64) for name in "abc"}
    f = lang_op.LanguageFilters.build(grams)
    for bit, name in enumerate("abc"):
        found = np.bitwise_and.reduce([f.masks[lang_op.slots_of(grams[name], i, len(f.masks))] for i in range(lang_op.HASHES)])
        assert (found >> np.uint64(bit) & np.uint64(1)).all()
    assert (f.wrong < 0.001).all()
    assert "".join(p.text for p in lang_op.blocks("ab " * 400_000)) == "ab " * 400_000


def test_blocks_give_the_grams_of_the_whole():
    rng = np.random.default_rng(3)
    for _ in range(300):
        text = "".join(rng.choice(list("abcdé  .-1İΣ"), rng.integers(0, 60)))
        whole = np.sort(lang_op.grams([text])[1])
        for size in (5, 8, 13, 40):
            parts = list(lang_op.blocks(text, size))
            assert (np.sort(np.concatenate([lang_op.grams([p])[1] for p in parts] or [np.zeros(0, np.uint64)])) == whole).all(), (text, size)
            assert not parts or (np.sort(lang_op.grams(parts)[1]) == whole).all()


def test_counts_against_exact_sets():
    """Never fewer than the exact counts, and after the correction about as many; more languages than a word has bits."""
    rng = np.random.default_rng(2)
    names = [f"l{i:03d}" for i in range(150)]
    words = {n: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(30)] for n in names}
    sets = {n: np.unique(lang_op.grams([" ".join(w)])[1]) for n, w in words.items()}
    f = lang_op.LanguageFilters.build(sets, 1 << 12)
    texts = [" ".join(words[names[i]][:10] + words[names[i + 1]][:5]) for i in range(0, 140, 7)]
    n, hits = f.counts(texts)
    for i, text in enumerate(texts):
        h = lang_op.grams([text])[1]
        exact = np.array([np.isin(h, sets[name]).sum() for name in names])
        assert n[i] == len(h) and (hits[i] >= exact).all()
        assert np.abs(np.clip((hits[i] / n[i] - f.wrong) / (1 - f.wrong), 0, 1) - exact / n[i]).max() < 0.15
    assert f.predict([" ".join(words["l149"])])[0] == ["l149"]


def test_many_languages_are_learned(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(70):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(20)]
        rows += [(len(rows) + j, " ".join(rng.choice(words, 30)), f"l{i:02d}") for j in range(6)]
    got = {r.doc_id: r for r in lang_op.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert np.mean([got[d].lang_pred == lang for d, _, lang in rows]) > 0.95
