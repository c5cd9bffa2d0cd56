import pytest

pytest.importorskip("tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from privloom.llm import line_op, simhash_op  # noqa: E402
from tests.llm.test_lines import brute as brute_lines  # noqa: E402
from tests.llm.test_packing import check as check_packing  # noqa: E402
from tests.llm.test_simhash import brute as brute_simhash  # noqa: E402


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()) if name != "quality" else None
        out = corpus_pipeline.durable(stage(spark, docs, sf_dir), "test")
        if name != "packing":
            assert out.columns == docs.columns and out.schema == docs.schema or name == "line_dedup" and out.columns == docs.columns
            kept[name] = {r.doc_id: r.text for r in out.collect()}
        if name == "quality":
            gone = {r.doc_id for r in docs.collect()} - set(kept[name])
            marked = [labels[d] for d in gone if d in labels]
            assert gone and sum(marked) <= 0.1 * len(marked)
            assert sum(labels[d] == 0 for d in kept[name] if d in labels) <= 2
        if name == "language":
            assert len(kept[name]) >= 0.97 * len(kept["quality"])
        if name == "line_dedup":
            want = brute_lines(before)
            assert set(want) == set(kept[name]) and sum(want[d] != kept[name][d] for d in want) <= 0.01 * len(want)
        if name == "simhash":
            assert sorted(kept[name]) == sorted(d for d, _, c in brute_simhash(before) if d == c)
        if name == "packing":
            assert check_packing(out.collect(), before) > 0.9
        docs = out


def test_one_of_each_with_repeats(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (3, "something else entirely here now"), (3, "something else entirely here now"), (None, "a b c d e")]
    df = spark.createDataFrame([(*r, "f", 1) for r in rows], "doc_id long, text string, fp string, count int")
    got = sorted((r.doc_id or -1, r.text) for r in simhash_op.one_of_each(df).collect())
    assert got == [(-1, "a b c d e"), (1, "a b c d e"), (3, "something else entirely here now")]
    assert line_op.dedup_lines(df).count() == 6
