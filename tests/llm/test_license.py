"""License scans against a plain search of every place, and the edge cases."""

import re

import pytest
from pyspark.sql import functions as F

from privloom.llm.license_op import BASE, COVER, NOTICES, OP13_SQL, default_templates, op13_license_scan, scan_licenses, template
from tests.llm.sql import same_rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_against_sql(spark, sf_dir):
    same_rows(op13_license_scan(spark, sf_dir), OP13_SQL, sf_dir)


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_phrases_against_a_search_of_every_place(spark):
    texts = [
        "MIT License, mit license", "mit-license\nApache (License)", "the general public license of general public license", "mit licenses", "MIT", "", None,
        "Mit lİcense", "apache Kicense license mit license", "x" * 5000 + " mit license", "mit license " * 300, "é mit license",
    ]
    got = {r.doc_id: r for r in scan_licenses(frame(spark, list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        words = plain_words(text)
        want = sorted((p, label) for phrase, label in BASE for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split())
        assert got[i].n_words == len(words)
        assert [(s.start, s.label) for s in got[i].spans if s.base] == want


@pytest.mark.parametrize("label,text", NOTICES)
def test_notices_survive_edits(spark, label, text):
    words = text.split()
    cut = words[: len(words) // 2] + ["some", "words", "more"] + words[len(words) // 2 + 2 :]
    rows = [(1, "before this " + text.upper() + " and after"), (2, " ".join(cut)), (3, " ".join(words[: len(words) // 3])), (4, " ".join(reversed(words)))]
    notices = {i for i, t in enumerate(default_templates()) if t.notice}
    got = {r.doc_id: {s.label: s for s in r.spans if s.template in notices} for r in scan_licenses(frame(spark, rows)).collect()}
    assert got[1][label].start == 2 and got[1][label].coverage == 1
    assert label not in got[4]
    if len(words) > 25:
        assert got[2][label].coverage >= COVER
    assert not got[3]


def test_two_copies_of_a_notice_are_two_spans_however_many_hits_lie_between(spark):
    text = NOTICES[4][1]
    between = "permission to use copy x " * 40
    spans = scan_licenses(frame(spark, [(1, f"{text} {between} {text}")])).first().spans
    whole = [s for s in spans if s.label == "isc" and s.coverage == 1]
    n = len(default_templates()[[t.label for t in default_templates()].index("isc", 10)].words)
    assert [s.start for s in whole] == [0, n + 200]


def test_repeated_rows_nulls_and_clashing_columns(spark):
    rows = [(None, "mit license", 1), (None, "mit license", 2), (7, None, 3), (7, None, 4), (7, "Apache License", 5), (None, "x", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, template long").withColumn("label", F.lit("y")).withColumn("h", F.lit("y")).withColumn("k", F.lit("y"))
    got = sorted((r.doc_id is not None, r.n_words, len(r.spans)) for r in scan_licenses(df).collect())
    assert got == [(False, 1, 0), (False, 2, 1), (False, 2, 1), (True, 0, 0), (True, 0, 0), (True, 2, 1)]


def test_no_rows(spark):
    assert scan_licenses(frame(spark, [])).collect() == []


def test_own_templates(spark):
    own = [template("own", "all rights reserved")]
    got = scan_licenses(frame(spark, [(1, "All rights reserved. MIT license")]), own).first()
    assert [(s.start, s.label) for s in got.spans] == [(0, "own")]
    with pytest.raises(ValueError):
        template("short", "one")


def test_no_python_in_the_plan(spark, sf_dir):
    plan = op13_license_scan(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
