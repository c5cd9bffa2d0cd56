"""Conversation repair against SQL, against all edits of short conversations, and the edge cases."""

import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import privloom.llm.repair_op as repair_op
from privloom.llm.repair_op import OP12_SQL, join_chunks, lightest, op12_conversation_repair, repair
from tests.llm.sql import compare, same_rows

SCHEMA = "conv_id long, turn long, role string, text string"


def test_against_sql(spark, sf_dir):
    same_rows(op12_conversation_repair(spark, sf_dir), OP12_SQL, sf_dir)


def mixed(seed, convs, longest):
    random.seed(seed)
    rows = []
    for conv in [None, *range(convs)]:
        for _ in range(random.randrange(1, longest)):
            turn = random.choice([None, *range(longest)])
            role = random.choice(["user", "assistant", "assistant", "system", "tool", "", None, "ursula"])
            text = random.choice(["Yes.", "no", "", "  \n", None, "What? ", "é!", "a.b", "x" * random.randrange(3), f"n{random.random()}."])
            rows.append((conv, turn, role, text))
            rows += [rows[-1]] * random.choice([0, 0, 0, 0, 1, 2])
    return rows


@pytest.mark.parametrize("chunk", [1, 3, 512])
def test_nulls_ties_repeats_and_long_conversations_against_sql(spark, monkeypatch, chunk):
    monkeypatch.setattr(repair_op, "CHUNK", chunk)
    rows = mixed(chunk, 40, 12)
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    compare(repair(df), con, OP12_SQL)


def every_edit(rows):
    """Least (cost, audit) over all sequences of edits with up to three insertions at a place."""
    best = None
    inserts = [""] + ["".join(p) for n in (1, 2, 3) for p in itertools.product("ua", repeat=n)]
    edits = [[("D", "")] if fault in "bd" else [("D", ""), ("K", initial), ("R", "u"), ("R", "a")] for initial, fault in rows]
    for chosen in itertools.product(*edits):
        for put in itertools.product(inserts, repeat=len(rows) + 1):
            roles = put[0] + "".join(r + p for (_, r), p in zip(chosen, put[1:], strict=True))
            if re.fullmatch("(s?(ua)+)?", roles) and len(roles) == sum(len(p) for p in put) + sum(e != "D" for e, _ in chosen):
                cost = sum({"D": 3, "K": 0, "R": 2}[e] + (e != "D" and fault == "t") for (e, _), (_, fault) in zip(chosen, rows, strict=True)) + 2 * sum(map(len, put))
                audit = "I" * len(put[0]) + "".join(e + "I" * len(p) for (e, _), p in zip(chosen, put[1:], strict=True))
                best = min(best or (cost, audit), (cost, audit))
    return best


@pytest.mark.parametrize("rows", [r for n in (0, 1, 2) for r in itertools.product(itertools.product(("s", "u", "a", "t", ""), "bft"), repeat=n)][::3])
def test_agenda_finds_the_least_of_all_edits(rows):
    ((state, got),) = lightest([(*r, 1) for r in rows], 0).items()
    assert state in (0, 3) and got == every_edit(rows)


def test_chunks_join_to_the_whole():
    random.seed(5)
    for _ in range(60):
        rows = [(random.choice("suat"), random.choice("bdtff"), random.choice((1, 1, 3))) for _ in range(random.randrange(1, 14))]
        cuts = sorted(random.sample(range(len(rows) + 1), min(3, len(rows))))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        weights = [{(a, b): w for a in range(4) for b, w in lightest(p, a, None).items()} for p in parts]
        cost, states = join_chunks(weights)
        assert (cost, "".join(w[s][1] for w, s in zip(weights, states, strict=True))) == next(iter(lightest(rows, 0).values()))


def test_all_rows_dropped_and_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair(empty).collect() == []
    ids = spark.range(4000).select(F.col("id").alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("Hi.").alias("text"))
    got = repair(ids)
    dropped = got.filter(F.crc32(F.concat("conv_id", F.lit(":1")).cast("binary")) % 20 == 0).collect()
    assert got.count() == 4000 and len(dropped) > 100
    assert {tuple(r)[1:] for r in dropped} == {(0, 0, 0, 0, 0, 0, "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")}


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, 1, "user", "Hi."), (1, 2, "assistant", "Yes.")], SCHEMA)
    more = df.select("*", *[F.lit("9").alias(c) for c in ("copies", "hit", "cost", "audit", "of", "fault", "digest", "first")])
    assert repair(more).collect() == repair(df).collect()
