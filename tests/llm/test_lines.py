import random

import pytest

pytest.importorskip("xxhash")

from privloom.llm import line_op  # noqa: E402


def sets(line):
    line = line_op.normal(line).ljust(6, "\0")
    return {line[i : i + 6] for i in range(len(line) - 5)}


def brute(docs, similar=0.8):
    """Kept texts of documents in the order of their ids."""
    lines = [(d, i, x) for d, t in docs for i, x in enumerate((t or "").split("\n")) if x.strip()]
    distinct = sorted({line_op.normal(x) for _, _, x in lines})
    each, comp = [sets(x) for x in distinct], list(range(len(distinct)))

    def find(i):
        while comp[i] != i:
            comp[i] = comp[comp[i]]
            i = comp[i]
        return i

    for i, a in enumerate(each):
        for j in range(i):
            b = each[j]
            if min(len(a), len(b)) >= similar * max(len(a), len(b)) and len(a & b) >= similar * len(a | b) - 1e-9:
                comp[find(i)] = find(j)
    of, seen, gone = {x: find(i) for i, x in enumerate(distinct)}, set(), set()
    for d, i, x in lines:
        c = of[line_op.normal(x)]
        if c in seen:
            gone.add((d, i))
        seen.add(c)
    return {d: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in docs}


def test_query_against_brute_force(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r.doc_id: r.text for r in line_op.op8_line_dedup(spark, sf_dir).collect()}
    want = brute(docs)
    wrong = [d for d in want if got[d] != want[d]]
    assert len(wrong) <= 0.01 * len(want) and len(got) == len(docs)


@pytest.mark.parametrize("block", [8, 512])
def test_families_of_near_lines(spark, block, monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    base = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(12)]
    docs = []
    for d in range(60):
        lines = []
        for b in rng.sample(base, 3):
            w = b.split()
            w[rng.randrange(40)] = rng.choice(words)
            lines.append(" ".join(w).upper() if rng.random() < 0.2 else "  ".join(w))
        docs.append((d, "\n".join(lines + [" ".join(rng.choice(words) for _ in range(12)), "", "ok"])))
    monkeypatch.setattr(line_op, "SMALL", 0)
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, lhash int")
    monkeypatch.setattr(line_op, "line_components", lambda x, y, f=line_op.line_components: f(x, y, block))
    got = {r.doc_id: r.text for r in line_op.dedup_lines(df).collect()}
    assert got == brute(docs)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, "\n\n"), (4, "Hello there\nhello  THERE\nhi"), (5, "hello there"), (6, "x" * 1_200_000 + "\nab"), (7, "x" * 1_200_001 + "\nAB"), (8, "hi\n \nnew one")]
    df = spark.createDataFrame([(*x, "r", x[0]) for x in docs], "doc_id long, text string, removed string, th long")
    out = line_op.dedup_lines(df)
    got = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == df.columns and got == brute(docs)
    assert got[5] == "" and got[7] == "" and got[8] == " \nnew one"
    twice = line_op.dedup_lines(df.union(df)).collect()
    assert len(twice) == 16 and {(r.doc_id, r.text) for r in twice} == set(got.items())
    assert line_op.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("pairs", [1_000, 4_000])
def test_one_template_for_very_many_lines(spark, pairs):
    """All lines share their large keys; those are similar that share the first four digits, and no others."""
    rng = random.Random(pairs)
    stem = "this is the usual form of a report about something in the archive and its number is "
    assert 82 <= len(stem) <= 86
    digits = [str(rng.randrange(10**14)).zfill(14) for _ in range(pairs)]
    digits += [d[:4] + str(rng.randrange(10**10)).zfill(10) for d in digits]
    like = line_op.shingle_sets([stem + d for d in ("12345678901234", "12340987654321", "12300987654321")])
    jaccard = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    assert jaccard(like[0], like[1]) >= 0.8 > jaccard(like[0], like[2])
    rng.shuffle(digits)
    df = spark.createDataFrame([(i, stem + d) for i, d in enumerate(digits)], "doc_id long, text string")
    seen, want = set(), 0
    for d in digits:
        want += d[:4] in seen
        seen.add(d[:4])
    removed = sum(r.n_removed for r in line_op.repeated_lines(df).collect())
    assert want * 0.99 <= removed <= want * 1.01  # a few share more by chance


@pytest.mark.parametrize("common", [1, 10_000])
def test_a_second_look_finds_all_links_between_components(spark, monkeypatch, common):
    """Lines of one family near the threshold; ``common`` moves all of them to counts over shingles, or none."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 8))) for _ in range(300)]
    base, lines = [rng.choice(words) for _ in range(30)], []
    for _ in range(150):
        w = list(base)
        for i in rng.sample(range(30), rng.randint(1, 6)):
            w[i] = rng.choice(words)
        lines.append(" ".join(w))
    monkeypatch.setattr(line_op, "COMMON", 150 if common == 1 else 1)
    monkeypatch.setattr(line_op, "TILE", 32)
    hashes, each = [line_op.line_hash(x) for x in lines], [sets(x) for x in lines]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    alone = df([], "id long, component long")
    links = line_op.rare_links(df([(1, h) for h in hashes], "key long, lhash long"), df(list(zip(hashes, lines)), "lhash long, line string"), alone, 4)
    comp = {h: h for h in hashes}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for r in links.collect():
        comp[find(r.a)] = find(r.b)
    got = {frozenset(h for h in hashes if find(h) == find(x)) for x in hashes}
    comp = {h: h for h in hashes}
    for i, a in enumerate(each):
        for j in range(i):
            if len(a & each[j]) >= 0.8 * len(a | each[j]) - 1e-9:
                comp[find(hashes[i])] = find(hashes[j])
    assert got == {frozenset(h for h in hashes if find(h) == find(x)) for x in hashes}
    assert 1 < len(got) < 150


@pytest.mark.parametrize("wide", [1 << 16, 5])
def test_keys_meet_in_buckets_many_in_a_row(monkeypatch, wide):
    """Keys of one line alone go, keys of the same lines are one, and keys of very many lines leave a bucket in pieces but whole."""
    pa = pytest.importorskip("pyarrow")
    rng = random.Random(9)
    lines = [(h, [rng.choice([rng.getrandbits(62), rng.randrange(40) << 57, 7 << 58]) for _ in range(line_op.BANDS)]) for h in range(-60, 400)]
    lines += lines[:50]  # repeats from another task
    batch = pa.RecordBatch.from_arrays([pa.array([h for h, _ in lines], pa.int64()), pa.array([k for _, k in lines], pa.list_(pa.int64()))], ["lhash", "keys"])
    monkeypatch.setattr(line_op, "SENT", 1_000)
    monkeypatch.setattr(line_op, "WIDE", wide)
    monkeypatch.setattr(line_op, "HELD", 300)
    dealt = list(line_op._deal(3)(iter(batch.slice(i, 20) for i in range(0, len(lines), 20))))
    assert sum(b.num_rows for b in dealt) <= 3 * len(dealt) <= 30
    rows = sorted((x for b in dealt for x in zip(*(c.to_pylist() for c in b.columns))), key=lambda x: x[0])
    dealt = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "pairs"])
    got, numbers = {}, {}
    for b in line_op._meet(iter([dealt])):
        for key, h, lo, n in zip(*(c.to_pylist() for c in b.columns)):
            got.setdefault(key, set()).add(h)
            numbers.setdefault(key, set()).add((n, None if n is None else lo))
    want = {}
    for h, keys in lines:
        for k in keys:
            want.setdefault(k, set()).add(h)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, {frozenset(x) for x in want.values() if len(x) > 1}))
    for key, x in got.items():
        assert numbers[key] in ({(len(x), min(x))}, {(None, None)})
    assert ({(None, None)} in numbers.values()) == (wide == 5)


@pytest.mark.parametrize("known", [False, True])
def test_links_join_what_pairs_join(monkeypatch, known):
    rng = random.Random(3)
    monkeypatch.setattr(line_op, "COLUMNS", 50)
    base = "".join(rng.choice("abcdef ") for _ in range(150))
    lines = list({"".join(c if rng.random() > 0.012 * (i % 4) else rng.choice("xyz") for c in base) for i in range(60)})
    each, comp = [sets(x) for x in lines], [i % 20 if known else i for i in range(len(lines))]
    links = line_op.links_of(list(range(len(lines))), line_op.shingle_sets(lines), known=list(comp) if known else None)
    first, second = list(comp), list(comp)
    join = lambda c, i, j: [c[i] if x == c[j] else x for x in c]
    for i, j in links:
        assert first[i] != first[j]
        first = join(first, i, j)
    for i, a in enumerate(each):
        for j in range(i):
            if len(a & each[j]) >= 0.8 * len(a | each[j]) - 1e-9:
                second = join(second, i, j)
    groups = lambda c: {frozenset(i for i, x in enumerate(c) if x == y) for y in c}
    assert groups(first) == groups(second) and len(set(first)) < len(set(comp))


@pytest.mark.parametrize("most", [4_096, 64])
def test_parities_miss_no_similar_pair(monkeypatch, most):
    """Sets of all sizes, with bitmaps of one width or of several; of those that can't be told apart a few stay."""
    monkeypatch.setattr(line_op, "MOST_PARITIES", most)
    rng, near, left, far = random.Random(4), 0, 0, 0
    for _ in range(2_000):
        n = rng.choice([1, 2, 5, 30, 62, 100, 200, 500])
        a = [rng.getrandbits(64) for _ in range(n)]
        b = a[: n - rng.randint(0, max(1, n // 3))] + [rng.getrandbits(64) for _ in range(rng.randint(0, max(1, n // 3)))]
        pair = [line_op.np.array(sorted(x or [0]), line_op.np.uint64) for x in rng.sample([a, b], 2)]
        found = line_op.may_link([len(x) for x in pair], line_op.parities(pair))
        x, y = map(set, (a, b or [0]))
        assert found[0] == found[1]
        if len(x & y) >= 0.8 * len(x | y) - 1e-9:
            near += 1
            assert found[0]
        elif len(x & y) <= 0.7 * len(x | y):
            far += 1
            left += found[0]
    assert near > 300 and far > 300 and left <= (0.1 if most == 4_096 else 0.9) * far


def test_texts_of_chance_candidates_stay_where_they_are(spark, monkeypatch):
    """Lines that share a key but can't be similar meet by bitmaps alone."""
    rng = random.Random(5)
    letter = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz ")
    lines, near = [], set()
    for i in range(300):
        base = "".join(letter() for _ in range(220))
        other = list(base)
        for at in range(0, 220, 220) if i < 100 else range(0, 220, 26):
            other[at + 5] = "0"
        pair = [line_op.normal(x) for x in (base, "".join(other))]
        lines += pair
        if len(sets(pair[0]) & sets(pair[1])) >= 0.8 * len(sets(pair[0]) | sets(pair[1])):
            near |= set(map(line_op.line_hash, pair))
    assert len(near) == 200
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    met = []
    monkeypatch.setattr(line_op, "_grouped", lambda members, f=line_op._grouped: met.append(members) or f(members))
    removed = sum(r.n_removed for r in line_op.repeated_lines(docs).collect())
    got = {r.lhash for r in met[0].select("lhash").collect()}
    assert removed == 100 and near <= got and len(got - near) <= 20
