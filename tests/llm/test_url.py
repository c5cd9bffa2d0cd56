import re

from privloom.llm import url_op


def brute(url):
    m = re.match(r"(?s)(.*?://)([^/?#]*)([^?#]*)", url or "")
    scheme, host, path = m.groups() if m else ("", "", "")
    lower = {i: i + 32 for i in range(65, 91)}
    scheme, host = scheme.translate(lower), host.translate(lower)
    fits = []
    for verdict, rule in url_op.HOST_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    found = [(len(r.name), r.verdict == "block", r.name, r.verdict) for r in map(lambda x: url_op.pattern_rule(*x), url_op.PATTERNS) if re.search(r.regex, scheme + host + path)]
    return host, path, None, max(found)[3] if found else "allow"


URLS = [None, "", "x", "http://", "http://NET/", "http://a.net", "http://a.net/x?y=/en/", "HTTPS://Example.NET/en/a#b", "http://notexample.net/en/", "http://q.example.com/de/x", "http://q.example.com/DE/x",
        "http://a.org/fr/", "http://org/fr/x", "http://ads-track.example.com/en", "http://m.ads-track.example.org/opt-out?x", "http://x.example.org/a/banner/12/ad/x", "http://x.org/banner/1/adx", "http://x.org/a-sponsored-b",
        "http://net:80/", "http://é.net/é", "a://b://c.net/", "http://x.com/torrent/a/b.exe", "http://x.com/torrent/a/b.exe/", "http://x.com/" + "a/" * 50000 + "popunder/"]


def test_rules(spark):
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(URLS)] + [(0, None, "", "")], "page_id long, url string, host string, row string")
    got = sorted(tuple(r)[:5] for r in url_op.judge_urls(df).select("page_id", "host", "path", F_coalesce("rule"), "verdict").collect())
    assert got == sorted([(i, h, p, r or "", v) for i, u in [*enumerate(URLS), (0, None)] for h, p, r, v in [brute(u)]])
    assert url_op.judge_urls(df.limit(0)).count() == 0
    assert url_op.judge_urls(df, []).filter("verdict <> 'allow' or rule is not null").count() == 0


def F_coalesce(name):
    from pyspark.sql import functions as F

    return F.coalesce(name, F.lit("")).alias(name)


def test_query_against_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    want = con.execute(url_op.OP3_SQL).fetchall()
    got = [tuple(r) for r in url_op.op3_url_filter(spark, sf_dir).collect()]
    key = lambda r: [str(x) for x in r]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_index_beyond_a_broadcast_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(url_op, "MAX_RULES", 3)
    rows = [(1, "http://ads.example.net/x")] * 3 + [(1, None), (2, "http://a.org/fr/b"), (2, "http://a.org/fr/b")]
    got = sorted((r.page_id, r.rule or "", r.verdict) for r in url_op.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect())
    assert got == [(1, "", "allow")] + [(1, "net/", "block")] * 3 + [(2, "org/fr/", "allow")] * 2
