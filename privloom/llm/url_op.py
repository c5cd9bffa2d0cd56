"""URL filters: pattern rules indexed by their rarest literal token.

A url's tokens (runs of a-z and 0-9, lower-cased) fetch the rules that are indexed under one of them, and only those
rules' regular expressions run. Of a rule's literal tokens the one that is rarest among the urls at hand is its
index, so that common tokens (``https``, ``com``) fetch nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from privloom.llm.common import table

#: The rules of the host and path list: (verdict, rule).
HOST_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: The method's own patterns: ``*`` any text, ``^`` a separator or the end, ``||`` the start of a host label, ``|`` an end of the url.
PATTERNS = (
    ("block", "||ads-track."), ("block", "||ads."), ("block", "||adserver."), ("block", "||doubleclick."), ("block", "||analytics."),
    ("block", "/banner/*/ad^"), ("block", "/popunder/"), ("block", "||tracker."), ("block", "/adframe."), ("block", "^affiliate^"),
    ("allow", "||ads-track.example.org/opt-out^"), ("block", "||casino."), ("block", "/torrent/*.exe|"), ("block", "||adult."), ("block", "-sponsored-"),
)
#: Most rules whose index is sent to every executor; a larger index is shuffled.
MAX_RULES = 200_000
DEFAULT_VERDICT = "allow"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    listed: bool  # of the host and path list


def host_rule(verdict: str, name: str) -> Rule:
    """``host/path``: the host and its subdomains, if the path starts so. Matches on host + path."""
    host, slash, path = name.partition("/")
    regex = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(slash + path)}"
    tokens = re.findall(r"[a-z0-9]+", host) + [m[1].lower() for m in re.finditer(r"(?<![A-Za-z0-9])([A-Za-z0-9]+)(?=[^A-Za-z0-9])", slash + path)]
    return Rule(name, verdict, regex, tuple(dict.fromkeys(tokens)), True)


def pattern_rule(verdict: str, name: str) -> Rule:
    """A pattern over the url as ``scheme://host`` + path; a literal token counts only where both its ends are sure."""
    body, lead, end = name, "", ""
    if body.startswith("||"):
        body, lead = body[2:], r"^[a-z][a-z0-9+.-]*://(?:[^/]*\.)?"
    elif body.startswith("|"):
        body, lead = body[1:], "^"
    if body.endswith("|"):
        body, end = body[:-1], "$"
    regex = lead + "".join({"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|$)"}.get(c, re.escape(c)) for c in body) + end
    sure = ("" if lead else "*") + body + ("" if end else "*")  # '*' beside a run makes it unsure
    tokens = [m[0].lower() for m in re.finditer(r"(?<![A-Za-z0-9*])[A-Za-z0-9]+(?![A-Za-z0-9*])", sure)]
    return Rule(name, verdict, regex, tuple(dict.fromkeys(tokens)), False)


def default_rules() -> list[Rule]:
    return [host_rule(*r) for r in HOST_RULES] + [pattern_rule(*r) for r in PATTERNS]


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """scheme with ``://``, host (A-Z lower-cased) and path; all empty for null or without ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    match = r"(?s)^(.*?://)([^/?#]*)([^?#]*)"
    return tuple([F.translate(F.regexp_extract(text, match, i), upper, lower) for i in (1, 2)]) + (F.regexp_extract(text, match, 3),)


def url_tokens(text: Column) -> Column:
    return F.array_distinct(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "))


def judge_urls(pages: DataFrame, rules: list[Rule] | None = None, default: str = DEFAULT_VERDICT) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) for each row of ``pages`` (page_id, url).

    ``rule`` is the longest fitting rule of the host and path list (ties: block, then name), else null; without one the
    longest fitting pattern decides (ties likewise), else ``default``. Null urls and urls without ``://`` have an empty
    host and path and get the default. Repeated rows are judged each; very long urls whole; an empty table gives an empty one. Other columns of ``pages`` are not read.
    """
    spark = pages.sparkSession
    rules = default_rules() if rules is None else rules
    scheme, host, path = url_parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), scheme.alias("scheme"), host.alias("host"), path.alias("path"))

    # tokens of rules, counted among the urls: one row a token of the rules
    sent = F.broadcast if len(rules) <= MAX_RULES else (lambda df: df)
    wanted = [(t,) for t in sorted({t for r in rules for t in r.tokens})]
    tokens = rows.select(F.explode(url_tokens(F.concat("scheme", "host", "path"))).alias("token"))
    counts = {r.token: r["count"] for r in tokens.join(sent(spark.createDataFrame(wanted, "token string")), "token").groupBy("token").count().collect()}
    index, always = [], []
    for r in rules:
        rarest = min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=None)
        (always if rarest is None else index).append((rarest or "", r.name, r.verdict, r.regex, r.listed))
    schema = "token string, name string, rule_verdict string, regex string, listed boolean"
    # rules without a sure token are candidates of every url: indexed under the empty token, which every url gets
    indexed = sent(spark.createDataFrame(index + always, schema))

    url = F.concat("scheme", "host", "path")
    tokens_of = F.array_union(url_tokens(url), F.array(F.lit("")))
    found = (
        rows.withColumn("token", F.explode(tokens_of)).join(indexed, "token")
        .filter(F.rlike(F.when(F.col("listed"), F.concat("host", "path")).otherwise(url), F.col("regex")))
    )
    strength = F.struct(F.length("name").alias("n"), (F.col("rule_verdict") == "block").alias("b"), F.col("name").alias("name"), F.col("rule_verdict").alias("v"))
    # equal rows are judged together and counted; a rule's match adds nothing to the count
    same = ["page_id", "scheme", "host", "path"]
    kept = rows.select(*same, F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("rule_verdict"), F.lit(None).cast("boolean").alias("listed"), F.lit(1).alias("one"))
    best = (
        found.withColumn("one", F.lit(0)).select(kept.columns).union(kept).groupBy(*same)
        .agg(F.max(F.when(F.col("listed"), strength)).alias("r"), F.max(F.when(~F.col("listed"), strength)).alias("p"), F.sum("one").cast("int").alias("copies"))
    )
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        "page_id", "host", "path", F.col("r.name").alias("rule"),
        F.coalesce("r.v", "p.v", F.lit(default)).alias("verdict"), F.col("p.name").alias("pattern"),
    )


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _oracle() -> str:
    def quoted(text: str) -> str:
        return text.replace("'", "''")

    # longest first, ties: block, then the larger name; so the first that fits decides
    def order(r: Rule):
        return (len(r.name), r.verdict == "block", r.name)

    rules = sorted(default_rules(), key=order, reverse=True)
    listed = "".join(f" WHEN regexp_matches(hp, '{quoted(r.regex)}') THEN '{quoted(r.name)}'" for r in rules if r.listed)
    pattern = "".join(f" WHEN regexp_matches(u, '{quoted(r.regex)}') THEN '{quoted(r.name)}'" for r in rules if not r.listed)
    verdict = "".join(f" WHEN '{quoted(r.name)}' THEN '{r.verdict}'" for r in rules)
    return f"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS t, regexp_extract(coalesce(url, ''), '(?s)^(.*?://)([^/?#]*)([^?#]*)', ['s', 'h', 'p']) AS m FROM pages),
texts AS (SELECT page_id, lower(m.h) AS host, m.p AS path, lower(m.h) || m.p AS hp, lower(m.s) || lower(m.h) || m.p AS u FROM parts),
named AS (SELECT page_id, host, path, CASE{listed} END AS rule, CASE{pattern} END AS pattern FROM texts)
SELECT page_id, host, path, rule, CASE coalesce(rule, pattern){verdict} ELSE '{DEFAULT_VERDICT}' END AS verdict, pattern FROM named"""


OP3_SQL = _oracle()
