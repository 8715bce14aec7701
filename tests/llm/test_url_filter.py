import re

import duckdb
import pytest
from pyspark.sql import functions as F

from veilwork.llm import url_filter as u
from veilwork.llm.queries import ORACLE_SQL, URL_RULES, op9_url_filter

URLS = [
    None, "", "no scheme", "http://", "http://Example.ORG", "HTTP://a.Example.org/EN/1?x=/y", "https://example.org/en/12", "https://notexample.org/en/1", "ftp://x.com/fr/1#a?b", "https://com/de/",
    "http://x.com?u=http://y.org/", "http://a.b/c://d/e", "http://x.com/de", "http://x.com/DE/1", "://org/", "http://x.com/a//b/", "http://é.org/ü\nz", "x" * 9000 + "://x.org/" + "y/" * 900,
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def rule_of(host, path):
    fits = []
    for says, rule in URL_RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, says))
    return max(fits)[1:] if fits else (None, None)


def test_hosts_paths_and_rules_against_plain_python(spark):
    df = spark.createDataFrame([(i, x, "old") for i, x in enumerate(URLS)], "page_id long, url string, verdict string")
    rows = u.judge(df, URL_RULES).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        host, path = split(URLS[r.page_id])
        rule, says = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == says if says else r.verdict in ("allow", "block")


def test_templates_judge_by_labelled_neighbours(spark):
    rows = [(i, f"https://s.net/spam/{i}") for i in range(60)] + [(100 + i, f"https://s.net/blog/{i}") for i in range(60)]
    rules = [("block", f"s.net/spam/{i}") for i in range(20, 40)] + [("allow", f"s.net/blog/{i}") for i in range(20, 40)]
    got = {r.page_id: r for r in u.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert {got[i].template for i in range(60)} == {"/spam/*"} and {got[100 + i].template for i in range(60)} == {"/blog/*"}
    assert all(got[i].verdict == "block" and got[100 + i].verdict == "allow" for i in range(60))


def test_branches_that_do_not_differ_are_merged(spark):
    rows = [(100 * k + i, f"https://s.net/{kind}/{i % 9}") for k, kind in enumerate(["a", "b"]) for i in range(60)]
    rules = [(("block", "allow")[i % 2], f"s.net/{kind}/{i}") for kind in ("a", "b") for i in range(9)]
    got = u.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).select(F.split("template", "/")[1].alias("t")).distinct().collect()
    assert [r.t for r in got] == ["~"]


def test_a_literal_tilde_is_no_merged_branch(spark, tmp_path):
    paths = [f"~/p{'?' * 1}{i}" for i in range(30)] + [f"{'ab'[i % 2]}/p?{i}" for i in range(60)] + [f"z/p?{i}" for i in range(6)]
    df = spark.createDataFrame([(i, f"https://s.net/{p}") for i, p in enumerate(paths)], "page_id long, url string")
    rules = [("block", "s.net/~/"), ("allow", "s.net/a/"), ("allow", "s.net/b/")]
    got = {r.page_id: r for r in u.judge(df, rules).collect()}
    assert {got[i].template.split("/")[1] for i in range(30)} == {"~0"}
    assert {got[i].template.split("/")[1] for i in range(90, 96)} == {"~"}
    assert all(got[i].verdict == "allow" for i in range(30, 96)) and got[0].verdict == "block"


def test_without_rules_and_without_rows(spark):
    df = spark.createDataFrame([(1, "http://a.b/c"), (1, "http://a.b/c"), (None, None)], "page_id long, url string")
    assert [r.verdict for r in u.judge(df, []).collect()] == ["allow"] * 3
    assert u.judge(df.limit(0), URL_RULES).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '/root/testdata/{sf}/pages.parquet'")
    df = op9_url_filter(spark, f"/root/testdata/{sf}")
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL['op9_url_filter']})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_sql_on_odd_urls(spark):
    con = duckdb.connect()
    rows = [(i, x) for i, x in enumerate(URLS)] + [(1000 + i, f"https://h{i % 3}.com/{('fr', 'de', 'it')[i % 3 if i % 5 else 2]}/{i % 7}/{i % 11}/x/y/z") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    con.register("pages", df.toPandas())
    got = u.judge(df, URL_RULES).select("page_id", "host", "path", "rule", "verdict")
    want = con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({ORACLE_SQL['op9_url_filter']})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
