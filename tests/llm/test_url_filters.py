"""URL filters against a plain rendering of the rules, nested rules, edge rows."""

import re

from deskpark.llm import url_filters as u
from deskpark.llm.queries import RULES, oracle_sql, queries
from llm.cases import SF_SMALL

RULE = "host string, path string, verdict string"


def brute(url, rules, otherwise="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3:]
        raw = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(raw):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), raw)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules
            if h and p is not None and v and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else otherwise


def rows(got):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()), key=repr)


def test_query_equals_brute_force(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()
    assert rows(queries()["op5_url_filters"](spark, SF_SMALL)) == sorted(((p.page_id, *brute(p.url, RULES)) for p in pages), key=repr)


def test_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF_SMALL}/pages.parquet')")
    want = con.execute(oracle_sql()["op5_url_filters"]).fetchall()
    assert rows(queries()["op5_url_filters"](spark, SF_SMALL)) == sorted(want, key=repr)


def test_nested_rules_and_edge_urls(spark):
    rules = [("com", "/", "block"), ("a.com", "/", "allow"), ("a.com", "/x/", "block"), ("b.a.com", "/", "block"), ("a-b.com", "/", "allow"),
             ("c.b.a.com", "/x/y", "allow"), ("org", "", "block"), ("same.org", "/", "allow"), ("same.org", "/", "block"), ("", "/", "block"),
             (None, "/", "block"), ("net", None, "block"), ("net", "/", None), ("x.y.z.io", "/", "block"), ("x.y.z.io", "/", "block")]
    hosts = ["a.com", "b.a.com", "c.b.a.com", "ab.com", "a-b.com", "z.a-b.com", "com", "xcom", "org", "same.org", "q.same.org", "x.y.z.io", "y.z.io", "net", "A.COM", "a.com.", ".com", "a..com"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/x/", "/x/y?q#f", "?q=/x/", "#/x/")]
    urls += [None, "", "no scheme", "://", "://a.com/x/", "http://a.com://b.org/", "http://a.com:80/x", "HTTP://B.A.Com/X/"] + urls[:9]
    pages = spark.createDataFrame([(i if i % 10 else None, x, "k", "top", 3) for i, x in enumerate(urls)], "page_id long, url string, key string, top string, slice int")
    want = sorted(((i if i % 10 else None, *brute(x, rules)) for i, x in enumerate(urls)), key=repr)
    for slices in (1, 5):
        assert rows(u.judge(pages, spark.createDataFrame(rules, RULE), slices=slices)) == want


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, RULE)
    assert rows(u.judge(pages, spark.createDataFrame([], RULE), "block")) == [(1, "a.com", "/", None, "block")]
    assert u.judge(pages.where("false"), rules).count() == 0
