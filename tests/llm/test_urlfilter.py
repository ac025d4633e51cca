import re

import pytest
from pyspark.sql import functions as F

from queuelens.llm import urlfilter

from .conftest import wide

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/en/x", "block"), ("org", "/fr/", "allow"),
         ("org", "/fr/", "block")]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
    path = re.match(r"[^?#]*", rest[len(raw):])[0]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


URLS = [None, "", "no scheme", "http://", "http://NET/", "http://net", "https://a.Example.net/en/xyz?q#f", "x://example.net/en/",
        "https://b.example.net/en", "https://wwwexample.net/", "ftp://q.org/fr/1", "http://q.org/fr", "http://É.org/fr/é#://z/",
        "http://h.org/" + "p/" * 5000, "http://a.b.c.d.e.net/?/en/", "http://..net/", "http://u@example.net:80/en/"]


@pytest.mark.parametrize("how", [{}, {"bits_per_key": 3, "hashes": 1}])
def test_urls_by_brute_force(spark, how):
    urls = URLS + [f"http://h{k}.s{k % 7}.net/en/{k}" for k in range(200)]
    rows = [(k, u) for k, u in enumerate(urls)] + [(5, "http://net/")] * 2 + [(None, "http://net/")]
    pages = wide(spark.createDataFrame(rows, "page_id bigint, url string"), "host", "path", "rule", "verdict", "best", "key")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    found = urlfilter.judge(pages, rules, **how)
    assert found.count() == len(rows)
    for r in found.collect():
        assert (r.host, r.path, r.rule, r.verdict) == plain(r.url), r.url


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("hash(key) % 5 = 0")
    cascade = urlfilter.Cascade.build(listed, universe, bits_per_key=2, hashes=2)
    assert len(cascade.levels) > 2
    want = {r.key for r in listed.collect()}
    assert {r.key for r in universe.filter(cascade.has(F.col("key"))).collect()} == want
    none = urlfilter.Cascade.build(listed.filter("false"), universe)
    assert universe.filter(none.has(F.col("key"))).count() == 0
    with pytest.raises(ValueError):
        urlfilter.Cascade.build(listed, universe, most_words=1)


def test_no_join_or_python_when_judging(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    plan = urlfilter.judge(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Join|Exchange|Python|Arrow", plan)
    assert urlfilter.judge(pages, rules.filter("false")).first().verdict == "allow"
    assert urlfilter.judge(pages.filter("false"), rules).count() == 0
