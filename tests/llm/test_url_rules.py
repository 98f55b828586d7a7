from __future__ import annotations

import random

from quern.llm import url_rules
from tests.oracle import same

SMALL = "/root/testdata/sf0.001"


def parts(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    path = rest[end:]
    stop = min((path.find(c) for c in "?#" if c in path), default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def brute(urls, rules, default="allow"):
    out = []
    for i, u in urls:
        h, p = parts(u)
        fits = [(len(rh + rp), len(rh), rh + rp, v) for v, rh, rp in rules if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        best = max(fits, default=None)
        out.append((i, h, p, best[2] if best else None, best[3] if best else default))
    return sorted(out, key=str)


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "h", "x", 1, "r") for i, u in urls], "page_id long, url string, host string, key string, node int, rule string")
    return sorted(map(tuple, url_rules.judge_urls(pages, url_rules.rules_frame(spark, rules)).collect()), key=str)


ODD = ["", "no scheme", "http://", "http://ORG", "http://org/", "http://org?x/", "http://a.ORG/en/1#f", "x://example.org/es/1", "ftp://b.example.org/en/12?q", "http://notexample.org/es/",
       "http://com/fr/", "http://x.com//fr/", "http://a..com/de/\n", "http://.org/", "http://org./", "http://u@example.org:80/es/", "a://b://org/", "http://éxample.org/es/é", "http://com/fr/" + "p" * 20_000]


def test_equals_brute_force_on_odd_urls(spark):
    urls = [(None, None), (3, "http://org/"), (3, "http://org/"), *enumerate(ODD)]
    assert judged(spark, urls, url_rules.RULES) == brute(urls, url_rules.RULES)


def test_equals_brute_force_on_many_nested_rules(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "RANGE_ROWS", 20)
    rng = random.Random(2)
    host = lambda: ".".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice(("/", "x", "y")) for _ in range(rng.randint(0, 5)))
    rules = list({(h, p): (rng.choice(("allow", "block")), h, p) for h, p in ((host(), path()) for _ in range(150))}.values())
    urls = [(i, f"http://{host()}/{path()}") for i in range(300)]
    found, expected = judged(spark, urls, rules), brute(urls, rules)
    assert found == expected


def test_without_rules_or_pages(spark):
    assert judged(spark, [(1, "http://a.b/c")], []) == [(1, "a.b", "/c", None, "allow")]
    assert judged(spark, [], url_rules.RULES) == []


def test_equals_duckdb(spark):
    same(url_rules.query(spark, SMALL), SMALL, url_rules.SQL)
