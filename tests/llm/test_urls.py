from __future__ import annotations

import re

import pytest

from vitrine.llm.host_reputation import Rule, judge_urls

RULES = [Rule("com/", "allow"), Rule("example.com/en/", "block"), Rule("www.example.com/en/", "allow"), Rule("net/es/", "block")]
URLS = [None, "", "no scheme/x", "http://", "https://A.Example.COM/en/1?x#y", "https://www.example.com/en/2", "https://example.com/En/3",
        "https://x.net/es/1", "https://x.net", "https://notexample.com/en/1", "ftp://ÄB.org#frag", "a://b://c/d"]


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def rule_of(host, path):
    fits = []
    for r in RULES:
        name, slash, rest = r.prefix.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + rest):
            fits.append(r)
    return max(fits, key=lambda r: len(r.prefix), default=None)


def test_split_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS[:2])], "key long, url string, host string")
    none = spark.createDataFrame([], "url string, usable int")
    got = {(r["key"]): r for r in judge_urls(pages, none, RULES).collect()}
    assert len(got) == len(URLS) + 2
    for i, u in enumerate(URLS + URLS[:2]):
        host, path = split(u)
        rule = rule_of(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule.prefix if rule else None), u
        assert got[i]["verdict"] == (rule.verdict if rule else "allow")


def test_empty_table(spark):
    pages = spark.createDataFrame([], "key long, url string")
    none = spark.createDataFrame([], "url string, usable int")
    assert judge_urls(pages, none, RULES).count() == 0


@pytest.fixture(scope="module")
def judged(spark):
    outcomes = [(f"http://bad{i}.spam.org/{j}", 0) for i in range(3) for j in range(40)]
    outcomes += [(f"http://good{i}.fine.org/{j}", int(j % 10 > 0)) for i in range(3) for j in range(40)]
    outcomes += [("http://new.fine.org/1", 0), ("http://fine.org/2", None), (None, 1)]
    pages = [(0, "http://bad1.spam.org/9"), (1, "http://other.spam.org/9"), (2, "http://good1.fine.org/9"), (3, "http://new.fine.org/9"),
             (4, "http://unseen.org/"), (5, "http://unseen.de/")]
    frame = judge_urls(spark.createDataFrame(pages, "key long, url string"), spark.createDataFrame(outcomes, "url string, usable int"), [])
    return {r["key"]: r for r in frame.collect()}


def test_hosts_shrink_to_domain(judged):
    assert judged[0]["verdict"] == "block"
    assert judged[1]["verdict"] == "block"  # no page of this host is known, its domain is bad throughout
    assert judged[2]["verdict"] == "allow"
    assert judged[3]["verdict"] == "allow"  # one bad page does not undo a good domain
    assert judged[4]["verdict"] == "allow" and judged[5]["verdict"] == "allow"


def test_bounds_are_ordered(judged):
    assert judged[0]["usable_bound"] < judged[1]["usable_bound"] + 0.2 < judged[2]["usable_bound"]
    assert all(0 <= r["usable_bound"] <= 1 for r in judged.values())
