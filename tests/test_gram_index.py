"""Searches over the kept index must find what a scan finds, and read the asked buckets only."""
import random

import pytest

from vitrine.operators import gram_index, search

NAMES = ["Red Widget", "red wire 50%", "Blue\\Bolt", "FG 1", "FG1L", "FG-10", "ตู้เอกสาร", "a_b", "aXb", "Straße", "İstanbul", "x", "", None, "red", "REDWOOD table", "under_score", "100% wool"]


@pytest.fixture(scope="module")
def products(spark):
    r = random.Random(6)
    rows = [(i, n, f"{(n or 'none')[:6]}-{i}", "".join(c for c in (n or "").upper() if c.isascii() and c.isalnum()) or None) for i, n in enumerate(NAMES)]
    rows += [(100 + i, "".join(r.choice("redfg1 wl") for _ in range(8)), f"c{i}", "".join(r.choice("REDFG1WL") for _ in range(r.randrange(1, 7)))) for i in range(120)]
    return spark.createDataFrame(rows, "id long, name string, code string, key string")


@pytest.fixture(scope="module")
def folder(products, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("grams") / "index")
    gram_index.write_index(products.filter("id % 3 > 0"), "id", "key", ["name", "code"], out)
    gram_index.write_index(products.filter("id % 3 = 0"), "id", "key", ["name", "code"], out)
    return out


@pytest.mark.parametrize("query", ["red w", "FG1", "fg 1", "50\\%", "r%w", "a_b", "under\\_", "Blue\\Bolt", "เอกสาร", "straSSe", "İst", "x", "%%", "", "none-13", "zzz", "100% wool"])
def test_same_rows_as_a_scan(products, folder, query):
    want = search.text_search(products, query, ["name"], "code", "key", limit=500).collect()
    got = gram_index.indexed_text_search(folder, products, "id", query, ["name"], "code", "key", limit=500).collect()
    assert sorted(map(str, ({c: r[c] for c in sorted(r.asDict())} for r in got))) == sorted(map(str, ({c: r[c] for c in sorted(r.asDict())} for r in want)))
    assert [r["code"] for r in got] == [r["code"] for r in want]


def test_matches_of_many_terms(spark, products, folder):
    keys = products.filter("key is not null")
    terms = spark.createDataFrame([(t,) for t in ("RED", "FG1", "WLR", "R", "REDWIRE50", "QQQ")], "term string")
    want = search.trigram_matches(keys, terms, "key", "term").collect()
    got = gram_index.indexed_matches(spark, folder, keys, "id", "key", terms, "term").collect()
    row = lambda r: (r["term"], r["key"], round(r["similarity"], 9))
    assert sorted(map(row, got)) == sorted(map(row, want)) and len(got) > 5


def test_only_asked_buckets_are_read(spark, products, folder):
    plan = gram_index._lists(spark, folder, "bigint", [("key", "red")])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert gram_index.candidates(spark, folder, "bigint", "x", ["name"]) is None
