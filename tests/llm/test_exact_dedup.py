from __future__ import annotations

import hashlib
import re

import pytest

from tests.llm.texts import no_pages, odd_pages, pages
from vitrine.llm import exact_dedup


def expected(rows):
    lower = [(u, re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for u, t in rows]
    groups = {}
    for u, t in lower:
        groups.setdefault(t, []).append(u)
    return sorted((u, max(groups[t]), len(groups[t]), u == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for u, t in lower)


def rows(frame):
    return sorted(tuple(r) for r in frame.select("url", "keep", "group_size", "kept", "digest").collect())


@pytest.mark.parametrize("files_per_batch", [1, 1000])
def test_against_brute_force(spark, files_per_batch):
    texts = ["A b", "a B", "a b ", "Ä", "ä", None, "", "a b"] + [f"t{i % 5}" for i in range(30)]
    frame = pages(spark, texts).repartition(5)
    assert rows(exact_dedup.dedup_pages(frame, files_per_batch)) == expected(list(enumerate(texts)))


def test_odd_tables(spark):
    frame = odd_pages(spark)
    assert rows(exact_dedup.dedup_pages(frame)) == expected([(r["url"], r["text"]) for r in frame.collect()])
    assert exact_dedup.dedup_pages(no_pages(spark)).count() == 0


def test_null_urls(spark):
    frame = spark.createDataFrame([(None, "a"), (4, "A"), (None, "b")], "url long, text string")
    got = sorted((r["digest"], str(r["url"]), r["kept"]) for r in exact_dedup.dedup_pages(frame).collect())
    a, b = (hashlib.sha256(t).hexdigest() for t in (b"a", b"b"))
    assert got == sorted([(a, "None", False), (a, "4", True), (b, "None", True)])


def test_texts_behind_a_digest_are_compared(spark):
    frame = pages(spark, ["one", "two", "one"])
    state = frame.selectExpr("sha2(cast(text as binary), 256) as digest").distinct().selectExpr("digest", "2L as copies")
    assert exact_dedup.distinct_texts(frame, state).count() == 0
    assert sorted(r["url"] for r in exact_dedup._by_text(frame).filter("url = keep").collect()) == [1, 2]
    assert rows(exact_dedup._by_text(frame).selectExpr("*", "url = keep as kept")) == expected([(0, "one"), (1, "two"), (2, "one")])
