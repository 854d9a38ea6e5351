from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest

from tests.llm.texts import ODD, invented, no_pages, odd_pages, pages
from vitrine.llm import ngram_join, scratch
from vitrine.llm.components import components


def brute(rows, words=5, percent=75):
    def grams(t):
        w = (t or "").encode().translate(ngram_join.LOWER).split()
        k = min(words, len(w))
        return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets = [(u, grams(t)) for u, t in rows]
    comp = {u: u for u, _ in rows}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, (u, a) in enumerate(sets):
        for v, b in sets[:i]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(u), find(v)
                comp[max(x, y)] = min(x, y)
    return sorted((u, len(s), find(u)) for u, s in sets)


def rows(frame):
    return sorted(tuple(r) for r in frame.select("url", "n_shingles", "component").collect())


def variants(seed: int, n: int, words: int, changes: int) -> list[str]:
    r = random.Random(seed)
    base = invented(seed, words).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(changes + 1)):
            w[r.randrange(len(w))] = f"new{r.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("draws, hot_rows", [(1, 4), (4, 1000)])
def test_against_brute_force(spark, draws, hot_rows):
    # Copies that differ from their origin by little but from one another by more than the limit, groups that share a passage, copies.
    texts = variants(1, 12, 120, 3) + variants(2, 12, 60, 2) + [invented(9, 40) + " " + invented(s, 25) for s in range(20, 26)]
    texts += ["One two", "one TWO", "one two three", invented(1, 120), invented(1, 120).upper()]
    frame = pages(spark, texts).repartition(4)
    got = rows(ngram_join.near_duplicates(frame, draws=draws, count_bits=12, hot_rows=hot_rows))
    assert got == brute(list(enumerate(texts)))


def test_odd_tables(spark):
    frame = odd_pages(spark).dropDuplicates(["url"])
    expected = [(u, n, c) for u, n, c in brute(list(enumerate(ODD)))]
    assert rows(ngram_join.near_duplicates(frame, count_bits=12)) == expected
    assert ngram_join.near_duplicates(no_pages(spark), count_bits=12).count() == 0


def test_hot_centres_go_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIRS_TOGETHER", 3)
    texts = variants(4, 25, 80, 2)
    frame = pages(spark, texts)
    pairs = spark.createDataFrame([(0, i) for i in range(1, 25)] + [(3, 4), (5, 9)], "a long, b long")
    got = {(r["a"], r["b"]) for r in ngram_join.verified(frame, pairs, 5, 75).collect()}

    def linked(i, j):
        x, y = ({tuple(texts[k].lower().split()[p:p + 5]) for p in range(76)} for k in (i, j))
        return 100 * len(x & y) >= 75 * len(x | y)
    assert got == {(r["a"], r["b"]) for r in pairs.collect() if linked(r["a"], r["b"])} and got


def test_repeated_rows_and_struct_urls(spark):
    near = invented(3, 60)
    frame = spark.createDataFrame([((1, "x"), near), ((1, "x"), near), ((1, "y"), invented(8, 60)), ((2, "z"), near + " more")], "url struct<i: long, d: string>, text string")
    got = sorted((tuple(r["url"]), tuple(r["component"])) for r in ngram_join.near_duplicates(frame, count_bits=12).collect())
    assert got == [((1, "x"), (1, "x")), ((1, "x"), (1, "x")), ((1, "y"), (1, "y")), ((2, "z"), (1, "x"))]


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 130)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(3, 3), (7, 8), (8, 7), (7, 8)]
    comp = {}

    def find(x):
        while comp.setdefault(x, x) != x:
            x = comp[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        comp[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}


def test_windows_over_lists_send_each_column_once(spark, monkeypatch):
    plans, table = {}, ngram_join.scratch.table

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString().splitlines()
        return table(df, name)
    monkeypatch.setattr(ngram_join.scratch, "table", seen)
    text = " ".join(f"w{i}" for i in range(60))
    pages = spark.createDataFrame([(1, text), (2, text + " end"), (3, "other words " * 9)], "url long, text string")
    got = {r["url"]: r["component"] for r in ngram_join.near_duplicates(pages).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    plan = plans["ngram-lists"]
    below = [plan[i + 1] for i, line in enumerate(plan) if "Exchange hashpartitioning(h#" in line]
    # What a window compares is put together behind the shuffle, and the second window needs no shuffle besides that of distinct().
    assert len(below) == 2 and not [line for line in below if "struct(" in line]


def test_a_written_table_leaves_no_shuffle_behind(spark):
    def shuffled():
        return spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")

    before, setting = shuffled(), spark.conf.get(scratch.CLEANUP, None)
    rows = spark.range(1000).repartition(3, "id")
    kept = [scratch.table(rows, "shuffled"), scratch.table(rows.filter("id < 10"), "few")]
    until = time.time() + 5
    while shuffled() > before and time.time() < until:
        time.sleep(0.1)
    assert shuffled() <= before and [t.count() for t in kept] == [1000, 10] and rows.count() == 1000
    assert spark.conf.get(scratch.CLEANUP, None) == setting


def test_lists_keep_the_upper_bits_of_a_hash(spark):
    text = " ".join(f"w{i}" for i in range(60))
    pages = spark.createDataFrame([(1, text), (2, text + " end"), (3, "other words " * 9)], "url long, text string")
    sets = ngram_join.page_sets(pages, ngram_join.corpus_counts(pages, 5, 8), 5, 75, 8, 100)
    listed = [e["h"] for r in sets.collect() for e in r["prefix"]]
    assert len(listed) > 20 and len(set(listed)) > 10 and all(h % (1 << 16) == 0 for h in listed)


def test_sketches_tell_unlike_sets_apart_and_lose_no_similar_pair(spark):
    r = np.random.default_rng(7)

    def odd_groups(hashes, size):
        bits = [0] * size
        for h in hashes.tolist():
            bits[h % size] ^= 1
        return bits
    sets = {}
    for n in (1, 2, 5, 31, 33, 64, 100, 300, 1000, 3000):
        base = r.integers(0, 2 ** 64, n, np.uint64)
        new = r.integers(0, 2 ** 64, 4 * n, np.uint64)
        for i, (cut, more) in enumerate([(0, 0), (0, n // 3), (n // 4, 0), (n // 7, n // 7), (n // 3, n // 3), (n // 2, n // 2), (n // 3, 2 * n), (n, n), (n, 2 * n)]):
            sets[n * 100 + i] = np.concatenate([base[cut:], new[:more]])
    for found in (sets[3105], sets[100000], np.zeros(0, np.uint64)):
        bits = np.unpackbits(ngram_join.sketch_of(found).view(np.uint8), bitorder="little").tolist()
        assert len(bits) >= max(64, 2 * len(found)) and bits == odd_groups(found, len(bits))
    frame = spark.createDataFrame([(k, ngram_join.sketch_of(x).tolist()) for k, x in sets.items()], "rep long, sketch array<long>")
    pairs = [(a, b, len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b and a // 100 == b // 100]
    for percent in (75, 30):
        got = {tuple(x) for x in ngram_join._sketch_filter(spark.createDataFrame(pairs, "a long, b long, na int, nb int"), frame, percent).collect()}
        common = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a, b, _, _ in pairs}
        similar = {(a, b) for a, b, n, m in pairs if 100 * common[a, b] >= percent * (n + m - common[a, b])}
        assert similar and similar <= got
        far = {(a, b) for a, b, n, m in pairs if n > 90 and 100 * common[a, b] < 55 * (n + m - common[a, b])}
        assert percent < 75 or (len(far) > 20 and not far & got)


def test_unlike_long_texts_with_a_common_passage_are_not_compared_whole(spark, monkeypatch):
    compared, whole = set(), ngram_join.verified

    def seen(pages, pairs, *more):
        compared.update((x["a"], x["b"]) for x in pairs.collect())
        return whole(pages, pairs, *more)
    monkeypatch.setattr(ngram_join, "verified", seen)
    passage = " ".join(f"p{i}" for i in range(300))
    texts = [" ".join([passage, *(f"w{k}x{i}" for i in range(900))]) for k in range(4)]
    texts.append(texts[3] + " end")
    got = rows(ngram_join.near_duplicates(pages(spark, texts).repartition(2), count_bits=12))
    assert [(u, c) for u, _, c in got] == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 3)]
    assert compared == {(3, 4)}


def test_a_settled_result_leaves_no_shuffle_behind(spark):
    def shuffles():
        names = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(" ")
        return set(re.findall(r"shuffle_(\d+)_", names))
    before, setting = shuffles(), spark.conf.get(scratch.CLEANUP, None)
    made = spark.range(1000).repartition(3, "id")
    kept = scratch.settled(made)
    until = time.time() + 5
    while shuffles() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffles() - before and kept.count() == made.count() == 1000
    assert spark.conf.get(scratch.CLEANUP, None) == setting
