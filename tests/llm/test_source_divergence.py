"""Divergence of sources against a plain count, with blocks, merges and odd rows of every kind."""
from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from tests.llm.texts import ODD
from vitrine.llm import source_divergence


def brute(rows, min_pages, top):
    """rows (text, lang, source)"""
    counts, pages, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        sources[lang].add(source)
        counts[lang, source].update(terms)
        pages[lang].update(set(terms))
    out = []
    for lang, named in sources.items():
        kept = [t for t, n in pages[lang].items() if n >= min_pages]

        def share(count, of):
            total = sum(of[t] for t in kept)
            return 1 + 1_000_000_000 * (count + 5) // (total + 5 * len(kept))

        whole = Counter()
        for s in named:
            whole.update(counts[lang, s])
        p = {s: {t: share(counts[lang, s][t], counts[lang, s]) for t in kept} for s in named}
        q = {t: share(whole[t], whole) for t in kept}
        for s in named:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in named if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found[:limit])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, rank int, term string")


def got(spark, rows, min_pages=2, top=3):
    found = source_divergence.audit_sources(table(spark, rows), min_pages, top)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in found.collect())


def invented(n, seed=1):
    r = random.Random(seed)
    words = ["Aa", "aA", "b", "ß", "É", "é", "漢字", "x9y", "co-op", "z_z", "q\x00q", "w" * 500, " ", "ÀB", "I", "İ"]
    return [(" ".join(r.choices(words, k=r.randrange(8))), r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "s3", None, "ß"])) for _ in range(n)]


def test_against_a_plain_count(spark):
    rows = invented(120) + [("only here only", "fr", "one"), ("", "it", "a"), (None, "it", "b"), ("...", "it", "c")]
    assert got(spark, rows) == brute(rows, 2, 3)


def test_hot_source_and_repeats(spark):
    rows = [("same words here", "en", "hot")] * 200 + invented(30, 2) + [(t, "en", "odd") for t in ODD]
    assert got(spark, rows, 5, 50) == brute(rows, 5, 50)


def test_small_blocks_and_merges_change_nothing(spark, monkeypatch):
    rows = invented(80, 3)
    want = brute(rows, 1, 4)
    for name, value in (("MERGE_ROWS", 5), ("SORTED_ROWS", 3), ("BLOCK_CELLS", 7)):
        monkeypatch.setattr(source_divergence, name, value)
    assert got(spark, rows, 1, 4) == want


def test_shares_are_exact():
    import numpy as np
    counts, total = np.array([5, 7, 123456789012345, 9 * 10 ** 15 - 1]), np.int64(9 * 10 ** 15)
    assert source_divergence.shares(counts, total).tolist() == [1 + 10 ** 9 * int(c) // int(total) for c in counts]


def test_nothing(spark):
    assert got(spark, []) == []
    assert got(spark, [("a b", "en", "s")]) == []
