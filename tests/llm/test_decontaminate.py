from __future__ import annotations

import random
import time

import numpy as np
import pytest

from tests.llm.texts import invented, no_pages, odd_pages, pages
from vitrine.llm.decontaminate import Templates, contaminated, marked

QUESTION = "A shop sells 12 chairs for 30 baht each and Anna buys 12 of them before lunch. How much does Anna pay in all for the chairs?"
OTHER = "A shop sells 45 chairs for 7 dollars each and Bill buys 45 of them before lunch. How much does Bill pay in all for the chairs?"
MIXED = "A shop sells 45 chairs for 7 dollars each and Bill buys 99 of them before lunch. How much does Carl pay in all for the chairs?"


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, QUESTION), (2, "One short text of six words"), (2, "One short text of six words"), (3, "1 2 3"), (4, None), (5, "")],
                                 "slug long, text string")


def test_templates():
    token, value = Templates().of("The width is 12.5 cm and Bob saw 7 cm. Now ok")
    same, values = Templates().of("The width is 3 mm and Ann saw 8 mm. Now ok")
    assert (token == same).all() and ((value > 0) == (values > 0)).all() and (value != values).any()
    assert int((value > 0).sum()) == 5


def test_finds_copies_and_other_parameters(spark, items):
    texts = [invented(1, 80) + ". " + QUESTION + " " + invented(2, 50), OTHER.replace(" ", "\n"), MIXED, invented(3, 200), QUESTION.upper(),
             "well. One short text of six words here", "One short text of", None, "", "1 2 3 4 5 6 7 8 9 10 11 12"]
    got = {(r["url"], r["slug"]): r for r in contaminated(pages(spark, texts), items).collect()}
    assert {k for k in got if k[1] == 1} >= {(0, 1), (1, 1)} and (2, 1) not in got and (3, 1) not in got
    assert got[0, 1]["verbatim"] and not got[1, 1]["verbatim"]
    assert (5, 2) in got and (6, 2) not in got and not any(k[1] in (3, 4, 5) or k[0] in (7, 8, 9) for k in got)


def test_repeated_pages_and_odd_tables(spark, items):
    twice = pages(spark, [QUESTION]).unionByName(pages(spark, [QUESTION]))
    assert [(r["url"], r["slug"], r["share"] <= 1) for r in contaminated(twice, items).collect()] == [(0, 1, True)]
    assert contaminated(odd_pages(spark), items).count() == 0
    assert contaminated(no_pages(spark), items).count() == 0
    assert contaminated(odd_pages(spark), items.filter("slug > 9")).count() == 0


def test_finds_copies_of_numbers_and_names_in_any_case(spark):
    sums = "12 + 7 = 19, 30 - 4 = 26, 5 * 9 = 45, 81 / 3 = 27"
    names = "die Mutter kauft Brot und Käse beim Bäcker neben dem Bahnhof während der Vater Blumen auf dem Markt am Rathaus der Stadt sucht"
    items = spark.createDataFrame([(1, sums), (2, names), (3, "Anna Bob Carl Dora"), (4, "Anna Bob Carl")], "slug long, text string")
    texts = [invented(1, 60) + ". " + sums + ". " + invented(2, 40), names.upper(), names.lower(), names.title(), sums.replace("19", "18").replace("45", "44"),
             "they met Anna Bob Carl Dora there"]
    got = {(r["url"], r["slug"]): r for r in contaminated(pages(spark, texts), items).collect()}
    assert set(got) == {(0, 1), (1, 2), (2, 2), (3, 2), (5, 3)}
    assert all(r["verbatim"] and r["share"] == 1 for r in got.values())


def test_one_odd_value_drops_only_its_windows(spark):
    def passage(*names):
        parts = [invented(i, 20) for i in range(1, 5)]
        return " ".join(f"{p} and then {n} went home with 12 more of them ." for p, n in zip(parts, names)).replace(" .", "")

    fruit = "In the morning the farmer put {} apples into the old basket behind the house and carried it slowly to the market where people bought {} pears"
    items = spark.createDataFrame([(1, passage("Anna", "Anna", "Anna", "Anna")), (2, fruit.format(3, 3))], "slug long, text string")
    texts = [passage("Anna", "Anna", "Bob", "Anna"), passage("Carl", "Carl", "Dora", "Carl"), fruit.format(4, 5), fruit.format(4, 4)]
    got = {(r["url"], r["slug"]): r for r in contaminated(pages(spark, texts), items).collect()}
    assert set(got) == {(0, 1), (1, 1), (2, 2), (3, 2)}
    total = got[1, 1]["windows"] / got[1, 1]["share"]
    assert total - 10 < got[0, 1]["windows"] < total and got[3, 2]["windows"] > got[2, 2]["windows"]


def test_plain_windows_against_all_places(spark):
    """Texts of few words, full of repeats: every place of a reference is looked for at every place of a page."""
    r = random.Random(7)
    text = lambda n: " ".join(r.choice(["red", "blue", "old", "box"]) for _ in range(n))
    refs = [text(r.randrange(9, 40)) for _ in range(12)] + [" ".join(["red box"] * 10)]
    texts = [text(r.randrange(1, 80)) for _ in range(25)] + [" ".join(["red box"] * 60)]
    texts += [text(20) + " " + ref for ref in refs[:4]]
    want = {}
    for u, page in enumerate(texts):
        p = page.split()
        for s, ref in enumerate(refs):
            w = ref.split()
            places = len(w) - 7
            hits = {there: [here for here in range(len(p) - 7) if p[here:here + 8] == w[there:there + 8]] for there in range(places)}
            hits = {t: h for t, h in hits.items() if h}
            if len(hits) >= 5 or hits and len(hits) / places >= 0.5:
                want[u, s] = (len(hits), len(hits) / places, True, min(map(min, hits.values())), max(map(max, hits.values())) + 8)
    items = spark.createDataFrame(list(enumerate(refs)), "slug long, text string")
    got = {(r["url"], r["slug"]): tuple(r)[2:] for r in contaminated(pages(spark, texts), items).collect()}
    assert got == want and len(want) > 3


def test_repeated_phrases_on_both_sides_stay_in_proportion(spark):
    phrase = "the same eight words of one phrase again "
    items = spark.createDataFrame([(1, phrase * 50)], "slug long, text string")
    start = time.perf_counter()
    got = contaminated(pages(spark, [phrase * 5000, "nothing of that kind"]), items).collect()
    assert [(r["url"], r["slug"], r["share"]) for r in got] == [(0, 1, 1.0)] and time.perf_counter() - start < 30


def test_packed_field_says_what_the_field_says():
    field = np.random.default_rng(5).random(1 << 12) < 0.1
    places = np.arange(1 << 12)
    assert (marked(np.packbits(field), places) == field).all()
    assert marked(np.packbits(field), places[:0]).shape == (0,)


def test_a_task_keeps_few_codes_of_many_tokens():
    templates = Templates()
    texts = [" ".join(f"w{k}" for k in range(a, a + 1_000)) for a in range(0, 120_000, 1_000)]
    first = [[x.tolist() for x in templates.both(t)] for t in texts[:3]]
    for t in texts:
        templates.both(t)
    assert len(templates.codes) <= 60_000
    assert [[x.tolist() for x in templates.both(t)] for t in texts[:3]] == first
