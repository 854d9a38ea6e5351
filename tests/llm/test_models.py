"""Language, toxicity and quality: held-out accuracy, and exactness of the search behind the toxicity score."""
from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

from tests.llm.texts import ODD, no_pages, odd_pages
from vitrine.llm import language_id, quality_ranking, toxic_neighbours

LEXICON = {"en": "the chair and table with steel legs of oak are in stock".split(), "fr": "la chaise et une table avec des pieds en chêne".split(),
           "de": "der stuhl und ein tisch mit beinen aus eiche ist da".split()}


def sentence(lang, r, n=30):
    return " ".join(r.choice(LEXICON[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(1)
    rows = [(i, sentence(lang, r), lang) for i, lang in enumerate(list(LEXICON) * 10)] + [(90, "null language", None), (91, None, "en")]
    return language_id.fit_languages(spark.createDataFrame(rows, "url long, text string, lang string"))


def test_languages(spark, model):
    r = random.Random(2)
    rows = [(i, sentence(lang, r, 8), lang) for i, lang in enumerate(list(LEXICON) * 5)]
    rows += [(50, "Stuhlbeine", "de"), (51, "chênes", "fr")]  # words that no page held, by their parts
    frame = spark.createDataFrame(rows, "url long, text string, lang_pred string")
    got = {x["url"]: x for x in language_id.identify_languages(frame, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows)
    assert all(0 < x["score"] <= 1 for x in got.values())


def test_language_of_odd_texts(spark, model):
    got = language_id.identify_languages(odd_pages(spark), model).collect()
    assert len(got) == len(ODD) + 1
    for x in got:
        none = not any(c.isalpha() for c in ODD[x["url"]] or "")
        assert (x["lang_pred"] == "und") == none and (x["score"] == 0) == none
    assert language_id.identify_languages(no_pages(spark), model).count() == 0
    whole = language_id.with_language(odd_pages(spark), model)
    assert whole.select("page.*").columns == odd_pages(spark).columns and whole.count() == len(ODD) + 1


def test_language_without_examples(spark):
    empty = language_id.fit_languages(spark.createDataFrame([], "url long, text string, lang string"))
    assert {r["lang_pred"] for r in language_id.identify_languages(odd_pages(spark), empty).collect()} == {"und"}


def test_longer_parts_first():
    def table(n, rows):
        rows = sorted((language_id.hashed(k, n), v) for k, v in rows.items())
        return np.array([h for h, _ in rows], np.int64), np.array([v for _, v in rows], float).reshape(-1, 2)
    parts = {0: {"xyz": [-1.0, -2.0]}, 3: {"<xy": [-5.0, -1.0]}, 1: {"x": [0.0, -9.0], "q": [-3.0, -9.0]}}
    m = language_id.LanguageModel(["a", "b"], {n: table(n, parts.get(n, {})) for n in range(5)})
    assert m.predict("xyz xyz")[0] == "a"
    assert m.unseen("xyw").tolist() == [-5.0, -1.0] and m.predict("xyw")[0] == "b"
    assert m.unseen("xq").tolist() == [-1.5, -9.0]
    assert m.unseen("ww").tolist() == [0.0, 0.0] and m.unseen("²") is None


def test_language_scores_against_plain_counts(spark):
    """The whole fit and back-off once more, with counts in dictionaries."""
    r = random.Random(11)
    known = [("".join(r.choice("abcé ") for _ in range(r.randrange(40))), r.choice(["en", "fr", "de"])) for _ in range(60)]
    asked = ["".join(r.choice("abcéz ²") for _ in range(r.randrange(25))) for _ in range(80)]
    langs, tables = ["de", "en", "fr"], {n: {} for n in range(5)}
    for text, lang in known:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            parts = {0: [w]} | {n: [f"<{w}>"[i:i + n] for i in range(len(w) + 3 - n)] if n > 1 else list(w) for n in range(1, 5)}
            for n, found in parts.items():
                for g in found:
                    tables[n].setdefault(g, {k: 0 for k in langs})[lang] += 1

    def rate(n, g, lang):
        return math.log((tables[n][g][lang] + 0.1) / (sum(c[lang] for c in tables[n].values()) + 0.1 * len(tables[n])))

    def score(text):
        total, any_word = dict.fromkeys(langs, 0.0), False
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            if not any(c.isalpha() for c in w):
                continue
            any_word = True
            rows = [(0, w)] if w in tables[0] else []
            for n in range(4, 0, -1):
                rows = rows or [(n, g) for g in ([f"<{w}>"[i:i + n] for i in range(len(w) + 3 - n)] if n > 1 else list(w)) if g in tables[n]]
            for lang in langs:
                total[lang] += sum(rate(n, g, lang) for n, g in rows) / len(rows) if rows else 0.0
        if not any_word:
            return "und", 0.0
        best = max(langs, key=lambda k: total[k])
        return best, 1 / sum(math.exp(total[k] - total[best]) for k in langs)

    fitted = language_id.fit_languages(spark.createDataFrame([(i, *x) for i, x in enumerate(known)], "url long, text string, lang string"))
    for text in asked:
        lang, share = fitted.predict(text)
        want, want_share = score(text)
        assert abs(share - want_share) < 1e-9 and (lang == want or abs(share - 1 / 2) < 1e-9 or abs(share - 1 / 3) < 1e-9)


def test_votes_of_neighbours_against_all_cosines(spark):
    """The score from all examples: cosines of whole TF-IDF vectors, the seven nearest, distance-weighted votes."""
    r = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(r.choice(words[:30] if i % 3 else words[10:]) for _ in range(r.randrange(1, 20))), "published" if i % 3 else "hidden") for i in range(60)]
    pages = spark.createDataFrame(rows, "url long, text string, status string")
    model = toxic_neighbours.fit_examples(pages.select("url", "text"), pages.select("url", "status"))
    asked = [" ".join(r.choice(words) for _ in range(12)) for _ in range(20)]
    weight = dict(zip(model.vocabulary.terms.split("\n"), model.vocabulary.weight))
    text_of, hidden_of = {u: t for u, t, _ in rows}, {u: s == "hidden" for u, _, s in rows}

    def vector(text):
        v = {t: (1 + math.log(n)) * weight[t] for t, n in toxic_neighbours.terms_of(text).items() if t in weight}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    examples = {u: vector(text_of[u]) for u in model.urls}
    for text, (score, near) in zip(asked, model.score(asked)):
        mine = vector(text)
        cosines = sorted(((round(sum(x * v.get(t, 0.0) for t, x in mine.items()), 9), -i, u) for i, (u, v) in enumerate((u, examples[u]) for u in model.urls)), reverse=True)[:model.k]
        assert [round(c, 9) for c, _ in near] == pytest.approx([c for c, _, _ in cosines], abs=1e-8)
        votes = [(model.class_weight[int(hidden_of[u])] / (1.05 - min(1.0, c)), hidden_of[u]) for c, _, u in cosines]
        want = (model.prior * model.base + sum(v for v, h in votes if h)) / (model.prior + sum(v for v, _ in votes))
        assert score == pytest.approx(want, abs=1e-6)


def test_block_max_is_exact():
    r = np.random.default_rng(3)
    vectors = []
    for _ in range(700):
        p = np.sort(r.choice(40, r.integers(1, 6), replace=False))
        w = r.choice([0.5, 1.0, 2.0], len(p))
        vectors.append((p, w / np.sqrt((w * w).sum())))
    index = toxic_neighbours.BlockMaxIndex(vectors, 40)
    dense = np.zeros((700, 40))
    for i, (p, w) in enumerate(vectors):
        dense[i, p] = w
    for p, w in vectors[:60]:
        cosine = dense[:, p] @ w
        best = sorted(((round(c, 9), -i) for i, c in enumerate(cosine) if c > 0), reverse=True)[:10]
        got = index.nearest(p, w, 10)
        assert [(round(c, 9), -i) for c, i in got] == best
    assert index.nearest(np.zeros(0, np.int64), np.zeros(0), 10) == []
    assert toxic_neighbours.BlockMaxIndex([], 0).nearest(np.array([0]), np.array([1.0]), 3) == []


def reviewed(spark, bad, n=240):
    r = random.Random(4)
    rows = []
    for i in range(n):
        words = [f"w{r.randrange(300)}" for _ in range(60)]
        hidden = i % 6 == 0
        if hidden:
            words[r.randrange(60)] = r.choice(bad)
        rows.append((i, " ".join(words), "hidden" if hidden else "published"))
    return spark.createDataFrame(rows, "url long, text string, status string")


def test_toxicity(spark):
    frame = reviewed(spark, ["awful", "horridness", "horridly"])
    learn = frame.filter("url < 160").select("url", "status")
    m = toxic_neighbours.fit_examples(frame.select("url", "text"), learn.unionByName(learn.limit(5)))
    got = {x["url"]: x for x in toxic_neighbours.score_pages(frame, m).collect()}
    for x in frame.filter("url >= 160").collect():
        assert (got[x["url"]]["score"] >= 0.3) == (x["status"] == "hidden")
        assert bool(got[x["url"]]["evidence"]) == (x["status"] == "hidden")
    odd = toxic_neighbours.score_pages(odd_pages(spark), m).collect()
    assert len(odd) == len(ODD) + 1 and all(0 <= x["score"] < 0.3 for x in odd)
    assert toxic_neighbours.score_pages(no_pages(spark), m).count() == 0


def test_toxicity_without_reviews(spark):
    m = toxic_neighbours.fit_examples(odd_pages(spark), spark.createDataFrame([(1, None), (2, "review")], "url long, status string"))
    assert {x["score"] for x in toxic_neighbours.score_pages(odd_pages(spark), m).collect()} == {0.0}


def test_toxicity_of_copies_without_telling_words(spark):
    frame = reviewed(spark, ["awful", "horridness", "horridly"]).filter("url < 160")
    rare = "one sentence that holds none of those terms"
    more = spark.createDataFrame([(900, rare, "hidden"), (901, rare, None), (902, "those terms are sold here", None), (903, "unheard", None)], frame.schema)
    frame = frame.unionByName(more)
    m = toxic_neighbours.fit_examples(frame.select("url", "text"), frame.select("url", "status"))
    got = {x["url"]: x for x in toxic_neighbours.score_pages(frame, m).collect()}
    assert got[901]["score"] >= 0.3 and [e["url"] for e in got[901]["evidence"]] == [900] and got[901]["evidence"][0]["cosine"] > 1 - 1e-9
    assert [e["url"] for e in got[902]["neighbours"]] == [900] and got[903]["neighbours"] == [] and got[903]["score"] == m.base
    assert all(len(x["neighbours"]) == 7 for x in got.values() if x["url"] < 160)
    assert len(m.urls) == 161


def test_block_max_with_frequent_and_rare_terms():
    r, n = np.random.default_rng(3), 900
    vectors = []
    for _ in range(1500):
        p = np.unique(np.minimum(n - 1, r.zipf(1.3, 80) - 1))
        w = r.random(len(p)) + 0.01
        vectors.append((p, w / np.sqrt((w * w).sum())))
    index = toxic_neighbours.BlockMaxIndex(vectors, n)
    dense = np.zeros((1500, n))
    for i, (p, w) in enumerate(vectors):
        dense[i, p] = w
    assert 0 < len(index.matrix) < n
    for (p, w), got in zip(vectors[:80], index.nearest_of(vectors[:80], 7)):
        best = sorted(((round(c, 9), -i) for i, c in enumerate(dense[:, p] @ w) if c > 0), reverse=True)[:7]
        assert [(round(c, 9), -i) for c, i in got] == best


def test_quality(spark):
    r = random.Random(6)
    rows = []
    for i in range(300):
        words = [f"w{r.randrange(500)}" for _ in range(r.randrange(5, 90))]
        poor = i % 7 == 0
        text = " ".join([words[0]] * len(words)) if poor and i % 2 else " ".join(w.upper() + "!!" for w in words) if poor else " ".join(words) + "."
        rows.append((i, text, "review" if poor else "published"))
    frame = spark.createDataFrame(rows, "url long, text string, status string")
    learn = frame.filter("url < 200").select("url", "status").unionByName(spark.createDataFrame([(210, "hidden"), (211, None)], "url long, status string"))
    m = quality_ranking.fit_ranking(frame.select("url", "text"), learn)
    got = {x["url"]: x["score"] for x in quality_ranking.rank_pages(frame, m).collect()}
    right = [(got[i] >= 0.5) == (s == "published") for i, _, s in rows if i >= 200]
    assert np.mean(right) > 0.97
    odd = quality_ranking.rank_pages(odd_pages(spark), m).collect()
    assert len(odd) == len(ODD) + 1 and all(0 <= x["score"] <= 1 for x in odd)
    assert quality_ranking.rank_pages(no_pages(spark), m).count() == 0


def test_quality_counts_every_review(spark, monkeypatch):
    """Groups of any size: all reviewed pages make the scale, each of them meets others, and the border is the exact quantile."""
    monkeypatch.setattr(quality_ranking, "GROUP", 10)
    r = random.Random(8)
    rows = [(i, " ".join(("W!" if r.random() < (0.6 if i % 9 == 0 else 0.2) else "w") + str(r.randrange(99)) for _ in range(r.randrange(5, 60))), "review" if i % 9 == 0 else "published")
            for i in range(400)]
    frame = spark.createDataFrame(rows, "url long, text string, status string")
    m = quality_ranking.fit_ranking(frame.select("url", "text"), frame.select("url", "status"))
    x = np.array([quality_ranking.features_of(t) for _, t, _ in rows])
    assert np.allclose(m.mean, x.mean(axis=0)) and np.allclose(m.scale, np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1))
    poor = sum(s == "review" for *_, s in rows)
    s = np.sort(m.strengths(x))
    assert abs(m.border - (s[poor - 1] + s[poor]) / 2) < 1e-12
    features = spark.createDataFrame([(i, s == "published", v) for (i, _, s), v in zip(rows, x.tolist())], "url long, good boolean, features array<double>")
    groups = quality_ranking._groups(features, False, poor, len(rows) - poor).collect()
    width = len(m.mean)
    met = [{tuple(g[c][k:k + width]) for g in groups for k in range(0, len(g[c]), width)} for c in ("few", "many")]
    assert met == [{tuple(v) for v, (*_, s) in zip(x.tolist(), rows) if s == status} for status in ("review", "published")]
    assert len(groups) > 20 and all(len(g["few"]) <= 30 * width and len(g["many"]) <= 30 * width for g in groups)


def test_border_of_many_equal_strengths(spark):
    values = [0.0] * 500 + [1e-12] * 3 + [2.0, 5e9]
    frame = spark.createDataFrame([(v,) for v in values], "strength double")
    for poor in (1, 499, 500, 503, 504):
        assert quality_ranking._border(frame, poor) == (values[poor - 1] + values[min(poor, len(values) - 1)]) / 2


def test_quality_with_one_status(spark):
    for status, passes in (("published", True), ("review", False)):
        m = quality_ranking.fit_ranking(odd_pages(spark), spark.createDataFrame([(4, status), (5, status)], "url long, status string"))
        assert {x["score"] >= 0.5 for x in quality_ranking.rank_pages(odd_pages(spark), m).collect()} == {passes}
