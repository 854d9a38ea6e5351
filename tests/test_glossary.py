"""A glossary by automaton must give what replacing phrase after phrase gives."""
import random
import time

import pytest
from pyspark.sql import functions as F

from vitrine.functions import glossary, language


def one_by_one(text, phrases):
    for source, target in sorted(phrases, key=lambda p: -len(p[0])):
        text = text.replace(source, f" {target} ") if source else text
    return text


@pytest.mark.parametrize("seed", range(30))
def test_same_as_one_by_one(seed):
    r = random.Random(seed)
    # Targets may hold sources, sources may hold spaces and be given twice.
    letters = "กข " if seed % 2 else "กขคabก"
    word = lambda n: "".join(r.choice(letters) for _ in range(r.randrange(1, n)))
    phrases = [(word(4), r.choice([word(4), "Chair", "x", ""])) for _ in range(12)]
    replace = glossary.Replacer(phrases)
    for _ in range(60):
        text = "".join(r.choice(letters + "กข") for _ in range(r.randrange(30)))
        assert replace(text) == one_by_one(text, phrases), (text, phrases)


def test_as_the_expression(spark):
    phrases = [("โต๊ะประชุม", "meeting table"), ("โต๊ะ", "table"), ("ที่นั่ง", "-seater"), ("กลม", "round")]
    texts = [None, "", "plain", "โต๊ะประชุม", "โต๊ะกลม 2 ที่นั่ง", "โต๊ะ ไม่รู้"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(glossary.translate_texts(F.col("t"), phrases).alias("a"), language.translate_phrases(F.col("t"), phrases).alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows] and rows[4]["a"] == "Table round 2-seater"
    assert df.select(glossary.replaced_phrases(F.col("t"), []).alias("a")).first()["a"] is None


def test_long_glossaries_cost_little_more():
    r = random.Random(1)
    words = list({"".join(r.choice("กขคงจฉชซ") for _ in range(r.randrange(4, 9))) for _ in range(20_000)})
    texts = ["".join(r.choice("กขคงจฉชซ ") for _ in range(3000)) for _ in range(20)]

    def seconds(phrases):
        replace, start = glossary.Replacer(phrases), time.perf_counter()
        out = [replace(t) for t in texts]
        return time.perf_counter() - start, out
    few, _ = seconds([(w, "a") for w in words[:20]])
    many, out = seconds([(w, "a") for w in words])
    assert out[0] == one_by_one(texts[0], [(w, "a") for w in words])
    assert many < 300 * few + 1  # a thousand times the phrases, most of which these texts do hold
