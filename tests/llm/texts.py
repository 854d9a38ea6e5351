"""Small tables for the tests of the operators."""
from __future__ import annotations

import random

ODD = [None, "", " \n\t ", "...", "word", "same text here", "same text here", "Ünïcode ß 漢字 😀", "x" * 3000, "long words again and " * 3000]


def odd_pages(spark):
    """Nulls, empty and very long texts, ties, a repeated row, and extra columns whose names the operators use inside."""
    rows = [(i, t, "a", 1, "b", 2.0) for i, t in enumerate(ODD)] + [(6, "same text here", "a", 1, "b", 2.0)]
    return spark.createDataFrame(rows, "url long, text string, digest string, n int, component string, score double")


def no_pages(spark):
    return spark.createDataFrame([], "url long, text string")


def invented(seed: int, words: int, lexicon: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(lexicon)}x" for _ in range(words))


def pages(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "url long, text string")
