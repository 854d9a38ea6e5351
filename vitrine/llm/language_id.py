"""Language of a page by words first, with back-off to shorter and shorter character n-grams.

A word of the lexicon counts with its log frequency in each language. A word outside it is looked up by its n-grams
of the longest length for which at least one is known (four letters, then three, down to one; word ends are marked) and
counts with their mean log frequency. Frequencies come from a bounded sample of pages of known language, with all of its words; every page
is then read whole. The model is a few sorted arrays of 64-bit hashes with their scores, small enough for every task.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.columns import hand_back, in_small_batches, let_go, sliced, texts_of, with_columns

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
LONGEST = 4
#: Scores of unseen words that a worker keeps.
CACHE_WORDS = 50_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(word: str, n: int) -> Iterator[str]:
    marked = f"<{word}>" if n > 1 else word
    return (marked[i:i + n] for i in range(len(marked) - n + 1))


def hashed(text: str, n: int = 0) -> int:
    """Signed 64-bit hash of a word (0) or of an n-gram."""
    h = xxhash.xxh3_64_intdigest(text, seed=n)
    return h - (1 << 64) if h >> 63 else h


@dataclass
class LanguageModel:
    """``tables[0]`` has the words, ``tables[n]`` the n-grams: hashes in ascending order, and one log frequency per language for each."""

    langs: list[str]
    tables: dict[int, tuple[np.ndarray, np.ndarray]]
    seen: dict[str, np.ndarray | None] = field(default_factory=dict)

    def plain(self) -> tuple:
        """What is broadcast: lists, dicts and arrays, which a worker can read without this package. ``LanguageModel(*plain)`` is the model again."""
        return self.langs, self.tables

    def found(self, n: int, hashes: Iterable[int], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes the table has, and the rows of those."""
        keys, _ = self.tables[n]
        wanted = np.fromiter(hashes, np.int64, size)
        if not len(keys):
            return np.zeros(size, bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[at] == wanted
        return hit, at[hit]

    def back_off(self, word: str) -> np.ndarray | None:
        """Score of a word outside the lexicon; None without a letter."""
        if not any(c.isalpha() for c in word):
            return None
        for n in range(LONGEST, 0, -1):
            parts = list(grams(word, n))
            _, rows = self.found(n, (hashed(g, n) for g in parts), len(parts))
            if len(rows):
                return self.tables[n][1][rows].mean(axis=0)
        return np.zeros(len(self.langs))

    def unseen(self, word: str) -> np.ndarray | None:
        if word not in self.seen:
            if len(self.seen) >= CACHE_WORDS:
                self.seen.clear()
            self.seen[word] = self.back_off(word)
        return self.seen[word]

    def predict(self, text: str) -> tuple[str, float]:
        """Language and its share of the posterior, first in alphabetical order on a tie."""
        if not self.langs:
            return UNKNOWN, 0.0
        counts = Counter(words_of(text))
        times = np.fromiter(counts.values(), float, len(counts))
        hit, rows = self.found(0, map(hashed, counts), len(counts))
        total, scored = times[hit] @ self.tables[0][1][rows], len(rows)
        for word, n, known in zip(counts, times.tolist(), hit.tolist()):
            if not known and (score := self.unseen(word)) is not None:
                total += n * score
                scored += 1
        if not scored:
            return UNKNOWN, 0.0
        odds = np.exp(total - total.max())
        best = int(total.argmax())
        return self.langs[best], float(odds[best] / odds.sum())


def fit_languages(known_pages: DataFrame, max_pages: int = 20_000, smoothing: float = 0.1) -> LanguageModel:
    """Learn from ``known_pages(url, text, lang)``; rows without lang or text teach nothing.

    ``max_pages`` bounds the sample: of each language the pages with the lowest hash of their url, in equal share, read whole.
    Words are counted per task first. No known page: a model that answers ``und``.
    """
    known = in_small_batches(known_pages).select("url", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], {})
    share, top = max(1, max_pages // len(langs)), 1 << 30
    cut = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(int(min(1.0, share / sizes[k]) * top)))])
    sample = known.filter(F.pmod(F.xxhash64("url"), F.lit(top)) < cut[F.col("lang")])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[str, Counter] = {}
        for batch in sliced(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch)):
                tally.setdefault(lang, Counter()).update(words_of(text))
        for lang, words in tally.items():
            tables = {n: Counter() for n in range(LONGEST + 1)}
            for word, times in words.items():
                if any(c.isalpha() for c in word):
                    tables[0][word] = times
                for n in range(1, LONGEST + 1):
                    for g in grams(word, n):
                        tables[n][g] += times
            for n, found in tables.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array([n] * len(found), pa.int32()), pa.array([hashed(g, n) for g in found], pa.int64()),
                     pa.array(found.values(), pa.int64())], names=["lang", "kind", "h", "n"])

    totals = sample.select("lang", "text").mapInArrow(count, "lang string, kind int, h long, n long").groupBy("kind", "h", "lang").agg(F.sum("n").alias("n")).toArrow()
    kind, h, n = (totals.column(c).to_numpy() for c in ("kind", "h", "n"))
    of = np.searchsorted(np.array(langs, object), totals.column("lang").to_numpy(zero_copy_only=False)) if len(h) else np.zeros(0, np.int64)
    tables = {}
    for k in range(LONGEST + 1):
        keys, at = np.unique(h[kind == k], return_inverse=True)
        counts = np.zeros((len(keys), len(langs)))
        counts[at, of[kind == k]] = n[kind == k]
        rates = (counts + smoothing) / (counts.sum(axis=0) + smoothing * max(1, len(keys)))
        tables[k] = keys, np.log(rates)
    return LanguageModel(langs, tables)


def identify_languages(crawled_pages: DataFrame, model: LanguageModel) -> DataFrame:
    """``crawled_pages(url, text)`` -> ``(url, lang_pred, score)``, one row per input row, repeated rows included.

    ``lang_pred`` is ``und`` with score 0 for a null or empty text, one without a letter, or an empty model. A text
    whose letters the model has never seen gets the first language with an even score. Texts of any length are read whole; extra
    columns are not read; an empty table gives an empty result.
    """
    keep = in_small_batches(crawled_pages.select("url", "text"))
    shared = keep.sparkSession.sparkContext.broadcast(model.plain())
    schema = T.StructType([keep.schema["url"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        known = LanguageModel(*shared.value)
        for batch in sliced(batches):
            found = [known.predict(t) for t in texts_of(batch)]
            yield with_columns(batch, ["url"], lang_pred=pa.array([f[0] for f in found], pa.string()),
                               score=pa.array([f[1] for f in found], pa.float64()))
        del known
        hand_back()

    return keep.mapInArrow(run, schema)


def with_language(pages: DataFrame, model: LanguageModel) -> DataFrame:
    """``(page, lang_pred, score)`` with the whole row of ``pages`` as the struct ``page``, so that no column name clashes."""
    whole = in_small_batches(pages).select(F.struct(*[pages[c] for c in pages.columns]).alias("page"))
    shared = pages.sparkSession.sparkContext.broadcast(model.plain())
    schema = T.StructType([whole.schema["page"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        known = LanguageModel(*shared.value)
        for batch in sliced(batches):
            found = [known.predict(t or "") for t in batch.column("page").field("text").to_pylist()]
            yield with_columns(batch, ["page"], lang_pred=pa.array([f[0] for f in found], pa.string()),
                               score=pa.array([f[1] for f in found], pa.float64()))
        del known
        hand_back()

    return whole.mapInArrow(run, schema)
