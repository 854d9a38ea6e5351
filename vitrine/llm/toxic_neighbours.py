"""Toxicity of page texts from the nearest reviewed examples.

Examples are pages that reviewers have hidden or published. Their vocabulary is all their words, and the first letters of longer words; vectors
are TF-IDF over it, scaled to length 1. A term that occurs clearly more often in one class than in the other weighs more, none is left out.
The nearest examples by cosine are found exactly with a block-max index: examples lie in blocks of 64, and each term keeps its largest weight in each block.
A
page's bound for a block is the product with those, plus what the most frequent terms give there at most, which a matrix tells for many pages at once;
blocks are read from the highest bound on until none can still beat the worst neighbour kept, and what may be among the nearest is compared in full. Neighbours vote, nearer ones with more weight, and
classes are weighted back to their share among all reviews, so that the score is a probability. All neighbours are returned, and the hidden ones
among them as evidence.
"""
from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm import scratch
from vitrine.llm.columns import in_small_batches, latest, sliced, texts_of, with_columns

WORD = re.compile(r"[^\W\d_]+")
STEM = 5
BLOCK = 64
#: So many of the most frequent terms, of those that one in so many examples holds, are a matrix instead of lists. Results do not depend on it.
COMMON, FREQUENT = 768, 32
#: The matrix is in single precision: cosines from it are off by less than this. What may be among the nearest is compared again in full.
OFF = 1e-4


def terms_of(text: str) -> Counter:
    """Words and, marked with a star, the first letters of longer ones, with their number."""
    words = Counter(WORD.findall(text.lower()))
    for word, n in list(words.items()):
        if len(word) > STEM:
            words[word[:STEM] + "*"] += n
    return words


@dataclass
class Vocabulary:
    """``terms``, one a line, and the ``weight`` of each: inverse document frequency times how much it tells. Both are flat, so that they travel
    in little memory; the place of each term is found where it is used."""

    terms: str
    weight: np.ndarray

    @cached_property
    def place(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.terms.split("\n"))} if self.terms else {}

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places in ascending order and how often each term occurs."""
        place, counts = self.place.get, {}
        for word, n in Counter(WORD.findall(text.lower())).items():
            if (p := place(word)) is not None:
                counts[p] = n
            if len(word) > STEM and (p := place(word[:STEM] + "*")) is not None:
                counts[p] = counts.get(p, 0) + n
        places, often = np.fromiter(counts.keys(), np.int32, len(counts)), np.fromiter(counts.values(), np.int32, len(counts))
        order = np.argsort(places)
        return places[order], often[order]

    def weights(self, places: np.ndarray, often: np.ndarray) -> np.ndarray:
        return (1 + np.log(often)) * self.weight[places]

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places in ascending order and weights, of length 1 or empty."""
        places, often = self.counts(text)
        weights = self.weights(places, often)
        return places, weights / np.sqrt((weights * weights).sum()) if len(places) else weights


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``size`` of them, one after the other."""
    return np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)


class BlockMaxIndex:
    """Unit vectors in example order. The most frequent terms are a matrix, the others inverted lists with the largest weight of each term in each
    block that holds it."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        self._build(np.array([len(p) for p, _ in vectors], np.int64), np.concatenate([np.zeros(0, np.int32), *(p for p, _ in vectors)]).astype(np.int32),
                    np.concatenate([np.zeros(0), *(w for _, w in vectors)]), terms)

    @classmethod
    def of(cls, lengths: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int) -> "BlockMaxIndex":
        """From all vectors one after the other, and how many terms each has."""
        index = cls.__new__(cls)
        index._build(lengths, term, weight, terms)
        return index

    def _build(self, lengths: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: int) -> None:
        self.lengths, self.term, self.weight, self.terms, self.size = lengths, term, weight, terms, len(lengths)
        self.blocks = -(-self.size // BLOCK)
        self.begins = np.cumsum(lengths) - lengths
        held_by = np.bincount(term, minlength=terms)
        common = np.argsort(-held_by, kind="stable")[:COMMON]
        common = common[held_by[common] * FREQUENT > self.size]
        self.column = np.full(terms, -1, np.int32)
        self.column[common] = np.arange(len(common))
        example, column = np.repeat(np.arange(self.size, dtype=np.int32), lengths), self.column[term]
        self.matrix = np.zeros((len(common), self.blocks * BLOCK), np.float32)
        self.matrix[column[column >= 0], example[column >= 0]] = weight[column >= 0]
        rest = np.flatnonzero(column < 0)
        rest = rest[np.argsort(term[rest], kind="stable")]
        held, self.example, self.listed = term[rest], example[rest], weight[rest].astype(np.float32)
        block = self.example // BLOCK
        begins = np.flatnonzero(np.concatenate([[True], (held[1:] != held[:-1]) | (block[1:] != block[:-1])])) if len(held) else np.zeros(0, np.int64)
        self.block, self.most = block[begins], np.maximum.reduceat(self.listed, begins) if len(begins) else np.zeros(0, np.float32)
        #: List i, of one term in one block: from starts[i] to the next. Lists of term t: from lists[t] to the next.
        self.starts = np.append(begins, len(held))
        self.lists = np.searchsorted(held[begins], np.arange(terms + 1))
        self.page = np.zeros(terms)

    def nearest(self, places: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The ``k`` examples of the largest positive cosine, ties by example number."""
        return self.nearest_of([(places, weights)], k)[0]

    def nearest_of(self, pages: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        """``nearest`` of several pages: their frequent terms are one product of matrices."""
        if not self.size:
            return [[] for _ in pages]
        out: list[list[tuple[float, int]]] = []
        for at in range(0, len(pages), BLOCK):
            few = pages[at:at + BLOCK]
            asked = np.zeros((len(few), len(self.matrix)), np.float32)
            for i, (places, weights) in enumerate(few):
                column = self.column[places]
                asked[i, column[column >= 0]] = weights[column >= 0]
            out += [self._nearest(places, weights, common, k) for (places, weights), common in zip(few, asked @ self.matrix)]
        return out

    def _nearest(self, places: np.ndarray, weights: np.ndarray, common: np.ndarray, k: int) -> list[tuple[float, int]]:
        if not len(places):
            return []
        rare = self.column[places] < 0
        own, force = places[rare], weights[rare]
        many = self.lists[own + 1] - self.lists[own]
        lists, force = _ranges(self.lists[own], many), np.repeat(force, many)
        block = self.block[lists]
        bounds = common.reshape(-1, BLOCK).max(axis=1) + np.bincount(block, weights=force * self.most[lists], minlength=self.blocks)
        order = np.argsort(-bounds, kind="stable")
        order = order[:np.count_nonzero(bounds > 0)]
        found, scores, done, step = np.zeros(0, np.int64), np.zeros(0), 0, 8
        self.page[places] = weights
        while done < len(order) and (len(found) < k or bounds[order[done]] >= scores[-1] - OFF):
            read = order[done:done + step]
            if len(found) == k:
                read = read[bounds[read] >= scores[-1] - OFF]
            slot = np.full(self.blocks, -1)
            slot[read] = np.arange(len(read))
            here = np.flatnonzero(slot[block] >= 0)
            first, size = self.starts[lists[here]], self.starts[lists[here] + 1] - self.starts[lists[here]]
            rows = _ranges(first, size)
            example = self.example[rows]
            sums = common.reshape(-1, BLOCK)[read].ravel() + np.bincount(
                slot[example // BLOCK] * BLOCK + example % BLOCK, weights=np.repeat(force[here], size) * self.listed[rows], minlength=len(read) * BLOCK)
            # The best k of these and what single precision cannot tell from them, compared in full.
            least = max(0.0, np.partition(sums, -k)[-k] - 2 * OFF if k <= len(sums) else 0.0, scores[-1] - 2 * OFF if len(found) == k else 0.0)
            at = np.flatnonzero((sums >= least) & (sums > 0))
            more = read[at // BLOCK] * BLOCK + at % BLOCK
            exact = self._scores(more)
            found, scores = np.concatenate([found, more]), np.concatenate([scores, exact])
            keep = np.lexsort((found, -np.round(scores, 9)))[:k]
            found, scores = found[keep], scores[keep]
            done, step = done + step, 8 * step
        self.page[places] = 0.0
        return list(zip(scores.tolist(), found.tolist()))

    def _scores(self, examples: np.ndarray) -> np.ndarray:
        """Cosines of these examples with the page, over all their terms."""
        long = self.lengths[examples]
        rows = _ranges(self.begins[examples], long)
        return np.bincount(np.repeat(np.arange(len(examples)), long), weights=self.weight[rows] * self.page[self.term[rows]], minlength=len(examples))


@dataclass
class ToxicModel:
    """Examples as the places and counts of their terms, one after the other; the index is made from them where it is used."""

    vocabulary: Vocabulary
    lengths: np.ndarray
    term: np.ndarray
    often: np.ndarray
    urls: list
    hidden: np.ndarray
    class_weight: np.ndarray
    base: float
    k: int
    prior: float

    @cached_property
    def index(self) -> BlockMaxIndex:
        weight = self.vocabulary.weights(self.term, self.often)
        if len(self.lengths):
            weight /= np.repeat(np.sqrt(np.add.reduceat(weight * weight, np.cumsum(self.lengths) - self.lengths)), self.lengths)
        return BlockMaxIndex.of(self.lengths, self.term, weight, len(self.vocabulary.weight))

    def plain(self) -> tuple:
        """What is broadcast: strings, lists and arrays, which a worker can read without this package."""
        return ((self.vocabulary.terms, self.vocabulary.weight), self.lengths, self.term, self.often, self.urls, self.hidden, self.class_weight, self.base,
                self.k, self.prior)

    @classmethod
    def of(cls, plain: tuple) -> "ToxicModel":
        return cls(Vocabulary(*plain[0]), *plain[1:])

    def score(self, texts: list[str]) -> list[tuple[float, list[tuple[float, int]]]]:
        return [self._vote(near) for near in self.index.nearest_of([self.vocabulary.vector(t) for t in texts], self.k)]

    def _vote(self, near: list[tuple[float, int]]) -> tuple[float, list[tuple[float, int]]]:
        if not near:
            return self.base, []
        at = np.array([i for _, i in near])
        votes = self.class_weight[self.hidden[at]] / (0.05 + 1 - np.minimum(1.0, [c for c, _ in near]))
        return float((self.prior * self.base + votes @ self.hidden[at]) / (self.prior + votes.sum())), near


def fit_examples(crawled_pages: DataFrame, reviews: DataFrame, max_examples: int = 20_000, k: int = 7, prior: float = 1.0) -> ToxicModel:
    """Learn from ``crawled_pages(url, text)`` and ``reviews(url, status)``, status hidden or published; others teach nothing.

    ``max_examples`` bounds the sample: equally many of each status where there are enough, by lowest hash of the url, read whole. Terms
    are counted per task first, equal texts once; all terms and the examples' vectors come to the driver, so both are bounded by the sample.
    A term's weight is its inverse document frequency times the factor by which it is at least more frequent in one status than in the
    other: the lower bound of that factor, two standard errors off, and 1 for a term that tells nothing. A page without any known term gets the
    share of hidden among examples without one. Without reviews: 0.
    """
    known = reviews.filter(F.col("status").isin("hidden", "published")).select("url", (F.col("status") == "hidden").cast("int").alias("hidden"))
    known = known.groupBy("url").agg(F.max("hidden").alias("hidden"))
    sizes = {r["hidden"]: r["n"] for r in known.groupBy("hidden").agg(F.count(F.lit(1)).alias("n")).collect()}
    top, half = 1 << 30, max(1, max_examples // 2)
    cut = F.when(F.col("hidden") == 1, int(min(1.0, half / max(1, sizes.get(1, 0))) * top)).otherwise(
        int(min(1.0, half / max(1, sizes.get(0, 0))) * top))
    chosen = F.broadcast(scratch.settled(known.filter(F.pmod(F.xxhash64("url"), F.lit(top)) < cut)))  # at most max_examples narrow rows
    sample = scratch.table(in_small_batches(crawled_pages).select("url", "text").join(chosen, "url"), "toxic-examples")
    once = sample.dropDuplicates(["hidden", "text"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in sliced(batches):
            for hidden, text in zip(batch.column("hidden").to_pylist(), texts_of(batch)):
                tally[hidden].update(terms_of(text).keys())
        for hidden, terms in tally.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(terms), pa.string()), pa.array(list(terms.values()), pa.int64()),
                                              pa.array([hidden] * len(terms), pa.int32())], names=["term", "n", "hidden"])

    counts = {r["hidden"]: r["n"] for r in once.groupBy("hidden").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = max(1, counts.get(1, 0)), max(1, counts.get(0, 0))
    by_term = (once.select("hidden", "text").mapInArrow(count, "term string, n long, hidden int").groupBy("term")
               .agg(F.sum(F.when(F.col("hidden") == 1, F.col("n")).otherwise(0)).alias("d1"), F.sum(F.when(F.col("hidden") == 0, F.col("n")).otherwise(0)).alias("d0")))
    terms = by_term.orderBy("term").toArrow()
    d1, d0 = (np.asarray(terms.column(c).to_numpy(), float) for c in ("d1", "d0"))
    lift = np.abs(np.log((d1 + 0.5) / n1) - np.log((d0 + 0.5) / n0)) - 2 * np.sqrt(1 / (d1 + 0.5) + 1 / (d0 + 0.5))
    vocabulary = Vocabulary("\n".join(terms.column("term").to_pylist()), np.log(1 + (n1 + n0) / (d1 + d0)) * np.exp(np.maximum(0.0, lift)))

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            terms = latest("toxic-terms", key, lambda: Vocabulary(*known_terms.value))
            found = [terms.counts(t) for t in texts_of(batch)]
            yield with_columns(batch, ["url", "hidden"], places=pa.array([p.tobytes() for p, _ in found], pa.binary()),
                               often=pa.array([zlib.compress(n.tobytes(), 1) for _, n in found], pa.binary()))

    known_terms, key = sample.sparkSession.sparkContext.broadcast((vocabulary.terms, vocabulary.weight)), uuid.uuid4().hex
    schema = T.StructType([*sample.select("url", "hidden").schema.fields, T.StructField("places", T.BinaryType()), T.StructField("often", T.BinaryType())])
    rows = sample.select("url", "hidden", "text").mapInArrow(vectors, schema).orderBy("url").collect()
    sampled = Counter(r["hidden"] for r in rows)
    share = {c: sizes.get(c, 0) / max(1, sampled[c]) for c in (0, 1)}
    class_weight = np.array([share[0], share[1]]) / max(1e-12, share[0] + share[1])
    # Examples of like terms lie in one block, so that bounds are tight: by their strongest telling term, their most frequent one, and length.
    telling, held_by = np.where(lift > 0, vocabulary.weight, 0.0), d1 + d0

    def likeness(row: tuple) -> tuple:
        places = np.frombuffer(row["places"], np.int32)
        strong = (1 + np.log(counts_of(row))) * telling[places]
        return int(places[int(np.argmax(strong))]) if strong.any() else -1, int(places[int(np.argmax(held_by[places]))]), len(places), row["url"]

    def counts_of(row: tuple) -> np.ndarray:
        return np.frombuffer(zlib.decompress(row["often"]), np.int32)

    full = sorted((r for r in rows if r["places"]), key=likeness)
    blank = [r["hidden"] for r in rows if not r["places"]]
    hidden = np.array([r["hidden"] for r in full], np.int64)
    weight_of_blank = class_weight[blank] if blank else np.zeros(0)
    if blank:
        base = float((weight_of_blank @ np.array(blank)) / weight_of_blank.sum())
    else:
        base = float(sizes.get(1, 0) / max(1, sum(sizes.values())))
    lengths = np.array([len(r["places"]) // 4 for r in full], np.int64)
    term = np.frombuffer(b"".join(r["places"] for r in full), np.int32)
    often = np.concatenate([np.zeros(0, np.int32), *map(counts_of, full)])
    return ToxicModel(vocabulary, lengths, term, often, [r["url"] for r in full], hidden, class_weight, base, k, prior)


def score_pages(crawled_pages: DataFrame, model: ToxicModel) -> DataFrame:
    """``crawled_pages(url, text)`` -> ``(url, score, evidence, neighbours)``: neighbours holds the nearest examples' urls and cosines, evidence the hidden
    ones among them.

    Null and empty texts, and texts without a term of the vocabulary, get the base score and no neighbours. Repeated rows stay and are scored alike,
    texts are read whole, extra columns are not read, an empty table gives an empty result.
    """
    keep = in_small_batches(crawled_pages.select("url", "text"))
    shared, key = keep.sparkSession.sparkContext.broadcast(model.plain()), uuid.uuid4().hex
    url = keep.schema["url"]
    examples = T.ArrayType(T.StructType([T.StructField("url", url.dataType), T.StructField("cosine", T.DoubleType())]))
    schema = T.StructType([url, T.StructField("score", T.DoubleType()), T.StructField("evidence", examples), T.StructField("neighbours", examples)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = latest("toxic-model", key, lambda: ToxicModel.of(shared.value))
        for batch in sliced(batches):
            found = model.score(texts_of(batch))
            kind = pa.list_(pa.struct([("url", batch.schema.field("url").type), ("cosine", pa.float64())]))
            urls, hidden = model.urls, model.hidden
            near = [[{"url": urls[i], "cosine": c} for c, i in n] for _, n in found]
            proof = [[{"url": urls[i], "cosine": c} for c, i in n if hidden[i]] for _, n in found]
            yield with_columns(batch, ["url"], score=pa.array([s for s, _ in found], pa.float64()), evidence=pa.array(proof, kind),
                               neighbours=pa.array(near, kind))

    return keep.mapInArrow(run, schema)
