"""Quality of page texts by Bradley-Terry ranking.

Reviewers do not give marks; a published page is preferred to one sent to review. With x the features of a text and s = w.x its
strength, page i beats page j with probability 1 / (1 + exp(s_j - s_i)): logistic loss on feature differences, no intercept.
Strengths only order pages, so the border between the two classes is a quantile of the strengths of the reviewed sample, the one
that leaves as many below as reviewers sent back. The score is the logistic function of the distance from that border.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm import scratch
from vitrine.llm.columns import in_small_batches, sliced, texts_of, with_columns

FEATURES = ["log_words", "word_length", "long_words", "distinct", "repeats", "pairs", "top_word", "upper", "digits", "marks",
            "bang", "bars", "symbols", "commas", "stops", "lines", "line_repeats", "empty"]
_CLASSES = {"digits": "0123456789", "bang": "!?", "bars": "|", "symbols": "$%&*#@~^=+<>{}[]\\_", "commas": ",;:", "stops": ".",
            "marks": "\"'()/-"}
_LETTERS = re.compile(r"[^\W\d_]")


def features_of(text: str) -> list[float]:
    """Shape of a whole text: word lengths and repetition, share of capitals, digits and kinds of marks, repeated lines."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    counts = Counter(words)
    pairs = set(zip(words, words[1:]))
    chars = len(text)
    capital = sum(map(str.isupper, words))
    lines = [x for x in text.split("\n") if x]
    seen = {k: sum(map(text.count, marks)) / n for k, marks in _CLASSES.items()}
    lengths = list(map(len, words))
    out = {"log_words": np.log(n), "word_length": min(30.0, sum(lengths) / n), "long_words": sum(x > 20 for x in lengths) / n,
           "distinct": len(counts) / n ** 0.8, "repeats": sum(a == b for a, b in zip(words, words[1:])) / n,
           "pairs": len(pairs) / n, "top_word": max(counts.values()) / n, "upper": capital / n,
           "lines": len(lines) / n, "line_repeats": 1 - len(set(lines)) / max(1, len(lines)), "empty": (chars - sum(lengths)) / n / 10}
    out |= {k: min(3.0, v) for k, v in seen.items()}
    return [float(out[k]) for k in FEATURES]


@dataclass
class Ranking:
    """``weights`` on standardised features, and the ``border`` strength."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    border: float

    def strengths(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.scale, -8, 8) @ self.weights


def feature_table(crawled_pages: DataFrame) -> DataFrame:
    """``(url, features)`` of every page, over its whole text."""
    keep = in_small_batches(crawled_pages.select("url", "text"))
    schema = T.StructType([keep.schema["url"], T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield with_columns(batch, ["url"], features=pa.array([features_of(t) for t in texts_of(batch)], pa.list_(pa.float64())))

    return keep.mapInArrow(run, schema)


#: Reviewed pages of each status that meet in one group.
GROUP = 2_000


def fit_ranking(crawled_pages: DataFrame, reviews: DataFrame, pairs_per_page: int = 10, penalty: float = 1e-3, steps: int = 50) -> Ranking:
    """Learn from ``crawled_pages(url, text)`` and ``reviews(url, status)``; published beats review, other statuses teach nothing.

    Every reviewed page counts, with the features of its whole text. Pages of both statuses are dealt by url into groups, each page of the more frequent status
    to one, each of the rarer to as many as are needed for all groups to hold about ``GROUP`` of it; there each page of the more frequent status meets
    ``pairs_per_page`` of the other, in turn. Tasks sum slopes over their groups' pairs; only sums of the features' size come to the driver, once for each Newton
    step. The border is the exact quantile over all reviewed pages. With one status only, every page has strength 0 and the border makes all of that status.
    """
    known = reviews.select("url", (F.col("status") == "published").alias("good")).filter(F.col("status").isin("published", "review")).dropDuplicates(["url"])
    n = len(FEATURES)
    rows = scratch.table(feature_table(crawled_pages).join(known, "url").select("url", "good", "features"), "reviewed")  # features travel, texts do not
    sizes = {r["good"]: r["n"] for r in rows.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, poor = sizes.get(True, 0), sizes.get(False, 0)
    if not good or not poor:
        return Ranking(np.zeros(n), np.ones(n), np.zeros(n), 1.0 if poor else -1.0)
    feature = [F.col("features")[i] for i in range(n)]
    moments = rows.agg(*[F.avg(f) for f in feature], *[F.stddev_pop(f) for f in feature]).first()
    mean, scale = np.array(moments[:n], float), np.array(moments[n:], float)
    ranking = Ranking(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(n), 0.0)
    groups = _groups(rows, good < poor, min(good, poor), max(good, poor))
    ranking.weights = _fit_pairs(groups, ranking, good < poor, pairs_per_page, penalty, steps)
    ranking.border = _border(_strengths(rows.select("features"), ranking), poor)
    return ranking


def _groups(rows: DataFrame, few_good: bool, few: int, many: int) -> DataFrame:
    """``(group, few, many)``: features of the pages of the rarer and of the more frequent status that meet, in order of their urls, one after the other."""
    parts = -(-few // GROUP)
    groups = max(parts, -(-many // GROUP))
    dealt, is_few = F.xxhash64("url"), F.col("good") == few_good
    at = F.when(is_few, F.sequence(F.pmod(dealt, F.lit(parts)), F.lit(groups - 1).cast("long"), F.lit(parts).cast("long"))).otherwise(F.array(F.pmod(dealt, F.lit(groups))))
    listed = lambda test: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("url", "features")))), lambda r: r["features"]))
    return scratch.table(rows.withColumn("group", F.explode(at)).groupBy("group").agg(listed(is_few).alias("few"), listed(~is_few).alias("many")), "groups")


def _fit_pairs(groups: DataFrame, ranking: Ranking, few_good: bool, pairs_per_page: int, penalty: float, steps: int) -> np.ndarray:
    """Newton steps on the penalised logistic loss of strength differences, summed over all groups."""
    n = len(ranking.mean)
    standard = lambda row: np.clip((np.asarray(row, float).reshape(-1, n) - ranking.mean) / ranking.scale, -8, 8)
    w = np.zeros(n)
    for _ in range(steps):
        def sums(batches: Iterable[pa.RecordBatch], w: np.ndarray = w) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + n + n * n)
            for batch in batches:
                for i in range(batch.num_rows):
                    few, many = (standard(batch.column(c)[i].values.to_numpy(zero_copy_only=False)) for c in ("few", "many"))
                    for turn in range(pairs_per_page if len(few) else 0):
                        met = few[(np.arange(len(many)) * pairs_per_page + turn) % len(few)]
                        diff = met - many if few_good else many - met
                        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
                        total += np.concatenate([[len(diff)], diff.T @ p, ((diff * (p * (1 - p))[:, None]).T @ diff).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])

        total = np.sum([r["sums"] for r in groups.select("few", "many").mapInArrow(sums, "sums array<double>").collect()], axis=0)  # one row a task
        grad = total[1:1 + n] / total[0] - penalty * w
        hess = total[1 + n:].reshape(n, n) / total[0] + penalty * np.eye(n)
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _strengths(rows: DataFrame, ranking: Ranking) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([pa.array(ranking.strengths(x))], names=["strength"])

    return rows.mapInArrow(run, "strength double")


def _border(strengths: DataFrame, poor: int, bins: int = 1_000) -> float:
    """Midway between the ``poor``-th lowest strength and the next, exactly: counts by bins of values, narrowed to one value."""
    strengths = scratch.table(strengths, "strengths")
    lowest, highest, n = strengths.agg(F.min("strength"), F.max("strength"), F.count("strength")).first()

    def ranked(rank: int) -> float:
        low, high, below = lowest, highest, 0
        while low < high:
            width = (high - low) / bins
            at = F.floor((F.col("strength") - low) / width) if width > 0 else F.col("strength")
            within = strengths.filter(F.col("strength").between(low, high))
            for r in within.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("strength").alias("low"), F.max("strength").alias("high")).orderBy("low").collect():
                if below + r["n"] >= rank:
                    low, high = r["low"], r["high"]
                    break
                below += r["n"]
        return low

    return (ranked(poor) + ranked(min(poor + 1, n))) / 2


def rank_pages(crawled_pages: DataFrame, ranking: Ranking) -> DataFrame:
    """``crawled_pages(url, text)`` -> ``(url, score, strength)``: score 0 to 1, 0.5 and more above the border.

    Null and empty texts have the features of a text without words and are scored by them. Repeated rows are scored
    alike and stay, texts are read whole, extra columns are not read, an empty table gives an empty result.
    """
    schema = T.StructType([crawled_pages.schema["url"], T.StructField("score", T.DoubleType()), T.StructField("strength", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            strength = ranking.strengths(np.array([features_of(t) for t in texts_of(batch)]).reshape(-1, len(FEATURES)))
            score = 1 / (1 + np.exp(-np.clip(strength - ranking.border, -30, 30)))
            yield with_columns(batch, ["url"], score=pa.array(score), strength=pa.array(strength))

    return in_small_batches(crawled_pages.select("url", "text")).mapInArrow(run, schema)
