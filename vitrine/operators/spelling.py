"""Word statistics over large text: frequencies, skeleton dictionary, spelling choice, unknown share."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.textclean import is_mark_subsequence, skeleton, tone_sequence

WORD_SPLIT = r"[^\p{L}\p{M}\p{N}]+"
MAX_WORD = 24


def words(df: DataFrame, text: str, keep: list[str], word: str = "token", split: str = WORD_SPLIT,
          lower: bool = True) -> DataFrame:
    """One row per word of the whole text."""
    source = F.lower(F.col(text)) if lower else F.col(text)
    return (df.select(*keep, F.explode(F.split(source, split)).alias(word)).filter(F.col(word) != ""))


def word_frequency(tokens: DataFrame, word: str = "token", out: str = "freq") -> DataFrame:
    """Occurrences per word; combined map-side, so a very common word costs one row per task."""
    return tokens.groupBy(word).agg(F.count(F.lit(1)).alias(out))


def dictionary_index(dictionary: DataFrame, word: str = "word") -> DataFrame:
    """Dictionary words (1 to 24 characters) with their skeleton."""
    return (
        dictionary.select(word).filter(F.length(word).between(1, MAX_WORD)).distinct()
        .withColumn("skeleton", skeleton(F.col(word)))
    )


def skeleton_choice(freq: DataFrame, word: str, count: str, key: Column) -> DataFrame:
    """Most frequent spelling per skeleton (ties: spelling that sorts first), with the number of spellings."""
    return (
        freq.withColumn("skeleton", key).groupBy("skeleton").agg(
            F.min_by(word, F.struct(-F.col(count), F.col(word))).alias("spelling"),
            F.count(F.lit(1)).alias("spellings"), F.sum(count).alias("occurrences"))
    )


def choose_spelling(tokens: DataFrame, index: DataFrame, freq: DataFrame, token: str = "token",
                    word: str = "word", reliable_vowels: bool = True) -> DataFrame:
    """Best dictionary spelling for every distinct token: (token, spelling).

    Candidates share the skeleton. Those consistent with the marks that survived are preferred, then, where
    the vowels can be trusted, those with the same number of sara am; the rest is decided by equality with
    the token, frequency and fewer marks. Tokens without a candidate keep their spelling. Distinct tokens
    are matched, so repeated words cost nothing, and one aggregate per token picks the winner.
    """
    distinct = tokens.select(token).distinct().withColumn("skeleton", skeleton(F.col(token)))
    candidates = distinct.join(index, "skeleton", "left").join(
        freq.select(F.col("token").alias(word), F.col("freq").alias("__f")), word, "left")
    t, c = F.col(token), F.coalesce(F.col(word), F.col(token))
    am = lambda s: F.length(F.regexp_replace(s, "[^\u0e33]", ""))
    consistent = is_mark_subsequence(tone_sequence(t), tone_sequence(c))
    same_vowels = (am(t) == am(c)) if reliable_vowels else F.lit(True)
    # Consistency comes first; among equally consistent ones the vowel count, then the score.
    order = F.struct(~consistent, ~same_vowels, c != t, -F.coalesce(F.col("__f"), F.lit(0)),
                     F.length(tone_sequence(c)), c)
    return candidates.groupBy(token).agg(F.min_by(c, order).alias("spelling"))


def word_counts(tokens: DataFrame, keep: list[str], token: str = "token") -> DataFrame:
    """(keep, token, n): the words of each document once. What follows joins these, so a word repeated in a
    document is one row, and the most common word has at most one row per document."""
    return tokens.groupBy(*keep, token).agg(F.count(F.lit(1)).alias("n"))


def frequency_of_counts(counts: DataFrame, token: str = "token") -> DataFrame:
    return counts.groupBy(token).agg(F.sum("n").alias("freq"))


def _marked(counts: DataFrame, known: DataFrame, token: str) -> DataFrame:
    """Counts with ``known``. The dictionary side has one row per word, so where a very common word fills a
    join partition, adaptive execution splits that partition and repeats the one row."""
    marks = known.select(token).distinct().withColumn("known", F.lit(True))
    return counts.join(marks, token, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def unknown_ratio(counts: DataFrame, known: DataFrame, keep: list[str], token: str = "token") -> DataFrame:
    """Share of characters in words missing from ``known``, per ``keep``; ``counts`` as from word_counts."""
    chars = F.length(token) * F.col("n")
    return _marked(counts, known, token).groupBy(*keep).agg(
        F.sum(chars).cast("long").alias("chars"),
        F.sum(F.when(~F.col("known"), chars).otherwise(0)).cast("long").alias("unknown_chars"),
    ).withColumn("unknown_ratio", F.col("unknown_chars") / F.col("chars"))


def name_is_readable(counts: DataFrame, vocabulary: DataFrame, keep: list[str], token: str = "token",
                     share: float = 0.9, digits: str = "[\u0e50-\u0e59]") -> DataFrame:
    """(keep, readable): at least ``share`` of the words in the vocabulary and no native digits."""
    good = F.sum(F.when(F.col("known"), F.col("n")).otherwise(0))
    return (
        _marked(counts, vocabulary, token).groupBy(*keep)
        .agg((good / F.sum("n")).alias("__share"), F.max(F.col(token).rlike(digits)).alias("__digits"))
        .select(*keep, ((F.col("__share") >= share) & ~F.col("__digits")).alias("readable"))
    )


def repair_lines(lines: DataFrame, keys: list[str], line: str, index: DataFrame, freq: DataFrame,
                 reliable_vowels: bool = True, script: str = "\u0e00-\u0e7f") -> DataFrame:
    """Lines with every word of the damaged script in its best dictionary spelling.

    Lines are cut into runs of the script and what stands between; distinct runs are matched once and put
    back by their place. Whole runs are words here: text that is not spaced needs a segmenter before.
    """
    cut = F.split(F.col(line), f"(?<=[{script}])(?![{script}])|(?<![{script}])(?=[{script}])")
    pieces = lines.select(*lines.columns, F.posexplode(cut).alias("__at", "token"))
    runs = pieces.filter(F.col("token").rlike(f"[{script}]")).select("token")
    chosen = choose_spelling(runs, index, freq, reliable_vowels=reliable_vowels)
    mended = pieces.join(chosen, "token", "left").withColumn("token", F.coalesce("spelling", "token"))
    rest = [c for c in lines.columns if c not in (*keys, line)]
    out = mended.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "token"))), lambda p: p["token"]), "").alias(line),
        *[F.first(c).alias(c) for c in rest])
    return out.select(*lines.columns)
