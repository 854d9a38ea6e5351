"""Text, code and trigram search."""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.textclean import search_key
from vitrine.functions.vectors import literal_trigrams, trigram_similarity, trigrams
from vitrine.operators.ordered import top_per_key

SIMILAR = 0.3


def like_pattern(query: str) -> str:
    """Pattern of texts that contain the query; a backslash that escapes nothing stands for itself."""
    return "%" + re.sub(r"\\([%_\\])?", lambda m: m.group() if m.group(1) else r"\\", query) + "%"


def text_search(products: DataFrame, query: str, texts: Sequence[str], code: str, key: str | None = None,
                shown: Column | str | None = None, limit: int = 60) -> DataFrame:
    """Products whose texts or code contain the query, whose code key begins with the query's key, or is
    similar to it. Prefix hits first, then similarity, then code. ``%`` and ``_`` in the query are wildcards, a
    backslash before one makes it a plain character, any other backslash stands for itself.
    """
    rows = products.filter(shown) if shown is not None else products
    like = F.lit(like_pattern(query.strip()))
    wanted = "".join(ch for ch in query.upper() if ch.isascii() and ch.isalnum())
    hit = F.lit(False)
    for c in [*texts, code]:
        hit = hit | F.coalesce(F.ilike(F.col(c), like), F.lit(False))
    if not wanted:
        return rows.filter(hit).orderBy(F.col(code).asc_nulls_last()).limit(limit)
    code_key = F.col(key) if key else search_key(F.col(code))
    prefix = code_key.startswith(wanted)
    rows = rows.withColumn("similarity", trigram_similarity(trigrams(code_key), literal_trigrams(wanted)))
    tie = [F.col(key).asc_nulls_last()] if key else []
    return (
        rows.filter(hit | prefix | (F.col("similarity") >= SIMILAR))
        .withColumn("prefix", prefix)
        .orderBy(F.col("prefix").desc(), F.col("similarity").desc(), F.col(code).asc_nulls_last(), *tie).limit(limit)
    )


def trigram_matches(items: DataFrame, terms: DataFrame, key: str, term: str, threshold: float = SIMILAR) -> DataFrame:
    """(term, key, similarity) of every distinct key at least ``threshold`` similar to a search term.

    A similar pair shares at least ceil(threshold * n) of either side's n trigrams. So with trigrams in one order for all, rare ones
    first, it meets on one of the first n - ceil(threshold * n) + 1 of both sides, and lengths differ by no more than the threshold
    allows. The trigrams nearly every key has come last and are hardly looked up; no pair is lost. Repeated keys cost
    nothing; candidates are verified by their real similarity.
    """
    keys = items.select(F.col(key).alias("key")).distinct().withColumn("grams", trigrams(F.col("key")))
    asked = terms.select(F.col(term).alias("term")).distinct().withColumn("grams", trigrams(F.col("term")))
    often = keys.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("often"))

    def prefixes(side: DataFrame, name: str, n: str) -> DataFrame:
        # A trigram no key has cannot be shared, but counts as a rare one.
        ranked = side.select(name, F.size("grams").alias(n), F.explode("grams").alias("g")).join(often, "g", "left")
        first = F.col(n) - F.ceil(F.col(n) * threshold).cast("int") + 1
        in_order = F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "g")))
        return ranked.groupBy(name, n).agg(in_order.alias("all")).select(name, n, F.explode(F.slice("all", F.lit(1), first)).alias("s")).select(name, n, "s.g")

    fits = (F.col("k") >= F.col("t") * threshold) & (F.col("t") >= F.col("k") * threshold)
    pairs = prefixes(keys, "key", "k").join(prefixes(asked, "term", "t"), "g").filter(fits).select("term", "key").distinct()
    score = trigram_similarity(trigrams(F.col("key")), trigrams(F.col("term")))
    return pairs.withColumn("similarity", score).filter(F.col("similarity") >= threshold).withColumnsRenamed({"term": term, "key": key})


def best_matches(matches: DataFrame, term: str, key: str, n: int = 60) -> DataFrame:
    """The ``n`` best keys per term."""
    return top_per_key(matches, [term], [F.col("similarity").desc(), F.col(key).asc()], n)
