"""Vectors and fingerprints as Column expressions."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once per row; inside a lambda an expression runs per element."""
    return F.transform(F.array(value), body)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def unit_vector(v: Column, decimals: int = 6) -> Column:
    """v divided by its length (1 for the zero vector), rounded."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    scale = F.when(length == 0, 1.0).otherwise(length)
    return let(scale, lambda s: F.transform(v, lambda x: F.round(x.cast("double") / s, decimals)))


def above_mean_bits(v: Column) -> Column:
    """Fingerprint: one bit per element, set where it exceeds the mean; packed into 32-bit words as longs."""
    words = F.sequence(F.lit(0), F.ceil(F.size(v) / 32).cast("int") - 1)

    def packed(mean: Column) -> Column:
        return F.transform(words, lambda w: F.aggregate(
            F.slice(v, w * 32 + 1, 32), F.lit(0).cast("long"),
            lambda acc, x: acc * 2 + (x.cast("double") > mean).cast("long")))

    return let(_sum(_doubles(v)) / F.size(v), packed)


def differing_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)


def trigrams(text: Column) -> Column:
    """Distinct 3-grams of the lower-cased text with two blanks before and one behind."""
    starts = F.sequence(F.lit(1), F.length(text) + 1)
    return let(F.concat(F.lit("  "), F.lower(text), F.lit(" ")), lambda padded: F.array_distinct(
        F.transform(starts, lambda i: F.substring(padded, i, F.lit(3)))))


def literal_trigrams(text: str) -> Column:
    """The trigrams of a fixed text as a literal, so nothing is computed per row."""
    padded = f"  {text.lower()} "
    return F.array(*[F.lit(g) for g in dict.fromkeys(padded[i:i + 3] for i in range(len(padded) - 2))])


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared over all trigrams of two trigram arrays."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)
