"""A kept trigram index for text search: inverted lists in buckets, written once, added to by each import, read by the buckets that are asked for.

Each list entry is a row ``(bucket, field, gram, id, n)``: the field holds the gram, ``n`` is the number of grams of its value. Code keys are cut as similarity needs
it (with space before and behind), texts as substring search needs it (letters as they follow one another). The index gives candidates, none is missed;
the search itself then judges them on their full values, so that results are those of a scan.
"""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.vectors import literal_trigrams, trigram_similarity, trigrams
from vitrine.operators import search
from vitrine.operators.search import SIMILAR

BUCKETS = 64
KEY = "key"


def substrings(text: Column) -> Column:
    """Distinct runs of three letters in lower case."""
    low = F.lower(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(0))), lambda i: F.substring(low, i, F.lit(3))))


def _bucket(field: Column, gram: Column) -> Column:
    return F.pmod(F.xxhash64(field, gram), F.lit(BUCKETS)).cast("int")


def write_index(products: DataFrame, id: str, key: str, texts: Sequence[str], folder: str) -> None:
    """Add products to the index in ``folder``, which begins with the first call; ids must be new. ``key`` is the code key, ``texts`` are searched for substrings."""
    fields = F.array(
        F.struct(F.lit(KEY).alias("field"), F.when(F.col(key).isNotNull(), trigrams(F.col(key))).alias("grams")),
        *[F.struct(F.lit(t).alias("field"), F.when(F.length(F.lower(F.col(t))) >= 3, substrings(F.col(t))).alias("grams")) for t in texts])
    values = products.select(F.col(id).alias("id"), F.explode(fields).alias("f")).select("id", "f.field", "f.grams").filter(F.col("grams").isNotNull())
    lists = values.select("id", "field", F.size("grams").alias("n"), F.explode("grams").alias("gram")).withColumn("bucket", _bucket(F.col("field"), F.col("gram")))
    # A bucket is written by several tasks, so that no gram that all products have makes one of them long; inside, lists lie together.
    (lists.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "field", "gram")
     .write.mode("append").partitionBy("bucket").parquet(folder))


def _lists(spark: SparkSession, folder: str, id_type: str, wanted: Sequence[tuple[str, str]]) -> DataFrame:
    """Entries of the wanted (field, gram) lists; no other bucket is read."""
    index = spark.read.schema(f"field string, gram string, id {id_type}, n int, bucket int").parquet(folder)
    asked = spark.createDataFrame(list(wanted), "field string, gram string").withColumn("bucket", _bucket(F.col("field"), F.col("gram")))
    buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # at most as many as there are
    by_field: dict[str, list[str]] = {}
    for field, gram in wanted:
        by_field.setdefault(field, []).append(gram)
    held = F.lit(False)
    for field, grams in by_field.items():
        held = held | ((F.col("field") == field) & F.col("gram").isin(*grams))
    return index.filter(F.col("bucket").isin(buckets) & held)


def _with_all(lists: DataFrame, field: str, grams: Sequence[str]) -> DataFrame:
    return (lists.filter((F.col("field") == field) & F.col("gram").isin(*grams)).groupBy("id").agg(F.count_distinct("gram").alias("m"))
            .filter(F.col("m") == len(set(grams))).select("id"))


def fragments(query: str) -> list[str]:
    """Plain stretches of a search text between its wildcards."""
    out, now = [], ""
    for part in re.findall(r"\\[%_\\]|[%_]|.", query.strip(), re.S):
        if part in ("%", "_"):
            out.append(now)
            now = ""
        else:
            now += part[1] if len(part) == 2 else part
    return [x for x in [*out, now] if x]


def candidates(spark: SparkSession, folder: str, id_type: str, query: str, texts: Sequence[str]) -> DataFrame | None:
    """``(id)`` of all products that ``search.text_search`` may find, or None where only a scan can tell: no stretch of the text has three letters."""
    long = [x for x in fragments(query) if len(x) >= 3]
    if not long:
        return None
    # The engine's own lower case, as in the index.
    pieces = spark.createDataFrame([(x,) for x in long], "x string").select(F.explode(substrings(F.col("x"))).alias("g")).distinct()
    inner = sorted(r["g"] for r in pieces.collect())
    wanted = "".join(ch for ch in query.upper() if ch.isascii() and ch.isalnum())
    padded = [r["g"] for r in spark.range(1).select(F.explode(trigrams(F.lit(wanted))).alias("g")).collect()] if wanted else []
    # A key that begins with the asked one has all its grams but the last, which ends in space.
    begins = [g for g in padded if not (g.endswith(" ") and not g.startswith("  "))]
    lists = _lists(spark, folder, id_type, [*((t, g) for t in texts for g in inner), *((KEY, g) for g in padded)])
    out = None
    for found in [*(_with_all(lists, t, inner) for t in texts), *([_with_all(lists, KEY, begins)] if begins else [])]:
        out = found if out is None else out.unionByName(found)
    if padded:
        shared = lists.filter(F.col("field") == KEY).groupBy("id", "n").agg(F.count(F.lit(1)).alias("m"))
        out = out.unionByName(shared.filter(F.col("m") / (F.col("n") + len(padded) - F.col("m")) >= SIMILAR).select("id"))
    return out.distinct()


def indexed_text_search(folder: str, products: DataFrame, id: str, query: str, texts: Sequence[str], code: str, key: str, shown: Column | str | None = None,
                        limit: int = 60) -> DataFrame:
    """``search.text_search`` with the same rows; only candidates of the index are judged. ``texts`` and ``code`` are fields of the index, ``key`` its code key."""
    some = candidates(products.sparkSession, folder, products.schema[id].dataType.simpleString(), query, [*texts, code])
    rows = products if some is None else products.join(some.withColumnRenamed("id", id), id, "left_semi")
    return search.text_search(rows, query, texts, code, key, shown, limit)


def indexed_matches(spark: SparkSession, folder: str, keys: DataFrame, id: str, key: str, terms: DataFrame, term: str, threshold: float = SIMILAR) -> DataFrame:
    """``search.trigram_matches`` over the index: (term, key, similarity). ``keys(id, key)`` are the values behind the ids of the index.

    A term looks up its rarest grams only, as many as a similar key cannot do without; list lengths say which those are.
    """
    id_type = keys.schema[id].dataType.simpleString()
    index = spark.read.schema(f"field string, gram string, id {id_type}, n int, bucket int").parquet(folder).filter(F.col("field") == KEY)
    asked = terms.select(F.col(term).alias("term")).distinct().withColumn("grams", trigrams(F.col("term")))
    grams = asked.select("term", F.size("grams").alias("t"), F.explode("grams").alias("gram"))
    grams = grams.withColumn("bucket", _bucket(F.lit(KEY), F.col("gram")))
    often = index.groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("often"))
    ranked = grams.join(often, ["bucket", "gram"], "left").groupBy("term", "t").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram", "bucket"))).alias("all"))
    first = F.col("t") - F.ceil(F.col("t") * threshold).cast("int") + 1
    rare = ranked.select("term", "t", F.explode(F.slice("all", F.lit(1), first)).alias("s")).select("term", "t", "s.gram", "s.bucket")
    fits = (F.col("n") >= F.col("t") * threshold) & (F.col("t") >= F.col("n") * threshold)
    pairs = index.join(rare, ["bucket", "gram"]).filter(fits).select("term", F.col("id").alias(id)).distinct()
    named = pairs.join(keys.select(id, F.col(key).alias("key")), id).select("term", "key").distinct()
    score = trigram_similarity(trigrams(F.col("key")), trigrams(F.col("term")))
    return named.withColumn("similarity", score).filter(F.col("similarity") >= threshold).withColumnsRenamed({"term": term, "key": key})
