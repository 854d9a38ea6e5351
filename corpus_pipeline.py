"""From raw documents to tokenised training text, one operator per stage.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read again as the next stage's docs.
All but the last return the columns of ``documents``; rows are told apart by id and text, not by id alone.
"""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import byte_bpe, decontaminate, exact_dedup, language_id, ngram_join, scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: No SQL expresses the language model, the near duplicates or the tokenizer; stages are tested against brute force.
ORACLE_SQL = None


def keyed(docs: DataFrame) -> DataFrame:
    """Documents as ``(url, text, doc)``, ``doc`` the whole row. ``url`` is the doc_id if all rows have one of their own; where an id is null or repeated it
    is the id together with the text's digest, so that a decision about one row never touches another. It is null only in rows that repeat one another."""
    plain = docs.select("doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("doc_id is null or n > 1").isEmpty()
    digest = F.sha2(F.concat(F.when(F.col("text").isNull(), "0").otherwise("1"), F.coalesce("text", F.lit(""))).cast("binary"), 256)
    url = F.col("doc_id") if plain else F.struct("doc_id", digest.alias("digest"))
    return docs.select(url.alias("url"), "text", F.struct(*docs.columns).alias("doc"))


def as_pages(docs: DataFrame) -> DataFrame:
    return docs.select("url", "text")


def without(docs: DataFrame, dropped: DataFrame, once: bool) -> DataFrame:
    """Rows of ``keyed`` documents whose url is not among ``dropped(url)``; with ``once``, one row of those that repeat both id and text. Urls to drop and repeated ones are
    written first, so their size is known when the joins are planned; whole rows move only where they are repeated."""
    rest = docs.join(scratch.table(dropped.select("url").distinct(), "dropped"), "url", "left_anti")
    if once:
        again = scratch.table(docs.groupBy("url").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("url"), "repeated")
        if not again.isEmpty():
            rest = rest.join(again, "url", "left_anti").select("doc").unionByName(
                rest.join(again, "url", "left_semi").groupBy("url").agg(F.first("doc").alias("doc")).select("doc"))
    return rest.select("doc.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null, empty or without a letter. Repeated and null ids are judged row by row."""
    model = language_id.fit_languages(docs.select(F.col("doc_id").alias("url"), "text", "lang"))
    return language_id.with_language(docs, model).filter(F.col("lang_pred") != language_id.UNKNOWN).select("page.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays, one row of it: a null id only if no other has the text. Rows that share an id but not a text are
    documents of their own."""
    docs = keyed(docs)
    return without(docs, exact_dedup.dedup_pages(as_pages(docs)).filter("not kept"), once=True)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, one row of it; null ids come first. Rows that share an id but not a text are
    documents of their own."""
    docs = keyed(docs)
    return without(docs, ngram_join.near_duplicates(as_pages(docs)).filter("url <> component"), once=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark text, with the same or other parameters. Of rows that share an id only those with such a text go."""
    docs = keyed(docs)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("slug"), "text")
    return without(docs, decontaminate.contaminated(as_pages(docs), items), once=False)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, lang, source, n_tokens, ids, decoded_sha256, round_trip)`` of every document. Ids are written before they are decoded: in one job each task would
    keep two Python workers, with a tokenizer each, and an executor would keep them beyond this stage."""
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    pages = docs.select(F.struct("doc_id", "lang", "source", digest.alias("sha256")).alias("url"), "text")
    encoded = scratch.table(byte_bpe.encode_pages(pages, ranks, pattern), "encoded")
    decoded = byte_bpe.decode_pages(encoded, ranks, pattern)
    return decoded.select("url.doc_id", "url.lang", "url.source", "n_tokens", "ids", F.col("url.sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256")).withColumn(
        "round_trip", F.expr("sha256 = decoded_sha256")).drop("sha256")


STAGES: list[tuple[str, Stage]] = [
    ("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("decontamination", decontamination),
    ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
