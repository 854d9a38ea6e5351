"""Exact de-duplication of page texts as a stateful stream.

Pages arrive as narrow records: digest of the normalised text, the page's url as stable identifier, and a content
locator (the file that holds the page, and the text's bytes). A streaming aggregate keeps one state row per digest in
RocksDB on disk, without watermark, so nothing ever expires: the largest url seen, its locator and the number of arrivals. Arrivals are combined per task before they reach
their state, so a text that makes up a third of all pages costs a few rows per task.

Every digest that was hit more than once is then checked on its full bytes: the distinct texts behind it are collected per digest,
again combined per task, and there must be exactly one. Should two texts ever share a digest, they are told apart by text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import scratch
from vitrine.llm.host_reputation import LOWER, UPPER

STATE = "spark.sql.streaming.stateStore"
#: Keyed state in RocksDB; changes are logged instead of uploading whole snapshots, and files grow as they fill.
STATE_SETTINGS = {
    f"{STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STATE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{STATE}.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """Null as empty, A-Z lower-cased and nothing else changed."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def arrivals_of(crawled_pages: DataFrame) -> DataFrame:
    """``(url, digest, locator)`` of every page; digest is the hex SHA-256 of the normalised text in UTF-8, locator
    ``(file, n_bytes)``, file empty where the pages don't come from files."""
    text = normalised(F.col("text"))
    return crawled_pages.select("url", F.sha2(text.cast("binary"), 256).alias("digest"),
                                F.struct(F.input_file_name().alias("file"), F.octet_length(text).cast("long").alias("n_bytes")).alias("locator"))


def stream_state(arrivals_path: str, schema, spark: SparkSession, files_per_batch: int = 1000) -> DataFrame:
    """Run all arrival files at ``arrivals_path`` through the keyed state.

    Returns the last state of each digest: ``(digest, kept_page(url, locator), copies)``. A batch that is run again after a failure
    writes its own folder anew, so nothing counts twice.
    """
    out, checkpoint = scratch.folder(spark, "dedup-state-changes"), scratch.folder(spark, "dedup-stream")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(arrivals_path)
    state = stream.groupBy("digest").agg(F.max(F.struct("url", "locator")).alias("kept_page"), F.count(F.lit(1)).alias("copies"))

    def write(changes: DataFrame, batch: int) -> None:
        changes.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        (state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start().awaitTermination())
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    changes = spark.read.schema(f"{_ddl(state)}, batch int").option("basePath", out).parquet(f"{out}/batch=*")
    # A state only grows: the last change of a digest has the largest count and the largest url.
    return changes.groupBy("digest").agg(F.max("kept_page").alias("kept_page"), F.max("copies").alias("copies"))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def distinct_texts(crawled_pages: DataFrame, state: DataFrame) -> DataFrame:
    """Full bytes behind each digest that was hit: ``(digest, texts)`` only where there is more than one text."""
    text = normalised(F.col("text"))
    hit = state.filter("copies > 1").select("digest")
    return (crawled_pages.select(F.sha2(text.cast("binary"), 256).alias("digest"), text.alias("text"))
            .join(hit, "digest", "left_semi").groupBy("digest").agg(F.collect_set("text").alias("texts"))
            .filter(F.size("texts") > 1))


def dedup_pages(crawled_pages: DataFrame, files_per_batch: int = 1000) -> DataFrame:
    """``crawled_pages(url, text)`` -> ``(url, keep, group_size, kept, digest)``, one row per page, dropped ones too.

    Texts are equal if identical after lower-casing A-Z; a null text equals the empty one. Of equal texts the page with the largest
    url stays. Rows that repeat a url as well as its text count as copies and are all marked kept or not by that url; urls are
    expected to be unique, and one that is null stays only where its group has no other. Texts of any length are compared whole. Extra columns are not read. Empty table: empty result.
    """
    spark = crawled_pages.sparkSession
    pages = crawled_pages.select("url", "text")
    arrivals = arrivals_of(pages)
    path = scratch.folder(spark, "dedup-arrivals")
    arrivals.write.parquet(path)
    narrow = spark.read.schema(arrivals.schema).parquet(path)
    if narrow.isEmpty():
        return narrow.select("url", F.col("url").alias("keep"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    state = scratch.settled(stream_state(path, arrivals.schema, spark, files_per_batch))
    clashes = scratch.settled(distinct_texts(pages, state))
    if clashes.isEmpty():
        # One digest, one text: what the state holds is the answer.
        groups = state.select("digest", F.col("kept_page.url").alias("keep"), F.col("copies").alias("group_size"))
        out = narrow.join(groups, "digest")
    else:
        out = _by_text(pages)
    return out.select("url", "keep", "group_size", F.col("url").eqNullSafe(F.col("keep")).alias("kept"), "digest")


def _by_text(pages: DataFrame) -> DataFrame:
    """The same rows keyed by the text itself, for the case that two texts share a digest."""
    keyed = pages.select("url", normalised(F.col("text")).alias("whole"))
    groups = keyed.groupBy("whole").agg(F.max("url").alias("keep"), F.count(F.lit(1)).alias("group_size"))
    return keyed.join(groups, "whole").select("url", "keep", "group_size", F.sha2(F.col("whole").cast("binary"), 256).alias("digest"))
