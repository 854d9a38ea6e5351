"""Intermediate tables in the shared folder that the session names in ``spark.checkpoint.dir``."""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from vitrine.session import ensure_checkpoint_dir


def folder(spark: SparkSession, name: str) -> str:
    """A new, unused path for one intermediate result."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Tells Spark to remove a job's shuffle files when the job ends, not when the driver's memory is cleaned up some time later.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job whose plan is made in this block go when the job ends."""
    conf = spark.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: later steps neither recompute it nor lose it with an executor. What was shuffled for it goes when it is written."""
    path = folder(df.sparkSession, name)
    with shuffles_go(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """Checkpoint a small result whose lineage has to end here; files go once nothing refers to it, what was shuffled for it when it is written."""
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_go(df.sparkSession):
        return df.select("*").checkpoint()  # a plan of its own: that of df was made before
