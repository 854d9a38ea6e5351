"""A kept index of picture vectors: clusters with a radius each, searched exactly.

Centres come from a bounded sample, but every picture is in the index, written by cluster with its distance from the centre. Lengths are one, so cosine
distance and straight distance go together, and straight distances obey the triangle inequality: no picture of a cluster is nearer to a query than the centre
less the radius. A query first reads the clusters that surely hold its k nearest candidates, then only those which can still hold a nearer one.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.vectors import unit_vector
from vitrine.operators.similar import NEAR_IMAGES, QUERIES_PER_BLOCK, _matrix, _unit, dealt, merged_nearest, nearest_in_cells
from vitrine.session import materialize

SAMPLE, MOST_CLUSTERS, TURNS = 20_000, 1024, 8
#: Pictures of one cluster that one task scans; larger clusters are cut.
BLOCK_ROWS = 50_000
#: Vectors of length zero have no direction: they lie in a cluster of their own that every query reads.
NOWHERE = -1
#: Distances are compared at nine decimals, so what is farther by less may still be as near.
SLACK = 2e-9


def fit_centres(vectors: np.ndarray, clusters: int) -> np.ndarray:
    """Centres of a sample by a few turns of moving each to the mean of its vectors; beginning with vectors that lie far apart."""
    vectors = vectors[np.linalg.norm(vectors, axis=1) > 0]
    if not len(vectors):
        return np.zeros((0, vectors.shape[1]))
    centres = vectors[np.linspace(0, len(vectors) - 1, min(clusters, len(vectors))).astype(int)]
    for _ in range(TURNS):
        nearest = np.argmax(vectors @ centres.T - (centres ** 2).sum(axis=1) / 2, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, vectors)
        n = np.bincount(nearest, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def build_index(images: DataFrame, image_id: str, vector: str, product: str, folder: str, clusters: int | None = None, sample: int = SAMPLE) -> None:
    """Write the index of all pictures that have a vector to ``folder``. About ``sample`` of them, by hash of their id, settle the centres; there are as many
    as the square root of the number of pictures unless ``clusters`` says otherwise, at most 1,024."""
    spark = images.sparkSession
    have = images.filter(F.col(vector).isNotNull()).select(F.col(image_id).alias("image_id"), F.col(product).alias("product"),
                                                           F.col(vector).cast("array<double>").alias("v"))
    n = have.count()
    top = 1 << 30
    chosen = have.filter(F.pmod(F.xxhash64("image_id"), F.lit(top)) < int(min(1.0, sample / max(1, n)) * top)).orderBy(F.xxhash64("image_id"), "image_id").select("v")
    vectors = _unit(_matrix(chosen.toPandas()["v"])) if n else np.zeros((0, 0))
    centres = fit_centres(vectors, clusters or min(MOST_CLUSTERS, max(1, int(n ** 0.5)))) if len(vectors) else np.zeros((0, 0))
    # Readers take the columns' types from here, so that an index without pictures can be read, too.
    spark.createDataFrame([], have.schema).coalesce(1).write.parquet(f"{folder}/types")
    rows = [(i, c.tolist()) for i, c in enumerate(centres)]
    spark.createDataFrame(rows, "cluster int, centre array<double>").coalesce(1).write.parquet(f"{folder}/centres")
    add_images(have, "image_id", "v", "product", folder)


def add_images(images: DataFrame, image_id: str, vector: str, product: str, folder: str) -> None:
    """Add pictures to the index in ``folder``; ids must be new. Centres stay."""
    centres = _centres(images.sparkSession, folder)

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            v = _unit(_matrix(part["v"])) if len(part) else np.zeros((0, 1))
            zero = np.linalg.norm(v, axis=1) == 0 if len(v) else np.zeros(0, bool)
            if len(v) and len(centres):
                away = np.sqrt(np.maximum(0.0, (v ** 2).sum(axis=1)[:, None] - 2 * v @ centres.T + (centres ** 2).sum(axis=1)))
                cluster = away.argmin(axis=1)
                away = away[np.arange(len(v)), cluster]
            else:
                cluster, away = np.full(len(v), NOWHERE), np.zeros(len(v))
            yield part.assign(away=np.where(zero, 0.0, away), cluster=np.where(zero, NOWHERE, cluster).astype("int32"))

    have = images.filter(F.col(vector).isNotNull()).select(F.col(image_id).alias("image_id"), F.col(product).alias("product"),
                                                           F.col(vector).cast("array<double>").alias("v"))
    types = {f.name: f.dataType.simpleString() for f in have.schema.fields}
    placed = have.mapInPandas(place, f"image_id {types['image_id']}, product {types['product']}, v array<double>, away double, cluster int")
    placed.repartition("cluster", dealt("image_id", 16)).write.mode("append").partitionBy("cluster").parquet(f"{folder}/pictures")


def _pictures(spark: SparkSession, folder: str) -> DataFrame:
    types = spark.read.parquet(f"{folder}/types").schema
    whole = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in types) + ", away double, cluster int"
    return spark.read.schema(whole).parquet(f"{folder}/pictures")


def _centres(spark: SparkSession, folder: str) -> np.ndarray:
    rows = spark.read.schema("cluster int, centre array<double>").parquet(f"{folder}/centres").orderBy("cluster").collect()  # at most 1,024
    return np.array([r["centre"] for r in rows]) if rows else np.zeros((0, 0))


def bounds(queries: np.ndarray, centres: np.ndarray, radius: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query and cluster: lower bound of any distance, whether the cluster is among those that surely hold k pictures within the bound, and whether it may hold a
    nearer one than those. The last row of the clusters is the one of zero vectors, which has no bound."""
    away = np.sqrt(np.maximum(0.0, (queries ** 2).sum(axis=1)[:, None] - 2 * queries @ centres.T + (centres ** 2).sum(axis=1))) if len(centres) else np.zeros((len(queries), 0))
    low = np.hstack([np.maximum(0.0, away - radius[:-1] - 1e-9), np.zeros((len(queries), 1))])
    high = np.hstack([away + radius[:-1] + 1e-9, np.full((len(queries), 1), 2.0)])
    order = np.argsort(high, axis=1, kind="stable")
    before = np.cumsum(n[order], axis=1) - n[order]
    needed = np.zeros(low.shape, bool)
    np.put_along_axis(needed, order, before < k, axis=1)
    reach = np.where(needed, high, 0.0).max(axis=1, keepdims=True)
    return low, needed & (n > 0), (low <= np.sqrt(reach ** 2 + 2 * SLACK) + 1e-9) & (n > 0)


def indexed_nearest(spark: SparkSession, folder: str, queries: DataFrame, query_id: str, vector: str, k: int = NEAR_IMAGES) -> tuple[DataFrame, DataFrame]:
    """``nearest_images`` over the index in ``folder``, with the same rows, and ``(query_id, compared, pictures)``: how many pictures each query was compared with."""
    centres = _centres(spark, folder)
    index = _pictures(spark, folder)
    stats = {r["cluster"]: (r["radius"], r["n"]) for r in index.groupBy("cluster").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
    radius, n = (np.array([stats.get(c, (0.0, 0))[i] for c in [*range(len(centres)), NOWHERE]]) for i in (0, 1))
    asked = queries.select(F.col(query_id).alias("query_id"), unit_vector(F.col(vector)).alias("v"))
    kind = asked.schema["query_id"].dataType.simpleString()

    def plan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            low, first, open_ = bounds(_unit(_matrix(part["v"])), centres, radius, n, k)
            q, c = np.nonzero(open_ | first)
            yield pd.DataFrame({"query_id": part["query_id"].to_numpy()[q], "v": part["v"].to_numpy()[q], "cluster": np.where(c < len(centres), c, NOWHERE).astype("int32"),
                                "low": low[q, c], "first": first[q, c]})

    plans = materialize(asked.mapInPandas(plan, f"query_id {kind}, v array<double>, cluster int, low double, first boolean"))
    query_blocks = max(1, -(-queries.count() // QUERIES_PER_BLOCK))
    cuts = spark.createDataFrame([(c, -(-m // BLOCK_ROWS)) for c, (_, m) in stats.items()] or [(NOWHERE, 1)], "cluster int, cuts long")
    most = int(max((-(-m // BLOCK_ROWS) for _, m in stats.values()), default=1))

    def found(some: DataFrame) -> DataFrame:
        read = [r["cluster"] for r in some.select("cluster").distinct().collect()]  # the scan reads no other folders
        blocks = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
        number = lambda block: F.col("cluster").cast("long") * most + block
        wanted = some.join(cuts, "cluster").withColumn("block", blocks).select("query_id", "v", number(F.col("block")).alias("ib"), dealt("query_id", query_blocks).alias("qb"))
        have = index.filter(F.col("cluster").isin(read)).join(cuts, "cluster").select(
            "image_id", "product", "v", number(F.pmod(F.xxhash64("image_id"), F.col("cuts"))).alias("ib")).withColumn(
            "qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
        return nearest_in_cells(wanted, have, k).drop("rank")

    near = materialize(found(plans.filter("first")))
    reach = near.groupBy("query_id").agg(F.max("distance").alias("farthest"), F.count(F.lit(1)).alias("m"))
    # What the first pictures leave open: clusters that begin no farther than the k-th of them.
    limit = F.when(F.col("m") >= k, F.sqrt(2 * (F.col("farthest") + SLACK)) + 1e-9).otherwise(F.lit(3.0))
    rest = materialize(plans.filter("not first").join(reach, "query_id", "left").filter(F.col("low") <= F.coalesce(limit, F.lit(3.0))).select(*plans.columns))
    out = merged_nearest(near.unionByName(found(rest)), k)
    sizes = spark.createDataFrame([(c, m) for c, (_, m) in stats.items()] or [(NOWHERE, 0)], "cluster int, m long")
    compared = plans.filter("first").unionByName(rest).join(sizes, "cluster").groupBy("query_id").agg(F.sum("m").alias("compared"))
    return out, compared.withColumn("pictures", F.lit(int(n.sum())).cast("long"))
