"""Vector search: nearest pictures, collapsed to products, and its accuracy."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.vectors import unit_vector
from vitrine.operators.ordered import top_per_key

NEAR_IMAGES = 240
TOP_PRODUCTS = 24
QUERIES_PER_BLOCK = 2_000
QUERY_SLICE = 128  # queries whose distances to one batch of pictures are in memory at once
MERGE_SALTS = 16
DECIMALS = 9  # distances are compared at this precision, ties go to the lower id


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length == 0, 1.0, length)


def _cut(found: pd.DataFrame, k: int) -> pd.DataFrame:
    return found.sort_values(["query_id", "distance", "image_id"], kind="stable").groupby("query_id", sort=False).head(k)


def _nearest(asked: pd.DataFrame, part: pd.DataFrame, k: int) -> pd.DataFrame:
    """For each query the pictures of this batch that are no farther than its k-th nearest one here."""
    images, queries, found = _unit(_matrix(part["v"])), _unit(_matrix(asked["v"])), []
    for at in range(0, len(queries), QUERY_SLICE):
        distance = np.round(1.0 - queries[at:at + QUERY_SLICE] @ images.T, DECIMALS)
        reach = np.partition(distance, k - 1, axis=1)[:, k - 1:k] if distance.shape[1] > k else distance.max(axis=1, keepdims=True)
        q, i = np.nonzero(distance <= reach)
        found.append(pd.DataFrame({"query_id": asked["query_id"].to_numpy()[at + q], "image_id": part["image_id"].to_numpy()[i],
                                   "product": part["product"].to_numpy()[i], "distance": distance[q, i]}))
    return _cut(pd.concat(found, ignore_index=True), k)


def nearest_images(images: DataFrame, queries: DataFrame, image_id: str, query_id: str, vector: str, product: str,
                   k: int = NEAR_IMAGES, queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """(query_id, image_id, product, distance): the exact k nearest pictures of each query by cosine distance.

    The product rides along, so that collapsing to products reads the pictures no second time. Pictures without a
    vector are skipped. Pictures and queries meet in a grid: pictures are dealt by hash into one block per shuffle partition, queries
    into blocks of about ``queries_per_block``. A task holds the queries of its cell and streams the pictures past them, batch by
    batch and slice by slice, so its memory depends on neither number. Only the best k per query leave a cell; they are
    merged in two steps, so that no task gets the candidates of one query from all cells. Ids may have any orderable type.
    """
    spark = images.sparkSession
    image_blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    query_blocks = max(1, -(-queries.count() // queries_per_block))
    asked = queries.select(F.col(query_id).alias("query_id"), unit_vector(F.col(vector)).alias("v"))
    have = images.filter(F.col(vector).isNotNull()).select(
        F.col(image_id).alias("image_id"), F.col(product).alias("product"), F.col(vector).cast("array<double>").alias("v"))

    def blocks(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    return nearest_in_cells(
        asked.withColumn("qb", dealt("query_id", query_blocks)).withColumn("ib", blocks(image_blocks)),
        have.withColumn("ib", dealt("image_id", image_blocks)).withColumn("qb", blocks(query_blocks)), k)


def dealt(key: str, n: int):
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def nearest_in_cells(asked: DataFrame, have: DataFrame, k: int) -> DataFrame:
    """(query_id, image_id, product, distance, rank) of the k nearest pictures among those that a query meets: ``asked(query_id, v, ib, qb)`` and
    ``have(image_id, product, v, ib, qb)`` meet where both block numbers are equal. A query and a picture must not meet twice."""
    types = {**{f.name: f.dataType.simpleString() for f in have.schema.fields}, **{f.name: f.dataType.simpleString() for f in asked.schema.fields}}
    schema = f"query_id {types['query_id']}, image_id {types['image_id']}, product {types['product']}, distance double"
    rows = asked.withColumn("kind", F.lit(0)).unionByName(have.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    cells = rows.repartition("ib", "qb").sortWithinPartitions("ib", "qb", "kind")

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, queries_here, best = None, [], None
        for part in parts:
            for here, rows_here in part.groupby(["ib", "qb"], sort=False):
                if here != cell:
                    if best is not None:
                        yield best
                    cell, queries_here, best = here, [], None
                new = rows_here[rows_here["kind"] == 0]
                if len(new):
                    queries_here.append(new[["query_id", "v"]])
                pictures = rows_here[rows_here["kind"] == 1]
                if len(pictures) and queries_here:
                    queries_here = [pd.concat(queries_here, ignore_index=True)]
                    found = _nearest(queries_here[0], pictures, k)
                    best = found if best is None else _cut(pd.concat([best, found], ignore_index=True), k)
        if best is not None:
            yield best

    return merged_nearest(cells.mapInPandas(scan, schema), k)


def merged_nearest(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of all (query_id, image_id, product, distance), in two steps, so that no task gets all candidates of one query."""
    fewer = top_per_key(found.withColumn("salt", dealt("image_id", MERGE_SALTS)), ["query_id", "salt"], ["distance", "image_id"], k).drop("rank", "salt")
    return top_per_key(fewer, ["query_id"], ["distance", "image_id"], k)


def best_per_product(near: DataFrame) -> DataFrame:
    """(query_id, product, distance): each product by its nearest picture."""
    return near.groupBy("query_id", "product").agg(F.min("distance").alias("distance"))


def top_products(best: DataFrame, shown: DataFrame, n: int = TOP_PRODUCTS) -> DataFrame:
    """The nearest ``n`` shown products per query with ``rank`` and ``score``.

    Hidden products are dropped after the cut to the nearest pictures, so fewer than ``n`` may remain.
    """
    visible = best.join(shown.select("product"), "product", "left_semi")
    ranked = top_per_key(visible, ["query_id"], ["distance", "product"], n)
    return ranked.withColumn("score", F.round(1 - F.col("distance"), 3))


def hit_rates(ranked: DataFrame, truth: DataFrame, cuts: tuple[int, ...] = (1, 5, 24)) -> DataFrame:
    """Share of queries whose true product (``truth``: query_id, product) is within the first k."""
    joined = truth.join(ranked.select("query_id", "product", "rank"), ["query_id", "product"], "left")
    return joined.agg(F.count(F.lit(1)).alias("queries"), *[
        F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(f"top_{k}") for k in cuts])
