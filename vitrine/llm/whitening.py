"""Whitening of picture embeddings with exactly determined components.

Entries become integers, so the scatter of all vectors is a matrix of integers and known exactly: tasks add up products of their vectors, one aggregate adds
those up. From it ``exact_spectrum`` finds the characteristic polynomial, its largest roots and their vectors; primes and roots are dealt over tasks. Whitening is
one product per batch of vectors. What the driver holds is of the size of the matrix.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm import exact_spectrum
from vitrine.llm.columns import in_small_batches, with_columns

STEPS, SHIFT = 64, 1_000_000
#: Entries from here on leave no room for exact products.
LARGEST = 2.0 ** 40
#: Sums of products below this are exact in double precision.
EXACT = 2.0 ** 53


def usable(embedding: Column, dimension: int) -> Column:
    """Is the vector there, of the right length, and are all its entries numbers?"""
    number = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)
    return F.coalesce((F.size(embedding) == dimension) & F.forall(embedding, number), F.lit(False))


def steps_of(batch: pa.RecordBatch, dimension: int) -> np.ndarray:
    """Entries in whole steps of 1 / 64, less the shift, which no covariance depends on."""
    flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.floor(STEPS * flat).astype(np.int64).reshape(-1, dimension)


def _products(y: np.ndarray) -> np.ndarray:
    """Sums of products of all columns, exact."""
    most = float(np.abs(y).max(initial=0))
    if most * most * max(1, len(y)) < EXACT:
        return (y.astype(float).T @ y.astype(float)).astype(np.int64).astype(object)
    y = y.astype(object)
    return y.T @ y


def scatter(images: DataFrame, dimension: int) -> tuple[int, list[int], list[list[int]]]:
    """Number, sums and ``n * sum(y_i * y_j) - sum(y_i) * sum(y_j)`` of all vectors, exact."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dimension, object), np.zeros((dimension, dimension), object)
        for batch in batches:
            y = steps_of(batch, dimension)
            n, sums, products = n + len(y), sums + y.sum(axis=0).astype(object), products + _products(y)
        if n:
            places = [(-1, -1, n), *((-1, i, v) for i, v in enumerate(sums.tolist())),
                      *((i, j, products[i, j]) for i in range(dimension) for j in range(i, dimension))]
            i, j, v = zip(*places)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(map(str, v), pa.string())], names=["i", "j", "v"])

    parts = images.select("embedding").mapInArrow(run, "i int, j int, v string")
    rows = parts.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # one row per entry of the matrix
    found = {(r["i"], r["j"]): int(r["v"]) for r in rows}
    n, sums = found.get((-1, -1), 0), [found.get((-1, i), 0) for i in range(dimension)]
    matrix = [[n * found.get((min(i, j), max(i, j)), 0) - sums[i] * sums[j] for j in range(dimension)] for i in range(dimension)]
    return n, sums, matrix


def components_of(images: DataFrame, matrix: list[list[int]], count: int) -> tuple[list[float], np.ndarray]:
    """The ``count`` largest positive eigenvalues of the matrix of integers, falling, and their unit vectors as rows. Primes and roots are worked on in tasks."""
    spark = images.sparkSession
    shared = spark.sparkContext.broadcast([[str(v) for v in row] for row in matrix])

    def remainders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [[int(v) for v in row] for row in shared.value]
        for batch in batches:
            for p in batch.column("p").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([exact_spectrum.polynomial_mod(whole, p)], pa.list_(pa.int64()))], names=["p", "found"])

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [[int(v) for v in row] for row in shared.value]
        for batch in batches:
            for at, a, bits, many in zip(*(batch.column(c).to_pylist() for c in ("at", "a", "bits", "many"))):
                found = exact_spectrum.null_vectors(whole, int(a), bits, many)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([found.tolist()], pa.list_(pa.list_(pa.float64())))], names=["at", "found"])

    cores = max(1, spark.sparkContext.defaultParallelism)
    primes = spark.createDataFrame([(p,) for p in exact_spectrum.primes_for(matrix)], "p long").repartition(cores)
    polynomial = exact_spectrum.combined({r["p"]: r["found"] for r in primes.mapInArrow(remainders, "p long, found array<long>").collect()})
    roots = exact_spectrum.largest_roots(polynomial, sum(matrix[i][i] for i in range(len(matrix))), count)
    if not roots:
        return [], np.zeros((0, len(matrix)))
    rows = spark.createDataFrame([(at, str(a), bits, many) for at, (a, bits, many) in enumerate(roots)], "at long, a string, bits int, many int").repartition(cores)
    found = {r["at"]: np.array(r["found"]) for r in rows.mapInArrow(vectors, "at long, found array<array<double>>").collect()}
    values = [a / (1 << bits) for a, bits, many in roots for _ in range(many)]
    return values[:count], np.vstack([found[at] for at in range(len(roots))])[:count]


def whiten_images(product_images: DataFrame, components: int = 32) -> DataFrame:
    """``product_images(image_id, embedding)`` -> ``(image_id, n, deviation, whitened, explained, identity_error)``, one row per usable vector.

    Entries c become ``floor(64 * c) + 1000000``; all ``n`` usable vectors are the fit list. ``whitened`` holds the vector, less the mean, along the first
    ``components`` unit eigenvectors of the covariance (divisor n) by falling eigenvalue, each over the eigenvalue's root; of an eigenvector's two signs its largest
    entry is positive. ``explained`` is each eigenvalue's share of the trace, ``deviation`` the exact sum over dimensions of ``(n * x - sum) ** 2``,
    ``identity_error`` the largest entry of the whitened vectors' covariance less the identity, by amount. Components without variance
    have no direction: their ``whitened`` is null and ``explained`` 0.

    Left out: vectors that are null, hold a null, NaN, infinite entry or one of 2**40 and more, and those whose length is not the most frequent one (the
    smaller one on a tie). Repeated rows stay and count as often as they occur; equal eigenvalues share an orthonormal basis of
    their space; a null image_id stays; extra columns are not read; an empty table gives an empty result. A deviation that exceeds a long is an error.
    """
    images = in_small_batches(product_images.select("image_id", "embedding"))
    out = T.StructType([images.schema["image_id"], T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
                        T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("explained", T.ArrayType(T.DoubleType())),
                        T.StructField("identity_error", T.DoubleType())])
    lengths = images.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("many"))
    usual = lengths.orderBy(F.desc("many"), "d").first()
    if usual is None:
        return images.sparkSession.createDataFrame([], out)
    dimension = usual["d"]
    images = images.filter(usable(F.col("embedding"), dimension)).withColumn("embedding", F.col("embedding").cast("array<double>"))
    n, sums, matrix = scatter(images, dimension)
    if not n:
        return images.sparkSession.createDataFrame([], out)
    values, directions = components_of(images, matrix, min(components, dimension))
    trace = sum(matrix[i][i] for i in range(dimension))
    # Eigenvalues of the matrix are n * n those of the covariance.
    scaled = directions.T / np.sqrt(np.array(values))[None, :] if values else np.zeros((dimension, 0))
    missing = min(components, dimension) - len(values)
    explained = [v / trace for v in values] + [0.0] * missing
    plain = images.sparkSession.sparkContext.broadcast((n, sums, scaled))

    def centred(batch: pa.RecordBatch) -> np.ndarray:
        """n * x - sums, exact."""
        many, total, _ = plain.value
        y = steps_of(batch, dimension)
        if float(np.abs(y).max(initial=0)) * many < 2.0 ** 62:
            return many * y - np.array(total, np.int64)
        return many * y.astype(object) - np.array(total, object)

    def covariance(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many, k, mean, inner = 0, len(values), np.zeros(len(values)), np.zeros((len(values), len(values)))
        for batch in batches:
            w = centred(batch).astype(float) @ plain.value[2]
            if not len(w):
                continue
            # Centred on the mean of what was read so far before it is multiplied; the mean's move is made good.
            here, both = w.mean(axis=0), many + len(w)
            inner += (w - here).T @ (w - here) + np.outer(here - mean, here - mean) * (many * len(w) / both)
            mean += (here - mean) * (len(w) / both)
            many = both
        if many:
            entries = [(-1, i, many * mean[i]) for i in range(k)] + [(i, j, inner[i, j] + many * mean[i] * mean[j]) for i in range(k) for j in range(i, k)]
            i, j, v = zip(*entries)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(v, pa.float64())], names=["i", "j", "v"])

    error = 0.0
    if values:
        parts = images.select("embedding").mapInArrow(covariance, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
        entry = {(r["i"], r["j"]): r["v"] / n for r in parts.collect()}
        error = max(abs(v - entry[-1, i] * entry[-1, j] - (i == j)) for (i, j), v in entry.items() if i >= 0)

    def whiten(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = centred(batch)
            most = max((abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))), default=0)
            wide = x if most * most * dimension < 2 ** 63 else x.astype(object)
            rows = x.astype(float) @ plain.value[2]
            lists = [row + [None] * missing for row in rows.tolist()] if missing else rows.tolist()
            yield with_columns(batch, ["image_id"], deviation=pa.array((wide * wide).sum(axis=1).tolist(), pa.int64()), whitened=pa.array(lists, pa.list_(pa.float64())))

    schema = T.StructType([out["image_id"], out["deviation"], out["whitened"]])
    return images.mapInArrow(whiten, schema).select(
        "image_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.array(*map(F.lit, explained)).alias("explained"), F.lit(float(error)).alias("identity_error"))
