"""Ordered computations inside groups that stay distributed when one group is huge.

A plain window sorts each group in one task. Here rows are first dealt into ranges of keys and all order columns together, with borders that Spark
samples from the rows themselves, and written once with their range as the piece: a group with a third of all rows spreads over many
pieces, keys that begin alike or orders by a struct do no harm, and rows of a later piece never come before rows of an earlier one. Rows are then worked on
inside their piece, one summary row per piece carries what the pieces before it contribute, and both are joined on the piece. Pieces are read from the written
rows, so a lost executor changes nothing.

Rows that are equal in keys and order stay together; an order that ends in an identifier has none. ``piece``, any expression that never
falls along the order, takes the place of the sampled ranges and of the written rows.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vitrine.session import materialize

GROUP = "__group"


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Rows written once with the number of their range of keys and order; ranges ascend with both, nulls first."""
    return materialize(df.repartitionByRange(*_cols([*keys, *order])).withColumn(out, F.spark_partition_id()))


def _pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], piece: Column | None) -> DataFrame:
    """Rows with the struct (k0, k1, ..., piece) that names their piece; null keys are equal inside a struct."""
    dealt = in_ranges(df, keys, order, "__range") if piece is None else df.withColumn("__range", piece)
    return dealt.withColumn(GROUP, F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col("__range").alias("piece"))).drop("__range")


def _along(keys: Sequence[str]):
    """Summary rows of one group in the order of their pieces: one row per piece and group."""
    return W.partitionBy(*[F.col(f"{GROUP}.k{i}") for i in range(len(keys))]).orderBy(F.col(f"{GROUP}.piece"))


def _earlier(keys: Sequence[str]):
    return _along(keys).rowsBetween(W.unboundedPreceding, -1)


def _local(order: Sequence[str]):
    return W.partitionBy(GROUP).orderBy(*order)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "rank",
                piece: Column | None = None) -> DataFrame:
    """1-based position of every row inside its group."""
    pieces = _pieces(df, keys, order, piece)
    counts = pieces.groupBy(GROUP).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(GROUP, F.coalesce(F.sum("__n").over(_earlier(keys)), F.lit(0)).alias("__before"))
    return (pieces.withColumn("__at", F.row_number().over(_local(order))).join(offsets, GROUP)
            .withColumn(out, (F.col("__at") + F.col("__before")).cast("long")).drop(GROUP, "__at", "__before"))


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str,
                  piece: Column | None = None) -> DataFrame:
    """Sum of ``value`` over the rows of the group up to and including this one."""
    pieces = _pieces(df.withColumn("__v", value.cast("long")), keys, order, piece)
    sums = pieces.groupBy(GROUP).agg(F.sum("__v").alias("__n"))
    offsets = sums.select(GROUP, F.coalesce(F.sum("__n").over(_earlier(keys)), F.lit(0)).alias("__before"))
    upto = _local(order).rowsBetween(W.unboundedPreceding, 0)
    return (pieces.withColumn("__at", F.sum("__v").over(upto)).join(offsets, GROUP)
            .withColumn(out, F.col("__at") + F.col("__before")).drop(GROUP, "__at", "__before", "__v"))


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str,
                  piece: Column | None = None) -> DataFrame:
    """Latest non-null ``value`` of the group at or before this row."""
    pieces = _pieces(df.withColumn("__v", value), keys, order, piece)
    ends = pieces.groupBy(GROUP).agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(*_cols(order)))).alias("__end"))
    carries = ends.select(GROUP, F.last("__end", ignorenulls=True).over(_earlier(keys)).alias("__carry"))
    upto = _local(order).rowsBetween(W.unboundedPreceding, 0)
    return (pieces.withColumn("__at", F.last("__v", ignorenulls=True).over(upto)).join(carries, GROUP)
            .withColumn(out, F.coalesce("__at", "__carry")).drop(GROUP, "__at", "__carry", "__v"))


def with_neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column,
                    prev: str | None = "prev", next: str | None = "next", piece: Column | None = None) -> DataFrame:
    """``value`` of the row before and after in the group (null at the ends)."""
    pieces = _pieces(df.withColumn("__v", value), keys, order, piece)
    at = F.struct(*_cols(order))
    boxed = F.struct(F.col("__v").alias("v"))
    ends = pieces.groupBy(GROUP).agg(F.min_by(boxed, at).alias("__first"), F.max_by(boxed, at).alias("__last"))
    edges = ends.select(GROUP, F.lag("__last").over(_along(keys)).alias("__lag"), F.lead("__first").over(_along(keys)).alias("__lead"))
    wanted = [x for x in ((prev, F.lag(boxed), "__lag"), (next, F.lead(boxed), "__lead")) if x[0]]
    out = pieces
    for name, near, _ in wanted:
        out = out.withColumn(f"__at_{name}", near.over(_local(order)))
    out = out.join(edges, GROUP)
    for name, _, edge in wanted:
        out = out.withColumn(name, F.coalesce(F.col(f"__at_{name}"), F.col(edge))["v"]).drop(f"__at_{name}")
    return out.drop(GROUP, "__v", "__lag", "__lead")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                  keep: Sequence[str] | None = None) -> DataFrame:
    """The first row of every group by ``order``: an aggregate, combined map-side, never a sort per group."""
    rest = [c for c in (keep or df.columns) if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*_cols(order))).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("__best")[c].alias(c) for c in rest])


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int,
                out: str = "rank") -> DataFrame:
    """First ``n`` rows of every group.

    Spark limits each group inside every map task before the shuffle (window group limit), so what one
    task receives for a hot group is bounded by n times the number of map tasks.
    """
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, rank).filter(F.col(out) <= n)
