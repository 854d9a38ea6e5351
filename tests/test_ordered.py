"""Pieces of a group must give what one window over the whole group gives."""
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vitrine.operators import ordered

ORDER = ["o", "id"]
#: Sampled ranges, ten pieces with empty ones between, one piece per value and null.
PIECES = [None, "floor(o / 4)", "o"]


@pytest.fixture(scope="module")
def rows(spark):
    # A third of the rows share one key, some keys and some order values are null, the values have gaps.
    df = spark.range(600).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 11).cast("string")).alias("k"),
        F.when(F.col("id") % 50 > 0, F.abs(F.hash("id") % 50)).alias("o"), F.when(F.hash("id") % 4 == 0, F.col("id")).alias("v"))
    return df.filter("o is null or o not between 25 and 34").repartition(5).cache()


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


@pytest.mark.parametrize("piece", PIECES)
def test_pieces_equal_window(rows, piece):
    v, piece = F.col("v"), piece and F.expr(piece)
    whole = W.partitionBy("k").orderBy(*ORDER)
    upto = whole.rowsBetween(W.unboundedPreceding, 0)
    same(ordered.number_rows(rows, ["k"], ORDER, "r", piece), rows.withColumn("r", F.row_number().over(whole).cast("long")))
    same(ordered.running_total(rows, ["k"], ORDER, F.coalesce(v, F.lit(0)), "r", piece), rows.withColumn("r", F.sum(F.coalesce(v, F.lit(0))).over(upto)))
    same(ordered.carry_forward(rows, ["k"], ORDER, v, "r", piece), rows.withColumn("r", F.last("v", ignorenulls=True).over(upto)))
    same(ordered.with_neighbours(rows, ["k"], ORDER, v, "p", "n", piece),
         rows.withColumn("p", F.lag("v").over(whole)).withColumn("n", F.lead("v").over(whole)))


@pytest.mark.parametrize("piece", PIECES)
def test_global_order(rows, piece):
    got = {r["id"]: r["r"] for r in ordered.number_rows(rows, [], ORDER, "r", piece and F.expr(piece)).collect()}
    want = {r["id"]: i + 1 for i, r in enumerate(sorted(rows.collect(), key=lambda r: (r["o"] is not None, r["o"] or 0, r["id"])))}
    assert got == want


@pytest.mark.parametrize("order", [["code"], ["at", "code"], ["ordinal"]])
def test_orders_that_begin_alike_are_spread(spark, order):
    """All keys begin with the same letters, one number comes first for all rows, or the order is a struct: pieces are even all the same."""
    df = spark.range(20_000).select(F.concat(F.lit("SRC-CH-NT-"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("code"), F.lit(1).alias("at"),
                                    F.struct(F.lit(7).alias("feed_no"), F.hash("id").alias("h"), "id").alias("ordinal"), (F.col("id") % 3 > 0).alias("k")).repartition(8, "code")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "10")
    try:
        for keys in ([], ["k"]):
            sizes = [r["count"] for r in ordered.in_ranges(df, keys, order, "piece").groupBy("piece").count().collect()]
            assert len(sizes) == 10 and max(sizes) < 2 * sorted(sizes)[5]
        got = ordered.number_rows(df, [], order, "r")
        assert got.join(got.select(F.col("r").alias("r2"), *[F.col(c).alias(f"{c}2") for c in order]), F.col("r") + 1 == F.col("r2")).filter(
            F.struct(*order) >= F.struct(*[f"{c}2" for c in order])).count() == 0
        assert got.agg(F.min("r"), F.max("r"), F.count_distinct("r")).first()[:] == (1, 20_000, 20_000)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


def test_no_job_while_building_with_given_pieces(spark, rows):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "plans only")
    ordered.number_rows(rows, ["k"], ORDER, "r", F.col("o"))
    assert list(tracker.getJobIdsForGroup("building")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_first_and_top(rows):
    data = rows.filter("o is not null").collect()
    first = {r["k"]: r["id"] for r in ordered.first_per_key(rows.filter("o is not null"), ["k"], ["o", "id"]).collect()}
    want = {}
    for r in sorted(data, key=lambda r: (r["o"], r["id"])):
        want.setdefault(r["k"], r["id"])
    assert first == want
    assert ordered.top_per_key(rows, ["k"], ["o", "id"], 3).count() == sum(min(3, sum(x["k"] == k for x in rows.collect())) for k in want)
