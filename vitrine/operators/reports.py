"""Aggregated quality reports."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def import_summary(records: DataFrame, flags: str, category: str, brand: str, blank: str = "—") -> DataFrame:
    """(section, value, n): records per category and brand, and per flag."""
    axes = F.array(
        F.struct(F.lit("category").alias("section"), F.coalesce(F.col(category), F.lit(blank)).alias("value")),
        F.struct(F.lit("brand").alias("section"), F.col(brand).alias("value")))
    by_flag = F.transform(flags, lambda f: F.struct(F.lit("flag").alias("section"), f.alias("value")))
    rows = records.select(F.explode(F.concat(axes, by_flag)).alias("a")).select("a.*")
    return rows.groupBy("section", "value").agg(F.count(F.lit(1)).alias("n"))


def unmapped_types(records: DataFrame, category: str, type_text: str) -> DataFrame:
    """Type texts no rule placed, with counts."""
    return records.filter(F.col(category).isNull()).groupBy(type_text).agg(F.count(F.lit(1)).alias("n"))


def gap_report(items: DataFrame, gaps: Sequence[tuple[str, Column]], keep: Sequence[str]) -> DataFrame:
    """Items with at least one gap; ``missing`` lists the gap names in rule order."""
    missing = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in gaps]))
    return items.withColumn("missing", missing).filter(F.size("missing") > 0).select(*keep, "missing")


def gap_counts(report: DataFrame) -> DataFrame:
    return report.select(F.explode("missing").alias("gap")).groupBy("gap").agg(F.count(F.lit(1)).alias("n"))


def exclusions(items: DataFrame, range_code: str, keep: Sequence[str]) -> DataFrame:
    """Products that belong to no range."""
    return items.filter(F.col(range_code).isNull()).select(*keep)


def range_counts(items: DataFrame, taxonomy: DataFrame, range_code: str) -> DataFrame:
    """Every range of the taxonomy with its number of products."""
    counts = items.filter(F.col(range_code).isNotNull()).groupBy(range_code).agg(F.count(F.lit(1)).alias("n"))
    out = taxonomy.join(counts.withColumnRenamed(range_code, "range"), "range", "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def catalogue_total(tree: DataFrame) -> DataFrame:
    """Total over non-empty roots, with their number."""
    return tree.filter(F.col("total") > 0).agg(F.count(F.lit(1)).alias("spaces"), F.sum("total").alias("total"),
                                               F.sum("children").alias("subcategories"))
