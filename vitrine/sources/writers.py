"""Writing catalogues, listings and reports; every sink writes in parallel."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_records(records: DataFrame, path: str) -> None:
    records.write.mode("errorifexists").json(path)


def category_rows(categories: DataFrame) -> DataFrame:
    """One row holding the ordered list ``categories`` -> rows with ``sort`` = position."""
    return categories.select(F.posexplode("categories").alias("sort", "c")).select("c.slug", "c.parent", "c.name_th", "c.name_en", "sort")


def brand_rows(brands: DataFrame, logos: DataFrame) -> DataFrame:
    """Brands (slug, name) with the logo address where the file exists, else null. ``logos`` is a manifest."""
    known = logos.select(F.regexp_extract("key", r"^brands/(.*)\.png$", 1).alias("slug")).filter(F.col("slug") != "").distinct()
    return (brands.join(known.withColumn("__has", F.lit(True)), "slug", "left")
            .select("slug", "name", F.when(F.col("__has"), F.concat(F.lit("/media/brands/"), "slug", F.lit(".png"))).alias("logo")))


def export_rows(products: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """Published, categorised products with space, category and cover: the rows of the catalogue export.

    ``categories``: id, slug, parent_id, sort. The nested document would gather a whole space in one value;
    these rows carry the same content, and ``write_export`` lays them out by space and category in order.
    """
    cats = categories.select(F.col("id").alias("category_id"), F.col("slug").alias("category"), F.col("parent_id"), F.col("sort").alias("category_sort"))
    spaces = categories.filter(F.col("parent_id").isNull()).select(F.col("id").alias("parent_id"), F.col("slug").alias("space"), F.col("sort").alias("space_sort"))
    cover = images.filter(F.col("sort") == 0).select(F.col("product_id").alias("id"), F.col("url").alias("image"))
    rows = products.filter((F.col("status") == "published") & F.col("category_id").isNotNull())
    sets = F.transform(F.filter("sizes", lambda s: s["mm"].isNotNull()), lambda s: s["mm"])
    return (
        rows.join(cats.join(spaces, "parent_id"), "category_id").join(cover, "id", "left")
        .select("space", "space_sort", "category", "category_sort", "slug", "code", "type_th", "type_en", "summary_th", "summary_en",
                F.slice("features_th", 1, 6).alias("features_th"), F.slice("features_en", 1, 6).alias("features_en"),
                "materials", "material", "tags", "specs", F.array_contains("flags", "image-from-render").alias("rendered"),
                sets.alias("sizes"), "image")
    )


def write_export(rows: DataFrame, path: str) -> None:
    """JSON lines under space=.../category=..., products in code order across the part files."""
    ordered = rows.orderBy("space_sort", "category_sort", "code", "slug")
    ordered.write.mode("errorifexists").partitionBy("space", "category").json(path)


def write_report(report: DataFrame, path: str, order: Sequence[str | Column]) -> None:
    """CSV with header. Part files are in report order; none of them holds the whole report."""
    report.orderBy(*order).write.mode("errorifexists").option("header", True).csv(path)


def write_listing(listing: DataFrame, path: str, order: Sequence[str | Column]) -> None:
    listing.select("slug", "code", "range", "also").orderBy(*order).write.mode("errorifexists").json(path)
