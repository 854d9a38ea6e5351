"""Loading an import into the next version of the catalogue tables."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import language, sizes, textclean
from vitrine.operators import classify, identity, merge
from vitrine.operators.ordered import number_rows
from vitrine.rules import ranges as R
from vitrine.session import materialize


def with_ids(merged: DataFrame, key: list[str], id_col: str = "id") -> DataFrame:
    """Rows without an id get the numbers after the highest one, in key order. The merge is computed once."""
    merged = materialize(merged)
    highest = merged.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("m"))
    have, fresh = merged.filter(F.col(id_col).isNotNull()), merged.filter(F.col(id_col).isNull())
    numbered = number_rows(fresh.drop(id_col), [], key, "__n").withColumn("__top", highest.scalar())
    return have.unionByName(numbered.withColumn(id_col, (F.col("__n") + F.col("__top")).cast("long")).drop("__n", "__top").select(*merged.columns))


def spec_text(specs: Column, features: Column, materials: Column) -> Column:
    rows = F.transform(specs, lambda s: F.concat_ws(" ", s["label_th"], F.array_join(s["values_th"], " "),
                                                    F.array_join(F.filter(s["values_en"], lambda v: v != ""), " ")))
    return F.concat_ws(" ", F.array_join(rows, " "), F.array_join(features, " "), F.array_join(materials, " "))


@dataclass(frozen=True)
class MaterialSources:
    """Patterns of source files whose products are of steel or of wood; ``late_wood`` are product lines that count as wood where nothing else decides.
    They belong to the suppliers at hand."""
    steel: Sequence[str] = tuple(R.STEEL_SOURCES)
    wood: Sequence[str] = tuple(R.WOOD_SOURCES)
    late_wood: Sequence[str] = ()


def product_rows(records: DataFrame, brands: DataFrame, categories: DataFrame, series: DataFrame, sources: MaterialSources = MaterialSources()) -> DataFrame:
    """Records -> rows of the products table, without id and stamps."""
    env = sizes.import_envelope(F.col("dimensions_mm"))
    kind = F.concat_ws(" ", F.coalesce("type_th", F.lit("")), F.coalesce("type_en", F.lit("")), F.col("code"))
    rows = records.withColumns({
        "__env": env, "series_slug": textclean.plain_slug(F.col("series")),
        "material": classify.main_material(F.col("category"), kind, spec_text(F.col("specs"), F.col("features_th"), F.col("materials")), F.col("source.file"),
                                           sources.steel, sources.wood, sources.late_wood)})
    b = brands.select(F.col("id").alias("brand_id"), F.col("slug").alias("brand"))
    c = categories.select(F.col("id").alias("category_id"), F.col("slug").alias("category"))
    s = series.select(F.col("id").alias("series_id"), "brand_id", F.col("slug").alias("series_slug"))
    rows = rows.join(b, "brand").join(c, "category", "left").join(s, ["brand_id", "series_slug"], "left")
    flags = F.array_distinct("flags")
    return rows.select(
        "slug", "brand_id", "series_id", "category_id", "code", textclean.search_key(F.col("code")).alias("code_norm"), "type_th", "type_en",
        "summary_th", "summary_en", "tags", "materials", "seats", "material", "__env.*", "sizes", "specs", "features_th",
        F.transform("features_en", lambda f: F.coalesce(f, F.lit(""))).alias("features_en"), "note_th", "note_en",
        F.col("source.file").alias("source_file"), F.col("source.page").alias("source_page"), flags.alias("flags"),
        classify.status_of(flags).alias("status"))


def load_catalog(snapshot: dict[str, DataFrame], records: DataFrame, brand_rows: DataFrame, category_rows: DataFrame,
                 now: Column | None = None, sources: MaterialSources = MaterialSources()) -> dict[str, DataFrame]:
    """The tables of the next version (brands, categories, series, products, images) and ``metrics``.

    ``snapshot`` holds the current version of those tables. Nothing is overwritten: write the result to a
    new version folder and switch readers, so a failed load leaves the old version in place.
    """
    stamp = now if now is not None else F.current_timestamp()
    brands = with_ids(merge.upsert(snapshot["brands"], brand_rows, ["slug"], ["name", "logo_url"]), ["slug"])
    cats = with_ids(merge.insert_only(snapshot["categories"].drop("parent_id"), category_rows.drop("parent"), ["slug"]), ["slug"])
    parents = category_rows.select("slug", F.col("parent").alias("__parent"))
    parent_ids = cats.select(F.col("slug").alias("__parent"), F.col("id").alias("__pid"))
    old_parent = snapshot["categories"].select("slug", F.col("parent_id").alias("__old"))
    cats = (cats.join(parents.withColumn("__listed", F.lit(True)), "slug", "left").join(parent_ids, "__parent", "left").join(old_parent, "slug", "left")
            .withColumn("parent_id", F.when(F.col("__listed"), F.col("__pid")).otherwise(F.col("__old")))
            .select(*snapshot["categories"].columns))

    named = records.withColumn("series_slug", textclean.plain_slug(F.col("series")))
    latest = identity.last_per_key(named, ["brand", "series_slug"], "ordinal", ["series"])
    b = brands.select(F.col("id").alias("brand_id"), F.col("slug").alias("brand"))
    new_series = latest.join(b, "brand").select("brand_id", F.col("series_slug").alias("slug"), F.col("series").alias("name"))
    series = with_ids(merge.upsert(snapshot["series"], new_series, ["brand_id", "slug"]), ["brand_id", "slug"])

    rows = product_rows(records, brands, cats, series, sources)
    merged = materialize(merge.guarded_upsert(snapshot["products"], rows, ["slug"], stamp="updated_at", now=stamp, drop_stale=True))
    live = merged.filter(F.col("action") != "removed")
    products = with_ids(live.withColumn("created_at", F.coalesce("created_at", stamp)), ["slug"])

    touched = products.filter(F.col("action").isin("inserted", "updated")).select(F.col("id").alias("product_id"), "slug")
    fresh = merge.children_of_arrays(records.join(touched, "slug"), "product_id", "images")
    alive = snapshot["images"].join(products.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    images = merge.replace_children(alive, fresh.withColumn("embedding", F.lit(None).cast("array<float>")), touched, "product_id", "url", "embedding")
    return {"brands": brands, "categories": cats, "series": series, "products": products.drop("action"), "images": images,
            "metrics": merge.load_metrics(merged)}


def _without_blank_values(row: Column) -> Column:
    pairs = language.align_pairs(F.transform(row["values_th"], lambda v: F.trim(v)), row["values_en"])
    return F.struct(row["label_th"].alias("label_th"), row["label_en"].alias("label_en"),
                    F.transform(pairs, lambda p: p["th"]).alias("values_th"), F.transform(pairs, lambda p: p["en"]).alias("values_en"))


def save_product(products: DataFrame, edits: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Apply edited rows (columns as in products): (new products, rejected edits with their first issue).

    Texts are trimmed and blank ones become null, blank feature lines and spec values go with their translation, the
    code key and the envelope are derived, and the product counts as edited.
    """
    trimmed = {c: F.trim(F.col(c)) for c in ("code", "type_th", "type_en", "summary_th", "summary_en", "note_th", "note_en")}
    edits = edits.withColumns({c: v if c == "code" else F.when(v != "", v) for c, v in trimmed.items()})
    checked = merge.with_violations(edits, merge.product_issues())
    good = checked.filter(F.size("violations") == 0).drop("violations")
    pairs = language.align_pairs(F.col("features_th"), F.col("features_en"))
    env = sizes.overall_envelope(F.col("sizes"))
    shaped = good.withColumns({"__pairs": pairs, "__env": env}).withColumns({
        "features_th": F.transform("__pairs", lambda p: p["th"]), "features_en": F.transform("__pairs", lambda p: p["en"]),
        "specs": F.transform("specs", _without_blank_values),
        "code_norm": textclean.search_key(F.col("code")), "edited_at": now if now is not None else F.current_timestamp(),
        **{n: F.col(f"__env.{n}") for n in ("width_min", "width_max", "depth_min", "depth_max", "height_min", "height_max")}})
    known = shaped.drop("__pairs", "__env").join(products.select("slug"), "slug", "left_semi")
    issue = F.element_at("violations", 1)
    return merge.upsert(products, known, ["slug"]), checked.filter(F.size("violations") > 0).select("slug", issue.alias("issue"))
