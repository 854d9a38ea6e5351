"""Catalogue queries: counts, trees, listings, facets, pages, orders."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.ordered import first_per_key, number_rows, top_per_key
from vitrine.operators.search import like_pattern
from vitrine.session import materialize


# ---------------------------------------------------------------- categories

def category_counts(categories: DataFrame, products: DataFrame, key: str, shown: Column | str | None = None,
                    cover: str | None = None, cover_order: Sequence[str] = ()) -> DataFrame:
    """Every category with its number of (shown) products and, if asked, the cover of its first product.

    One aggregate over the products, combined map-side; the category table is joined to the result.
    """
    rows = products.filter(shown) if shown is not None else products
    aggs = [F.count(F.lit(1)).alias("products")]
    if cover:
        aggs.append(F.min_by(cover, F.when(F.col(cover).isNotNull(), F.struct(*cover_order))).alias("cover"))
    counted = rows.groupBy(key).agg(*aggs)
    out = categories.join(counted, key, "left")
    return out.withColumn("products", F.coalesce(F.col("products"), F.lit(0)).cast("long"))


def category_tree(counts: DataFrame, roots: DataFrame, parent: str, sort: str, cover: str = "cover") -> DataFrame:
    """Roots with the sum over their non-empty children, the number of those, and a cover that falls back
    to the first child that has one."""
    filled = counts.filter(F.col("products") > 0)
    rolled = filled.groupBy(parent).agg(
        F.sum("products").alias("total"), F.count(F.lit(1)).alias("children"),
        F.min_by(cover, F.when(F.col(cover).isNotNull(), F.struct(sort))).alias("__child_cover"))
    out = roots.join(rolled, parent, "left")
    own = F.col(cover) if cover in roots.columns else F.lit(None).cast("string")
    return out.withColumns({
        "total": F.coalesce("total", F.lit(0)).cast("long"), "children": F.coalesce("children", F.lit(0)).cast("long"),
        cover: F.coalesce(own, F.col("__child_cover"))}).drop("__child_cover")


def listing(products: DataFrame, categories: DataFrame, key: str, shown: Column | str | None = None) -> DataFrame:
    """Products of the given categories; empty categories drop out by themselves. Order when writing."""
    rows = products.filter(shown) if shown is not None else products
    return rows.join(categories.select(key).distinct(), key, "left_semi")


def breadcrumbs(categories: DataFrame, id_col: str, parent: str, name: str, separator: str = " › ") -> DataFrame:
    """``label`` "Parent › Child" for children, the name for roots; ``assignable`` marks the children."""
    up = categories.select(F.col(id_col).alias("__pid"), F.col(name).alias("__pname"))
    joined = categories.join(up, F.col(parent) == F.col("__pid"), "left")
    label = F.when(F.col(parent).isNull(), F.col(name)).otherwise(F.concat_ws(separator, "__pname", name))
    return joined.withColumn("label", label).withColumn("assignable", F.col(parent).isNotNull()).drop("__pid", "__pname")


# ---------------------------------------------------------------- products

def first_child(children: DataFrame, parent: str, order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """First child row per parent (the thumb): an aggregate instead of a correlated LIMIT 1."""
    return first_per_key(children, [parent], order, keep)


def detail(products: DataFrame, dimensions: Sequence[tuple[DataFrame, str]], children: DataFrame, parent: str,
           order: Sequence[str]) -> DataFrame:
    """Products with their dimension rows and one row per ordered child (``position`` from 0, null if none)."""
    out = products
    for frame, key in dimensions:
        out = out.join(frame, key, "left")
    placed = number_rows(children, [parent], order, "__n").withColumn("position", F.col("__n") - 1).drop("__n")
    return out.join(placed, parent, "left")


def siblings(products: DataFrame, series: str, code: str, key: str, n: int = 12) -> DataFrame:
    """Up to ``n`` other products of the same series in code order: (key, sibling, position).

    The first n + 1 of a series answer the question for all its members, so each series is reduced to an
    array of n + 1 entries before it meets its members.
    """
    heads = top_per_key(products.select(series, code, key), [series], [code, key], n + 1, "__r")
    packed = heads.groupBy(series).agg(F.sort_array(F.collect_list(F.struct(code, F.col(key).alias("k")))).alias("__heads"))
    others = F.slice(F.filter("__heads", lambda h: h["k"] != F.col(key)), 1, n)
    return (
        products.filter(F.col(series).isNotNull()).select(series, key).join(packed, series)
        .select(key, F.posexplode(F.transform(others, lambda h: h["k"])).alias("position", "sibling"))
    )


#: Rows up to which a page is taken from the head of the order; pages behind are located by ranges.
HEAD_ROWS = 10_000


def filtered_page(products: DataFrame, conditions: Sequence[Column], order: Sequence[str | Column],
                  page: int = 1, size: int = 50, key: str | None = None) -> DataFrame:
    """One page of the rows meeting every condition, with ``total`` and ``pages`` (at least 1).

    With a unique ``key`` no place keeps all rows before a deep page: key and order columns are dealt into ranges of the order, whose sizes tell in
    which of them the page lies (and the total); only those are sorted, and the rows of the page are fetched by key.
    """
    rows = products
    for c in conditions:
        rows = rows.filter(c)
    start = (max(1, page) - 1) * size
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long")
    if key is None or start + size <= HEAD_ROWS:
        total = rows.agg(F.count(F.lit(1)).alias("n"))
        return rows.orderBy(*order).offset(start).limit(size).withColumn("total", total.scalar()).withColumn("pages", pages)
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = materialize(rows.select(*rows.columns).repartitionByRange(*columns).select(key, F.spark_partition_id().alias("__range")))
    sizes = sorted((r["__range"], r["count"]) for r in ranged.groupBy("__range").count().collect())  # one row per range
    before, wanted, skipped = 0, [], 0
    for piece, n in sizes:
        if before + n > start and before < start + size:
            skipped = before if not wanted else skipped
            wanted.append(piece)
        before += n
    near = rows.join(ranged.filter(F.col("__range").isin(wanted)).select(key), key, "left_semi").select(*rows.columns)
    return near.orderBy(*columns).offset(start - skipped).limit(size).withColumn("total", F.lit(before).cast("long")).withColumn("pages", pages)


@dataclass(frozen=True)
class ListFilter:
    """What an editor's list shows. ``category`` is a slug whose subcategories belong to it; ``open`` means that nobody has checked the product; ``q`` may hold
    the wildcards ``%`` and ``_``; ``sort`` is ``code`` or ``updated``, latest first."""
    status: str | None = None
    brand: str | None = None
    category: str | None = None
    flag: str | None = None
    open: bool = False
    q: str | None = None
    page: int = 1
    sort: str = "code"


def listed_products(products: DataFrame, brands: DataFrame, categories: DataFrame, wanted: ListFilter) -> DataFrame:
    """Products that a list filter lets through, with ``brand_slug`` and ``brand`` (its name); an unknown category filters nothing."""
    rows = products.join(brands.select(F.col("id").alias("brand_id"), F.col("slug").alias("brand_slug"), F.col("name").alias("brand")), "brand_id")
    if wanted.status:
        rows = rows.filter(F.col("status") == wanted.status)
    if wanted.brand:
        rows = rows.filter(F.col("brand_slug") == wanted.brand)
    if wanted.flag:
        rows = rows.filter(F.array_contains("flags", wanted.flag))
    if wanted.open:
        rows = rows.filter(F.col("edited_at").isNull())
    if wanted.q:
        like = F.lit(like_pattern(wanted.q))
        hit = F.lit(False)
        for c in ("code", "type_th", "type_en"):
            hit = hit | F.coalesce(F.ilike(F.col(c), like), F.lit(False))
        rows = rows.filter(hit)
    top = categories.filter(F.col("slug") == wanted.category).select("id").first() if wanted.category else None
    if top is not None:
        tree = categories.filter((F.col("id") == top["id"]) | (F.col("parent_id") == top["id"])).select(F.col("id").alias("category_id"))
        rows = rows.join(tree, "category_id", "left_semi")
    return rows


def admin_list(products: DataFrame, brands: DataFrame, categories: DataFrame, images: DataFrame, wanted: ListFilter, size: int = 50) -> DataFrame:
    """One page of an editor's list: slug, code, type_th, status, flags, edited_at, updated_at, brand, category, thumb, total, pages. Equal codes and times are ordered by slug."""
    rows = listed_products(products, brands, categories, wanted)
    order = [F.col("updated_at").desc(), F.col("slug")] if wanted.sort == "updated" else [F.col("code"), F.col("slug")]
    shown = filtered_page(rows, [], order, wanted.page, size, "id")
    # Names and pictures are only looked up for the rows of the page.
    first = images.join(shown.select(F.col("id").alias("product_id")), "product_id", "left_semi").groupBy("product_id").agg(
        F.min_by("thumb_url", F.struct("sort", "thumb_url")).alias("thumb"))
    named = shown.join(categories.select(F.col("id").alias("category_id"), F.col("name_th").alias("category")), "category_id", "left")
    return named.join(first, named["id"] == first["product_id"], "left").select(
        "slug", "code", "type_th", "status", "flags", "edited_at", "updated_at", "brand", "category", "thumb", "total", "pages")


def keyset_next(products: DataFrame, order: Sequence[str], after: Sequence[object], keep: Sequence[str]) -> DataFrame:
    """The first row behind a position in the order: a filter and an aggregate, no sort."""
    here = F.struct(*[F.lit(v).alias(n) for n, v in zip(order, after)])
    rest = products.filter(F.struct(*order) > here)
    return rest.agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("r")).filter(F.col("r").isNotNull()).select("r.*")


def grouped_counts(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def flag_counts(products: DataFrame, flags: str, edited: str) -> DataFrame:
    """Per flag: products carrying it, and those nobody has checked."""
    exploded = products.select(F.explode(F.array_distinct(flags)).alias("flag"), F.col(edited).isNull().alias("__open"))
    return exploded.groupBy("flag").agg(F.count(F.lit(1)).alias("total"), F.count_if("__open").alias("open"))


def review_queue(counts: DataFrame, order: Sequence[tuple[str, int]], informational: Sequence[str] = ()) -> DataFrame:
    """Known flags that occur, in queue order; ``counted_open`` leaves informational flags out."""
    spark = counts.sparkSession
    known = spark.createDataFrame(list(order), "flag string, position int")
    quiet = F.col("flag").isin(*informational) if informational else F.lit(False)
    return (
        counts.join(F.broadcast(known), "flag").filter(F.col("total") > 0)
        .withColumn("counted_open", F.when(quiet, F.lit(0)).otherwise(F.col("open")).cast("long"))
    )


def slug_sample(products: DataFrame, order: Sequence[str], n: int = 24) -> DataFrame:
    return products.orderBy(*order).limit(n)


# ---------------------------------------------------------------- facets

def band_of(value: Column, bands: Sequence[tuple[str, float, float]]) -> Column:
    """Name of the closed band a value lies in; null stays null."""
    chain = None
    for name, lo, hi in bands:
        test = (value >= lo) & (value <= hi)
        chain = F.when(test, F.lit(name)) if chain is None else chain.when(test, F.lit(name))
    return chain


def owners_with_all(df: DataFrame, owner: str, value: str, selected: Sequence[str]) -> DataFrame:
    """Owners that have every selected value in a long table: one flag per value, nothing collected."""
    seen = [F.max((F.col(value) == s).cast("int")).alias(f"__s{i}") for i, s in enumerate(selected)]
    return (df.filter(F.col(value).isin(*selected)).groupBy(owner).agg(*seen)
            .filter(sum((F.col(f"__s{i}") for i in range(len(selected))), F.lit(0)) == len(selected)).select(owner))


def facet_presence(products: DataFrame, values: str, dictionary: Sequence[str]) -> DataFrame:
    """Dictionary values that occur, in dictionary order, with product counts."""
    spark = products.sparkSession
    known = spark.createDataFrame(list(enumerate(dictionary)), "position int, value string")
    counts = products.select(F.explode(F.array_distinct(values)).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(known), "value")


def facet_order(sort: str, code: str, width: str) -> list[Column]:
    """Sort orders of a facet grid; a missing width counts as 0."""
    by_width = F.coalesce(F.col(width), F.lit(0))
    return {"code": [F.col(code).asc_nulls_last()], "width-asc": [by_width.asc(), F.col(code).asc_nulls_last()],
            "width-desc": [by_width.desc(), F.col(code).asc_nulls_last()]}[sort]


# ---------------------------------------------------------------- catalogue order

def own_and_cross_listed(items: DataFrame, range_code: str, also: str) -> DataFrame:
    """One row per (page range, item): own items and see-also items (``own`` false)."""
    own = items.withColumn("page_range", F.col(range_code)).withColumn("own", F.lit(True))
    cross = items.withColumn("page_range", F.explode(F.array_distinct(also))).withColumn("own", F.lit(False))
    return own.unionByName(cross.select(*own.columns))


def contents_tiles(items: DataFrame, taxonomy: DataFrame, range_code: str, main: str, cover: str,
                   order: Sequence[str]) -> DataFrame:
    """Per main category: number of items and the first cover there is in catalogue order."""
    joined = items.join(taxonomy.select(F.col("range").alias(range_code), main), range_code)
    counted = joined.groupBy(main).agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(cover, F.when(F.col(cover).isNotNull(), F.struct(*order))).alias("cover"))
    mains = taxonomy.select(main).distinct()
    return mains.join(counted, main, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def group_ranges(taxonomy: DataFrame, main: str, group: str, position: str) -> DataFrame:
    """Function groups of each main in first-seen order, with the number of ranges."""
    return taxonomy.groupBy(main, group).agg(F.min(position).alias("position"), F.count(F.lit(1)).alias("ranges"))


def entry_label(group_name: Column, range_name: Column, same: Column) -> Column:
    """"Group · Range", or the range alone when it is its own group."""
    return F.when(same | group_name.isNull(), range_name).otherwise(F.concat_ws(" · ", group_name, range_name))


def code_order(key: Column) -> Column:
    """Sort value of a code index: blank keys last."""
    return F.when(key != "", key).otherwise("~")


def source_link(file: Column, page: Column, brochures: Column | None = None) -> Column:
    """struct(kind, label, href) of where a product came from."""
    is_brochure = brochures if brochures is not None else F.lit(False)
    sheet = F.concat(file, F.when(page > 1, F.concat(F.lit(" p. "), page.cast("string"))).otherwise(""))
    return (
        F.when(file.startswith("http"), F.struct(F.lit("web").alias("kind"), F.lit("Product page").alias("label"), file.alias("href")))
        .when(is_brochure, F.struct(F.lit("brochure").alias("kind"), F.concat(file, F.lit(" p. "), page.cast("string")).alias("label"),
                                    F.concat(file, F.lit("#page="), page.cast("string")).alias("href")))
        .when(file == "admin", F.struct(F.lit("manual").alias("kind"), F.lit("Added by hand").alias("label"), F.lit(None).cast("string").alias("href")))
        .otherwise(F.struct(F.lit("sheet").alias("kind"), sheet.alias("label"), F.lit(None).cast("string").alias("href")))
    )
