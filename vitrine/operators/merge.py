"""Merging an import into table snapshots: snapshot in, snapshot out.

A snapshot is never overwritten in place; write the result as the next version and switch readers over.
Every merge is one full outer join on a unique key, so it is one shuffle per side however large the tables.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.ordered import number_rows, with_neighbours


def _sides(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    left = old.select(*keys, F.struct(*old.columns).alias("__old"))
    return left.join(one_per_key(new, keys), list(keys), "full_outer")


def one_per_key(new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ``__new``): an import that repeats a key counts once, with the row whose values sort last. The aggregate
    needs the partitioning of the join that follows anyway."""
    return new.groupBy(*keys).agg(F.max(F.struct(*new.columns)).alias("__new"))


def repeated_keys(new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that an import holds more than once, with ``rows``: for the load report."""
    return new.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def _field(side: str, frame: DataFrame, name: str) -> Column:
    return F.col(side)[name] if name in frame.columns else F.lit(None)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], update: Sequence[str] | None = None) -> DataFrame:
    """Insert new rows; overwrite ``update`` (all non-key columns by default) of existing ones."""
    update = list(update) if update is not None else [c for c in new.columns if c not in keys]
    joined = _sides(old, new, keys)
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in update:
            out.append(F.when(F.col("__new").isNotNull(), _field("__new", new, c)).otherwise(F.col("__old")[c]).alias(c))
        else:
            out.append(F.when(F.col("__old").isNotNull(), F.col("__old")[c]).otherwise(_field("__new", new, c)).alias(c))
    return joined.select(*out)


def insert_only(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing rows keep every value; unknown keys are added."""
    return upsert(old, new, keys, update=[])


def resolve_parents(categories: DataFrame, slug: str = "slug", parent: str = "parent", id_col: str = "id") -> DataFrame:
    """Parent slug -> ``parent_id`` (null for roots)."""
    ids = categories.select(F.col(slug).alias(parent), F.col(id_col).alias("parent_id"))
    return categories.join(ids, parent, "left")


def guarded_upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], edited: str = "edited_at",
                   stamp: str | None = None, now: Column | None = None, drop_stale: bool = False) -> DataFrame:
    """Overwrite only rows nobody edited. ``action``: inserted, updated, kept (edited), untouched, removed.

    With ``drop_stale`` unedited rows missing from the import are marked removed; filter them out when
    writing, count the actions for the load report.
    """
    joined = _sides(old, new, keys)
    had, has = F.col("__old").isNotNull(), F.col("__new").isNotNull()
    locked = had & F.col("__old")[edited].isNotNull()
    action = (
        F.when(has & ~had, "inserted").when(has & locked, "kept").when(has, "updated")
        .when(locked | F.lit(not drop_stale), "untouched").otherwise("removed")
    )
    take_new = has & ~locked
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.col(c))
        elif c == stamp:
            out.append(F.when(take_new, now if now is not None else F.current_timestamp()).otherwise(F.col("__old")[c]).alias(c))
        elif c in new.columns:
            out.append(F.when(take_new, F.col("__new")[c]).otherwise(F.col("__old")[c]).alias(c))
        else:
            out.append(F.col("__old")[c].alias(c))
    return joined.select(*out, action.alias("action"))


def load_metrics(merged: DataFrame) -> DataFrame:
    """Rows per action."""
    return merged.groupBy("action").agg(F.count(F.lit(1)).alias("rows"))


def stale_rows(old: DataFrame, new: DataFrame, keys: Sequence[str], edited: str = "edited_at") -> DataFrame:
    """Rows to delete: not in the import and not edited."""
    return old.filter(F.col(edited).isNull()).join(new.select(*keys).distinct(), list(keys), "left_anti")


def replace_children(old: DataFrame, new: DataFrame, touched: DataFrame, parent: str, url: str,
                     carried: str) -> DataFrame:
    """Children of touched parents come from ``new``, with ``carried`` kept where (parent, url) is unchanged;
    children of other parents stay."""
    stay = old.join(touched.select(parent).distinct(), parent, "left_anti")
    vectors = (old.filter(F.col(carried).isNotNull()).groupBy(parent, url)
               .agg(F.max(carried).alias(carried)))
    fresh = new.drop(carried).join(vectors, [parent, url], "left")
    return stay.unionByName(fresh.select(*old.columns))


def children_of_arrays(df: DataFrame, parent: str, images: str) -> DataFrame:
    """One row per element of an image array; ``sort`` is its position."""
    exploded = df.select(parent, F.posexplode(images).alias("sort", "im"))
    return exploded.select(parent, F.col("im.src").alias("url"), F.col("im.thumb").alias("thumb_url"),
                           F.col("im.w").alias("width"), F.col("im.h").alias("height"), "sort")


def refresh_derived(df: DataFrame, column: str, value: Column, edited: str = "edited_at") -> DataFrame:
    """Recompute a derived column for rows nobody edited."""
    return df.withColumn(column, F.when(F.col(edited).isNull(), value).otherwise(F.col(column)))


BULK_OPERATIONS = {"publish": "published", "hide": "hidden", "review": "review"}
BULK_LIMIT = 500


def bulk_edit(df: DataFrame, edits: DataFrame, key: str, status: str, category: str, edited: str, now: Column,
              op: str = "op", category_id: str = "category_id", order: str | None = None) -> DataFrame:
    """Apply (key, op, category id) edits; each stamps ``edited``. A category edit without an id is ignored.

    A key may be edited more than once: its last change of status and its last change of category count, by ``order`` where given,
    else by name of the operation and id.
    """
    valid = edits.filter((F.col(op) != "category") | F.col(category_id).isNotNull())
    at = F.col(order) if order else F.lit(0)
    to_status = F.create_map(*[F.lit(x) for kv in BULK_OPERATIONS.items() for x in kv])
    changed = F.when(F.col(op).isin(*BULK_OPERATIONS), F.struct(at.alias("at"), F.col(op).alias("v")))
    moved = F.when(F.col(op) == "category", F.struct(at.alias("at"), F.col(category_id).alias("v")))
    picked = valid.groupBy(key).agg(F.max(changed)["v"].alias("__op"), F.max(moved)["v"].alias("__cat"), F.lit(True).alias("__edit"))
    return df.join(picked, key, "left").withColumns({
        status: F.coalesce(F.try_element_at(to_status, F.col("__op")), F.col(status)),
        category: F.coalesce(F.col("__cat"), F.col(category)),
        edited: F.when(F.col("__edit"), now).otherwise(F.col(edited)),
    }).drop("__op", "__cat", "__edit")


def bulk_edit_issue(slugs: Column, op: Column, category_id: Column, limit: int = BULK_LIMIT) -> Column:
    """First problem of a bulk request, or null. ``limit`` is what one request may hold; ``bulk_edit`` itself has none."""
    return (
        F.when(F.coalesce(F.size(slugs), F.lit(0)) < 1, "no rows selected").when(F.size(slugs) > limit, "too many rows")
        .when(~op.isin(*BULK_OPERATIONS, "checked", "category"), "unknown operation")
        .when((op == "category") & category_id.isNull(), "no category")
    )


# ---------------------------------------------------------------- ordered children

def renumber(df: DataFrame, parent: str, order: Sequence[str], out: str = "sort") -> DataFrame:
    """Close the gaps: positions 0..n-1 per parent."""
    return number_rows(df, [parent], order, "__n").withColumn(out, F.col("__n") - 1).drop("__n")


def move_children(df: DataFrame, moves: DataFrame, parent: str, child: str, sort: str = "sort") -> DataFrame:
    """Swap each moved child with its neighbour (direction -1 or 1); at the end of the list nothing moves.

    ``moves`` holds at most one child per parent; a child that is named more than once moves once, up if the directions differ.
    """
    once = moves.groupBy(child).agg(F.min("direction").alias("__dir"))
    marked = df.join(once, child, "left")
    placed = renumber(marked, parent, [sort, child], "__pos")
    around = with_neighbours(placed, [parent], ["__pos"], F.struct(F.col("__dir").alias("d")), "__prev", "__next")
    pos, mine = F.col("__pos"), F.col("__dir")
    new = (
        F.when((mine == -1) & F.col("__prev").isNotNull(), pos - 1)
        .when((mine == 1) & F.col("__next").isNotNull(), pos + 1)
        .when(F.col("__next.d") == -1, pos + 1)
        .when(F.col("__prev.d") == 1, pos - 1)
        .otherwise(pos)
    )
    return around.withColumn(sort, new).drop("__dir", "__pos", "__prev", "__next")


def stamp_touched(products: DataFrame, pictures: DataFrame, changed: DataFrame, parent: str, child: str, key: str,
                  edited: str, now: Column) -> DataFrame:
    """Products whose pictures were moved or removed count as edited: ``changed`` holds the pictures' ids."""
    touched = (pictures.join(changed.select(child).distinct(), child, "left_semi").select(F.col(parent).alias(key)).distinct()
               .withColumn("__touched", F.lit(True)))
    return products.join(touched, key, "left").withColumn(edited, F.when(F.col("__touched"), now).otherwise(F.col(edited))).drop("__touched")


# ---------------------------------------------------------------- validation and audits

def text_issue(value: Column, name: str, longest: int, required: bool = False) -> Column:
    trimmed = F.trim(F.coalesce(value, F.lit("")))
    blank = F.when(trimmed == "", f"{name}: required") if required else F.lit(None)
    return F.coalesce(blank, F.when(F.length(trimmed) > longest, f"{name}: too long"))


def choice_issue(value: Column, name: str, allowed: Sequence[str], optional: bool = False) -> Column:
    bad = ~value.isin(*allowed)
    return F.when(F.coalesce(bad, F.lit(not optional)), f"{name}: not allowed")


def range_issue(pair: Column, name: str, highest: int = 100_000) -> Column:
    ok = (F.size(pair) == 2) & (pair[0] >= 0) & (pair[1] <= highest) & (pair[0] <= pair[1])
    return F.when(pair.isNotNull() & ~F.coalesce(ok, F.lit(False)), f"{name}: bad range")


def size_issue(values: Column, name: str, most: int) -> Column:
    return F.when(F.size(values) > most, f"{name}: too many")


def vector_issue(vector: Column, dims: int) -> Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | F.abs(v).eqNullSafe(F.lit(float("inf"))))
    return F.when(vector.isNull() | (F.size(vector) != dims) | F.coalesce(bad, F.lit(True)), "invalid embedding")


def with_violations(df: DataFrame, issues: Sequence[Column], out: str = "violations") -> DataFrame:
    """All issues in rule order; the first is what an editor is shown."""
    return df.withColumn(out, F.array_compact(F.array(*issues)))


def product_issues(c=F.col) -> list[Column]:
    """The rules of a product edit, over columns named as in the products table."""
    per_size = F.flatten(F.transform(c("sizes"), lambda s: F.array_compact(F.array(*[
        range_issue(s["mm"][a], f"sizes › mm › {a}") for a in ("w", "d", "h", "dia", "seat_h", "arm_h")]))))
    return [
        text_issue(c("code"), "code", 80, required=True),
        *[text_issue(c(n), n, 2000) for n in ("type_th", "type_en")],
        *[text_issue(c(n), n, 4000) for n in ("summary_th", "summary_en")],
        choice_issue(c("material"), "material", ["steel", "wood"], optional=True),
        choice_issue(c("status"), "status", ["published", "review", "hidden"]),
        *[text_issue(c(n), n, 2000) for n in ("note_th", "note_en")],
        *[size_issue(c(n), n, 50) for n in ("features_th", "features_en")],
        size_issue(c("sizes"), "sizes", 10), F.get(per_size, F.lit(0)), size_issue(c("specs"), "specs", 40),
        F.when(F.exists(c("specs"), lambda s: F.trim(F.coalesce(s["label_th"], F.lit(""))) == ""), "specs › label_th: required"),
        F.when(F.exists(c("specs"), lambda s: (F.size(s["values_th"]) > 20) | (F.size(s["values_en"]) > 20)), "specs › values: too many"),
    ]


def repeated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def audit_listing(listing: DataFrame, products: DataFrame, main_of: DataFrame) -> DataFrame:
    """(slug, issue): listed but unknown, listed but not published, repeated code, bad cross-listing.

    ``main_of`` is the taxonomy (range, main), a fixed small table.
    """
    known = products.select("slug", "status")
    joined = listing.join(known, "slug", "left")
    missing = joined.filter(F.col("status").isNull()).select("slug", F.lit("unknown product").alias("issue"))
    hidden = joined.filter(F.col("status") != "published").select("slug", F.lit("not published").alias("issue"))
    twice = listing.join(repeated(listing, ["code"]).select("code"), "code", "left_semi").select(
        "slug", F.lit("repeated code").alias("issue"))
    mains = main_of
    cross = (
        listing.select("slug", "range", F.explode("also").alias("a"))
        .join(mains.select(F.col("range"), F.col("main").alias("m")), "range", "left")
        .join(mains.select(F.col("range").alias("a"), F.col("main").alias("am")), "a", "left")
        .filter((F.col("a") == F.col("range")) | ~F.col("m").eqNullSafe(F.col("am")) | F.col("am").isNull())
        .select("slug", F.lit("bad cross-listing").alias("issue"))
    )
    return missing.unionByName(hidden).unionByName(twice).unionByName(cross.distinct())


def manifest_diff(local: DataFrame, remote: DataFrame, key: str = "key", md5: str = "md5",
                  exempt: Sequence[str] = ("healthcheck.txt",)) -> DataFrame:
    """(key, action): upload new or changed, delete vanished, keep the rest."""
    joined = (local.select(F.col(key), F.col(md5).alias("__l"))
              .join(remote.select(F.col(key), F.col(md5).alias("__r")), key, "full_outer"))
    action = (
        F.when(F.col("__l").isNotNull() & ~F.col("__l").eqNullSafe(F.col("__r")), "upload")
        .when(F.col("__l").isNull() & ~F.col(key).isin(*exempt), "delete").otherwise("keep")
    )
    return joined.select(key, action.alias("action"))


def deletion_is_safe(diff: DataFrame, remote: DataFrame, prune: bool = False) -> bool:
    """False when more than max(50, a tenth of the store) would be deleted and that was not asked for."""
    if prune:
        return True
    deletes = diff.filter(F.col("action") == "delete").count()
    return deletes <= max(50, remote.count() // 10)
