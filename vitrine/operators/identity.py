"""Duplicates, preferred rows, stable identifiers."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.textclean import canonical_url
from vitrine.functions.vectors import above_mean_bits, differing_bits
from vitrine.operators.ordered import carry_forward, first_per_key, number_rows
from vitrine.session import materialize


def dedupe_lineage(df: DataFrame, keys: Sequence[str], ordinal: str, never_merged: Column | None = None) -> DataFrame:
    """Every record with the ordinal of the record it is merged into (``keeper``; its own for a keeper).

    The first record of a key keeps; a record that may never be merged stands for itself and is the target
    for the records of its key that follow. The lineage stays a table, one row per record, so a key with
    very many copies is never gathered in one place.
    """
    alone = never_merged if never_merged is not None else F.lit(False)
    if never_merged is None:
        first = df.groupBy(*keys).agg(F.min(ordinal).alias("keeper"))
        return _null_safe_join(df, first, keys)
    first = df.groupBy(*keys).agg(F.min(ordinal).alias("__first"))
    df = _null_safe_join(df, first, keys)
    target = F.when(alone | (F.col(ordinal) == F.col("__first")), F.col(ordinal))
    return carry_forward(df, keys, [ordinal], target, "keeper").drop("__first")


def _null_safe_join(df: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                           *[c for c in right.columns if c not in keys])
    cond = None
    for i, k in enumerate(keys):
        test = F.col(k).eqNullSafe(F.col(f"__k{i}"))
        cond = test if cond is None else cond & test
    return df.join(renamed, cond, "left").drop(*[f"__k{i}" for i in range(len(keys))])


def keepers_with_counts(lineage: DataFrame, ordinal: str, brand: str) -> DataFrame:
    """Per keeper: how many records were merged into it and how many of them came from another brand."""
    per_brand = lineage.groupBy("keeper", brand).agg(
        F.count(F.lit(1)).alias("__n"), F.max(F.col(ordinal) == F.col("keeper")).alias("__is_own"))
    return per_brand.groupBy("keeper").agg(
        (F.sum("__n") - 1).alias("also_sources"),
        F.sum(F.when(~F.col("__is_own"), F.col("__n")).otherwise(0)).alias("also_brands"),
    )


def number_slugs(df: DataFrame, base: str, order: Sequence[str], out: str = "slug") -> DataFrame:
    """The base slug; its nth repeat in record order gets ``-n``."""
    numbered = number_rows(df, [base], order, "__n")
    slug = F.when(F.col("__n") == 1, F.col(base)).otherwise(F.concat_ws("-", F.col(base), F.col("__n")))
    return numbered.withColumn(out, slug).drop("__n")


def free_slugs(new_rows: DataFrame, existing: DataFrame, base: str, order: Sequence[str], slug: str = "slug") -> DataFrame:
    """For hand-made products: the base if free, else base-(number of slugs that begin with it + 1).

    New rows are one edit batch and get distinct slugs: those of one base are numbered in ``order``, each counting the ones before it,
    and numbers lie above any that an existing slug or another base of the batch already has.

    A slug begins with a base exactly when one of its prefixes equals it, so slugs are matched by equality on the
    prefix lengths that occur among the new bases; the lengths are a short array, and only slugs that do match are
    shuffled further.
    """
    wanted = new_rows.select(F.col(base).alias("__base")).distinct()
    lengths = wanted.agg(F.collect_set(F.length("__base")).alias("v"))
    known = existing.select(F.col(slug).alias("__slug"), F.lit(1).alias("__old")).unionByName(
        wanted.select(F.col("__base").alias("__slug"), F.lit(0).alias("__old")))
    prefixes = (
        known.withColumn("__len", F.explode(lengths.scalar())).filter(F.length("__slug") >= F.col("__len"))
        .select(F.expr("substring(__slug, 1, __len)").alias("__base"), "__slug", "__old",
                F.expr("try_cast(regexp_extract(substring(__slug, __len + 1), '^-([0-9]{1,15})$', 1) as bigint)").alias("__number"))
    )
    taken = (
        prefixes.join(wanted, "__base", "left_semi").groupBy("__base")
        .agg(F.sum("__old").alias("__taken"), F.max((F.col("__slug") == F.col("__base")) & (F.col("__old") == 1)).alias("__exact"),
             F.max("__number").alias("__highest"))
    )
    numbered = number_rows(new_rows, [base], order, "__nth")
    joined = numbered.join(taken, F.col(base) == F.col("__base"), "left")
    number = F.greatest(F.coalesce("__taken", F.lit(0)), F.coalesce("__highest", F.lit(0))) + F.col("__nth")
    free = (F.col("__nth") == 1) & ~F.coalesce("__exact", F.lit(False))
    out = F.when(free, F.col(base)).otherwise(F.concat_ws("-", F.col(base), number))
    return joined.withColumn("slug", out).drop("__base", "__taken", "__exact", "__highest", "__nth")


def code_number(code: Column) -> Column:
    return F.regexp_extract(code, r"-(\d+)$", 1).try_cast("long")


def code_range(code: Column) -> Column:
    return F.regexp_replace(code, r"-\d+$", "")


def assign_codes(items: DataFrame, registry: DataFrame, order: Sequence[str], slug: str = "slug",
                 range_code: str = "range") -> tuple[DataFrame, DataFrame]:
    """Stable catalogue codes: (items with ``cat_code``, new registry).

    A registered code stays while the range is the same. Others get the next numbers of their range after
    the highest ever used, in ``order``. Codes of moved products stay in the registry as retired rows, so a
    number is never given twice. Only unassigned rows are numbered.
    """
    if "retired" not in registry.columns:
        registry = registry.withColumn("retired", F.lit(False))
    used = registry.groupBy(code_range(F.col("code")).alias(range_code)).agg(F.max(code_number(F.col("code"))).alias("__used"))
    live = registry.filter(~F.col("retired")).select(F.col(slug), F.col("code").alias("__old"))
    # Codes are settled on narrow rows; the items join the result.
    narrow = items.select(*dict.fromkeys([slug, range_code, *order]))
    known = narrow.join(live, slug, "left")
    keeps = F.col("__old").isNotNull() & (code_range(F.col("__old")) == F.col(range_code))
    kept = known.filter(keeps).select(slug, "__old", F.col("__old").alias("cat_code"))
    fresh = number_rows(known.filter(~F.coalesce(keeps, F.lit(False))), [range_code], order, "__n")
    number = F.coalesce(F.col("__used"), F.lit(0)) + F.col("__n")
    padded = F.when(number < 10, F.concat(F.lit("0"), number.cast("string"))).otherwise(number.cast("string"))
    fresh = fresh.join(used, range_code, "left").select(slug, "__old", F.concat_ws("-", range_code, padded).alias("cat_code"))
    codes = kept.unionByName(fresh)
    now = codes.select(F.col(slug), F.col("cat_code").alias("code"), F.lit(False).alias("retired"))
    moved = codes.filter(F.col("__old").isNotNull() & (F.col("__old") != F.col("cat_code"))).select(
        F.col(slug), F.col("__old").alias("code"), F.lit(True).alias("retired"))
    others = registry.select(slug, "code", "retired").join(codes.select(slug).withColumn("retired", F.lit(False)),
                                                           [slug, "retired"], "left_anti")
    return items.join(codes.drop("__old"), slug), now.unionByName(moved).unionByName(others)


def decorations(df: DataFrame, item: str, file: str, min_files: int = 4) -> DataFrame:
    """Items that occur in at least ``min_files`` distinct files: (item, files)."""
    return (
        df.select(item, file).distinct().groupBy(item).agg(F.count(F.lit(1)).alias("files"))
        .filter(F.col("files") >= min_files)
    )


def vote_per_folder(df: DataFrame, folder: str, item: str, pinned: dict[str, str] | None = None) -> DataFrame:
    """Per folder the item shared with the fewest folders, then with the most votes; a pin overrides.

    Ties go to the item that sorts first. (folder, item, folders, votes)
    """
    votes = df.groupBy(folder, item).agg(F.count(F.lit(1)).alias("votes"))
    shared = votes.groupBy(item).agg(F.count(F.lit(1)).alias("folders"))
    both = votes.join(shared, item)
    if pinned:
        pin = F.create_map(*[F.lit(x) for kv in pinned.items() for x in kv])
        both = both.withColumn("__pinned", F.coalesce(F.try_element_at(pin, F.col(folder)) == F.col(item), F.lit(False)))
    else:
        both = both.withColumn("__pinned", F.lit(False))
    order = [(~F.col("__pinned")), F.col("folders"), -F.col("votes"), F.col(item)]
    return first_per_key(both, [folder], order, [item, "folders", "votes"])


def distinct_fingerprints(df: DataFrame, group: str, ordinal: str, vector: str, limit: int = 3,
                          max_share: float = 0.1) -> DataFrame:
    """Greedy keep-first within a group: a picture stays unless its fingerprint differs from one kept before
    in less than ``max_share`` of the bits; at most ``limit`` stay. (group, position, ordinal)

    Round n keeps the first picture of each group that is far from all n-1 kept so far: one partial
    aggregate per round, no pairs, and a group with very many copies is only ever reduced. What is kept so
    far is one row per group. The bits and what each round keeps are written once, so a round is one scan.
    """
    bits = materialize(df.select(group, ordinal, above_mean_bits(F.col(vector)).alias("__bits"), F.size(vector).alias("__size")))
    boxed = F.struct(F.col(ordinal).alias("id"), F.col("__bits").alias("bits"))
    kept = materialize(bits.groupBy(group).agg(F.array(F.min_by(boxed, ordinal)).alias("__kept")))
    for _ in range(limit - 1):
        far = F.forall("__kept", lambda k: differing_bits(k["bits"], F.col("__bits")) >= F.col("__size") * max_share)
        again = bits.join(kept, group).filter((F.col(ordinal) > F.element_at("__kept", -1)["id"]) & far)
        nxt = again.groupBy(group).agg(F.min_by(boxed, ordinal).alias("__next"))
        kept = materialize(kept.join(nxt, group, "left").select(
            group, F.when(F.col("__next").isNull(), F.col("__kept"))
            .otherwise(F.concat("__kept", F.array("__next"))).alias("__kept")))
    return kept.select(group, F.posexplode(F.transform("__kept", lambda k: k["id"])).alias("position", ordinal))


def page_photos(pictures: DataFrame, page: Sequence[str], digest: str, ordinal: str, decoration: DataFrame, photo: Column) -> DataFrame:
    """Photos of each page in their first place: pictures that are no decoration (``decoration(digest)``), look like photos, and do not repeat one before them on
    the page. The first of equal pictures is an aggregate; decorations go by a join on their digest."""
    kept = pictures.filter(photo).join(decoration.select(digest).distinct(), digest, "left_anti")
    return first_per_key(kept, [*page, digest], [ordinal], pictures.columns).select(*pictures.columns)


def hero_first(df: DataFrame, group: str, ordinal: str, area: Column) -> DataFrame:
    """0-based ``sort``: the largest picture first, the others in reading order."""
    hero = first_per_key(df.withColumn("__a", -area), [group], ["__a", ordinal], [ordinal]).withColumnRenamed(ordinal, "__hero")
    marked = df.join(hero, group, "left").withColumn("__rest", F.col(ordinal) != F.col("__hero"))
    return (number_rows(marked, [group], ["__rest", ordinal], "__n")
            .withColumn("sort", F.col("__n") - 1).drop("__n", "__rest", "__hero"))


def pick_hero(df: DataFrame, group: str, image: str, rendered: str, number: str, keep: Sequence[str]) -> DataFrame:
    """Per group the first product with a picture, photos before drawings."""
    return first_per_key(df.filter(F.col(image).isNotNull()), [group], [rendered, number], keep)


def last_per_key(df: DataFrame, keys: Sequence[str], ordinal: str, keep: Sequence[str]) -> DataFrame:
    """Last definition wins (series names, dictionary labels)."""
    best = F.max_by(F.struct(*keep), F.col(ordinal)).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("__best")[c].alias(c) for c in keep])


def crawl_frontier(found: DataFrame, done: DataFrame, url: str, ordinal: str) -> DataFrame:
    """Addresses still to fetch: canonical without query, first sighting kept, finished ones dropped."""
    canonical = found.withColumn("canonical", canonical_url(F.col(url)))
    first = first_per_key(canonical, ["canonical"], [ordinal], found.columns)
    finished = done.select(canonical_url(F.col(url)).alias("canonical")).distinct()
    return first.join(finished, "canonical", "left_anti")


def missing_only(df: DataFrame, result: DataFrame, keys: Sequence[str], redo_all: bool = False) -> DataFrame:
    """Rows without a result yet; all of them on request."""
    return df if redo_all else df.join(result.select(*keys).distinct(), list(keys), "left_anti")
