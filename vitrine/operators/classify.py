"""Classification by ordered rules, lookups, learned votes and provenance."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.patterns import all_matches, extracted, first_match, flags, mapped, matches
from vitrine.functions.textclean import code_family, search_key
from vitrine.operators.ordered import first_per_key
from vitrine.rules import categories as C
from vitrine.rules import ranges as R

Rules = Sequence[tuple[str, str]]


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


# ---------------------------------------------------------------- categories

def categorize(type_text: Column, code: Column, spec_text: Column,
               rules: Rules = C.TYPE_RULES, spec_rules: Rules = C.SPEC_RULES) -> Column:
    """First matching type rule; the spec rules only when the type is blank; else null."""
    subject = F.concat(_text(type_text), F.lit(" | "), _text(code))
    fallback = F.when(F.trim(_text(type_text)) == "", first_match(spec_text, spec_rules))
    return F.coalesce(first_match(subject, rules), fallback)


def tags(text: Column, rules: Rules = C.TAG_RULES, exclusive_suffix: str = "-back") -> Column:
    """All matching tags in rule order, of the exclusive group only the first."""
    found = all_matches(text, rules)
    group = F.filter(found, lambda t: t.endswith(exclusive_suffix))
    return F.filter(found, lambda t: ~t.endswith(exclusive_suffix) | (t == F.get(group, F.lit(0))))


def materials(text: Column, rules: Rules = C.MATERIAL_RULES) -> Column:
    return all_matches(text, rules)


def web_materials(value_texts: Column, rules: Rules = C.WEB_MATERIAL_RULES) -> Column:
    """Sorted distinct materials over an array of value texts."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(value_texts, lambda v: all_matches(v, rules)))))


def seat_count(type_text: Column) -> Column:
    """First number before a seat word: the pattern that matches leftmost wins."""
    thai, english = C.SEAT_PATTERNS
    joined = rf"(?iu){thai}|{english}"
    return F.coalesce(extracted(type_text, joined, 1), extracted(type_text, joined, 2)).cast("int")


def web_category(subcategory: Column, unit: Column, name: Column, subcategories: dict[str, str] = C.SUBCATEGORY_MAP,
                 units: dict[str, str] = C.UNIT_MAP, rules: Rules = C.NAME_RULES) -> Column:
    """Subcategory map, then product-group map, then name rules."""
    return F.coalesce(mapped(subcategory, subcategories), mapped(unit, units),
                      first_match(F.upper(name), rules, ignore_case=False))


def folder_category(folder: Column, by_rule: Column, folders: dict[str, str] = C.FOLDER_MAP,
                    generic: Sequence[str] = C.GENERIC_FOLDERS) -> Column:
    """The folder decides; generic and unknown folders let the rule result go first."""
    default = mapped(folder, folders)
    return F.when(folder.isin(*generic) | default.isNull(), F.coalesce(by_rule, default)).otherwise(default)


def learn_families(df: DataFrame, family: str, category: str, min_votes: int = 2, min_share: float = 0.7) -> DataFrame:
    """Majority category per code family: (family, category, votes, share).

    Two small aggregates: votes per pair, then the best pair and the total per family. Ties go to the
    category that sorts first.
    """
    votes = (
        df.filter(F.col(category).isNotNull() & (F.length(family) >= 2))
        .groupBy(family, category).agg(F.count(F.lit(1)).alias("votes"))
    )
    best = votes.groupBy(family).agg(
        F.sum("votes").alias("__all"),
        F.min_by(F.struct(category, "votes"), F.struct(-F.col("votes"), F.col(category))).alias("__best"))
    share = F.col("__best.votes") / F.col("__all")
    return (
        best.select(family, F.col(f"__best.{category}").alias(category), F.col("__best.votes").alias("votes"),
                    share.alias("share"))
        .filter((F.col("votes") >= min_votes) & (F.col("share") >= min_share))
    )


def with_category_provenance(df: DataFrame, name: str, code: str, default: Column, rules: Rules = C.TYPE_RULES,
                             noisy: Rules = C.NOISY_NAME_RULES, code_rules: Rules = (),
                             extra_flags: Sequence[str] = ("ocr-import",)) -> DataFrame:
    """Category by name, forgiving name, learned family, code rule, then the brochure default.

    Adds ``category`` and ``flags``: category-guessed when only the default was left, category-from-code
    when the code rule decided and the name did not, no-category when nothing did.
    """
    bare = F.trim(F.regexp_replace(_text(F.col(name)), "^[^\u0e00-\u0e7fA-Za-z]+", ""))
    named = F.coalesce(categorize(bare, F.col(code), F.lit(""), rules), first_match(bare, noisy))
    compact = F.replace(F.col(code), F.lit(" "), F.lit(""))
    df = df.withColumns({"__named": named, "__family": code_family(F.col(code)),
                         "__rule": first_match(compact, code_rules, ignore_case=False)})
    learned = learn_families(df, "__family", "__named").select(
        F.col("__family"), F.col("__named").alias("__learned"))
    df = df.join(learned, "__family", "left")
    df = df.withColumn("__found", F.coalesce("__named", "__learned", "__rule")).withColumn("__default", default)
    df = df.withColumn("category", F.coalesce("__found", "__default"))
    from_code = F.col("__found").eqNullSafe(F.col("__rule")) & F.col("__rule").isNotNull() & F.col("__named").isNull()
    df = df.withColumn("flags", F.concat(F.array(*[F.lit(f) for f in extra_flags]), flags(
        ("category-guessed", F.col("__found").isNull()), ("category-from-code", from_code),
        ("no-category", F.col("category").isNull()))))
    return df.drop("__named", "__family", "__rule", "__learned", "__found", "__default")


def type_label(category: Column, otherwise: Column, labels: dict[str, str] = C.TYPE_TH) -> Column:
    return F.coalesce(mapped(category, labels), otherwise)


# ---------------------------------------------------------------- materials and ranges

def main_material(category: Column, type_text: Column, spec_text: Column, source: Column,
                  steel_sources: Sequence[str] = R.STEEL_SOURCES, wood_sources: Sequence[str] = R.WOOD_SOURCES,
                  late_wood_sources: Sequence[str] = ()) -> Column:
    """steel | wood | null. Seating and upholstery have none; the type word decides, then the source
    folder, then board words before steel words, then product lines known to be board."""
    whole = F.concat_ws(" ", type_text, spec_text)
    place = F.upper(_text(source))

    def any_of(patterns: Sequence[str]) -> Column:
        return place.rlike("|".join(patterns)) if patterns else F.lit(False)

    return (
        F.when(_text(category).isin(*R.SEATING, *R.SOFT), None)
        .when(matches(type_text, R.TYPE_STEEL) & ~matches(type_text, R.TYPE_STEEL_LEGS), "steel")
        .when(matches(type_text, R.TYPE_WOOD) & ~matches(type_text, R.TYPE_WOOD_LEGS), "wood")
        .when(any_of(steel_sources), "steel").when(any_of(wood_sources), "wood")
        .when(matches(whole, R.TEXT_WOOD), "wood").when(matches(whole, R.TEXT_STEEL), "steel")
        .when(any_of(late_wood_sources), "wood")
    )


def _has(values: Column, wanted: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap(values, F.array(*[F.lit(w) for w in wanted])), F.lit(False))


def case_material(type_text: Column, material: Column, material_set: Column) -> Column:
    """struct(value, guessed) for a cupboard or shelf."""
    value = (
        F.when(_text(material).isin("steel", "wood"), material)
        .when(_has(material_set, R.WOOD_BOARDS), "wood")
        .when(_has(material_set, ["steel"]) | matches(type_text, R.STEEL), "steel")
    )
    return F.struct(F.coalesce(value, F.lit("wood")).alias("value"), value.isNull().alias("guessed"))


def table_range(type_text: Column, spec_text: Column, material: Column, material_set: Column) -> Column:
    """struct(value, guessed): all steel, wooden top on steel, or wood."""
    whole = F.concat_ws(" ", type_text, spec_text)
    boards = _has(material_set, R.WOOD_BOARDS)
    wood = (_text(material) == "wood") | boards | matches(whole, R.WOOD)
    steel = _has(material_set, ["steel", "chrome"]) | matches(whole, R.STEEL)
    value = (
        F.when((_text(material) == "steel") & ~boards, "TB-ST").when(wood & steel, "TB-WS")
        .when(wood, "TB-WD").when(steel, "TB-ST")
    )
    return F.struct(F.coalesce(value, F.lit("TB-WD")).alias("value"), value.isNull().alias("guessed"))


def office_range(category: Column, type_text: Column, spec_text: Column, material: Column, material_set: Column,
                 tag_set: Column) -> Column:
    """struct(range, also, guessed), or null for a product outside the office catalogue."""
    both = F.concat_ws(" ", type_text, spec_text)
    none = F.array().cast("array<string>")

    def result(code: Column | str, also: Column = none, guessed: Column | bool = False) -> Column:
        return F.struct((F.lit(code) if isinstance(code, str) else code).alias("range"), also.alias("also"),
                        (F.lit(guessed) if isinstance(guessed, bool) else guessed).alias("guessed"))

    def either(case: Column, steel: str, wood: str) -> Column:
        return result(F.when(case["value"] == "steel", steel).otherwise(wood), none, case["guessed"])

    mesh = _has(material_set, ["mesh"]) | matches(type_text, R.MESH)
    leather = _has(material_set, R.LEATHERS) | matches(type_text, R.LEATHER)
    fixed = matches(both, R.FIXED_BASE)
    wheels = _has(tag_set, ["casters"]) | (matches(both, R.WHEELS) & ~fixed) | ((category == "office-chairs") & ~fixed)
    plain = F.when(wheels, "CH-MW").otherwise("CH-MP")
    chair = (
        F.when(mesh, result("CH-NT", F.when(leather, F.array(F.lit("CH-LT"))).otherwise(none)))
        .when(leather, result("CH-LT", F.when(category == "office-chairs", none).otherwise(F.array(plain))))
        .otherwise(result(plain))
    )
    case = case_material(type_text, material, material_set)
    table = table_range(type_text, spec_text, material, material_set)
    outside = matches(type_text, R.NOT_OFFICE)
    shelf = (category == "shelving") | ((category == "storage") & matches(type_text, R.SHELF))
    cupboard = (category == "storage") | ((category == "wardrobes") & matches(type_text, R.STEEL_WARDROBE))
    is_table = category.isin(*R.TABLE_CATEGORIES)
    meeting = (category == "meeting-tables") | (is_table & matches(type_text, R.MEETING))
    return (
        F.when(matches(type_text, R.MOBILE) & ~matches(type_text, R.NOT_MOBILE), result("ST"))
        .when(category.isin(*R.CHAIR_CATEGORIES), chair)
        .when(category.isin(*R.GUEST_CATEGORIES), result("GR"))
        .when(category == "armchairs", F.when(~outside, result("GR")))
        .when(category == "counters", F.when(matches(type_text, R.RECEPTION) & ~outside, result("GR")))
        .when(category == "partitions", F.when(matches(type_text, R.PARTITION), result("PT")))
        .when(shelf, either(case, "SH-ST", "SH-WD"))
        .when(cupboard, either(case, "CB-ST", "CB-WD"))
        .when(meeting, result("TB-MT", F.array(table["value"]), table["guessed"]))
        .when(is_table & ~outside, F.when(matches(type_text, R.CABINET_HEAD), either(case, "CB-ST", "CB-WD"))
              .otherwise(result(table["value"], none, table["guessed"])))
    )


def with_office_range(df: DataFrame, category: Column, type_text: Column, spec_text: Column, material: Column,
                      material_set: Column, tag_set: Column) -> DataFrame:
    """Add ``range``, ``also`` (same main category only) and ``guessed``; all null outside the catalogue.

    The rules are a large expression; a generator evaluates it once per row, where plain columns would be
    copied into every later filter and projection that reads one of the three.
    """
    found = office_range(category, type_text, spec_text, material, material_set, tag_set)
    out = df.select("*", F.inline_outer(F.array(found)))
    return out.withColumn("also", keep_same_main(F.col("range"), F.col("also")))


def range_main_map() -> dict[str, str]:
    """Range code -> main code; a main without subs is its own range."""
    with_subs = {m for m, *_ in R.SUBS}
    own = {code: code for _, code, *_ in R.MAINS if code not in with_subs}
    return {**{r: m for m, r, *_ in R.SUBS}, **own}


def keep_same_main(range_code: Column, also: Column, main_of: dict[str, str] | None = None) -> Column:
    """Cross-listings stay inside the same main category and never repeat the own range."""
    pairs = main_of or range_main_map()
    return F.filter(also, lambda a: (a != range_code) & (mapped(a, pairs) == mapped(range_code, pairs)))


def colours(text: Column, rules: Rules = R.COLOUR_RULES) -> Column:
    to_order = F.when(matches(text, R.COLOUR_TO_ORDER), F.array(F.lit(R.COLOUR_TO_ORDER_NAME)))
    return F.concat(all_matches(text, rules), F.coalesce(to_order, F.array().cast("array<string>")))


def printed_materials(material_set: Column, range_code: Column, also: Column, guessed: Column,
                      names: dict[str, str] = R.MATERIAL_EN,
                      implied: dict[str, list[str]] = R.RANGE_MATERIAL) -> Column:
    """Material names; without any, and unless the range was a guess, those the range implies."""
    found = F.transform(material_set, lambda m: F.coalesce(mapped(m, names), m))
    decisive = F.coalesce(F.when(range_code == "TB-MT", F.get(also, F.lit(0))), range_code)
    by_range = F.create_map(*[x for k, v in implied.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    empty = F.array().cast("array<string>")
    return F.when(F.size(found) > 0, found).otherwise(
        F.when(guessed, empty).otherwise(F.coalesce(F.try_element_at(by_range, decisive), empty)))


# ---------------------------------------------------------------- flags and status

def quality_flags(code: Column, primary: Column, category: Column, dims_flags: Column) -> Column:
    """no-code, no-dimensions, no-category, then the size flags in alphabetical order."""
    blank = F.coalesce(code, F.lit("")) == ""
    return F.concat(flags(("no-code", blank), ("no-dimensions", primary.isNull()), ("no-category", category.isNull())),
                    F.array_sort(F.array_distinct(F.array_compact(dims_flags))))


def status_of(flag_set: Column, review: Sequence[str] = C.REVIEW_FLAGS) -> Column:
    return F.when(_has(flag_set, review), "review").otherwise("published")


def is_photo(w: Column, h: Column) -> Column:
    """Neither a badge nor a sliver."""
    short, long = F.least(w, h), F.greatest(w, h)
    aspect = long / F.greatest(short, F.lit(1))
    return (short >= C.MIN_SIDE) & (aspect <= C.MAX_ASPECT) & ~((long < C.SMALL_SIDE) & (aspect > C.SMALL_ASPECT))


def is_document_photo(w: Column, h: Column) -> Column:
    wide, tall = w / F.greatest(h, F.lit(1)), h / F.greatest(w, F.lit(1))
    return (wide <= C.DOC_MAX_WIDE) & (tall <= C.DOC_MAX_TALL)


def first_pictured_per_code(df: DataFrame, code: str, image: str, ordinal: str) -> DataFrame:
    """One row per search key: the first with a picture, else the first."""
    keyed = df.withColumn("__key", search_key(F.col(code)))
    return first_per_key(keyed, ["__key"], [F.col(image).isNull(), ordinal], df.columns).drop("__key")
