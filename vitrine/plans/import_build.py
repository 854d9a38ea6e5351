"""The import: feeds of pages, documents, web pages and brochures -> one de-duplicated record set with slugs."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import language, sizes, textclean
from vitrine.functions.patterns import flags as flag_array
from vitrine.functions.patterns import mapped
from vitrine.operators import classify, extract, identity, segment
from vitrine.rules import categories as C
from vitrine.rules import labels as L
from vitrine.schemas import CATALOG_RECORD, MM, SOURCE
from vitrine.session import materialize
from vitrine.sources.feeds import unite


@dataclass
class Vocabulary:
    """What a supplier's language and conventions look like; all of it small and hand-kept."""
    labels: dict[str, str] = field(default_factory=dict)
    phrases: Sequence[tuple[str, str]] = ()
    code_rules: Sequence[tuple[str, str]] = ()
    brochure_categories: dict[str, str] = field(default_factory=dict)


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _source(file: Column, page: Column, kind: str) -> Column:
    values = {"file": file, "page": page, "kind": F.lit(kind), "images": _null("array<string>"), "prechecked": _null("boolean")}
    return F.struct(*[values[f.name].cast(f.dataType).alias(f.name) for f in SOURCE.fields])


def _conform(df: DataFrame, ordinal: Sequence[str]) -> DataFrame:
    """Record columns in schema order and type, absent ones null or empty, plus the ordinal columns."""
    out = []
    for f in CATALOG_RECORD.fields:
        if f.name in df.columns:
            c = F.col(f.name)
        elif f.dataType.typeName() == "array":
            c = F.array()
        else:
            c = F.lit(None)
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out, *ordinal)


def _size_sets(df: DataFrame, keys: Sequence[str], sets: str, v: Vocabulary) -> DataFrame:
    """(keys, sizes, dims_flags): parsed and repaired size sets in their order."""
    rows = df.select(*keys, F.posexplode(sets).alias("__i", "s")).select(*keys, "__i", "s.label", "s.value")
    rows = sizes.with_plausible_size(sizes.with_parsed_size(rows, "value", "raw"), "raw", "mm", "__flag")
    full = sizes.as_full_mm(F.col("mm")).cast(MM).alias("mm")
    one = F.struct(F.col("label").alias("label_th"), language.translate_label(F.col("label"), v.labels, v.phrases).alias("label_en"),
                   F.col("value").alias("text_th"), language.translate_phrases(F.col("value"), v.phrases).alias("text_en"), full)
    return rows.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("__i").alias("i"), one.alias("s")))), lambda x: x["s"]).alias("sizes"),
        F.array_sort(F.collect_set("__flag")).alias("dims_flags"))


def _primary(size_sets: Column) -> Column:
    return F.get(F.filter(F.transform(size_sets, lambda s: s["mm"]), lambda m: m.isNotNull()), F.lit(0))


def repaired_lines(lines: DataFrame, keys: Sequence[str], dictionary: DataFrame, trusted: DataFrame) -> DataFrame:
    """Lines in dictionary spelling. ``trusted(folder, file, page, text)`` is recognised text of the same pages and of others; it says what is frequent, on
    the page first. Lines with ``exact`` false (exports in which sara am and sara aa look alike) have no reliable vowels."""
    exact = F.bool_and(F.coalesce("exact", F.lit(True))) if "exact" in lines.columns else F.lit(True)
    pages = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("__rows"), exact.alias("__exact"))
    trusted = trusted.withColumn("text", textclean.normalize(F.col("text")))
    own = trusted.groupBy("folder", "file", "page").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("__own"))
    pages = pages.join(own, ["folder", "file", "page"], "left").select(
        *keys, F.transform("__rows", lambda r: r["line_no"]).alias("__numbers"), F.transform("__rows", lambda r: r["line"]).alias("__lines"), "__own", "__exact")
    mended = segment.repair_pages(pages, keys, "__lines", dictionary, trusted, page_text="__own", reliable_vowels=F.col("__exact"))
    return mended.select(*keys, F.explode(F.arrays_zip("__numbers", "__lines")).alias("__row")).select(
        *keys, F.col("__row.__numbers").alias("line_no"), F.col("__row.__lines").alias("line"))


def sheet_records(lines: DataFrame, v: Vocabulary, kind: str = "pdf", dictionary: DataFrame | None = None, trusted: DataFrame | None = None) -> DataFrame:
    """Spec-sheet lines (brand, folder, file, page, line_no, line) -> records ordered by (file, page). With a ``dictionary(word)`` and ``trusted`` text, damaged
    words are repaired first."""
    keys = ["brand", "folder", "file", "page"]
    clean = lines.withColumn("line", textclean.normalize(F.col("line")))
    if dictionary is not None and trusted is not None:
        clean = repaired_lines(clean, keys, dictionary, trusted)
    pages = extract.parse_sheets(clean, keys)
    rows = pages.withColumnRenamed("sizes", "size_lines").join(_size_sets(pages, keys, "sizes", v), keys, "left")
    values = F.flatten(F.transform("specs", lambda s: s["values"]))
    type_th = F.coalesce("type", F.lit(""))
    spec_text = F.array_join(F.transform("specs", lambda s: F.concat(s["label"], F.lit(": "), F.array_join(s["values"], " "))), " ")
    whole = F.concat_ws(" ", type_th, spec_text, F.array_join("features", " "))
    code = F.trim(F.coalesce("code", "file"))
    primary = _primary(F.coalesce("sizes", F.array()))
    category = classify.categorize(type_th, code, F.array_join(values, " "))
    specs = F.transform("specs", lambda s: F.struct(
        s["label"].alias("label_th"), language.translate_label(s["label"], v.labels, v.phrases).alias("label_en"),
        s["values"].alias("values_th"), F.transform(s["values"], lambda x: language.translate_phrases(x, v.phrases)).alias("values_en")))
    rows = rows.withColumns({"__primary": primary, "__category": category})
    out = rows.select(
        *keys, code.alias("code"), textclean.series_of_code(code).alias("series"), type_th.alias("type_th"),
        language.translate_phrases(type_th, v.phrases).alias("type_en"), F.col("__category").alias("category"),
        classify.tags(whole).alias("tags"), classify.materials(whole).alias("materials"), classify.seat_count(type_th).alias("seats"),
        F.coalesce("sizes", F.array().cast(CATALOG_RECORD["sizes"].dataType)).alias("sizes"), F.col("__primary").alias("dimensions_mm"), specs.alias("specs"),
        F.col("features").alias("features_th"), F.transform("features", lambda x: language.translate_phrases(x, v.phrases)).alias("features_en"),
        F.col("note").alias("note_th"), language.translate_phrases(F.col("note"), v.phrases).alias("note_en"),
        _source(F.concat_ws("/", "folder", F.concat("file", F.lit(f".{kind}"))), F.col("page"), kind).alias("source"),
        classify.quality_flags(F.col("code"), F.col("__primary"), F.col("__category"), F.coalesce("dims_flags", F.array())).alias("flags"))
    return _conform(out.withColumns({"at1": F.concat_ws("/", "folder", "file"), "at2": F.col("page")}), ["at1", "at2"])


def document_records(docs: DataFrame, v: Vocabulary, brand: str, min_repeats: int = 3) -> DataFrame:
    """Documents (file, folder, paras, images) -> records; letterhead pictures that repeat are left out."""
    keys = ["file"]
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    paras = docs.select("file", F.posexplode("paras").alias("position", "paragraph"))
    body = extract.from_title(paras, keys)
    titles = body.groupBy("file").agg(F.min_by("paragraph", "position").alias("title"))
    parsed = extract.pair_paragraphs(body, keys)
    entry = lambda k: F.filter("__all", lambda e: e["kind"] == k)
    grouped = parsed.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("position", "kind", "label", "value"))).alias("__all"))
    rows = docs.select("file", "folder", "images").join(titles, "file", "left").join(grouped, "file", "left").withColumn("__stem", stem)
    rows = rows.withColumn("title", F.coalesce("title", "__stem")).withColumn("__all", F.coalesce("__all", F.array().cast(grouped.schema["__all"].dataType)))
    lines = F.transform(entry("size"), lambda e: e["value"])
    rows = rows.withColumn("__lines", F.transform(F.when(F.size(lines) > 0, lines).otherwise(F.array("__stem")),
                                                  lambda x: F.struct(F.lit("ขนาด").alias("label"), x.alias("value"))))
    measured = _size_sets(rows, keys, "__lines", v)
    only = extract.distinct_size_sets(F.filter("sizes", lambda s: s["mm"].isNotNull()))
    measured = measured.select("file", only.alias("sizes"), "dims_flags")

    repeated = identity.decorations(docs.select("file", F.explode("images").alias("im")).select("file", F.col("im.hash").alias("hash")), "hash", "file", min_repeats)
    pictures = docs.select("file", F.explode("images").alias("im")).select("file", "im.*").join(repeated.select("hash"), "hash", "left_anti")
    pictures = pictures.filter(classify.is_document_photo(F.col("w"), F.col("h")))
    largest = pictures.groupBy("file").agg(F.slice(F.sort_array(F.collect_set(F.struct((F.col("w") * F.col("h")).alias("area"), F.col("hash"))), asc=False), 1, 2).alias("__pics"))
    rows = rows.join(measured, "file", "left").join(largest, "file", "left")

    parts = textclean.split_title(F.col("title"), F.element_at(F.split("file", "/"), -1))
    rows = rows.withColumns({"__code": parts["code"], "__name": F.coalesce(F.when(parts["name"] != "", parts["name"]), F.col("title"))})
    pairs = entry("pair")
    by_rule = classify.categorize(F.col("__name"), F.col("__code"), F.array_join(F.transform(pairs, lambda e: e["value"]), " "))
    features = F.filter(F.transform(entry("feature"), lambda e: e["value"]), lambda f: (f != F.col("__name")) & (F.length(f) > 3))
    flags = F.array_sort(F.array_distinct(F.concat(F.coalesce("dims_flags", F.array()), flag_array(
        ("no-dimensions", F.coalesce(F.size("sizes"), F.lit(0)) < 1), ("no-image", F.coalesce(F.size("__pics"), F.lit(0)) < 1)))))
    specs = F.transform(pairs, lambda e: F.struct(
        e["label"].alias("label_th"), language.translate_label(e["label"], v.labels, v.phrases).alias("label_en"),
        F.array(e["value"]).alias("values_th"), F.array(language.translate_phrases(e["value"], v.phrases)).alias("values_en")))
    out = rows.withColumns({"__category": classify.folder_category(F.col("folder"), by_rule), "__features": features}).select(
        "file", F.lit(brand).alias("brand"), F.coalesce(F.when(F.col("__code") != "", F.col("__code")), F.col("__name")).alias("code"),
        textclean.series_code_or_folder(F.col("__code"), F.col("folder")).alias("series"), F.col("__name").alias("type_th"),
        language.translate_phrases(F.col("__name"), v.phrases).alias("type_en"), F.col("__category").alias("category"),
        F.coalesce("sizes", F.array().cast(CATALOG_RECORD["sizes"].dataType)).alias("sizes"), _primary(F.coalesce("sizes", F.array())).alias("dimensions_mm"),
        specs.alias("specs"), F.col("__features").alias("features_th"), F.transform("__features", lambda x: language.translate_phrases(x, v.phrases)).alias("features_en"),
        _source(F.col("file"), F.lit(1), "web").alias("source"), flags.alias("flags"))
    return _conform(out.withColumns({"at1": F.col("file"), "at2": F.lit(1)}), ["at1", "at2"])


def web_records(pages: DataFrame, brand: str) -> DataFrame:
    """Crawled product pages -> records in page order of their address."""
    keys = ["url"]
    named = pages.withColumn("name", F.trim(F.regexp_replace("name", r"\s+", " ")))
    blocks = extract.parse_blocks(named, keys, "text", "name")
    specs = extract.spec_rows(blocks, keys)
    plain = F.col("section").isin("", "material", "other")
    en = F.when(plain, F.col("label")).otherwise(F.concat(F.initcap("section"), F.lit(" · "), "label"))
    th = F.when(plain, language.reverse_label(F.col("label"), L.LABEL_TH)).otherwise(F.concat(
        language.reverse_label(F.col("section"), L.LABEL_TH), F.lit(" · "), language.reverse_label(F.col("label"), L.LABEL_TH)))
    row = F.struct(th.alias("label_th"), en.alias("label_en"), F.array("value").alias("values_th"), F.array("value").alias("values_en"))
    specs = specs.groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", row.alias("r")))), lambda x: x["r"]).alias("specs"))
    sets = extract.size_sets(blocks, keys).join(named.select("url", "name"), "url")
    other = F.col("label").isNotNull() & (F.col("label") != F.col("name"))
    one = F.struct(F.when(other, F.concat(F.lit("ขนาด "), "label")).otherwise("ขนาด").alias("label_th"), F.when(other, F.concat(F.lit("Size "), "label")).otherwise("Size").alias("label_en"),
                   sizes.mm_text(F.col("mm")).alias("text_th"), _null("string").alias("text_en"), F.col("mm"))
    sets = sets.groupBy("url").agg(F.transform(F.array_sort(F.collect_list(F.struct("set_no", one.alias("s")))), lambda x: x["s"]).alias("sizes"))
    rows = named.join(specs, "url", "left").join(sets, "url", "left").join(extract.introduction(named, keys, "text", "name"), "url", "left")
    values = F.transform(F.coalesce("specs", F.array().cast(CATALOG_RECORD["specs"].dataType)), lambda s: s["values_en"][0])
    rows = rows.withColumn("category", classify.web_category(F.col("subcategory"), F.col("unit"), F.col("name")))
    out = rows.select(
        "url", F.lit(brand).alias("brand"), F.upper("name").alias("code"), textclean.series_first_word(F.col("name")).alias("series"),
        classify.type_label(F.col("category"), F.col("subcategory")).alias("type_th"), F.col("subcategory").alias("type_en"), "category",
        F.col("summary").alias("summary_th"), classify.web_materials(values).alias("materials"),
        F.coalesce("sizes", F.array().cast(CATALOG_RECORD["sizes"].dataType)).alias("sizes"), F.get("sizes", F.lit(0))["mm"].alias("dimensions_mm"),
        F.coalesce("specs", F.array().cast(CATALOG_RECORD["specs"].dataType)).alias("specs"), _source(F.col("url"), F.lit(1), "web").alias("source"),
        flag_array(("no-dimensions", F.coalesce(F.size("sizes"), F.lit(0)) < 1), ("no-category", F.col("category").isNull())).alias("flags"))
    return _conform(out.withColumns({"at1": F.col("url"), "at2": F.lit(1)}), ["at1", "at2"])


def brochure_records(words: DataFrame, v: Vocabulary, brand: str, dictionary: DataFrame | None = None) -> DataFrame:
    """Recognised word boxes (file, page, page_w, page_h, x0, y0, x1, y1, text) -> records. With a ``dictionary(word)`` a recognised name of four letters or more that is
    made of its words is the product's type; otherwise the category's name is."""
    keys = ["file", "page"]
    lines = extract.word_lines(words, [*keys, "page_w", "page_h"])
    is_size = sizes.brochure_size(F.col("text")).isNotNull()
    items = extract.nearest_code_above(lines, keys, "page_w", "page_h", is_size)
    items = items.withColumns({"code": textclean.clean_code(F.col("code")), "mm": sizes.brochure_size(F.col("size_text"))})
    items = items.withColumns({"image": _null("string"), "ordinal": F.struct("file", "page", "y0", "x0")})
    first = classify.first_pictured_per_code(items, "code", "image", "ordinal")
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    default = mapped(stem, v.brochure_categories) if v.brochure_categories else _null("string")
    rows = classify.with_category_provenance(first, "name", "code", default, code_rules=v.code_rules)
    names = {slug: th for slug, _, th, _ in C.CATEGORIES}
    full = sizes.as_full_mm(F.col("mm")).cast(MM)
    of_category = F.coalesce(mapped(F.col("category"), names), F.lit(""))
    type_th = of_category
    if dictionary is not None:
        rows = materialize(rows.withColumn("__name", F.trim(F.regexp_replace("name", "^[^\u0e00-\u0e7fA-Za-z]+", ""))))
        readable = segment.readable_names(rows.select("code", "__name"), ["code"], "__name", dictionary)
        rows = rows.join(readable, "code", "left")
        type_th = F.when((F.length("__name") >= 4) & F.coalesce("readable", F.lit(False)), F.col("__name")).otherwise(of_category)
    out = rows.withColumn("__mm", full).select(
        *keys, "ordinal", F.lit(brand).alias("brand"), "code", textclean.series_of_file(F.col("file")).alias("series"),
        type_th.alias("type_th"), "category",
        F.array(F.struct(F.lit("ขนาด").alias("label_th"), F.lit("Size").alias("label_en"), sizes.mm_text(F.col("__mm")).alias("text_th"),
                         F.col("size_text").alias("text_en"), F.col("__mm").alias("mm"))).alias("sizes"),
        F.col("__mm").alias("dimensions_mm"), _source(F.col("file"), F.col("page"), "web").alias("source"), "flags")
    return _conform(out.withColumns({"at1": F.col("file"), "at2": F.col("page")}), ["at1", "at2"])


def build_catalog(feeds: Sequence[tuple[str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(records with slugs, lineage). Feed order, then place in the feed, decides which record is first."""
    records = materialize(unite(feeds, ["at1", "at2", "code"]))
    # Duplicates are found on narrow rows; whole records are only read again for the keepers.
    narrow = records.select("ordinal", "brand", "code", F.col("source.file").alias("file"),
                            textclean.dedupe_key(F.col("code")).alias("__code"), F.coalesce(F.to_json("dimensions_mm"), F.lit("null")).alias("__mm"),
                            F.col("type_th").alias("__type"), F.array_contains("flags", "no-code").alias("__alone"))
    lineage = materialize(identity.dedupe_lineage(narrow, ["__code", "__mm", "__type"], "ordinal", F.col("__alone")))
    kept = lineage.filter(F.col("ordinal") == F.col("keeper")).withColumn("__base", F.concat_ws("-", "brand", textclean.slugify(F.col("code"))))
    slugs = identity.number_slugs(kept.select("ordinal", "__base"), "__base", ["ordinal"], "slug").drop("__base")
    return records.drop("slug").join(slugs, "ordinal"), lineage.select("brand", "code", "file", "ordinal", "keeper")
