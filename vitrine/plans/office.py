"""The ordered office catalogue: ranges, stable codes, listing and reports from the published products."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions import language, sizes, textclean
from vitrine.operators import classify, identity, reports
from vitrine.operators.ordered import with_neighbours
from vitrine.rules import ranges as R
from vitrine.session import materialize


def taxonomy_rows() -> list[tuple]:
    """(main number, main, range, range position) of the fixed taxonomy."""
    number = {code: n for n, code, *_ in R.MAINS}
    return [(number[m], m, r, i) for i, (r, m) in enumerate(sorted(classify.range_main_map().items(), key=lambda x: (
        number[x[1]], [s[1] for s in R.SUBS].index(x[0]) if x[0] in {s[1] for s in R.SUBS} else 0)))]


def office_catalogue(products: DataFrame, registry: DataFrame) -> dict[str, DataFrame]:
    """listing, neighbours, registry, gaps, gap_counts, excluded and range_counts.

    ``products``: slug, code, category, type_th, type_en, specs, features_th, features_en, material,
    materials, tags, sizes, image.
    """
    spark = products.sparkSession
    kind = F.trim(F.concat_ws(" ", "type_th", "type_en"))
    spec = F.array_join(F.transform("specs", lambda s: F.concat_ws(" ", s["label_th"], F.array_join(s["values_th"], " "))), " ")
    english = F.array_join(F.flatten(F.transform("specs", lambda s: F.coalesce(s["values_en"], F.array()))), " ")
    rows = products.withColumns({"__kind": kind, "__spec": spec, "__en": english})
    placed = materialize(classify.with_office_range(rows, F.col("category"), F.col("__kind"), F.col("__spec"), F.col("material"), F.col("materials"), F.col("tags")))
    inside = placed.filter(F.col("range").isNotNull()).withColumn("__key", textclean.search_key(F.col("code")))
    coded, new_registry = identity.assign_codes(inside, registry, ["__key", "slug"])

    taxonomy = spark.createDataFrame(taxonomy_rows(), "main_no int, main string, range string, range_no int")
    ordered = coded.join(F.broadcast(taxonomy), "range").withColumn("num", identity.code_number(F.col("cat_code")))
    order = ["main_no", "range_no", "num"]
    listing = ordered.select("slug", F.col("cat_code").alias("code"), "range", "also", *order)
    around = with_neighbours(listing.select("slug", "code", *order), [], order, F.col("code"), "prev_code", "next_code")

    sized = F.exists("sizes", lambda s: sizes.size_set_text(s["mm"]).isNotNull())
    features = language.pick_features(F.col("features_th"), F.col("features_en"))
    tagged = F.arrays_overlap("tags", F.array(*[F.lit(t) for t in R.FEATURE_TAGS]))
    text = F.concat_ws(" ", "__kind", "__spec", "__en")
    gaps = [("photo", F.col("image").isNull()), ("dimensions", ~F.coalesce(sized, F.lit(False))),
            ("material", F.size(classify.printed_materials(F.col("materials"), F.col("range"), F.col("also"), F.col("guessed"))) == 0),
            ("colours", F.size(classify.colours(text)) == 0),
            ("features", (F.coalesce(F.size(features), F.lit(0)) < 1) & ~F.coalesce(tagged, F.lit(False))), ("range-guessed", F.col("guessed"))]
    name = F.coalesce(F.when(F.col("type_en") != "", F.col("type_en")), F.when(F.col("type_th") != "", F.col("type_th")), F.col("code"))
    report = reports.gap_report(ordered.withColumn("name", name), gaps, ["slug", "cat_code", "code", "range", "num", "name"])
    excluded = reports.exclusions(placed.withColumn("name", name), "range", ["slug", "code", "category", "name"])
    return {"listing": listing, "neighbours": around.drop(*order), "registry": new_registry, "gaps": report, "gap_counts": reports.gap_counts(report),
            "excluded": excluded, "range_counts": reports.range_counts(placed, taxonomy.select("range", "main"), "range")}
