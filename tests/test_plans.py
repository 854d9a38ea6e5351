"""From feeds to the printed catalogue on a handful of products."""
import pytest
from pyspark.sql import functions as F

from tests.test_extract import PAGE, SHEET
from vitrine import schemas
from vitrine.operators import identity
from vitrine.plans import import_build, load, office
from vitrine.rules.categories import CATEGORIES
from vitrine.sources import writers

VOCABULARY = import_build.Vocabulary(
    labels={"โครงขา": "Leg frame", "ขนาด": "Size"}, phrases=[("เก้าอี้สำนักงาน", "office chair"), ("เหล็ก", "steel"), ("ไม้", "wood")],
    code_rules=[(r"^FC", "storage")], brochure_categories={"brochure": "storage"})


@pytest.fixture(scope="module")
def built(spark):
    pages = [("b1", "F", "sheet1", 1, SHEET), ("b1", "F", "sheet2", 1, SHEET), ("b2", "G", "sheet3", 1, "ประเภทสินค้า : ตู้เหล็ก\nสูง : x"),
             ("b2", "G", "sheet4", 1, SHEET.replace("60 x สูง", "70 x สูง"))]
    lines = [(*p[:4], i, line) for p in pages for i, line in enumerate(p[4].split("\n"))]
    sheets = spark.createDataFrame(lines, "brand string, folder string, file string, page int, line_no int, line string")
    docs = spark.createDataFrame([
        ("STEEL/F9.docx", "STEEL", ["x", "F9 ตู้เอกสารบานเปิด", "ขนาด กว้าง 90 x ลึก 45 x สูง 180 ซม.", "สี : ขาว"], [("h", 300, 200), ("logo", 100, 100)]),
        ("STEEL/A.docx", "STEEL", ["ตู้ A2"], [("logo", 100, 100)]), ("SOFA/B.docx", "SOFA", ["B3 โซฟา"], [("logo", 100, 100)])], schemas.DOC_PARAGRAPHS)
    web = spark.createDataFrame([("http://w/1", "Rely", "U", "Office Chairs", PAGE, [])], schemas.CRAWLED_PAGE)
    words = [(10, 100, 40, 110, "FC-634"), (10, 120, 200, 130, "W900*D450*H1800")]
    boxes = spark.createDataFrame([("brochure.pdf", 1, 1000, 1400, *w) for w in words], "file string, page int, page_w int, page_h int, x0 int, y0 int, x1 int, y1 int, text string")
    records, lineage = import_build.build_catalog([
        ("sheets", import_build.sheet_records(sheets, VOCABULARY)), ("documents", import_build.document_records(docs, VOCABULARY, "own")),
        ("web", import_build.web_records(web, "web")), ("brochures", import_build.brochure_records(boxes, VOCABULARY, "ocr"))])
    records = records.cache()
    return records, lineage


def test_records(built):
    records, lineage = built
    rows = {r["slug"]: r for r in records.collect()}
    assert set(rows) == {"b1-fg-1", "b2-sheet3", "b2-fg-1", "own-f9", "own-a2", "own-b3", "web-rely", "ocr-fc-634"}
    chair = rows["b1-fg-1"]
    assert (chair["type_en"], chair["category"], chair["series"], chair["flags"]) == ("Office chair", "office-chairs", "FG", [])
    assert chair["dimensions_mm"]["w"] == [600, 600] and chair["specs"][0]["label_en"] == "Leg frame"
    assert chair["materials"] == ["steel", "chrome", "plastic"]
    assert rows["b2-sheet3"]["flags"] == ["no-code", "no-dimensions"] and rows["b2-sheet3"]["category"] == "storage"
    assert (rows["own-f9"]["category"], rows["own-f9"]["flags"], rows["own-f9"]["dimensions_mm"]["h"]) == ("storage", [], [1800, 1800])
    assert rows["own-b3"]["flags"] == ["no-dimensions", "no-image"] and rows["own-b3"]["category"] == "sofas"
    assert rows["web-rely"]["summary_th"] == "intro" and rows["web-rely"]["dimensions_mm"]["seat_h"] == [400, 500]
    assert [s["label_th"] for s in rows["web-rely"]["specs"]] == ["ที่นั่ง", "สี · โครง"]
    assert rows["ocr-fc-634"]["category"] == "storage" and rows["ocr-fc-634"]["flags"] == ["ocr-import", "category-from-code"]
    assert lineage.filter(F.col("ordinal") != F.col("keeper")).count() == 1


def snapshot(spark):
    products = ("id long, slug string, brand_id long, series_id long, category_id long, code string, code_norm string, type_th string, type_en string, summary_th string, "
                "summary_en string, tags array<string>, materials array<string>, seats int, material string, width_min int, width_max int, depth_min int, depth_max int, "
                f"height_min int, height_max int, sizes array<{schemas.SIZE_SET.simpleString()}>, specs array<{schemas.SPEC_ROW.simpleString()}>, features_th array<string>, "
                "features_en array<string>, note_th string, note_en string, source_file string, source_page int, flags array<string>, status string, edited_at timestamp, "
                "created_at timestamp, updated_at timestamp")
    return {"brands": spark.createDataFrame([], "id long, slug string, name string, logo_url string"),
            "categories": spark.createDataFrame([], "id long, parent_id long, slug string, name_th string, name_en string, sort int"),
            "series": spark.createDataFrame([], "id long, brand_id long, slug string, name string"),
            "products": spark.createDataFrame([], products), "images": spark.createDataFrame([], schemas.PRODUCT_IMAGE)}


def keep(tables, folder, spark):
    """Write a version and read it back, as a load does."""
    out = {}
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
        out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def test_load_twice_and_print(built, spark, tmp_path):
    records = built[0].withColumn("images", F.array(F.struct(
        F.concat(F.lit("/media/p/"), "slug", F.lit("/0.webp")).alias("src"), F.lit("t").alias("thumb"), F.lit(10).alias("w"), F.lit(20).alias("h"))))
    brands = spark.createDataFrame([(b, b.upper(), None) for b in ("b1", "b2", "own", "web", "ocr")], "slug string, name string, logo_url string")
    cats = spark.createDataFrame([(s, p, th, en, i) for i, (s, p, th, en) in enumerate(CATEGORIES)], schemas.CATEGORY)
    now = F.lit("2024-06-01").cast("timestamp")
    first = keep(load.load_catalog(snapshot(spark), records, brands, cats, now), tmp_path / "v1", spark)
    assert {r["action"]: r["rows"] for r in first["metrics"].collect()} == {"inserted": 8}
    ids = [r["id"] for r in first["products"].collect()]
    assert sorted(ids) == list(range(1, 9))
    parents = {r["slug"]: r["parent_id"] for r in first["categories"].collect()}
    assert parents["office"] is None and parents["desks"] == {r["slug"]: r["id"] for r in first["categories"].collect()}["office"]

    # A person edits one product and pictures get vectors; the same import again changes neither.
    edited = first["products"].withColumn("edited_at", F.when(F.col("slug") == "own-f9", now)).withColumn(
        "code", F.when(F.col("slug") == "own-f9", "MINE").otherwise(F.col("code")))
    vectors = first["images"].withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    second = keep(load.load_catalog({**first, "products": edited, "images": vectors}, records.filter("slug <> 'web-rely'"), brands, cats, now), tmp_path / "v2", spark)
    assert {r["action"]: r["rows"] for r in second["metrics"].collect()} == {"updated": 6, "kept": 1, "removed": 1}
    rows = {r["slug"]: r for r in second["products"].collect()}
    assert rows["own-f9"]["code"] == "MINE" and "web-rely" not in rows
    assert {r["slug"]: r["id"] for r in rows.values()} == {r["slug"]: r["id"] for r in first["products"].collect() if r["slug"] != "web-rely"}
    assert second["images"].filter(F.col("embedding").isNotNull()).count() == 7 == second["images"].count()

    # Export and office catalogue.
    products = second["products"].join(second["categories"].select(F.col("id").alias("category_id"), F.col("slug").alias("category")), "category_id", "left")
    products = products.join(second["images"].select(F.col("product_id").alias("id"), F.col("url").alias("image")), "id", "left")
    export = writers.export_rows(second["products"], second["images"], second["categories"])
    writers.write_export(export, str(tmp_path / "export"))
    assert spark.read.json(str(tmp_path / "export")).filter("space = 'office' and category = 'storage'").count() == export.filter("category = 'storage'").count() > 0
    empty = spark.createDataFrame([], schemas.REGISTRY)
    out = office.office_catalogue(products.filter("status = 'published'"), empty)
    listing = {r["slug"]: (r["code"], r["range"]) for r in out["listing"].collect()}
    assert listing["b1-fg-1"][1] == "CH-MW" and listing["own-f9"] == ("CB-WD-02", "CB-WD")
    assert {r["slug"] for r in out["gaps"].collect()} <= set(listing)
    chain = {r["code"]: (r["prev_code"], r["next_code"]) for r in out["neighbours"].collect()}
    assert sum(v[0] is None for v in chain.values()) == 1 and sum(v[1] is None for v in chain.values()) == 1
    again = office.office_catalogue(products.filter("status = 'published'"), keep({"r": out["registry"]}, tmp_path / "reg", spark)["r"])
    assert {r["slug"]: (r["code"], r["range"]) for r in again["listing"].collect()} == listing


def test_save_product(spark, built):
    base = snapshot(spark)["products"]
    row = built[0].filter("slug = 'b1-fg-1'").select("slug", "code", "type_th", "type_en", "summary_th", "summary_en", "sizes", "specs", "note_th", "note_en")
    row = row.withColumns({"features_th": F.array(F.lit("a"), F.lit(""), F.lit("b")), "features_en": F.array(F.lit("A"), F.lit("x")),
                           "material": F.lit(None).cast("string"), "status": F.lit("published")})
    products = row.select(*[F.col(f.name) if f.name in row.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in base.schema.fields])
    bad = row.withColumns({"slug": F.lit("bad"), "code": F.lit(" ")})
    saved, rejected = load.save_product(products, row.withColumn("code", F.lit("fg-2")).unionByName(bad))
    r = saved.first()
    assert (r["code"], r["code_norm"], r["features_th"], r["features_en"], r["width_max"]) == ("fg-2", "FG2", ["a", "b"], ["A", ""], 600)
    assert r["edited_at"] is not None
    assert [tuple(x) for x in rejected.collect()] == [("bad", "code: required")]


def test_series_last_name_wins(spark):
    df = spark.createDataFrame([("b", "s", 1, "Old"), ("b", "s", 2, "New")], "brand string, slug string, no int, name string")
    assert identity.last_per_key(df, ["brand", "slug"], "no", ["name"]).first()["name"] == "New"
