import json

from pyspark.sql import functions as F

from vitrine import schemas
from vitrine.sources import feeds, writers


def test_page_text_tree(spark, tmp_path):
    for folder, file, page, text in [("A", "ราคา 1", 1, "x"), ("A", "sheet+1", 1, "one\ntwo"), ("A", "sheet+1", 12, "three"), ("B", "s", 1, "b")]:
        d = tmp_path / folder / file
        d.mkdir(parents=True, exist_ok=True)
        (d / f"p{page}.txt").write_text(text)
    lines = feeds.without_price_sheets(feeds.brand_of_folder(feeds.read_page_text(spark, str(tmp_path)), {"A": "brand-a"}))
    got = {(r["brand"], r["file"], r["page"], r["line_no"], r["line"]) for r in lines.collect()}
    assert got == {("brand-a", "sheet+1", 1, 0, "one"), ("brand-a", "sheet+1", 1, 1, "two"), ("brand-a", "sheet+1", 12, 0, "three")}


def test_word_boxes(spark, tmp_path):
    d = tmp_path / "b.pdf"
    d.mkdir()
    (d / "p3.json").write_text(json.dumps({"w": 100, "h": 200, "words": [[1, 2, 3, 4, "FC-1", 99], [5, 6, 7, 8, "noise", 30]]}))
    got = [tuple(r) for r in feeds.read_word_boxes(spark, str(tmp_path)).collect()]
    assert got == [("b.pdf", 3, 100, 200, 1, 2, 3, 4, "FC-1", 99.0)]


def test_json_sources(spark, tmp_path):
    assert feeds.read_crawled_pages(spark, str(tmp_path / "absent.json")).count() == 0
    (tmp_path / "products.json").write_text(json.dumps([{"url": "u", "name": "n", "text": "t", "images": ["i"]}]))
    assert feeds.read_crawled_pages(spark, str(tmp_path / "products.json")).first()["images"] == ["i"]
    (tmp_path / "catalog.json").write_text(json.dumps([{"brand": "b", "code": "C", "sizes": [{"mm": {"w": [1, 2]}}], "flags": []}]))
    r = feeds.read_catalog(spark, str(tmp_path / "catalog.json")).first()
    assert r["sizes"][0]["mm"]["w"] == [1, 2] and r["sizes"][0]["mm"]["d"] is None
    (tmp_path / "glossary.csv").write_text("kind,th,en\nphrase,โต๊ะ,table\nphrase,แบบ,\nlabel,ขา,Legs\n")
    assert feeds.glossary_phrases(feeds.read_glossary(spark, str(tmp_path / "glossary.csv"))) == [("โต๊ะ", "table"), ("แบบ", "")]


def test_unite_keeps_feed_order(spark):
    a, b = spark.createDataFrame([(2,), (1,)], "n int"), spark.createDataFrame([(1, "x")], "n int, extra string")
    out = feeds.unite([("second", a), ("first", b)], ["n"]).orderBy("ordinal").collect()
    assert [(r["feed"], r["n"], r["extra"]) for r in out] == [("second", 1, None), ("second", 2, None), ("first", 1, "x")]


def test_manifest_and_brands(spark, tmp_path):
    (tmp_path / "brands").mkdir()
    (tmp_path / "brands" / "one.png").write_bytes(b"x")
    manifest = feeds.file_manifest(spark, str(tmp_path))
    assert [tuple(r) for r in manifest.collect()] == [("brands/one.png", "9dd4e461268c8034f5c8564e155c67a6")]
    brands = spark.createDataFrame([("one", "ONE"), ("two", "TWO")], "slug string, name string")
    assert {r["slug"]: r["logo"] for r in writers.brand_rows(brands, manifest).collect()} == {"one": "/media/brands/one.png", "two": None}


def test_reports_round_trip(spark, tmp_path):
    df = spark.range(50).select(F.col("id"), F.concat(F.lit("n,\"é"), "id").alias("name"))
    writers.write_report(df, str(tmp_path / "r"), ["id"])
    parts = [r["id"] for f in sorted((tmp_path / "r").glob("*.csv")) for r in spark.read.option("header", True).csv(str(f)).collect()]
    assert [int(i) for i in parts] == list(range(50))
    listing = spark.createDataFrame([("b", "CH-02", "CH", []), ("a", "CH-01", "CH", ["X"])], schemas.LISTING)
    writers.write_listing(listing, str(tmp_path / "l"), ["code"])
    assert spark.read.schema(schemas.LISTING).json(str(tmp_path / "l")).count() == 2
    cats = spark.createDataFrame([([("a", None, "A", "A"), ("b", "a", "B", "B")],)], "categories array<struct<slug:string,parent:string,name_th:string,name_en:string>>")
    assert [(r["slug"], r["sort"]) for r in writers.category_rows(cats).collect()] == [("a", 0), ("b", 1)]


def test_card_scan_reads_only_card_columns(spark, tmp_path):
    cols = ("slug code type_th type_en materials material width_min width_max depth_min depth_max height_min height_max specs sizes").split()
    spark.createDataFrame([tuple("x" for _ in cols)], ", ".join(f"{c} string" for c in cols)).write.parquet(str(tmp_path / "p"))
    plan = feeds.card_columns(spark.read.parquet(str(tmp_path / "p")))._jdf.queryExecution().executedPlan().toString()
    assert "specs" not in plan and "sizes" not in plan and "width_min" in plan
