from pyspark.sql import functions as F

from vitrine.functions.sizes import brochure_size
from vitrine.operators import extract

SHEET = """ACME CO.,LTD Tel. 02
ประเภทสินค้า : เก้าอี้สำนักงาน
รหัสสินค้า : FG 1
ขนาด : กว้าง 60 x ลึก 60 x สูง 100 ซม.
โครงขา : เหล็ก
  ชุบโครเมียม
: ล้อไนลอน
45 x 60
หมายเหตุ : ไม่รวมอุปกรณ์"""


def sheets(spark, *texts):
    pages = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return {r["id"]: r for r in extract.parse_sheets(extract.lines_of(pages, ["id"], "text"), ["id"]).collect()}


def test_sheet(spark):
    r = sheets(spark, SHEET, "nothing here", "ขนาด : 10 x 10")
    assert set(r) == {0}
    r = r[0]
    assert (r["type"], r["code"], r["note"]) == ("เก้าอี้สำนักงาน", "FG 1", "ไม่รวมอุปกรณ์")
    assert [tuple(s) for s in r["sizes"]] == [("ขนาด", "กว้าง 60 x ลึก 60 x สูง 100 ซม.")]
    assert [(s["label"], s["values"]) for s in r["specs"]] == [("โครงขา", ["เหล็ก ชุบโครเมียม", "ล้อไนลอน"])]


def test_sheet_sections_features_and_repeats(spark):
    r = sheets(spark, "Type : A\nType : B\nmore\nFeature : one\n: two\ngoes on\nSpecification\nlost\nTop : oak\nFeature :\nstill two\nSize : 5\n: 6")[0]
    assert r["type"] == "B more" and r["code"] is None
    assert r["features"] == ["one", "two goes on still two"]
    assert r["sections"] == ["Specification"]
    assert [tuple(s) for s in r["sizes"]] == [("Size", "5"), ("Size", "6")]
    assert [(s["label"], s["values"]) for s in r["specs"]] == [("Top", ["oak"])]


PAGE = """Menu
Rely
intro
Download
Material
Seat
:
Moulded
plywood
Colour
Frame
:
Black
Dimension : Rely-M : Width x Depth x Height
Width
:
700   mm
Seat Height
:
40 - 50 cm
Dimension : Set
Overall
:
2,900 x 2450 x 750 mm
Desk
:
120 x 60 cm
เรื่องน่าสนใจ
Seat
:
no"""


def test_web_page(spark):
    pages = spark.createDataFrame([("u", "Rely", PAGE)], "url string, name string, text string")
    blocks = extract.parse_blocks(pages, ["url"], "text", "name")
    rows = [(r["section"], r["label"], r["value"]) for r in extract.spec_rows(blocks, ["url"]).orderBy("position").collect()]
    assert rows == [("material", "Seat", "Moulded plywood"), ("colour", "Frame", "Black")]
    sets = [(r["label"], {k: v for k, v in r["mm"].asDict().items() if v}) for r in extract.size_sets(blocks, ["url"]).orderBy("set_no").collect()]
    assert sets == [("Rely-M", {"w": [700, 700], "seat_h": [400, 500]}),
                    ("Set · Overall", {"w": [2900, 2900], "d": [2450, 2450], "h": [750, 750]}), ("Set · Desk", {"w": [1200, 1200], "d": [600, 600]})]
    assert extract.introduction(pages, ["url"], "text", "name").first()["summary"] == "intro"


def test_document_paragraphs(spark):
    paras = ["\\", "F9 ตู้เอกสาร", "คุณลักษณะเฉพาะ", "ขนาด กว้าง 90 x ลึก 45 x สูง 180 ซม.", "โครงตู้", "เหล็กหนาพ่นสี อบแห้งอย่างดี", "รหัส : ทิ้ง",
             "สี : ขาว", "ก", "กข", "กขค", "a sentence that is a feature because nothing longer follows it"]
    df = spark.createDataFrame([("d", i, p) for i, p in enumerate(paras)], "file string, position int, paragraph string")
    body = extract.from_title(df, ["file"])
    got = [(r["kind"], r["label"], r["value"]) for r in extract.pair_paragraphs(body, ["file"]).orderBy("position").collect()]
    assert got == [("size", None, paras[3]), ("pair", "โครงตู้", paras[5]), ("pair", "สี", "ขาว"), ("pair", "ก", "กข"), ("pair", "กขค", paras[11])]


def test_markup(spark):
    xml = '<w:p a="1"><w:t>A &amp; </w:t><w:t x="y">B</w:t></w:p><w:p><w:t> </w:t></w:p>'
    df = spark.createDataFrame([(1, xml)], "id int, x string")
    assert [r["paragraph"] for r in extract.paragraphs(df, ["id"], "x", "w:p", "w:t").collect()] == ["A & B"]


def test_word_boxes(spark):
    words = [(10, 100, 40, 110, "FC-634"), (45, 101, 90, 111, "ตู้เอกสาร"), (10, 120, 200, 130, "W900*D450*H1800"),
             (400, 100, 440, 110, "CA"), (445, 100, 480, 110, "501A"), (400, 122, 600, 132, "600(W) x 600(D) x 900(H) mm"), (10, 600, 60, 610, "footer")]
    df = spark.createDataFrame([("f", 1, 1000, 1400, *w) for w in words], "file string, page int, page_w int, page_h int, x0 int, y0 int, x1 int, y1 int, text string")
    lines = extract.word_lines(df, ["file", "page", "page_w", "page_h"])
    assert sorted(r["text"] for r in lines.collect()) == sorted(["FC-634 ตู้เอกสาร", "W900*D450*H1800", "CA 501A", "600(W) x 600(D) x 900(H) mm", "footer"])
    items = extract.nearest_code_above(lines, ["file", "page"], "page_w", "page_h", brochure_size(F.col("text")).isNotNull())
    assert {(r["code"], r["name"], r["size_text"]) for r in items.collect()} == {
        ("FC-634", "ตู้เอกสาร", "W900*D450*H1800"), ("CA 501A", "", "600(W) x 600(D) x 900(H) mm")}
    spans = {r["code"]: (r["left"], r["right"]) for r in extract.column_spans(items, ["file", "page"], "page_w", "page_h").collect()}
    assert spans == {"FC-634": (0, 385), "CA 501A": (370, 740)}
