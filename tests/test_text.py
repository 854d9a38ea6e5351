import pytest
from pyspark.sql import functions as F

from vitrine.functions import language, textclean
from vitrine.functions.vectors import trigram_similarity, trigrams
from vitrine.operators import classify, spelling


def test_mojibake(value):
    assert value(textclean.normalize, "ËÁÒÂàËµØ") == "หมายเหตุ"
    assert value(textclean.normalize, "size Ø 90") == "size Ø 90"
    assert value(textclean.normalize, " x") == "ิ x"
    assert value(textclean.normalize, "นํ้า") == "น้ำ"
    assert value(textclean.normalize, "é") == "é"


def test_mojibake_keeps_runs_that_are_no_thai(value):
    assert value(textclean.repair_mojibake, "ûüý") == "ûüý"


def test_skeleton(value):
    assert value(textclean.skeleton, "เก้าอี้") == "เกาอี"
    assert value(textclean.skeleton, "น้ำ ตาล") == "นาตาล"


def test_marks(value):
    assert value(textclean.tone_sequence, "เก้าอี้") == "้้"
    assert value(textclean.is_mark_subsequence, "้", "่้") is True
    assert value(textclean.is_mark_subsequence, "้่", "่้") is False
    assert value(textclean.is_mark_subsequence, "", "่") is True


@pytest.mark.parametrize("freq, cost", [(0, 10), (9, 8), (99, 6), (999, 4), (100000, 4)])
def test_word_cost(value, freq, cost):
    assert value(lambda c: textclean.word_cost(c.cast("int")), str(freq)) == cost


def test_spacing(value):
    assert value(textclean.fix_thai_spacing, "โ ต๊ ะ ab") == "โต๊ะ ab"


@pytest.mark.parametrize("code, series", [("PILOT-H", "PILOT"), ("FG 1L-T", "FG"), ("123", "123")])
def test_series(value, code, series):
    assert value(textclean.series_of_code, code) == series


def test_other_series_rules(value):
    assert value(textclean.series_first_word, "rely m 2") == "RELY"
    assert value(textclean.series_code_or_folder, "ca-17c", "CHAIR") == "CA"
    assert value(textclean.series_code_or_folder, "", "chair") == "CHAIR"
    assert value(textclean.series_of_file, "some-tea_table_brochure.pdf") == "SOME TEA TABLE"


def test_addresses(value):
    assert value(lambda u: textclean.edition_url(u, True), "/media/p/a/0.webp") == "/media/photo/a/0.webp"
    assert value(lambda u: textclean.edition_url(u, False), "/media/p/a/0.webp") == "/media/p/a/0.webp"
    assert value(textclean.canonical_url, "http://a/b?pg=2?x") == "http://a/b"
    assert value(textclean.media_name, "http://a/b.PNG?x").endswith(".PNG")


@pytest.mark.parametrize("raw, clean", [("SFO11", "SF011"), ("CA5O1A", "CA501A"), ("A—1.", "A-1")])
def test_clean_code(value, raw, clean):
    assert value(textclean.clean_code, raw) == clean


@pytest.mark.parametrize("code, family", [("FC-634", "FC"), ("2CL850A", "2CL"), ("HB-WSD15060", "HB-WSD"), ("99", "")])
def test_family(value, code, family):
    assert value(textclean.code_family, code) == family


@pytest.mark.parametrize("title, file, code, name", [
    ("F9 ตู้เอกสารบานเปิด", "x.docx", "F9", "ตู้เอกสารบานเปิด"), ("51.CO-K2 ชุดครัว", "x.docx", "CO-K2", "ชุดครัว"),
    ("CA-17Cเก้าอี้", "x.docx", "CA-17C", "เก้าอี้"), ("19. ตู้ข้าง", "รุ่น AB 7.docx", "AB-7", "ตู้ข้าง"), ("ตู้ข้าง", "x.docx", "", "ตู้ข้าง")])
def test_title(value, title, file, code, name):
    assert tuple(value(textclean.split_title, title, file)) == (code, name)


def test_keys(value):
    assert {value(textclean.search_key, c) for c in ("FG 1", "fg-1", "FG1")} == {"FG1"}
    assert value(textclean.dedupe_key, "ตู้-1 a") == "ตู้1A"
    assert value(textclean.slugify, "Café Nº 5 / b") == "cafe-no-5-b"
    assert value(textclean.slugify, "ตู้") == "item"


def test_shorten_keeps_marks_with_their_letter(value):
    assert value(lambda c: textclean.shorten(c, 3), "กี่abc") == "กี่…"
    assert value(lambda c: textclean.shorten(c, 2), "กี่abc") == "…"
    assert value(lambda c: textclean.shorten(c, 9), " abc ") == "abc"


def test_trigrams(value):
    assert value(lambda a, b: trigram_similarity(trigrams(a), trigrams(b)), "FG1", "FG1L") == 0.5


GLOSSARY = [("โต๊ะประชุม", "meeting table"), ("โต๊ะ", "table"), ("ที่นั่ง", "-seater"), ("โซฟา", "sofa"), ("ขนาด", "")]


def test_translate(value):
    tr = lambda c: language.translate_phrases(c, GLOSSARY)
    assert value(tr, "โต๊ะประชุม") == "Meeting table"
    assert value(tr, "โต๊ะประชุมไม้") is None
    assert value(tr, "โซฟา 2 ที่นั่ง") == "Sofa 2-seater"
    assert value(tr, "ABC") == "ABC"
    assert value(tr, "ขนาด") is None
    label = lambda c: language.translate_label(c, {"เก้าอี้": "Chair"}, GLOSSARY)
    assert value(label, "เกาอี") == "Chair"
    assert value(label, "โต๊ะ") == "Table"


def test_reverse_label(value):
    assert value(lambda c: language.reverse_label(c, {"seat": "ที่นั่ง"}), " Seat:") == "ที่นั่ง"
    assert value(lambda c: language.reverse_label(c, {"seat": "ที่นั่ง"}), "Unknown") == "Unknown"


def test_spelling_choice(spark):
    index = spelling.dictionary_index(spark.createDataFrame([("ไม่",), ("ไม้",), ("เก้าอี้",), ("นำ",), ("นา",)], "word string"))
    freq = spark.createDataFrame([("ไม่", 5), ("ไม้", 9)], "token string, freq long")
    tokens = spark.createDataFrame([("ไม",), ("ไม่",), ("เกาอี",), ("นำ",), ("xyz",)], "token string")
    got = {r["token"]: r["spelling"] for r in spelling.choose_spelling(tokens, index, freq).collect()}
    assert got == {"ไม": "ไม้", "ไม่": "ไม่", "เกาอี": "เก้าอี้", "นำ": "นำ", "xyz": "xyz"}
    lines = spark.createDataFrame([(1, "a ไม 5 เกาอี", "k")], "id int, line string, other string")
    assert spelling.repair_lines(lines, ["id"], "line", index, freq).first()["line"] == "a ไม้ 5 เก้าอี้"


# ---------------------------------------------------------------- rules

@pytest.mark.parametrize("type_text, code, category", [
    ("โต๊ะข้าง", "", "coffee-tables"), ("โต๊ะข้างโต๊ะทำงาน", "", "desks"), ("เก้าอี้สำนักงาน", "FG 1", "office-chairs"),
    ("SOFA BED", "", "beds"), ("BED SOFA", "", "sofas"), ("เก้าอี้แลคเชอร์", "", "training-chairs"), ("ไม่รู้จัก", "", None)])
def test_categorize(value, type_text, code, category):
    assert value(lambda t: classify.categorize(t, F.lit(code), F.lit("")), type_text) == category


def test_categorize_blank_type_uses_spec(value):
    assert value(lambda t, s: classify.categorize(t, F.lit("X1"), s), " ", "มีล้อ") == "office-chairs"
    assert value(lambda t, s: classify.categorize(t, F.lit("X1"), s), "อื่น", "มีล้อ") is None


def test_tags_keep_one_back_height(value):
    assert value(classify.tags, "พนักพิงเตี้ย พนักพิงสูง มีที่ท้าวแขน") == ["high-back", "armrests"]
    assert value(classify.tags, "ไม่มีที่ท้าวแขน ล้อมรอบ") == []


def test_seats(value):
    assert value(classify.seat_count, "โซฟา 2 ที่นั่ง") == 2
    assert value(classify.seat_count, "3-SEAT sofa") == 3
    assert value(classify.seat_count, "sofa") is None


def test_main_material(value):
    def run(category, type_text, spec, source):
        return value(classify.main_material, category, type_text, spec, source)
    assert run("desks", "โต๊ะทำงาน ขาเหล็ก", "melamine", "a.pdf") == "wood"
    assert run("storage", "ตู้เหล็ก", "", "") == "steel"
    assert run("office-chairs", "เก้าอี้เหล็ก", "", "") is None
    assert run("storage", "ตู้", "", "x/WOOD/y") == "wood"
    assert run("storage", "ตู้", "ไม้PB", "") == "wood"
    assert run("storage", "ตู้", "", "") is None


def test_range_of_chairs_and_tables(spark):
    rows = [("office-chairs", "เก้าอี้ตาข่าย", "", None, [], []), ("visitor-chairs", "เก้าอี้หนัง", "", None, [], []),
            ("training-chairs", "เก้าอี้", "ขาเหล็กดัด", None, [], ["casters"]), ("desks", "โต๊ะทำงาน", "เหล็ก", None, ["melamine"], []),
            ("meeting-tables", "โต๊ะประชุม", "", "steel", [], []), ("storage", "ชั้น", "", "steel", [], []), ("beds", "เตียง", "", None, [], []),
            ("storage", "ตู้รางเลื่อน", "", None, [], []), ("desks", "ตู้ข้าง", "", None, [], [])]
    df = spark.createDataFrame(rows, "category string, t string, s string, material string, mats array<string>, tags array<string>")
    out = classify.with_office_range(df, *[F.col(c) for c in ("category", "t", "s", "material", "mats", "tags")])
    got = [(r["range"], r["also"], r["guessed"]) for r in out.collect()]
    assert got == [("CH-NT", [], False), ("CH-LT", ["CH-MP"], False), ("CH-MW", [], False), ("TB-WS", [], False), ("TB-MT", ["TB-ST"], False),
                   ("SH-ST", [], False), (None, None, None), ("ST", [], False), ("CB-WD", [], True)]


def test_colours(value):
    assert value(classify.colours, "Black frame, สีขาว, infrared, สีมาตรฐาน") == ["Black", "White", "standard colours to order"]


def test_status(value):
    assert value(lambda a: classify.status_of(F.split(a, ",")), "dims-fixed,no-image") == "review"
    assert value(lambda a: classify.status_of(F.split(a, ",")), "dims-fixed") == "published"


def test_trigram_search_matches_brute_force(spark):
    from vitrine.operators import search
    keys = ["REDWIDGET", "REDBOLT", "BLUEBOLT", "WIDGETX", "W", "FG1L", "FG1", "FG12", "XFG1"]
    terms = ["FG1", "WIDGET", "BOLT", "RED", "ZZZ", "W"]
    items = spark.createDataFrame([(k,) for k in keys * 3], "k string")
    asked = spark.createDataFrame([(t,) for t in terms], "t string")

    def grams(s):
        p = "  " + s.lower() + " "
        return {p[i:i + 3] for i in range(len(p) - 2)}
    for threshold in (0.1, 0.3, 0.6):
        want = {(t, k) for t in terms for k in keys if len(grams(t) & grams(k)) / len(grams(t) | grams(k)) >= threshold}
        got = [(r["t"], r["k"]) for r in search.trigram_matches(items, asked, "k", "t", threshold).collect()]
        assert sorted(got) == sorted(want)


def test_long_glossary(spark):
    phrases = [(f"ก{i}ข", f"thing {i}") for i in range(20_000)] + [("โต๊ะ", "table")]
    df = spark.createDataFrame([("โต๊ะ ก19999ข",), ("ก7ข",), ("ก7",), ("plain",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(language.translate_phrases(F.col("t"), phrases)).collect()]
    assert got == ["Table thing 19999", "Thing 7", None, "plain", None, None]


def test_backslash_in_a_search(spark):
    from vitrine.operators import search
    df = spark.createDataFrame([("A1", "a\\b"), ("A2", "a%b"), ("A3", "axb"), ("A4", "a_b")], "code string, name string")
    for query, want in (("a\\b", ["A1"]), ("a\\%b", ["A2"]), ("a_b", ["A1", "A2", "A3", "A4"]), ("a\\_b", ["A4"]), ("\\", ["A1"])):
        got = [r["code"] for r in search.text_search(df, query, ["name"], "code").collect()]
        assert got == want, query
