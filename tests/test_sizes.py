import pytest
from pyspark.sql import functions as F

from vitrine.functions import sizes
from vitrine.schemas import SIZE_SET


def run(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    raw = sizes.with_parsed_size(df, "t", "raw")
    out = sizes.with_plausible_size(raw, "raw", "mm", "flag").first()
    strip = lambda r: None if r is None else {k: v for k, v in r.asDict().items() if v is not None}
    return strip(out["raw"]), strip(out["mm"]), out["flag"]


@pytest.mark.parametrize("text, expected", [
    ("กว้าง 120 x ลึก 60-74 x สูง 105 ซม.", {"w": [1200, 1200], "d": [600, 740], "h": [1050, 1050]}),
    ("1.20 x 0.60 x 0.75", {"w": [1200, 1200], "d": [600, 600], "h": [750, 750]}),
    ("Ø 90 x สูง 75 ซม.", {"dia": [900, 900], "h": [750, 750]}),
    ("1200 x 600 mm", {"w": [1200, 1200], "d": [600, 600]}), ("80 x 60", {"w": [800, 800], "d": [600, 600]}), ("800 x 600", {"w": [800, 800], "d": [600, 600]}),
    ("nothing", None)])
def test_parse(spark, text, expected):
    assert run(spark, text)[0] == expected


@pytest.mark.parametrize("text, expected, flag", [
    ("560 x 550 x 790 ซม.", {"w": [560, 560], "d": [550, 550], "h": [790, 790]}, "dims-fixed"),
    ("W 60 D 60 H 11 cm", {"w": [600, 600], "d": [600, 600], "h": [110, 110]}, "dims-suspect"),
    ("W 60 D 60 H 80 cm", {"w": [600, 600], "d": [600, 600], "h": [800, 800]}, None),
    ("W 60 D 60 H 1100 cm", {"w": [600, 600], "d": [600, 600], "h": [1100, 1100]}, "dims-fixed")])
def test_plausible(spark, text, expected, flag):
    assert run(spark, text)[1:] == (expected, flag)


def test_brochure(value):
    got = lambda t: {k: v for k, v in value(sizes.brochure_size, t).asDict().items() if v}
    assert got("1600(W) x 800(D) x 750(H) mm") == {"w": [1600, 1600], "d": [800, 800], "h": [750, 750]}
    assert got("W600*D600*H750") == {"w": [600, 600], "d": [600, 600], "h": [750, 750]}
    assert got("900(Ø) x 750(H)") == {"dia": [900, 900], "h": [750, 750]}
    assert got("W60 D60 H107-117 cm") == {"w": [600, 600], "d": [600, 600], "h": [1070, 1170]}
    assert value(sizes.brochure_size, "no size") is None


def test_axis_measure(value):
    assert value(sizes.axis_measure, "1,200   mm") == [1200, 1200]
    assert value(sizes.axis_measure, "70 - 90 cm") == [700, 900]
    assert value(sizes.axis_measure, "1.2 m") == [1200, 1200]
    assert value(sizes.axis_of_label, "Seat Height") == "seat_h"


def test_texts(spark):
    env = lambda *v: spark.range(1).select(sizes.envelope_text(*[F.lit(x).cast("int") for x in v]).alias("t")).first()["t"]
    assert env(1200, 1200, 600, 600, 745, 745) == "120W x 60D x 74.5H cm"
    assert env(None, None, None, None, 430, 765) == "43–76.5H cm"
    assert env(None, None, None, None, None, None) == ""
    assert env(12000, 12000, None, None, None, None) == "1,200W cm"


def test_envelopes(spark):
    mm = {"w": [500, 600], "d": None, "h": [700, 800], "dia": None, "seat_h": None, "arm_h": None}
    top = {"w": None, "d": None, "h": [100, 200], "dia": [900, 900], "seat_h": None, "arm_h": None}
    sets = [("a", None, "", None, mm), ("b", None, "", None, top)]
    df = spark.createDataFrame([(sets,)], "sizes array<" + SIZE_SET.simpleString() + ">")
    out = df.select(sizes.overall_envelope(F.col("sizes")).alias("o"), sizes.import_envelope(F.col("sizes")[1]["mm"]).alias("i"),
                    F.transform("sizes", lambda s: sizes.size_set_text(s["mm"])).alias("t"), sizes.mm_text(F.col("sizes")[0]["mm"]).alias("m")).first()
    assert tuple(out["o"]) == (500, 900, 900, 900, 100, 800)
    assert tuple(out["i"]) == (900, 900, 900, 900, 100, 200)
    assert out["t"] == ["W 50–60 × H 70–80 cm", "Ø 90 × H 10–20 cm"]
    assert out["m"] == "กว้าง 500-600 x สูง 700-800 มม."


@pytest.mark.parametrize("text, expected", [
    ("W 123456789012345678 x D 20 cm", {"d": [200, 200]}), ("1234567890123456 x 20 x 30 cm", {"d": [200, 200], "h": [300, 300]}),
    (f"{'9' * 400} x {'8' * 30} cm", None), ("W 10-99999999999 x D 20 cm", {"d": [200, 200]}), ("W 1.2.3 x D 20 cm", {"w": [12, 12], "d": [200, 200]}),
    ("2147483 x 1.5", {"w": [2147483, 2147483], "d": [2, 2]}), ("W ... x D ,,, cm", None)])
def test_untidy_numbers_are_no_sizes(spark, text, expected):
    assert run(spark, text)[0] == expected


def test_rescaling_never_leaves_int(spark):
    df = spark.sql("select named_struct('w', array(2147483000, 2147483647), 'd', array(20, 20), 'h', array(30, 30), 'dia', cast(null as array<int>)) as raw")
    out = sizes.with_plausible_size(df, "raw", "mm", "flag").first()
    assert out["flag"] == "dims-suspect" and out["mm"]["d"] in ([20, 20], [200, 200])


@pytest.mark.parametrize("text, expected", [
    ("1.2.3 mm", None), ("... mm", None), ("12345678901234567 mm", None), ("2147483 m", [2147483000, 2147483000]), ("700 - 1.2.3 mm", None),
    ("700 - 900 mm", [700, 900]), ("70 cm", [700, 700])])
def test_axis_measure_of_untidy_text(value, text, expected):
    assert value(sizes.axis_measure, text) == expected
