"""Sizes in text: parsing to millimetre ranges, plausibility repair, and printing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.patterns import extracted, matches
from vitrine.schemas import MM

# How each axis is written on the sheets, in the order they are tried.
AXIS_WORDS = {
    "w": r"(?:กว้าง|กว้า|กวาง|ก\.|ก(?=\s*\d)|W\.?|Width)",
    "d": r"(?:ลึก|ลก|ยาว|D\.?|Depth|L\.?|ล(?=\s*\d))",
    "h": r"(?:สูง|สง|H\.?|Height|ส(?=\s*\d))",
    "dia": r"(?:ø|Ø|⌀|เส้นผ่า(?:น)?ศูนย์กลาง|Dia\.?|DIA\.?)",
}
NUMBER = r"(\d+(?:[.,]\d+)?)"
RANGE = rf"{NUMBER}(?:\s*[-–~]\s*{NUMBER})?"
UNIT_MM = r"(มม|mm)"
UNIT_CM = r"(ซม|cm)"

# Plausible furniture sizes in millimetres.
PLAUSIBLE = {"w": (200, 6000), "d": (10, 4000), "h": (200, 2600), "dia": (200, 3000)}
PARSED_AXES = ["w", "d", "h", "dia"]

# Words that make a line a size line, or the size of a component only.
SIZE_LINE_HEAD = r"ขนาด|กว้าง|[Ww]\s*\d|^\s*\d"
COMPONENT_WORDS = r"เหล็ก|ท่อ|แป๊บ|หนา|เส้นผ่า|โครงสร้าง|ขาเก้าอี้|ขาโต๊ะ|สกรู|ล้อ|รู"

# English axis labels of web pages.
AXIS_LABELS = {
    "width": "w", "depth": "d", "height": "h", "length": "w", "diameter": "dia", "dia": "dia",
    "seat height": "seat_h", "arm height": "arm_h",
}
#: The largest number that is read as a size.
LARGEST = 2_147_483
UNIT_FACTORS = {"mm": 1.0, "cm": 10.0, "m": 1000.0}

# The Thai axis words used when a size text is generated.
AXIS_TH = {"w": "กว้าง", "d": "ลึก", "h": "สูง", "dia": "Ø", "seat_h": "สูงที่นั่ง", "arm_h": "สูงท้าวแขน"}


def _number(text: Column) -> Column:
    """The number, or null if it is none or so large that even in metres its millimetres are no int: untidy text holds no size then."""
    value = F.replace(text, F.lit(","), F.lit(".")).try_cast("double")
    return F.when(value <= LARGEST, value)


def whole_mm(pair: Column) -> Column:
    """[min, max] rounded half-even to int, null where an end is missing or outside int."""
    ends = F.transform(pair, lambda v: F.bround(v, 0).try_cast("int"))
    return F.when(F.forall(ends, lambda v: v.isNotNull()), ends)


def _span(lo: Column, hi: Column) -> Column:
    """struct(lo, hi), hi defaulting to lo; null without lo, or where hi is written but is no size."""
    low, high = _number(lo), _number(hi)
    return F.when(low.isNotNull() & (hi.isNull() | high.isNotNull()), F.struct(low.alias("lo"), F.coalesce(high, low).alias("hi")))


def with_parsed_size(df: DataFrame, text: str, out: str = "mm") -> DataFrame:
    """Add struct ``out`` of [min, max] millimetres for w, d, h, dia, or null when the text holds no size.

    Axis words are looked for first, a bare ``a x b [x c]`` only if there is none. Fractions up to 5 are
    metres; otherwise the unit decides, and without one the magnitude.
    """
    t = F.col(text)
    df = df.withColumns({
        f"__{axis}": _span(extracted(t, rf"(?iu){word}\s*[:=]?\s*{RANGE}", 1),
                           extracted(t, rf"(?iu){word}\s*[:=]?\s*{RANGE}", 2))
        for axis, word in AXIS_WORDS.items()
    })
    bare = rf"{RANGE}\s*[xX×*]\s*{RANGE}(?:\s*[xX×*]\s*{RANGE})?"
    named = F.coalesce(*[F.col(f"__{a}") for a in PARSED_AXES]).isNotNull()
    df = df.withColumn("__bare", F.when(~named, F.array(*[
        F.regexp_extract(t, bare, g) for g in range(1, 7)])))
    piece = lambda i: F.when(F.col("__bare")[i] != "", F.col("__bare")[i])
    df = df.withColumns({
        axis_col: F.coalesce(F.col(axis_col), _span(piece(2 * i), piece(2 * i + 1)))
        for i, axis_col in enumerate(["__w", "__d", "__h"])
    })
    values = F.array_compact(F.array(*[F.col(f"__{a}")[end] for a in PARSED_AXES for end in ("lo", "hi")]))
    df = df.withColumn("__biggest", F.array_max(values)).withColumn(
        "__fraction", F.exists(values, lambda v: v % 1 != 0))
    factor = (
        F.when((F.col("__biggest") <= 5) & F.col("__fraction"), 1000.0)
        .when(matches(t, UNIT_MM), 1.0).when(matches(t, UNIT_CM), 10.0)
        .when(F.col("__biggest") > 400, 1.0).otherwise(10.0)
    )
    df = df.withColumn("__factor", factor)

    def pair(axis: str) -> Column:
        c = F.col(f"__{axis}")
        return F.when(c.isNotNull(), whole_mm(F.array(c["lo"] * F.col("__factor"), c["hi"] * F.col("__factor")))).alias(axis)

    df = df.withColumn(out, F.when(F.col("__biggest").isNotNull(), F.struct(*[pair(a) for a in PARSED_AXES])))
    return df.drop(*[f"__{a}" for a in PARSED_AXES], "__bare", "__biggest", "__fraction", "__factor")


def _times(pair: Column, factor: float) -> Column:
    """The scaled pair, rounded but not cut to int, so that a value that leaves int is judged as it is."""
    return F.transform(pair, lambda v: F.bround(v * F.lit(float(factor)), 0))


def _implausible(pair: Column, axis: str) -> Column:
    lo, hi = PLAUSIBLE[axis]
    return F.coalesce((pair[0] < lo) | (pair[1] > hi), F.lit(False))


def with_plausible_size(df: DataFrame, mm: str, out: str = "mm", flag: str = "dims_flag") -> DataFrame:
    """Repair unit mistakes: rescale the set by 1, 10 or 1/10 (fewest implausible axes, 1 wins ties), then
    shrink single axes that are ten times too large. ``flag`` says dims-fixed, dims-suspect or null."""
    c = F.col(mm)
    options = [1.0, 10.0, 0.1]
    bad_counts = [sum((_implausible(_times(c[a], f), a).cast("int") for a in PARSED_AXES), F.lit(0)) for f in options]
    df = df.withColumn("__factor", F.array_min(F.array(*[
        F.struct(n.alias("bad"), F.lit(i).alias("i"), F.lit(f).alias("f"))
        for i, (n, f) in enumerate(zip(bad_counts, options))]))["f"])
    scaled = {a: whole_mm(F.transform(c[a], lambda v: v * F.col("__factor"))) for a in PARSED_AXES}
    df = df.withColumns({f"__{a}": scaled[a] for a in PARSED_AXES})

    def shrunk(axis: str) -> Column:
        p = F.col(f"__{axis}")
        small = whole_mm(F.transform(p, lambda v: v / F.lit(10.0)))
        use = _implausible(p, axis) & (p[1] > PLAUSIBLE[axis][1]) & ~_implausible(small, axis)
        return F.when(use, small)

    df = df.withColumns({f"__s_{a}": shrunk(a) for a in PARSED_AXES})
    fixed = (F.col("__factor") != 1.0)
    for a in PARSED_AXES:
        fixed = fixed | F.col(f"__s_{a}").isNotNull()
    df = df.withColumn("__fixed", fixed)
    df = df.withColumns({f"__{a}": F.coalesce(F.col(f"__s_{a}"), F.col(f"__{a}")) for a in PARSED_AXES})
    suspect = F.lit(False)
    for a in PARSED_AXES:
        # An axis that left int under the chosen factor is gone; that is suspect, too.
        suspect = suspect | _implausible(F.col(f"__{a}"), a) | (c[a].isNotNull() & F.col(f"__{a}").isNull())
    verdict = F.when(c.isNull(), None).when(suspect, "dims-suspect").when(F.col("__fixed"), "dims-fixed")
    df = df.withColumn(flag, verdict).withColumn(
        out, F.when(c.isNotNull(), F.struct(*[F.col(f"__{a}").alias(a) for a in PARSED_AXES])))
    return df.drop("__factor", "__fixed", *[f"__{a}" for a in PARSED_AXES], *[f"__s_{a}" for a in PARSED_AXES])


def is_size_line(line: Column, mm: Column) -> Column:
    """A line that states the product's own size: two axes, a size word in its head, no component word."""
    axes = sum((F.when(mm[a].isNotNull(), 1).otherwise(0) for a in PARSED_AXES), F.lit(0))
    head = F.when(F.substring(line, 1, 30).contains(":"), F.split(line, ":", 2)[0]).otherwise(F.substring(line, 1, 25))
    return F.coalesce((axes >= 2) & head.rlike(SIZE_LINE_HEAD) & ~head.rlike(COMPONENT_WORDS), F.lit(False))


# The three notations of brochure size lines.
_BN = r"\d{2,4}(?:[.,]\d)?(?:\s*[-–]\s*\d{2,4})?"
BROCHURE_SIZE = (
    rf"(?:({_BN})\s*\(?\s*[WwLl]\s*\)?\s*[xX×*]\s*({_BN})\s*\(?\s*[DdWw]\s*\)?(?:\s*[xX×*]\s*({_BN})\s*\(?\s*[Hh]\s*\)?)?)"
    rf"|(?:[Ww]\s*({_BN})\s*[xX×*]?\s*[Dd]\s*({_BN})(?:\s*[xX×*]?\s*[Hh]\s*({_BN}))?)"
    rf"|(?:({_BN})\s*\(\s*[ØøDd]\s*\)\s*[xX×*]\s*({_BN})\s*\(?\s*[Hh]\s*\)?)"
)


def brochure_size(text: Column) -> Column:
    """struct(w, d, h, dia) of a brochure line, or null; centimetres if the line says so, else millimetres."""
    unit = F.when(matches(text, r"\bcm\b|ซม"), 10).otherwise(1)

    def pair(raw: Column) -> Column:
        ends = F.transform(F.split(F.trim(raw), r"\s*[-–]\s*"), lambda p: F.bround(_number(p), 0) * unit)
        return F.when(raw.isNotNull(), whole_mm(F.array(ends[0], F.element_at(ends, -1))))

    group = lambda i: extracted(text, BROCHURE_SIZE, i)
    round_top = group(7)
    return F.when(text.rlike(BROCHURE_SIZE), F.struct(
        F.when(round_top.isNull(), pair(F.coalesce(group(1), group(4)))).alias("w"),
        F.when(round_top.isNull(), pair(F.coalesce(group(2), group(5)))).alias("d"),
        pair(F.coalesce(group(3), group(6), group(8))).alias("h"),
        pair(round_top).alias("dia"),
    ))


def axis_measure(text: Column) -> Column:
    """[min, max] of ``700 - 900 mm``, ``70 cm`` or ``1.2 m``; millimetres when no unit is given. Digits and points that make no number
    (``1.2.3``, ``...``) or one outside int are no measure."""
    bare = F.replace(text, F.lit(","), F.lit(""))
    rx = r"(?i)^([\d.]+)\s*(?:[-–]\s*([\d.]+))?\s*(mm|cm|m)?"
    first, last = extracted(bare, rx, 1), extracted(bare, rx, 2)
    lo, hi = _number(first), _number(last)
    factor = F.try_element_at(
        F.create_map(*[F.lit(x) for kv in UNIT_FACTORS.items() for x in kv]),
        F.coalesce(F.lower(extracted(bare, rx, 3)), F.lit("mm")))
    return F.when(lo.isNotNull() & (last.isNull() | hi.isNotNull()), whole_mm(F.array(lo * factor, F.coalesce(hi, lo) * factor)))


def axis_of_label(label: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in AXIS_LABELS.items() for x in kv])
    return F.try_element_at(pairs, F.lower(label))


def as_full_mm(mm: Column) -> Column:
    """Pad a parsed struct to the six-axis record type."""
    return F.when(mm.isNotNull(), F.struct(*[
        (mm[f.name] if f.name in PARSED_AXES else F.lit(None).cast(f.dataType)).alias(f.name) for f in MM.fields]))


# ---------------------------------------------------------------- printing

def cm_text(mm: Column, grouping: bool = False) -> Column:
    """Millimetres as centimetres with at most one decimal."""
    value = F.round(mm.cast("double"), 0) / 10
    text = F.format_number(value, 1) if grouping else F.format_string("%.1f", value)
    return F.regexp_replace(text, r"\.0$", "")


def range_text(lo: Column, hi: Column, grouping: bool = False) -> Column:
    one = cm_text(hi, grouping)
    return F.when(lo.isNotNull() & (lo != hi), F.concat(cm_text(lo, grouping), F.lit("–"), one)).otherwise(one)


def envelope_text(w_min: Column, w_max: Column, d_min: Column, d_max: Column, h_min: Column, h_max: Column) -> Column:
    """``120W x 60D x 74.5H cm``; axes without a maximum are left out, empty without any."""
    parts = F.array_compact(F.array(*[
        F.when(F.coalesce(hi, F.lit(0)) != 0, F.concat(range_text(lo, hi, True), F.lit(k)))
        for k, lo, hi in (("W", w_min, w_max), ("D", d_min, d_max), ("H", h_min, h_max))]))
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, " x "), F.lit(" cm"))).otherwise("")


def size_set_text(mm: Column) -> Column:
    """``W 120 × D 60 × H 75 cm`` for one size set; the diameter only when there is no width; null if empty."""
    span = lambda a: range_text(mm[a][0], mm[a][1])
    parts = F.array_compact(F.array(
        F.when(mm["dia"].isNotNull() & mm["w"].isNull(), F.concat(F.lit("Ø "), span("dia"))),
        *[F.when(mm[a].isNotNull(), F.concat(F.lit(f"{a.upper()} "), span(a))) for a in ("w", "d", "h")]))
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, " × "), F.lit(" cm")))


def mm_text(mm: Column) -> Column:
    """The generated Thai size text in millimetres."""
    def one(axis: str, word: str) -> Column:
        p = mm[axis]
        span = F.when(p[0] == p[1], p[0].cast("string")).otherwise(F.concat_ws("-", p[0], p[1]))
        return F.when(p.isNotNull(), F.concat(F.lit(word + " "), span))

    parts = F.array_compact(F.array(*[one(a, w) for a, w in AXIS_TH.items()]))
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, " x "), F.lit(" มม."))).otherwise("")


# ---------------------------------------------------------------- envelopes

def overall_envelope(sizes: Column) -> Column:
    """Min and max over all size sets; a diameter counts as width and as depth (edited products)."""
    def ends(axes: list[str]) -> tuple[Column, Column]:
        pairs = F.flatten(F.transform(sizes, lambda s: F.array_compact(F.array(*[s["mm"][a] for a in axes]))))
        return F.array_min(F.transform(pairs, lambda p: p[0])), F.array_max(F.transform(pairs, lambda p: p[1]))

    (w0, w1), (d0, d1), (h0, h1) = ends(["w", "dia"]), ends(["d", "dia"]), ends(["h"])
    return F.struct(w0.alias("width_min"), w1.alias("width_max"), d0.alias("depth_min"), d1.alias("depth_max"),
                    h0.alias("height_min"), h1.alias("height_max"))


def import_envelope(mm: Column) -> Column:
    """Envelope of the primary size set alone, diameter only where width or depth is missing (imports)."""
    w, d = F.coalesce(mm["w"], mm["dia"]), F.coalesce(mm["d"], mm["dia"])
    return F.struct(w[0].alias("width_min"), w[1].alias("width_max"), d[0].alias("depth_min"),
                    d[1].alias("depth_max"), mm["h"][0].alias("height_min"), mm["h"][1].alias("height_max"))
