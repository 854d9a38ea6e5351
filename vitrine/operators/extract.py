"""Structure from semi-structured text: spec sheets, web pages, documents, word boxes.

A page or document is one unit of work: its lines all come from one source row, so a window over them is
bounded by that row. Lines are shuffled to their page once; every window and aggregate below reuses that
partitioning.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from vitrine.functions.patterns import extracted, matches
from vitrine.functions.sizes import axis_measure, axis_of_label, is_size_line, with_parsed_size
from vitrine.functions.textclean import fix_thai_spacing, plain_skeleton, skeleton
from vitrine.functions.vectors import let
from vitrine.rules import labels as L
from vitrine.schemas import AXES


def lines_of(pages: DataFrame, keys: Sequence[str], text: str, line: str = "line", line_no: str = "line_no") -> DataFrame:
    return pages.select(*keys, F.posexplode(F.split(F.col(text), r"\r\n|\r|\n")).alias(line_no, line))


def _joined(texts: Column, separator: str = " ") -> Column:
    """Ordered (position, text) pairs as one string."""
    return F.array_join(F.transform(F.array_sort(texts), lambda s: s["text"]), separator)


# ---------------------------------------------------------------- spec sheets

def _clean(value: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(value, r"\s{2,}", " ")), "^[ :]+|[ :]+$", "")


def _in_labels(skel: Column, words: Sequence[str]) -> Column:
    return skel.isin(*[plain_skeleton(w) for w in words])


def _is_size_label(skel: Column) -> Column:
    test = F.lit(False)
    for p in L.SIZE_PREFIXES:
        test = test | skel.startswith(plain_skeleton(p))
    return test & ~skel.contains(L.NOT_A_SIZE)


def parse_sheets(lines: DataFrame, keys: Sequence[str], line: str = "line", line_no: str = "line_no") -> DataFrame:
    """One row per spec sheet that names a code or a type: code, type, note, sizes, specs, features, sections.

    Reading starts at the first type, code or size label that is not letterhead. ``label : value`` opens a
    field, ``: value`` adds a value to it, any other line continues its last value, a section heading ends it.
    """
    doc = W.partitionBy(*keys)
    order = doc.orderBy("__no")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)

    df = lines.select(*keys, F.col(line_no).alias("__no"), F.trim(F.col(line)).alias("__line")).filter(F.col("__line") != "")
    text = F.col("__line")
    df = df.withColumn("__raw", extracted(text, L.FIELD_LINE))
    df = df.withColumn("__first", skeleton(F.regexp_replace("__raw", L.NUMBERING, "")))
    is_field, raw_label, first_skel = text.rlike(L.FIELD_LINE), F.col("__raw"), F.col("__first")
    named = _in_labels(first_skel, [*L.TYPE_LABELS, *L.CODE_LABELS]) | _is_size_label(first_skel)
    # The letterhead pattern is the slow one: it only runs on lines that could open a sheet.
    opener = F.coalesce(named, F.lit(False)) & ~matches(text, L.LETTERHEAD)
    df = df.withColumn("__start", F.min(F.when(opener, F.col("__no"))).over(doc)).filter(
        (F.col("__no") >= F.col("__start")) & ~text.rlike(L.NUMERIC_LINE))

    after_colon = F.trim(F.coalesce(F.get(F.split(text, ":", 2), F.lit(1)), F.lit("")))
    kind = (
        F.when(matches(text, L.SECTION_LINE) & (after_colon == ""), "section")
        .when(text.rlike(L.VALUE_LINE), "value")
        .when(is_field & raw_label.isNotNull() & (F.length(F.trim(raw_label)) <= 40) & ~raw_label.rlike(L.NUMERIC_LABEL), "field")
        .otherwise("wrapped")
    )
    df = df.withColumn("__kind", kind)
    label = _clean(F.regexp_replace(raw_label, L.NUMBERING, ""))
    df = df.withColumns({"__label": F.when(F.col("__kind") == "field", label)})
    skel = skeleton(F.col("__label"))
    target = (
        F.when(_in_labels(skel, L.TYPE_LABELS), "type").when(_in_labels(skel, L.CODE_LABELS), "code")
        .when(_in_labels(skel, L.NOTE_LABELS), "note").when(_in_labels(skel, L.FEATURE_LABELS), "features")
        .when(_is_size_label(skel), "size").otherwise("spec")
    )
    opened = F.when(F.col("__kind") == "field", F.struct(target.alias("target"), F.col("__label").alias("label"), F.col("__no").alias("no"))).when(
        F.col("__kind") == "section", F.struct(F.lit("section").alias("target"), F.lit(None).cast("string").alias("label"), F.col("__no").alias("no")))
    df = df.withColumn("__gov", F.last(opened, ignorenulls=True).over(so_far))
    value = (
        F.when(F.col("__kind") == "section", _clean(text))
        .when(F.col("__kind") == "value", _clean(F.regexp_extract(text, L.VALUE_LINE, 1)))
        .when(F.col("__kind") == "field", _clean(F.regexp_extract(text, L.FIELD_LINE, 2))).otherwise(_clean(text))
    )
    df = df.select(*keys, "__no", "__kind", F.col("__gov.target").alias("__target"), F.col("__gov.label").alias("__label"),
                   F.col("__gov.no").alias("__field"), value.alias("__value"))
    ignored = (F.col("__target") == "section") & (F.col("__kind") != "section")
    ignored = ignored | ((F.col("__target") == "code") & (F.col("__kind") != "field"))
    df = df.filter(F.col("__target").isNotNull() & ~ignored)
    df = df.filter((F.col("__value") != "") | ((F.col("__kind") == "field") & F.col("__target").isin("type", "code", "note", "size")))

    # Features go on across feature fields; every other field counts its own values.
    df = df.withColumn("__holder", F.when(F.col("__target") == "features", F.lit(-1)).otherwise(F.col("__field")))
    opens_value = F.col("__kind").isin("field", "value", "section")
    df = df.withColumn("__v", F.sum(opens_value.cast("int")).over(
        W.partitionBy(*keys, "__target", "__holder").orderBy("__no").rowsBetween(W.unboundedPreceding, 0)))
    # An opening line that has no value of its own lets the next line start the first one.
    values = df.groupBy(*keys, "__target", "__holder", "__v").agg(
        F.max("__label").alias("label"),
        F.trim(_joined(F.collect_list(F.struct(F.col("__no").alias("no"), F.col("__value").alias("text"))))).alias("text"),
        F.min("__no").alias("no"))
    # One entry per value, in page order; a page has few of them, so the rest is array work within its row.
    pages = values.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        "no", F.col("__target").alias("target"), F.col("__holder").alias("holder"), "label", "text"))).alias("__all"))
    of = lambda t: F.filter("__all", lambda v: v["target"] == t)
    texts = lambda values: F.transform(values, lambda v: v["text"])

    def latest(target: str) -> Column:
        """The values of the last field of this kind, as one text."""
        def joined(values: Column) -> Column:
            last = F.array_max(F.transform(values, lambda v: v["holder"]))
            return let(last, lambda h: F.array_join(texts(F.filter(values, lambda v: v["holder"] == h)), " "))
        return F.trim(let(of(target), joined)).alias(target)

    def spec_list(values: Column) -> Column:
        rows = F.array_distinct(F.transform(values, lambda v: F.struct(v["holder"].alias("holder"), v["label"].alias("label"))))
        return F.transform(rows, lambda r: F.struct(
            r["label"].alias("label"), texts(F.filter(values, lambda v: v["holder"] == r["holder"])).alias("values")))

    sizes = F.transform(of("size"), lambda v: F.struct(v["label"].alias("label"), v["text"].alias("value")))
    pages = pages.select(*keys, latest("code"), latest("type"), latest("note"), sizes.alias("sizes"), let(of("spec"), spec_list).alias("specs"),
                         texts(of("features")).alias("features"), texts(of("section")).alias("sections"))
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    return pages.withColumns({c: blank(c) for c in ("code", "type", "note")}).filter(
        F.col("code").isNotNull() | F.col("type").isNotNull())


# ---------------------------------------------------------------- web pages

def _web_lines(pages: DataFrame, keys: Sequence[str], text: str, name: str) -> DataFrame:
    body = F.col(text)
    title = F.trim(F.col(name))
    start = F.locate(L.WEB_START_MARK, body)
    start = F.when((title != "") & body.contains(title), F.position(title, body)).otherwise(start)
    end = F.locate(L.WEB_END_MARK, body)
    part = F.when(end > 1, F.substr(body, start, F.greatest(end - start, F.lit(0)))).otherwise(F.substr(body, start))
    cut = pages.select(*keys, title.alias("__name"), F.when(start > 0, part).alias("__body"))
    return (
        cut.select(*keys, "__name", F.posexplode(F.split("__body", r"\r\n|\r|\n")).alias("__no", "__line"))
        .withColumn("__line", F.regexp_replace("__line", r"^[\s\x{a0}]+|[\s\x{a0}]+$", ""))
        .filter((F.col("__line") != "") & ~F.col("__line").isin(*L.WEB_FURNITURE))
    )


def parse_blocks(pages: DataFrame, keys: Sequence[str], text: str, name: str) -> DataFrame:
    """Label rows of flattened product pages: keys, position, kind (row | axis | triple | dimension),
    section, label, value, variant, set_no.

    A label is a line whose next line is ":"; its value is everything up to the next label, section word or
    dimension heading. ``size_sets`` and ``spec_rows`` turn the result into size sets and spec rows.
    """
    order = W.partitionBy(*keys).orderBy("__no")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    df = _web_lines(pages, keys, text, name)
    low = F.lower(F.col("__line"))
    df = df.withColumns({"__is_label": F.coalesce(F.lead("__line").over(order) == ":", F.lit(False)),
                         "__after": F.coalesce(F.lag("__line", 1).over(order), F.lit(""))})
    sure = (
        F.when(F.col("__is_label"), "label").when(low.isin(*L.WEB_SECTIONS), "section")
        .when(F.col("__line").rlike(L.DIMENSION_STOP), "dimension")
    )
    df = df.withColumn("__sure", sure)
    df = df.withColumn("__in", F.last("__sure", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    bare = F.col("__line").rlike(L.DIMENSION_LINE) & ~F.coalesce(F.col("__in") == "label", F.lit(False))
    df = df.withColumn("__kind", F.coalesce(F.col("__sure"), F.when(bare, "dimension")))
    df = df.withColumn("__head", F.last(F.when(F.col("__kind").isNotNull(), F.col("__no")), ignorenulls=True).over(so_far))
    df = df.withColumn("__colon", (F.col("__line") == ":") & F.lag("__is_label").over(order))
    heads = df.filter(F.col("__head").isNotNull()).groupBy(*keys, "__name", "__head").agg(
        F.max(F.when(F.col("__no") == F.col("__head"), F.col("__kind"))).alias("__kind"),
        F.max(F.when(F.col("__no") == F.col("__head"), F.col("__line"))).alias("__key"),
        _joined(F.collect_list(F.when((F.col("__no") > F.col("__head")) & ~F.coalesce(F.col("__colon"), F.lit(False)),
                                      F.struct(F.col("__no").alias("no"), F.col("__line").alias("text"))))).alias("value"))
    horder = W.partitionBy(*keys).orderBy("__head")
    hsofar = horder.rowsBetween(W.unboundedPreceding, 0)
    key = F.col("__key")
    heading = F.translate(F.regexp_extract(key, L.DIMENSION_LINE, 1), "\u00a0", " ")
    variant = F.trim(F.regexp_replace(heading, L.AXIS_LEGEND, ""))
    state = F.when(F.col("__kind") == "section", F.struct(F.lower(key).alias("section"), F.lit(None).cast("string").alias("variant"))).when(
        F.col("__kind") == "dimension", F.struct(F.lit("dimension").alias("section"), F.when(variant != "", variant).otherwise(F.col("__name")).alias("variant")))
    heads = heads.withColumn("__state", F.last(state, ignorenulls=True).over(hsofar))
    in_dim = F.coalesce(F.col("__state.section") == "dimension", F.lit(False))
    axis = axis_of_label(key)
    triple = F.replace(F.col("value"), F.lit(","), F.lit("")).rlike(L.SIZE_TRIPLE)
    kind = (
        F.when(F.col("__kind") != "label", F.col("__kind"))
        .when(in_dim & axis.isNull() & triple, "triple").when(in_dim & axis.isNotNull(), "axis").otherwise("row")
    )
    heads = heads.withColumn("kind", kind)
    opens = F.col("kind").isin("dimension", "triple").cast("int")
    return heads.withColumn("set_no", F.sum(opens).over(hsofar)).select(
        *keys, F.col("__name").alias("name"), F.col("__head").alias("position"), "kind",
        F.coalesce("__state.section", F.lit("")).alias("section"), F.col("__key").alias("label"), "value",
        F.col("__state.variant").alias("variant"), "set_no")


def spec_rows(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    return blocks.filter((F.col("kind") == "row") & (F.trim("value") != "")).select(*keys, "position", "section", "label", "value")


def size_sets(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, set_no, label, mm): mm holds [min, max] millimetres per axis, a later line overriding an
    earlier one; sets without axes are dropped."""
    bare = F.replace(F.col("value"), F.lit(","), F.lit(""))
    factor = F.when(F.lower(F.regexp_extract(bare, L.SIZE_TRIPLE, 4)) == "cm", 10).otherwise(1)
    # Digits and points that make no number, or none that fits, are no edge.
    edge = lambda i: F.bround(extracted(bare, L.SIZE_TRIPLE, i).try_cast("double") * factor, 0).try_cast("int")
    named = F.when(F.col("variant").isNotNull() & (F.col("variant") != F.col("name")),
                   F.concat_ws(" · ", "variant", "label")).otherwise(F.col("label"))
    entry = lambda a, pair: F.struct(a.alias("axis"), pair.alias("mm"))
    parts = (
        F.when(F.col("kind") == "triple", F.array(*[
            entry(F.lit(a), F.when(edge(i).isNotNull(), F.array(edge(i), edge(i)))) for a, i in (("w", 1), ("d", 2), ("h", 3))]))
        .when(F.col("kind") == "axis", F.array(entry(axis_of_label(F.col("label")), axis_measure(F.col("value")))))
    )
    label = F.when(F.col("kind") == "triple", named).when(F.col("kind") == "dimension", F.col("variant"))
    rows = blocks.filter(F.col("kind").isin("dimension", "triple", "axis") & (F.col("set_no") > 0))
    sets = rows.groupBy(*keys, "set_no").agg(
        F.max(label).alias("label"),
        F.array_sort(F.collect_list(F.when(parts.isNotNull(), F.struct("position", parts.alias("parts"))))).alias("__parts"))
    entries = F.filter(F.flatten(F.transform("__parts", lambda p: p["parts"])), lambda e: e["mm"].isNotNull())
    sets = sets.withColumn("__entries", entries).filter(F.size("__entries") > 0)

    def latest(axis: str) -> Column:
        return F.try_element_at(F.filter("__entries", lambda e: e["axis"] == axis), F.lit(-1))["mm"].alias(axis)

    return sets.select(*keys, "set_no", "label", F.struct(*[latest(a) for a in AXES]).alias("mm"))


def introduction(pages: DataFrame, keys: Sequence[str], text: str, name: str) -> DataFrame:
    """Text after the last line equal to the name, up to the first stop word: (keys, summary)."""
    df = lines_of(pages.withColumn("__name", F.trim(F.col(name))), [*keys, "__name"], text, "__line", "__no").withColumn("__line", F.trim("__line"))
    doc = W.partitionBy(*keys)
    df = df.withColumn("__head", F.max(F.when(F.col("__line") == F.col("__name"), F.col("__no"))).over(doc)).filter(F.col("__no") > F.col("__head"))
    df = df.withColumn("__stop", F.min(F.when(F.col("__line").isin(*L.WEB_INTRO_STOPS), F.col("__no"))).over(doc))
    body = df.filter((F.col("__line") != "") & (F.col("__stop").isNull() | (F.col("__no") < F.col("__stop"))))
    return body.groupBy(*keys).agg(_joined(F.collect_list(F.struct(F.col("__no").alias("no"), F.col("__line").alias("text"))), "\n").alias("summary"))


# ---------------------------------------------------------------- markup

# The character entities met in the sources, decoded in this order.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def unescape(text: Column) -> Column:
    out = text
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def paragraphs(pages: DataFrame, keys: Sequence[str], markup: str, element: str = "p", text_element: str | None = None) -> DataFrame:
    """(keys, position, paragraph): text of every paragraph element, unescaped, squeezed, blank ones dropped."""
    blocks = F.regexp_extract_all(F.col(markup), F.lit(rf"(?s)<{element}(?: [^>]*)?>(.*?)</{element}>"), F.lit(1))
    if text_element:
        text = lambda b: F.array_join(F.regexp_extract_all(b, F.lit(rf"<{text_element}[^>]*>([^<]*)</{text_element}>"), F.lit(1)), "")
    else:
        text = lambda b: F.regexp_replace(b, "<[^>]*>", "")
    clean = F.transform(blocks, lambda b: F.trim(F.regexp_replace(unescape(text(b)), r"\s+", " ")))
    return pages.select(*keys, F.posexplode(F.filter(clean, lambda p: p != "")).alias("position", "paragraph"))


def links(pages: DataFrame, keys: Sequence[str], markup: str, wanted: str | None = None, dropped: str | None = None) -> DataFrame:
    """(keys, position, href) of the anchors, kept and dropped by address pattern."""
    found = F.regexp_extract_all(F.col(markup), F.lit(r"<a [^>]*href=\"([^\"]*)\""), F.lit(1))
    rows = pages.select(*keys, F.posexplode(found).alias("position", "href"))
    if wanted:
        rows = rows.filter(F.col("href").rlike(wanted))
    return rows.filter(~F.col("href").rlike(dropped)) if dropped else rows


# ---------------------------------------------------------------- documents

def from_title(paras: DataFrame, keys: Sequence[str], position: str = "position", paragraph: str = "paragraph", letters: int = 2) -> DataFrame:
    """Drop junk before the title: paragraphs with fewer than two letters. A document of junk only vanishes
    here; its title is then the file stem."""
    count = F.length(F.regexp_replace(paragraph, "[^A-Za-z\u0e00-\u0e7f]", ""))
    first = F.min(F.when(count >= letters, F.col(position))).over(W.partitionBy(*keys))
    return paras.withColumn("__first", first).filter(F.col(position) >= F.col("__first")).drop("__first")


def pair_paragraphs(paras: DataFrame, keys: Sequence[str], position: str = "position", paragraph: str = "paragraph") -> DataFrame:
    """Body paragraphs as (keys, position, kind, label, value); kind is size, pair or feature.

    ``label : value`` is a pair. A short paragraph followed by a longer one is a pair too and uses up both,
    so in a run of candidates every other one is a label. The first paragraph, the title, is left out.
    """
    order = W.partitionBy(*keys).orderBy(position)
    df = paras.withColumn("__first", F.min(position).over(W.partitionBy(*keys))).filter(F.col(position) > F.col("__first")).drop("__first")
    df = with_parsed_size(df, paragraph, "__mm")
    line = F.col(paragraph)
    df = df.withColumns({"__size": is_size_line(line, F.col("__mm")), "__heading": matches(line, L.FEATURE_HEADING)})
    label = F.trim(F.regexp_extract(line, L.PAIR_LINE, 1))
    colon = line.rlike(L.PAIR_LINE) & ~label.rlike(L.NOT_A_PAIR_LABEL)
    df = df.withColumns({"__colon": colon & ~F.col("__heading") & ~F.col("__size"), "__next": F.lead(paragraph).over(order)})
    plain_next = ~F.lead("__size").over(order) & ~F.lead("__heading").over(order)
    candidate = (
        ~F.col("__heading") & ~F.col("__size") & ~F.col("__colon") & (F.length(line) <= 28) & ~line.rlike(r"\d{2,}")
        & (F.length("__next") > F.length(line)) & plain_next
    )
    df = df.withColumn("__cand", F.coalesce(candidate, F.lit(False))).withColumn("__row", F.row_number().over(order))
    run = F.last(F.when(~F.col("__cand"), F.col("__row")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumn("__offset", F.col("__row") - F.coalesce(run, F.lit(0)) - 1)
    df = df.withColumn("__label", F.col("__cand") & (F.col("__offset") % 2 == 0))
    df = df.withColumn("__used", F.coalesce(F.lag("__label").over(order), F.lit(False)))
    dropped = F.col("__colon") & label.rlike(L.DROPPED_PAIR_LABEL)
    kind = (
        F.when(F.col("__used") | F.col("__heading") | dropped, None).when(F.col("__size"), "size")
        .when(F.col("__colon") | F.col("__label"), "pair").otherwise("feature")
    )
    out_label = F.when(F.col("__colon"), label).when(F.col("__label"), line)
    out_value = F.when(F.col("__colon"), F.trim(F.regexp_extract(line, L.PAIR_LINE, 2))).when(F.col("__label"), F.col("__next")).otherwise(line)
    return df.select(*keys, position, kind.alias("kind"), out_label.alias("label"), out_value.alias("value")).filter(F.col("kind").isNotNull())


def distinct_size_sets(sizes: Column) -> Column:
    """Per record the first of identical size sets."""
    seen = F.transform(sizes, lambda s: F.to_json(s["mm"]))
    return F.filter(sizes, lambda s, i: F.array_position(seen, F.to_json(s["mm"])) == i + 1)


# ---------------------------------------------------------------- word boxes

CODE_WORD = r"^(?=[A-Z0-9./-]*\d)(?=[A-Z0-9./-]*[A-Z])[A-Z0-9][A-Z0-9./-]{2,}$"
CODE_HEAD = r"^[A-Z]{1,4}$"


def lines_of_page(words: list[tuple]) -> list[tuple]:
    """Words (x0, y0, x1, y1, text) of one page -> lines (band, part, x0, y0, x1, y1, texts), by one sweep from top to bottom and one along each band."""
    order = lambda text: (text is not None, text or "")
    by_y = sorted(((y0 + y1) / 2, x0, order(text), x1, y0, y1, max(8, y1 - y0), text) for x0, y0, x1, y1, text in words)
    bands: list[list[tuple]] = []
    first = 0.0
    for w in by_y:
        if not bands or w[0] - first >= w[6] * 0.55:
            bands.append([])
            first = w[0]
        bands[-1].append(w)
    out = []
    for band, found in enumerate(bands):
        part, reach, line = 0, None, []
        for w in sorted(found, key=lambda w: (w[1], w[3], w[2])):
            if reach is not None and w[1] - reach >= w[6] * 1.6:
                out.append((band, part, line))
                part, line = part + 1, []
            line.append(w)
            reach = w[3] if reach is None else max(reach, w[3])
        out.append((band, part, line))
    return [(band, part, min(w[1] for w in line), min(w[4] for w in line), max(w[3] for w in line), max(w[5] for w in line), [w[7] for w in line])
            for band, part, line in out]


#: Pages whose words are Python values at one time.
PAGES_AT_ONCE = 64


def word_lines(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Words (x0, y0, x1, y1, text) -> text lines (band, part, x0, y0, x1, y1, words, text).

    Independent of reading order: a vertical band holds the centres that lie less than 0.55 of the word height below its
    first one, so lines of one column never share a band; within a band a line ends at a horizontal gap of 1.6 heights.
    ``keys`` name a page, whose words are gathered and swept once in an Arrow batch; words without a box are left out.
    """
    boxes = [F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")]
    whole = words.filter(F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull())
    page = whole.groupBy(*keys).agg(F.collect_list(F.struct(*boxes, "text")).alias("__w"))
    numbers = [T.StructField(c, T.IntegerType()) for c in ("x0", "y0", "x1", "y1")]
    schema = T.StructType([*(page.schema[k] for k in keys), T.StructField("band", T.IntegerType()), T.StructField("part", T.LongType()), *numbers,
                           T.StructField("words", T.ArrayType(T.StringType()))])
    names, kinds = [f.name for f in schema], [pa.int32(), pa.int64(), *[pa.int32()] * 4, pa.list_(pa.string())]

    def sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_AT_ONCE):
                some = batch.slice(at, PAGES_AT_ONCE)
                boxes = some.column(len(keys))
                flat, end = list(zip(*(f.to_pylist() for f in boxes.flatten().flatten()))), 0
                rows, of = [], []
                for i, size in enumerate(pc.list_value_length(boxes).to_pylist()):
                    rows += (found := lines_of_page(flat[end:end + size]))
                    of += [i] * len(found)
                    end += size
                columns = list(zip(*rows)) or [()] * len(kinds)
                take = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in some.columns[:len(keys)]), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    return page.mapInArrow(sweep, schema).withColumn("text", fix_thai_spacing(F.array_join("words", " ")))


def with_code_line(lines: DataFrame) -> DataFrame:
    """Add ``code`` and ``name`` where a line begins with a code of one or two words."""
    first = F.upper(F.regexp_replace(F.get("words", F.lit(0)), "^:+|:+$", ""))
    second = F.upper(F.coalesce(F.get("words", F.lit(1)), F.lit("")))
    split = first.rlike(CODE_HEAD) & second.rlike(CODE_WORD)
    code = F.when(split, F.concat_ws(" ", F.upper(F.get("words", F.lit(0))), second)).when(first.rlike(CODE_WORD), first)
    rest = F.when(split, F.slice("words", 3, F.greatest(F.size("words"), F.lit(1)))).otherwise(F.slice("words", 2, F.greatest(F.size("words"), F.lit(1))))
    name = F.regexp_replace(fix_thai_spacing(F.array_join(rest, " ")), "^[ :-]+|[ :-]+$", "")
    return lines.withColumn("code", code).withColumn("name", F.when(F.col("code").isNotNull(), name))


def nearest_code_above(lines: DataFrame, keys: Sequence[str], page_w: str, page_h: str, is_size: Column) -> DataFrame:
    """Each size line with the closest code line above it: within 5 % of the page height, overlapping in x.

    Lines meet only within the same or the next strip of 5 % page height, then the nearest is an aggregate.
    """
    reach = F.col(page_h) * 0.05
    sized = lines.filter(is_size).select(*keys, page_w, page_h, F.col("x0").alias("sx0"), F.col("y0").alias("sy0"), F.col("x1").alias("sx1"), F.col("y1").alias("sy1"), F.col("text").alias("size_text"))
    sized = sized.withColumn("__strip", F.explode(F.array(*[F.floor((F.col("sy0") + 4) / reach) - i for i in (0, 1, 2)])))
    coded = with_code_line(lines).filter(F.col("code").isNotNull()).select(
        *keys, F.floor(F.col("y1") / reach).alias("__strip"), "x0", "y0", "x1", "y1", "code", "name")
    joined = sized.join(coded, [*keys, "__strip"]).filter(
        (F.col("y1") <= F.col("sy0") + 4) & (F.col("sy0") - F.col("y1") < reach) & (F.col("x0") < F.col("sx1"))
        & (F.col("x1") > F.col("sx0") - F.col(page_w) * 0.02))
    pick = F.max_by(F.struct("code", "name", "x0", "y0", "x1", "y1"), F.struct("y1", -F.col("x0")))
    return joined.groupBy(*keys, page_w, page_h, "sx0", "sy0", "sx1", "sy1", "size_text").agg(pick.alias("line")).select(
        *keys, page_w, page_h, "size_text", "line.code", "line.name", "line.x0", "line.y0",
        F.greatest("line.x1", "sx1").alias("x1"), F.col("sy1").alias("y1"))


def column_spans(items: DataFrame, keys: Sequence[str], page_w: str, page_h: str) -> DataFrame:
    """``left`` and ``right`` bounds of each item: up to its neighbours in the same row of the page."""
    by_y = W.partitionBy(*keys).orderBy("y0", "x0")
    jump = (F.col("y0") - F.lag("y0").over(by_y) >= F.col(page_h) * 0.04).cast("int")
    df = items.withColumn("__j", F.coalesce(jump, F.lit(0))).withColumn("__row", F.sum("__j").over(by_y.rowsBetween(W.unboundedPreceding, 0)))
    row = W.partitionBy(*keys, "__row").orderBy("x0", "y0")
    w = F.col(page_w)
    left = F.greatest(F.lit(0), F.col("x0") - F.floor(w * 0.03), F.lag("x0").over(row) + F.floor(w * 0.05))
    right = F.coalesce(F.lead("x0").over(row) - F.floor(w * 0.015), F.least(w, F.col("x0") + F.floor(w * 0.34)))
    return df.withColumn("left", left.cast("int")).withColumn("right", F.least(w, right).cast("int")).drop("__j", "__row")

