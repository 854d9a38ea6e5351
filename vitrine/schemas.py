"""Explicit schemas of the catalogue tables and feeds; nothing is inferred on read."""
from __future__ import annotations

from pyspark.sql import types as T

INT_PAIR = T.ArrayType(T.IntegerType())

#: Size axes of one size set, each a [min, max] range in millimetres or null.
AXES = ["w", "d", "h", "dia", "seat_h", "arm_h"]
MM = T.StructType([T.StructField(a, INT_PAIR) for a in AXES])

SIZE_SET = T.StructType([
    T.StructField("label_th", T.StringType()),
    T.StructField("label_en", T.StringType()),
    T.StructField("text_th", T.StringType()),
    T.StructField("text_en", T.StringType()),
    T.StructField("mm", MM),
])

STRINGS = T.ArrayType(T.StringType())

SPEC_ROW = T.StructType([
    T.StructField("label_th", T.StringType()),
    T.StructField("label_en", T.StringType()),
    T.StructField("values_th", STRINGS),
    T.StructField("values_en", STRINGS),
])

SOURCE = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("images", STRINGS),
    T.StructField("prechecked", T.BooleanType()),
])

IMAGE = T.StructType([
    T.StructField("src", T.StringType()),
    T.StructField("thumb", T.StringType()),
    T.StructField("w", T.IntegerType()),
    T.StructField("h", T.IntegerType()),
])

#: One extracted product as the import produces it.
CATALOG_RECORD = T.StructType([
    T.StructField("brand", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("series", T.StringType()),
    T.StructField("type_th", T.StringType()),
    T.StructField("type_en", T.StringType()),
    T.StructField("summary_th", T.StringType()),
    T.StructField("summary_en", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("tags", STRINGS),
    T.StructField("materials", STRINGS),
    T.StructField("seats", T.IntegerType()),
    T.StructField("sizes", T.ArrayType(SIZE_SET)),
    T.StructField("dimensions_mm", MM),
    T.StructField("specs", T.ArrayType(SPEC_ROW)),
    T.StructField("features_th", STRINGS),
    T.StructField("features_en", STRINGS),
    T.StructField("note_th", T.StringType()),
    T.StructField("note_en", T.StringType()),
    T.StructField("source", SOURCE),
    T.StructField("images", T.ArrayType(IMAGE)),
    T.StructField("flags", STRINGS),
    T.StructField("slug", T.StringType()),
])

BRAND = T.StructType([
    T.StructField("slug", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("logo", T.StringType()),
])

CATEGORY = T.StructType([
    T.StructField("slug", T.StringType()),
    T.StructField("parent", T.StringType()),
    T.StructField("name_th", T.StringType()),
    T.StructField("name_en", T.StringType()),
    T.StructField("sort", T.IntegerType()),
])

CRAWLED_PAGE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("unit", T.StringType()),
    T.StructField("subcategory", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("images", STRINGS),
])

#: A page of recognised words: every word is [x0, y0, x1, y1, text, confidence], mixed types, so strings.
WORD_PAGE = T.StructType([
    T.StructField("w", T.IntegerType()),
    T.StructField("h", T.IntegerType()),
    T.StructField("words", T.ArrayType(STRINGS)),
])

DOC_PARAGRAPHS = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("folder", T.StringType()),
    T.StructField("paras", STRINGS),
    T.StructField("images", T.ArrayType(T.StructType([
        T.StructField("hash", T.StringType()),
        T.StructField("w", T.IntegerType()),
        T.StructField("h", T.IntegerType()),
    ]))),
])

REGISTRY = T.StructType([T.StructField("slug", T.StringType()), T.StructField("code", T.StringType())])

LISTING = T.StructType([
    T.StructField("slug", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("range", T.StringType()),
    T.StructField("also", STRINGS),
])

MANIFEST = T.StructType([T.StructField("key", T.StringType()), T.StructField("md5", T.StringType())])

GLOSSARY = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("th", T.StringType()),
    T.StructField("en", T.StringType()),
])

PRODUCT_STATUS = ["published", "review", "hidden"]

PRODUCT_IMAGE = T.StructType([
    T.StructField("product_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("thumb_url", T.StringType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("sort", T.IntegerType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])
