"""Reading the feeds of an import and uniting them."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine import schemas


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Extracted records: one JSON array per file."""
    return spark.read.schema(schemas.CATALOG_RECORD).option("multiLine", True).json(path)


def read_json_table(spark: SparkSession, path: str, schema, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def read_or_empty(spark: SparkSession, path: str, schema, multi_line: bool = True) -> DataFrame:
    """A feed whose source is not there contributes nothing."""
    try:
        return read_json_table(spark, path, schema, multi_line)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_crawled_pages(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, schemas.CRAWLED_PAGE)


def read_page_text(spark: SparkSession, root: str) -> DataFrame:
    """A tree <folder>/<file>/p<N>.txt as (folder, file, page, line_no, line); one row per line."""
    raw = (spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="p*.txt")
           .select(F.col("value"), F.col("_metadata.file_path").alias("path")))
    path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    parts = r"([^/]+)/([^/]+)/p(\d+)\.txt$"
    pages = raw.select(F.regexp_extract(path, parts, 1).alias("folder"), F.regexp_extract(path, parts, 2).alias("file"),
                       F.regexp_extract(path, parts, 3).cast("int").alias("page"), "value")
    return pages.select("folder", "file", "page", F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line_no", "line"))


def read_word_boxes(spark: SparkSession, root: str, min_confidence: int = 30) -> DataFrame:
    """Per-page JSON of recognised words as one row per word; unsure words are dropped."""
    raw = (spark.read.schema(schemas.WORD_PAGE).option("multiLine", True).option("recursiveFileLookup", True).json(root)
           .withColumn("path", F.col("_metadata.file_path")))
    path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    parts = r"([^/]+)/p(\d+)\.json$"
    word = F.col("word")
    rows = raw.select(F.regexp_extract(path, parts, 1).alias("file"), F.regexp_extract(path, parts, 2).cast("int").alias("page"),
                      F.col("w").alias("page_w"), F.col("h").alias("page_h"), F.explode("words").alias("word"))
    return rows.select("file", "page", "page_w", "page_h",
                       *[word[i].cast("int").alias(n) for i, n in enumerate(["x0", "y0", "x1", "y1"])],
                       word[4].alias("text"), word[5].cast("double").alias("confidence")).filter(F.col("confidence") > min_confidence)


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """(kind label | phrase, th, en) rows of a CSV with header, in definition order."""
    return spark.read.schema(schemas.GLOSSARY).option("header", True).csv(path)


def glossary_phrases(glossary: DataFrame) -> list[tuple[str, str]]:
    """Phrase pairs for translate_phrases. A glossary is kept by hand and becomes part of the plan, however long it is."""
    rows = glossary.filter(F.col("kind") == "phrase").select("th", F.coalesce("en", F.lit("")).alias("en")).collect()
    return [(r["th"], r["en"]) for r in rows]


def brand_of_folder(df: DataFrame, brands: dict[str, str], folder: str = "folder") -> DataFrame:
    """First path segment -> brand slug; files of unknown folders are not part of the import."""
    pairs = F.create_map(*[F.lit(x) for kv in brands.items() for x in kv])
    return df.withColumn("brand", F.try_element_at(pairs, F.split(F.col(folder), "/")[0])).filter(F.col("brand").isNotNull())


# Fixed value: price sheets begin with this word and are never imported.
PRICE_PREFIX = "^ราคา"


def without_price_sheets(df: DataFrame, file: str = "file") -> DataFrame:
    return df.filter(~F.col(file).rlike(PRICE_PREFIX))


def unite(feeds: Sequence[tuple[str, DataFrame]], ordinal: Sequence[str] = ()) -> DataFrame:
    """Feeds one below the other with ``feed`` and ``feed_no``; later steps depend on this order.

    ``ordinal`` names the columns that order rows inside a feed; together with ``feed_no`` they form the
    struct ``ordinal`` by which "first record" is decided.
    """
    out = None
    for no, (name, frame) in enumerate(feeds):
        part = frame.withColumns({"feed": F.lit(name), "feed_no": F.lit(no)})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.withColumn("ordinal", F.struct("feed_no", *ordinal)) if ordinal else out


def file_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(key, md5) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    prefix = F.lit(root.rstrip("/") + "/")
    path = F.regexp_replace("path", "^file:/*", "/")
    return files.select(F.replace(path, prefix, F.lit("")).alias("key"), F.md5("content").alias("md5"))


def card_columns(products: DataFrame, extra: Sequence[str | Column] = ()) -> DataFrame:
    """The columns a product card shows; the scan reads nothing else."""
    return products.select("slug", "code", "type_th", "type_en", "materials", "material", "width_min", "width_max",
                           "depth_min", "depth_max", "height_min", "height_max", *extra)
