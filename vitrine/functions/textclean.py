"""Cleaning damaged text and building match keys; every function is Column -> Column."""
from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions.patterns import extracted

# Thai marks that damage removes (tone marks, thanthakhat, maitaikhu, nikhahit).
TONE_MARKS = "\u0e48\u0e49\u0e4a\u0e4b\u0e4c\u0e47\u0e4d"

# Private-use glyphs U+F700..U+F71A of Windows Thai fonts, in code point order.
PRIVATE_USE = "".join(chr(c) for c in range(0xF700, 0xF71B))
PRIVATE_USE_THAI = (
    "\u0e10\u0e34\u0e35\u0e36\u0e37"
    "\u0e48\u0e49\u0e4a\u0e4b\u0e4c"
    "\u0e48\u0e49\u0e4a\u0e4b\u0e4c"
    "\u0e0d\u0e31\u0e4d\u0e47\u0e48"
    "\u0e49\u0e4a\u0e4b\u0e4c\u0e38"
    "\u0e39\u0e3a"
)
SARA_AA, SARA_AM, NIKHAHIT = "\u0e32", "\u0e33", "\u0e4d"

# The bytes the Thai code page defines, read as Latin-1, and the letters they stand for (offset 0xD60).
_THAI_BYTES = [c for c in range(0xA1, 0xFC) if not 0xDB <= c <= 0xDE]
LATIN_FORM = "".join(chr(c) for c in _THAI_BYTES)
THAI_FORM = "".join(chr(c + 0xD60) for c in _THAI_BYTES)

# Latin letters whose decomposition is one plain letter plus marks.
_ACCENTED = {chr(c): unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode()
             for c in range(0xA0, 0x250)}
_ACCENTED = {k: v for k, v in _ACCENTED.items() if len(v) == 1 and v.isalnum()}
ACCENTED, PLAIN = "".join(_ACCENTED), "".join(_ACCENTED.values())


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def compose_unicode(text: Column) -> Column:
    """Canonical composition; Spark has no builtin, so one Arrow batch function."""
    return _composed(text)


def repair_mojibake(text: Column) -> Column:
    """Thai bytes shown as Latin-1 become Thai again, run by run; other runs stay."""
    high = "[\u00a0-\u00ff]"
    runs = F.split(text, f"(?<={high})(?!{high})|(?<!{high})(?={high})")
    fixed = F.transform(runs, lambda r: F.when(
        r.rlike("^[\u00a1-\u00da\u00df-\u00fb]{2,}$"), F.translate(r, LATIN_FORM, THAI_FORM)).otherwise(r))
    return F.array_join(fixed, "")


def normalize(text: Column, compose: bool = True) -> Column:
    """Glyph mapping, composition, micro sign, no-break space, code-page repair, vowel composition."""
    out = F.translate(text, PRIVATE_USE, PRIVATE_USE_THAI)
    if compose:
        out = compose_unicode(out)
    out = F.translate(out, "\u03bc\u00a0", "\u00b5 ")
    out = repair_mojibake(out)
    out = F.replace(out, F.lit(NIKHAHIT + SARA_AA), F.lit(SARA_AM))
    return F.regexp_replace(out, f"{NIKHAHIT}([\u0e48-\u0e4b]){SARA_AA}", f"$1{SARA_AM}")


def skeleton(text: Column) -> Column:
    """What survives the damage: no tone marks, sara am read as sara aa, no white space."""
    return F.regexp_replace(F.translate(text, SARA_AM + TONE_MARKS, SARA_AA), r"(?U)\s", "")


def plain_skeleton(word: str) -> str:
    """The skeleton of a rule word, for building literal lists."""
    gone = dict.fromkeys(map(ord, TONE_MARKS))
    return "".join(word.translate({**gone, ord(SARA_AM): SARA_AA}).split())


def tone_sequence(text: Column) -> Column:
    return F.regexp_replace(text, f"[^{TONE_MARKS}]", "")


def is_mark_subsequence(small: Column, big: Column) -> Column:
    """Do the marks of ``small`` appear in this order among those of ``big``?"""
    return F.rlike(big, F.regexp_replace(small, "(.)", "$1.*"))


def word_cost(freq: Column) -> Column:
    """10 for an unseen word down to 4 from a thousand occurrences on."""
    return (10 - F.bround(6 * F.least(F.lit(1.0), F.log10(1 + freq) / 3), 0)).cast("int")


def fix_thai_spacing(text: Column) -> Column:
    out = F.regexp_replace(text, "(?<=[\u0e00-\u0e7f]) (?=[\u0e00-\u0e7f])", "")
    out = F.replace(out, F.lit(NIKHAHIT + SARA_AA), F.lit(SARA_AM))
    return F.replace(out, F.lit(f"{NIKHAHIT} {SARA_AA}"), F.lit(SARA_AM))


def dedupe_key(code: Column) -> Column:
    """Code key for merging records: separators out, every script kept."""
    return F.regexp_replace(F.upper(code), r"(?U)[\s\-_/.]+", "")


def search_key(code: Column) -> Column:
    """Code key for search: upper-case ASCII letters and digits only."""
    return F.regexp_replace(F.upper(code), "[^A-Z0-9]", "")


def series_of_code(code: Column) -> Column:
    """Leading model word without its trailing number."""
    head = F.split(F.trim(code), r"[\s\-/(\[]", 2)[0]
    bare = F.regexp_replace(head, r"\d+$", "")
    return F.upper(F.when(bare != "", bare).otherwise(head))


def series_first_word(name: Column) -> Column:
    return F.upper(F.split(F.trim(name), r"\s+", 2)[0])


def series_code_or_folder(code: Column, folder: Column) -> Column:
    return F.upper(F.when(code != "", F.split(code, "-", 2)[0]).otherwise(folder))


def series_of_file(file_name: Column) -> Column:
    stem = F.regexp_replace(F.regexp_replace(file_name, r"\.[^.]*$", ""), "_brochure", "")
    return F.upper(F.trim(F.regexp_replace(F.translate(stem, "-_", "  "), r"\s+", " ")))


def slugify(text: Column) -> Column:
    """Address part of a code; letters that have no ASCII form are dropped."""
    ascii_only = F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"[^\x00-\x7F]", "")
    slug = F.lower(F.regexp_replace(F.regexp_replace(ascii_only, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    return F.when(slug != "", slug).otherwise("item")


def plain_slug(text: Column) -> Column:
    """The loader's slug: no transliteration, no default."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def clean_code(code: Column) -> Column:
    """Undo the letter O read for zero inside codes."""
    out = F.regexp_replace(code, r"(?<=[A-Z]{2})O(?=\d)", "0")
    out = F.regexp_replace(out, r"(?<=\d)O|O(?=\d{2})", "0")
    return F.regexp_replace(F.replace(out, F.lit("—"), F.lit("-")), r"^[.-]+|[.-]+$", "")


# What a model code looks like at the head of a title, glued to text, and in a file name.
CODE_TOKEN = r"^(?=[A-Za-z0-9./-]*\d)(?=[A-Za-z0-9./-]*[A-Za-z])[A-Za-z0-9][A-Za-z0-9./-]{1,}$"
GLUED_CODE = r"^([A-Za-z][A-Za-z0-9./-]*\d[A-Za-z0-9./-]*)"
FILE_CODE = r"(?:รุ่น\s*)?([A-Za-z]{1,5}[- ]?\d[A-Za-z0-9./-]*)"


def split_title(title: Column, file_name: Column) -> Column:
    """struct(code, name) of a document title: leading code word, glued code, or code in the file name."""
    text = F.trim(F.regexp_replace(title, r"^\d+(\.\d+)*\.?\s*", ""))
    head = F.split(text, " ", 2)[0]
    glued = extracted(text, GLUED_CODE)
    in_file = extracted(F.regexp_replace(file_name, r"\.[^.]*$", ""), FILE_CODE)
    code = (
        F.when(head.rlike(CODE_TOKEN), F.upper(head))
        .when(glued.isNotNull(), F.upper(glued))
        .when(in_file.isNotNull(), F.upper(F.translate(in_file, " ", "-")))
        .otherwise("")
    )
    name = (
        F.when(head.rlike(CODE_TOKEN), F.trim(F.substr(text, F.length(head) + 1)))
        .when(glued.isNotNull(), F.trim(F.substr(text, F.length(glued) + 1)))
        .otherwise(text)
    )
    return F.struct(code.alias("code"), name.alias("name"))


def code_family(code: Column) -> Column:
    """Letter prefix that groups codes of one product family ("" if none)."""
    return F.regexp_extract(F.replace(code, F.lit(" "), F.lit("")), r"^\d?[A-Z]+(?:-[A-Z]+)?", 0)


def shorten(text: Column, n: int) -> Column:
    """At most about n characters, never between a letter and its marks, with an ellipsis."""
    whole = F.trim(F.coalesce(text, F.lit("")))
    head = F.regexp_replace(F.substring(whole, 1, n + 1), r"(\P{Mn}|^)\p{Mn}*$", "")
    return F.when(F.length(whole) <= n, whole).otherwise(F.concat(F.rtrim(head), F.lit("…")))


def media_name(url: Column) -> Column:
    """File name of a downloaded picture: 16 hex digits of the address hash plus its extension."""
    ext = extracted(url, r"(?i)\.(?:jpe?g|png|webp)", 0)
    return F.concat(F.substring(F.sha1(url), 1, 16), F.coalesce(ext, F.lit(".jpg")))


def canonical_url(url: Column) -> Column:
    return F.split(url, r"\?", 2)[0]


def edition_url(url: Column, photo_edition: bool) -> Column:
    """Drawings are stored; the photo edition serves the same path from the photo folder."""
    return F.regexp_replace(url, "^/media/p/", "/media/photo/") if photo_edition else url
