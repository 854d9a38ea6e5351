"""Glossary translation and language fallback as Column expressions."""
from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions.patterns import mapped
from vitrine.functions.textclean import plain_skeleton, skeleton

THAI = "[\u0e00-\u0e7f]"


def translate_phrases(text: Column, phrases: Sequence[tuple[str, str]], foreign: str = THAI) -> Column:
    """Replace every glossary phrase, longest first; null when source-script text remains.

    Text without source-script characters passes unchanged. The glossary is one array literal that is folded over the text,
    so the expression is equally deep for any number of phrases, and the replaced text is computed once per row.
    """
    ordered = [{"s": source, "t": f" {target} "} for source, target in sorted(phrases, key=lambda p: -len(p[0]))]
    glossary = F.from_json(F.lit(json.dumps(ordered, ensure_ascii=False)), "array<struct<s:string,t:string>>")
    replaced = F.aggregate(glossary, text, lambda out, p: F.replace(out, p["s"], p["t"]))

    return tidy_translation(text, replaced, foreign)


def tidy_translation(text: Column, replaced: Column, foreign: str = THAI) -> Column:
    """The replaced text with its spaces put right and a capital letter, null where source script is left; ``text`` itself if it had none."""
    def tidy(out: Column) -> Column:
        done = F.regexp_replace(out, r"\s+-seater", "-seater")
        done = F.regexp_replace(done, r"(\d)\s+-tier", "$1-tier")
        done = F.regexp_replace(done, r"\s+([,.)\]])", "$1")
        done = F.regexp_replace(done, r"([(\[])\s+", "$1")
        return F.regexp_replace(F.regexp_replace(done, r"\s{2,}", " "), "^[ ,]+|[ ,]+$", "")

    def capital(done: Column) -> Column:
        return F.when(done != "", F.concat(F.upper(F.substring(done, 1, 1)), F.substr(done, F.lit(2))))

    # A lambda over an array of one names a value without repeating the expression behind it.
    tidied = F.transform(F.array(replaced), lambda out: F.when(~out.rlike(foreign), tidy(out)))
    return (
        F.when(text.isNull() | (text == ""), None)
        .when(~text.rlike(foreign), text)
        .otherwise(F.transform(tidied, capital)[0])
    )


def translate_label(label: Column, labels: dict[str, str], phrases: Sequence[tuple[str, str]]) -> Column:
    """A label by its skeleton, else by phrases; text outside the source script passes unchanged."""
    by_skeleton = {plain_skeleton(k): v for k, v in labels.items()}
    known = mapped(skeleton(label), by_skeleton) if by_skeleton else F.lit(None).cast("string")
    return F.when(~label.rlike(THAI), label).otherwise(F.coalesce(known, translate_phrases(label, phrases)))


def reverse_label(label: Column, labels: dict[str, str]) -> Column:
    """English label -> source language; unknown labels pass unchanged."""
    key = F.regexp_replace(F.lower(F.trim(label)), ":+$", "")
    return F.coalesce(mapped(key, labels), F.trim(label))


def pick_language(th: Column, en: Column, lang: str) -> Column:
    """struct(value, fallback): English where there is some, else the source language, marked."""
    if lang != "en":
        return F.struct(th.alias("value"), F.lit(False).alias("fallback"))
    has = en.isNotNull() & (en != "")
    return F.struct(F.when(has, en).otherwise(th).alias("value"), (~F.coalesce(has, F.lit(False))).alias("fallback"))


def align_pairs(th: Column, en: Column) -> Column:
    """Array of struct(th, en): blank source lines go with their partner, missing translations become ""."""
    zipped = F.transform(th, lambda v, i: F.struct(v.alias("th"), F.coalesce(F.get(en, i), F.lit("")).alias("en")))
    return F.filter(zipped, lambda p: p["th"] != "")


def pick_features(th: Column, en: Column, boilerplate: str = r"ISO\s*9001|ผลิตในประเทศไทย", n: int = 5) -> Column:
    """English (else source) feature lines without supplier boilerplate, the first ``n``."""
    zipped = F.zip_with(th, en, lambda a, b: F.when(F.coalesce(b, F.lit("")) != "", b).otherwise(a))
    shared = F.slice(zipped, 1, F.least(F.size(th), F.size(en)))
    return F.slice(F.filter(shared, lambda v: (v != "") & ~v.rlike(boilerplate)), 1, n)
