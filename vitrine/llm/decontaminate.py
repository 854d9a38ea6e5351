"""Pages that hold a reference text, also with other numbers, names and units in it.

Texts become templates: a number is a placeholder, so is a unit behind a number and a capitalised word that does not begin a sentence; all
other words are lower-cased. Windows of template tokens are joined by hash, and beside them windows of the lower-cased tokens with all values
kept, so that copies are found in any case of letters and however many numbers and names they hold. What stands in the slots must then be consistent:
within one alignment of page and reference, one value of the reference is always the same value in the page; windows that hold another value
than most places have are left out, the others stay. So a question
asked again with other parameters is found, and a page that merely has numbers in like places is not.

The references are read once to mark their windows in a bit field of fixed size; pages are read once and only windows that pass it
leave their task. The project keeps no benchmark texts of its own, so the reference side is general: ``(slug, text)``.
"""
from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm import scratch
from vitrine.llm.bit_field import bit_field
from vitrine.llm.columns import hand_back, in_small_batches, let_go, sliced, texts_of, with_columns

#: Sentence ends, numbers (also with a unit written onto them), and words, product codes among them.
TOKEN = re.compile(r"[.!?]|\n\s*\n|\d+(?:[.,]\d+)*(?=(?:[^\W\d_]{1,3})?(?![^\W_]))|[^\W_]+")
#: Units that may stand behind a number.
UNITS = frozenset(
    "mm cm m km in ft inch inches g kg mg lb lbs ml l s min h hr hrs ms w kw v a hz khz mhz gb mb kb tb px pt usd eur gbp thb baht "
    "dollars dollar euros euro percent degrees years year months month weeks week days day hours hour minutes minute seconds second "
    "meters metres meter metre miles mile pounds pound people items units pieces".split())
WORD, NUMBER, STOP, UNIT, CAPITAL = range(5)
#: Codes of tokens that a task keeps: most of a text's tokens are among those met last, and each worker of an executor keeps so many.
CACHE_TOKENS = 50_000
#: Keeps the hashes of literal windows apart from those of template windows.
LITERAL = 1 << 32
_KIND = np.uint64(7)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class _Codes(dict):
    """A token as a 64-bit hash of its case-folded form with its kind in the last three bits."""

    def __missing__(self, token: str) -> int:
        low = token.lower()
        if token[0] in ".!?\n":
            kind = STOP
        elif token[-1].isdigit() and not any(map(str.isalpha, token)):
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        else:
            kind = CAPITAL if token[0].isupper() and token[1:].islower() else WORD
        out = self[token] = xxhash.xxh3_64_intdigest(token.casefold()) & ~7 | kind
        return out


class Templates:
    def __init__(self) -> None:
        self.codes = _Codes()
        self.marks = {k: np.uint64(xxhash.xxh3_64_intdigest(f"<{k}>") & ~7) for k in (NUMBER, UNIT, CAPITAL)}

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Template tokens, and for each the hash of the value in its slot, 0 for a literal word."""
        return self.both(text)[:2]

    def both(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``of``, and the tokens with their values kept."""
        if len(self.codes) > CACHE_TOKENS:
            self.codes.clear()
        found = TOKEN.findall(text)
        code = np.fromiter(map(self.codes.__getitem__, found), np.uint64, len(found))
        kind = (code & _KIND).astype(np.int8)
        before = np.concatenate([[STOP], kind[:-1]]) if len(kind) else kind
        slot = {NUMBER: kind == NUMBER, UNIT: (kind == UNIT) & (before == NUMBER), CAPITAL: (kind == CAPITAL) & (before != STOP)}
        token = code & ~_KIND
        literal = token.copy()
        value = np.zeros(len(code), np.uint64)
        for k, where in slot.items():
            value[where] = token[where] | np.uint64(1)
            token[where] = self.marks[k]
        keep = kind != STOP
        return token[keep], value[keep], literal[keep]


def windows_of(token: np.ndarray, value: np.ndarray, length: int, min_words: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every window with enough literal words, those of value 0."""
    n = len(token) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    out = np.full(n, length + seed, np.uint64)
    for i in range(length):
        out = out * _FACTOR + token[i:n + i]
        out ^= out >> np.uint64(31)
    words = np.concatenate([[0], np.cumsum(value == 0)])
    at = np.flatnonzero(words[length:] - words[:-length] >= min_words)
    return out[at].view(np.int64), at


def _place(h: np.ndarray, bits: int) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def marked(packed: np.ndarray, places: np.ndarray) -> np.ndarray:
    """What a field packed eight to a byte says at these places."""
    return (packed[places >> 3] >> (7 - (places & 7)).astype(np.uint8) & 1).astype(bool)


def template_windows(texts: DataFrame, key: str, lengths: Sequence[int] | None, window: int, min_words: int,
                     field: np.ndarray | None = None, bits: int = 0) -> DataFrame:
    """``(key, h, at, slots, literal, length, total, places)``: slots are the values in the window's slots and spots their places in the text, none in a literal window; total is the template
    windows of the text, places its literal ones. ``lengths`` None takes one length per text: the window, or the whole text if it is shorter."""
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(field)) if field is not None else None  # every task has it whole
    schema = T.StructType([texts.schema[key], T.StructField("h", T.LongType()), T.StructField("at", T.IntegerType()),
                           T.StructField("slots", T.ArrayType(T.LongType())), T.StructField("spots", T.ArrayType(T.IntegerType())), T.StructField("literal", T.BooleanType()),
                           T.StructField("length", T.IntegerType()), T.StructField("total", T.IntegerType()), T.StructField("places", T.IntegerType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        templates = Templates()
        for batch in sliced(batches):
            row, hs, ats, slots, spots, kinds, long, totals, places = [], [], [], [], [], [], [], [], []
            for i, text in enumerate(texts_of(batch)):
                token, value, literal = templates.both(text)
                none = np.zeros_like(value)
                for length in lengths or ([min(window, len(token))] if len(token) else []):
                    found = [windows_of(token, value, length, min_words), windows_of(literal, none, length, min_words, LITERAL)]
                    total, all_places = len(found[0][0]), len(found[1][0])
                    for kind, (h, at) in enumerate(found):
                        if shared is not None:
                            passed = marked(shared.value, _place(h, bits))
                            h, at = h[passed], at[passed]
                        row += [i] * len(h)
                        hs += h.tolist()
                        ats += at.tolist()
                        slots += [[]] * len(h) if kind else [[int(v) for v in value[a:a + length].view(np.int64) if v] for a in at.tolist()]
                        spots += [[]] * len(h) if kind else [(a + np.flatnonzero(value[a:a + length])).tolist() for a in at.tolist()]
                        kinds += [bool(kind)] * len(h)
                        long += [length] * len(h)
                        totals += [total] * len(h)
                        places += [all_places] * len(h)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(row, pa.int64())), pa.array(hs, pa.int64()), pa.array(ats, pa.int32()),
                 pa.array(slots, pa.list_(pa.int64())), pa.array(spots, pa.list_(pa.int32())), pa.array(kinds, pa.bool_()), pa.array(long, pa.int32()), pa.array(totals, pa.int32()),
                 pa.array(places, pa.int32())],
                names=[key, "h", "at", "slots", "spots", "literal", "length", "total", "places"])
        del templates
        hand_back()

    return in_small_batches(texts.select(key, "text")).mapInArrow(run, schema)


def _marked(windows: DataFrame, bits: int) -> np.ndarray:
    """Bit field over the hashes of the references."""
    return bit_field(windows.select(F.shiftrightunsigned("h", 64 - bits).alias("k")), bits)


def contaminated(crawled_pages: DataFrame, references: DataFrame, window: int = 8, min_words: int = 4, min_run: int = 5,
                 min_share: float = 0.5, bits: int = 24) -> DataFrame:
    """``crawled_pages(url, text)``, ``references(slug, text)`` -> ``(url, slug, windows, share, verbatim, first, last)``, one row for
    each page and each reference it holds.

    Where one value of the reference stands at several places of an alignment, the most frequent value there is right and template windows
    that hold another one are left out; if two are equally frequent, none is right. A position of the reference counts once if the page has its literal window, or its template window with right values. A page holds a
    reference if such positions are ``min_run`` or more, or at least ``min_share`` of the reference's positions or of its template windows. ``verbatim`` says that all slots have the reference's values; ``first`` and ``last`` are
    the template tokens of the page between which the windows lie.

    A reference shorter than the window is one window of its own length. Template windows need ``min_words`` literal
    words, literal windows as many tokens of any kind: a reference of fewer tokens proves nothing and is never found, nor are null and empty
    texts on either side. A reference given twice under one slug counts
    once. Repeated pages are one url. Texts are read whole; extra columns are not read; an empty table on either side gives
    an empty result.
    """
    theirs = scratch.table(template_windows(references, "slug", None, window, min_words), "reference-windows")
    lengths = sorted(r[0] for r in theirs.select("length").distinct().collect())  # at most as many as a window is long
    if not lengths:
        lengths = [window]
    ours = template_windows(crawled_pages, "url", lengths, window, min_words, _marked(theirs, bits), bits)
    theirs = theirs.groupBy("slug", "h", "at", "length", "literal").agg(F.first("slots").alias("slots"), F.max("total").alias("total"),
                                                                        F.max("places").alias("places"))
    # Windows without slots only have to occur: of a page's equal ones the first and the last place are enough, however often a phrase repeats on either side.
    ours = scratch.table(ours, "page-windows")
    plain = ours.filter(F.col("literal") | (F.size("slots") == 0)).groupBy("url", "h", "length", "literal").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    found_plain = plain.join(theirs.withColumnRenamed("at", "there"), ["h", "length", "literal"]).select(
        "url", "slug", "there", "total", "places", "literal", F.lit(True).alias("same"), "first", (F.col("last") + F.col("length")).alias("last"))
    hits = ours.filter(~F.col("literal") & (F.size("slots") > 0)).select("url", "h", "length", "literal", F.col("at").alias("here"), F.col("slots").alias("mine"), "spots").join(
        theirs.withColumnRenamed("at", "there"), ["h", "length", "literal"])
    hits = hits.select("url", "slug", "here", "there", "length", "literal", "total", "places", "mine", "slots", "spots", (F.col("here") - F.col("there")).alias("shift"))
    hits = scratch.settled(hits.distinct())
    slots = hits.select("url", "slug", "shift", "here", "length", F.explode(F.arrays_zip("slots", "mine", "spots")).alias("z")).select(
        "url", "slug", "shift", "here", "length", "z.*")
    slot = ["url", "slug", "shift", "slots"]
    often = slots.groupBy(*slot, "mine").agg(F.count_distinct("spots").alias("n"))
    # The most frequent value of a slot, by places; the largest and the smallest of them are one value if there is only one.
    odd = often.groupBy(*slot).agg(F.max(F.struct("n", "mine")).alias("most"), F.max(F.struct("n", F.expr("~mine").alias("not"))).alias("least"),
                                   F.count(F.lit(1)).alias("values")).filter("values > 1")
    odd = odd.select(*slot, F.expr("if(most.mine = ~least.not, most.mine, null)").alias("winner"))
    bad = slots.join(odd, slot).filter("winner is null or mine <> winner").select("url", "slug", "shift", "here", "length").distinct()
    kept = hits.join(bad, ["url", "slug", "shift", "here", "length"], "left_anti").select(
        "url", "slug", "there", "total", "places", "literal", F.expr("slots = mine").alias("same"), F.col("here").alias("first"), (F.col("here") + F.col("length")).alias("last"))
    whole = kept.unionByName(found_plain).groupBy("url", "slug", "there").agg(
        F.max("total").alias("total"), F.max("places").alias("places"), F.max((~F.col("literal")).cast("int")).alias("template"), F.min(F.col("same").cast("int")).alias("same"),
        F.min("first").alias("first"), F.max("last").alias("last"))
    found = whole.groupBy("url", "slug").agg(
        F.count(F.lit(1)).alias("windows"), F.max("total").alias("total"), F.max("places").alias("places"), F.sum("template").alias("templates"), (F.min("same") == 1).alias("verbatim"),
        F.min("first").alias("first"), F.max("last").alias("last"))
    share = F.greatest(F.col("windows") / F.col("places"), F.when(F.col("total") > 0, F.col("templates") / F.col("total")))
    return found.filter((F.col("windows") >= min_run) | (share >= min_share)).select(
        "url", "slug", "windows", share.alias("share"), "verbatim", "first", "last")
