"""Text without reliable spaces or marks: cut into dictionary words by a least-cost path, each word spelled by what stands around it.

A dictionary is kept by hand or comes with a language, so it is small next to the text: its size is checked, and every task holds it as an automaton of
skeletons. What is learned from the text is not: frequencies and neighbours of words are counted per task, summed by the shuffle, and
only what a page asks for is joined to it.

1. ``word_contexts`` finds all dictionary words in trusted text in one pass, with the letters before and after them where a skeleton has several spellings.
2. ``with_costs`` gives each skeleton its spellings and its cost: 10 for unseen words down to 4 for frequent ones.
3. ``cut_lines`` finds the cheapest cut of each run of the script. Words pay their cost, 3 for each space inside, and letters outside words 40.
4. ``repair_pages`` puts in the spelling whose surroundings are most frequent on the page and in the corpus.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from itertools import groupby
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.functions.textclean import SARA_AA, SARA_AM, TONE_MARKS, plain_skeleton, word_cost
from vitrine.operators.cuts import LETTERS_AT_ONCE, Cuts, Runs, WordTree, codes_of
from vitrine.operators.spelling import dictionary_index
from vitrine.session import materialize

SCRIPT = "฀-๿"
# What a space inside a word and a letter outside words cost, beside the words' own 4 to 10.
SPACE_COST, UNKNOWN_COST = 3, 40
#: The most words a dictionary may have; each task holds it.
MAX_DICTIONARY = 2_000_000
#: Counts that a task keeps before they go out, contexts that each task may hold, and rows it works on at a time.
HELD, HELD_CONTEXTS, ROWS = 200_000, 200_000, 256
#: Bits of a letter in a context, and what stands there for no letter.
LETTER_BITS = 21
_LETTER_MASK = (1 << LETTER_BITS) - 1
NO_LETTER = 0x110000


#: Marks at the begin of a run stand on no letter and go.
LOOSE_MARKS = re.compile(f"(?:[{TONE_MARKS}]+ *)+$")


def run_pattern(script: str = SCRIPT) -> re.Pattern:
    """Runs of the script; spaces inside belong to them."""
    return re.compile(f"[{script}]+(?: +[{script}]+)*")


def dictionary_words(dictionary: DataFrame, word: str = "word") -> list[tuple[str, str]]:
    """(word, skeleton) of a dictionary, in order; an error if it is too large for every task to hold."""
    index = dictionary_index(dictionary.select(F.col(word).alias("word"))).filter(F.col("skeleton") != "")
    rows = index.orderBy("word").limit(MAX_DICTIONARY + 1).collect()
    if len(rows) > MAX_DICTIONARY:
        raise ValueError(f"a dictionary of more than {MAX_DICTIONARY} words; pass its frequent words only")
    return [(r["word"], r["skeleton"]) for r in rows]


def _ambiguous(words: Sequence[tuple[str, str]]) -> set[str]:
    spellings = Counter(s for _, s in words)
    return {w for w, s in words if spellings[s] > 1}


def word_contexts(texts: DataFrame, text: str, words: Sequence[tuple[str, str]]) -> DataFrame:
    """``(word, prev, next, n)``: how often each dictionary word occurs in trusted text, spaces left out, and between which letters; the
    ends of a text count as a line feed. Words whose skeleton has no other spelling have one row with empty neighbours. Words inside words count, too."""
    shared = texts.sparkSession.sparkContext.broadcast(([w for w, _ in words], _ambiguous(words)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, unclear = shared.value
        if not known:
            return
        tree, open_ = WordTree(known), np.array([w in unclear for w in known])
        held, times, clear = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(known), np.int64)

        def sent() -> pa.RecordBatch:
            letter = lambda at: pa.array(["" if c == NO_LETTER else chr(c) for c in ((held >> at) & _LETTER_MASK).tolist()], pa.string())
            return pa.RecordBatch.from_arrays([pa.array(known, pa.string()).take(pa.array(held >> 2 * LETTER_BITS)), letter(LETTER_BITS), letter(0),
                                               pa.array(times, pa.int64())], names=["word", "prev", "next", "n"])

        for some in _portions(re.sub("[ \t]+", "", whole) for batch in batches for at in range(0, batch.num_rows, ROWS)
                              for whole in batch.column(0).slice(at, ROWS).to_pylist() if whole):
            codes = codes_of("\n".join(["", *some, ""])).astype(np.int64)
            letters = tree.letter[codes]
            letters[np.cumsum([0, *(len(t) + 1 for t in some)])] = 0  # between texts
            first, size, word = tree.found(letters)
            some_open = open_[word]
            clear += np.bincount(word[~some_open], minlength=len(known))
            first, size, word = first[some_open], size[some_open], word[some_open]
            around = codes[first - 1] << LETTER_BITS | codes[first + size]
            held, place = np.unique(np.append(held, word << 2 * LETTER_BITS | around), return_inverse=True)
            times = np.bincount(place, np.append(times, np.ones(len(word), np.int64)), len(held)).astype(np.int64)
            if len(held) > HELD:
                yield sent()
                held, times = held[:0], times[:0]
        seen = np.flatnonzero(clear)
        held, times = np.append(held, seen << 2 * LETTER_BITS | NO_LETTER << LETTER_BITS | NO_LETTER), np.append(times, clear[seen])
        if len(held):
            yield sent()

    return texts.select(text).mapInArrow(run, "word string, prev string, next string, n long").groupBy("word", "prev", "next").agg(F.sum("n").alias("n"))


def with_costs(dictionary: DataFrame, contexts: DataFrame, word: str = "word") -> DataFrame:
    """``(skeleton, spellings, cost)``: cost by the most frequent spelling, spellings in order."""
    freq = contexts.groupBy("word").agg(F.sum("n").alias("freq"))
    index = dictionary_index(dictionary.select(F.col(word).alias("word"))).filter(F.col("skeleton") != "")
    best = F.max(F.coalesce("freq", F.lit(0)))
    return index.join(freq, "word", "left").groupBy("skeleton").agg(F.array_sort(F.collect_set("word")).alias("spellings"), word_cost(best).alias("cost"))


def _portions(texts: Iterable[str]) -> Iterator[list[str]]:
    """Texts, as many at a time as a task has in arrays."""
    some, letters = [], 0
    for text in texts:
        some.append(text)
        letters += len(text) + 1
        if letters >= LETTERS_AT_ONCE:
            yield some
            some, letters = [], 0
    if some:
        yield some


def unknown_share(pages: DataFrame, keys: Sequence[str], text: str, dictionary: DataFrame, script: str = SCRIPT) -> DataFrame:
    """``(keys, chars, unknown_chars, unknown_ratio)``: share of the letters of a script that no cut into dictionary words covers; 0 without such letters."""
    shared = pages.sparkSession.sparkContext.broadcast(sorted({s for _, s in dictionary_words(dictionary)}))
    schema = T.StructType([*(pages.schema[k] for k in keys), T.StructField("chars", T.LongType()), T.StructField("unknown_chars", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, runs = WordTree(shared.value), run_pattern(script)
        price = np.zeros(len(tree.words), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                found = [runs.findall(t or "") for t in some.column(len(keys)).to_pylist()]
                page = np.repeat(np.arange(len(found)), list(map(len, found)))
                chars, outside, done = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64), 0
                for portion in _portions(r for of_page in found for r in of_page):
                    laid = Runs(portion)
                    cuts, of = Cuts(laid, tree, price, 1), page[done:done + len(portion)][laid.run]
                    chars += np.bincount(of[~laid.end], minlength=len(found))
                    np.add.at(outside, of[cuts.ends - 1], cuts.cost)
                    done += len(portion)
                yield pa.RecordBatch.from_arrays([*some.columns[:len(keys)], pa.array(chars), pa.array(outside)], names=[f.name for f in schema])

    out = pages.select(*keys, text).mapInArrow(run, schema)
    return out.withColumn("unknown_ratio", F.coalesce(F.try_divide("unknown_chars", "chars"), F.lit(0.0)))


def _cut_pages(pages: Sequence[Sequence[str | None] | None], runs: re.Pattern, tree: WordTree, price: np.ndarray) -> tuple[np.ndarray, ...]:
    """(page, line, first, end, number of the word or -1, had a space before it, letter behind it in its run) of all parts of pages, in order."""
    where, out, done = [], [], 0

    def found() -> Iterator[str]:
        for no, page in enumerate(pages):
            for line_no, line in enumerate(page or []):
                for m in runs.finditer(line or ""):
                    where.append((no, line_no, m.start()))
                    yield m.group()

    for portion in _portions(found()):
        laid = Runs(portion)
        first, end, word = Cuts(laid, tree, price, UNKNOWN_COST, SPACE_COST).parts()
        page, line, start = np.array(where[done:done + len(portion)], np.int64).reshape(-1, 3)[laid.run[first]].T
        out.append((page, line, start + laid.place[first], start + laid.place[end], word, laid.spaced[first], np.where(laid.end[end], NO_LETTER, laid.written[end])))
        done += len(portion)
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip((none, none, none, none, none, none.astype(bool), none), *out))


def _shared_costs(costs: DataFrame):
    rows = costs.select("skeleton", "cost").limit(MAX_DICTIONARY + 1).collect()
    if len(rows) > MAX_DICTIONARY:
        raise ValueError(f"a dictionary of more than {MAX_DICTIONARY} words; pass its frequent words only")
    return costs.sparkSession.sparkContext.broadcast({r["skeleton"]: r["cost"] for r in rows})


def cut_lines(pages: DataFrame, keep: Sequence[str], lines: str, costs: DataFrame, script: str = SCRIPT) -> DataFrame:
    """Pages with ``parts``, the words and letters of all runs of all their lines: ``(line, first, end, skeleton, space)``, skeleton null for a letter outside words.
    ``costs(skeleton, spellings, cost)`` as from ``with_costs``."""
    shared = _shared_costs(costs)
    part = T.StructType([T.StructField("line", T.IntegerType()), T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType()),
                         T.StructField("skeleton", T.StringType()), T.StructField("space", T.BooleanType())])
    schema = T.StructType([*(pages.schema[k] for k in keep), pages.schema[lines], T.StructField("parts", T.ArrayType(part))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, tree, price = _cutter(script, shared.value)
        skeletons = pa.array(tree.words, pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                page, line, first, end, word, space, _ = _cut_pages(some.column(len(keep)).to_pylist(), runs, tree, price)
                fields = [*(pa.array(v.astype(np.int32)) for v in (line, first, end)), skeletons.take(pa.array(word, mask=word < 0)), pa.array(space)]
                ends = np.cumsum([0, *np.bincount(page, minlength=some.num_rows)])
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, names=part.names))
                yield pa.RecordBatch.from_arrays([*some.columns, listed], names=[f.name for f in schema])

    return pages.select(*keep, lines).mapInArrow(run, schema)


def readable_names(names: DataFrame, keys: Sequence[str], name: str, dictionary: DataFrame, share: float = 0.9, digits: str = "[๐-๙]", script: str = SCRIPT) -> DataFrame:
    """``(keys, readable)``: is a recognised name made of dictionary words, ``share`` of its pieces at least, and without native digits? A stretch of letters outside
    words is one piece; a name without letters of the script is not readable."""
    spark = names.sparkSession
    costs = with_costs(dictionary, spark.createDataFrame([], "word string, prev string, next string, n long"))
    cut = cut_lines(names.select(*keys, F.col(name).alias("__name"), F.array(name).alias("__lines")), [*keys, "__name"], "__lines", costs, script)
    known = F.size(F.filter("parts", lambda p: p["skeleton"].isNotNull()))
    before = lambda i: F.get(F.col("parts"), i - 1)
    goes_on = lambda p, i: F.coalesce((i > 0) & before(i)["skeleton"].isNull() & (before(i)["end"] == p["first"]), F.lit(False))
    unknown = F.size(F.filter("parts", lambda p, i: p["skeleton"].isNull() & ~goes_on(p, i)))
    good = (known > 0) & (known >= share * (known + unknown)) & ~F.coalesce(F.col("__name").rlike(digits), F.lit(False))
    return cut.select(*keys, F.coalesce(good, F.lit(False)).alias("readable"))


def is_subsequence(small: str, big: str) -> bool:
    rest = iter(big)
    return all(c in rest for c in small)


def marks_of(word: str) -> str:
    return "".join(c for c in word if c in TONE_MARKS)


def chosen(original: str, spellings: Sequence[str], page: str, before: str, after: str, seen: dict[tuple[str, str], tuple[str, list[int]]], reliable: bool) -> str:
    """The spelling of one word. Those that hold the marks that are left come first, then, where vowels are reliable, those with as many sara am; of these
    the one most frequent between its neighbours, before its next letter, after its last one, the original itself, the most frequent, the one with fewest marks."""
    fit = [c for c in spellings if is_subsequence(marks_of(original), marks_of(c))] or list(spellings)
    if reliable:
        fit = [c for c in fit if c.count(SARA_AM) == original.count(SARA_AM)] or fit
    if len(fit) == 1:
        return fit[0]

    def times(c: str, prev: str, next: str) -> int:
        letters, counts = seen.get((c, next), ("", ()))
        if not prev:
            return sum(counts)
        at = letters.find(prev)
        return counts[at] if at >= 0 else 0

    return max(fit, key=lambda c: (page.count(before + c + after) + times(c, before, after), page.count(c + after) + times(c, "", after), times(c, before, ""),
                                   c == original, times(c, "", ""), -len(marks_of(c))))


def repair_pages(pages: DataFrame, keys: Sequence[str], lines: str, dictionary: DataFrame, trusted: DataFrame, text: str = "text", page_text: str | None = None,
                 reliable_vowels: Column | None = None, script: str = SCRIPT) -> DataFrame:
    """Pages with repaired ``lines`` (an array of strings), all other columns as they are; ``keys`` name a page.

    ``trusted(text)`` is the corpus whose frequencies and contexts decide, ``page_text`` a column with trusted text of the page itself, ``reliable_vowels``
    says where sara am can be told from sara aa. Runs of the script are cut into words, words get their spelling, spaces stay only before words. Each task holds
    the contexts of the ambiguous words while there are at most ``HELD_CONTEXTS``. Where there are more, each page asks for those of its own words and they are joined
    to it, so nothing of the corpus' size goes to a task as a whole.
    """
    words = dictionary_words(dictionary)
    contexts = materialize(word_contexts(trusted, text, words))
    costs = _shared_costs(with_costs(dictionary, contexts))
    spellings: dict[str, list[str]] = {}
    for w, s in words:
        spellings.setdefault(s, []).append(w)
    shared = pages.sparkSession.sparkContext.broadcast(spellings)

    own = F.col(page_text) if page_text else F.lit("")
    whole = pages.withColumn("__page", F.regexp_replace(F.coalesce(own, F.lit("")), "[ \t]+", "")).withColumn(
        "__reliable", F.coalesce(reliable_vowels, F.lit(False)) if reliable_vowels is not None else F.lit(True))
    listed = F.collect_list(F.struct("prev", "n"))
    unclear = contexts.filter("prev <> ''")
    by_next = unclear.groupBy("word", "next").agg(listed.alias("prevs"))
    any_next = unclear.groupBy("word", "prev").agg(F.sum("n").alias("n")).groupBy("word").agg(listed.alias("prevs")).select("word", F.lit("").alias("next"), "prevs")
    # In flat arrays, which a task reads without an object per number.
    flat = by_next.unionByName(any_next).select("word", "next", F.array_join("prevs.prev", "").alias("letters"), F.col("prevs.n").alias("times"))
    asks = ["__word", "__next", "__letters", "__times"]
    few = unclear.limit(HELD_CONTEXTS + 1).count() <= HELD_CONTEXTS
    if few:
        ready, known = whole, pages.sparkSession.sparkContext.broadcast([tuple(r) for r in flat.collect()])
    else:
        ready, known = _with_contexts(whole, keys, lines, costs, shared, flat, asks, script), None
    schema, names = T.StructType([pages.schema[c] for c in pages.columns]), pages.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, tree, price = _cutter(script, costs.value)
        everywhere = {(w, n): (p, t) for w, n, p, t in known.value} if few else {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                columns = [some.column(c).to_pylist() for c in (lines, "__page", "__reliable")]
                page, line, first, end, word, space, _ = _cut_pages(columns[0], runs, tree, price)
                parts = list(zip(line.tolist(), first.tolist(), end.tolist(), [tree.words[i] if i >= 0 else None for i in word.tolist()], space.tolist()))
                ends = np.cumsum([0, *np.bincount(page, minlength=some.num_rows)]).tolist()
                if few:
                    seen = [everywhere] * some.num_rows
                else:
                    seen = [dict(zip(zip(w, n), zip(p, t))) if w else {} for w, n, p, t in zip(*(some.column(c).to_pylist() for c in asks))]
                fixed = [_repaired(*row, parts[a:b], told, shared.value) for *row, a, b, told in zip(*columns, ends, ends[1:], seen)]
                yield pa.RecordBatch.from_arrays([pa.array(fixed, some.schema.field(c).type) if c == lines else some.column(c) for c in names], names=names)

    return ready.mapInArrow(run, schema)


def _cutter(script: str, costs: dict[str, int]) -> tuple[re.Pattern, WordTree, np.ndarray]:
    return run_pattern(script), WordTree(list(costs)), np.array(list(costs.values()), np.int64)


def _with_contexts(pages: DataFrame, keys: Sequence[str], lines: str, costs, spellings, contexts: DataFrame, names: Sequence[str], script: str) -> DataFrame:
    """Pages with what they ask for of ``contexts(word, next, letters, times)``, as lists: each spelling of their unclear words before its next letter, and before any."""
    schema = T.StructType([*(pages.schema[k] for k in keys), T.StructField("word", T.StringType()), T.StructField("next", T.StringType())])

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, tree, price = _cutter(script, costs.value)
        several = np.array([len(spellings.value[s]) > 1 for s in tree.words], bool)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                page, _, _, _, word, _, behind = _cut_pages(some.column(len(keys)).to_pylist(), runs, tree, price)
                open_ = np.flatnonzero(word >= 0)
                open_ = open_[several[word[open_]]]
                wanted = np.unique(np.concatenate([np.stack([page[open_], word[open_], x]) for x in (behind[open_], np.full(len(open_), NO_LETTER))], axis=1), axis=1)
                asked = [(of, w, "" if c == NO_LETTER else chr(c)) for of, s, c in wanted.T.tolist() for w in spellings.value[tree.words[s]]]
                of, word_, next_ = zip(*asked) if asked else ((), (), ())
                take = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in some.columns[:len(keys)]), pa.array(word_, pa.string()), pa.array(next_, pa.string())],
                                                 names=[f.name for f in schema])

    asked = pages.select(*keys, lines).mapInArrow(ask, schema).distinct()
    told = asked.join(contexts, ["word", "next"]).groupBy(*keys).agg(F.collect_list(F.struct("word", "next", "letters", "times")).alias("__told"))
    told = told.select(*[F.col(k).alias(f"__of_{i}") for i, k in enumerate(keys)], *[F.col(f"__told.{c}").alias(n) for c, n in zip(contexts.columns, names)])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__of_{i}")) for i, k in enumerate(keys)])
    return pages.join(told, same, "left").drop(*[f"__of_{i}" for i in range(len(keys))])


def _repaired(lines: list[str] | None, page: str, reliable: bool, parts: list[tuple], seen: dict, spellings: dict[str, list[str]]) -> list[str] | None:
    if lines is None:
        return None
    out = list(lines)
    for no, group in groupby(parts, key=lambda p: p[0]):
        found, line, made, at, previous = list(group), lines[no], [], 0, ""
        for k, (_, first, end, skeleton, space) in enumerate(found):
            if k == 0 or first != at:  # a new run
                made.append(LOOSE_MARKS.sub("", line[at:first]))
                previous = ""
            word = line[first:end].replace(" ", "")
            if skeleton is not None:
                words = spellings[skeleton]
                follows = k + 1 < len(found) and found[k + 1][1] == end
                word = chosen(word, words, page, previous, line[end] if follows else "", seen, reliable) if len(words) > 1 else words[0]
            made.append(" " + word if space and previous else word)
            previous, at = word[-1:] or previous, end
        made.append(line[at:])
        out[no] = "".join(made)
    return out
