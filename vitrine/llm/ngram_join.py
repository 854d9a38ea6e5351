"""Near-duplicate pages: exact join of word n-gram sets by Jaccard similarity, with rare-first prefix filtering.

1. One pass counts all n-grams of the corpus in a table of fixed size. Its counts order n-grams from rare to common; any
   order gives the same result, this one makes prefixes selective.
2. One pass takes from each page the prefix of its ordered set: two sets that are similar enough must share an n-gram of their
   prefixes. Pages with equal sets are one from here on, and a task lists a set once however many copies it reads.
3. Prefix n-grams listed by one set only are gone after one shuffle. Pairs that share one pass the length filter, the
   positional filter at their first common n-gram, and the sketch filter (n-grams are dealt into groups, about two or more for each;
   where two sets hold an odd and an even number of a group they differ by one at least), and are then verified once on their whole sets.
4. A group of near copies would give all its pairs. So the sets of a list are first compared with one of them, the set that stands
   in most lists, and those it did not reach with a few drawn by hash. Sets found to be connected need no comparison, so only pairs
   across components are left for the last round. That takes every one of them, so no link between components is lost.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from vitrine.llm import scratch
from vitrine.llm.bit_field import bit_field, place
from vitrine.llm.columns import hand_back, in_small_batches, let_go, sliced, texts_of, with_columns
from vitrine.llm.components import components

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Odd constants that make the hash of an n-gram depend on the order of its words.
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Groups of a sketch at most: sketches of larger sets let more pairs pass.
MOST_GROUPS = 1 << 17
SLICES = 16
CACHE_WORDS = 200_000
#: What lists keep of an n-gram's hash: the upper 48 bits. The lower bytes are 0 and come first in a row, so that rows take less room when they are dealt. N-grams that
#: become one by it only add a pair to compare.
LISTED = ~np.uint64(0xFFFF)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Shingler:
    """64-bit hashes of the word n-grams of texts, A-Z lower-cased, words cut at ASCII white space. Fewer words than
    ``n`` make one n-gram of all of them."""

    def __init__(self, n: int):
        self.n, self.words = n, _Hashes()

    def _grams(self, w: np.ndarray, k: int) -> np.ndarray:
        out = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            out *= FACTOR
            out += w[i:len(w) - k + 1 + i]
            out ^= out >> np.uint64(29)
        return _mixed(out)

    def all(self, texts: list[str]) -> list[np.ndarray]:
        """N-grams of every text in order, repeats included."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        found = [t.encode().translate(LOWER).split() for t in texts]
        ends = np.cumsum([0, *map(len, found)]).tolist()
        w = np.fromiter(map(self.words.__getitem__, chain.from_iterable(found)), np.uint64, ends[-1])
        # All texts at once; n-grams that reach into the next text are left out below.
        grams = self._grams(w, self.n) if len(w) >= self.n else w[:0]
        return [grams[a:b - self.n + 1] if b - a >= self.n else self._grams(w[a:b], b - a) if b > a else w[:0]
                for a, b in zip(ends, ends[1:])]

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """Distinct n-grams of every text in ascending order."""
        out = []
        for grams in self.all(texts):
            grams.sort()
            out.append(grams[np.concatenate([[True], grams[1:] != grams[:-1]])] if len(grams) else grams)
        return out


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """One bit per group of n-grams, set if the set has an odd number of them. Groups are a power of two, 64 and two per n-gram at least, and go by the
    last bits of the hash: halves of a sketch that are put over one another make the next smaller one."""
    size = min(MOST_GROUPS, max(64, 1 << (2 * len(hashes) - 1).bit_length() if len(hashes) else 0))
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def corpus_counts(crawled_pages: DataFrame, words: int, bits: int) -> np.ndarray:
    """Occurrences of all n-grams of all pages, in 2**bits counters by hash, as powers of two (one byte each).

    Each task fills one table and sends it in slices that are added up slice by slice, one slice in memory at a time.
    """
    size = 1 << bits
    part = size // SLICES

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        shingler, total = Shingler(words), np.zeros(size, np.uint32)
        waiting, n = [], 0
        for batch in sliced(batches):
            waiting += [(h >> np.uint64(64 - bits)).astype(np.int32) for h in shingler.all(texts_of(batch))]
            n += sum(map(len, waiting[-batch.num_rows:]))
            if n > size:
                total += np.bincount(np.concatenate(waiting), minlength=size).astype(np.uint32)
                waiting, n = [], 0
        if n:
            total += np.bincount(np.concatenate(waiting), minlength=size).astype(np.uint32)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()),
                                              pa.array([zlib.compress(total[i * part:(i + 1) * part].tobytes(), 1) for i in range(SLICES)], pa.binary())], names=["slice", "counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in sliced(batches, 4):
            for k, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                sums[k] = sums.get(k, np.zeros(part, np.uint64)) + np.frombuffer(zlib.decompress(counts), np.uint32)
        if sums:
            powers = [np.ceil(np.log2(v + 1.0)).astype(np.uint8).tobytes() for v in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(powers, pa.binary())], names=["slice", "counts"])

    schema = "slice int, counts binary"
    with scratch.shuffles_go(crawled_pages.sparkSession):
        rows = crawled_pages.select("text").mapInArrow(count, schema).repartition(SLICES, "slice").mapInArrow(add, schema).collect()
    out = np.zeros(size, np.uint8)
    for r in rows:
        out[r["slice"] * part:(r["slice"] + 1) * part] = np.frombuffer(r["counts"], np.uint8)
    return out


def prefix_length(n: int, percent: int) -> int:
    """A set of ``n`` shares at least ``percent`` of its n-grams with any similar one, so one of the first so many."""
    return n - (percent * n + 99) // 100 + 1 if n else 0


def page_sets(crawled_pages: DataFrame, counts: np.ndarray, words: int, percent: int, bits: int, hot_rows: int) -> DataFrame:
    """``(url, n, digest, sketch, prefix)`` of every page; prefix holds ``(h, part)`` rare first, null if this task has listed
    the set before. An n-gram that may stand in more than ``hot_rows`` lists is dealt into parts 1, 2, ...; all others have part 0."""
    shared = crawled_pages.sparkSession.sparkContext.broadcast(counts)
    entry = T.StructType([T.StructField("h", T.LongType()), T.StructField("part", T.IntegerType())])
    schema = T.StructType([crawled_pages.schema["url"], T.StructField("n", T.IntegerType()), T.StructField("digest", T.BinaryType()),
                           T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("prefix", T.ArrayType(entry))])
    kind = pa.list_(pa.struct([("h", pa.int64()), ("part", pa.int32())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        shingler, counted, listed = Shingler(words), shared.value, set()
        part_count = np.array([max(1, (1 << k) // hot_rows) for k in range(65)])
        for batch in sliced(batches):
            n, digests, sketches, offsets, missing, hs, parts = [], [], [], [0], [], [], []
            for hashes in shingler.sets(texts_of(batch)):
                digest = xxhash.xxh3_128_digest(hashes.tobytes())
                new = len(hashes) > 0 and digest not in listed
                n.append(len(hashes))
                digests.append(digest)
                sketches.append(sketch_of(hashes))
                missing.append(not new)
                if new:
                    listed.add(digest)
                    often = counted[(hashes >> np.uint64(64 - bits)).astype(np.int64)]
                    # Rare first, then by hash: count and hash share one number, less the hash's last bits.
                    key = (often.astype(np.uint64) << np.uint64(56)) | (hashes >> np.uint64(8))
                    p = prefix_length(len(hashes), percent)
                    first = np.argpartition(key, p - 1)[:p] if p < len(key) else np.arange(p)
                    first = first[np.argsort(key[first])]
                    hs.append((hashes[first] & LISTED).view(np.int64))
                    dealt = part_count[often[first]]
                    parts.append(np.where(dealt > 1, 1 + int.from_bytes(digest[:4], "little") % dealt, 0))
                offsets.append(offsets[-1] + (len(hs[-1]) if new else 0))
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *hs])),
                                               pa.array(np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int32))], names=["h", "part"])
            prefix = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, mask=pa.array(missing)).cast(kind)
            yield with_columns(batch, ["url"], n=pa.array(n, pa.int32()), digest=pa.array(digests, pa.binary()),
                               sketch=pa.array(sketches, pa.list_(pa.int64())), prefix=prefix)
        del shingler, listed
        hand_back()

    return crawled_pages.mapInArrow(run, schema)


def needed_overlap(n: Column, m: Column, percent: int) -> Column:
    return F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))


def _may_begin(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    """Length filter, and positional filter for a first common n-gram at places ``i`` and ``j``: what is left from there on in
    either set must hold the needed overlap. A similar pair passes at its first common n-gram at least."""
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (F.least(n - i, m - j) >= needed_overlap(n, m, percent))


def _worth_comparing(postings: DataFrame, who: str, percent: int) -> DataFrame:
    """Entries of lists that name two or more. A list of just two goes if they cannot begin to be similar with this n-gram; most
    n-grams that unlike texts share by chance are such lists. Lists in parts are judged later. ``postings`` come dealt by list: a window that
    deals them itself sends what it compares a second time."""
    w = W.partitionBy("h", "part")
    one = F.struct(who, "n", "i")
    return (postings.withColumns({"lo": F.min(one).over(w), "hi": F.max(one).over(w), "many": F.count(F.lit(1)).over(w)})
            .filter((F.col("part") > 0) | ((F.col(f"lo.{who}") != F.col(f"hi.{who}")) & (
                (F.col("many") > 2) | _may_begin(F.col("lo.n"), F.col("lo.i"), F.col("hi.n"), F.col("hi.i"), percent))))
            .drop("lo", "hi", "many"))


def _distinct(pairs: DataFrame) -> DataFrame:
    """``(a, b, na, nb)`` once per pair, however many lists it stands in."""
    return pairs.groupBy("a", "b").agg(F.min("na").alias("na"), F.min("nb").alias("nb"))


def _folded(sketch: Column, size: Column) -> Column:
    """``sketch`` as a sketch of ``size`` numbers, which is its own size or smaller."""
    parts = F.sequence(F.lit(0), F.floor(F.size(sketch) / size).cast("int") - 1)
    over = F.aggregate(parts, F.array_repeat(F.lit(0).cast("long"), size), lambda whole, k: F.zip_with(
        whole, F.slice(sketch, k * size + 1, size), lambda x, y: x.bitwiseXOR(y)))
    return F.when(F.size(sketch) == size, sketch).otherwise(over)


def _sketch_filter(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """``pairs`` without those whose sketches tell that they share too little: n-grams that only one set holds number the bits that differ at least."""
    for side in "ab":
        pairs = pairs.join(sketches.select(F.col("rep").alias(side), F.col("sketch").alias(f"s{side}")), side)
    size = F.least(F.size("sa"), F.size("sb"))
    differ = F.aggregate(F.zip_with(_folded(F.col("sa"), size), _folded(F.col("sb"), size), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                         F.lit(0), lambda x, y: x + y)
    return pairs.filter(F.col("na") + F.col("nb") - differ >= 2 * needed_overlap(F.col("na"), F.col("nb"), percent)).select("a", "b")


#: Pairs of one text that a task compares; a text with more of them goes to several tasks.
PAIRS_TOGETHER = 2_000
#: Texts that a task unpacks at one time.
UNPACKED = 32


def _arranged(pairs: DataFrame, url: T.StructField) -> DataFrame:
    """``(centre, salt, url, first)`` for the texts that have to meet: of each pair the end with more pairs is the centre, named by ``first`` once per salt, and
    the other end comes to one salt of it."""
    count = F.count(F.lit(1))
    degree = scratch.settled(pairs.select(F.explode(F.array("a", "b")).alias("u")).groupBy("u").agg(count.alias("d")))
    for side in "ab":
        pairs = pairs.join(degree.select(F.col("u").alias(side), F.col("d").alias(f"d{side}")), side)
    swap = F.col("db") > F.col("da")
    pairs = pairs.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("centre"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("url"),
                         F.greatest("da", "db").alias("d"))
    salts = F.ceil(F.col("d") / PAIRS_TOGETHER).cast("int")
    others = pairs.select("centre", F.pmod(F.xxhash64("url"), salts).cast("int").alias("salt"), "url", F.lit(False).alias("first"))
    return others.unionByName(others.select("centre", "salt", F.col("centre").alias("url"), F.lit(True).alias("first")).distinct())


def verified(crawled_pages: DataFrame, pairs: DataFrame, words: int, percent: int, bits: int = 20) -> DataFrame:
    """Those ``pairs(a, b)`` of urls whose whole sets are similar. A pair of sets is compared once.

    Texts travel, packed, not their sets, which are several times larger: each text that has pairs is dealt by url once, and from there to the text that it is
    compared with, which comes first in its cell. Their sets are made where they meet, of a few texts at a time.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("u")).select(place(F.col("u"), bits).alias("k"))
    shared = crawled_pages.sparkSession.sparkContext.broadcast(bit_field(ends, bits))
    url = crawled_pages.schema["url"]
    schema = T.StructType([url, T.StructField("packed", T.BinaryType())])

    def asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in sliced(batches):
            kept = batch.filter(pa.array(shared.value[batch.column("k").to_numpy(zero_copy_only=False)]))
            yield with_columns(kept, ["url"], packed=pa.array([zlib.compress(t.encode(), 1) for t in texts_of(kept)], pa.binary()))

    def similar(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        shingler, cell, centre = Shingler(words), None, None
        for batch in sliced(batches, UNPACKED):
            keep = []
            sets = shingler.sets([zlib.decompress(t).decode() for t in batch.column("packed").to_pylist()])
            for c, salt, first, found in zip(*(batch.column(k).to_pylist() for k in ("centre", "salt", "first")), sets):
                if first:
                    cell, centre = (c, salt), found
                    keep.append(False)
                else:
                    assert cell == (c, salt), "a cell begins with its centre"
                    common = len(np.intersect1d(centre, found, assume_unique=True))
                    keep.append(100 * common >= percent * (len(centre) + len(found) - common))
            yield batch.select(["centre", "url"]).rename_columns(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        del shingler
        hand_back()

    whole = crawled_pages.select("url", "text", place(F.col("url"), bits).alias("k")).mapInArrow(asked, schema)
    met = _arranged(pairs, url).join(whole, "url").select("centre", "salt", F.col("first"), "url", "packed")
    cells = met.repartition("centre", "salt").sortWithinPartitions("centre", "salt", F.col("first").desc())
    found = cells.mapInArrow(similar, T.StructType([T.StructField(c, url.dataType) for c in "ab"]))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(crawled_pages: DataFrame, words: int = 5, percent: int = 75, draws: int = 4, count_bits: int = 20,
                    hot_rows: int = 1_000_000) -> DataFrame:
    """``crawled_pages(url, text)`` -> ``(url, n_shingles, component)``, one row per page.

    Two pages are linked if ``100 * common >= percent * united`` n-grams; ``component`` is the smallest url reachable by links. Null
    or empty texts, and texts of white space only, have no n-gram and are linked with nothing, not even one another. Equal texts
    are linked. Texts are read whole, extra columns are not read, an empty table gives an empty
    result. ``draws`` is the number of sets that each list draws in the second round. A url must not be null, and where it is repeated it has to stand for the
    same text; such rows all stay and get the same component. It may be a struct of an id and a digest of the text.
    """
    pages = in_small_batches(crawled_pages.select("url", "text"))
    counts = corpus_counts(pages, words, count_bits)
    sets = scratch.table(page_sets(pages, counts, words, percent, count_bits, hot_rows), "ngram-sets")

    # Equal sets become one: the smallest url stands for all.
    first = sets.filter("n > 0").groupBy("digest").agg(F.min("url").alias("rep"))
    members = scratch.table(sets.select("url", "n", "digest").join(first, "digest", "left")
                            .select("url", "n", F.coalesce("rep", "url").alias("rep")), "ngram-members")
    sketches = sets.select(F.col("url").alias("rep"), "sketch")

    # Prefix n-grams that more than one page lists, then those that more than one set lists.
    w = W.partitionBy("h", "part")
    postings = sets.select("url", "n", F.posexplode("prefix").alias("i", "p")).select("p.h", "i", "url", "n", "p.part")
    listed = _worth_comparing(postings.repartition("h", "part"), "url", percent)
    listed = listed.join(members.select("url", "rep"), "url").select("h", "i", "rep", "n", "part").repartition("h", "part")
    lists = _worth_comparing(listed.distinct(), "rep", percent)
    lists = scratch.table(lists, "ngram-lists")
    weights = lists.groupBy("rep").agg(F.count(F.lit(1)).alias("weight"))
    lists = scratch.table(lists.join(weights, "rep"), "ngram-weighted")

    links = tested = scratch.settled(members.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0))
    own = F.struct("rep", "component", "n", "i")
    for turn in ("heaviest", "drawn", "all"):
        if turn == "heaviest":
            open_lists = lists.withColumn("component", F.col("rep"))  # no links yet
        else:
            # Each set's link to the smallest of its component stands for all links so far.
            links = scratch.settled(components(links).select(F.col("node").alias("a"), F.col("component").alias("b")))
            where = links.select(F.col("a").alias("rep"), F.col("b").alias("component"))
            open_lists = lists.join(where, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        if turn == "all":
            open_lists = scratch.table(open_lists.select("h", "rep", "n", "i", "component"), "ngram-open")
            # Lists that lie in one component have nothing to add; of the rest, pairs meet whatever part they were dealt to.
            mixed = open_lists.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("h")
            open_lists = scratch.settled(open_lists.join(mixed, "h", "left_semi").select("h", "rep", "n", "i", "component"))
            # Both sides have the same columns, so one shuffle serves both.
            one, two = (open_lists.select(*(F.col(c).alias(f"{c}_{side}") for c in open_lists.columns)) for side in "ab")
            pairs = one.join(two, (F.col("h_a") == F.col("h_b")) & (F.col("rep_a") < F.col("rep_b")) & (F.col("component_a") != F.col("component_b"))
                             & _may_begin(F.col("n_a"), F.col("i_a"), F.col("n_b"), F.col("i_b"), percent))
            pairs = pairs.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), F.col("n_a").alias("na"), F.col("n_b").alias("nb"))
        else:
            open_lists = open_lists.repartition("h", "part")
            if turn == "heaviest":
                chosen = [F.max_by(own, F.struct("weight", "rep")).over(w)]
            else:
                # Sets that the heaviest one did not reach meet others of each of their lists, drawn by hash: other ones in every list.
                chosen = [F.max_by(own, F.struct(F.xxhash64("rep", "h", F.lit(k)), "rep")).over(w) for k in range(draws)]
            pairs = open_lists.withColumn("ps", F.array(*chosen)).withColumn("p", F.explode("ps")).filter(
                (F.col("component") != F.col("p.component")) & _may_begin(F.col("n"), F.col("i"), F.col("p.n"), F.col("p.i"), percent))
            first = F.col("rep") < F.col("p.rep")
            pairs = pairs.select(F.least("rep", "p.rep").alias("a"), F.greatest("rep", "p.rep").alias("b"),
                                 F.when(first, F.col("n")).otherwise(F.col("p.n")).alias("na"), F.when(first, F.col("p.n")).otherwise(F.col("n")).alias("nb"))
        pairs = scratch.settled(_sketch_filter(_distinct(pairs).join(tested, ["a", "b"], "left_anti"), sketches, percent))
        if not pairs.isEmpty():
            links = scratch.settled(links.unionByName(verified(pages, pairs, words, percent)))
            tested = tested.unionByName(pairs)
    where = components(links).select(F.col("node").alias("rep"), "component")
    return members.join(where, "rep", "left").select("url", F.col("n").cast("long").alias("n_shingles"),
                                                    F.coalesce("component", "rep").alias("component"))
