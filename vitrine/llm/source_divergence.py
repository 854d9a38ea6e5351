"""How much the sources of each language differ in their words.

1. Inside each task Arrow's own functions count: ``ascii_lower``, ``split_pattern_regex``, ``dictionary_encode`` and hash ``group_by`` give
   occurrences and pages of each term per (language, source). Counts of several batches are merged in the task, so a common word costs a few rows
   per task, and go out when there are too many distinct ones.
2. The shuffle brings the counts of a term together; terms in too few pages of their language end here. What is kept is one columnar table.
3. Its shards, a term whole in one of them, are turned into small dense blocks of terms by sources. Each block gives, per pair of sources, its part of the
   sum of differences, and per source its most telling terms. Both are merged by aggregate and rank.

All arithmetic is in integers. A task knows all (language, source) groups and their totals: the result holds each pair of them, so their number has to be
one for which that is wanted.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vitrine.llm import scratch
from vitrine.llm.columns import in_small_batches

#: What stands between terms, after lower-casing: all of ASCII but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
ONE = 1_000_000_000
ADDED = 5
#: Counts that a task merges before they go out, sorted rows that it looks at together, and cells of a dense block. Results do not depend on them.
MERGE_ROWS, SORTED_ROWS, BLOCK_CELLS = 400_000, 50_000, 500_000
COUNT_SCHEMA = "lang string, source string, term string, n long, pages long"


def _summed(tables: list[pa.Table]) -> pa.Table:
    keys = ["lang", "source", "term"]
    out = pa.concat_tables(tables).group_by(keys).aggregate([("n", "sum"), ("pages", "sum")])
    return out.rename_columns([c.removesuffix("_sum") for c in out.column_names]).select([*keys, "n", "pages"])


def batch_counts(batch: pa.RecordBatch) -> pa.Table:
    """Occurrences and pages of each (lang, source, term) of a batch; each (lang, source) also has a row with the empty term."""
    group = pa.table({k: pc.fill_null(batch.column(k).cast(pa.string()), "") for k in ("lang", "source")})
    parts = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(batch.column("text"), "")), BETWEEN)
    page, term = pc.list_parent_indices(parts), pc.list_flatten(parts)
    real = pc.not_equal(term, "")
    term = pc.dictionary_encode(pc.filter(term, real))
    per_page = (pa.table({"page": pc.filter(page, real), "term": term.indices}).group_by(["page", "term"]).aggregate([([], "count_all")]))
    counted = pa.table({"lang": pc.take(group["lang"], per_page["page"]), "source": pc.take(group["source"], per_page["page"]),
                        "term": pc.take(term.dictionary, per_page["term"]), "n": per_page["count_all"],
                        "pages": pa.array(np.ones(len(per_page), np.int64))})
    nothing = pa.array(np.zeros(len(group), np.int64))
    seen = group.append_column("term", pa.array([""] * len(group), pa.string())).append_column("n", nothing).append_column("pages", nothing)
    return _summed([counted, seen])


def term_counts(crawled_pages: DataFrame) -> DataFrame:
    """Partial counts ``(lang, source, term, n, pages)`` of each task."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch_counts(batch))
            if sum(map(len, waiting)) > MERGE_ROWS:
                waiting = [_summed(waiting)]
                if len(waiting[0]) > MERGE_ROWS // 2:
                    yield from waiting.pop().to_batches(100_000)
        if waiting:
            yield from _summed(waiting).to_batches(100_000)

    return in_small_batches(crawled_pages.select("lang", "source", "text")).mapInArrow(run, COUNT_SCHEMA)


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(ONE * count / total) for count <= total, by long division in steps of 1,000: exact up to totals of 9e15."""
    rest, out = count.astype(np.int64), np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def block_results(lang: str, terms: pa.Array, counts: np.ndarray, groups: dict, top: int) -> list[tuple]:
    """``(lang, source, part, item, value)`` of a block of terms: the sums of differences of each two sources (once, in their order), and the
    ``top`` terms of each source that are more frequent there than in the language."""
    sources, totals, kept = groups["sources"], np.array(groups["totals"], np.int64), groups["kept"]
    p = shares(counts + ADDED, totals + ADDED * kept)
    whole = shares(counts.sum(axis=1) + ADDED, np.int64(totals.sum() + ADDED * kept))
    out = []
    for i, source in enumerate(sources):
        if i + 1 < len(sources):
            sums = np.abs(p[:, i + 1:] - p[:, i:i + 1]).sum(axis=0)
            out += [(lang, source, "pair", other, v) for other, v in zip(sources[i + 1:], sums.tolist())]
        over = p[:, i] - whole
        at = np.flatnonzero((counts[:, i] > 0) & (over > 0))
        found = pa.table({"item": terms.take(pa.array(at)), "value": over[at]})
        best = found.take(pc.sort_indices(found, sort_keys=[("value", "descending"), ("item", "ascending")])[:top])
        out += [(lang, source, "term", t, v) for t, v in zip(best["item"].to_pylist(), best["value"].to_pylist())]
    return out


def _blocks(batches: Iterable[pa.RecordBatch], groups: dict) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """Dense blocks (lang, terms, counts) of rows that come sorted by lang and term. A term is never cut."""
    def dense(lang: str, rows: pa.Table) -> tuple[str, pa.Array, np.ndarray]:
        term = rows["term"].combine_chunks().dictionary_encode()
        place = {s: i for i, s in enumerate(groups[lang]["sources"])}
        counts = np.zeros((len(term.dictionary), len(place)), np.int64)
        counts[term.indices.to_numpy(), [place[s] for s in rows["source"].to_pylist()]] = rows["n"].to_numpy()
        return lang, term.dictionary, counts

    def whole(rows: pa.Table, last: bool) -> Iterator[tuple[str, pa.Array, np.ndarray] | pa.Table]:
        """Blocks of all terms that surely end within ``rows``, then the rows that are left."""
        while rows.num_rows:
            lang, langs, terms = rows["lang"][0].as_py(), rows["lang"], rows["term"]
            changes = pc.or_(pc.not_equal(terms[1:], terms[:-1]), pc.not_equal(langs[1:], langs[:-1])).to_numpy()
            same = int(pc.sum(pc.equal(langs, lang)).as_py())
            ends = np.flatnonzero(changes) + 1
            ends = np.append(ends, rows.num_rows) if last else ends
            ends = ends[ends <= same]  # where terms of this language end
            if not len(ends):
                break
            cut = int(ends[min(max(1, BLOCK_CELLS // len(groups[lang]["sources"])), len(ends)) - 1])
            yield dense(lang, rows.slice(0, cut))
            rows = rows.slice(cut)
        yield rows

    waiting: list[pa.Table] = []
    for batch in batches:
        waiting.append(pa.Table.from_batches([batch]))
        if sum(map(len, waiting)) >= SORTED_ROWS:
            *blocks, rest = whole(pa.concat_tables(waiting).combine_chunks(), last=False)
            yield from blocks
            waiting = [rest]
    if waiting:
        *blocks, _ = whole(pa.concat_tables(waiting).combine_chunks(), last=True)
        yield from blocks


def audit_sources(crawled_pages: DataFrame, min_pages: int = 30, top: int = 50) -> DataFrame:
    """``crawled_pages(text, lang, source)`` -> ``(lang, source, part, item, value, rank)``.

    Terms are runs of letters A-Z, lower-cased, and of characters outside ASCII. A language keeps the terms of at least ``min_pages`` of its pages. A
    term's share is ``1 + floor(1e9 * (count + 5) / (all counts + 5 * kept terms))``. Part ``pair`` names each other source of the language
    with the sum of differences in share over all kept terms (0 without any); part ``term`` the ``top`` terms by which the source's share exceeds that of
    the language. Ranks begin at 1, largest value first, ties by item in byte order.

    Null texts, languages and sources count as empty ones; a source without terms is compared all the same; repeated rows count as often as
    they occur; texts are read whole; extra columns are not read; an empty table gives an empty result.
    """
    spark = crawled_pages.sparkSession
    # One shuffle by term serves the sums, the pages per language and the choice of terms.
    counts = (term_counts(crawled_pages).repartition("lang", "term").groupBy("lang", "term", "source")
              .agg(F.sum("n").alias("n"), F.sum("pages").alias("pages")))
    in_lang = F.sum("pages").over(W.partitionBy("lang", "term"))
    kept = scratch.table(counts.withColumn("in_lang", in_lang).filter((F.col("term") == "") | (F.col("in_lang") >= min_pages))
                         .select("lang", "term", "source", "n"), "divergence-terms")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sizes = kept.filter("term <> ''").groupBy("lang").agg(F.count_distinct("term").alias("kept"))
    groups: dict[str, dict] = {}
    for r in totals.join(sizes, "lang", "left").orderBy("lang", "source").collect():  # one row per group
        of = groups.setdefault(r["lang"], {"sources": [], "totals": [], "kept": r["kept"] or 0})
        of["sources"].append(r["source"])
        of["totals"].append(r["n"])
    shared = spark.sparkContext.broadcast(groups)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, terms, block in _blocks(batches, shared.value):
            rows = block_results(lang, terms, block, shared.value[lang], top)
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 4 + [pa.int64()])],
                                             names=["lang", "source", "part", "item", "value"])

    shards = kept.filter("term <> ''").repartition("lang", "term").sortWithinPartitions("lang", "term")
    found = scratch.table(shards.mapInArrow(run, "lang string, source string, part string, item string, value long"), "divergence-blocks")
    sums = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    either = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    names = totals.select("lang", "source")
    every = names.join(names.select("lang", F.col("source").alias("item")), "lang").filter("source <> item")
    pairs = every.join(either, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item",
                                                                         F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    best = found.filter("part = 'term'").withColumn("rank", rank).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(best)
