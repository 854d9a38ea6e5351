"""Token ids of page texts packed into rows of fixed length, best fit decreasing.

Texts are encoded, and those longer than a row are cut into pieces that together hold every token. Pieces are dealt by hash into shards
of bounded size, and each shard is packed on its own: longest piece first, into the row with the least room that still
takes it. Rows are found by their room in a segment tree over capacities, one descent per piece, however many rows are open. A
shard is one group in one task and its size does not grow with the corpus; the number of shards does.

The result is one record per row of a shard's id matrix: ids padded to the row length, cumulative segment lengths, and where positions
start again from 0. ``write_packed`` puts matrices into files by shard.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.byte_bpe import CACHE_PIECES, JOINED, PIECE, read_ranks
from vitrine.llm.columns import in_small_batches, per_process, sliced, texts_of


class RoomTree:
    """Open rows by the room left in them: a segment tree over 0..capacity that counts the rows below each node."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def _add(self, room: int, n: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += n
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Row with the smallest room of at least ``least``, taken out: ``(row, room)``."""
        node = least + self.leaves
        if not self.count[node]:
            # Up to the first ancestor with something on its right, then down to the leftmost leaf there.
            while node > 1 and not (node % 2 == 0 and self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of indices into ``lengths`` (each 1 to capacity); equal lengths in the order given."""
    tree, rows = RoomTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        found = tree.take(lengths[i])
        row, room = found if found else (len(rows), capacity)
        if not found:
            rows.append([])
        rows[row].append(i)
        tree.put(row, room - lengths[i])
    return rows


class RankEncoder:
    """Ids of texts by the tiktoken library. Texts are cut at white space, which the pattern never crosses, and each distinct piece
    is encoded once; new ones go to the library as one text with line feeds between, whose token tells them apart."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.width = np.uint16 if max(ranks.values()) < (1 << 16) - 1 else np.uint32
        self.feed = ranks[b"\n"]
        self.pieces: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_ordinary(text), self.width)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        cut = [PIECE.findall(t) for t in texts]
        new = {p for c in cut for p in c} - self.pieces.keys()
        words = [p for p in new if not p[-1].isspace()]
        for at in range(0, len(words), JOINED):
            some = words[at:at + JOINED]
            ids = self._ids("\n".join(some))
            ends = [-1, *np.flatnonzero(ids == self.feed).tolist(), len(ids)]
            if len(ends) == len(some) + 1:
                self.pieces.update((piece, ids[a + 1:b].tobytes()) for piece, a, b in zip(some, ends, ends[1:]))
        for piece in new - self.pieces.keys():
            self.pieces[piece] = self._ids(piece).tobytes()
        return [np.frombuffer(b"".join(map(self.pieces.__getitem__, c)), self.width) for c in cut]


def text_pieces(crawled_pages: DataFrame, ranks_path: str, pattern: str, row_tokens: int) -> DataFrame:
    """``(url, piece, n, ids)``: the ids of every text in pieces of at most a row, nothing for a text without tokens."""
    schema = T.StructType([crawled_pages.schema["url"], T.StructField("piece", T.IntegerType()), T.StructField("n", T.IntegerType()),
                           T.StructField("ids", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = per_process(("ranks", ranks_path, pattern), lambda: RankEncoder(ranks_path, pattern))
        for batch in sliced(batches):
            row, piece, n, ids = [], [], [], []
            for i, narrow in enumerate(bpe.encode(texts_of(batch))):
                for k, at in enumerate(range(0, len(narrow), row_tokens)):
                    part = narrow[at:at + row_tokens]
                    row.append(i)
                    piece.append(k)
                    n.append(len(part))
                    ids.append(part.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("url").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                                              pa.array(n, pa.int32()), pa.array(ids, pa.binary())], names=["url", "piece", "n", "ids"])
        bpe.pieces.clear()

    return crawled_pages.select("url", "text").mapInArrow(run, schema)


def pack_pages(crawled_pages: DataFrame, ranks_path: str, pattern: str, row_tokens: int = 2048, pad_id: int = 50256,
               shard_bytes: int = 16 << 20) -> DataFrame:
    """``crawled_pages(url, text)`` -> ``(shard, row, n_tokens, ids, urls, pieces, cu_lengths, position_resets)``.

    ``ids`` is one matrix row, ``row_tokens`` unsigned little-endian integers of 16 bits (32 where the vocabulary needs them), padded with
    ``pad_id``. Segment i is piece ``pieces[i]`` of page ``urls[i]`` and lies between ``cu_lengths[i]`` and ``cu_lengths[i + 1]``; positions start
    again at ``position_resets``. A shard gets about ``shard_bytes`` of text, whatever the size of the corpus.

    Null and empty texts have no tokens and stand in no row. Texts longer than a row are in several pieces without loss. Equal
    lengths are packed in the order of url and piece; repeated rows are packed as often as they occur. Extra columns are not
    read. Empty table: empty result.
    """
    keep = in_small_batches(crawled_pages.select("url", "text"))
    total = keep.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-total // shard_bytes) or 1
    pieces = text_pieces(keep, ranks_path, pattern, row_tokens).withColumn("shard", F.pmod(F.xxhash64("url", "piece"), F.lit(shards)).cast("int"))
    url = keep.schema["url"].dataType
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("row", T.IntegerType()), T.StructField("n_tokens", T.IntegerType()),
                           T.StructField("ids", T.BinaryType()), T.StructField("urls", T.ArrayType(url)), T.StructField("pieces", ints),
                           T.StructField("cu_lengths", ints), T.StructField("position_resets", ints)])

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("url", "ascending"), ("piece", "ascending")])
        lengths, ids = shard.column("n").to_pylist(), shard.column("ids")
        width = len(ids[0].as_py()) // lengths[0]
        pad = pad_id.to_bytes(width, "little")
        rows = best_fit_decreasing(lengths, row_tokens)
        used = [sum(lengths[i] for i in r) for r in rows]
        cuts = [np.cumsum([0, *(lengths[i] for i in r)]).tolist() for r in rows]
        flat = shard.take(pa.array([i for r in rows for i in r], pa.int64()))
        offsets = pa.array(np.cumsum([0, *map(len, rows)]), pa.int32())
        number = shard.column("shard")[0].as_py()

        def lists(name: str) -> pa.Array:
            return pa.ListArray.from_arrays(offsets, flat.column(name).combine_chunks())

        return pa.table({
            "shard": pa.array([number] * len(rows), pa.int32()), "row": pa.array(range(len(rows)), pa.int32()), "n_tokens": pa.array(used, pa.int32()),
            "ids": pa.array([b"".join([*(ids[i].as_py() for i in r), pad * (row_tokens - n)]) for r, n in zip(rows, used)], pa.binary()),
            "urls": lists("url"), "pieces": lists("piece"), "cu_lengths": pa.array(cuts, pa.list_(pa.int32())),
            "position_resets": pa.array([c[:-1] for c in cuts], pa.list_(pa.int32()))})

    return pieces.groupBy("shard").applyInArrow(run, schema)


def write_packed(packed: DataFrame, path: str) -> None:
    """One folder of files per shard, rows in order: the ids of a shard, read in turn, are its matrix."""
    packed.repartition("shard").sortWithinPartitions("shard", "row").write.partitionBy("shard").parquet(path)
