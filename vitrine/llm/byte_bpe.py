"""Byte-level BPE encoding and decoding of page texts.

Encoding runs the tokenizers library on a model made from a rank file: every byte stands for one printable character, every token
for a string of them, and a merge exists for each way to cut a token into two shorter ones, in rank order. Texts are cut first at white
space and between a letter and a mark, which the split pattern never crosses; a worker encodes each distinct piece once and keeps those it met last.
Decoding takes the byte string of each id, so a character split over several tokens comes together again; offsets come from the same byte lengths.
"""
from __future__ import annotations

import base64
import codecs
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from vitrine.llm.columns import hand_back, in_small_batches, per_process, sliced, texts_of, with_columns

#: White space as the split pattern means it (the Unicode property, not Python's wider idea of it).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters in every version of Unicode that knows them, and ASCII marks, which no token holds together with a letter before them.
LETTER, MARK = "A-Za-zÀ-ÖØ-öø-ɏЀ-ҁ", "!-/:-@\\[-`{-~"
#: Letters up to white space, a mark or the end, else a run without white space, either with one space before it; or white space as the split pattern cuts it.
PIECE = re.compile(rf" ?[{LETTER}]+(?=[{SPACE}{MARK}]|\Z)| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Distinct pieces that a worker keeps while it works on a partition: half of them met since it last had so many, and the ones before.
CACHE_PIECES = 150_000
#: New pieces that go to the library as one text, with a line feed between.
JOINED = 1_000


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte: itself if it is printable, else the next one from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task per core
        ranks = read_ranks(path)
        char = byte_characters()
        spell = {token: "".join(map(char.__getitem__, token)) for token in ranks}
        merges = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            ways = [(ranks[token[:i]], ranks[token[i:]], token[:i], token[i:]) for i in range(1, len(token))
                    if token[:i] in ranks and token[i:] in ranks]
            merges += [(spell[a], spell[b]) for _, _, a, b in sorted(ways)]
        self.library = Tokenizer(models.BPE(vocab={spell[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        self.library.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)])
        # The byte table reversed: from the library's token strings back to bytes.
        back = {c: b for b, c in char.items()}
        self.bytes_of = {i: bytes(map(back.__getitem__, s)) for s, i in self.library.get_vocab().items()}
        self.sizes = np.zeros(max(self.bytes_of) + 1, np.int64)
        for i, token in self.bytes_of.items():
            self.sizes[i] = len(token)
        self.width = np.uint16 if len(self.sizes) <= 1 << 16 else np.uint32
        self.feed = self.library.encode("\n").ids
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def forget(self) -> None:
        self.pieces, self.older = {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        if 2 * len(self.pieces) > CACHE_PIECES:
            self.pieces, self.older = {}, self.pieces
        cut = [PIECE.findall(t) for t in texts]
        new = [p for p in set().union(*cut) if p not in self.pieces]
        self.pieces.update((p, self.older[p]) for p in new if p in self.older)
        words = [p for p in new if p not in self.pieces and not p[-1].isspace()]
        lists = [words[i:i + JOINED] for i in range(0, len(words), JOINED)] if len(self.feed) == 1 else []
        for some, found in zip(lists, self.library.encode_batch_fast(["\n".join(x) for x in lists], add_special_tokens=False)):
            # The pattern never takes a line feed together with a word before or after it, so its token tells words apart.
            ids = np.array(found.ids, "<u4")
            ends = [-1, *np.flatnonzero(ids == self.feed[0]).tolist(), len(ids)]
            if len(ends) == len(some) + 1:
                raw, ends = ids.tobytes(), [4 * e for e in ends]
                self.pieces.update((piece, raw[a + 4:b]) for piece, a, b in zip(some, ends, ends[1:]))
        rest = [p for p in new if p not in self.pieces]
        for piece, found in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False)):
            self.pieces[piece] = np.array(found.ids, "<u4").tobytes()
        return [b"".join(map(self.pieces.__getitem__, c)) for c in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, ids: bytes, text: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First and end character of each token; a token that holds part of a character counts as all of it. ``text`` is what the ids decode to, if known."""
        text = self.decode(ids) if text is None else text
        raw = np.frombuffer(text, np.uint8)
        ends = np.cumsum(self.sizes[np.frombuffer(ids, "<u4")])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        if text.isascii():
            return starts, ends
        begun = np.cumsum((raw & 0xC0) != 0x80)  # characters begun up to and including each byte
        return (begun[starts] - 1, begun[ends - 1]) if len(ends) else (starts, ends)


def text_of(chunks: Iterable[bytes]) -> str:
    """Text of byte chunks that may end inside a character."""
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    return "".join([*map(reader.decode, chunks), reader.decode(b"", True)])


def loaded(path: str, pattern: str) -> ByteBpe:
    return per_process(("byte_bpe", path, pattern), lambda: ByteBpe(path, pattern))


def encode_pages(crawled_pages: DataFrame, ranks_path: str, pattern: str, offsets: bool = False) -> DataFrame:
    """``crawled_pages(url, text)`` -> ``(url, ids, n_tokens)``, with ``starts`` and ``ends`` in characters if asked.

    ``ids`` is binary, little-endian unsigned 32-bit. Special strings inside a text are ordinary text. Null and empty texts have no
    ids; texts are encoded whole; repeated rows stay; extra columns are not read; an empty table gives an empty result.
    The rank file must be readable at ``ranks_path`` wherever Python workers run.
    """
    keep = in_small_batches(crawled_pages.select("url", "text"))
    fields = [keep.schema["url"], T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    spans = [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("starts", "ends")] if offsets else []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ranks_path, pattern)
        for batch in sliced(batches):
            texts = texts_of(batch)
            ids = bpe.encode(texts)
            more = {}
            if offsets:
                found = [bpe.offsets(i, t.encode()) for i, t in zip(ids, texts)]
                more = {n: pa.array([f[k].astype(np.int32) for f in found], pa.list_(pa.int32())) for k, n in enumerate(("starts", "ends"))}
            yield with_columns(batch, ["url"], ids=pa.array(ids, pa.binary()), n_tokens=pa.array([len(i) // 4 for i in ids], pa.int64()), **more)
        bpe.forget()
        hand_back()

    return keep.mapInArrow(run, T.StructType(fields + spans))


def decode_pages(encoded_pages: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(url, ids, ...)`` -> all columns and ``decoded``, the text's bytes. Null ids decode to nothing; an id outside the table is an error."""
    schema = T.StructType([*[f for f in encoded_pages.schema.fields if f.name != "decoded"], T.StructField("decoded", T.BinaryType())])
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ranks_path, pattern)
        for batch in sliced(batches):
            yield with_columns(batch, keep, decoded=pa.array([bpe.decode(i or b"") for i in batch.column("ids").to_pylist()], pa.binary()))

    return in_small_batches(encoded_pages).select(*keep).mapInArrow(run, schema)
