"""Token counts of page texts, huge ones included, by resynchronising overlapping chunks.

A text up to ``chunk_chars`` is encoded at once. A longer one is encoded in chunks that overlap, with the offset of every
token. Two neighbours are joined at a stable boundary: a place in the overlap where a space follows another character, where
both encodings begin a token, and where they agree on that token. No piece of the vocabulary holds a space after another
character (checked when the model is loaded), so no merge crosses such a place and what lies on either side is encoded the
same in any context: the joined count is that of the whole text. If an overlap has no such place, the overlap is widened, in the last
resort until the chunk reaches the end of the text.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vitrine.llm.columns import in_small_batches, per_process, sliced, texts_of, with_columns

MARK = "▁"


class Counter:
    """``stable`` says whether the model allows joins at spaces; without that, long texts are encoded at once."""

    def __init__(self, model_path: str, chunk_chars: int, overlap_chars: int):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.chunk, self.overlap = chunk_chars, overlap_chars
        ids = range(self.model.get_piece_size())
        pieces = list(map(self.model.id_to_piece, ids))
        # Characters of each token; of those that stand for one byte, the first byte of a character counts for it.
        self.length = np.array([int(int(p[3:5], 16) & 0xC0 != 0x80) if self.model.is_byte(i) else len(p) for i, p in zip(ids, pieces)])
        # Spaces must stay where they are, one mark each, after a mark set before the text; unknown characters must become bytes.
        probe = self.model.encode("a  b \u0378")
        self.stable = not any(MARK in p.lstrip(MARK) for p in pieces) and int(self.length[probe].sum()) == len("a  b \u0378") + 1 \
            and any(map(self.model.is_byte, probe))

    def count(self, texts: list[str]) -> list[int]:
        short = [len(t) <= self.chunk or not self.stable for t in texts]
        whole = iter(self.model.encode([t for t, s in zip(texts, short) if s], num_threads=1))
        return [len(next(whole)) if s else self.count_long(t) for t, s in zip(texts, short)]

    def encoded(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Of every token of a chunk, the character at which it ends, and its id."""
        ids = np.array(self.model.encode(text[start:end], num_threads=1), np.int64)
        return np.cumsum(self.length[ids]) - 1 + start, ids

    @staticmethod
    def join(text: str, left: tuple, right: tuple, start: int, end: int) -> int | None:
        """A stable boundary inside the overlap ``start``..``end``, the one nearest to its middle."""
        common = np.intersect1d(left[0], right[0])
        common = common[(common > start) & (common < end)]
        for b in common[np.argsort(np.abs(common - (start + end) // 2), kind="stable")].tolist():
            if text[b] == " " and text[b - 1] != " ":
                i, j = (np.searchsorted(x[0], b, "right") for x in (left, right))
                # The token after the boundary may be cut by the end of the left chunk; the one before it is whole on both sides.
                if left[0][i] == right[0][j] and left[1][i] == right[1][j] or left[0][i] == end:
                    return b
        return None

    def count_long(self, text: str) -> int:
        total, since, start, end = 0, 0, 0, self.chunk
        left = self.encoded(text, start, end)
        while end < len(text):
            overlap, b = self.overlap, None
            while b is None and end < len(text):
                at = max(since, end - overlap)
                to = min(len(text), at + max(self.chunk, 2 * overlap))
                right = self.encoded(text, at, to)
                b = self.join(text, left, right, at, end)
                if b is None and at > since:
                    overlap *= 2
                elif b is None:
                    # Nothing to join at in the whole chunk: encode from its start again, twice as far.
                    end = min(len(text), start + 2 * (end - start))
                    left, overlap = self.encoded(text, start, end), self.overlap
            if b is not None:
                total += self.between(left, since, b)
                left, start, since, end = right, at, b, to
        return total + self.between(left, since, end)

    @staticmethod
    def between(chunk: tuple, since: int, to: int) -> int:
        """Tokens from ``since`` (all of them at the start of the text) to ``to``."""
        return int(np.searchsorted(chunk[0], to, "right") - (np.searchsorted(chunk[0], since, "right") if since else 0))


def count_tokens(crawled_pages: DataFrame, model_path: str, chunk_chars: int = 20_000, overlap_chars: int = 256) -> DataFrame:
    """``crawled_pages(url, text)`` -> ``(url, n_bytes, n_tokens)``, one row per input row.

    Counts are those of the sentencepiece model for the whole text without begin or end marks. Null and empty texts count 0.
    Repeated rows stay, extra columns are not read, an empty table gives an empty result. The model must be readable
    at ``model_path`` wherever Python workers run.
    """
    keep = in_small_batches(crawled_pages.select("url", "text"))
    schema = T.StructType([keep.schema["url"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = per_process(("pieces", model_path, chunk_chars, overlap_chars), lambda: Counter(model_path, chunk_chars, overlap_chars))
        for batch in sliced(batches):
            texts = texts_of(batch)
            yield with_columns(batch, ["url"], n_bytes=pa.array([len(t.encode()) for t in texts], pa.int64()),
                               n_tokens=pa.array(counter.count(texts), pa.int64()))

    return keep.mapInArrow(run, schema)
