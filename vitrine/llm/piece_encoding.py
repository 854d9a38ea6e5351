"""SentencePiece encoding and decoding of page texts, exact for models of merge type, by backtracking instead of merging.

Merging joins the best pair of neighbours again and again. Its result is the only cut of a text into tokens in which each
pair of neighbours is compatible: merged on its own, the pair's text gives just these two tokens. So a text is read from the left:
an Aho-Corasick automaton of all tokens gives the longest one at each place, and if that one is not compatible with the token before,
its next shorter prefix is tried. Where none is left, the token before is taken back and its place is marked in a bit field, so that no place
fails twice and the work stays in proportion to the text. Compatible pairs are found by merging their text once and are kept.

* Tokens that their own merging does not give (they can never come out) are left out of the automaton.
* That argument needs a strict order of merges. Where tokens of equal score occur (runs of spaces in many models), the piece of text is merged
  as a whole by score and place.
* A character without a token of its own never merges; its UTF-8 bytes are byte tokens, or it is the unknown token if the model has none.
* The library normalises texts. They are then cut where no token of the model can cross: before spaces, after words, at characters without a
  token; a worker encodes each distinct short piece once and keeps it.
"""
from __future__ import annotations

import heapq
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vitrine.llm.columns import in_small_batches, per_process, sliced, texts_of, with_columns

SPACE = "▁"
#: Distinct pieces that a worker keeps, and how long they may be; compatible pairs that it keeps.
CACHE_PIECES, PIECE_LETTERS, CACHE_PAIRS = 350_000, 64, 400_000


class PieceEncoder:
    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, every = self.library, range(self.library.get_piece_size())
        plain = [i for i in every if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in plain}
        self.bytes = {int(lib.id_to_piece(i)[1:-1], 16): i for i in every if lib.is_byte(i)}
        shared = Counter(v for p, v in self.score.items() if len(p) > 1)
        tied = [p for p, v in self.score.items() if len(p) > 1 and shared[v] > 1]
        #: Tokens of equal score; those that hold another one need no look of their own.
        self.tied = [p for p in tied if not any(q != p and q in p for q in tied)]
        self.tokens = ahocorasick.Automaton()
        #: Text and length of each token that can come out, by id.
        self.text = {i: p for p, i in self.ids.items() if any(q in p for q in self.tied) or self.merged(p) == [p]}
        self.size = {i: len(p) for i, p in self.text.items()}
        self.sizes = np.array([self.size.get(i, 0) for i in every], np.int64)
        for i, piece in self.text.items():
            self.tokens.add_word(piece, i)
        self.tokens.make_automaton()
        #: The next shorter token that each token begins with.
        self.shorter = {i: next((j for k in range(len(p) - 1, 0, -1) if (j := self.ids.get(p[:k])) in self.text), None) for i, p in self.text.items()}
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cut = self._cut()

    def _cut(self) -> re.Pattern:
        """Pieces that no token can join: no token crosses from a letter to what follows a piece, nor from there to a space."""
        follow = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in self.ids)
        alone = f"[{alone}]" if alone else "(?!)"
        if any(a != SPACE and b == SPACE for a, b in follow):
            return re.compile(f"{alone}+|(?:(?!{alone}).)+", re.S)
        is_letter, more = re.compile("[^\\W\\d_]").match, set()
        while found := {b for a, b in follow if (is_letter(a) or a in more) and not (is_letter(b) or b in more)}:
            more |= found
        if more:
            letter = "(?:[^\\W\\d_]|[" + "".join(map(re.escape, sorted(more))) + "])"
            other = f"(?!{alone}|{letter})[^{SPACE}]"
        else:  # the same in plain classes
            letter, other = "[^\\W\\d_]", f"(?:[^\\w{SPACE}{alone[1:-1] if alone[0] == '[' else ''}]|[\\d_])"
        return re.compile(f"{SPACE}*(?:{letter}+|(?:{other})+{letter}*)|{SPACE}+|{alone}+")

    def merged(self, text: str) -> list[str]:
        """Tokens of ``text`` as merging gives them: best score first, then leftmost. Characters without a token stay as they are."""
        parts: list[str] = list(text)
        if len(parts) > 32:
            return self._merged_long(parts)
        score = self.score.get
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = score(parts[i] + parts[i + 1])
                if found is not None and (best is None or found > best):
                    best, at = found, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _merged_long(self, parts: list[str]) -> list[str]:
        """The same with a heap of pairs."""
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (score := self.score.get(both := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-score, i, j, both))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if after[i] != j or parts[i] + parts[j] != both:
                continue  # one of the two is part of another token by now
            parts[i], parts[j] = both, ""
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            after[j] = -1
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p]

    def compatible(self, a: int, b: int) -> bool:
        """Does merging the text of both give just these two tokens?"""
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            left, right = self.text[a], self.text[b]
            found = self.pairs[key] = self.merged(left + right) == [left, right]
        return found

    def ids_of(self, text: str) -> list[int] | None:
        """Ids of a text, None if it holds a character without a token."""
        for several in self.tied:
            if several in text:
                return [self.ids[t] for t in self.merged(text)] if self.ids.keys() >= set(text) else None
        # As long as each longest token fits the one before, one pass of the automaton gives them all.
        out = [i for _, i in self.tokens.iter_long(text)]
        if sum(map(self.size.__getitem__, out)) < len(text):
            return None
        known = self.pairs.get
        for fit in range(1, len(out)):
            if not (known(out[fit - 1] << 32 | out[fit]) or self.compatible(out[fit - 1], out[fit])):
                return self._backtracked(text, out[:fit], out[fit])
        return out

    def _backtracked(self, text: str, out: list[int], token: int) -> list[int]:
        """The ids of a text of which ``out`` are the first so far and ``token`` is the longest one next."""
        sizes, known, shorter, longest = self.size, self.pairs.get, self.shorter, self.tokens.iter_long
        at, size, trial = sum(map(sizes.__getitem__, out)), len(text), token
        failed = bytearray(size // 8 + 1)  # one bit a place: nothing fits from there on
        while at < size:
            before = out[-1] << 32 if out else -1
            while trial is not None:
                end = at + sizes[trial]
                if not failed[end >> 3] >> (end & 7) & 1:
                    if before < 0:
                        break
                    fits = known(before | trial)
                    if fits is None:
                        fits = self.compatible(before >> 32, trial)
                    if fits:
                        break
                trial = shorter[trial]
            if trial is not None:
                out.append(trial)
                at = end
                if at < size:
                    _, trial = next(longest(text, at))
            else:
                failed[at >> 3] |= 1 << (at & 7)
                trial = out.pop()
                at -= sizes[trial]
        return out

    def _encode(self, piece: str) -> bytes:
        if (whole := self.ids_of(piece)) is not None:
            return array("i", whole).tobytes()
        ids: list[int] = []
        run = 0
        for i in range(len(piece) + 1):
            if i == len(piece) or piece[i] not in self.ids:
                if run < i:
                    ids += self.ids_of(piece[run:i])
                if i < len(piece):
                    ids += [self.bytes[b] for b in piece[i].encode()] if self.bytes else [self.library.unk_id()]
                run = i + 1
        return array("i", ids).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces together: one pass of the automaton over all of them, pairs looked at once. Those that the longest tokens do not fit,
        and those of other kinds, go one by one."""
        gap = next((chr(c) for c in range(128) if chr(c) not in self.ids), None)
        plain = [p for p in pieces if not any(t in p for t in self.tied)] if gap else []
        found = np.array(list(self.tokens.iter_long(gap.join(plain))) if plain else [], np.int64).reshape(-1, 2)
        ends, ids = found[:, 0], found[:, 1]
        size = self.sizes[ids]
        long = np.fromiter(map(len, plain), np.int64, len(plain))
        begins = np.cumsum(long + 1) - long - 1
        of = np.searchsorted(begins, ends - size + 1, "right") - 1  # the piece each token belongs to
        pairs, at = np.unique((ids[:-1] << 32 | ids[1:])[of[:-1] == of[1:]], return_inverse=True)
        fits = np.fromiter((self.compatible(k >> 32, k & 0xFFFFFFFF) for k in pairs.tolist()), bool, len(pairs))
        good = np.bincount(of, weights=size, minlength=len(plain)) == long
        misfit = np.flatnonzero(of[:-1] == of[1:])[~fits[at]]  # tokens that do not fit the next one
        edges = np.searchsorted(of, np.arange(len(plain) + 1))
        whole, flat, done = ids.astype(np.int32).tobytes(), ids.tolist(), {}
        # The first misfit of each piece, the number of tokens if there is none.
        first = edges[1:].copy()
        np.minimum.at(first, of[misfit], misfit + 1)
        for piece, ok, a, b, fit in zip(plain, good.tolist(), edges[:-1].tolist(), edges[1:].tolist(), first.tolist()):
            if ok:
                done[piece] = whole[4 * a:4 * b] if fit == b else array("i", self._backtracked(piece, flat[a:fit], flat[fit])).tobytes()
        self.pieces.update(done)
        for piece in pieces:
            if piece not in done:
                self.pieces[piece] = self._encode(piece)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as 32-bit integers in the machine's byte order."""
        if len(self.pieces) > CACHE_PIECES:
            self.older, self.pieces = self.pieces, {}  # what was not asked for since goes with the next exchange
        cut = [self.cut.findall(self.library.normalize(text)) if text else [] for text in texts]
        new = set().union(*cut).difference(self.pieces)
        for piece in new & self.older.keys():
            self.pieces[piece] = self.older[piece]
        self._learn([p for p in new if p not in self.pieces])
        out = [b"".join(map(self.pieces.__getitem__, c)) for c in cut]
        for piece in new:
            if len(piece) > PIECE_LETTERS:
                del self.pieces[piece]
        return out


class PieceDecoder:
    """Texts of ids: the bytes of all tokens of a batch are taken from one table, so that a text is a stretch of them."""

    def __init__(self, path: str):
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(lib.get_piece_size())
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) for i in every]
        self.special = np.array(special)
        self.table = pa.array([bytes([int(lib.id_to_piece(i)[1:-1], 16)]) if lib.is_byte(i) else lib.id_to_piece(i).replace(SPACE, " ").encode()
                               for i in every], pa.binary())
        self.begins = np.array([not lib.is_byte(i) and lib.id_to_piece(i).startswith(SPACE) for i in every])

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Text ``i`` has the ids from ``ends[i]`` to ``ends[i + 1]``."""
        taken = self.table.take(pa.array(ids))
        offsets = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset:taken.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        data = taken.buffers()[2].to_pybytes() if len(ids) and taken.buffers()[2] is not None else b""
        odd = np.concatenate([[0], np.cumsum(self.special[ids])])
        out = []
        for a, b in zip(ends.tolist(), ends[1:].tolist()):
            try:
                if odd[b] > odd[a]:
                    raise UnicodeError
                # Encoding puts a space in front of a text; it is part of the first token or a token of its own.
                out.append(data[offsets[a] + bool(b > a and self.begins[ids[a]]):offsets[b]].decode())
            except UnicodeError:  # control tokens and bytes that make no character are the library's business
                out.append(self.library.decode(ids[a:b].tolist()))
        return out


def loaded(path: str) -> PieceEncoder:
    return per_process(("piece_encoding", path), lambda: PieceEncoder(path))


def encode_pages(crawled_pages: DataFrame, model_path: str) -> DataFrame:
    """``crawled_pages(url, text)`` -> ``(url, ids, n_tokens)``, ids an array of int, without begin or end ids.

    Strings of control tokens inside a text are ordinary text, as the library has it. Null and empty texts have no ids, texts are encoded whole
    whatever their length, repeated rows stay and get the same ids, extra columns are not read, an empty table gives an empty result.
    The model (merge type, without user-defined symbols) must be readable at ``model_path`` wherever Python workers run.
    """
    keep = in_small_batches(crawled_pages.select("url", "text"))
    schema = T.StructType([keep.schema["url"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(model_path)
        for batch in sliced(batches):
            found = encoder.encode(texts_of(batch))
            sizes = [len(f) // 4 for f in found]
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32)))
            yield with_columns(batch, ["url"], ids=ids, n_tokens=pa.array(sizes, pa.int64()))

    return keep.mapInArrow(run, schema)


def decode_pages(encoded_pages: DataFrame, model_path: str) -> DataFrame:
    """``(url, ids, ...)`` -> all columns and ``decoded``, the text that the library makes of the ids; null ids decode to the empty text.

    Byte tokens become characters again where they make whole ones, the leading space that encoding adds is taken away. An id outside the
    model is an error.
    """
    schema = T.StructType([*[f for f in encoded_pages.schema.fields if f.name != "decoded"], T.StructField("decoded", T.StringType())])
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = per_process(("piece_decoding", model_path), lambda: PieceDecoder(model_path))
        for batch in sliced(batches):
            lists = batch.column("ids")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            decoded = decoder.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.cumsum([0, *sizes.tolist()]))
            yield with_columns(batch, keep, decoded=pa.array(decoded, pa.string()))

    return in_small_batches(encoded_pages).select(*keep).mapInArrow(run, schema)
