from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from tests.llm.texts import ODD, no_pages, odd_pages
from vitrine.llm import byte_bpe, packing, token_counts

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b ", " ", "  ", "the", "漢", "\n", "é", "😀", "▁", "<0xE2>", "loweit", "x" * 30, " q", "'s", "12", "²", "\x1c", "\x85", "ا", "<|endoftext|>", "<s>"]


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe(RANKS, PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def mixed(n, most):
    r = random.Random(8)
    return ["".join(r.choice(PARTS) for _ in range(r.randrange(most))) for _ in range(n)]


def test_encode_as_tiktoken(bpe, reference):
    texts = mixed(500, 40) + [t or "" for t in ODD]
    for text, ids in zip(texts, bpe.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_packing_encodes_as_tiktoken(reference):
    encoder = packing.RankEncoder(RANKS, PATTERN)
    texts = mixed(500, 40) + [t or "" for t in ODD]
    assert [x.tolist() for x in encoder.encode(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_offsets_and_split_characters(bpe):
    for text in mixed(200, 20):
        ids = bpe.encode([text])[0]
        starts, ends = bpe.offsets(ids)
        tokens = [bpe.bytes_of[i] for i in np.frombuffer(ids, "<u4").tolist()]
        assert all(t in text[a:b].encode() for t, a, b in zip(tokens, starts.tolist(), ends.tolist()))
        assert byte_bpe.text_of(tokens) == text
    assert byte_bpe.text_of([b"\xf0\x9f", b"\x98\x80"]) == "😀"


def test_encoded_pages(spark, reference):
    encoded = byte_bpe.encode_pages(odd_pages(spark), RANKS, PATTERN, offsets=True)
    got = byte_bpe.decode_pages(encoded, RANKS, PATTERN).collect()
    assert len(got) == len(ODD) + 1
    for r in got:
        text = ODD[r["url"]] or ""
        assert bytes(r["decoded"]).decode() == text and r["n_tokens"] == len(reference.encode_ordinary(text)) == len(r["starts"]) == len(r["ends"])
    assert byte_bpe.decode_pages(byte_bpe.encode_pages(no_pages(spark), RANKS, PATTERN), RANKS, PATTERN).count() == 0


@pytest.mark.parametrize("chunk, overlap", [(20, 4), (50, 16), (200, 8)])
def test_counts_of_chunked_texts(chunk, overlap):
    counter = token_counts.Counter(MODEL, chunk, overlap)
    assert counter.stable
    texts = mixed(120, 300)
    assert counter.count(texts) == [len(x) for x in counter.model.encode(texts)]


def test_counted_pages(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = token_counts.count_tokens(odd_pages(spark), MODEL, 500, 16).collect()
    assert len(got) == len(ODD) + 1
    for r in got:
        text = ODD[r["url"]] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(model.encode(text)))
    assert token_counts.count_tokens(no_pages(spark), MODEL).count() == 0


def test_best_fit_decreasing():
    r = random.Random(1)
    for _ in range(100):
        capacity = r.choice([1, 7, 64, 100])
        lengths = [r.randint(1, capacity) for _ in range(r.randrange(60))]
        rows, slow = packing.best_fit_decreasing(lengths, capacity), []
        for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
            room = [(capacity - sum(lengths[j] for j in x), k) for k, x in enumerate(slow)]
            fit = min((x for x in room if x[0] >= lengths[i]), default=None)
            slow[fit[1]].append(i) if fit else slow.append([i])
        assert sorted(i for row in rows for i in row) == list(range(len(lengths)))
        assert sorted(sum(lengths[i] for i in row) for row in rows) == sorted(sum(lengths[i] for i in row) for row in slow)


def test_packed_pages_hold_every_token(spark, reference, tmp_path):
    packed = packing.pack_pages(odd_pages(spark), RANKS, PATTERN, row_tokens=64, shard_bytes=20_000)
    packing.write_packed(packed, str(tmp_path / "packed"))
    rows = spark.read.parquet(str(tmp_path / "packed")).collect()
    assert len({r["shard"] for r in rows}) > 1
    pieces: dict = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u2")
        assert len(ids) == 64 and r["cu_lengths"][0] == 0 and r["cu_lengths"][-1] == r["n_tokens"] and (ids[r["n_tokens"]:] == 50256).all()
        assert r["position_resets"] == r["cu_lengths"][:-1]
        for url, piece, a, b in zip(r["urls"], r["pieces"], r["cu_lengths"], r["cu_lengths"][1:]):
            pieces.setdefault(url, []).append((piece, ids[a:b].tolist()))
    for url, text in enumerate(ODD):
        whole = reference.encode_ordinary(text or "") * (2 if url == 6 else 1)
        assert [i for _, ids in sorted(pieces.get(url, [])) for i in ids] == whole, url
    assert packing.pack_pages(no_pages(spark), RANKS, PATTERN).agg(F.count("*")).first()[0] == 0


def test_a_word_is_learnt_once_whatever_mark_follows(reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", 6)
    bpe, asked = byte_bpe.ByteBpe(RANKS, PATTERN), []

    class Watched:
        def __init__(self, library):
            self.library = library

        def encode_batch_fast(self, texts, **more):
            asked.extend(w for t in texts for w in t.split("\n"))
            return self.library.encode_batch_fast(texts, **more)
    bpe.library = Watched(bpe.library)
    for text in [" word, word. word! word's", *(f" word a{'bcdefghi'[i]} x{'bcdefghi'[i]}" for i in range(8)), " déjà-vu; 2nd's 'tis a,b(c) x'll"]:
        assert np.frombuffer(bpe.encode([text])[0], "<u4").tolist() == reference.encode_ordinary(text)
    assert asked.count(" word") == 1 and not [w for w in asked if w.startswith(" word") and w != " word"]


def test_offsets_with_the_text_at_hand(bpe):
    for text in mixed(100, 20) + ["plain words, 12"]:
        ids = bpe.encode([text])[0]
        assert [x.tolist() for x in bpe.offsets(ids, text.encode())] == [x.tolist() for x in bpe.offsets(ids)]
