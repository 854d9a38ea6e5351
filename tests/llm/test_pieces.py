"""Encoding by backtracking against the library, on odd texts, random joins of tokens and a whole table."""
from __future__ import annotations

import hashlib
import os
import random

import public_tokenizers
import pytest
import sentencepiece

from tests.llm.texts import ODD, no_pages, odd_pages
from vitrine.llm import piece_encoding, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def encoder():
    return piece_encoding.PieceEncoder(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids(encoder, texts):
    return [memoryview(x).cast("i").tolist() for x in encoder.encode(texts)]


def test_joined_tokens_and_letters(encoder, library):
    r = random.Random(3)
    tokens = [t.replace("▁", " ") for t in encoder.ids]
    letters = "aehinorst ▁▁  \n\t.,-0123é²中あ　\x00😀"
    texts = ["".join(r.choice(tokens) for _ in range(r.randrange(20))) for _ in range(1500)]
    texts += ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(3000)]
    assert ids(encoder, texts) == library.encode(texts)


def test_runs_control_strings_and_long_texts(encoder, library):
    texts = [" " * k + w for k in range(40) for w in ("", "a", "1", "\n", "the", ".", "中")]
    texts += ["▁" * 33, "<s> </s> <unk> <0x0A>", "ab" * 20000, "a" * 30000, " " * 30000, "中文字" * 5000, *(t or "" for t in ODD)]
    assert ids(encoder, texts) == library.encode(texts)


def test_backtracking_takes_tokens_back(encoder):
    """Words whose longest tokens from the left are not what merging gives; merged whole they must come out the same."""
    r = random.Random(4)
    words = ["".join(r.choice("etaonrishl") for _ in range(12)) for _ in range(2000)]
    greedy = 0
    for w in words:
        longest, at = [], 0
        while at < len(w):
            longest.append(next(w[at:k] for k in range(len(w), at, -1) if w[at:k] in encoder.ids))
            at += len(longest[-1])
        found = [encoder.text[i] for i in encoder.ids_of(w)]
        assert found == encoder.merged(w) == encoder._merged_long(list(w))
        greedy += found == longest
    assert 0 < greedy < len(words)


def test_pages(spark, library):
    got = piece_encoding.decode_pages(piece_encoding.encode_pages(odd_pages(spark), MODEL), MODEL).orderBy("url").collect()
    texts = sorted([*enumerate(ODD), (6, "same text here")], key=lambda x: x[0])
    assert [(r["url"], r["ids"], r["n_tokens"], r["decoded"]) for r in got] == [
        (u, x := library.encode(t or ""), len(x), library.decode(x) if x else "") for u, t in texts]
    assert piece_encoding.encode_pages(no_pages(spark), MODEL).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.QUERIES["op13_piece_encoding"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        x = library.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(x) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((library.decode(x) if x else "").encode()).hexdigest()
