"""The pipeline stage by stage on a small table, and the registered queries with SQL."""
from __future__ import annotations

import hashlib
import os
import zlib

import public_tokenizers
import pytest
import sentencepiece
import tiktoken

import corpus_pipeline
from tests.llm.test_ngram_join import brute
from tests.llm.texts import invented
from tests.oracle import compare, connect
from vitrine.llm import byte_bpe, queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages(spark, tmp_path):
    item = invented(77, 30)
    near = invented(5, 60)
    texts = [invented(1, 50), invented(2, 50), invented(1, 50).upper(), near, near + " more", "42 !!", None, "", invented(6, 40) + ". " + item, invented(8, 3)]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, now = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "tokens":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = sorted(r["doc_id"] for r in now.collect())
    assert kept["language"] == [0, 1, 2, 3, 4, 8, 9]
    assert kept["exact_copies"] == [1, 2, 3, 4, 8, 9]
    rest = [(i, texts[i]) for i in kept["exact_copies"]]
    assert kept["near_copies"] == [u for u, _, c in brute(rest) if u == c] == [1, 2, 3, 8, 9]
    assert kept["decontamination"] == kept["tokens"] == [1, 2, 3, 9]
    for r in now.collect():
        assert r["round_trip"] and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() and len(r["ids"]) == 4 * r["n_tokens"]
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [1, 2, 3, 9]


def stage(spark, folder, name, rows):
    """Rows (doc_id, text) that a stage keeps."""
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
    assert out.columns == docs.columns
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)


def test_repeated_and_null_ids_in_each_stage(spark, tmp_path):
    item, t, u, v = invented(77, 30), invented(5, 60), invented(6, 60), invented(7, 60)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows, near = [(1, t), (1, t), (2, u), (2, t), (None, u), (None, u), (None, v), (3, None), (3, "")], t + " more"
    assert stage(spark, str(tmp_path), "language", rows) == sorted(((i, x) for i, x in rows if x), key=str)
    assert stage(spark, str(tmp_path), "exact_copies", rows) == sorted([(2, u), (2, t), (None, v), (3, "")], key=str)
    assert stage(spark, str(tmp_path), "near_copies", [*rows, (2, near)]) == sorted([(1, t), (None, u), (None, v), (3, None), (3, "")], key=str)
    bad = item + " " + t
    assert stage(spark, str(tmp_path), "decontamination", [(1, t), (1, bad), (None, bad), (None, u), (None, u), (4, None)]) == sorted(
        [(1, t), (None, u), (None, u), (4, None)], key=str)
    tokens = dict(corpus_pipeline.STAGES)["tokens"](spark, spark.createDataFrame(
        [(i, x, "en", "s", 0) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long"), str(tmp_path))
    assert sorted(map(str, (r["doc_id"] for r in tokens.collect()))) == sorted(str(i) for i, _ in rows)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query(spark, name):
    problem, _ = compare(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.ORACLES[name])
    assert problem is None


def crc(key, n):
    return zlib.crc32(str(key).encode()) % n


@pytest.fixture(scope="module")
def documents(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.mark.parametrize("name, modulus, rest, limit", [("op2_toxic_neighbours", 4, 2, 0.3), ("op10_pairwise_quality", 3, 1, 0.5)])
def test_scoring_queries(spark, documents, name, modulus, rest, limit):
    rows = queries.QUERIES[name](spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    labels = {r["doc_id"]: r["toxic" if name.startswith("op2") else "quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    for r in rows:
        assert r["held_out"] == (crc(r["doc_id"], modulus) == rest) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= limit)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert sum(p == y for p, y in held) >= 0.8 * len(held)


def test_language_query(spark, documents):
    rows = queries.QUERIES["op4_language_backoff"](spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    for r in rows:
        text = documents[r["doc_id"]]["text"] or ""
        assert r["held_out"] == (crc(r["doc_id"], 4) == 2) and (r["lang_pred"] == "und") == (not any(c.isalpha() for c in text)) and 0 <= r["score"] <= 1
    known = [(r["lang_pred"], documents[r["doc_id"]]["lang"]) for r in rows if r["held_out"] and r["lang_pred"] != "und" and documents[r["doc_id"]]["lang"]]
    assert sum(p == y for p, y in known) >= 0.95 * len(known)


def test_token_queries(spark, documents):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in queries.QUERIES["op5_resync_token_counts"](spark, FOLDER).collect():
        text = documents[r["doc_id"]]["text"] or ""
        n = len(library.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 4096)
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.QUERIES["op6_byte_bpe"](spark, FOLDER).collect():
        text = documents[r["doc_id"]]["text"] or ""
        ids = reference.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_near_copies_query(spark, documents):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op8_ngram_join"](spark, FOLDER).collect())
    assert got == brute([(u, r["text"]) for u, r in documents.items()])


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_tokens_keep_one_python_worker_a_task(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two", "en", "s", 7), (2, None, None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)["tokens"](spark, docs, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert [(r["doc_id"], r["round_trip"]) for r in out.orderBy("doc_id").collect()] == [(1, True), (2, True)]
