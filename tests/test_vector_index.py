"""The index must give what a comparison with all pictures gives, and say how much it compared."""
import numpy as np
import pytest

from vitrine.operators import vector_index


def unit(m):
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length == 0, 1, length)


def table(spark, rows, start=0):
    return spark.createDataFrame([(start + i, f"p{i % 9}", None if v is None else [float(x) for x in v]) for i, v in enumerate(rows)], "id long, p string, v array<double>").repartition(3)


def search(spark, folder, queries, k):
    qs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(queries)], "id long, v array<double>")
    near, work = vector_index.indexed_nearest(spark, folder, qs, "id", "v", k)
    found = {}
    for r in near.collect():
        found.setdefault(r["query_id"], []).append((r["distance"], r["image_id"]))
    return {q: [i for _, i in sorted(rows)] for q, rows in found.items()}, {r["query_id"]: (r["compared"], r["pictures"]) for r in work.collect()}


def brute(images, queries, k):
    d = np.round(1 - unit(np.round(unit(queries), 6)) @ unit(images).T, 9)
    return {q: [int(i) for i in np.lexsort((np.arange(len(images)), d[q]))[:k]] for q in range(len(queries))}


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_same_rows_as_all_pictures(spark, tmp_path, spread):
    rng = np.random.default_rng(4)
    homes = rng.normal(size=(12, 8))
    images = homes[rng.integers(0, 12, 500)] + spread * rng.normal(size=(500, 8))
    images[100:230] = images[100]  # copies
    images[7] = images[300] = 0  # no direction
    queries = np.vstack([homes[:4] + 0.01, rng.normal(size=(3, 8)), np.zeros((1, 8)), -homes[:1]])
    vector_index.build_index(table(spark, [*images[:400], None]), "id", "v", "p", f"{tmp_path}/a", sample=150)
    vector_index.add_images(table(spark, images[401:], 401), "id", "v", "p", f"{tmp_path}/a")
    have = np.vstack([images[:400], images[401:]])
    ids = [*range(400), *range(401, 500)]
    for k in (1, 20, 150):
        want = {q: [ids[i] for i in found] for q, found in brute(have, queries, k).items()}
        got, work = search(spark, f"{tmp_path}/a", queries, k)
        assert got == want
        assert all(n == 499 and k <= c <= n for c, n in work.values())
    if spread < 1:
        _, work = search(spark, f"{tmp_path}/a", queries[:4], 5)
        assert max(c for c, _ in work.values()) < 499 / 2


def test_large_clusters_are_cut_and_few_pictures_suffice(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 10)
    rng = np.random.default_rng(5)
    images, queries = rng.normal(size=(60, 4)), rng.normal(size=(3, 4))
    vector_index.build_index(table(spark, images), "id", "v", "p", f"{tmp_path}/b", clusters=2)
    got, _ = search(spark, f"{tmp_path}/b", queries, 100)
    assert got == brute(images, queries, 100) and all(len(v) == 60 for v in got.values())


def test_no_pictures(spark, tmp_path):
    vector_index.build_index(table(spark, [None, None]), "id", "v", "p", f"{tmp_path}/c")
    assert search(spark, f"{tmp_path}/c", np.ones((2, 3)), 5) == ({}, {})
    vector_index.build_index(table(spark, [np.zeros(3)] * 4), "id", "v", "p", f"{tmp_path}/d")
    assert search(spark, f"{tmp_path}/d", np.ones((1, 3)), 2)[0] == {0: [0, 1]}
