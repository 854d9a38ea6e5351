import numpy as np

from vitrine.operators import similar


def test_grid_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    images = rng.normal(size=(300, 16))
    images[50:150] = images[50]  # a third of the pictures are copies
    queries = rng.normal(size=(7, 16))
    df = spark.createDataFrame([(i, f"p{i % 9}", [float(x) for x in v]) for i, v in enumerate(images)] + [(999, "p0", None)], "id long, p string, v array<double>").repartition(4)
    qs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(queries)], "id long, v array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    d = np.round(1 - unit(np.round(unit(queries), 6)) @ unit(images).T, 9)
    want = {(q, int(i)) for q in range(7) for i in np.lexsort((np.arange(300), d[q]))[:40]}
    for kwargs in ({}, {"queries_per_block": 3}):
        near = similar.nearest_images(df, qs, "id", "id", "v", "p", 40, **kwargs).collect()
        assert {(r["query_id"], r["image_id"]) for r in near} == want and len(near) == len(want)
        assert all(r["product"] == f"p{r['image_id'] % 9}" for r in near)


def test_many_queries_and_text_ids(spark):
    rng = np.random.default_rng(2)
    images, queries = rng.normal(size=(40, 4)), rng.normal(size=(5000, 4))
    df = spark.createDataFrame([(f"i{i:02}", "p", [float(x) for x in v]) for i, v in enumerate(images)], "id string, p string, v array<double>")
    qs = spark.createDataFrame([(f"q{i:04}", [float(x) for x in v]) for i, v in enumerate(queries)], "id string, v array<double>")
    near = similar.nearest_images(df, qs, "id", "id", "v", "p", 3).collect()
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    d = np.round(1 - unit(np.round(unit(queries), 6)) @ unit(images).T, 9)
    want = {(f"q{q:04}", f"i{i:02}") for q in range(5000) for i in np.lexsort((np.arange(40), d[q]))[:3]}
    assert {(r["query_id"], r["image_id"]) for r in near} == want and len(near) == len(want)


def test_hidden_products_drop_after_the_cut(spark):
    near = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.2), (1, "c", 0.3)], "query_id long, product string, distance double")
    out = similar.top_products(near, spark.createDataFrame([("b",), ("c",)], "product string"), 24)
    assert [(r["product"], r["rank"], r["score"]) for r in out.orderBy("rank").collect()] == [("b", 1, 0.8), ("c", 2, 0.7)]
    truth = spark.createDataFrame([(1, "c"), (2, "a")], "query_id long, product string")
    assert tuple(similar.hit_rates(out, truth).first()) == (2, 0.0, 0.5, 0.5)
