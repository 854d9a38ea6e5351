from pyspark.sql import functions as F

from vitrine.operators import merge

COLS = "slug string, name string, edited_at timestamp, updated_at timestamp"
NOW = "2024-06-01"


def stamp():
    return F.lit(NOW).cast("timestamp")


def old(spark):
    return spark.sql(f"select * from values ('a','A',null,null),('b','B',timestamp'2024-01-01',null),('c','C',null,null),('d','D',timestamp'2024-01-01',null) as t(slug,name,edited_at,updated_at)")


def test_guarded_upsert_and_idempotence(spark):
    new = spark.createDataFrame([("a", "A2"), ("b", "B2"), ("n", "N")], "slug string, name string")
    out = merge.guarded_upsert(old(spark), new, ["slug"], stamp="updated_at", now=stamp(), drop_stale=True)
    got = {r["slug"]: (r["name"], r["action"]) for r in out.collect()}
    assert got == {"a": ("A2", "updated"), "b": ("B", "kept"), "c": ("C", "removed"), "d": ("D", "untouched"), "n": ("N", "inserted")}
    once = out.filter("action <> 'removed'").drop("action")
    twice = merge.guarded_upsert(once, new, ["slug"], stamp="updated_at", now=stamp(), drop_stale=True).drop("action")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.select(*once.columns).collect()))


def test_children_keep_vectors(spark):
    have = spark.createDataFrame([(1, "u", [1.0]), (1, "gone", [2.0]), (2, "u", [3.0])], "p int, url string, e array<double>")
    new = spark.createDataFrame([(1, "u", None), (1, "v", None)], "p int, url string, e array<double>")
    out = merge.replace_children(have, new, spark.createDataFrame([(1,)], "p int"), "p", "url", "e")
    assert {(r["p"], r["url"], tuple(r["e"] or ())) for r in out.collect()} == {(1, "u", (1.0,)), (1, "v", ()), (2, "u", (3.0,))}


def test_parents_and_bulk(spark):
    cats = spark.createDataFrame([(1, "office", None), (2, "desks", "office")], "id int, slug string, parent string")
    assert {r["slug"]: r["parent_id"] for r in merge.resolve_parents(cats).collect()} == {"office": None, "desks": 1}
    issue = lambda n, op, cat: spark.range(1).select(merge.bulk_edit_issue(F.array(*[F.lit("s")] * n) if n else F.array().cast("array<string>"), F.lit(op), F.lit(cat).cast("int")).alias("i")).first()["i"]
    assert issue(0, "hide", None) == "no rows selected"
    assert issue(501, "hide", None) == "too many rows"
    assert issue(1, "category", None) == "no category"
    assert issue(1, "checked", None) is None


def test_renumber_and_move(spark):
    df = spark.createDataFrame([("p", "a", 0), ("p", "b", 2), ("p", "c", 5), ("q", "d", 0)], "p string, c string, sort int")
    assert {r["c"]: r["sort"] for r in merge.renumber(df, "p", ["sort"]).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0}
    move = lambda c, d: {r["c"]: r["sort"] for r in merge.move_children(df, spark.createDataFrame([(c, d)], "c string, direction int"), "p", "c").collect()}
    assert move("b", -1) == {"b": 0, "a": 1, "c": 2, "d": 0}
    assert move("b", 1) == {"a": 0, "c": 1, "b": 2, "d": 0}
    assert move("a", -1) == {"a": 0, "b": 1, "c": 2, "d": 0}


def test_manifest(spark):
    local = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, md5 string")
    remote = spark.createDataFrame([("b", "9"), ("c", "3"), ("healthcheck.txt", "0")], "key string, md5 string")
    diff = merge.manifest_diff(local, remote)
    assert {r["key"]: r["action"] for r in diff.collect()} == {"a": "upload", "b": "upload", "c": "delete", "healthcheck.txt": "keep"}
    assert merge.deletion_is_safe(diff, remote)
    big = spark.range(60).select(F.col("id").cast("string").alias("key"), F.lit("x").alias("md5"))
    wipe = merge.manifest_diff(local, big)
    assert not merge.deletion_is_safe(wipe, big)
    assert merge.deletion_is_safe(wipe, big, prune=True)


def test_vector_issue(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],), ([1.0, float("nan")],), ([float("-inf"), 1.0],), (None,)], "v array<double>")
    assert [r["i"] for r in df.select(merge.vector_issue(F.col("v"), 2).alias("i")).collect()] == [None] + ["invalid embedding"] * 4


def test_repeated_edits_and_import_keys_multiply_nothing(spark):
    rows = spark.createDataFrame([("a", "review", 1, None), ("b", "review", 1, None)], "slug string, status string, category_id long, edited_at timestamp")
    edits = spark.createDataFrame([("a", "publish", None, 1), ("a", "category", 7, 2), ("a", "hide", None, 3), ("a", "category", None, 4)],
                                  "slug string, op string, category_id long, at int")
    out = merge.bulk_edit(rows.withColumnRenamed("category_id", "cat"), edits, "slug", "status", "cat", "edited_at", F.current_timestamp(), order="at")
    got = {r["slug"]: (r["status"], r["cat"], r["edited_at"] is not None) for r in out.collect()}
    assert out.count() == 2 and got == {"a": ("hidden", 7, True), "b": ("review", 1, False)}
    old = spark.createDataFrame([("a", "x"), ("c", "z")], "slug string, name string")
    new = spark.createDataFrame([("a", "n1"), ("a", "n2"), ("d", "n3"), ("d", "n3")], "slug string, name string")
    assert sorted(map(tuple, merge.upsert(old, new, ["slug"]).collect())) == [("a", "n2"), ("c", "z"), ("d", "n3")]
    assert sorted(map(tuple, merge.repeated_keys(new, ["slug"]).collect())) == [("a", 2), ("d", 2)]
