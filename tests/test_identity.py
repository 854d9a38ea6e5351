import random

from pyspark.sql import functions as F

from vitrine.operators import identity
from vitrine.session import materialize


def brute_lineage(rows):
    seen, out = {}, {}
    for no, key, alone in sorted(rows):
        if key in seen and not alone:
            out[no] = seen[key]
        else:
            seen[key] = no
            out[no] = no
    return out


def test_lineage_matches_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, "hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", None]), rnd.random() < 0.1) for i in range(300)]
    df = spark.createDataFrame(rows, "no long, k string, alone boolean").repartition(4)
    got = {r["no"]: r["keeper"] for r in identity.dedupe_lineage(df, ["k"], "no", F.col("alone")).collect()}
    assert got == brute_lineage(rows)
    plain = {r["no"]: r["keeper"] for r in identity.dedupe_lineage(df, ["k"], "no").collect()}
    assert plain == brute_lineage([(n, k, False) for n, k, _ in rows])


def test_slugs(spark):
    df = spark.createDataFrame([(1, "b-fg-1"), (2, "b-fg-1"), (3, "c")], "no int, base string")
    assert sorted(r["slug"] for r in identity.number_slugs(df, "base", ["no"]).collect()) == ["b-fg-1", "b-fg-1-2", "c"]


def test_free_slugs(spark):
    old = spark.createDataFrame([("b-x",), ("b-x-2",), ("b-xy",), ("b-z-1",)], "slug string")
    new = spark.createDataFrame([(1, "b-x"), (2, "b-z"), (3, "b-q"), (4, "b-q"), (5, "b-z"), (6, "b-q"), (7, "b-x"), (8, "b-q-2")], "no int, base string")
    got = {r["no"]: r["slug"] for r in identity.free_slugs(new, old, "base", ["no"]).collect()}
    assert got == {1: "b-x-4", 2: "b-z", 3: "b-q", 4: "b-q-4", 5: "b-z-3", 6: "b-q-5", 7: "b-x-5", 8: "b-q-2"}
    assert len(set(got.values())) == len(got) and not set(got.values()) & {r["slug"] for r in old.collect()}


def test_codes_stay_and_are_never_reused(spark):
    registry = spark.createDataFrame([("a", "CH-NT-01"), ("b", "CH-NT-03")], "slug string, code string")
    items = spark.createDataFrame([("a", "CH-NT", "A"), ("b", "CH-NT", "B"), ("c", "CH-NT", "C")], "slug string, range string, k string")
    out, reg = identity.assign_codes(items, registry, ["k", "slug"])
    reg = materialize(reg)  # a registry is written between runs
    assert {r["slug"]: r["cat_code"] for r in out.collect()} == {"a": "CH-NT-01", "b": "CH-NT-03", "c": "CH-NT-04"}
    moved = items.withColumn("range", F.when(F.col("slug") == "c", "CH-LT").otherwise(F.col("range")))
    out2, reg2 = identity.assign_codes(moved, reg, ["k", "slug"])
    reg2 = materialize(reg2)
    assert {r["slug"]: r["cat_code"] for r in out2.collect()}["c"] == "CH-LT-01"
    back = moved.unionByName(spark.createDataFrame([("d", "CH-NT", "D")], "slug string, range string, k string"))
    out3, reg3 = identity.assign_codes(back, reg2, ["k", "slug"])
    codes = {r["slug"]: r["cat_code"] for r in out3.collect()}
    assert codes["d"] == "CH-NT-05" and codes["c"] == "CH-LT-01"
    assert reg3.count() == reg3.select("code").distinct().count()


def test_fingerprints_match_greedy(spark):
    rnd = random.Random(5)
    base = [[rnd.random() for _ in range(64)] for _ in range(4)]
    rows = []
    for i in range(120):
        v = list(base[rnd.randrange(4)])
        for _ in range(rnd.choice([0, 2, 5])):
            v[rnd.randrange(64)] = rnd.random()
        rows.append((i, rnd.choice(["p", "p", "q", "r"]), v))
    kept = {}
    for i, g, v in rows:
        bits = [x > sum(v) / len(v) for x in v]
        have = kept.setdefault(g, [])
        if len(have) < 3 and not any(sum(a != b for a, b in zip(bits, o)) / 64 < 0.1 for _, o in have):
            have.append((i, bits))
    df = spark.createDataFrame(rows, "no long, g string, v array<double>")
    got = {(r["g"], r["position"], r["no"]) for r in identity.distinct_fingerprints(df, "g", "no", "v").collect()}
    assert got == {(g, p, i) for g, have in kept.items() for p, (i, _) in enumerate(have)}


def test_decoration_vote_and_hero(spark):
    df = spark.createDataFrame([("f1", "h1"), ("f2", "h1"), ("f2", "h1"), ("f3", "h2")], "file string, hash string")
    assert [tuple(r) for r in identity.decorations(df, "hash", "file", 2).collect()] == [("h1", 2)]
    votes = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "y"), ("b", "x")], "folder string, item string")
    assert {r["folder"]: r["item"] for r in identity.vote_per_folder(votes, "folder", "item").collect()} == {"a": "y", "b": "x"}
    assert {r["folder"]: r["item"] for r in identity.vote_per_folder(votes, "folder", "item", {"a": "x"}).collect()} == {"a": "x", "b": "x"}
    pics = spark.createDataFrame([("g", 0, 5), ("g", 1, 9), ("g", 2, 9)], "g string, no int, area int")
    assert {r["no"]: r["sort"] for r in identity.hero_first(pics, "g", "no", F.col("area")).collect()} == {1: 0, 0: 1, 2: 2}
