import random

from pyspark.sql import functions as F

from skygrain.llm import splits


def union_find(links):
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    groups: dict = {}
    for x in list(parent):
        groups.setdefault(root(x), set()).add(x)
    return {x: min(g) for g in groups.values() for x in g}


def test_components_against_union_find(spark):
    rng = random.Random(5)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(100)] + [(7, 7)]
    df = spark.createDataFrame(links + links[:5] + [(None, 3), (4, None)], "a long, b long")
    got = {r.node: r.component for r in splits.components(df).collect()}
    assert got == union_find(links)


def records(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "a long, author string, source string, x string, component double")


WEIGHTS = {"train": 0.7, "validation": 0.2, "test": 0.1}


def split(spark, rows):
    out = splits.assigned(records(spark, rows), "a", splits.node("author", F.col("author")), splits.node("source", F.col("source")), WEIGHTS)
    return out.collect()


def test_entities_stay_together(spark):
    rng = random.Random(1)
    rows = [(i, f"w{rng.randrange(900)}", f"s{rng.randrange(900)}") for i in range(1200)] + [(5000, None, "s1"), (5001, "w1", None), (5002, None, None), (5003, None, None)]
    by: dict = {}
    of = {r.a: r for r in split(spark, rows)}
    assert set(of) == {r[0] for r in rows}
    for i, w, s in rows:
        for e in (("w", w), ("s", s)):
            if e[1]:
                by.setdefault(e, set()).add(of[i].split)
                if of[i].blocked_split != "buffer":
                    by.setdefault(("blocked", *e), set()).add(of[i].blocked_split)
                by.setdefault(("axis", *e), set()).add(of[i].first_split if e[0] == "w" else of[i].second_split)
    assert all(len(v) == 1 for v in by.values())
    assert of[5002].component != of[5003].component


def test_shares(spark):
    rows = [(i, f"w{i // 3}", f"s{i // 6}") for i in range(6000)]
    got = split(spark, rows)
    for name, w in WEIGHTS.items():
        assert abs(sum(r.split == name for r in got) / len(got) - w) < 0.04
    kept = [r.blocked_split for r in got if r.blocked_split != "buffer"]
    for name, w in WEIGHTS.items():
        assert abs(kept.count(name) / len(kept) - w) < 0.06


def test_divided(spark):
    rows = [(1, "p", "0"), (2, "p", "1"), (3, "q", "0"), (4, "q", "0"), (5, "r", None), (6, "r", "1"), (7, None, "0"), (8, None, "1"), (9, "p", "1")]
    got = splits.divided(records(spark, rows), {"place": ({"key": F.col("author")}, F.col("source")), "letter": ({"key": F.col("source")}, F.col("author"))}).collect()
    assert sorted(tuple(r) for r in got) == [("letter", "0"), ("letter", "1"), ("place", "p")]


def test_a_giant_component_is_even_work(spark, monkeypatch):
    """A node of 10^5 members: its rows meet its least member where they are, in all tasks alike."""
    monkeypatch.setattr(splits, "HOT_ROWS", 1000)
    n = 100_000
    cluster = spark.range(n, numPartitions=8).select(F.lit(0).cast("long").alias("v"), F.col("id").alias("u"))
    cluster = cluster.unionByName(spark.range(5, numPartitions=1).select((F.col("id") + n).alias("v"), F.lit(n).cast("long").alias("u")))
    least = cluster.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("c"))
    got = splits._with_least(cluster, least)
    assert got.count() == n + 5 and got.filter("v = 0 and m = 0").count() == n
    per_task = [r["count"] for r in got.filter("v = 0").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(per_task) >= 8 and max(per_task) <= 2 * n / 8
    star = [(0, i) for i in range(1, 5000)] + [(10_000 + i, 10_001 + i) for i in range(20)]
    of = {r.node: r.component for r in splits.components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert of == union_find(star)


def test_a_hot_entity(spark):
    rows = [(i, "hot", f"s{i}") for i in range(3000)] + [(9000 + i, f"w{i}", f"t{i}") for i in range(10)]
    got = split(spark, rows)
    assert len({r.component for r in got if r.a < 9000}) == 1 and len({r.component for r in got}) == 11


def test_empty(spark):
    assert split(spark, []) == []
    assert splits.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert splits.divided(records(spark, []), {"p": ({"key": F.col("author")}, F.col("source"))}).count() == 0
