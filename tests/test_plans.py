"""Components, ranks and tables."""

import random

from pyspark.sql import functions as F

from pixelmill.plans import graph, ranks


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(200, 200 + i) for i in range(50)] + [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(40)] + [(999, 999)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_components_by_group(spark):
    edges = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (2, 3, 4), (1, 5, 5)], "g int, a long, b long")
    got = {(r["g"], r["node"]): r["component"] for r in graph.connected_components(edges, ["g"]).collect()}
    assert got == {(1, 1): 1, (1, 2): 1, (1, 5): 5, (2, 2): 2, (2, 3): 2, (2, 4): 2}


def test_global_rank(spark):
    values = [None if i % 50 == 0 else f"k{i * 7919 % 1000:04d}" for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(7)
    rows = ranks.global_rank(df, [F.col("v").asc_nulls_last()]).collect()
    assert sorted(r["rank"] for r in rows) == list(range(500))
    by = [r["v"] for r in sorted(rows, key=lambda r: r["rank"])]
    assert by == sorted((v for v in values if v), key=str.encode) + [None] * 10
    assert ranks.global_rank(df.limit(0), [F.col("v")]).collect() == []
