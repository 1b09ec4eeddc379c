"""Tasks that hold a million rows at most, pairs without a self-join, and paths relaxed from what changed."""

import random

from loomwork.operators import aggregates as A
from loomwork.operators import graph as G
from loomwork.plans import bindings as B
from loomwork.session import spread

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_partitions_grow_with_rows(spark):
    rows = spark.range(10).withColumnRenamed("id", "k")
    assert spread(rows, "k", rows=10).rdd.getNumPartitions() == 4
    assert spread(rows, "k", rows=9_500_000).rdd.getNumPartitions() == 10


def test_facts_of_orders_are_spread(spark):
    assert "RepartitionByExpression" in _plan(B.edges(spark, SF)) and "RepartitionByExpression" in _plan(B.commits(spark, SF))


def test_pairs_need_no_self_join(spark):
    draw = random.Random(2)
    rows = sorted({(draw.randrange(30), draw.randrange(12)) for _ in range(200)})
    made = A.coupling(spark.createDataFrame(rows, "commit_id long, path long"), cap=5)
    assert _plan(made).count("Join ") == 2
    of = {c: sorted(p for k, p in rows if k == c)[:5] for c, _ in rows}
    times, pairs = {}, {}
    for files in of.values():
        for k, a in enumerate(files):
            times[a] = times.get(a, 0) + 1
            for b in files[k + 1 :]:
                pairs[a, b] = pairs.get((a, b), 0) + 1
    want = {(a, b, n, round(n / max(times[a], times[b]), 6)) for (a, b), n in pairs.items() if n >= 2}
    assert {tuple(r) for r in made.collect()} == want and want
    assert A.coupling(spark.createDataFrame([], "commit_id long, path long")).count() == 0


def test_cheapest_paths_with_ties(spark):
    draw = random.Random(4)
    edges = sorted({(draw.randrange(15), draw.randrange(15)): draw.choice([0.5, 1.0, 1.5]) for _ in range(45)}.items())
    rows = [(a, b, c) for (a, b), c in edges if a != b]
    best = {0: (0.0, 0)}
    for _ in range(16):
        for a, b, c in rows:
            if a in best:
                best[b] = min(best.get(b, (9e9, 0)), (round(best[a][0] + c, 9), best[a][1] + 1))
    got = {r.id: r for r in G.cheapest_paths(spark.createDataFrame(rows, "src long, dst long, cost double"), spark.createDataFrame([(0,)], "id long")).collect()}
    assert {k: (r.cost, r.hops) for k, r in got.items()} == best
    cost = {(a, b): c for a, b, c in rows}
    for k, r in got.items():
        assert k == 0 or (round(best[r.previous][0] + cost[r.previous, k], 9), best[r.previous][1] + 1) == best[k]
