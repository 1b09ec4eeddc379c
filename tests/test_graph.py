import pytest

from loomwork.operators import graph as G


def test_paths_of_more_than_fifty_hops(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(58)] + [(0, 58, 100.0)], "src long, dst long, cost double").coalesce(1).cache()
    best = G.cheapest_paths(edges, spark.createDataFrame([(0,)], "id long"))
    assert sorted((r.id, r.cost, r.hops) for r in best.collect()) == [(i, float(i), i) for i in range(59)]
    path = G.walk_back(best, spark.createDataFrame([(58,)], "id long"))
    assert sorted((r.position, r.id) for r in path.collect()) == [(i, i) for i in range(59)]


def test_limits_and_negative_cycles_raise(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(5)], "src long, dst long, cost double")
    source = spark.createDataFrame([(0,)], "id long")
    with pytest.raises(RuntimeError):
        G.cheapest_paths(edges, source, rounds=3)
    with pytest.raises(ValueError):
        G.cheapest_paths(spark.createDataFrame([(0, 1, 1.0), (1, 0, -2.0)], "src long, dst long, cost double"), source)


def test_every_cycle_of_a_line_is_found_or_it_raises(spark):
    """Two-node cycles with the largest ids upstream: one settles a round."""
    pairs = [(2 * i, 2 * i + 1) for i in range(5)]
    edges = [e for a, b in pairs for e in ((a, b), (b, a))] + [(2 * i, 2 * i - 1) for i in range(1, 5)]
    edges = spark.createDataFrame(edges, "src long, dst long")
    assert sorted(tuple(r) for r in G.strong_components(edges).collect()) == sorted((x, b) for a, b in pairs for x in (a, b))
    with pytest.raises(RuntimeError):
        G.strong_components(edges, rounds=2)
