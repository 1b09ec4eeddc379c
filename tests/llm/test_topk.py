import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.llm import topk


def brute(rows, k):
    q = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i in sorted({i for i, _ in q if i % 3 == 0}):
        own = next(v for j, v in q if j == i)
        best = sorted((-sum(a * b for a, b in zip(own, v)), j) for j, v in q if j != i and len(v) == len(own))[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return out


def test_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1).astype(np.float32)]) for i in range(150)]
    rows += [(150, None), (151, []), (153, [1.0, None, 2.0, 0.0, 0.0, 1.0]), (156, [float("nan")] * 6), (159, [float("inf")] + [0.0] * 5), (162, [1.0, 2.0]), (163, [3.0, -1.0]), (None, [1.0] * 6), (165, [0.0] * 6)]
    rows += [(200 + i, rows[7][1]) for i in range(30)] + [(7, rows[7][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, rank string, score int")
    for options in ({}, {"group_rows": 40, "chunk_queries": 9}):
        got = topk.top_k(df, F.col("vec_id") % 3 == 0, k=5, **options)
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute(rows, 5)


@pytest.mark.parametrize("scale", [10, 2**28, 2**40])
def test_blocks_are_pruned_and_exact(scale):
    rng = np.random.default_rng(6)
    centres = rng.integers(-scale, scale, (8, 16))
    rows = np.concatenate([c + rng.integers(-scale // 10 - 1, scale // 10 + 1, (64, 16)) for c in centres])
    ids = np.arange(len(rows))
    at, found, score, scored = topk.search_group(rows[::50], ids[::50], rows, ids, 4, block=64)
    for q, i in enumerate(ids[::50]):
        best = sorted((-sum(int(a) * int(b) for a, b in zip(rows[i], rows[j])), j) for j in ids if j != i)[:4]
        assert found[at == q].tolist() == [j for _, j in best]
        assert score[at == q].tolist() == [max(-(2**63), min(2**63 - 1, -s)) for s, _ in best]
    assert scored < len(rows[::50]) * 8


def test_few_rows_and_empty_table(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 100 == 0).count() == 0
    got = topk.top_k(spark.createDataFrame([(0, [1.0]), (5, [2.0])], schema), F.col("vec_id") % 100 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 5, 1024 * 2048)]


def test_floor_from_another_group_prunes_and_keeps_ties():
    rng = np.random.default_rng(8)
    rows = rng.integers(-20, 20, (640, 8))
    ids = np.arange(len(rows))
    q, query_ids = rows[:10], ids[:10] + 10_000
    want = [sorted((-int(rows[i] @ r), j) for j, r in zip(ids, rows))[:5] for i in range(10)]
    floor = np.array([-w[-1][0] for w in want], dtype=np.int64)
    at, found, score, scored = topk.search_group(q, query_ids, rows, ids, 5, block=16, floor=floor)
    plain = topk.search_group(q, query_ids, rows, ids, 5, block=16)[3]
    for i in range(10):
        assert sorted(zip((-score[at == i]).tolist(), found[at == i].tolist()))[:5] == want[i]
    assert scored <= plain


def test_ids_of_one_stride_spread_over_groups(spark):
    rows = [(i * 256 * 8, [float(i % 7), 1.0]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("vec_id") % (256 * 8 * 40) == 0, k=3, group_rows=50)
    q = [(i, [1024 * int(x) for x in v]) for i, v in rows]
    want = []
    for i, own in q[::40]:
        best = sorted((-sum(a * b for a, b in zip(own, v)), j) for j, v in q if j != i)[:3]
        want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == sorted(want)
