import random
from collections import defaultdict
from fractions import Fraction
from heapq import heappop, heappush

import pytest
from pyspark.sql import functions as F

from loomwork.llm import mixing
from tests.llm.data import SCHEMA, documents


def brute(sources):
    """{(source, block): (slot, release, deadline)} of earliest deadline first; ``sources`` are (blocks, whole weight)."""
    total = sum(w for _, w in sources)
    jobs = sorted((j * total // w, -(-(j + 1) * total // w), z, j) for z, (n, w) in enumerate(sources) if w for j in range(n))
    out, live, k, t = {}, [], 0, 0
    while k < len(jobs) or live:
        if not live:
            t = max(t, jobs[k][0])
        while k < len(jobs) and jobs[k][0] <= t:
            r, d, z, j = jobs[k]
            heappush(live, (d, z, j, r))
            k += 1
        d, z, j, r = heappop(live)
        out[z, j] = (t, r, d)
        t += 1
    return out


def planned(spark, sources, **options):
    rows = [(z, f"s{z:05}", n * 10, w) for z, (n, w) in enumerate(sources)]
    got = mixing.schedule(spark.createDataFrame(rows, "z long, s string, n long, w long"), block_rows=10, **options).collect()
    return {(int(r.s[1:]), r.block): (r.slot, r.release, r.deadline) for r in got}


SOURCES = [
    [(5, 1)],
    [(30, 3), (10, 1)],
    [(50, 50), (30, 30), (19, 19), (1, 1)],
    [(7, 1)] * 50 + [(350, 50)],
    [(400, 9999), (3, 1)],  # 0.0001 of all
    [(20, 1), (200, 1_000_003), (200, 999_999), (5, 17)],
    [(300, 5), (2, 90), (40, 5)],  # the heaviest is used up first
    [(40, 0), (10, 3), (10, 4)],
]


@pytest.mark.parametrize("sources", SOURCES)
def test_schedule_is_earliest_deadline_first_within_windows(spark, sources):
    got = planned(spark, sources)
    assert got == brute(sources)
    assert len({t for t, _, _ in got.values()}) == len(got) and all(r <= t < d for t, r, d in got.values())


@pytest.mark.parametrize("chunk", [1, 7, 64])
def test_chunks_give_the_schedule_of_one_queue(spark, chunk):
    rng = random.Random(chunk)
    for _ in range(3):
        sources = [(rng.randint(1, 60), rng.choice([1, 3, 10, 100, 1000]) * rng.randint(1, 9)) for _ in range(rng.randint(2, 9))]
        assert planned(spark, sources, chunk_slots=chunk) == brute(sources)


def test_deviation_is_under_one_block_with_ten_thousand_sources(spark):
    rng = random.Random(2)
    weights = {f"s{i:05}": rng.choice([0.0001, 0.3, 1, 2.5, 7]) for i in range(10_000)} | {"s00000": 20_000.0}
    whole = mixing.whole_weights(weights)
    total = sum(Fraction(str(v)) for v in weights.values())
    assert all(Fraction(whole[k], sum(whole.values())) == Fraction(str(v)) / total for k, v in weights.items())
    sources = [(40 if k else 12_000, whole[f"s{k:05}"]) for k in range(10_000)]
    got = planned(spark, [(min(n, 2 + int(15_000 * w / sum(whole.values()))), w) for n, w in sources])
    runs = sorted((t, z) for (z, _), (t, _, _) in got.items() if t < 10_000)
    assert [t for t, _ in runs] == list(range(10_000))
    done = defaultdict(int)
    for t, z in runs:
        share = Fraction(sources[z][1], sum(whole.values()))
        assert abs(done[z] - t * share) < 1  # before its slot
        done[z] += 1
        assert abs(done[z] - (t + 1) * share) < 1  # and after it: in between the distance only falls back
    assert all(abs(done[z] - 10_000 * Fraction(w, sum(whole.values()))) < 1 for z, (_, w) in enumerate(sources))


def test_whole_weights():
    assert mixing.whole_weights({"a": 0.1, "b": 0.25, "c": 0}) == {"a": 2, "b": 5, "c": 0}
    assert mixing.whole_weights({"a": 1.0, "b": 1e-300}) == {"a": 1 << 40, "b": 1}
    assert mixing.whole_weights({}) == {}
    for bad in (-1.0, float("nan"), float("inf"), None):
        with pytest.raises(ValueError):
            mixing.whole_weights({"a": bad})


def test_small_weights_differ(spark):
    docs = documents(spark, [(i, "t", "abcd"[i % 4]) for i in range(400)])
    plan = mixing.mix_plan(docs, weights={"a": 1.0, "b": 0.0004, "c": 0.0002, "d": 0.0}, block_rows=10)
    first = {r.s: (r.r, r.d) for r in plan.where("block = 1").groupBy("s").agg(F.min("release").alias("r"), F.max("deadline").alias("d")).collect()}
    assert first == {"a": (1, 3), "b": (2501, 5003), "c": (5003, 10006), "d": (None, None)}
    assert plan.where("s = 'd'").agg(F.min("slot")).first()[0] > plan.where("s <> 'd'").agg(F.max("slot")).first()[0]


def test_every_row_once_in_schedule_order(spark):
    rows = [(i, f"t{i}", "hot" if i % 3 else ["b", None][i % 2]) for i in range(900)] + [(5, "again", "hot"), (5, "again", "hot"), (None, "no id", "b")]
    docs = documents(spark, rows)
    options = {"weights": {"hot": 0.5, "b": 0.3}, "block_rows": 10, "bucket_rows": 50}
    plan = mixing.mix_plan(docs, **options).collect()
    mixed = mixing.mix(docs, **options)
    assert mixed.columns == docs.columns
    got = [(r.doc_id, r.text, r.source) for r in mixed.collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)
    place = {(r.id, r.s): (r.slot, r.s, r.within) for r in plan}
    keys = [place[i, s if s is not None else mixing._NONE] for i, _, s in got]
    assert keys == sorted(keys) and len({r.slot for r in plan}) == len({(r.s, r.block) for r in plan})
    rows_of = defaultdict(list)
    for r in plan:
        rows_of[r.s].append(r.within)
    assert all(min(v) == 0 for v in rows_of.values())


def test_query_is_the_schedule_of_its_own_weights(spark):
    from loomwork.llm.queries import op5_mixing

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op5_mixing(spark, sf).collect()
    assert sorted((r.doc_id, r.source) for r in got) == sorted(docs)
    names = sorted({s for _, s in docs})
    n = {s: sum(x == s for _, x in docs) for s in names}
    root = {s: n[s] ** 0.5 for s in names}
    whole = [(-(-n[s] // 64), max(1, round(root[s] / sum(root.values()) * (1 << 40)))) for s in names]
    want = brute(whole)
    assert {(names.index(r.source), r.block): (r.slot, r.release, r.deadline) for r in got} == want
    for s in names:
        assert sorted(r.within for r in got if r.source == s) == list(range(n[s]))
        assert all(r.within // 64 == r.block for r in got)


def test_default_weights_flatten_and_edges(spark):
    docs = documents(spark, [(i, "t", "hot" if i % 10 else "b") for i in range(2000)])
    plan = mixing.mix_plan(docs, block_rows=10).where("slot < 40").groupBy("s").count().collect()
    share = {r.s: r["count"] for r in plan}
    assert 0.2 < share["b"] / sum(share.values()) < 0.3  # 1 : 3 by the root of 1 : 9
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mix(documents(spark, [(None, None, None)] * 2)).count() == 2
    assert mixing.mix(documents(spark, [(1, "a", "x"), (2, "b", "y")]), weights={}).count() == 2


def test_plan_stays_native(spark):
    text = mixing.mix(documents(spark), weights={"hot": 2.0, "b": 1.0})._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text
