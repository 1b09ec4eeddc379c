from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomwork.llm import line_dedup
from loomwork.llm.line_dedup import dedup_lines
from tests.llm.data import SCHEMA, documents

BLANKS = " \t\n\x0b\x0c\r"
FOLD = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, least=10):
    owner = defaultdict(set)
    key = lambda x: x.strip(BLANKS).translate(FOLD)
    for i, text in rows:
        for x in (text or "").split("\n"):
            owner[key(x)].add(float("inf") if i is None else i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        at = float("inf") if i is None else i
        kept = [x for x in lines if len(key(x)) < least or min(owner[key(x)]) == at]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (7, 3)])
def test_matches_brute_force(spark, batches, fanout):
    docs = documents(spark)
    got = dedup_lines(docs, batches=batches, fanout=fanout)
    assert got.columns == ["doc_id", "text", "source", "id", "fp", "score", "__x", "n_lines", "n_dropped"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == brute(rows)


def test_empty_table_and_all_null_ids(spark):
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
    got = dedup_lines(documents(spark, [(None, "the same long line", "a")] * 3)).collect()
    assert [r.n_dropped for r in got] == [0, 0, 0]


def test_hot_line_in_many_documents(spark):
    rows = [(i, f"a very common licence line\nown words of {i}", "hot") for i in range(600)]
    got = dedup_lines(documents(spark, rows)).where("n_dropped = 0").collect()
    assert [r.doc_id for r in got] == [0]


def test_plan_stays_native(spark):
    plan = dedup_lines(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_runs_are_merged_without_exchange_or_sort(spark):
    """A batch is shuffled and sorted once; runs are read in their partitions' order. Compactions don't shuffle either."""
    rows = spark.range(500).selectExpr("id % 200 as __lw_h1", "id % 200 as __lw_h2", "id as __lw_owner")
    keys = ["__lw_h1", "__lw_h2"]
    batch = rows.groupBy(*keys).agg(F.min("__lw_owner").alias("__lw_lo")).withColumn("__lw_many", F.lit(False))
    runs = [line_dedup.run_of(rows.where(f"__lw_h1 % 4 = {k}").groupBy(*keys).agg(F.min("__lw_owner").alias("__lw_owner"))) for k in range(3)]
    runs[0] = line_dedup.compacted([runs[0], runs[1]])

    text = line_dedup.meet(batch, [runs[0], runs[2]])._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and text.count("Sort [") == 1 and text.count("SortMergeJoin") == 2
    union = runs[0].unionByName(runs[2]).sortWithinPartitions(*keys)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in union
    assert {r["__lw_h1"]: r["__lw_held"] for r in line_dedup.meet(batch, [runs[0], runs[2]]).collect()} == {k: k % 4 < 3 for k in range(200)}


def test_batches_grow_with_the_documents(spark, monkeypatch):
    seen = []
    whole = line_dedup.repeated_keys
    monkeypatch.setattr(line_dedup, "repeated_keys", lambda hashed, batches, **kw: seen.append(batches) or whole(hashed, batches, **kw))
    rows = [(i, f"a line of two {i // 2}", "a") for i in range(400)]
    assert dedup_lines(documents(spark, rows), task_docs=5).where("n_dropped = 1").count() == 200
    assert seen == [20]
