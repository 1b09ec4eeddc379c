"""Connected components of a large sparse graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.session import cut, shuffle_partitions

#: Rows of (id, id) a file of a checkpoint.
_ROWS = 20_000


def cut_rows(df: DataFrame, rows: int) -> DataFrame:
    """``cut`` of at most ``rows`` rows: a result that is small beside the shuffle's partitions goes into as few files as it needs."""
    files = max(1, -(-rows // _ROWS))
    return cut(df.coalesce(files) if files < shuffle_partitions(df.sparkSession) else df)


def _state(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour larger than a node is linked to the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def star_components(edges: DataFrame, *, most: int | None = None, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) that isn't its component's smallest.

    Minima are taken by aggregation, so no node's neighbours meet in one task,
    and each round is cut off in the checkpoint folder. Edges never grow in
    number; ``most`` says how many there are at most, if known. Only their count
    and a digest reach the driver. No edges: no rows.
    """
    start = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    now = cut(start) if most is None else cut_rows(start, most)
    state = _state(now)
    for _ in range(rounds):
        now = cut_rows(_small_star(_large_star(now)), state[0])
        before, state = state, _state(now)
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"no fixpoint after {rounds} rounds")
