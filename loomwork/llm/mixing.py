"""Mixing sources to target weights by Pfair scheduling (DataFrame operations only).

A source's documents, in hash order, are cut into blocks of ``block_rows``.
Block j of a source of weight w (a share of all weights) is released at slot
floor(j / w) and due at ceil((j + 1) / w); in each slot the released block with
the earliest deadline runs, ties by source. As the shares sum to 1, every block
runs within its window, so at any slot each source is less than one block from
its target, however long the schedule is. Releases and deadlines are whole
numbers from whole weights, without a period or rounded quotas.

The one queue of blocks is scheduled in chunks of slots side by side. What a
chunk runs are the earliest deadlines that its slots can hold: a greedy basis of
a matroid. So if blocks wait at its start, it runs the earliest of those and of
what it would have run alone, and the rest waits on. So what a run of chunks
does to the blocks that wait before it is told by the blocks that wait behind
it when none does, and the last deadlines it ran then (at most a block a source
of each). Such runs are joined ``_JOINED`` at a time, level by level, in
rows of their own; on the way back each gets what waits at its start, and a
second pass over the chunks gives the slots.

When a source has no blocks left its slots stay empty: no document is dropped
or repeated, and the others keep their windows.

Defined results
* null sources are a source of their own; null ids are one document of it.
* rows that repeat a (source, id) share a place and count each.
* a source of weight 0 or without a given weight has no window: its blocks come
  after all others, such sources taking turns. Negative, infinite and missing
  weights are refused.
* weights count to 2^-40 of the largest one; a smaller positive one is 2^-40 of it.
* text isn't looked at; extra columns pass through; empty table: empty result.
"""

from __future__ import annotations

import json
import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.session import cut

_NONE = "\x00null"
_ONE = 1 << 40
_PART = 1 << 16
_JOINED = 32  # runs of chunks that one row joins


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """The weights as whole numbers in their exact ratios, or to 2^-40 of the largest."""
    exact = {}
    for k, v in weights.items():
        if v is None or not math.isfinite(v) or v < 0:
            raise ValueError(f"weight of {k!r} must be a number of 0 or more")
        exact[k] = Fraction(str(v))
    scale = math.lcm(*(v.denominator for v in exact.values())) if exact else 1
    most = max(exact.values(), default=0) * scale
    if most > _ONE:
        return {k: max(1, round(v * scale / most * _ONE)) if v else 0 for k, v in exact.items()}
    return {k: int(v * scale) for k, v in exact.items()}


def shares(docs: DataFrame, source_col: str, weights: dict[str, float] | None, *, power: float) -> DataFrame:
    """(z, s, n, w): number, name, rows and whole weight of each source; weights default to n ** power."""
    counts = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit(_NONE)).alias("s")).agg(F.count("*").alias("n"))
    if weights is None:
        total = F.sum(F.pow(F.col("n").cast("double"), F.lit(power))).over(Window.partitionBy())  # one row a source
        wanted = counts.withColumn("w", F.greatest(F.lit(1), F.round(F.pow(F.col("n").cast("double"), F.lit(power)) / total * _ONE)).cast("long"))
    else:
        listed = F.from_json(F.lit(json.dumps(whole_weights(weights))), "map<string,bigint>")
        given = docs.sparkSession.range(1).select(F.explode(listed).alias("s", "w"))
        wanted = counts.join(given, "s", "left").withColumn("w", F.coalesce("w", F.lit(0)).cast("long"))
    return wanted.select((F.row_number().over(Window.orderBy("s")) - 1).cast("long").alias("z"), "s", "n", "w")


def _folded(events: str, waiting: str, slots: int) -> str:
    """SQL that runs a chunk: ``p``, what waits at its end, and ``runs``, what ran from slot t on without a pause.

    Between two events no block is released, so the first of those that wait run in turn.
    """
    return f"""aggregate(
      transform({events}, (e, i) -> named_struct('t', e.t, 'a', e.a, 'g', cast(coalesce(try_element_at({events}, i + 2).t, {slots}) - e.t as int))),
      named_struct('p', {waiting}, 'runs', cast(array() as array<struct<t: bigint, x: array<struct<d: bigint, z: bigint, j: bigint, r: bigint>>>>)),
      (acc, e) -> transform(array(sort_array(concat(acc.p, e.a))), q -> named_struct(
        'p', slice(q, e.g + 1, greatest(size(q), 1)),
        'runs', concat(acc.runs, array(named_struct('t', e.t, 'x', slice(q, 1, e.g))))))[0])"""


_KIND = "array<struct<d: bigint, z: bigint, j: bigint, r: bigint>>"
_EMPTY = f"cast(array() as {_KIND})"


def _carried(p: str, x: str) -> str:
    """SQL of the blocks that wait behind run ``x`` (m, top, rest, slots) if ``p`` wait before it."""
    return f"concat({x}.rest, slice(sort_array(concat({p}, {x}.top), false), 1, cast(greatest(0, size({p}) + {x}.m - {x}.slots) as int)))"


def _joined(count: int) -> str:
    """SQL that folds the runs of a row, in order, into one."""
    late = "cast(greatest(0, size(acc.rest) + x.m - x.slots) as int)"
    both = "sort_array(concat(acc.rest, x.top), false)"
    return f"""aggregate(runs, named_struct('m', 0L, 'top', {_EMPTY}, 'rest', {_EMPTY}, 'slots', 0L),
      (acc, x) -> named_struct(
        'm', acc.m + size(acc.rest) + x.m - {late},
        'top', slice(sort_array(concat(acc.top, slice({both}, {late} + 1, greatest(1, size(acc.rest) + size(x.top)))), false), 1, {count}),
        'rest', concat(x.rest, slice({both}, 1, {late})),
        'slots', acc.slots + x.slots))"""


def waiting(ends: DataFrame, count: int, chunks: int) -> DataFrame:
    """(c, p): the blocks that wait at each chunk's start, of ``ends`` (c, m, top, rest, slots), chunks below ``chunks``.

    Runs without a row have nothing to wait and run nothing. A row holds up to ``_JOINED`` runs of two blocks a source each.
    """
    levels = [cut(ends)]
    while chunks > _JOINED:
        chunks = -(-chunks // _JOINED)
        rows = levels[-1].groupBy(F.expr(f"c div {_JOINED}").alias("c")).agg(F.array_sort(F.collect_list(F.struct("c", "m", "top", "rest", "slots"))).alias("runs"))
        levels.append(cut(rows.select("c", F.expr(_joined(count)).alias("r")).select("c", "r.m", "r.top", "r.rest", "r.slots")))
    before = levels[-1].select(F.expr(f"c div {_JOINED}").alias("g")).distinct().selectExpr("g", f"{_EMPTY} as p")
    for level in reversed(levels):
        rows = level.groupBy(F.expr(f"c div {_JOINED}").alias("g")).agg(F.array_sort(F.collect_list(F.struct("c", "m", "top", "rest", "slots"))).alias("runs")).join(before, "g")
        folded = f"""aggregate(runs, named_struct('p', p, 'out', cast(array() as array<struct<c: bigint, p: {_KIND}>>)),
          (acc, x) -> named_struct('p', {_carried("acc.p", "x")}, 'out', concat(acc.out, array(named_struct('c', x.c, 'p', acc.p)))), acc -> acc.out)"""
        before = rows.selectExpr(f"inline({folded})").withColumnRenamed("c", "g")
    return before.withColumnRenamed("g", "c")


def schedule(sources: DataFrame, *, block_rows: int = 64, chunk_slots: int | None = None) -> DataFrame:
    """(s, block, slot, release, deadline) of every block of the ``sources`` (z, s, n, w) of positive weight."""
    paid = sources.where("w > 0")
    blocks = F.ceil(F.col("n") / block_rows)
    total, many, count = paid.agg(F.sum("w"), F.sum(blocks), F.count("*")).first()
    if not many:
        return sources.limit(0).selectExpr("s", "n as block", "n as slot", "n as release", "n as deadline")
    n = max(chunk_slots or max(128, 2 * count), count)  # at most one block a source waits, so none waits beyond the next chunk
    parts = paid.select("z", "w", blocks.alias("b")).withColumn("part", F.explode(F.expr(f"sequence(0L, (b - 1) div {_PART})")))
    parts = parts.repartition("z", "part")  # a large source's blocks are listed by many tasks
    jobs = parts.withColumn("j", F.explode(F.expr(f"sequence(part * {_PART}, least(b, (part + 1) * {_PART}) - 1)")))
    span = f"cast({total} as decimal(19, 0))"
    jobs = jobs.selectExpr("z", "j", f"(cast(j as decimal(19, 0)) * {span}) div w as r", f"(cast(j + 1 as decimal(19, 0)) * {span} + w - 1) div w as d")
    released = jobs.groupBy(F.expr(f"r div {n}").alias("c"), F.expr(f"r % {n}").alias("t")).agg(F.collect_list(F.struct("d", "z", "j", "r")).alias("a"))
    # Every chunk begins with an event, and one follows each chunk, for what waits at its end.
    starts = released.select("c").union(released.select(F.col("c") + 1)).distinct().selectExpr("c", "0L as t", f"{_EMPTY} as a")
    chunks = cut(released.unionByName(starts).groupBy("c").agg(F.sort_array(F.collect_list(F.struct("t", "a"))).alias("events")))
    alone = chunks.select("c", F.expr(_folded("events", _EMPTY, n)).alias("f")).selectExpr("c", "flatten(f.runs.x) as ran", "f.p as rest")
    ends = alone.selectExpr("c", "cast(size(ran) as bigint) as m", f"slice(sort_array(ran, false), 1, {count}) as top", "rest", f"{n}L as slots")
    waits = waiting(ends, count, 1 + chunks.agg(F.max("c")).first()[0])
    met = chunks.join(waits, "c").select("c", F.expr(_folded("events", "p", n)).alias("f")).selectExpr("c", "inline(f.runs)")
    ran = met.select("c", "t", F.posexplode("x").alias("at", "x")).selectExpr("x.z as z", "x.j as block", f"c * {n} + t + at as slot", "x.r as release", "x.d as deadline")
    return ran.join(sources.select("z", "s"), "z").select("s", "block", "slot", "release", "deadline")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", *, weights: dict[str, float] | None = None, power: float = 0.5, block_rows: int = 64, bucket_rows: int = 2_000, chunk_slots: int | None = None) -> DataFrame:
    """(id, s, block, slot, release, deadline, within) of each (source, id); order by (slot, s, within).

    Documents are numbered per source without bringing a source together:
    running sums within ranges of the id's hash, on top of the ranges' totals.
    """
    key = F.coalesce(F.col(source_col).cast("string"), F.lit(_NONE)).alias("s")
    units = docs.select(F.col(id_col).alias("id"), key).groupBy("s", "id").agg(F.count("*").alias("n"))
    units = units.withColumn("h", F.xxhash64("id", "s"))
    sources = cut(shares(docs, source_col, weights, power=power))
    most, unpaid = sources.agg(F.max("n"), F.count_if(F.col("w") == 0)).first()
    bits = max(0, math.ceil(math.log2(max(1, (most or 0) / bucket_rows))))
    bucket = F.shiftrightunsigned(F.col("h"), 64 - bits) if bits else F.lit(0).cast("long")
    units = units.withColumn("b", bucket)
    totals = units.groupBy("s", "b").agg(F.sum("n").alias("m"))
    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("s", "b", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("s", "b").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)
    ranked = units.withColumn("upto", F.sum("n").over(inside)).join(offsets, ["s", "b"])
    at = F.col("base") + F.col("upto") - F.col("n")
    ranked = ranked.select("id", "s", at.alias("within"), F.floor(at / block_rows).cast("long").alias("block"))
    slots = cut(schedule(sources, block_rows=block_rows, chunk_slots=chunk_slots))
    out = ["id", "s", "block", "slot", "release", "deadline", "within"]
    planned = ranked.join(slots, ["s", "block"])
    if unpaid:
        last = slots.agg(F.coalesce(F.max("slot"), F.lit(-1))).first()[0]
        turns = sources.where("w = 0").select("s", (F.row_number().over(Window.orderBy("z")) - 1).alias("k"))
        none = F.lit(None).cast("long")
        rest = ranked.join(turns, "s").select("id", "s", "block", (F.col("block") * unpaid + F.col("k") + (last + 1)).alias("slot"), none.alias("release"), none.alias("deadline"), "within")
        return planned.select(*out).unionByName(rest)
    return planned.select(*out)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """``docs`` in the order of the schedule: every row once, columns unchanged.

    Texts are shuffled twice, once to meet their places and once into order: the
    place of a row depends on the rows before it in its source, which are elsewhere.
    """
    plan = mix_plan(docs, id_col, source_col, **options).select(F.col("id").alias("__lw_id"), F.col("s").alias("__lw_s"), F.col("slot").alias("__lw_slot"), F.col("within").alias("__lw_at"))
    here = F.coalesce(docs[source_col].cast("string"), F.lit(_NONE))
    met = docs.join(plan.hint("merge"), docs[id_col].eqNullSafe(plan["__lw_id"]) & (here == plan["__lw_s"]), "left")
    return met.orderBy("__lw_slot", "__lw_s", "__lw_at").select(*[docs[c] for c in docs.columns])
