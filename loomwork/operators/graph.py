"""Graph operators over edge tables (src, dst).

Every traversal is a loop of joins over a frontier; each round is cut off in
the checkpoint folder, and only an emptiness test or a count reaches the
driver. Depth bounds are arguments, caps are explicit ranks.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.session import cut


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, once."""
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(origin, id, depth): the least depth, up to ``depth``, at which each seed (id) reaches a node; seeds at 0."""
    steps = edges.select(F.col("src").alias("id"), F.col("dst").alias("to")).distinct()
    seen = seeds.select(F.col("id").alias("origin"), "id").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        found = frontier.join(steps, "id").select("origin", F.col("to").alias("id")).distinct()
        frontier = cut(found.join(seen, ["origin", "id"], "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def components(edges: DataFrame, *, rounds: int = 100) -> DataFrame:
    """(id, component): the smallest id of each node's connected component; isolated nodes don't occur."""
    ways = cut(both_ways(edges))
    labels = cut(ways.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")))
    for _ in range(rounds):
        heard = ways.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("heard"))
        near = labels.join(heard, "id", "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("heard", "label")).alias("label"))
        # Pointer jumping: take the label's own label too, so that long paths shrink by halves.
        far = labels.select(F.col("id").alias("label"), F.col("label").alias("jump"))
        new = cut(near.join(far, "label", "left").select("id", "old", F.least("label", F.coalesce("jump", "label")).alias("label")))
        moved = new.where("old <> label").isEmpty()
        labels = new.select("id", "label")
        if moved:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"no fixpoint after {rounds} rounds")


def strong_components(edges: DataFrame, *, rounds: int | None = None) -> DataFrame:
    """(id, component) of nodes in cycles: the largest id of the strongly connected component, for two nodes or more or a loop.

    Forward colouring: each live node takes the largest id that reaches it;
    what reaches a colour's root backwards within the colour is its component.
    Each round settles a component at least, so without ``rounds`` all are found.
    """
    loops = edges.where("src = dst").select(F.col("src").alias("id"), F.col("src").alias("component")).distinct()
    live = cut(edges.where("src <> dst").select("src", "dst").distinct())
    done: DataFrame | None = None
    for turn in count():
        while True:  # trim nodes without edges in or out
            core = cut(live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            same = core.count() == live.count()
            live = core
            if same:
                break
        if live.isEmpty():
            break
        if turn == rounds:
            raise RuntimeError(f"no fixpoint after {rounds} rounds")
        colour = live.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("c", F.col("id"))
        while True:
            heard = live.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("c").alias("h"))
            new = cut(colour.join(heard, "id", "left").select("id", F.col("c").alias("old"), F.greatest("c", F.coalesce("h", "c")).alias("c")))
            still = new.where("old <> c").isEmpty()
            colour = new.select("id", "c")
            if still:
                break
        a, b = colour.select(F.col("id").alias("src"), F.col("c").alias("ca")), colour.select(F.col("id").alias("dst"), F.col("c").alias("cb"))
        inside = cut(live.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst", F.col("ca").alias("c")))
        found = front = colour.where("id = c")
        while True:
            front = cut(inside.join(front.select(F.col("id").alias("dst"), "c"), ["dst", "c"]).select(F.col("src").alias("id"), "c").distinct().join(found, ["id", "c"], "left_anti"))
            if front.isEmpty():
                break
            found = found.union(front)
        found = cut(found)
        done = found if done is None else done.union(found)
        gone = found.select("id")
        live = cut(live.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
    if done is None:
        return loops
    big = done.withColumn("n", F.count("*").over(Window.partitionBy("c"))).where("n > 1").select("id", F.col("c").alias("component"))
    return big.union(loops.join(big.select("id"), "id", "left_anti"))


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): 0 for nodes (id) without a need, else one more than the highest level that they need; null in and behind cycles.

    ``edges`` (src, dst): dst needs src; those from elsewhere than ``nodes`` count for nothing. Each round frees the nodes
    whose last need was met in the round before, so a round costs its own edges and there are as many as levels.
    """
    nodes = nodes.select("id").distinct()
    steps = cut(edges.select("src", "dst").distinct().join(nodes.withColumnRenamed("id", "src"), "src", "left_semi"))
    needs = steps.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("need"))
    left = cut(nodes.join(needs, "id", "left").select("id", F.coalesce("need", F.lit(0)).alias("need")))
    found = []
    for level in count():
        ready = left.where("need = 0").select("id", F.lit(level).alias("level"))
        if ready.isEmpty():
            break
        found.append(ready)
        met = steps.join(ready.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("met"))
        left = cut(left.where("need > 0").join(met, "id", "left").select("id", (F.col("need") - F.coalesce("met", F.lit(0))).alias("need")))
    return reduce(DataFrame.union, found, left.select("id", F.lit(None).cast("int").alias("level")))


def cheapest_paths(edges: DataFrame, source: DataFrame, *, rounds: int | None = None) -> DataFrame:
    """(id, cost, hops, previous) from the one ``source`` (id) over edges (src, dst, cost): relaxation to a fixpoint.

    A round starts from the nodes that the last one changed; what others offer was weighed before, and an equal offer changes
    nothing. Ties go to fewer hops, then the smaller previous node. A negative cycle,
    which has no fixpoint, is an error, as is a limit of ``rounds`` that is hit.
    """
    kind = edges.schema["src"].dataType
    best = cut(source.select("id", F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.lit(None).cast(kind).alias("previous")))
    front = best
    for turn in count(1):
        tried = front.join(edges.select(F.col("src").alias("id"), F.col("dst").alias("to"), F.col("cost").alias("c")), "id")
        tried = tried.select(F.col("to").alias("id"), F.round(F.col("cost") + F.col("c"), 9).alias("cost"), (F.col("hops") + 1).alias("hops"), F.col("id").alias("previous"))
        merged = best.withColumn("new", F.lit(0)).union(tried.withColumn("new", F.lit(1)))
        order = Window.partitionBy("id").orderBy("cost", "hops", "new", "previous")
        step = cut(merged.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn"))
        best, front = step.drop("new"), step.where("new = 1").drop("new")
        if front.isEmpty():
            return best
        if turn == rounds:
            raise RuntimeError(f"no fixpoint after {rounds} rounds")
        # Round k changes a node by a path of k hops, over k + 1 nodes unless it meets one twice.
        if turn >= best.count():
            raise ValueError("a cycle of negative cost")


def walk_back(best: DataFrame, target: DataFrame) -> DataFrame:
    """(position, id) of the path to ``target`` (id), position 0 at the source; empty if it isn't reached."""
    at = best.join(target, "id").select("id", "hops", "previous")
    path = at
    for _ in range(at.agg(F.max("hops")).first()[0] or 0):
        at = cut(best.join(at.where("previous is not null").select(F.col("previous").alias("id")), "id").select("id", "hops", "previous"))
        if at.isEmpty():
            break
        path = path.union(at)
    return path.select(F.col("hops").alias("position"), "id")


def label_communities(nodes: DataFrame, edges: DataFrame, *, passes: int = 12, gain: float = 1e-4) -> DataFrame:
    """(id, community) by asynchronous weighted label propagation in id order.

    ``nodes`` (id, noisy), ``edges`` (src, dst, weight). A vote is the weight
    times a hub penalty and 0.45 for noisy neighbours. The order of updates
    matters only within a connected component, so components run in parallel,
    one group each.
    """
    parts = components(edges.where("src <> dst"))
    ways = edges.where("src <> dst").select("src", "dst", "weight").union(edges.where("src <> dst").select("dst", "src", "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    degree = ways.groupBy(F.col("src").alias("dst")).agg(F.sum("weight").alias("d"))
    noisy = nodes.select(F.col("id").alias("dst"), "noisy")
    penalty = F.greatest(F.lit(0.35), F.least(F.lit(1.0), F.lit(6.0) / F.greatest(F.lit(6.0), F.col("d").cast("double")))) * F.when(F.coalesce("noisy", F.lit(False)), 0.45).otherwise(1.0)
    votes = ways.join(degree, "dst").join(noisy, "dst", "left").select("src", "dst", (F.col("weight") * penalty).alias("vote"))
    votes = votes.join(parts.select(F.col("id").alias("src"), "component"), "src")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        votes_of: dict = {}
        for s, d, v in zip(pdf["src"], pdf["dst"], pdf["vote"], strict=True):
            votes_of.setdefault(s, []).append((d, v))
        label = {n: n for n in sorted(votes_of)}
        for _ in range(passes):
            moved = False
            for n in label:
                score: dict = {}
                for d, v in votes_of[n]:
                    score[label[d]] = score.get(label[d], 0.0) + v
                best = min(score, key=lambda c: (-score[c], c))
                if score[best] > score.get(label[n], 0.0) + gain:
                    label[n], moved = best, True
            if not moved:
                break
        return pd.DataFrame({"id": list(label), "community": list(label.values())})

    found = votes.groupBy("component").applyInPandas(settle, "id long, community long")
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def graph_view(edges: DataFrame, seeds: DataFrame, depth: int, cap: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` of any seed, the ``cap`` nearest with ties by id, and the edges among them."""
    near = reach(both_ways(edges), seeds, depth).groupBy("id").agg(F.min("depth").alias("depth"))
    nodes = cut(near.orderBy("depth", "id").limit(cap))
    ids = nodes.select("id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes, inside
