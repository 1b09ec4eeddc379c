"""Joins of repository facts, each declared so that Catalyst can pick its strategy.

First-match rules become an argmin over an explicit priority; prefix matches
become equi-joins over the bounded set of a stem's prefixes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.session import cut, shuffle_partitions


def local_edges(edges: DataFrame, files: DataFrame, src: str = "src", dst: str = "dst", key: str = "path") -> DataFrame:
    """Edges whose two ends are indexed files."""
    ends = files.select(F.col(key).alias("__k")).distinct()
    return edges.join(ends, F.col(src) == F.col("__k"), "left_semi").join(ends, F.col(dst) == F.col("__k"), "left_semi")


def dangling_edges(edges: DataFrame, files: DataFrame, dst: str = "dst", key: str = "path") -> DataFrame:
    """Edges to a file that isn't indexed."""
    return edges.join(files.select(F.col(key).alias("__k")), F.col(dst) == F.col("__k"), "left_anti")


def orphans(files: DataFrame, edges: DataFrame, entries: DataFrame, key: str = "path") -> DataFrame:
    """Files without edges either way that are no entry point."""
    out = files
    for other, column in ((edges, "src"), (edges, "dst"), (entries, "path")):
        out = out.join(other.select(F.col(column).alias("__k")), F.col(key) == F.col("__k"), "left_anti")
    return out


def resolve_candidates(imports: DataFrame, files: DataFrame, candidates: Column, target: str = "target", key: str = "path") -> DataFrame:
    """``imports`` with ``resolved``: the first of its candidate paths that is a file, else the target as it is."""
    tried = imports.withColumn("__row", F.xxhash64(*imports.columns)).select("*", F.posexplode(candidates).alias("__pos", "__path"))
    found = tried.join(files.select(F.col(key).alias("__k")).distinct(), F.col("__path") == F.col("__k"), "left")
    best = found.groupBy(*imports.columns).agg(F.min_by("__k", F.when(F.col("__k").isNotNull(), F.col("__pos"))).alias("__hit"))
    return best.select(*imports.columns, F.coalesce("__hit", target).alias("resolved"))


def prefixes(text: Column) -> Column:
    """Every non-empty prefix, the text itself included."""
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda n: F.substring(text, F.lit(1), n)))


def stem_matches(tests: DataFrame, sources: DataFrame) -> DataFrame:
    """(test_path, source_path): the first source, in path order, whose stem begins the test's stem.

    ``tests`` (test_path, stem), ``sources`` (source_path, stem). The prefix
    condition is an equality with one of the test stem's prefixes.
    """
    spread = tests.select("test_path", F.explode(prefixes(F.col("stem"))).alias("stem"))
    return spread.join(sources, "stem").groupBy("test_path").agg(F.min("source_path").alias("source_path"))


def either_prefix(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` (path, stem) for which a stem of ``b`` (stem) begins theirs or is begun by it."""
    down = a.select("path", F.explode(prefixes(F.col("stem"))).alias("stem")).join(b.select("stem").distinct(), "stem", "left_semi")
    up = a.select("path", "stem").join(b.select(F.explode(prefixes(F.col("stem"))).alias("stem")).distinct(), "stem", "left_semi")
    return down.select("path").union(up.select("path")).distinct()


def staged_resolution(calls: DataFrame, stages: list[DataFrame], key: str = "call_id") -> DataFrame:
    """Outcome of each call from candidate tables (call_id, target) in order of trust.

    The first stage with candidates counts: one target RESOLVED (first stage)
    or INFERRED, several AMBIGUOUS, none UNRESOLVED.
    """
    tagged = reduce(DataFrame.unionByName, [s.select(key, "target").distinct().withColumn("stage", F.lit(n)) for n, s in enumerate(stages)])
    least = Window.partitionBy(key)
    won = tagged.withColumn("__s", F.min("stage").over(least)).where("stage = __s").groupBy(key).agg(F.min("stage").alias("stage"), F.count("*").alias("n"), F.sort_array(F.collect_list("target")).alias("targets"))
    outcome = F.when(F.col("n").isNull(), "UNRESOLVED").when(F.col("n") > 1, "AMBIGUOUS").when(F.col("stage") == 0, "RESOLVED").otherwise("INFERRED")
    return calls.join(won, key, "left").select(key, outcome.alias("outcome"), "stage", F.coalesce("n", F.lit(0)).cast("long").alias("candidates"), F.element_at("targets", 1).alias("target"))


def scoped_then_global(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """``refs`` (ref, scope, name) resolved by scope and name, else by name; the last written target wins.

    ``targets`` (id, scope, name, seq).
    """
    scoped = targets.groupBy("scope", "name").agg(F.max_by("id", "seq").alias("scoped_id"))
    anywhere = targets.groupBy("name").agg(F.max_by("id", "seq").alias("global_id"))
    return refs.join(scoped, ["scope", "name"], "left").join(anywhere, "name", "left").select("ref", F.coalesce("scoped_id", "global_id").alias("target"), F.when(F.col("scoped_id").isNotNull(), "scoped").when(F.col("global_id").isNotNull(), "global").otherwise("none").alias("via"))


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """``left`` with the last non-null ``value`` of ``right`` at or before ``at``, by one sort of the union."""
    a = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(1).alias("__side"))
    b = right.select(by, at, F.col(value).alias("__v")).withColumn("__side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    seen = Window.partitionBy(by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(seen)).where("__side = 1").drop("__v", "__side")


def in_ranges(points: DataFrame, ranges: DataFrame, by: list[str], at: str, width: int) -> DataFrame:
    """Points inside ranges (start, end, both included): an equi-join on buckets of ``width``, then the exact test."""
    spread = ranges.select("*", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))).alias("__b"))
    near = points.withColumn("__b", F.floor(F.col(at) / width)).join(spread, [*by, "__b"])
    return near.where((F.col(at) >= F.col("start")) & (F.col(at) <= F.col("end"))).drop("__b")


def diff(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """(path, kind): added, deleted, unchanged, implementation or structural, by content and structure hashes."""
    a = old.select(F.col(key).alias("__o"), F.col("content_hash").alias("oc"), F.col("structural_hash").alias("os"))
    b = new.select(F.col(key).alias("__n"), F.col("content_hash").alias("nc"), F.col("structural_hash").alias("ns"))
    kind = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "deleted").when(F.col("oc") == F.col("nc"), "unchanged").when(F.col("os") == F.col("ns"), "implementation").otherwise("structural")
    return a.join(b, F.col("__o") == F.col("__n"), "full_outer").select(F.coalesce("__n", "__o").alias(key), kind.alias("kind"))


def tombstones(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """The new rows as active, and the old rows that are gone as deleted."""
    gone = old.join(new.select(key), key, "left_anti")
    return new.withColumn("lifecycle", F.lit("active")).unionByName(gone.withColumn("lifecycle", F.lit("deleted")), allowMissingColumns=True)


def rank_all(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place in a total order, without one task that sees them all.

    Rows are dealt into ranges of the order; a row's rank is its place in its
    range after the counts of the ranges before, one row a range.
    """
    n = shuffle_partitions(rows.sparkSession)
    dealt = cut(rows.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.join(F.broadcast(counts), "__part").withColumn(name, F.col("__before") + inside).drop("__part", "__before")


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _nth(rows, keys, [F.col(c).asc() for c in order], 1)


def last_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _nth(rows, keys, [F.col(c).desc() for c in order], 1)


def cap_per_key(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return _nth(rows, keys, order, n)


def _nth(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")
