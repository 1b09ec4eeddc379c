"""Aggregates of repository facts."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.session import cut, spread

#: Change classes, severities and their weights in a risk score.
CHANGE_KINDS = ["unchanged", "implementation", "structural", "added", "deleted"]
SEVERITY_WEIGHTS = {"critical": 20, "high": 8, "medium": 3, "low": 1}


def severity_weight(severity: Column) -> Column:
    out = F.lit(0)
    for name, weight in SEVERITY_WEIGHTS.items():
        out = F.when(severity == name, weight).otherwise(out)
    return out


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree) over distinct neighbours."""
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    both = both.union(edges.select("dst", "src", F.lit(0), F.lit(1))).groupBy("id", "other").agg(F.max("o").alias("o"), F.max("i").alias("i"))
    return both.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("degree"))


def coupling(commits: DataFrame, *, cap: int = 50, least: int = 2) -> DataFrame:
    """(file_a, file_b, commits, strength): pairs changed together in ``least`` commits or more.

    A commit counts with its first ``cap`` files; that bound is the feature, and
    keeps a commit's pairs bounded too.
    """
    first = Window.partitionBy("commit_id").orderBy("path")
    bounded = commits.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= cap)
    # A commit's files in one row: pairs need no join, and their number is known before tasks are made for them.
    files = cut(bounded.groupBy("commit_id").agg(F.sort_array(F.collect_list("path")).alias("files")))
    counts = files.select(F.explode("files").alias("path")).groupBy("path").agg(F.count("*").alias("n"))
    n = files.agg(F.sum(F.size("files").cast("long") * (F.size("files") - 1) / 2)).first()[0] or 0
    each = files.select("files", F.posexplode("files").alias("at", "file_a")).select("file_a", F.explode(F.slice("files", F.col("at") + 2, F.size("files"))).alias("file_b"))
    pairs = spread(each.where("file_a < file_b"), "file_a", "file_b", rows=int(n)).groupBy("file_a", "file_b").agg(F.count("*").alias("commits")).where(F.col("commits") >= least)
    met = pairs.join(counts.select(F.col("path").alias("file_a"), F.col("n").alias("na")), "file_a").join(counts.select(F.col("path").alias("file_b"), F.col("n").alias("nb")), "file_b")
    return met.select("file_a", "file_b", "commits", F.round(F.col("commits") / F.greatest("na", "nb"), 6).alias("strength"))


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in CHANGE_KINDS])


def signal_groups(signals: DataFrame) -> DataFrame:
    """Signals by the file before their first ": ", else by the workspace."""
    at = F.instr("signal", ": ")
    file = F.when(at > 1, F.substring("signal", F.lit(1), at - 1)).otherwise("workspace")
    return signals.groupBy(file.alias("file")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("signal")), "|").alias("signals"))


def severity_summary(findings: DataFrame, by: str) -> DataFrame:
    counts = findings.groupBy(by).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_WEIGHTS])
    score = F.least(F.lit(100), sum((F.col(s) * w for s, w in SEVERITY_WEIGHTS.items()), F.lit(0)))
    level = F.when(F.col("risk_score") >= 80, "critical").when(F.col("risk_score") >= 45, "high").when(F.col("risk_score") >= 15, "medium").otherwise("low")
    return counts.withColumn("risk_score", score).withColumn("risk_level", level)


def hotspots(findings: DataFrame, by: str, n: int) -> DataFrame:
    found = findings.groupBy(by).agg(F.count("*").alias("findings"), F.sum(severity_weight(F.col("severity"))).alias("weight"))
    return found.orderBy(F.desc("weight"), F.desc("findings"), by).limit(n)


def health(checks: DataFrame) -> DataFrame:
    """Mean of the checks' ratios, a check over nothing being whole."""
    score = F.round(F.avg(F.coalesce("ratio", F.lit(1.0))) * 100)
    return checks.agg(score.cast("int").alias("score")).withColumn("status", F.when(F.col("score") >= 80, "healthy").when(F.col("score") >= 50, "degraded").otherwise("unhealthy"))


def community_stats(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Internal and boundary weight of each community, and its three commonest kinds."""
    a = members.select(F.col("id").alias("src"), F.col("community").alias("c"))
    b = members.select(F.col("id").alias("dst"), F.col("community").alias("d"))
    met = edges.join(a, "src").join(b, "dst")
    sides = met.select(F.col("c").alias("community"), "weight", (F.col("c") == F.col("d")).alias("inside")).union(met.where("c <> d").select("d", "weight", F.lit(False)))
    sums = sides.groupBy("community").agg(F.coalesce(F.sum(F.when(F.col("inside"), F.col("weight"))), F.lit(0)).alias("internal"), F.coalesce(F.sum(F.when(~F.col("inside"), F.col("weight"))), F.lit(0)).alias("boundary"))
    kinds = members.groupBy("community", "kind").agg(F.count("*").alias("n"))
    ranked = kinds.withColumn("rn", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "kind"))).where("rn <= 3")
    top = ranked.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "kind"))), lambda x: x["kind"]), ",").alias("kinds"))
    return sums.join(top, "community", "left")


def anchor_composition(edges: DataFrame, kinds: DataFrame, least: int) -> DataFrame:
    """Weighted degree of nodes of ``least`` or more, with the three commonest kinds of their neighbours."""
    ends = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "weight").union(edges.select("dst", "src", "weight"))
    per = ends.join(kinds, "other").groupBy("id", "kind").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    ranked = per.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "kind")))
    shown = F.transform(F.filter(F.sort_array(F.collect_list(F.struct("rn", "kind", "n"))), lambda x: x["rn"] <= 3), lambda x: F.concat_ws(":", x["kind"], x["n"]))
    return ranked.groupBy("id").agg(F.sum("w").alias("weighted"), F.array_join(shown, ",").alias("composition")).where(F.col("weighted") >= least)


def flaky(runs: DataFrame, threshold: float) -> DataFrame:
    """Tests that fail in ``threshold`` of their runs or more, but not in all."""
    out = runs.groupBy("test_id").agg(F.count("*").alias("runs"), F.count_if(~F.col("passed")).alias("failures"), F.round(F.avg(F.when(F.col("passed"), 0.0).otherwise(1.0)), 6).alias("rate"), F.coalesce(F.min(F.when(~F.col("passed"), F.col("attempt"))), F.lit(-1)).alias("first_failure"))
    return out.where((F.col("rate") >= threshold) & (F.col("failures") < F.col("runs")))


def digests(rows: DataFrame, by: list[str], digest: Column) -> DataFrame:
    """Count and digest of each group by a tree over its rows' own hex digests.

    Rows meet in 65,536 buckets by the head of their digest, buckets in the
    group: no task holds a group's rows, however large it is.
    """
    leaves = rows.select(*by, digest.alias("d")).groupBy(*by, F.substring("d", 1, 4).alias("b"))
    inner = leaves.agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("d")), ""), 256).alias("d"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "")
    return inner.groupBy(*by).agg(F.sum("n").alias("files"), F.sha2(joined, 256).alias("digest"))


def validation_counters(outputs: DataFrame) -> DataFrame:
    """Passed and failed counts by the first pattern that matches a runner's output."""

    def number(*patterns: str) -> Column:
        return F.coalesce(*[F.nullif(F.regexp_extract("output", p, 1), F.lit("")) for p in patterns], F.lit("0")).cast("long")

    return outputs.select("id", number(r"([0-9]+) (?:passed|passing)").alias("passed"), number(r"([0-9]+) (?:failed|failing)", r"FAILED ([0-9]+)").alias("failed"), F.regexp_count("output", F.lit("[0-9]+")).alias("numbers"))


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page: only offset + limit rows are ordered."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_cursor(query: str, kind: str, offset: int, digest: str) -> str:
    """An opaque cursor for the page after ``offset`` rows."""
    return base64.urlsafe_b64encode(json.dumps({"query": query, "kind": kind, "offset": offset, "digest": digest}).encode()).decode().rstrip("=")


def cursor_offset(cursor: str | None, query: str, kind: str, digest: str) -> int:
    """The cursor's offset; 0 if it is damaged or of another query or snapshot."""
    try:
        raw = json.loads(base64.urlsafe_b64decode((cursor or "") + "=" * (-len(cursor or "") % 4)))
        same = (raw["query"], raw["kind"], raw["digest"]) == (query, kind, digest)
        return max(0, int(raw["offset"])) if same else 0
    except (ValueError, KeyError, TypeError):
        return 0
