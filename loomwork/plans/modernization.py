"""Queries of modernisation plans: languages as repositories, their documents as files in folders of their sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import graph as G
from loomwork.operators import modernization as M
from loomwork.operators.relational import local_edges
from loomwork.plans import bindings as B
from loomwork.plans.registry import query
from loomwork.session import table

FRAMEWORKS = [("en", "Express", "web"), ("en", "PostgreSQL", "database"), ("fr", "Spring Boot", "web"), ("de", "React", "ui")]
RISKS = [("en", "weak-ciphers", "security", "critical", 0.5), ("en", "late-queues", "operations", "high", 0.9), ("fr", "old-runtime", "technology-stack", "high", 0.8), ("de", "odd-names", "code", "low", 0.2)]

REPO_SQL = f"""{B.FILES_SQL},
fw AS (SELECT * FROM (VALUES {", ".join(map(repr, FRAMEWORKS))}) v(repository, name, category)),
own AS (SELECT * FROM (VALUES {", ".join(map(repr, RISKS))}) v(repository, risk, area, severity, likelihood)),
f AS (SELECT doc_id, lang AS repository, path, source AS top, ['use_src' || doc_id % 23] AS symbols FROM files),
dep AS (SELECT repository, path, top, 't' || doc_id % 37 AS target FROM f WHERE doc_id % 2 = 0),
m AS (SELECT lang AS repository, count(*) AS files, sum(line_count) // 7 AS symbols, count(*) // 3 AS dependencies, count(*) FILTER (WHERE is_test AND lang <> 'es') AS tests, count(*) FILTER (WHERE doc_id % 97 = 0) AS documentation,
  count(*) FILTER (WHERE doc_id % 11 = 0) AS builds, round(avg(line_count), 2) AS average_lines, max(line_count) AS max_lines, bool_or(doc_id % 50 = 0) AS database FROM files GROUP BY 1),
tops AS (SELECT repository, top, count(*) AS assets FROM f GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY repository ORDER BY top) <= 12),
comp AS (SELECT repository, top AS component, assets, coalesce(uses, 0) AS dependencies FROM tops LEFT JOIN (SELECT repository, top, count(*) AS uses FROM dep GROUP BY 1, 2) USING (repository, top)),
arch AS (SELECT repository, CASE WHEN coalesce(layered, false) THEN 'layered' WHEN n > 1 THEN 'modular-monolith' ELSE 'unknown' END AS style, n AS components, round(least(0.9, 0.45 + n * 0.04 + coalesce(s, 0) * 0.03), 2)::DOUBLE AS confidence
  FROM (SELECT repository, count(*) AS n FROM comp GROUP BY 1) LEFT JOIN (SELECT repository, count(*) AS s, bool_or(lower(name) LIKE '%express%' OR lower(name) LIKE '%spring%') AS layered FROM fw GROUP BY 1) USING (repository)),
risks AS (SELECT repository, 'missing-tests' AS risk, 'testing' AS area, 'critical' AS severity, 0.85 AS likelihood FROM m WHERE tests = 0 UNION ALL SELECT repository, 'missing-docs', 'documentation', 'medium', 0.7 FROM m WHERE documentation = 0
  UNION ALL SELECT repository, 'large-files', 'code', CASE WHEN max_lines > 1000 THEN 'high' ELSE 'medium' END, 0.65 FROM m WHERE max_lines > 500 UNION ALL SELECT repository, 'dependency-volume', 'dependency', 'high', 0.72 FROM m WHERE dependencies > 60
  UNION ALL SELECT repository, 'architecture-unknowns', 'architecture', 'medium', 0.6 FROM m UNION ALL SELECT repository, 'database-coupling', 'database', 'medium', 0.55 FROM m WHERE database),
weights AS (SELECT repository, sum(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS w FROM risks GROUP BY 1),
scored AS (SELECT repository, round(least(100, greatest(0, w * 8 + greatest(0, average_lines - 200) / 8.0 + greatest(0, dependencies - 80) / 5.0))::DOUBLE, 2) AS debt, round(least(100, symbols::DOUBLE / files * 8 + max_lines / 20.0 + dependencies / 3.0)::DOUBLE, 2) AS complexity FROM m JOIN weights USING (repository)),
gap AS (SELECT repository, 'testing-safety-net' AS gap, 'testing' AS area, 'critical' AS priority, 'medium' AS effort, 1 AS o FROM m WHERE tests = 0 UNION ALL SELECT repository, 'documentation-baseline', 'documentation', 'medium', 'low', 2 FROM m WHERE documentation = 0
  UNION ALL SELECT repository, 'dependency-surface', 'dependency', 'high', 'high', 3 FROM m WHERE dependencies > 40 UNION ALL SELECT repository, 'architecture-target', 'architecture', 'high', 'high', 4 FROM m
  UNION ALL SELECT repository, 'risk-' || risk, area, severity, CASE severity WHEN 'critical' THEN 'high' ELSE 'medium' END, 5 FROM own WHERE area IN ('technology-stack', 'security') AND repository IN (SELECT repository FROM m)),
placed AS (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY CASE priority WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, o, gap) + 1 AS position FROM gap QUALIFY position <= 9),
phases AS (SELECT repository AS plan, 'phase-1-safety-net' AS phase, 1 AS position, 'incremental-upgrade' AS strategy, 3 AS effort, '' AS needs, false AS approval FROM m
  UNION ALL SELECT repository, 'phase-' || position || '-' || gap, position, CASE WHEN area = 'architecture' THEN 'strangler-fig' WHEN area IN ('dependency', 'technology-stack') THEN 'incremental-upgrade' WHEN area IN ('api', 'code') THEN 'refactor' WHEN area = 'database' THEN 'replatform' ELSE 'retain' END,
    CASE effort WHEN 'high' THEN 8 WHEN 'medium' THEN 5 ELSE 2 END + greatest(0, CASE priority WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END - 2), 'phase-1-safety-net', priority IN ('high', 'critical') FROM placed
  UNION ALL SELECT m.repository, 'phase-' || (count(gap) + 2) || '-operational-readiness', count(gap) + 2, 'retain', 2, coalesce(string_agg('phase-' || position || '-' || gap, ',' ORDER BY position), ''), true FROM m LEFT JOIN placed USING (repository) GROUP BY 1)"""


def _files(spark, sf):
    d = F.col("doc_id")
    rows = B.files(spark, sf).select("doc_id", F.col("lang").alias("repository"), "path", "source", "line_count", "is_test")
    return rows.withColumn("symbols", F.array(F.concat(F.lit("use_src"), (d % 23).cast("string"))))


def _metrics(files):
    d = F.col("doc_id")
    return files.groupBy("repository").agg(
        F.count("*").alias("files"), F.expr("sum(line_count) div 7").alias("symbols"), F.expr("count(*) div 3").alias("dependencies"), F.count_if(F.col("is_test") & (F.col("repository") != "es")).alias("tests"), F.count_if(d % 97 == 0).alias("documentation"),
        F.count_if(d % 11 == 0).alias("builds"), F.round(F.avg("line_count"), 2).alias("average_lines"), F.max("line_count").alias("max_lines"), F.max(d % 50 == 0).alias("database"),
    )


def _found(spark, sf):
    """Files, components, architecture and metrics of the repositories, and the risks known from elsewhere."""
    files = _files(spark, sf)
    uses = files.where("doc_id % 2 = 0").select("repository", "path", F.concat(F.lit("t"), (F.col("doc_id") % 37).cast("string")).alias("target"))
    parts = M.components(files, uses)
    frameworks = B.literal(spark, "repository string, name string, category string", FRAMEWORKS)
    own = B.literal(spark, "repository string, risk string, area string, severity string, likelihood double", RISKS)
    return files, parts, M.architecture(parts, frameworks), _metrics(files), own


def _gaps(metrics, own):
    return M.gaps(metrics, risks=own.join(metrics, "repository", "left_semi"))


@query("f16_components", f"WITH {REPO_SQL} SELECT *, CASE WHEN dependencies > 15 THEN 'high' WHEN assets > 20 THEN 'medium' ELSE 'low' END AS boundary_risk FROM comp")
def f16_components(spark, sf):
    return _found(spark, sf)[1]


@query("f16_architecture", f"WITH {REPO_SQL} SELECT * FROM arch")
def f16_architecture(spark, sf):
    return _found(spark, sf)[2]


@query("f16_capabilities", f"""WITH {REPO_SQL}, hit AS (SELECT c.repository, component, count(*) AS assets FROM comp c JOIN f ON f.repository = c.repository AND (contains(lower(path), lower(component)) OR contains(lower(symbols[1]), lower(component))) GROUP BY 1, 2)
SELECT repository, upper(component[1]) || component[2:] AS capability, coalesce(h.assets, 1) AS assets, CASE WHEN coalesce(h.assets, 1) > 4 THEN 'high' ELSE 'medium' END AS criticality, 0.6::DOUBLE AS confidence FROM comp LEFT JOIN hit h USING (repository, component)""")
def f16_capabilities(spark, sf):
    files, parts, _, _, _ = _found(spark, sf)
    return M.capabilities(files, parts.select("repository", F.col("component").alias("module")))


@query("f16_targets", f"""WITH {REPO_SQL}, t AS (SELECT repository, 0 AS k, 'target-incremental-modular' AS target, 'modular-monolith' AS style, 100 - debt * 0.35 AS s, 'medium' AS cost, 'low' AS reversibility FROM scored
UNION ALL SELECT repository, 1, 'target-service-oriented', 'service-oriented', CASE WHEN style = 'service-oriented' THEN 70 ELSE 82 - complexity * 0.25 END, 'medium', 'medium' FROM scored JOIN arch USING (repository)
UNION ALL SELECT repository, 2, 'target-strangler', 'microservices', CASE WHEN style = 'microservices' THEN 70 ELSE 82 - complexity * 0.25 END, 'high', 'medium' FROM scored JOIN arch USING (repository))
SELECT repository, (row_number() OVER (PARTITION BY repository ORDER BY round(s::DOUBLE, 2) DESC, k) - 1)::INTEGER AS place, target, style, round(least(100, greatest(0, s))::DOUBLE, 2) AS score, cost, reversibility FROM t""")
def f16_targets(spark, sf):
    _, _, found, metrics, _ = _found(spark, sf)
    return M.targets(M.assess(metrics), found)


@query("f16_plan", f"WITH {REPO_SQL} SELECT plan, phase, position::INTEGER AS position, strategy, effort::INTEGER AS effort, needs, approval FROM phases")
def f16_plan(spark, sf):
    _, _, _, metrics, own = _found(spark, sf)
    return M.plan_phases(metrics, _gaps(metrics, own)).select("plan", "phase", "position", "strategy", "effort", F.array_join("needs", ",").alias("needs"), "approval")


@query("f16_strategy", f"""WITH {REPO_SQL}, r AS (SELECT repository, round(least(100, greatest(0, 100 - (debt * 0.55 + complexity * 0.25) + CASE WHEN tests > 0 THEN 8 ELSE 0 END + CASE WHEN documentation > 0 THEN 5 ELSE 0 END + CASE WHEN builds > 0 THEN 5 ELSE 0 END))::DOUBLE, 2) AS readiness FROM scored JOIN m USING (repository)),
g AS (SELECT repository, bool_or(priority = 'critical') AS critical FROM gap GROUP BY 1)
SELECT repository, CASE WHEN readiness < 35 OR critical THEN 'strangler-fig' WHEN style = 'unknown' THEN 'incremental-upgrade' ELSE 'refactor' END AS strategy FROM r JOIN arch USING (repository) JOIN g USING (repository)""")
def f16_strategy(spark, sf):
    _, _, found, metrics, own = _found(spark, sf)
    return M.strategy(M.assess(metrics), found, _gaps(metrics, own))


@query("f16_plan_layers", f"""WITH {REPO_SQL} SELECT plan || '/' || phase AS id, CASE position WHEN 1 THEN 0 WHEN (SELECT max(position) FROM phases q WHERE q.plan = p.plan) THEN CASE position WHEN 2 THEN 0 ELSE 2 END ELSE 1 END AS level FROM phases p""")
def f16_plan_layers(spark, sf):
    _, _, _, metrics, own = _found(spark, sf)
    phases = M.plan_phases(metrics, _gaps(metrics, own)).select("plan", "needs", F.concat_ws("/", "plan", "phase").alias("id"))
    edges = phases.select(F.explode(F.transform("needs", lambda n: F.concat_ws("/", "plan", n))).alias("src"), F.col("id").alias("dst"))
    return G.layers(phases, edges)


@query("f16_impact", f"""WITH {REPO_SQL}, every AS (SELECT repository, area, severity, likelihood FROM risks UNION ALL SELECT repository, area, severity, likelihood FROM own),
h AS (SELECT repository AS plan, area, sum(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END * likelihood::DOUBLE * 25) AS v FROM every GROUP BY 1, 2)
SELECT plan, count(*) AS phases, {", ".join(f"round(least(100, coalesce((SELECT v FROM h WHERE h.plan = p.plan AND area = '{a}'), 0))::DOUBLE, 6) AS {k}" for k, a in {"architecture": "architecture", "repository": "code", "business": "business-capability", "technology": "technology-stack", "operational": "operations"}.items())}, least(100, sum(effort) * 2)::INTEGER AS migration FROM phases p GROUP BY plan""")
def f16_impact(spark, sf):
    _, _, _, metrics, own = _found(spark, sf)
    every = M.risks(metrics).select("repository", "area", "severity", "likelihood").union(own.select("repository", "area", "severity", "likelihood"))
    return M.impact(M.plan_phases(metrics, _gaps(metrics, own)), every)


@query("f16_dependency_layers", f"""WITH RECURSIVE {B.EDGES_SQL}, dag AS (SELECT DISTINCT src, dst FROM edges WHERE src < dst AND src IN (SELECT p_partkey FROM part) AND dst IN (SELECT p_partkey FROM part)),
up(id, level) AS (SELECT p_partkey, 0 FROM part UNION SELECT dst, level + 1 FROM up JOIN dag ON src = id)
SELECT id, max(level)::INTEGER AS level FROM up GROUP BY id""")
def f16_dependency_layers(spark, sf):
    """Parts in the order that changes of them can follow: a part needs those of smaller keys that come before it."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    edges = local_edges(B.edges(spark, sf).where("src < dst"), parts, key="id")
    return G.layers(parts, edges)
