"""Queries of test discovery and gap analysis over documents as the files of repositories, and events as runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import aggregates as A
from loomwork.operators import quality as Q
from loomwork.operators import testing as T
from loomwork.plans import bindings as B
from loomwork.plans.registry import query
from loomwork.session import table

WORK_SQL = r"""work AS (
  SELECT doc_id, n_chars, source AS repo, doc_id % 5 = 0 AS t, CASE lang WHEN 'en' THEN 'ts' WHEN 'de' THEN 'py' WHEN 'fr' THEN 'java' ELSE 'go' END AS ext FROM documents),
placed AS (SELECT doc_id, n_chars, repo, CASE ext
    WHEN 'ts' THEN 'src/m' || doc_id % 7 || '/f' || CASE WHEN t THEN doc_id // 3 || '.test.ts' ELSE doc_id || '.ts' END
    WHEN 'py' THEN CASE WHEN t THEN 'tests/test_f' || doc_id // 3 || '.py' ELSE 'src/f' || doc_id || '.py' END
    WHEN 'java' THEN CASE WHEN t THEN 'src/it/F' || doc_id // 3 || 'Test.java' ELSE 'src/main/F' || doc_id || '.java' END
    ELSE 'pkg/m' || doc_id % 7 || '/f' || CASE WHEN t THEN doc_id // 3 || '_test.go' ELSE doc_id || '.go' END END AS path FROM work),
fw AS (SELECT repo, CASE coalesce(try_cast(substr(repo, 4) AS INTEGER), 4) % 5 WHEN 0 THEN 'vitest' WHEN 1 THEN 'pytest' WHEN 2 THEN 'go-test' WHEN 3 THEN 'junit'
    ELSE CASE WHEN bool_or(regexp_matches(path, '^test_[^/]*[.]py$')) THEN 'pytest' WHEN bool_or(path LIKE '%\_test.go' ESCAPE '\') THEN 'go-test'
              WHEN bool_or(path LIKE '%Test.java') THEN 'junit' WHEN bool_or(path LIKE '%.test.ts') THEN 'vitest' ELSE 'unknown' END END AS framework FROM placed GROUP BY repo),
split AS (SELECT doc_id, n_chars, repo, path, framework, CASE framework
    WHEN 'vitest' THEN regexp_matches(path, '^(tests|src)/(.*/)?[^/]*[.](test|spec)[.](ts|tsx|js|jsx)$|^[^/]*[.]spec[.](ts|tsx|js|jsx)$')
    WHEN 'pytest' THEN regexp_matches(path, '^tests/(.*/)?[^/]*[.]py$|^[^/]*_test[.]py$|^test_[^/]*[.]py$')
    WHEN 'go-test' THEN regexp_matches(path, '_test[.]go$') WHEN 'junit' THEN regexp_matches(path, '(Test|Spec|TestCase)[.]java$') ELSE false END AS is_test,
    regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '[^/]*$') AS name FROM placed JOIN fw USING (repo))"""

SOURCE_NO = "coalesce(try_cast(substr(source, 4) as int), 4) % 5"
#: A manifest or two for four of five repositories.
MANIFESTS = [
    (0, "package.json", '{"scripts": {"lint": "eslint .", "test": "vitest run"}, "devDependencies": {"mocha": "1"}}'),
    (0, "pyproject.toml", "[tool.pytest.ini_options]"),
    (1, "package.json", '{"scripts": {"lint": "eslint ."}}'),
    (1, "pyproject.toml", '[project.optional-dependencies]\ntest = ["PyTest"]'),
    (2, "go.mod", "require github.com/stretchr/testify v1.9.0"),
    (3, "pom.xml", "<artifactId>junit-jupiter</artifactId>"),
]


def workspace(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, n_chars, repo, path): documents as files of a repository a source."""
    d, t = F.col("doc_id"), F.col("doc_id") % 5 == 0
    third, deep, n = F.expr("doc_id div 3").cast("string"), (d % 7).cast("string"), d.cast("string")
    f = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    path = (
        F.when(F.col("lang") == "en", f("src/m", deep, "/f", F.when(t, f(third, ".test.ts")).otherwise(f(n, ".ts"))))
        .when(F.col("lang") == "de", F.when(t, f("tests/test_f", third, ".py")).otherwise(f("src/f", n, ".py")))
        .when(F.col("lang") == "fr", F.when(t, f("src/it/F", third, "Test.java")).otherwise(f("src/main/F", n, ".java")))
        .otherwise(f("pkg/m", deep, "/f", F.when(t, f(third, "_test.go")).otherwise(f(n, ".go"))))
    )
    return table(spark, sf, "documents").select("doc_id", "n_chars", F.col("source").alias("repo"), path.alias("path"))


def manifests(spark: SparkSession, sf: str) -> DataFrame:
    """(repo, path, text)"""
    repos = table(spark, sf, "documents").select("source").distinct().withColumn("no", F.expr(SOURCE_NO))
    rules = B.literal(spark, "no int, path string, text string", MANIFESTS)
    return repos.join(F.broadcast(rules), "no").select(F.col("source").alias("repo"), "path", "text")


def split(spark: SparkSession, sf: str) -> DataFrame:
    files = workspace(spark, sf)
    return T.split_files(files, T.frameworks(files, manifests(spark, sf)))


@query("f13_discovery", f"WITH {WORK_SQL} SELECT repo, framework, count(*) AS tests, floor(count(*) * 0.7 + 0.5)::BIGINT AS covered_estimate, round(least(floor(count(*) * 0.7 + 0.5) / count(*), 1.0), 6)::DOUBLE AS ratio FROM split WHERE is_test GROUP BY 1, 2")
def f13_discovery(spark, sf):
    return T.discovery(split(spark, sf))


@query("f13_test_files", f"WITH {WORK_SQL} SELECT repo, framework, path FROM split WHERE is_test")
def f13_test_files(spark, sf):
    return split(spark, sf).where("is_test").select("repo", "framework", "path")


MAPPED_SQL = r"""stems AS (SELECT DISTINCT repo, lower(regexp_replace(regexp_replace(name, '[.](test|spec)?[.][^.]+$', ''), '[.](test|spec)$', '')) AS s FROM split WHERE is_test),
mapped AS (SELECT repo, path FROM (SELECT repo, path, lower(regexp_replace(name, '[.][^.]+$', '')) AS o FROM split WHERE NOT is_test) a
  WHERE EXISTS (SELECT 1 FROM stems b WHERE a.repo = b.repo AND (starts_with(a.o, b.s) OR starts_with(b.s, a.o))))"""
QUICK_SQL = f"""{WORK_SQL}, {MAPPED_SQL},
covered AS (SELECT repo, path, 1 AS lines FROM mapped), flaky AS (SELECT NULL AS repo WHERE false), broken AS (SELECT NULL AS repo WHERE false),
risk AS (SELECT repo, path, round(0.35 * (1 - exp(-0.3 / 30)) + 0.25 / (1 + exp(-0.4)) + 0.15 + 0.1, 6)::DOUBLE AS score, 'medium' AS tier, 'low_coverage' AS factors FROM split WHERE NOT is_test)"""
DEEP_SQL = f"""{WORK_SQL}, {B.RUNS_SQL},
covered AS (SELECT repo, path, count(DISTINCT attempt % 50) AS lines FROM runs JOIN split ON doc_id = test_id + 1 WHERE NOT is_test GROUP BY 1, 2),
flaky AS (SELECT repo, path FROM split JOIN (SELECT test_id FROM runs GROUP BY 1 HAVING avg(CASE WHEN passed THEN 0.0 ELSE 1.0 END) >= 0.2 AND bool_or(passed)) ON test_id = doc_id WHERE is_test),
broken AS (SELECT repo, path FROM split JOIN (SELECT test_id FROM runs GROUP BY 1 HAVING NOT arg_max(passed, attempt)) ON test_id = doc_id WHERE is_test),
terms AS (SELECT repo, path, CASE WHEN n_chars = 0 THEN 0 ELSE 1 - exp(-(n_chars / 80.0) / 30) END AS a, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 / (1 + exp(-2 * (doc_id % 3) / 2.0)) END AS b,
  CASE WHEN doc_id % 10 >= 5 THEN 0 ELSE 1 - (doc_id % 10 / 10.0) / 0.5 END AS c, CASE WHEN doc_id % 10 = 9 THEN 0 ELSE (1 - doc_id % 10 / 10.0) ** 2 END AS d FROM split WHERE NOT is_test),
scored AS (SELECT *, round((0.35 * a + 0.25 * b + 0.15 * c + 0.1 * d)::DOUBLE, 6) AS score FROM terms),
risk AS (SELECT repo, path, score, CASE WHEN score >= 0.8 THEN 'critical' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.4 THEN 'medium' WHEN score >= 0.2 THEN 'low' ELSE 'none' END AS tier,
  array_to_string([v FOR v IN [CASE WHEN round(a::DOUBLE, 6) > 0.7 THEN 'high_churn' END, CASE WHEN round(b::DOUBLE, 6) > 0.7 THEN 'high_coupling' END, CASE WHEN round(c::DOUBLE, 6) > 0.7 THEN 'low_coverage' END] IF v IS NOT NULL], ',') AS factors FROM scored)"""
_QUICK_GAP = "UNION ALL SELECT repo, 'no-coverage-data', path, 0.2, 'A mapped test file exists, but executed line-coverage evidence is not available in quick analysis.', 'Run the relevant test suite with coverage when measured coverage is required.' FROM covered"


def _gaps_sql(base: str, quick: str = "") -> str:
    return f"""{base}, bare AS (SELECT * FROM split WHERE NOT is_test AND (repo, path) NOT IN (SELECT repo, path FROM covered)), tested AS (SELECT DISTINCT repo, dir FROM split WHERE is_test),
gaps AS (SELECT repo, 'uncovered' AS type, path, greatest(score, 0.5)::DOUBLE AS severity, 'High-risk file (' || tier || ') with no test coverage' AS reason, 'Write tests for ' || name || ' (risk: ' || tier || ')' AS action FROM bare JOIN risk USING (repo, path)
UNION ALL SELECT repo, 'high-risk-no-test', path, score, 'Critical/high risk file (' || tier || ') without tests: ' || replace(factors, ',', ', '), 'Priority test coverage for ' || name FROM bare JOIN risk USING (repo, path) WHERE tier IN ('critical', 'high')
UNION ALL SELECT repo, 'under-tested', path, 0.4, 'Source file has nearby tests but no direct coverage', 'Add tests that import and exercise this module' FROM bare x
  WHERE EXISTS (SELECT 1 FROM tested t WHERE t.repo = x.repo AND (t.dir = x.dir OR t.dir = CASE WHEN x.dir LIKE '%/%' THEN regexp_replace(x.dir, '/[^/]*$', '') ELSE '.' END)) {quick})"""


def _totals_sql(rate: str) -> str:
    return f"""totals AS (SELECT repo, framework, tests, sources, round(CASE WHEN sources = 0 OR tests = 0 THEN 0 ELSE least(tests / sources, 1.0) END, 6)::DOUBLE AS coverage_ratio, round({rate}, 6)::DOUBLE AS coverage_rate, flaky, broken, coalesce(risk_score, 0) AS risk_score
FROM (SELECT repo, framework, count(*) FILTER (WHERE is_test) AS tests, count(*) FILTER (WHERE NOT is_test) AS sources FROM split GROUP BY 1, 2)
LEFT JOIN (SELECT repo, floor(avg(score) * 100 + 0.5)::BIGINT AS risk_score FROM risk GROUP BY 1) USING (repo)
LEFT JOIN (SELECT s.repo, (SELECT count(*) FROM covered c WHERE c.repo = s.repo) AS covered, (SELECT count(*) FROM flaky c WHERE c.repo = s.repo) AS flaky, (SELECT count(*) FROM broken c WHERE c.repo = s.repo) AS broken FROM (SELECT DISTINCT repo FROM split) s) USING (repo))"""


_QUICK_RATE = "CASE WHEN sources = 0 OR tests = 0 THEN 0 ELSE least(tests / sources, 1.0) END"
_DEEP_RATE = "CASE WHEN sources = 0 THEN 0 ELSE covered / sources END"


def quick(spark, sf):
    files = split(spark, sf)
    return files, T.mapped_sources(files), T.quick_risk(files)


def deep(spark, sf):
    """Files, covered sources, risk, and flaky and broken tests; an event of a user is a run of the test of that id, and covers the next file."""
    placed = workspace(spark, sf)
    files = T.split_files(placed, T.frameworks(placed, manifests(spark, sf)))
    runs = B.runs(spark, sf)
    hits = runs.select((F.col("test_id") + 1).alias("doc_id"), F.col("test_id").alias("test"), (F.col("attempt") % 50).alias("line"))
    covered = T.covered_lines(hits.join(placed, "doc_id").select("repo", "test", "path", "line"), files)
    d = F.col("doc_id")
    rows = placed.join(files.where("not is_test"), ["repo", "path"], "left_semi").select(
        F.struct("repo", "path").alias("at"), (F.col("n_chars") / 80.0).alias("churn"), ((d % 3) / 2.0).alias("coupling"), ((d % 10) / 10.0).alias("coverage"), F.lit(0.5).alias("author_share"), F.lit(0.0).alias("instability"), F.lit(30).alias("age_days")
    )
    risk = Q.risk(rows, "at").select("at.repo", "at.path", "score", "tier", "factors")
    tests = placed.join(files.where("is_test").select("repo", "path"), ["repo", "path"], "left_semi").select("repo", "path", d.alias("test_id"))
    flaky = A.flaky(runs, 0.2).join(tests, "test_id").select("repo", "path")
    last = runs.groupBy("test_id").agg(F.max_by("passed", "attempt").alias("passed")).where("not passed")
    return files, covered, risk, flaky, last.join(tests, "test_id").select("repo", "path")


@query("f12_quick_gaps", f"WITH {_gaps_sql(QUICK_SQL, _QUICK_GAP)} SELECT * FROM gaps")
def f12_quick_gaps(spark, sf):
    files, mapped, risk = quick(spark, sf)
    return T.gaps(files, mapped, risk, quick=True)


@query("f12_deep_gaps", f"WITH {_gaps_sql(DEEP_SQL)} SELECT * FROM gaps")
def f12_deep_gaps(spark, sf):
    files, covered, risk, _, _ = deep(spark, sf)
    return T.gaps(files, covered, risk, quick=False)


@query("f12_quick_summary", f"WITH {QUICK_SQL}, {_totals_sql(_QUICK_RATE)} SELECT * FROM totals")
def f12_quick_summary(spark, sf):
    files, mapped, risk = quick(spark, sf)
    none = files.select("repo", "path").limit(0)
    return T.summary(files, risk, mapped, none, none, quick=True)


@query("f12_deep_summary", f"WITH {DEEP_SQL}, {_totals_sql(_DEEP_RATE)} SELECT * FROM totals")
def f12_deep_summary(spark, sf):
    files, covered, risk, flaky, broken = deep(spark, sf)
    return T.summary(files, risk, covered, flaky, broken, quick=False)


@query("f12_deep_recommendations", f"""WITH {_gaps_sql(DEEP_SQL)}, {_totals_sql(_DEEP_RATE)},
g AS (SELECT repo, type, count(*) AS n, array_to_string(list_transform(list_sort(list(path))[1:CASE type WHEN 'uncovered' THEN 10 ELSE 5 END], lambda p: regexp_extract(p, '[^/]*$')), ', ') AS affected FROM gaps WHERE type IN ('uncovered', 'high-risk-no-test') GROUP BY 1, 2),
r AS (SELECT repo, 1 AS k, 'high' AS priority, 'coverage' AS category, n || ' uncovered source files' AS title, affected FROM g WHERE type = 'uncovered'
UNION ALL SELECT repo, 2, 'high', 'risk', n || ' high-risk files without tests', affected FROM g WHERE type = 'high-risk-no-test'
UNION ALL SELECT repo, 3, 'medium', 'coverage', 'Low test coverage rate', NULL FROM totals WHERE framework IN ('vitest', 'jest') AND coverage_rate < 0.5
UNION ALL SELECT repo, 4, 'medium', 'maintenance', flaky || ' flaky tests detected', NULL FROM totals WHERE flaky > 0
UNION ALL SELECT repo, 5, 'high', 'quality', broken || ' broken tests', NULL FROM totals WHERE broken > 0
UNION ALL SELECT repo, 6, 'high', 'coverage', 'No tests discovered', NULL FROM totals WHERE tests = 0 AND sources > 0)
SELECT repo, (row_number() OVER (PARTITION BY repo ORDER BY k) - 1)::INTEGER AS place, priority, category, title, affected FROM r""")
def f12_deep_recommendations(spark, sf):
    files, covered, risk, flaky, broken = deep(spark, sf)
    return T.recommendations(T.gaps(files, covered, risk, quick=False), T.summary(files, risk, covered, flaky, broken, quick=False))


@query("f12_modules", f"""WITH {DEEP_SQL} SELECT repo, dir, count(*) FILTER (WHERE NOT is_test) AS sources, count(*) FILTER (WHERE NOT is_test AND lines IS NOT NULL) AS covered,
round(coalesce(count(*) FILTER (WHERE NOT is_test AND lines IS NOT NULL) / nullif(count(*) FILTER (WHERE NOT is_test), 0), 0), 6)::DOUBLE AS ratio, count(*) FILTER (WHERE is_test) AS tests FROM split LEFT JOIN covered USING (repo, path) GROUP BY 1, 2""")
def f12_modules(spark, sf):
    files, covered, _, _, _ = deep(spark, sf)
    return T.modules(files, covered)
