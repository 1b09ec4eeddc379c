"""Test discovery and gap analysis over many repositories at once.

Every table has a ``repo`` column. Frameworks come from manifests by ordered
rules, or else from the names of files; a repository's tests are the files that a
glob of its framework matches. A gap analysis meets sources with what covers
them, their risk and the folders of tests, in one pass over the sources: every
source makes an array of gaps, exploded once.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import text as X
from loomwork.operators import quality as Q
from loomwork.operators import relational as R
from loomwork.sources.files import glob_regex

#: Globs of test files by framework.
TEST_GLOBS = {
    "vitest": ["tests/**/*.test.{ts,tsx,js,jsx}", "tests/**/*.spec.{ts,tsx,js,jsx}", "src/**/*.test.{ts,tsx,js,jsx}", "src/**/*.spec.{ts,tsx,js,jsx}", "*.spec.{ts,tsx,js,jsx}"],
    "jest": ["tests/**/*.test.{ts,tsx,js,jsx}", "tests/**/*.spec.{ts,tsx,js,jsx}", "src/**/*.test.{ts,tsx,js,jsx}", "src/**/*.spec.{ts,tsx,js,jsx}", "*.spec.{ts,tsx,js,jsx}"],
    "mocha": ["test/**/*.js", "tests/**/*.js", "spec/**/*.js", "test/**/*.ts", "tests/**/*.ts", "spec/**/*.ts"],
    "pytest": ["tests/**/*.py", "*_test.py", "test_*.py"],
    "go-test": ["**/*_test.go"],
    "junit": ["**/*Test.java", "**/*Spec.java", "**/*TestCase.java"],
    "phpunit": ["tests/**/*Test.php"],
    "xunit": ["**/*Test.cs"],
    "cypress": ["cypress/e2e/**/*.cy.{ts,js}", "cypress/integration/**/*.spec.{ts,js}"],
    "playwright": ["tests/**/*.spec.{ts,js}", "e2e/**/*.spec.{ts,js}"],
}
#: Words of a package's scripts, in order, and the framework that each stands for.
SCRIPT_WORDS = [("vitest", "vitest"), ("jest", "jest"), ("cypress", "cypress"), ("playwright", "playwright"), ("mocha", "mocha")]
#: Dependencies of a package, in order.
PACKAGES = [("vitest", "vitest"), ("jest", "jest"), ("cypress", "cypress"), ("@playwright/test", "playwright"), ("mocha", "mocha")]
#: Words of the other manifests, in order of the manifests.
MANIFEST_WORDS = [
    ("pyproject.toml", ["pytest", "[tool.pytest"], "pytest"),
    ("go.mod", ["testing/", "github.com/onsi/ginkgo", "testify", "gotest.tools"], "go-test"),
    ("pom.xml", ["junit", "surefire"], "junit"),
    ("build.gradle", ["junit", "usejunit", "usejunitjupiter"], "junit"),
]
#: Globs that tell a framework where no manifest does, in order.
FALLBACK_GLOBS = [("test_*.py", "pytest"), ("**/*_test.go", "go-test"), ("**/*Test.java", "junit"), ("**/*.test.{ts,tsx,js,jsx}", "vitest")]
#: Extensions of sources and folders that hold none.
SOURCE_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".go", ".java", ".rs", ".rb", ".php", ".cs", ".kt", ".scala"]
NO_SOURCE_FOLDERS = ["node_modules", "bower_components", "dist", "build", "out", "bin", "obj", "vendor", "venv", "env", "site-packages", "coverage", "target", "builds", "cypress"]
#: What the quick analysis takes for every source's risk terms.
QUICK_RISK = {"churn": 0.3, "coupling": 0.2, "coverage": 0.0, "author_share": 0.5, "instability": 0.0, "age_days": 30}

_PACKAGE = "scripts map<string,string>, dependencies map<string,string>, devDependencies map<string,string>"
_COMPOSER = "require map<string,string>, `require-dev` map<string,string>"


def _alternatives(glob: str) -> list[str]:
    """The glob once for each of the names in its braces."""
    found = re.search(r"\{([^}]*)\}", glob)
    return [glob.replace(found[0], x) for x in found[1].split(",")] if found else [glob]


def matches(path: Column, globs: list[str]) -> Column:
    """Does a glob match the whole path, in any letter case; ``{a,b}`` are alternatives."""
    flat = [g for glob in globs for g in _alternatives(glob)]
    return reduce(lambda a, b: a | b, [path.rlike(f"(?i)^{glob_regex(g)}$") for g in flat])


def _first(rules: list[tuple[str, str]], hit) -> Column:
    return F.coalesce(*[F.when(hit(word), F.lit(name)) for word, name in rules])


def manifest_framework(path: Column, text: Column) -> Column:
    """Struct (order, framework) of one manifest, null if it tells none."""
    low = F.lower(text)
    package, composer = F.from_json(text, _PACKAGE), F.from_json(text, _COMPOSER)
    script = lambda v: _first(SCRIPT_WORDS, lambda w: F.lower(v).contains(w))
    by_script = F.try_element_at(F.filter(F.transform(F.map_values(package["scripts"]), script), lambda x: x.isNotNull()), F.lit(1))
    needs = F.concat(*[F.coalesce(F.map_keys(package[k]), F.array().cast("array<string>")) for k in ("dependencies", "devDependencies")])
    by_need = _first(PACKAGES, lambda w: F.array_contains(needs, w))
    php = F.concat(*[F.coalesce(F.map_keys(composer[k]), F.array().cast("array<string>")) for k in ("require", "require-dev")])
    tells = [(path == "package.json", F.coalesce(by_script, by_need))]
    tells += [(path == name, F.when(reduce(lambda a, b: a | b, [low.contains(w) for w in words]), framework)) for name, words, framework in MANIFEST_WORDS]
    tells += [(path == "composer.json", F.when(F.array_contains(php, "phpunit/phpunit"), "phpunit"))]
    tells += [(path.rlike(r"^[^/]*\.csproj$"), F.when(low.contains("xunit") | low.contains("nunit"), "xunit"))]
    found = lambda k, x: F.when(x.isNotNull(), F.struct(F.lit(k).alias("order"), x.alias("framework")))
    return F.coalesce(*[F.when(here, found(k, x)) for k, (here, x) in enumerate(tells)])


def frameworks(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """(repo, framework) of every repository of ``files`` (repo, path); ``manifests`` (repo, path, text) are at their roots.

    The first manifest that tells one decides, or else the first fallback glob that a file matches; "unknown" is neither.
    """
    told = manifests.select("repo", manifest_framework(F.col("path"), F.col("text")).alias("f")).where("f is not null").groupBy("repo").agg(F.min("f").alias("f"))
    order = F.coalesce(*[F.when(matches(F.col("path"), [glob]), k) for k, (glob, _) in enumerate(FALLBACK_GLOBS)])
    seen = files.groupBy("repo").agg(F.min(order).alias("k"))
    named = F.element_at(F.array(*[F.lit(name) for _, name in FALLBACK_GLOBS]), F.col("k") + 1)
    return seen.join(told, "repo", "left").select("repo", F.coalesce("f.framework", F.when(F.col("k").isNotNull(), named), F.lit("unknown")).alias("framework"))


def split_files(files: DataFrame, found: DataFrame) -> DataFrame:
    """(repo, path, framework, is_test) of the tests and sources among ``files`` (repo, path); others go."""
    path = F.col("path")
    test = reduce(lambda rest, x: F.when(F.col("framework") == x[0], matches(path, x[1])).otherwise(rest), TEST_GLOBS.items(), F.lit(False))
    steps = F.split(path, "/")
    hidden = F.exists(steps, lambda s: s.startswith("."))
    folders = F.slice(steps, 1, F.size(steps) - 1)
    source = F.lower(X.extname(path)).isin(SOURCE_EXTENSIONS) & ~hidden & ~F.exists(folders, lambda s: s.isin(NO_SOURCE_FOLDERS))
    return files.select("repo", "path").join(found, "repo").select("repo", "path", "framework", test.alias("is_test"), source.alias("src")).where("is_test or src").drop("src")


def discovery(split: DataFrame) -> DataFrame:
    """(repo, framework, tests, covered_estimate, ratio): seven of ten tests are taken to cover a file each."""
    g = split.where("is_test").groupBy("repo", "framework").agg(F.count("*").alias("tests"))
    covered = F.floor(F.col("tests") * 0.7 + 0.5)
    return g.select("repo", "framework", "tests", covered.cast("long").alias("covered_estimate"), F.round(F.least(covered / F.col("tests"), F.lit(1.0)), 6).alias("ratio"))


def mapped_sources(split: DataFrame) -> DataFrame:
    """(repo, path) of sources whose stem a test's stem begins with, or that begins with a test's stem."""
    bare = F.regexp_replace(X.basename(F.col("path")), r"(?i)\.(?:test|spec)?\.[^.]+$", "")
    tests = split.where("is_test").select("repo", F.lower(F.regexp_replace(bare, r"(?i)\.(?:test|spec)$", "")).alias("stem")).distinct()
    own = F.lower(F.regexp_replace(X.basename(F.col("path")), r"\.[^.]+$", ""))
    sources = split.where("not is_test").select("repo", "path", own.alias("stem")).where("stem <> ''")
    begun = sources.select("repo", "path", F.explode(R.prefixes(F.col("stem"))).alias("stem")).join(tests, ["repo", "stem"], "left_semi")
    begins = sources.join(tests.select("repo", F.explode(R.prefixes(F.col("stem"))).alias("stem")).distinct(), ["repo", "stem"], "left_semi")
    return begun.select("repo", "path").union(begins.select("repo", "path")).distinct()


def gaps(split: DataFrame, covered: DataFrame, risk: DataFrame, *, quick: bool, min_severity: float = 0.1) -> DataFrame:
    """(repo, type, path, severity, reason, action) of the sources of ``split``.

    ``covered`` (repo, path) are sources with a test: by convention in the quick
    analysis, by executed coverage in the deep one. ``risk`` is (repo, path, score, tier, factors).
    """
    name, tier = X.basename(F.col("path")), F.col("tier")
    place = X.dirname(F.col("path"))
    sources = split.where("not is_test").select("repo", "path")
    tested = split.where("is_test").select("repo", X.dirname(F.col("path")).alias("dir")).distinct()
    near = sources.select("repo", "path", F.explode(F.array_distinct(F.array(place, X.dirname(place)))).alias("dir")).join(tested, ["repo", "dir"], "left_semi").select("repo", "path").distinct()
    rows = sources.join(covered.select("repo", "path").distinct().withColumn("has", F.lit(True)), ["repo", "path"], "left")
    rows = rows.join(risk, ["repo", "path"], "left").join(near.withColumn("near", F.lit(True)), ["repo", "path"], "left")

    def gap(when: Column, kind: str, severity: Column, reason: Column, action: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("type"), severity.cast("double").alias("severity"), reason.alias("reason"), action.cast("string").alias("action")))

    bare = F.col("has").isNull()
    severity = F.when(tier.isNull(), 0.3).otherwise(F.greatest(F.col("score"), F.lit(0.5)))
    found = [
        gap(
            bare & (severity >= min_severity), "uncovered", severity,
            F.when(tier.isNull(), F.lit("Source file with no test coverage")).otherwise(F.concat(F.lit("High-risk file ("), tier, F.lit(") with no test coverage"))),
            F.when(tier.isNotNull(), F.concat(F.lit("Write tests for "), name, F.lit(" (risk: "), tier, F.lit(")"))),
        ),
        gap(
            bare & tier.isin("critical", "high"), "high-risk-no-test", F.col("score"),
            F.concat(F.lit("Critical/high risk file ("), tier, F.lit(") without tests: "), F.coalesce(F.regexp_replace("factors", ",", ", "), F.lit(""))),
            F.concat(F.lit("Priority test coverage for "), name),
        ),
        gap(bare & F.col("near").isNotNull(), "under-tested", F.lit(0.4), F.lit("Source file has nearby tests but no direct coverage"), F.lit("Add tests that import and exercise this module")),
    ]
    if quick:
        text = "A mapped test file exists, but executed line-coverage evidence is not available in quick analysis."
        found.append(gap(~bare, "no-coverage-data", F.lit(0.2), F.lit(text), F.lit("Run the relevant test suite with coverage when measured coverage is required.")))
    return rows.select("repo", "path", F.explode(F.array_compact(F.array(*found))).alias("g")).select("repo", "g.type", "path", "g.severity", "g.reason", "g.action")


def quick_risk(split: DataFrame) -> DataFrame:
    """The risk that the quick analysis takes for every source."""
    rows = split.where("not is_test").select("repo", "path", *[F.lit(v).cast("double").alias(k) for k, v in QUICK_RISK.items()])
    return Q.risk(rows.withColumn("at", F.struct("repo", "path")), "at").select("at.repo", "at.path", "score", "tier", "factors")


def covered_lines(coverage: DataFrame, split: DataFrame) -> DataFrame:
    """(repo, path, lines): distinct lines that any test executed, of sources only; ``coverage`` (repo, test, path, line)."""
    merged = coverage.groupBy("repo", "path").agg(F.countDistinct("line").alias("lines"))
    return merged.join(split.where("not is_test").select("repo", "path"), ["repo", "path"], "left_semi")


def summary(split: DataFrame, risk: DataFrame, covered: DataFrame, flaky: DataFrame, broken: DataFrame, *, quick: bool) -> DataFrame:
    """One row a repository: framework, tests, sources, coverage_ratio, coverage_rate, flaky, broken, risk_score.

    ``flaky`` and ``broken`` are (repo, test). The quick rate is that of tests to sources, the deep one of covered sources.
    """
    score = risk.groupBy("repo").agg(F.floor(F.avg("score") * 100 + 0.5).cast("long").alias("risk_score"))
    g = split.groupBy("repo", "framework").agg(F.count_if("is_test").alias("tests"), F.count_if(~F.col("is_test")).alias("sources")).join(score, "repo", "left")
    for name, rows in (("covered", covered), ("flaky", flaky), ("broken", broken)):
        g = g.join(rows.groupBy("repo").agg(F.count("*").alias(name)), "repo", "left")
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("covered", "flaky", "broken", "risk_score")}
    ratio = F.when((F.col("sources") == 0) | (F.col("tests") == 0), 0.0).otherwise(F.least(F.col("tests") / F.col("sources"), F.lit(1.0)))
    rate = ratio if quick else F.when(F.col("sources") == 0, 0.0).otherwise(n["covered"] / F.col("sources"))
    return g.select("repo", "framework", "tests", "sources", F.round(ratio, 6).alias("coverage_ratio"), F.round(rate, 6).alias("coverage_rate"), n["flaky"].alias("flaky"), n["broken"].alias("broken"), n["risk_score"].alias("risk_score"))


def recommendations(found: DataFrame, totals: DataFrame) -> DataFrame:
    """(repo, place, priority, category, title, affected) in the order of a report; up to ten or five affected files by path.

    A repository's kinds of gaps are capped on the map side, so a large one's gaps don't meet in a task.
    """
    kinds = ["uncovered", "high-risk-no-test"]
    some = found.where(F.col("type").isin(kinds)).select("repo", "type", "path")
    counts = some.groupBy("repo").pivot("type", kinds).count()
    top = R.cap_per_key(some, ["repo", "type"], [F.col("path")], 10).groupBy("repo").agg(*[F.array_sort(F.collect_list(F.when(F.col("type") == k, F.col("path")))).alias(f"{k}-files") for k in kinds])
    t = totals.join(counts, "repo", "left").join(top, "repo", "left")
    names = lambda k, n: F.array_join(F.transform(F.slice(F.col(f"`{k}-files`"), 1, n), X.basename), ", ")

    def advice(when: Column, priority: str, category: str, title: Column, affected: Column | None = None) -> Column:
        return F.when(when, F.struct(F.lit(priority).alias("priority"), F.lit(category).alias("category"), title.alias("title"), (F.lit(None).cast("string") if affected is None else affected).alias("affected")))

    n = lambda k: F.coalesce(F.col(f"`{k}`"), F.lit(0))
    made = F.array_compact(F.array(
        advice(n("uncovered") > 0, "high", "coverage", F.concat(n("uncovered"), F.lit(" uncovered source files")), names("uncovered", 10)),
        advice(n("high-risk-no-test") > 0, "high", "risk", F.concat(n("high-risk-no-test"), F.lit(" high-risk files without tests")), names("high-risk-no-test", 5)),
        advice(F.col("framework").isin("vitest", "jest") & (F.col("coverage_rate") < 0.5), "medium", "coverage", F.lit("Low test coverage rate")),
        advice(F.col("flaky") > 0, "medium", "maintenance", F.concat("flaky", F.lit(" flaky tests detected"))),
        advice(F.col("broken") > 0, "high", "quality", F.concat("broken", F.lit(" broken tests"))),
        advice((F.col("tests") == 0) & (F.col("sources") > 0), "high", "coverage", F.lit("No tests discovered")),
    ))
    return t.select("repo", F.posexplode(made).alias("place", "a")).select("repo", "place", "a.*")


def modules(split: DataFrame, covered: DataFrame) -> DataFrame:
    """(repo, dir, sources, covered, ratio, tests) of every folder with a source or a test."""
    met = split.join(covered.select("repo", "path").distinct().withColumn("has", F.lit(True)), ["repo", "path"], "left")
    source = ~F.col("is_test")
    g = met.groupBy("repo", X.dirname(F.col("path")).alias("dir")).agg(F.count_if(source).alias("sources"), F.count_if(source & F.col("has").isNotNull()).alias("covered"), F.count_if("is_test").alias("tests"))
    return g.select("repo", "dir", "sources", "covered", F.round(F.coalesce(F.try_divide("covered", "sources"), F.lit(0.0)), 6).alias("ratio"), "tests")
