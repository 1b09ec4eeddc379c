"""Test discovery, gap analysis and modernisation on small hand-made repositories."""

import random

import pytest
from pyspark.sql import functions as F

from loomwork.operators import graph as G
from loomwork.operators import modernization as M
from loomwork.operators import testing as T


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("package.json", '{"scripts": {"a": "tsc", "b": "Mocha x", "c": "jest"}, "devDependencies": {"vitest": "1"}}', "mocha"),
        ("package.json", '{"scripts": {"b": "node jest-vitest"}}', "vitest"),
        ("package.json", '{"dependencies": {"mocha": "1"}, "devDependencies": {"@playwright/test": "1"}}', "playwright"),
        ("package.json", "not json", None),
        ("package.json", "{}", None),
        ("pyproject.toml", "[tool.PyTest]", "pytest"),
        ("go.mod", "x gotest.tools/v3", "go-test"),
        ("pom.xml", "<a>surefire</a>", "junit"),
        ("build.gradle", "useJUnitPlatform()", "junit"),
        ("composer.json", '{"require-dev": {"phpunit/phpunit": "9"}}', "phpunit"),
        ("App.csproj", "NUnit", "xunit"),
        ("other.txt", "vitest", None),
        ("package.json", None, None),
    ],
)
def test_manifests(spark, path, text, want):
    df = spark.createDataFrame([(path, text)], "path string, text string").select(T.manifest_framework(F.col("path"), F.col("text")).alias("f"))
    found = df.first().f
    assert (found.framework if found else None) == want


def test_earlier_manifests_win_and_file_names_decide_without_any(spark):
    files = spark.createDataFrame([("a", "x.py"), ("b", "test_x.py"), ("b", "y/z_test.go"), ("c", "y/z_test.go"), ("d", "m/ATest.java"), ("e", "s/q.test.tsx"), ("f", "q.rs"), ("f", "t/test_q.py")], "repo string, path string")
    manifests = spark.createDataFrame([("a", "pom.xml", "junit"), ("a", "pyproject.toml", "pytest"), ("a", "package.json", "{}")], "repo string, path string, text string")
    assert rows(T.frameworks(files, manifests), "repo", "framework") == [("a", "pytest"), ("b", "pytest"), ("c", "go-test"), ("d", "junit"), ("e", "vitest"), ("f", "unknown")]


def test_files_are_split_by_globs_folders_and_extensions(spark):
    paths = ["src/a.ts", "src/deep/x/a.TEST.tsx", "a.spec.js", "lib/a.test.ts", "tests/a.test.py", "node_modules/b.ts", "src/.hid/b.ts", ".b.ts", "dist/b.ts", "src/dist", "readme.md", "src/c.go", "cypress/e2e/a.cy.ts"]
    files = spark.createDataFrame([("r", p) for p in paths], "repo string, path string")
    split = T.split_files(files, spark.createDataFrame([("r", "jest")], "repo string, framework string"))
    got = dict(rows(split, "path", "is_test"))
    assert got == {"src/a.ts": False, "src/deep/x/a.TEST.tsx": True, "a.spec.js": True, "lib/a.test.ts": False, "tests/a.test.py": False, "src/c.go": False}


def _split(spark, pairs):
    return spark.createDataFrame([("r", p, "pytest", t) for p, t in pairs], "repo string, path string, framework string, is_test boolean")


def test_sources_are_mapped_by_prefixes_of_stems_either_way(spark):
    rng = random.Random(1)
    stems = ["a", "ab", "abc", "b", "ba", "Abcd", "test_b", ""]
    tests = [f"t{k}/{rng.choice(stems)}{rng.choice(['.test.py', '.spec.ts', '.py', ''])}" for k in range(6)]
    sources = [f"s{k}/{rng.choice(stems)}.py" for k in range(12)]
    split = _split(spark, [(p, True) for p in tests] + [(p, False) for p in sources])

    def test_stem(p):
        import re

        return re.sub(r"(?i)\.(?:test|spec)$", "", re.sub(r"(?i)\.(?:test|spec)?\.[^.]+$", "", p.split("/")[-1], count=1)).lower()

    want = set()
    for s in sources:
        stem = s.split("/")[-1].rsplit(".", 1)[0].lower()
        # A test without a stem maps every source of a stem; both sides begin with nothing.
        if stem and any(test_stem(t) and (stem.startswith(test_stem(t)) or test_stem(t).startswith(stem)) for t in tests):
            want.add(("r", s))
    assert set(rows(T.mapped_sources(split), "repo", "path")) == want


def test_gaps_of_both_modes(spark):
    split = _split(spark, [("a/x.py", False), ("a/b/y.py", False), ("c/z.py", False), ("w.py", False), ("a/test_q.py", True)])
    risk = spark.createDataFrame([("r", "a/x.py", 0.9, "critical", "high_churn,new_file"), ("r", "c/z.py", 0.1, "none", "")], "repo string, path string, score double, tier string, factors string")
    covered = spark.createDataFrame([("r", "w.py")], "repo string, path string")
    deep = rows(T.gaps(split, covered, risk, quick=False), "path", "type", "severity", "action")
    assert deep == [
        ("a/b/y.py", "uncovered", 0.3, None),
        ("a/b/y.py", "under-tested", 0.4, "Add tests that import and exercise this module"),
        ("a/x.py", "high-risk-no-test", 0.9, "Priority test coverage for x.py"),
        ("a/x.py", "uncovered", 0.9, "Write tests for x.py (risk: critical)"),
        ("a/x.py", "under-tested", 0.4, "Add tests that import and exercise this module"),
        ("c/z.py", "uncovered", 0.5, "Write tests for z.py (risk: none)"),
    ]
    quick = rows(T.gaps(split, covered, risk, quick=True, min_severity=0.5), "path", "type")
    assert ("w.py", "no-coverage-data") in quick and ("a/b/y.py", "uncovered") not in quick and len(quick) == 6
    none = covered.limit(0)
    totals = T.summary(split, risk, covered, none, covered, quick=False)
    assert totals.first().asDict() == {"repo": "r", "framework": "pytest", "tests": 1, "sources": 4, "coverage_ratio": 0.25, "coverage_rate": 0.25, "flaky": 0, "broken": 1, "risk_score": 50}
    advice = rows(T.recommendations(T.gaps(split, covered, risk, quick=False), totals), "place", "title", "affected")
    assert advice == [(0, "3 uncovered source files", "y.py, x.py, z.py"), (1, "1 high-risk files without tests", "x.py"), (2, "1 broken tests", None)]


def test_empty_tables_give_empty_results(spark):
    split = _split(spark, [("a", False)]).limit(0)
    none = split.select("repo", "path")
    risk = T.quick_risk(split)
    assert T.gaps(split, none, risk, quick=True).count() == 0 and T.summary(split, risk, none, none, none, quick=True).count() == 0 and T.mapped_sources(split).count() == 0


def kahn(nodes, edges):
    level, left = {}, set(nodes)
    while True:
        ready = {n for n in left if not any(a in left for a, b in edges if b == n)}
        if not ready:
            return {**level, **dict.fromkeys(left)}
        k = 1 + max(level.values(), default=-1)
        level.update(dict.fromkeys(ready, k))
        left -= ready


@pytest.mark.parametrize("seed", range(3))
def test_layers_match_kahn_and_cycles_have_none(spark, seed):
    rng = random.Random(seed)
    nodes = list(range(25))
    edges = {(rng.randrange(25), rng.randrange(25)) for _ in range(30)}
    df = spark.createDataFrame(sorted(edges) * 2 + [(99, 3)], "src long, dst long")
    got = dict(rows(G.layers(spark.createDataFrame([(n,) for n in nodes], "id long"), df), "id", "level"))
    assert got == kahn(nodes, edges)


def test_components_without_folders_are_the_root(spark):
    files = spark.createDataFrame([("a", "x.py"), ("a", "y.py"), ("b", "m/x.py"), ("b", "z.py")], "repository string, path string")
    uses = spark.createDataFrame([("a", "x.py", "t"), ("a", "y.py", "t"), ("b", "m/x.py", "t")] + [("b", "m/x.py", f"u{k}") for k in range(15)], "repository string, path string, target string")
    assert rows(M.components(files, uses), "repository", "component", "assets", "dependencies", "boundary_risk") == [("a", "a", 2, 1, "low"), ("b", "m", 1, 16, "high")]


def test_a_plan_without_gaps_has_its_first_and_last_phase(spark):
    metrics = spark.createDataFrame([("r",)], "repository string")
    none = spark.createDataFrame([], "repository string, gap string, area string, priority string, effort string")
    assert rows(M.plan_phases(metrics, none), "phase", "needs") == [("phase-1-safety-net", []), ("phase-2-operational-readiness", [])]
    many = spark.createDataFrame([("r", f"g{k}", "api", ["low", "critical"][k % 2], "high") for k in range(12)], none.schema)
    phases = M.plan_phases(metrics, many).orderBy("position").collect()
    assert [p.phase for p in phases[1:7]] == [f"phase-{i + 2}-{g}" for i, g in enumerate(["g1", "g11", "g3", "g5", "g7", "g9"])]
    assert [p.effort for p in phases] == [3, *[10] * 6, 8, 8, 2] and phases[-1].needs == [p.phase for p in phases[1:-1]] and phases[1].strategy == "refactor"
