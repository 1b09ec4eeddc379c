"""Extraction reads the texts once, and no line overflows the matcher's stack or takes more than linear time."""

import time

import pytest

from loomwork.functions import text as X
from loomwork.operators import extract as E
from loomwork.operators import quality as Q
from loomwork.plans.snapshots import snapshot_of

N = 100_000
LONG = {
    "blanks": " " * N,
    "padded": "public" + " " * N + "x",
    "words": "word " * (N // 5),
    "modifiers": "static " * (N // 7),
    "dots": "a." * (N // 2),
    "commas": "a ," * (N // 3),
    "parents": "class A extends " + "b , " * (N // 4),
    "import": "import" + " " * N + "x",
}
LANGUAGES = ["java", "csharp", "css", "haskell", "markdown", "cpp", "c", "vbnet", "javascript", "typescript", "scala", "kotlin"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts") / "texts")
    rows = [("a.ts", "typescript", "import x from 'y'\nexport function f(a) {\n  const b = g(a)\n  return b\n}"), ("m.py", "python", "def f():\n  pass")]
    spark.createDataFrame(rows, "path string, lang string, text string").write.parquet(path)
    return path


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_facts_and_entities_scan_once(spark, stored):
    src = spark.read.parquet(stored)
    for made in (E.facts, E.entities, E.symbols, E.calls, E.imports, E.detect):
        assert scans(made(src)) == 1, made


def test_graph_and_snapshot_scan_few_times(spark, stored):
    src = spark.read.parquet(stored)
    graph = E.property_graph(src)
    assert scans(graph) == 0 and "Python" not in graph._jdf.queryExecution().executedPlan().toString()  # both passes are over
    snapshot = snapshot_of(src)
    assert sum(scans(t) for t in snapshot.values()) == 0 and snapshot["units"].count() > 0


@pytest.mark.parametrize("kind", sorted(LONG))
def test_long_lines_end_soon(spark, kind):
    src = spark.createDataFrame([(f"{x}/f", x, LONG[kind]) for x in LANGUAGES], "path string, lang string, text string").repartition(4)
    began = time.time()
    E.facts(src).collect()
    one = src.where("lang = 'java'")
    E.entities(one).collect()
    E.detect(one).collect()
    Q.scan_lines(E.lines(one).select("path", "line", "code")).collect()
    assert time.time() - began < 90


LINES = [
    ("java", "  public static int foo(int a) {", "method", "foo"),
    ("java", "public static final(x)", "method", "final"),
    ("java", "private   Map<K,V>   get (", "method", "get"),
    ("java", "public foo(", None, None),
    ("c", "static int  *x  bar (int a) {", "function", "bar"),
    ("cpp", "std::vector<int> a::b go(int) const {", "function", "go"),
    ("haskell", "main' args x = y", "function", "main'"),
    ("css", "  .a > b  {", "type", ".a > b  "),
    ("css", " @media x {", "type", " @media x "),
    ("markdown", "##  A title   ", "type", "A title"),
    ("javascript", "  static async get (a) {", "method", "get"),
    ("javascript", "async (x) {", "method", "async"),
    ("typescript", "  private async load(a): Promise<x> {", "method", "load"),
    ("vbnet", "  Public Partial Class Foo", "class", "Foo"),
    ("vbnet", "Private Shared Async Function Bar", "method", "Bar"),
]


@pytest.mark.parametrize(("lang", "line", "kind", "name"), LINES)
def test_safe_forms_find_the_same_names(spark, lang, line, kind, name):
    import re

    src = spark.createDataFrame([("p", lang, line)], "path string, lang string, text string")
    got = {(r.kind, r.name) for r in E.symbols(src).collect()}
    assert ((kind, name) in got) if kind else not got
    for scope, k, pattern in E.SYMBOL_RULES:  # the rule as it is written, by another matcher
        if scope == lang:
            found = re.search(pattern, line)
            if found and found[1] and found[1].lower() not in E.KEYWORDS:
                assert (k, found[1]) in got


def test_script_imports(spark):
    lines = ["import x from 'a'", 'import  type {y} from "b"', "import 'c'", "import type 'd'", "import from 'e'", "import  from 'f'", "import a; import 'g'", "importx 'h'", "import(\"i\")", "import x 'j'", "import x from y from `k`"]
    src = spark.createDataFrame([(f"{k}.ts", "typescript", t) for k, t in enumerate(lines)], "path string, lang string, text string")
    assert {r.target for r in E.imports(src).collect()} == {"a", "b", "c", "d", "f", "g", "k"}


@pytest.mark.parametrize("line", ["map " * (N // 4), "update " * (N // 7), "filter(" * (N // 7), "x " * (N // 2) + "for"])
def test_line_rules_take_linear_time(spark, line):
    began = time.time()
    rows = spark.createDataFrame([("f", 1, line), ("f", 2, line + " for"), ("f", 3, line + " find")], "path string, line int, code string")
    got = {(r.line, r.category) for r in Q.scan_lines(rows).collect()}
    assert time.time() - began < 20
    assert ((2, "nested-iteration") in got) == line.startswith(("map", "filter", "x"))


def test_opening_word_is_any_not_the_first_only(spark):
    rows = [(1, "format for x, filter(y)"), (2, "filter(y) only"), (3, "xmap for y"), (4, "update a; select b + c"), (5, "selected + c"), (6, "a + update")]
    got = Q.scan_lines(spark.createDataFrame([("f", *r) for r in rows], "path string, line int, code string"))
    assert {(r.line, r.category) for r in got.collect() if r.category in ("nested-iteration", "sql-injection")} == {(1, "nested-iteration"), (4, "sql-injection")}


def test_needed_words():
    assert X.needles(r"(?i)\b(?:Emit|send)\s*\(") == (("emit", "send"), ("(",))
    assert X.needles(r"create\s+(?:if\s+)?[xy]{2}|drop") == (("create", "drop"),)
    assert X.needles(r"colou?r") == (("colo",), ("r",)) and X.needles(r"(?:ab)*") == () == X.needles(r"\w+") and X.needles(r"\h+x") == ()
    assert X.needles(r"a(?:b|)c(?!no)") == (("ac", "abc"),) and X.needles(r"(?:foo|\d+)z") == (("z",),)


def test_no_match_is_passed_over():
    import re

    lines = [line for _, line, _, _ in LINES]
    lines += ["select (a) FROM b", "@GetMapping('/x')", "router.get('/a', b)", "Route::get(x)", "for (a) { query(b) }", "MODEL User", "isFeatureEnabled('x')", "A_FLAG_B", "emit(`x`)", "class PayEvent", "CREATE TABLE if not exists a", "const p = (a) => b", "EVAL(x)", "sleep (1)", "json.dumps(rows)"]
    patterns = [r[2] for r in E.SYMBOL_RULES] + E.IMPORT_RULES + [r[0] for r in E.ROUTE_RULES] + [r[2] for r in E.TYPE_RULES] + [r[4] for r in Q.LINE_RULES] + [s for d in E.DETECTORS for s in d[3]] + [E.TABLE, E.MODEL, E.STATEMENT, E.ORM_CALL, E.FLAG_WORD, E.FLAG_CALL, E.EVENT_CALL, E.EVENT_CLASS, E.TEST_LINE, Q.COMMENT]
    seen = 0
    for p in patterns:
        for line in lines:
            if re.search(p, line):
                seen += 1
                assert all(any(w in line.lower() for w in ws) for ws in X.needles(p)), (p, line)
    assert seen > 60


def test_letters_of_any_case_and_script(spark):
    src = spark.createDataFrame([("İ/a", "en", "İß CREATE TABLE ÄX (\nСелект SeLeCt * from İt")], "path string, lang string, text string")
    assert {(r.kind, r.name, r.line) for r in E.entities(src).collect()} >= {("query", "SELECT @ İ/a:2", 2)}


def test_signals_are_made_once(spark, stored):
    plan = E.sensitive(spark.read.parquet(stored))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("([a-z0-9])([A-Z])") == 1
