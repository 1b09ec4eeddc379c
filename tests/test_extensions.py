import pytest
from pyspark.sql import functions as F

from loomwork.operators import extract as E
from loomwork.operators.extensions import Extensions

ROWS = [("a.zig", "zig", "pub fn main"), ("b.py", "python", "import zlib_client\ndef run(x):\n    pass"), ("go.mod", "text", "require zlib_client v1")]


@pytest.fixture
def sources(spark):
    return spark.createDataFrame(ROWS, "path string, lang string, text string")


def test_languages_detectors_and_enrichment(spark, sources):
    own = Extensions()
    own.language("zig", [".zig", ".zig.in"], lambda s: E.lines(s).select("path", "line", F.lit("symbol").alias("fact"), F.regexp_extract("code", r"fn (\w+)", 1).alias("name"), F.lit("zig").alias("detail")))
    own.detector("zlib", ["python"], "framework", [r"zlib_client"]).enricher("sizes", lambda s: s.select("path", F.lit(1).alias("line"), F.lit("size").alias("fact"), F.length("text").cast("string").alias("name"), F.lit("").alias("detail")))
    assert {r.path: r.l for r in sources.select("path", own.identify(F.col("path")).alias("l")).collect()} == {"a.zig": "zig", "b.py": "python", "go.mod": "text"}
    got = {(r.path, r.fact, r.name, r.detail) for r in own.facts(sources).collect()}
    assert ("a.zig", "symbol", "main", "zig") in got and ("b.py", "symbol", "run", "function unknown") in got and ("go.mod", "size", "22", "") in got
    assert ("a.zig", "symbol", "main", "function exported") not in got
    assert sorted(r.path for r in own.detect(sources).where("detector = 'zlib'").collect()) == ["b.py", "go.mod"]  # manifests of any language
    with pytest.raises(ValueError):
        own.detector("zlib", ["python"], "framework", ["x"])


def test_coverage_classifier_and_scorer(spark, sources):
    own = Extensions(classifier=lambda q: ["tests", "nonsense"] if "zz" in q else [])
    own.coverage_format("csv", lambda reports: reports.select("report", F.explode(F.split("json", "\n")).alias("r")).where("r like '%,%,%'").select("report", F.split("r", ",")[0].alias("path"), F.split("r", ",")[1].cast("int").alias("line"), F.split("r", ",")[2].cast("bigint").alias("hits")))
    reports = spark.createDataFrame([("r", "x.py,3,2\nx.py,3,0\nx.py,4,0"), ("s", '{"files": [{"name": "y.js", "lines": [1]}]}')], "report string, json string")
    assert {(r.path, r.line, r.hits) for r in own.line_hits(reports.where("report = 'r'")).collect()} == {("x.py", 3, 2), ("x.py", 4, 0)}
    assert {(r.path, r.line, r.hits) for r in own.line_hits(reports.where("report = 's'")).collect()} >= {("y.js", 1, 1)}
    assert own.intents("zz") == ["tests"] and own.intents("who calls x") == ["callers"]
    own.scorer("length", lambda docs, q: docs.select(F.col("path").alias("id"), F.length("text").cast("double").alias("score")))
    got = [r.id for r in own.retrieve(sources, "zlib_client", "path", "text").collect()]
    assert set(got) == {"a.zig", "b.py", "go.mod"} and got[-1] == "a.zig"
