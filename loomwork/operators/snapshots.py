"""Knowledge snapshots: four tables and a manifest, built, validated, published and compared.

A snapshot is (units, relationships, observations, evidence). Rules of a valid
one are data; a validation is the union of its violation queries. Publishing
writes a run's folder first and moves a pointer last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import text as X
from loomwork.session import schema

TABLES = ["units", "relationships", "observations", "evidence"]
UNIT = schema("id string, kind string, name string, description string, canonical_key string, path string, properties string, confidence double, lifecycle string")
RELATIONSHIP = schema("id string, kind string, source_id string, target_id string, origin string, confidence double, lifecycle string")
OBSERVATION = schema("id string, subject_id string, predicate string, value string, value_type string")
EVIDENCE = schema("id string, extractor string, path string, line int, digest string, freshness string")

#: Kinds of units and the ends that relationships allow.
UNIT_KINDS = [
    "repository", "workspace", "file", "module", "package", "service", "symbol", "api", "data-entity", "configuration", "test", "documentation", "call-flow", "data-flow",
    "architecture-boundary", "risk-area", "change-impact", "database", "table", "orm-entity", "query", "feature-flag", "fixture", "ci-cd", "infrastructure", "component", "event",
    "build-system", "package-manager", "route", "controller", "middleware", "handler", "entity", "migration", "contract", "message", "consumer", "producer",
]
#: Own kinds besides.
UNIT_KINDS += ["external-dependency", "decision", "project"]
_STORED = ["data-entity", "database", "table", "orm-entity", "query", "configuration", "feature-flag", "file"]
_TESTED = ["file", "symbol", "api", "service", "configuration", "data-entity", "database", "table", "orm-entity", "query", "fixture", "module"]
ENDPOINTS = {
    "contains": (["workspace", "repository", "module", "package", "service", "architecture-boundary", "component", "database", "table", "ci-cd", "infrastructure"], UNIT_KINDS),
    "defines": (
        ["file", "test", "documentation", "configuration", "module", "service", "component", "database", "table", "ci-cd", "infrastructure", "build-system", "package-manager"],
        ["module", "package", "symbol", "api", "data-entity", "service", "call-flow", "data-flow", "database", "table", "orm-entity", "query", "feature-flag", "fixture", "ci-cd", "infrastructure", "component", "event", "build-system", "package-manager", "route", "controller", "middleware", "handler", "repository", "entity", "migration", "contract", "message", "consumer", "producer"],
    ),
    "imports": (["file", "test", "module", "configuration"], ["file", "test", "module", "package", "configuration", "package-manager", "build-system", "ci-cd", "infrastructure"]),
    "depends-on": (UNIT_KINDS, UNIT_KINDS),
    "calls": (["symbol", "api", "call-flow"], ["symbol", "api", "service", "call-flow"]),
    "reads": (["symbol", "api", "service", "data-flow", "query"], _STORED),
    "writes": (["symbol", "api", "service", "data-flow", "query"], _STORED),
    "exposes": (["file", "service", "module", "component", "controller"], ["api", "event", "component", "route"]),
    "implements": (["symbol", "service"], ["symbol", "architecture-boundary"]),
    "extends": (["symbol"], ["symbol"]),
    "tests": (["test"], _TESTED),
    "covers": (["test"], _TESTED),
    "configured-by": (UNIT_KINDS, ["configuration", "feature-flag", "ci-cd", "infrastructure"]),
    "documented-by": (UNIT_KINDS, ["documentation"]),
    "flows-to": (["call-flow", "data-flow", "api", "service", "symbol", "file", "data-entity", "query", "component", "event"], UNIT_KINDS),
    "may-impact": (["change-impact", "risk-area", "file", "symbol", "service", "component", "database", "table", "query"], UNIT_KINDS),
    "maps-to": (["orm-entity", "query", "component"], ["table", "database", "data-entity", "service"]),
}


def unit_id(kind: Column, key: Column) -> Column:
    return X.stable_id("lw:unit:", F.lit("workspace"), kind, key)


def build(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> dict[str, DataFrame]:
    """Snapshot tables from facts: files (path, lang, content_hash, is_test), symbols (path, name, line), imports (path, target).

    An import whose end isn't a file becomes a dependency on an external unit.
    """
    f = files.select(F.when(F.col("is_test"), "test").otherwise("file").alias("kind"), F.col("path").alias("name"), F.lit(None).cast("string").alias("description"), F.col("path").alias("canonical_key"), "path", F.to_json(F.struct("lang")).alias("properties"), F.lit(1.0).alias("confidence"))
    s = symbols.select(F.lit("symbol").alias("kind"), "name", F.lit(None).cast("string").alias("description"), F.concat_ws("#", "path", "name").alias("canonical_key"), "path", F.to_json(F.struct("line")).alias("properties"), F.lit(0.9).alias("confidence")).dropDuplicates(["canonical_key"])
    known = files.select(F.col("path").alias("target")).withColumn("hit", F.lit(True))
    met = imports.join(known, "target", "left")
    x = met.where("hit is null").select("target").distinct().select(F.lit("external-dependency").alias("kind"), F.col("target").alias("name"), F.lit(None).cast("string").alias("description"), F.concat(F.lit("external:"), "target").alias("canonical_key"), F.lit(None).cast("string").alias("path"), F.lit("{}").alias("properties"), F.lit(0.6).alias("confidence"))
    units = f.union(s).union(x).select(unit_id(F.col("kind"), F.col("canonical_key")).alias("id"), "*").withColumn("lifecycle", F.lit("active"))
    kinds = files.select("path", F.when(F.col("is_test"), "test").otherwise("file").alias("k"))
    source = unit_id(F.col("k"), F.col("path"))
    inside = met.join(kinds, "path").where("hit").join(kinds.select(F.col("path").alias("target"), F.col("k").alias("tk")), "target")
    local = inside.select(F.lit("imports").alias("kind"), source.alias("source_id"), unit_id(F.col("tk"), F.col("target")).alias("target_id"), F.lit("RESOLVED").alias("origin"), F.lit(0.95).alias("confidence"))
    outside = met.where("hit is null").join(kinds, "path").select(F.lit("depends-on").alias("kind"), source.alias("source_id"), unit_id(F.lit("external-dependency"), F.concat(F.lit("external:"), "target")).alias("target_id"), F.lit("INFERRED").alias("origin"), F.lit(0.6).alias("confidence"))
    defined = symbols.join(kinds, "path").select(F.lit("defines").alias("kind"), source.alias("source_id"), unit_id(F.lit("symbol"), F.concat_ws("#", "path", "name")).alias("target_id"), F.lit("EXTRACTED").alias("origin"), F.lit(1.0).alias("confidence"))
    rels = local.union(outside).union(defined).distinct()
    rels = rels.select(X.stable_id("lw:rel:", F.concat(F.col("kind"), F.lit(":"), F.col("source_id"), F.lit("->"), F.col("target_id"))).alias("id"), "*").withColumn("lifecycle", F.lit("active"))
    unresolved = met.where("hit is null").join(kinds, "path").select(source.alias("subject_id"), F.lit("unresolved-import").alias("predicate"), F.col("target").alias("value"), F.lit("string").alias("value_type")).distinct()
    obs = unresolved.select(X.stable_id("lw:obs:", F.col("subject_id"), F.col("predicate"), F.col("value")).alias("id"), "*")
    ev = files.select(X.stable_id("lw:ev:", F.col("path")).alias("id"), F.lit("files").alias("extractor"), "path", F.lit(1).alias("line"), F.col("content_hash").alias("digest"), F.lit("current").alias("freshness"))
    return {"units": units, "relationships": rels, "observations": obs, "evidence": ev}


def with_facts(snapshot: dict[str, DataFrame], files: DataFrame, symbols: DataFrame, imports: DataFrame, *, calls: DataFrame, types: DataFrame, routes: DataFrame, tests: DataFrame, entities: DataFrame) -> dict[str, DataFrame]:
    """The snapshot of ``build`` with the other facts of its files.

    Calls and type relations link symbols: of the file, else the only ones of
    their name. Routes are exposed by their file. Test cases test what their
    file imports. Entities are defined by their file, or depended on where a
    definition isn't allowed. Each fact has its evidence.
    """
    none = F.lit(None).cast("string")
    kinds = files.select("path", F.when(F.col("is_test"), "test").otherwise("file").alias("k"))
    file_id = unit_id(F.col("k"), F.col("path"))

    def units_of(rows: DataFrame, kind: Column, name: Column, key: Column, confidence: float, detail: Column) -> DataFrame:
        return rows.select(kind.alias("kind"), name.alias("name"), none.alias("description"), key.alias("canonical_key"), "path", F.to_json(F.struct("line", detail.alias("detail"))).alias("properties"), F.lit(confidence).alias("confidence")).dropDuplicates(["kind", "canonical_key"])

    route_key = F.concat("method", F.lit(" "), "route", F.lit("@"), "path")
    case_key = F.concat_ws("::", "path", "name")
    entity_key = F.concat(F.lower("name"), F.lit("@"), "path")
    known = entities.where(F.col("kind").isin(UNIT_KINDS))
    found = [
        units_of(routes, F.lit("route"), F.concat_ws(" ", "method", "route"), route_key, 0.86, F.lit("")),
        units_of(tests, F.lit("test"), F.col("name"), case_key, 0.8, F.lit("")),
        units_of(known, F.col("kind"), F.col("name"), entity_key, 0.72, F.col("detail")),
    ]
    units = reduce(DataFrame.union, found).select(unit_id(F.col("kind"), F.col("canonical_key")).alias("id"), "*").withColumn("lifecycle", F.lit("active"))

    named = symbols.select("path", "name").distinct()
    only = named.groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("at")).where("n = 1").drop("n")

    def linked(rows: DataFrame) -> DataFrame:
        """Relations (kind, path, source, target) between symbols, by name."""
        own = named.select("path", F.col("name").alias("target"), F.lit(True).alias("here"))
        met = rows.join(named.select("path", F.col("name").alias("source")), ["path", "source"], "left_semi").join(own, ["path", "target"], "left").join(only.withColumnRenamed("name", "target"), "target", "left")
        at = F.when(F.col("here"), F.col("path")).otherwise(F.col("at"))
        met = met.withColumn("to", at).where("`to` is not null")
        ends = [unit_id(F.lit("symbol"), F.concat_ws("#", "path", "source")), unit_id(F.lit("symbol"), F.concat_ws("#", "to", "target"))]
        return met.select("kind", ends[0].alias("source_id"), ends[1].alias("target_id"), F.lit("RESOLVED").alias("origin"), F.when(F.col("here"), 0.9).otherwise(0.7).alias("confidence"))

    last = F.element_at(F.split("callee", r"\."), -1)
    one = lambda rows, kind, target, origin, confidence: rows.join(kinds, "path").select(kind.alias("kind"), file_id.alias("source_id"), target.alias("target_id"), F.lit(origin).alias("origin"), F.lit(confidence).alias("confidence"))
    targets = imports.select("path", "target").join(kinds.select(F.col("path").alias("target"), F.col("k").alias("tk")).where("tk = 'file'"), "target")
    defined = F.when(F.col("kind").isin(ENDPOINTS["defines"][1]), "defines").otherwise("depends-on")
    rels = reduce(DataFrame.union, [
        linked(calls.select(F.lit("calls").alias("kind"), "path", F.col("caller").alias("source"), last.alias("target"))),
        linked(types.select("kind", "path", "source", "target")),
        one(routes, F.lit("exposes"), unit_id(F.lit("route"), route_key), "EXTRACTED", 0.86),
        tests.join(targets, "path").select(F.lit("tests").alias("kind"), unit_id(F.lit("test"), case_key).alias("source_id"), unit_id(F.col("tk"), F.col("target")).alias("target_id"), F.lit("INFERRED").alias("origin"), F.lit(0.8).alias("confidence")),
        one(known, defined, unit_id(F.col("kind"), entity_key), "EXTRACTED", 0.72),
    ]).groupBy("kind", "source_id", "target_id").agg(F.max_by("origin", "confidence").alias("origin"), F.max("confidence").alias("confidence"))
    rels = rels.select(X.stable_id("lw:rel:", F.concat(F.col("kind"), F.lit(":"), F.col("source_id"), F.lit("->"), F.col("target_id"))).alias("id"), "*").withColumn("lifecycle", F.lit("active"))
    every = DataFrame.unionByName(snapshot["units"], units)
    facts = [("symbols", symbols), ("routes", routes), ("tests", tests), ("entities", known)]
    lines = reduce(DataFrame.union, [rows.select(F.lit(extractor).alias("extractor"), "path", F.col("line").cast("int").alias("line")) for extractor, rows in facts]).distinct()
    seen = lines.join(files.select("path", F.col("content_hash").alias("digest")), "path").select(X.stable_id("lw:ev:", F.concat_ws("|", "extractor", "path", F.col("line").cast("string"))).alias("id"), "extractor", "path", "line", "digest", F.lit("current").alias("freshness"))
    joined = downgraded(snapshot["relationships"].unionByName(rels.select(snapshot["relationships"].columns)), every)
    return {**snapshot, "units": every, "relationships": joined, "evidence": snapshot["evidence"].unionByName(seen)}


def downgraded(rels: DataFrame, units: DataFrame) -> DataFrame:
    """Relations whose ends their kind doesn't allow become dependencies, each once."""
    a, b = units.select(F.col("id").alias("source_id"), F.col("kind").alias("sk")), units.select(F.col("id").alias("target_id"), F.col("kind").alias("tk"))
    met = rels.join(a, "source_id").join(b, "target_id")
    wrong = reduce(lambda x, y: x | y, [(F.col("kind") == k) & ~(F.col("sk").isin(s) & F.col("tk").isin(t)) for k, (s, t) in ENDPOINTS.items()])
    made = met.withColumn("kind", F.when(wrong, "depends-on").otherwise(F.col("kind"))).withColumn("id", X.stable_id("lw:rel:", F.concat(F.col("kind"), F.lit(":"), F.col("source_id"), F.lit("->"), F.col("target_id"))))
    return made.select(rels.columns).dropDuplicates(["id"])


def violations(snapshot: dict[str, DataFrame]) -> DataFrame:
    """(path, message) of everything a valid snapshot must not have; empty if it is valid.

    What a row shows is found in one pass over its table. One aggregate of the units by id tells repeated ids and both ends
    of relationships; of an id with several kinds the least is that of the end.
    """
    u, r = snapshot["units"], snapshot["relationships"]
    said = lambda checks: F.explode(F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), message) for when, message in checks]))).alias("message")
    at = lambda where: F.concat(F.lit(f"{where}/"), F.coalesce("id", F.lit("?"))).alias("path")
    missing = lambda *names: reduce(lambda x, y: x | y, [F.col(n).isNull() for n in names])
    both = [(~F.col("confidence").between(0, 1), "confidence out of range"), (~F.col("lifecycle").isin("active", "deprecated", "deleted"), "unknown lifecycle")]
    of_units = u.select(at("units"), said([(missing("id", "kind", "name", "canonical_key"), "required field is missing"), (~F.col("kind").isin(UNIT_KINDS), "unknown kind"), *both]))
    ids = u.groupBy("id").agg(F.count("*").alias("n"), F.min("kind").alias("kind"))
    keys = u.where("lifecycle = 'active'").groupBy("kind", "canonical_key").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    ends = [ids.select(F.col("id").alias(f"{end}_id"), F.col("n").alias(f"{end}_n"), F.col("kind").alias(f"{end}_kind")) for end in ("source", "target")]
    met = r.join(ends[0], "source_id", "left").join(ends[1], "target_id", "left")
    wrong = reduce(lambda x, y: x | y, [(F.col("kind") == k) & ~(F.col("source_kind").isin(s) & F.col("target_kind").isin(t)) for k, (s, t) in ENDPOINTS.items()])
    known = F.col("source_n").isNotNull() & F.col("target_n").isNotNull()
    of_relations = met.select(at("relationships"), said([
        (missing("id", "source_id", "target_id"), "required field is missing"), *both, (F.col("source_n").isNull(), "source_id does not exist"), (F.col("target_n").isNull(), "target_id does not exist"), (known & wrong, "endpoint kinds are not allowed"),
    ]))
    twice = lambda rows, where, message: rows.where("n > 1").select(at(where), F.lit(message).alias("message"))
    repeated = [twice(ids, "units", "duplicate id"), twice(r.groupBy("id").agg(F.count("*").alias("n")), "relationships", "duplicate id"), twice(keys, "units", "active canonical key is not unique")]
    return reduce(DataFrame.union, [of_units, of_relations, *repeated])


def downgrade(rels: DataFrame, units: DataFrame) -> DataFrame:
    """Imports whose ends are not allowed become dependencies."""
    a, b = units.select(F.col("id").alias("source_id"), F.col("kind").alias("sk")), units.select(F.col("id").alias("target_id"), F.col("kind").alias("tk"))
    s, t = ENDPOINTS["imports"]
    kind = F.when((F.col("kind") == "imports") & ~(F.col("sk").isin(s) & F.col("tk").isin(t)), "depends-on").otherwise(F.col("kind"))
    return rels.join(a, "source_id").join(b, "target_id").withColumn("kind", kind).drop("sk", "tk")


def manifest(snapshot: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, digest): counts and order-free digests of the tables, without bringing rows together."""

    def one(name: str) -> DataFrame:
        rows = snapshot[name]
        h = [F.xxhash64(F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(rows.columns)]) for seed in (1, 2)]
        sums = [F.sum(x.cast("decimal(38,0)")) for x in h]
        return rows.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws("|", *[F.coalesce(s, F.lit(0)).cast("string") for s in sums]), 256).alias("digest")).select(F.lit(name).alias("name"), "rows", "digest")

    return reduce(DataFrame.union, [one(n) for n in TABLES])


def plan_update(changes: DataFrame) -> DataFrame:
    """(action, meaningful, structural, files): how much must be rebuilt after ``changes`` (path, kind)."""
    n = changes.agg(F.count_if(F.col("kind") != "unchanged").alias("meaningful"), F.count_if(F.col("kind").isin("structural", "added", "deleted")).alias("structural"), F.count_if(F.col("kind") != "deleted").alias("files"))
    s, ratio = F.col("structural"), F.col("structural") / F.greatest("files", F.lit(1))
    action = F.when(F.col("meaningful") == 0, "skip").when(s == 0, "file-local").when((s > 30) | (ratio > 0.5), "full").when(s > 10, "architecture").otherwise("graph")
    return n.select(action.alias("action"), "meaningful", "structural", "files")


def misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (path, content_hash, version) without a cached extraction."""
    return files.join(cache, ["path", "content_hash", "version"], "left_anti")


def stale(captured: DataFrame, current: DataFrame) -> DataFrame:
    """Captured rows (path, content_hash) whose file has changed or is gone."""
    now = current.select("path", F.col("content_hash").alias("now"))
    return captured.join(now, "path", "left").where("now is null or now <> content_hash").drop("now")


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    return {n: spark.createDataFrame([], s) for n, s in zip(TABLES, (UNIT, RELATIONSHIP, OBSERVATION, EVIDENCE), strict=True)}


#: What makes a file a configuration, and a statement one that writes.
CONFIGURATION_LANGUAGES = ["json", "yaml", "toml", "xml"]
CONFIGURATION_PATH = r"(?i)(?:^|/)(?:package\.json|tsconfig.*\.json|.*\.ya?ml|.*\.toml|.*\.properties|Dockerfile|Makefile)$"
WRITES = r"^(?:insert|update|delete|merge|writ)"


def file_kind(path: Column, lang: Column, is_test: Column) -> Column:
    """The kind of unit that a file is."""
    configured = lang.isin(CONFIGURATION_LANGUAGES) | path.rlike(CONFIGURATION_PATH)
    return F.when(lang == "markdown", "documentation").when(is_test, "test").when(configured, "configuration").otherwise("file")


def structure(files: DataFrame, entities: DataFrame, flows: DataFrame) -> DataFrame:
    """(kind, source, target) between units by kind and key: what holds, configures and documents the repository, what
    statements and flows read and write, which tables models stand for.

    ``files`` (path, lang, is_test), ``entities`` and ``flows`` (path, line, target, source) as extracted. A table is
    looked for in the own file, else anywhere by its name, the last path's then. Each relation is there once.
    """
    own = files.select("path", file_kind(F.col("path"), F.col("lang"), F.col("is_test")).alias("k"), "lang")
    end = lambda kind, key: F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit(":"), key)
    edge = lambda kind, source, target: F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), source.alias("source"), target.alias("target"))
    repository, path = F.lit("repository:."), F.col("path")
    file = end(F.col("k"), path)
    schema_file = (F.col("lang") == "sql") | path.rlike(r"(?i)\.(?:sql|prisma)$")
    of_files = own.select(F.inline(F.array_compact(F.array(
        edge("contains", repository, file),
        F.when(F.col("k") == "documentation", edge("documented-by", repository, file)),
        F.when(F.col("k") == "configuration", edge("configured-by", repository, file)),
        F.when(schema_file, edge("defines", file, end("data-entity", F.concat(F.lit("data:"), path)))),
    ))))
    line = F.concat(F.lit("data:"), path, F.lit(":"), F.col("line").cast("string"), F.lit(":"), "source", F.lit("->"), "target")
    variable = lambda c: end("data-entity", F.concat(F.lit("variable:"), path, F.lit(":"), c))
    of_flows = flows.join(own, "path").select(F.inline(F.array(
        edge("defines", file, end("data-flow", line)), edge("reads", end("data-flow", line), variable("source")), edge("writes", end("data-flow", line), variable("target")), edge("flows-to", variable("source"), variable("target")),
    )))
    key = end(F.col("kind"), F.concat(F.lower("name"), F.lit("@"), path))
    named = entities.select("path", "kind", "name", "detail", key.alias("unit"))
    of_entities = named.join(own, "path").select(F.inline(F.array_compact(F.array(
        F.when(F.col("kind") == "feature-flag", edge("configured-by", file, F.col("unit"))),
        F.when(F.col("kind").isin("ci-cd", "infrastructure"), edge("contains", repository, F.col("unit"))),
    ))))
    tables = named.where("kind = 'table'").select("path", F.lower("name").alias("low"), "unit").distinct()
    held = named.where("kind = 'database'").select("path", F.col("unit").alias("database")).join(tables, "path").select(F.lit("contains").alias("kind"), F.col("database").alias("source"), F.col("unit").alias("target"))
    parts = F.split("detail", r"\|")
    model = F.when(F.col("detail").rlike("^(?:sqlalchemy|django|decorator) "), F.substring_index("detail", " ", -1)).otherwise(F.col("name"))
    asked = named.where("kind = 'orm-entity'").select("path", F.lit("maps-to").alias("kind"), F.col("unit").alias("source"), F.lower(model).alias("low"))
    stated = named.where((F.col("kind") == "query") & (F.size(parts) > 2)).select("path", F.when(parts[0].rlike(WRITES), "writes").otherwise("reads").alias("kind"), F.col("unit").alias("source"), F.lower(parts[1]).alias("low")).where("low <> ''")
    here = tables.select("path", "low", F.col("unit").alias("here"))
    anywhere = tables.groupBy("low").agg(F.max_by("unit", "path").alias("any"))
    linked = asked.union(stated).join(here, ["path", "low"], "left").join(anywhere, "low", "left").select("kind", "source", F.coalesce("here", "any").alias("target")).where("target is not null")
    return reduce(DataFrame.union, [of_files, of_flows, of_entities, held, linked]).distinct()
