"""Snapshot building, validation, updates over the fixture tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import aggregates as A
from loomwork.operators import extract as E
from loomwork.operators import relational as R
from loomwork.operators import snapshots as S
from loomwork.plans import bindings as B
from loomwork.plans.registry import query
from loomwork.plans.relational import DIFF_SQL
from loomwork.session import cut, table


def _facts(spark, sf):
    """Files are documents; a document imports the one seven before it, and one that is missing; its symbol is its language."""
    files = B.files(spark, sf).select("doc_id", "path", "lang", "content_hash", "is_test")
    symbols = files.select("path", F.concat(F.lit("s_"), "lang").alias("name"), F.lit(1).alias("line"))
    before = files.select((F.col("doc_id") + 7).alias("doc_id"), F.col("path").alias("target"))
    imports = files.join(before, "doc_id").select("path", "target").union(files.where("doc_id % 4 = 0").select("path", F.concat(F.lit("pkg_"), F.col("doc_id") % 9)))
    return files, symbols, imports


FACTS_SQL = f"""{B.FILES_SQL}, imp AS (SELECT f.path, g.path AS target, true AS hit FROM files f JOIN files g ON f.doc_id = g.doc_id + 7 UNION ALL SELECT path, 'pkg_' || (doc_id % 9), false FROM files WHERE doc_id % 4 = 0),
k AS (SELECT path, CASE WHEN is_test THEN 'test' ELSE 'file' END AS kind, lang FROM files)"""


def _uid(kind: str, key: str) -> str:
    return f"'lw:unit:' || substr(sha256('workspace' || chr(0) || {kind} || chr(0) || {key}), 1, 32)"


@query("k_units", f"""WITH {FACTS_SQL}, u AS (SELECT kind, path AS canonical_key, 1.0 AS confidence FROM k UNION ALL SELECT 'symbol', path || '#s_' || lang, 0.9 FROM k UNION ALL SELECT DISTINCT 'external-dependency', 'external:' || target, 0.6 FROM imp WHERE NOT hit)
SELECT {_uid('kind', 'canonical_key')} AS id, kind, canonical_key, confidence::DOUBLE AS confidence FROM u""")
def k_units(spark, sf):
    return S.build(*_facts(spark, sf))["units"].select("id", "kind", "canonical_key", "confidence")


@query("k_relationships", f"""WITH {FACTS_SQL}, r AS (SELECT DISTINCT 'imports' AS kind, {_uid('a.kind', 'a.path')} AS s, {_uid('b.kind', 'b.path')} AS t FROM imp JOIN k a ON a.path = imp.path JOIN k b ON b.path = imp.target WHERE hit
UNION SELECT 'depends-on', {_uid('a.kind', 'a.path')}, {_uid("'external-dependency'", "'external:' || target")} FROM imp JOIN k a ON a.path = imp.path WHERE NOT hit UNION SELECT 'defines', {_uid('kind', 'path')}, {_uid("'symbol'", "path || '#s_' || lang")} FROM k)
SELECT 'lw:rel:' || substr(sha256(kind || ':' || s || '->' || t), 1, 32) AS id, kind, s AS source_id, t AS target_id FROM r""")
def k_relationships(spark, sf):
    return S.build(*_facts(spark, sf))["relationships"].select("id", "kind", "source_id", "target_id")


@query("k_observations", f"WITH {FACTS_SQL} SELECT DISTINCT {_uid('a.kind', 'a.path')} AS subject_id, 'unresolved-import' AS predicate, target AS value FROM imp JOIN k a ON a.path = imp.path WHERE NOT hit")
def k_observations(spark, sf):
    return S.build(*_facts(spark, sf))["observations"].select("subject_id", "predicate", "value")


@query("v_validate", """WITH u AS (SELECT CASE WHEN p_partkey % 101 = 0 THEN 'dup' ELSE 'p' || p_partkey END AS id, CASE WHEN p_partkey % 97 = 0 THEN 'gadget' WHEN p_partkey % 3 = 0 THEN 'test' ELSE 'file' END AS kind, p_size / 49.0 AS confidence FROM part),
r AS (SELECT DISTINCT 'r' || l_orderkey || '_' || l_linenumber || '_' || l_partkey AS id, 'tests' AS kind, 'p' || l_partkey AS s, 'p' || (l_partkey + 1) AS t FROM lineitem)
SELECT 'duplicate id' AS message, count(*) AS n FROM (SELECT id FROM u GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'confidence out of range', count(*) FROM u WHERE confidence > 1 HAVING count(*) > 0 UNION ALL SELECT 'unknown kind', count(*) FROM u WHERE kind = 'gadget'
UNION ALL SELECT 'source_id does not exist', count(*) FROM r WHERE s NOT IN (SELECT id FROM u) HAVING count(*) > 0 UNION ALL SELECT 'target_id does not exist', count(*) FROM r WHERE t NOT IN (SELECT id FROM u) HAVING count(*) > 0
UNION ALL SELECT 'endpoint kinds are not allowed', count(*) FROM r JOIN u a ON a.id = s JOIN u b ON b.id = t WHERE NOT (a.kind = 'test' AND b.kind = 'file')""")
def v_validate(spark, sf):
    p = F.col("p_partkey")
    units = table(spark, sf, "part").select(
        F.when(p % 101 == 0, F.lit("dup")).otherwise(F.concat(F.lit("p"), p)).alias("id"), F.when(p % 97 == 0, "gadget").when(p % 3 == 0, "test").otherwise("file").alias("kind"), F.col("p_name").alias("name"),
        F.concat(F.lit("k"), p).alias("canonical_key"), (F.col("p_size") / 49.0).alias("confidence"), F.lit("active").alias("lifecycle"),
    )
    rels = table(spark, sf, "lineitem").select(F.concat(F.lit("r"), F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey")).alias("id"), F.lit("tests").alias("kind"), F.concat(F.lit("p"), "l_partkey").alias("source_id"), F.concat(F.lit("p"), F.col("l_partkey") + 1).alias("target_id"), F.lit(1.0).alias("confidence"), F.lit("active").alias("lifecycle")).distinct()
    return S.violations({"units": units, "relationships": rels}).groupBy("message").agg(F.count("*").alias("n"))


@query("j24_endpoint_downgrade", """WITH u AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'service' ELSE 'file' END AS kind FROM part), r AS (SELECT DISTINCT l_partkey AS s, l_partkey + 1 AS t FROM lineitem)
SELECT s AS source_id, t AS target_id, CASE WHEN a.kind = 'file' AND b.kind = 'file' THEN 'imports' ELSE 'depends-on' END AS kind FROM r JOIN u a ON a.id = s JOIN u b ON b.id = t""")
def j24(spark, sf):
    units = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, "service").otherwise("file").alias("kind"))
    rels = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("source_id"), (F.col("l_partkey") + 1).alias("target_id"), F.lit("imports").alias("kind")).distinct()
    return S.downgrade(rels, units).select("source_id", "target_id", "kind")


@query("f5_update_plan", f"""WITH {DIFF_SQL}, n AS (SELECT count(*) FILTER (WHERE kind <> 'unchanged') AS meaningful, count(*) FILTER (WHERE kind IN ('structural', 'added', 'deleted')) AS structural, count(*) FILTER (WHERE kind <> 'deleted') AS files FROM changes)
SELECT CASE WHEN meaningful = 0 THEN 'skip' WHEN structural = 0 THEN 'file-local' WHEN structural > 30 OR structural / greatest(files, 1) > 0.5 THEN 'full' WHEN structural > 10 THEN 'architecture' ELSE 'graph' END AS action, * FROM n""")
def f5(spark, sf):
    return S.plan_update(R.diff(*B.snapshots(spark, sf)))


@query("s18_cache_misses", f"WITH {B.OLD_SQL}, {B.NEW_SQL} SELECT path FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.path = new.path AND old.content_hash = new.content_hash)")
def s18(spark, sf):
    old, new = (t.select("path", "content_hash", F.lit("v1").alias("version")) for t in B.snapshots(spark, sf))
    return S.misses(new, old).select("path")


@query("c6_staleness", f"WITH {B.OLD_SQL}, {B.NEW_SQL} SELECT old.path, old.content_hash FROM old LEFT JOIN new ON new.path = old.path WHERE new.path IS NULL OR new.content_hash <> old.content_hash")
def c6(spark, sf):
    old, new = B.snapshots(spark, sf)
    return S.stale(old.select("path", "content_hash"), new)


@query("s21_input_fingerprint", f"""WITH {B.FILES_SQL}, b AS (SELECT lang, substr(content_hash, 1, 4) AS b, count(*) AS n, sha256(string_agg(content_hash, '' ORDER BY content_hash)) AS d FROM files GROUP BY 1, 2)
SELECT lang, sum(n)::BIGINT AS files, sha256(string_agg(d, '' ORDER BY b)) AS digest FROM b GROUP BY lang""")
def s21(spark, sf):
    return A.digests(B.files(spark, sf), ["lang"], F.col("content_hash"))


@query("s7_snapshot_manifest")
def s7(spark, sf):
    return S.manifest(S.build(*_facts(spark, sf)))


def snapshot_of(src):
    """The whole snapshot of files (path, lang, text)."""
    known = cut(E.line_facts(src).drop("code", "control", "target", "source"))  # read for each table below; texts are scanned three times in all
    files = cut(src.select("path", "lang", F.sha2("text", 256).alias("content_hash"), F.col("path").rlike("(?:^|/)tests?/").alias("is_test")))
    symbols, imports = E.symbols_of(known).select("path", "name", "line"), E.imports_of(known).select("path", "target")
    facts = {"calls": E.calls_of(known), "types": E.types_of(known), "routes": E.routes_of(known), "tests": E.test_lines_of(known), "entities": cut(E.entities(src))}
    return S.with_facts(S.build(files, symbols, imports), files, symbols, imports, **facts)


@query("k_from_sources")
def k_from_sources(spark, sf):
    from loomwork.plans.extraction import everything

    snapshot = snapshot_of(everything(spark, sf))
    return snapshot["units"].select("kind", "canonical_key").union(snapshot["relationships"].select("kind", F.concat_ws("->", "source_id", "target_id")))


def _structure_sql() -> str:
    from loomwork.plans import extraction as X

    kind = f"CASE WHEN lang = 'markdown' THEN 'documentation' WHEN regexp_matches(path, '(?:^|/)tests?/') THEN 'test' WHEN lang IN ('json', 'yaml', 'toml', 'xml') OR regexp_matches(path, {X._q(S.CONFIGURATION_PATH)}) THEN 'configuration' ELSE 'file' END"
    return f"""WITH {X.ALL_LINES_SQL}, e AS ({X.X11_SQL}), own AS (SELECT path, lang, {kind} AS k FROM src), fl AS (SELECT * FROM ({X.X6_SQL}) WHERE target <> '-'),
u AS (SELECT *, kind || ':' || lower(name) || '@' || path AS unit FROM e), t AS (SELECT DISTINCT path, lower(name) AS low, unit FROM u WHERE kind = 'table'),
d AS (SELECT f.*, k, 'data-flow:data:' || path || ':' || line || ':' || source || '->' || target AS flow, 'data-entity:variable:' || path || ':' AS var FROM fl f JOIN own USING (path)),
a AS (SELECT path, 'maps-to' AS kind, unit AS source, lower(CASE WHEN regexp_matches(detail, '^(?:sqlalchemy|django|decorator) ') THEN split_part(detail, ' ', -1) ELSE name END) AS low FROM u WHERE kind = 'orm-entity'
  UNION ALL SELECT path, CASE WHEN regexp_matches(detail, '^(?:insert|update|delete|merge|writ)') THEN 'writes' ELSE 'reads' END, unit, lower(split_part(detail, '|', 2)) FROM u WHERE kind = 'query' AND split_part(detail, '|', 3) <> '' AND split_part(detail, '|', 2) <> ''),
r AS (SELECT 'contains' AS kind, 'repository:.' AS source, k || ':' || path AS target FROM own UNION ALL SELECT 'documented-by', 'repository:.', k || ':' || path FROM own WHERE k = 'documentation' UNION ALL SELECT 'configured-by', 'repository:.', k || ':' || path FROM own WHERE k = 'configuration'
UNION ALL SELECT 'defines', k || ':' || path, 'data-entity:data:' || path FROM own WHERE lang = 'sql' OR regexp_matches(path, '(?i)[.](?:sql|prisma)$')
UNION ALL SELECT 'defines', k || ':' || path, flow FROM d UNION ALL SELECT 'reads', flow, var || source FROM d UNION ALL SELECT 'writes', flow, var || target FROM d UNION ALL SELECT 'flows-to', var || source, var || target FROM d
UNION ALL SELECT 'configured-by', k || ':' || path, unit FROM u JOIN own USING (path) WHERE kind = 'feature-flag' UNION ALL SELECT 'contains', 'repository:.', unit FROM u WHERE kind IN ('ci-cd', 'infrastructure')
UNION ALL SELECT 'contains', u.unit, t.unit FROM u JOIN t USING (path) WHERE kind = 'database'
UNION ALL SELECT a.kind, source, coalesce((SELECT unit FROM t WHERE t.path = a.path AND t.low = a.low), (SELECT arg_max(unit, path) FROM t WHERE t.low = a.low)) FROM a)
SELECT DISTINCT * FROM r WHERE target IS NOT NULL"""


@query("k_structure", _structure_sql())
def k_structure(spark, sf):
    from loomwork.plans.extraction import everything

    src = everything(spark, sf)
    files = src.select("path", "lang", F.col("path").rlike("(?:^|/)tests?/").alias("is_test"))
    return S.structure(files, cut(E.entities(src)), cut(E.flow_facts(src).where("target <> '-'")))
