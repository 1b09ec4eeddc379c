"""Sources, sinks and the remaining projections over literal records and the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import asking as Q
from loomwork.operators import graph as G
from loomwork.plans import bindings as B
from loomwork.plans.asking import UNITS_SQL, facts
from loomwork.plans.extraction import SRC_SQL, _q, sources
from loomwork.plans.registry import query
from loomwork.session import cut, table
from loomwork.sources import files as S
from loomwork.sources import records as R
from loomwork.sources import store as T

IGNORE = "*.log\n!keep.log\n/dist\ndocs/**/draft.md\ntmp/\n"
PATHS = [("a.log",), ("x/keep.log",), ("dist/main.js",), ("src/dist",), ("docs/a/b/draft.md",), ("docs/draft.md",), ("tmp/x",), ("tmp",), ("src/tmp/y.ts",), ("src/main.ts",)]


@query("s4_ignore_rules", "SELECT * FROM (VALUES ('a.log', true), ('x/keep.log', false), ('dist/main.js', true), ('src/dist', false), ('docs/a/b/draft.md', true), ('docs/draft.md', true), ('tmp/x', true), ('tmp', false), ('src/tmp/y.ts', true), ('src/main.ts', false)) t(path, ignored)")
def s4(spark, sf):
    return B.literal(spark, "path string", PATHS).select("path", S.ignored(F.col("path"), S.parse_ignore(IGNORE)).alias("ignored"))


@query("s2_inspect_files", """WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'node_modules/d' WHEN 1 THEN 'src/d' WHEN 2 THEN 'img/d' ELSE 'lib/d' END || doc_id || CASE doc_id % 4 WHEN 2 THEN '.png' ELSE '.py' END AS path, strlen(text) AS length FROM documents)
SELECT path, length, CASE WHEN starts_with(path, 'node_modules/') THEN 'ignored' WHEN ends_with(path, '.png') THEN 'binary' WHEN length > 5000 THEN 'too-large' ELSE 'kept' END AS status FROM p""")
def s2(spark, sf):
    d = F.col("doc_id")
    files = table(spark, sf, "documents").select(F.concat(F.when(d % 4 == 0, "node_modules/d").when(d % 4 == 1, "src/d").when(d % 4 == 2, "img/d").otherwise("lib/d"), d, F.when(d % 4 == 2, ".png").otherwise(".py")).alias("path"), F.octet_length("text").cast("long").alias("length"), F.col("text").cast("binary").alias("content"))
    return S.inspect(files, most=5000).select("path", "length", "status")


SNIFF = [(1, "plain text\n"), (2, ""), (3, "tab\tand é"), (4, "bell \x07\x07\x07\x07"), (5, "ends \x01")]


@query("s3_text_sniff", "SELECT * FROM (VALUES (1, true), (2, true), (3, true), (4, false), (5, false)) t(id, is_text) UNION ALL SELECT 10 + doc_id, true FROM documents")
def s3(spark, sf):
    rows = B.literal(spark, "id long, t string", SNIFF).union(table(spark, sf, "documents").select(10 + F.col("doc_id"), "text"))
    return rows.select("id", S.looks_like_text(F.col("t").cast("binary")).alias("is_text"))


LOGS = [("r1", f"{R.MARK}\na.ts\nb.ts\n\n{R.MARK}\nb.ts\nb.ts\n"), ("r2", "noise only"), ("r3", f"head{R.MARK}one.py")]


@query("s14_commit_log", "SELECT * FROM (VALUES ('r1', 1, 'a.ts'), ('r1', 1, 'b.ts'), ('r1', 2, 'b.ts'), ('r3', 1, 'one.py')) t(log_id, commit, path)")
def s14(spark, sf):
    return R.parse_commits(B.literal(spark, "log_id string, output string", LOGS))


TELEMETRY = [('[{"id": "1", "file": "a", "metric": 1.5}, {"id": "2", "path": "b", "value": 2}]',), ('{"mappings": [{"id": "3", "filePath": "c", "metric": 3}, {"file": "d"}]}',), ("broken",)]


@query("s15_telemetry", "SELECT * FROM (VALUES ('1', 'a', 1.5::DOUBLE), ('2', 'b', 2), ('3', 'c', 3)) t(id, file, metric)")
def s15(spark, sf):
    return R.telemetry(B.literal(spark, "json string", TELEMETRY))


REPORTS = [("x", '{"/a.ts": {"path": "a.ts", "statementMap": {"0": {"start": {"line": 1}}, "1": {"start": {"line": 4}}}, "s": {"0": 2, "1": 0}}}'), ("y", '{"files": [{"name": "a.ts", "lines": [4, 5]}, {"name": "b.ts", "lines": [1]}]}')]


@query("s16_coverage", "SELECT * FROM (VALUES ('a.ts', 3, 3), ('b.ts', 1, 1)) t(path, lines, covered)")
def s16(spark, sf):
    return R.covered(B.literal(spark, "report string, json string", REPORTS))


@query("s17_coverage_lines", "SELECT * FROM (VALUES ('x', 'a.ts', 1, 2), ('x', 'a.ts', 4, 0)) t(report, path, line, hits)")
def s17(spark, sf):
    return R.istanbul(B.literal(spark, "report string, json string", REPORTS[:1]))


@query("s20_retention", "SELECT o_custkey AS folder, o_orderkey AS name FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) > 3 OR o_orderdate < TIMESTAMP '1998-12-01' - INTERVAL 30 DAY")
def s20(spark, sf):
    entries = table(spark, sf, "orders").select(F.col("o_custkey").alias("folder"), F.col("o_orderkey").alias("name"), F.col("o_orderdate").alias("modified"))
    return T.retention(entries, F.lit("1998-12-01").cast("timestamp_ntz"), newest=3, days=30)


@query("s10_bundle", f"""WITH {UNITS_SQL} SELECT kind, path, document FROM (SELECT kind, 'units/' || kind || '/' || substr(sha256(id::VARCHAR), 1, 16) || '.md' AS path, printf('---{chr(10)}id: %s{chr(10)}kind: %s{chr(10)}---{chr(10)}# %s{chr(10)}{chr(10)}%s{chr(10)}', id::VARCHAR, kind, name, description) AS document FROM units
UNION ALL SELECT kind, 'index/' || kind || '.md', '# ' || kind || chr(10) || string_agg('- ' || name, chr(10) ORDER BY name) FROM units GROUP BY kind)""")
def s10(spark, sf):
    return T.bundle(facts(spark, sf)[0].withColumn("id", F.col("id").cast("string")))


@query("s11_bundle_validation", "SELECT * FROM (VALUES ('units/a.md', 'front matter is missing'), ('units/b.md', 'id is missing'), ('index/c.md', 'title is missing')) t(path, message)")
def s11(spark, sf):
    docs = [("units/a.md", "# x"), ("units/b.md", "---\nkind: x\n---\n# t"), ("index/c.md", "no title"), ("units/d.md", "---\nid: 1\n---\n# t"), ("index/e.md", "# ok")]
    return T.invalid_documents(B.literal(spark, "path string, document string", docs))


@query("s12_shard_reuse", f"WITH {B.OLD_SQL}, {B.NEW_SQL} SELECT new.path, EXISTS (SELECT 1 FROM old WHERE old.path = new.path AND old.content_hash = new.content_hash) AS reused FROM new")
def s12(spark, sf):
    old, new = B.snapshots(spark, sf)
    return new.select("path", "content_hash").join(old.select("path", "content_hash", F.lit(True).alias("hit")), ["path", "content_hash"], "left").select("path", F.coalesce("hit", F.lit(False)).alias("reused"))


@query("s19_config_fingerprint", "SELECT o_custkey AS project, sha256(string_agg(sha256(o_orderstatus || o_orderpriority || o_orderkey), chr(10) ORDER BY sha256(o_orderstatus || o_orderpriority || o_orderkey))) AS fingerprint FROM orders GROUP BY 1")
def s19(spark, sf):
    h = F.sha2(F.concat("o_orderstatus", "o_orderpriority", "o_orderkey"), 256)
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("project")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list(h)), "\n"), 256).alias("fingerprint"))


@query("p2_column_pruning", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def p2(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("p4_graph_projection", f"WITH {UNITS_SQL} SELECT id, kind AS type, name AS label, confidence AS weight FROM units")
def p4(spark, sf):
    return Q.active(*facts(spark, sf))[0].select("id", F.col("kind").alias("type"), F.col("name").alias("label"), F.col("confidence").alias("weight"))


@query("p6_cpg_bindings", f"WITH {UNITS_SQL} SELECT id, path FROM units WHERE kind IN ('symbol', 'file', 'api', 'test', 'risk-area') AND path IS NOT NULL")
def p6(spark, sf):
    return Q.active(*facts(spark, sf))[0].where("kind in ('symbol', 'file', 'api', 'test', 'risk-area') and path is not null").select("id", "path")


#: Explorer groups of kinds and graph modes' relations.
GROUPS = {"services": ["service", "api"], "interfaces": ["api", "route", "contract"], "risks": ["risk-area"], "implementation": ["symbol", "file"]}
MODES = {"calls": ["calls"], "dependencies": ["imports", "depends-on"], "impact": ["calls", "imports", "tests", "may-impact"], "tests": ["tests", "covers"]}


@query("p10_kind_groups", f"WITH {UNITS_SQL}, {B.values_sql('g', ['grp', 'kind'], [(k, v) for k, vs in GROUPS.items() for v in vs])} SELECT grp, count(*) AS units FROM units JOIN g USING (kind) GROUP BY grp")
def p10(spark, sf):
    g = B.literal(spark, "grp string, kind string", [(k, v) for k, vs in GROUPS.items() for v in vs])
    return Q.active(*facts(spark, sf))[0].join(F.broadcast(g), "kind").groupBy("grp").agg(F.count("*").alias("units"))


@query("p11_graph_modes", f"WITH {UNITS_SQL}, {B.values_sql('m', ['mode', 'kind'], [(k, v) for k, vs in MODES.items() for v in vs])} SELECT mode, count(*) AS edges FROM rels JOIN m USING (kind) GROUP BY mode")
def p11(spark, sf):
    m = B.literal(spark, "mode string, kind string", [(k, v) for k, vs in MODES.items() for v in vs])
    return Q.active(*facts(spark, sf))[1].join(F.broadcast(m), "kind").groupBy("mode").agg(F.count("*").alias("edges"))


NOISE = r"^(index|main|test|small.*)$"


@query("p12_noisy_names", f"WITH {UNITS_SQL} SELECT id FROM units WHERE kind IN ('file', 'service', 'api') AND NOT regexp_matches(name, {_q(NOISE)})")
def p12(spark, sf):
    return Q.active(*facts(spark, sf))[0].where(F.col("kind").isin("file", "service", "api") & ~F.col("name").rlike(NOISE)).select("id")


IMPL = r"^(?:src|lib|pkg|web|app)/"


@query("p13_implementation_paths", f"WITH {SRC_SQL}, {B.FILES_SQL}, every AS (SELECT path FROM src UNION ALL SELECT 'src/' || path FROM files) SELECT path FROM every WHERE regexp_matches(path, {_q(IMPL)}) AND NOT regexp_matches(path, '[.](?:test|spec)[.]|(?:^|/)(?:docs|fixtures)/')")
def p13(spark, sf):
    every = sources(spark).select("path").union(B.files(spark, sf).select(F.concat(F.lit("src/"), "path")))
    return every.where(F.col("path").rlike(IMPL) & ~F.col("path").rlike("[.](?:test|spec)[.]|(?:^|/)(?:docs|fixtures)/")).select("path")


@query("t9_coupling_order", "WITH c AS (SELECT o_custkey AS a, o_orderstatus AS b, count(*) AS commits, round(count(*) / 20.0::DOUBLE, 6) AS strength FROM orders GROUP BY 1, 2) SELECT a, b, strength FROM c ORDER BY strength DESC, commits DESC, a, b LIMIT 50")
def t9(spark, sf):
    c = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("a"), F.col("o_orderstatus").alias("b")).agg(F.count("*").alias("commits")).withColumn("strength", F.round(F.col("commits") / 20.0, 6))
    return c.orderBy(F.desc("strength"), F.desc("commits"), "a", "b").limit(50).select("a", "b", "strength")


@query("t11_anchor_order", f"WITH {B.EDGES_SQL} SELECT id, sum(weight)::BIGINT AS weighted FROM (SELECT src AS id, weight FROM edges UNION ALL SELECT dst, weight FROM edges) GROUP BY id ORDER BY weighted DESC, id LIMIT 30")
def t11(spark, sf):
    e = B.edges(spark, sf)
    return e.select(F.col("src").alias("id"), "weight").union(e.select("dst", "weight")).groupBy("id").agg(F.sum("weight").alias("weighted")).orderBy(F.desc("weighted"), "id").limit(30)


@query("t12_cpg_files", f"WITH {B.FILES_SQL} SELECT path, CASE WHEN is_test THEN 0 ELSE 5 END + least(line_count, 20) AS score FROM files ORDER BY score DESC, path LIMIT 40")
def t12(spark, sf):
    score = F.when(F.col("is_test"), 0).otherwise(5) + F.least("line_count", F.lit(20))
    return B.files(spark, sf).select("path", score.alias("score")).orderBy(F.desc("score"), "path").limit(40)


@query("j14_unreferenced", "SELECT DISTINCT p_partkey AS path FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount >= 0.1) AND p_partkey IN (SELECT l_partkey FROM lineitem)")
def j14(spark, sf):
    li = table(spark, sf, "lineitem")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("path"))
    return parts.join(li.where("l_discount >= 0.1"), F.col("path") == F.col("l_partkey"), "left_anti").join(li, F.col("path") == F.col("l_partkey"), "left_semi")


ROUTES = [("a.ts", "GET", "/x", "CtrlA"), ("a.ts", "POST", "/y", "CtrlA"), ("b.ts", "GET", "/z", None)]
HANDLERS = [("a.ts", "CtrlA", True), ("a.ts", "Hidden", False), ("b.ts", "CtrlB", True)]


@query("x14_default_relations", f"WITH {B.values_sql('r', ['path', 'method', 'route', 'owner'], ROUTES)}, {B.values_sql('h', ['path', 'name', 'visible'], HANDLERS)} SELECT r.path, r.route, h.name AS handler FROM r JOIN h ON r.path = h.path WHERE h.visible AND (r.owner IS NULL OR r.owner = h.name)")
def x14(spark, sf):
    r, h = B.literal(spark, "path string, method string, route string, owner string", ROUTES), B.literal(spark, "path string, name string, visible boolean", HANDLERS)
    return r.join(h.where("visible"), "path").where("owner is null or owner = name").select("path", "route", F.col("name").alias("handler"))


@query("q5_global_adds", f"WITH {UNITS_SQL} SELECT id, 8.0::DOUBLE AS score FROM units WHERE kind = 'risk-area' AND json_extract_string(properties, '$.category') = 'security' UNION SELECT target_id, 7.0 FROM rels WHERE kind = 'may-impact' AND source_id IN (SELECT id FROM units WHERE kind = 'risk-area' AND json_extract_string(properties, '$.category') = 'security')")
def q5(spark, sf):
    units, rels = Q.active(*facts(spark, sf))
    area = units.where((F.col("kind") == "risk-area") & (F.get_json_object("properties", "$.category") == "security")).select("id")
    hit = rels.where("kind = 'may-impact'").join(area.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(F.col("target_id").alias("id"), F.lit(7.0).alias("score"))
    return area.select("id", F.lit(8.0).alias("score")).union(hit).distinct()


@query("g11_layout_levels", f"WITH RECURSIVE {B.EDGES_SQL}, r(id, depth) AS (SELECT DISTINCT src, 0 FROM edges WHERE src NOT IN (SELECT dst FROM edges) UNION SELECT dst, depth + 1 FROM r JOIN edges ON id = src WHERE depth < 7) SELECT id, min(depth) AS level FROM r GROUP BY id")
def g11(spark, sf):
    e = cut(B.edges(spark, sf))
    roots = e.join(e.select(F.col("dst").alias("k")), F.col("src") == F.col("k"), "left_anti").select(F.col("src").alias("id")).distinct()
    return G.reach(e, roots, 7).groupBy("id").agg(F.min("depth").alias("level"))
