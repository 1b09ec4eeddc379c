"""Joins, projections and window-like operators over the fixture tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork.functions import text as X
from loomwork.operators import relational as R
from loomwork.plans import bindings as B
from loomwork.plans.registry import query
from loomwork.session import table

PAIRS_SQL = B.EDGES_SQL


@query("j1_local_edges", f"""WITH {B.EDGES_SQL}, idx AS (SELECT p_partkey AS path FROM part WHERE p_size <= 40)
SELECT src, dst, weight FROM edges WHERE src IN (SELECT path FROM idx) AND dst IN (SELECT path FROM idx)""")
def j1(spark, sf):
    idx = table(spark, sf, "part").where("p_size <= 40").select(F.col("p_partkey").alias("path"))
    return R.local_edges(B.edges(spark, sf), idx)


@query("j2_dangling_edges", f"""WITH {B.EDGES_SQL}, idx AS (SELECT p_partkey AS path FROM part WHERE p_size <= 40)
SELECT src, dst, weight FROM edges WHERE dst NOT IN (SELECT path FROM idx)""")
def j2(spark, sf):
    idx = table(spark, sf, "part").where("p_size <= 40").select(F.col("p_partkey").alias("path"))
    return R.dangling_edges(B.edges(spark, sf), idx)


@query("j3_orphans", f"""WITH {B.EDGES_SQL}
SELECT p_partkey AS path FROM part WHERE p_partkey NOT IN (SELECT src FROM edges) AND p_partkey NOT IN (SELECT dst FROM edges)
AND p_name NOT LIKE 'small%'""")
def j3(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("path"), "p_name")
    return R.orphans(parts, B.edges(spark, sf), parts.where(F.col("p_name").startswith("small"))).select("path")


J4_FILES = [("src/a.ts",), ("src/a/index.ts",), ("src/b.js",), ("lib/c.py",), ("lib/c/index.js",)]
J4_IMPORTS = [("m1", "src/a"), ("m2", "src/b"), ("m3", "lib/c"), ("m4", "lib/none"), ("m5", "src/b.js")]
J4_SUFFIX = ["", ".ts", ".tsx", ".js", "/index.ts", "/index.js"]


@query("j4_resolve_imports", f"""WITH {B.values_sql("f", ["path"], J4_FILES)}, {B.values_sql("i", ["origin", "target"], J4_IMPORTS)},
{B.values_sql("x", ["pos", "suffix"], list(enumerate(J4_SUFFIX)))},
hit AS (SELECT origin, target, arg_min(f.path, pos) AS path FROM i CROSS JOIN x JOIN f ON f.path = target || suffix GROUP BY origin, target)
SELECT i.origin, i.target, coalesce(hit.path, i.target) AS resolved FROM i LEFT JOIN hit USING (origin, target)""")
def j4(spark, sf):
    files, imports = B.literal(spark, "path string", J4_FILES), B.literal(spark, "origin string, target string", J4_IMPORTS)
    return R.resolve_candidates(imports, files, F.array(*[F.concat("target", F.lit(s)) for s in J4_SUFFIX]))


@query("j5_test_by_stem", """WITH t AS (SELECT c_custkey AS test_path, 'd' || c_custkey || 'x' AS stem FROM customer),
s AS (SELECT p_partkey AS source_path, 'd' || (p_partkey // 3) AS stem FROM part)
SELECT test_path, min(source_path) AS source_path FROM t JOIN s ON starts_with(t.stem, s.stem) GROUP BY test_path""")
def j5(spark, sf):
    tests = table(spark, sf, "customer").select(F.col("c_custkey").alias("test_path"), F.concat(F.lit("d"), "c_custkey", F.lit("x")).alias("stem"))
    sources = table(spark, sf, "part").select(F.col("p_partkey").alias("source_path"), F.concat(F.lit("d"), F.expr("p_partkey div 3")).alias("stem"))
    return R.stem_matches(tests, sources)


@query("j6_test_mapping_upgrade", f"""WITH {B.EDGES_SQL}, t AS (SELECT src, count(DISTINCT dst) AS n, min(dst) AS target FROM edges WHERE dst % 5 <> 0 GROUP BY src)
SELECT p_partkey AS test_path, CASE WHEN n = 1 THEN target ELSE -1 END AS target, CASE WHEN n = 1 THEN 0.95 ELSE 0.6 END::DOUBLE AS confidence
FROM part LEFT JOIN t ON p_partkey = src WHERE p_partkey % 5 = 0""")
def j6(spark, sf):
    tests = table(spark, sf, "part").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("test_path"))
    targets = B.edges(spark, sf).where("dst % 5 <> 0").groupBy(F.col("src").alias("test_path")).agg(F.countDistinct("dst").alias("n"), F.min("dst").alias("target"))
    one = F.col("n") == 1
    return tests.join(targets, "test_path", "left").select("test_path", F.when(one, F.col("target")).otherwise(-1).alias("target"), F.when(one, 0.95).otherwise(0.6).alias("confidence"))


@query("j7_call_resolution", """WITH calls AS (SELECT DISTINCT l_orderkey AS call_id, l_suppkey, l_partkey FROM lineitem WHERE l_linenumber = 1),
s0 AS (SELECT DISTINCT call_id, p_partkey AS target, 0 AS stage FROM calls JOIN part ON p_partkey = l_partkey AND p_size < 10),
s1 AS (SELECT DISTINCT call_id, s_suppkey AS target, 1 AS stage FROM calls JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 5000),
s2 AS (SELECT DISTINCT call_id, n_nationkey::BIGINT AS target, 2 AS stage FROM calls JOIN nation ON n_regionkey = l_partkey % 9),
u AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2),
w AS (SELECT call_id, stage, count(*) AS n, min(target) AS target FROM u GROUP BY call_id, stage QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY stage) = 1),
c AS (SELECT DISTINCT call_id FROM calls)
SELECT call_id, CASE WHEN n IS NULL THEN 'UNRESOLVED' WHEN n > 1 THEN 'AMBIGUOUS' WHEN stage = 0 THEN 'RESOLVED' ELSE 'INFERRED' END AS outcome,
coalesce(stage, -1) AS stage, coalesce(n, 0) AS candidates, coalesce(target, -1) AS target FROM c LEFT JOIN w USING (call_id)""")
def j7(spark, sf):
    calls = table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("call_id"), "l_suppkey", "l_partkey").distinct()
    exact = calls.join(table(spark, sf, "part").where("p_size < 10"), F.col("p_partkey") == F.col("l_partkey")).select("call_id", F.col("p_partkey").alias("target"))
    scope = calls.join(table(spark, sf, "supplier").where("s_acctbal > 5000"), F.col("s_suppkey") == F.col("l_suppkey")).select("call_id", F.col("s_suppkey").alias("target"))
    names = calls.join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("l_partkey") % 9).select("call_id", F.col("n_nationkey").cast("long").alias("target"))
    return R.staged_resolution(calls.select("call_id").distinct(), [exact, scope, names]).fillna(-1, ["stage", "target"])


@query("j8_type_targets", """SELECT c_custkey AS ref, coalesce(s.s_name, n.n_name, r.r_name, 'external:' || c_mktsegment) AS target,
CASE WHEN s.s_name IS NOT NULL THEN 'same-file' WHEN n.n_name IS NOT NULL THEN 'import' WHEN r.r_name IS NOT NULL THEN 'global' ELSE 'external' END AS via
FROM customer LEFT JOIN supplier s ON s.s_suppkey = c_custkey LEFT JOIN nation n ON n.n_nationkey = c_custkey - 100
LEFT JOIN region r ON r.r_regionkey = c_custkey - 200""")
def j8(spark, sf):
    c = table(spark, sf, "customer")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    n, r = table(spark, sf, "nation").select("n_nationkey", "n_name"), table(spark, sf, "region").select("r_regionkey", "r_name")
    met = c.join(s, F.col("s_suppkey") == F.col("c_custkey"), "left").join(n, F.col("n_nationkey") == F.col("c_custkey") - 100, "left").join(r, F.col("r_regionkey") == F.col("c_custkey") - 200, "left")
    via = F.when(F.col("s_name").isNotNull(), "same-file").when(F.col("n_name").isNotNull(), "import").when(F.col("r_name").isNotNull(), "global").otherwise("external")
    return met.select(F.col("c_custkey").alias("ref"), F.coalesce("s_name", "n_name", "r_name", F.concat(F.lit("external:"), "c_mktsegment")).alias("target"), via.alias("via"))


@query("j9_scoped_then_global", """WITH t AS (SELECT p_partkey AS id, p_brand AS scope, p_type AS name, p_partkey AS seq FROM part WHERE p_size < 25),
refs AS (SELECT p_partkey AS ref, p_brand AS scope, p_type AS name FROM part WHERE p_size >= 25),
a AS (SELECT scope, name, arg_max(id, seq) AS scoped_id FROM t GROUP BY scope, name), b AS (SELECT name, arg_max(id, seq) AS global_id FROM t GROUP BY name)
SELECT ref, coalesce(scoped_id, global_id) AS target, CASE WHEN scoped_id IS NOT NULL THEN 'scoped' WHEN global_id IS NOT NULL THEN 'global' ELSE 'none' END AS via
FROM refs LEFT JOIN a USING (scope, name) LEFT JOIN b USING (name)""")
def j9(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("scope"), F.col("p_type").alias("name"), F.col("p_partkey").alias("seq"), "p_size")
    return R.scoped_then_global(part.where("p_size >= 25").select(F.col("id").alias("ref"), "scope", "name"), part.where("p_size < 25"))


@query("j10_evidence_freshness", """WITH x AS (SELECT o_custkey AS unit, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS f FROM orders GROUP BY o_custkey)
SELECT c_custkey AS unit, round(least(1, greatest(0, 0.8 * (c_acctbal % 1) + 0.2 * coalesce(f, 0.7))), 6) AS confidence FROM customer LEFT JOIN x ON unit = c_custkey""")
def j10(spark, sf):
    fresh = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("unit")).agg(F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("f"))
    score = F.lit(0.8) * (F.col("c_acctbal") % 1) + F.lit(0.2) * F.coalesce("f", F.lit(0.7))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("unit"), "c_acctbal").join(fresh, "unit", "left").select("unit", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6).alias("confidence"))


DIFF_SQL = f"""{B.OLD_SQL}, {B.NEW_SQL}, changes AS (
SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted'
WHEN o.content_hash = n.content_hash THEN 'unchanged' WHEN o.structural_hash = n.structural_hash THEN 'implementation' ELSE 'structural' END AS kind
FROM old o FULL OUTER JOIN new n ON o.path = n.path)"""


@query("j11_snapshot_diff", f"WITH {DIFF_SQL} SELECT path, kind FROM changes")
def j11(spark, sf):
    return R.diff(*B.snapshots(spark, sf))


@query("j12_tombstones", f"""WITH {B.OLD_SQL}, {B.NEW_SQL} SELECT path, content_hash, 'active' AS lifecycle FROM new
UNION ALL SELECT path, content_hash, 'deleted' FROM old WHERE path NOT IN (SELECT path FROM new)""")
def j12(spark, sf):
    return R.tombstones(*B.snapshots(spark, sf)).select("path", "content_hash", "lifecycle")


@query("j13_runtime_correlation", """SELECT p_partkey AS finding_id, string_agg(DISTINCT l_orderkey::VARCHAR, ',' ORDER BY l_orderkey::VARCHAR) AS evidence_ids,
least(1.0, round((p_size / 50.0)::DOUBLE + 0.2, 6))::DOUBLE AS confidence FROM part JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 49 GROUP BY p_partkey, p_size""")
def j13(spark, sf):
    telemetry = table(spark, sf, "lineitem").where("l_quantity > 49").groupBy("l_partkey").agg(F.array_join(F.sort_array(F.collect_set(F.col("l_orderkey").cast("string"))), ",").alias("evidence_ids"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("finding_id"), "p_size")
    return parts.join(telemetry, F.col("finding_id") == F.col("l_partkey")).select("finding_id", "evidence_ids", F.least(F.lit(1.0), F.round(F.col("p_size") / 50.0 + 0.2, 6)).alias("confidence"))


@query("j15_structural_evidence", """WITH a AS (SELECT l_partkey, count(*) AS calls FROM lineitem GROUP BY 1), b AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS apis FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
c AS (SELECT l_partkey, count(*) AS persistence FROM lineitem WHERE l_tax > 0.05 GROUP BY 1), d AS (SELECT l_partkey, max(l_discount) AS deps FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT p_partkey AS path, coalesce(calls, 0) AS calls, coalesce(apis, 0) AS apis, coalesce(persistence, 0) AS persistence, coalesce(deps, 0) AS deps
FROM part LEFT JOIN a ON p_partkey = a.l_partkey LEFT JOIN b ON p_partkey = b.l_partkey LEFT JOIN c ON p_partkey = c.l_partkey LEFT JOIN d ON p_partkey = d.l_partkey""")
def j15(spark, sf):
    # One pass: every side is aggregated by the same key, so they share a shuffle.
    facts = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("path")).agg(
        F.count("*").alias("calls"), F.countDistinct(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("apis"), F.count_if(F.col("l_tax") > 0.05).alias("persistence"), F.max(F.when(F.col("l_linestatus") == "O", F.col("l_discount"))).alias("deps"))
    joined = table(spark, sf, "part").select(F.col("p_partkey").alias("path")).join(facts, "path", "left")
    return joined.select("path", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("calls", "apis", "persistence")], F.coalesce("deps", F.lit(0.0)).alias("deps"))


@query("j16_impacted_tests", f"""WITH {B.EDGES_SQL}, changed AS (SELECT p_partkey AS path, p_brand AS dir FROM part WHERE p_partkey % 7 = 0), tests AS (SELECT p_partkey AS path, p_brand AS dir FROM part WHERE p_partkey % 5 = 0),
g AS (SELECT DISTINCT src AS path, 3 AS rank, 'graph' AS reason FROM edges WHERE dst IN (SELECT path FROM changed) AND src % 5 = 0),
a AS (SELECT DISTINCT t.path, 1 AS rank, 'directory' AS reason FROM tests t JOIN changed c ON t.dir = c.dir)
SELECT path, arg_max(reason, rank) AS reason FROM (SELECT * FROM g UNION ALL SELECT * FROM a) GROUP BY path""")
def j16(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("dir"))
    changed, tests = parts.where("path % 7 = 0"), parts.where("path % 5 = 0")
    by_graph = B.edges(spark, sf).where("src % 5 = 0").join(changed, F.col("dst") == F.col("path"), "left_semi").select(F.col("src").alias("path"), F.lit(3).alias("rank"), F.lit("graph").alias("reason"))
    by_dir = tests.join(changed.select("dir").distinct(), "dir", "left_semi").select("path", F.lit(1).alias("rank"), F.lit("directory").alias("reason"))
    return by_graph.union(by_dir).groupBy("path").agg(F.max_by("reason", "rank").alias("reason"))


@query("j17_coverage_inversion", """SELECT DISTINCT l_orderkey AS test_id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 37 = 0)""")
def j17(spark, sf):
    covered = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("test_id")).agg(F.collect_set("l_partkey").alias("files"))
    changed = table(spark, sf, "part").where("p_partkey % 37 = 0").select(F.col("p_partkey").alias("file"))
    return covered.select("test_id", F.explode("files").alias("file")).join(changed, "file", "left_semi").select("test_id").distinct()


@query("j18_coverage_gaps", f"""WITH {B.FILES_SQL} SELECT path, n_chars > 4000 AS high_risk FROM files WHERE NOT is_test AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def j18(spark, sf):
    files = B.files(spark, sf).where(~F.col("is_test"))
    return files.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").select("path", (F.col("n_chars") > 4000).alias("high_risk"))


@query("j19_stem_either_way", """WITH a AS (SELECT p_partkey AS path, 'p' || p_partkey AS stem FROM part), b AS (SELECT DISTINCT 'p' || (c_custkey // 4) AS stem FROM customer WHERE c_custkey % 9 = 0)
SELECT path FROM a WHERE EXISTS (SELECT 1 FROM b WHERE starts_with(a.stem, b.stem) OR starts_with(b.stem, a.stem))""")
def j19(spark, sf):
    a = table(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.concat(F.lit("p"), "p_partkey").alias("stem"))
    b = table(spark, sf, "customer").where("c_custkey % 9 = 0").select(F.concat(F.lit("p"), F.expr("c_custkey div 4")).alias("stem"))
    return R.either_prefix(a, b)


@query("j20_cpg_binding", """WITH f AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem),
x AS (SELECT l_orderkey, l_linenumber, l_partkey, min(l_suppkey) AS id FROM lineitem WHERE l_tax < 0.04 GROUP BY 1, 2, 3),
y AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS id FROM lineitem WHERE l_tax < 0.06 GROUP BY 1, 2), z AS (SELECT l_orderkey, min(l_suppkey) AS id FROM lineitem GROUP BY 1)
SELECT f.l_orderkey AS path, f.l_linenumber AS line, f.l_partkey AS name, coalesce(x.id, y.id, z.id) AS binding FROM f
LEFT JOIN x ON f.l_orderkey = x.l_orderkey AND f.l_linenumber = x.l_linenumber AND f.l_partkey = x.l_partkey
LEFT JOIN y ON f.l_orderkey = y.l_orderkey AND f.l_linenumber = y.l_linenumber LEFT JOIN z ON f.l_orderkey = z.l_orderkey""")
def j20(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("name"), "l_suppkey", "l_tax")
    facts = rows.select("path", "line", "name").distinct()
    x = rows.where("l_tax < 0.04").groupBy("path", "line", "name").agg(F.min("l_suppkey").alias("a"))
    y = rows.where("l_tax < 0.06").groupBy("path", "line").agg(F.min("l_suppkey").alias("b"))
    z = rows.groupBy("path").agg(F.min("l_suppkey").alias("c"))
    return facts.join(x, ["path", "line", "name"], "left").join(y, ["path", "line"], "left").join(z, "path", "left").select("path", "line", "name", F.coalesce("a", "b", "c").alias("binding"))


@query("j21_as_of", """SELECT p.event_id, p.user_id, coalesce(v.event_id, -1) AS enclosing FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT event_id, user_id, max(ts) AS ts FROM events WHERE event_type = 'view' GROUP BY ALL) v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def j21(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("enclosing"))
    return R.as_of(events.where("event_type = 'purchase'").drop("event_type"), views, "user_id", "ts", "enclosing").select("event_id", "user_id", F.coalesce("enclosing", F.lit(-1)).alias("enclosing"))


@query("j22_in_ranges", """WITH r AS (SELECT s_suppkey AS range_id, s_nationkey * 60 AS "start", s_nationkey * 60 + 15 + s_suppkey % 40 AS "end" FROM supplier)
SELECT p_partkey AS point, range_id FROM part JOIN r ON p_partkey BETWEEN r."start" AND r."end" """)
def j22(spark, sf):
    ranges = table(spark, sf, "supplier").selectExpr("s_suppkey as range_id", "s_nationkey * 60 as start", "s_nationkey * 60 + 15 + s_suppkey % 40 as end")
    points = table(spark, sf, "part").select(F.col("p_partkey").alias("point"))
    return R.in_ranges(points, ranges, [], "point", 64).select("point", "range_id")


@query("j23_nodes_with_communities", f"""WITH {B.EDGES_SQL}, deg AS (SELECT src AS id, count(*) AS degree FROM edges GROUP BY 1)
SELECT p_partkey AS id, p_brand AS community, coalesce(degree, 0) AS degree, coalesce(degree, 0) >= 2 AS anchor FROM part LEFT JOIN deg ON id = p_partkey""")
def j23(spark, sf):
    degree = B.edges(spark, sf).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("community"))
    n = F.coalesce("degree", F.lit(0))
    return nodes.join(degree, "id", "left").select("id", "community", n.alias("degree"), (n >= 2).alias("anchor"))


@query("j25_canonical_tests", f"""WITH {B.EDGES_SQL} SELECT src AS test, dst AS source, a.p_brand AS test_dir, b.p_brand AS source_dir FROM edges
JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE src % 5 = 0 AND dst % 5 <> 0 AND b.p_size > 10""")
def j25(spark, sf):
    part = table(spark, sf, "part")
    a = part.select(F.col("p_partkey").alias("test"), F.col("p_brand").alias("test_dir"))
    b = part.where("p_size > 10").select(F.col("p_partkey").alias("source"), F.col("p_brand").alias("source_dir"))
    pairs = B.edges(spark, sf).where("src % 5 = 0 and dst % 5 <> 0").select(F.col("src").alias("test"), F.col("dst").alias("source"))
    return pairs.join(a, "test").join(b, "source").select("test", "source", "test_dir", "source_dir")


@query("j26_runner_exclusion", """SELECT c_custkey AS test_id FROM customer WHERE c_custkey NOT IN (
SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate + INTERVAL 7 DAY > TIMESTAMP '1998-06-01')""")
def j26(spark, sf):
    quarantine = table(spark, sf, "orders").where("o_orderstatus = 'F' and o_orderdate + interval 7 days > timestamp '1998-06-01'")
    tests = table(spark, sf, "customer").select(F.col("c_custkey").alias("test_id"))
    return tests.join(quarantine, F.col("test_id") == F.col("o_custkey"), "left_anti")


@query("w1_rank_scores", """SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank,
round(1.0 / (60 + row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey))::DOUBLE, 9) AS score FROM orders""")
def w1(spark, sf):
    ranked = R.rank_all(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")])
    return ranked.select("o_orderkey", "rank", F.round(1.0 / (60 + F.col("rank")), 9).alias("score"))


@query("w2_first_last", """SELECT user_id, arg_min(event_id, event_id) AS first_id, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id""")
def w2(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("first_id"), F.max_by("event_type", "event_id").alias("last_type"))


@query("w3_cap_per_group", """SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3""")
def w3(spark, sf):
    return R.cap_per_key(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 3).drop("n_chars")


@query("w4_sibling_edges", """SELECT conv_id, turn AS src, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations QUALIFY dst IS NOT NULL""")
def w4(spark, sf):
    nxt = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("src"), nxt.alias("dst")).where("dst is not null")


@query("w6_prefix_fit", """SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS used FROM conversations QUALIFY used <= 1200""")
def w6(spark, sf):
    used = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf, "conversations").select("conv_id", "turn", used.alias("used")).where("used <= 1200")


@query("w8_last_n", """SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5""")
def w8(spark, sf):
    return R.cap_per_key(table(spark, sf, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).drop("ts")


LINES_SQL = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS n FROM documents)"""


def doc_lines(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))


@query("w9_line_context", f"""WITH {LINES_SQL}, f AS (SELECT doc_id, n, coalesce(regexp_matches(line, 'token|example'), false) AS hit FROM lines)
SELECT doc_id, n FROM f QUALIFY hit OR coalesce(lag(hit) OVER w, false) OR coalesce(lead(hit) OVER w, false) WINDOW w AS (PARTITION BY doc_id ORDER BY n)""".replace(" QUALIFY hit OR coalesce(lag(hit) OVER w, false) OR coalesce(lead(hit) OVER w, false) WINDOW w AS (PARTITION BY doc_id ORDER BY n)", " WINDOW w AS (PARTITION BY doc_id ORDER BY n) QUALIFY hit OR coalesce(lag(hit) OVER w, false) OR coalesce(lead(hit) OVER w, false)"))
def w9(spark, sf):
    w = Window.partitionBy("doc_id").orderBy("n")
    rows = doc_lines(spark, sf).select("doc_id", "n", F.col("line").rlike("token|example").alias("hit"))
    near = rows.withColumn("keep", F.col("hit") | F.coalesce(F.lag("hit").over(w), F.lit(False)) | F.coalesce(F.lead("hit").over(w), F.lit(False)))
    return near.where("keep").select("doc_id", "n")


@query("w10_omitted_runs", f"""WITH {LINES_SQL}, o AS (SELECT doc_id, n, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS island FROM lines WHERE length(line) < 40)
SELECT doc_id, min(n) AS first_line, max(n) AS last_line, count(*) AS omitted FROM o GROUP BY doc_id, island""")
def w10(spark, sf):
    rows = doc_lines(spark, sf).where(F.length("line") < 40).select("doc_id", "n")
    island = F.col("n") - F.row_number().over(Window.partitionBy("doc_id").orderBy("n"))
    return rows.withColumn("island", island).groupBy("doc_id", "island").agg(F.min("n").alias("first_line"), F.max("n").alias("last_line"), F.count("*").alias("omitted")).drop("island")


@query("w11_merge_intervals", """WITH r AS (SELECT s_nationkey AS f, s_suppkey % 50 * 3 AS a, s_suppkey % 50 * 3 + s_suppkey % 7 AS b FROM supplier),
m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY f ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM r),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY f ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT f AS file, min(a) AS "start", max(b) AS "end" FROM i GROUP BY f, g""")
def w11(spark, sf):
    w = Window.partitionBy("file").orderBy("start", "end")
    r = table(spark, sf, "supplier").selectExpr("s_nationkey as file", "s_suppkey % 50 * 3 as start", "s_suppkey % 50 * 3 + s_suppkey % 7 as end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    g = r.withColumn("fresh", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("g", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("file", "g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("g")


@query("p3_path_regex", f"WITH {B.FILES_SQL} SELECT path FROM files WHERE regexp_matches(path, '^src[0-3]/.*[.](en|fr)$')")
def p3(spark, sf):
    return B.files(spark, sf).where(F.col("path").rlike("^src[0-3]/.*[.](en|fr)$")).select("path")


@query("p1_active_filter", f"""WITH {B.EDGES_SQL}, act AS (SELECT p_partkey AS id FROM part WHERE p_size > 5) SELECT src, dst FROM edges WHERE src IN (SELECT id FROM act) AND dst IN (SELECT id FROM act) AND weight < 4""")
def p1(spark, sf):
    active = table(spark, sf, "part").where("p_size > 5").select(F.col("p_partkey").alias("path"))
    return R.local_edges(B.edges(spark, sf).where("weight < 4"), active).select("src", "dst")


@query("p5_search_document", """SELECT p_partkey AS id, concat_ws(chr(10), p_name, p_type, p_brand, '{"p_size":' || p_size || '}') AS document FROM part""")
def p5(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("\n", "p_name", "p_type", "p_brand", F.to_json(F.struct("p_size"))).alias("document"))


@query("p7_path_coalesce", """SELECT event_id, coalesce(json_extract_string(props, '$.path'), json_extract_string(props, '$.k')) AS path FROM events""")
def p7(spark, sf):
    v = F.parse_json("props")
    return table(spark, sf, "events").select("event_id", F.coalesce(F.try_variant_get(v, "$.path", "string"), F.try_variant_get(v, "$.k", "string")).alias("path"))


@query("p14_redaction", """SELECT event_id, CASE WHEN event_type = 'error' THEN '[redacted]' ELSE props END AS evidence FROM events""")
def p14(spark, sf):
    return table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "error", F.lit("[redacted]")).otherwise(F.col("props")).alias("evidence"))


@query("u1_union_first", f"""WITH {B.EDGES_SQL}, u AS (SELECT src, dst, 1 AS prio FROM edges UNION ALL SELECT dst, src, 2 FROM edges UNION ALL SELECT src, src + 1, 3 FROM edges)
SELECT src, dst, min(prio) AS prio FROM u GROUP BY src, dst""")
def u1(spark, sf):
    e = B.edges(spark, sf)
    u = e.select("src", "dst", F.lit(1).alias("prio")).union(e.select("dst", "src", F.lit(2))).union(e.selectExpr("src", "src + 1", "3"))
    return R.first_per_key(u, ["src", "dst"], ["prio"])


@query("u2_union_max", """WITH u AS (SELECT l_partkey AS test, l_discount AS confidence, 'graph' AS reason FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_partkey, l_tax, 'path' FROM lineitem WHERE l_returnflag = 'A')
SELECT test, max(confidence) AS confidence FROM u GROUP BY test""")
def u2(spark, sf):
    li = table(spark, sf, "lineitem")
    u = li.where("l_returnflag = 'R'").selectExpr("l_partkey as test", "l_discount as confidence").union(li.where("l_returnflag = 'A'").selectExpr("l_partkey", "l_tax"))
    return u.groupBy("test").agg(F.max("confidence").alias("confidence"))


@query("u4_visible_edges", f"""WITH {B.EDGES_SQL}, s AS (SELECT p_partkey AS path FROM part WHERE p_type IN ('ECONOMY', 'STANDARD')) SELECT src, dst FROM edges WHERE src IN (FROM s) AND dst IN (FROM s)""")
def u4(spark, sf):
    return R.local_edges(B.edges(spark, sf), table(spark, sf, "part").where("p_type in ('ECONOMY', 'STANDARD')").select(F.col("p_partkey").alias("path"))).select("src", "dst")


@query("u5_except", """SELECT DISTINCT o_custkey AS id FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD'""")
def u5(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_custkey as id").subtract(table(spark, sf, "customer").where("c_mktsegment = 'HOUSEHOLD'").selectExpr("c_custkey"))


@query("text_scalars", f"""WITH {B.FILES_SQL} SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir, split_part(path, '/', -1) AS base, split_part(split_part(path, '/', -1), '.', 1) AS stem,
greatest(1, ceil((length(text) - length(regexp_replace(text, '[\\x00-\\x7f]', '', 'g'))) * 0.25 + length(regexp_replace(text, '[\\x00-\\x7f]', '', 'g')) * 0.5))::BIGINT AS tokens,
'lw:file:' || substr(sha256('ws' || chr(0) || 'file' || chr(0) || path), 1, 32) AS id FROM files""")
def scalars(spark, sf):
    p = F.col("path")
    return B.files(spark, sf).select("path", X.dirname(p).alias("dir"), X.basename(p).alias("base"), X.stem(p).alias("stem"), X.token_estimate(F.col("text")).alias("tokens"), X.stable_id("lw:file:", F.lit("ws"), F.lit("file"), p).alias("id"))
