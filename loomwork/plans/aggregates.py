"""Aggregates, top-k reports and pagination over the fixture tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork.functions import text as X
from loomwork.operators import aggregates as A
from loomwork.plans import bindings as B
from loomwork.plans.registry import query
from loomwork.plans.relational import DIFF_SQL, LINES_SQL, doc_lines
from loomwork.operators import relational as R
from loomwork.session import table


@query("a1_degree_distinct", f"""WITH {B.EDGES_SQL}, o AS (SELECT src AS id, count(DISTINCT dst) AS n FROM edges GROUP BY 1), i AS (SELECT dst AS id, count(DISTINCT src) AS n FROM edges GROUP BY 1),
b AS (SELECT src AS id, dst AS x FROM edges UNION SELECT dst, src FROM edges), t AS (SELECT id, count(*) AS n FROM b GROUP BY id)
SELECT t.id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, t.n AS degree FROM t LEFT JOIN o USING (id) LEFT JOIN i USING (id)""")
def a1(spark, sf):
    return A.degrees(B.edges(spark, sf))


@query("a2_degree_all_edges", f"WITH {B.EDGES_SQL} SELECT id, sum(n)::BIGINT AS degree FROM (SELECT src AS id, count(*) AS n FROM edges GROUP BY 1 UNION ALL SELECT dst, count(*) FROM edges GROUP BY 1) GROUP BY id")
def a2(spark, sf):
    ends = B.edges(spark, sf).select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


@query("a3_kind_counts", "SELECT lang AS kind, count(*) AS n FROM documents GROUP BY lang")
def a3(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("lang").alias("kind")).agg(F.count("*").alias("n"))


COUPLING_SQL = f"""WITH {B.COMMITS_SQL}, b AS (SELECT commit_id, path FROM commits QUALIFY row_number() OVER (PARTITION BY commit_id ORDER BY path) <= 50),
f AS (SELECT path, count(*) AS n FROM b GROUP BY path),
p AS (SELECT x.path AS file_a, y.path AS file_b, count(*) AS commits FROM b x JOIN b y ON x.commit_id = y.commit_id AND x.path < y.path GROUP BY 1, 2 HAVING count(*) >= 2),
c AS (SELECT file_a, file_b, commits, round(commits / greatest(a.n, z.n)::DOUBLE, 6) AS strength FROM p JOIN f a ON a.path = file_a JOIN f z ON z.path = file_b)"""


@query("a4_cochange_coupling", COUPLING_SQL + " SELECT file_a, file_b, commits, strength FROM c ORDER BY strength DESC, commits DESC, file_a, file_b LIMIT 500")
def a4(spark, sf):
    return A.coupling(B.commits(spark, sf)).orderBy(F.desc("strength"), F.desc("commits"), "file_a", "file_b").limit(500)


@query("a5_change_counts", f"WITH {DIFF_SQL} SELECT " + ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}" for k in A.CHANGE_KINDS) + " FROM changes")
def a5(spark, sf):
    return A.change_counts(R.diff(*B.snapshots(spark, sf)))


A6_ROWS = [("src/a.ts: uses password",), ("src/a.ts: uses token",), ("no separator",), (": at the start",), ("src/b.ts: loop: deep",)]


@query("a6_signal_groups", f"WITH {B.values_sql('s', ['signal'], A6_ROWS)}, t AS (SELECT CASE WHEN instr(signal, ': ') > 1 THEN substr(signal, 1, instr(signal, ': ') - 1) ELSE 'workspace' END AS file, signal FROM s UNION ALL SELECT 'd' || doc_id, 'd' || doc_id || ': ' || lang FROM documents) SELECT file, count(*) AS n, string_agg(signal, '|' ORDER BY signal) AS signals FROM t GROUP BY file")
def a6(spark, sf):
    rows = B.literal(spark, "signal string", A6_ROWS)
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id", F.lit(": "), "lang").alias("signal"))
    return A.signal_groups(rows.union(docs))


@query("a7_first_wins", "SELECT l_partkey, l_suppkey, min(l_orderkey * 10 + l_linenumber) AS first_seen FROM lineitem GROUP BY 1, 2")
def a7(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_seen"))


@query("a8_last_wins", "SELECT user_id, min(event_id) AS first_position, arg_max(event_type, event_id) AS value FROM events GROUP BY user_id")
def a8(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("first_position"), F.max_by("event_type", "event_id").alias("value"))


SEVERITY_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END"
WEIGHT_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 20 WHEN '2-HIGH' THEN 8 WHEN '3-MEDIUM' THEN 3 ELSE 1 END"


def severities(spark, sf):
    p = F.col("o_orderpriority")
    sev = F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "high").when(p == "3-MEDIUM", "medium").otherwise("low")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("file"), sev.alias("severity"), "o_orderkey")


@query("a9_severity_summary", f"""WITH s AS (SELECT o_custkey AS file, {SEVERITY_SQL} AS s FROM orders), g AS (SELECT file, count(*) FILTER (WHERE s = 'critical') AS critical, count(*) FILTER (WHERE s = 'high') AS high,
count(*) FILTER (WHERE s = 'medium') AS medium, count(*) FILTER (WHERE s = 'low') AS low FROM s GROUP BY file), x AS (SELECT *, least(100, 20 * critical + 8 * high + 3 * medium + low) AS risk_score FROM g)
SELECT *, CASE WHEN risk_score >= 80 THEN 'critical' WHEN risk_score >= 45 THEN 'high' WHEN risk_score >= 15 THEN 'medium' ELSE 'low' END AS risk_level FROM x""")
def a9(spark, sf):
    return A.severity_summary(severities(spark, sf), "file")


@query("a10_hotspots", f"SELECT o_custkey AS file, count(*) AS findings, sum({WEIGHT_SQL})::BIGINT AS weight FROM orders GROUP BY 1 ORDER BY weight DESC, findings DESC, file LIMIT 20")
def a10(spark, sf):
    return A.hotspots(severities(spark, sf), "file", 20)


@query("a11_health", """WITH r AS (SELECT 'labelled' AS "check", (SELECT count(DISTINCT doc_id) FROM labels)::DOUBLE / nullif((SELECT count(*) FROM documents), 0) AS ratio
UNION ALL SELECT 'current', avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) FROM orders UNION ALL SELECT 'passing', avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) FROM events)
SELECT round(avg(coalesce(ratio, 1)) * 100)::INTEGER AS score, CASE WHEN round(avg(coalesce(ratio, 1)) * 100) >= 80 THEN 'healthy' WHEN round(avg(coalesce(ratio, 1)) * 100) >= 50 THEN 'degraded' ELSE 'unhealthy' END AS status FROM r""")
def a11(spark, sf):
    docs, labels = table(spark, sf, "documents").agg(F.count("*").alias("n")), table(spark, sf, "labels").agg(F.countDistinct("doc_id").alias("m"))
    ratio = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0)).alias("ratio")
    checks = docs.join(labels, how="cross").select(F.try_divide("m", "n").alias("ratio"))  # two single rows
    checks = checks.union(table(spark, sf, "orders").agg(ratio(F.col("o_orderstatus") == "F"))).union(table(spark, sf, "events").agg(ratio(F.col("event_type") != "error")))
    return A.health(checks)


@query("a12_family_rollup", "SELECT p_type AS family, count(*) AS stages, count(*) FILTER (WHERE p_size > 45) AS failed, bool_or(p_size > 45) AS degraded, max(p_size) AS longest FROM part GROUP BY p_type")
def a12(spark, sf):
    bad = F.col("p_size") > 45
    return table(spark, sf, "part").groupBy(F.col("p_type").alias("family")).agg(F.count("*").alias("stages"), F.count_if(bad).alias("failed"), F.bool_or(bad).alias("degraded"), F.max("p_size").alias("longest"))


@query("a13_stage_metrics", "SELECT count(*) AS files, count(DISTINCT lang) AS languages, count(DISTINCT source) AS modules, count(*) FILTER (WHERE n_chars > 5000) AS large, sum(n_chars)::BIGINT AS chars FROM documents")
def a13(spark, sf):
    return table(spark, sf, "documents").agg(F.count("*").alias("files"), F.countDistinct("lang").alias("languages"), F.countDistinct("source").alias("modules"), F.count_if(F.col("n_chars") > 5000).alias("large"), F.sum("n_chars").alias("chars"))


@query("a14_community_stats", f"""WITH {B.EDGES_SQL}, e AS (SELECT a.p_brand AS c, b.p_brand AS d, weight FROM edges JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst),
w AS (SELECT c, weight, c = d AS inside FROM e UNION ALL SELECT d, weight, false FROM e WHERE c <> d),
k AS (SELECT p_brand AS c, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS rn FROM part GROUP BY 1, 2)
SELECT c AS community, coalesce(sum(weight) FILTER (WHERE inside), 0)::BIGINT AS internal, coalesce(sum(weight) FILTER (WHERE NOT inside), 0)::BIGINT AS boundary,
(SELECT string_agg(p_type, ',' ORDER BY rn) FROM k WHERE k.c = w.c AND rn <= 3) AS kinds FROM w GROUP BY c""")
def a14(spark, sf):
    members = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("community"), F.col("p_type").alias("kind"))
    return A.community_stats(B.edges(spark, sf), members)


@query("a15_anchor_composition", f"""WITH {B.EDGES_SQL}, n AS (SELECT src AS id, dst AS other, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges),
k AS (SELECT id, p_type AS kind, count(*) AS n, sum(weight) AS w FROM n JOIN part ON p_partkey = other GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, kind) AS rn FROM k)
SELECT id, sum(w)::BIGINT AS weighted, string_agg(kind || ':' || n, ',' ORDER BY rn) FILTER (WHERE rn <= 3) AS composition FROM r GROUP BY id HAVING sum(w) >= 4""")
def a15(spark, sf):
    kinds = table(spark, sf, "part").select(F.col("p_partkey").alias("other"), F.col("p_type").alias("kind"))
    return A.anchor_composition(B.edges(spark, sf), kinds, 4)


@query("a16_module_coverage", f"""WITH {B.FILES_SQL}, s AS (SELECT source AS dir, count(*) AS sources, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS covered FROM files WHERE NOT is_test GROUP BY 1),
t AS (SELECT source AS dir, count(*) AS tests FROM files WHERE is_test GROUP BY 1)
SELECT coalesce(s.dir, t.dir) AS dir, coalesce(sources, 0) AS sources, coalesce(covered, 0) AS covered, round(coalesce(covered::DOUBLE / sources, 0), 6) AS ratio, coalesce(tests, 0) AS tests FROM s FULL OUTER JOIN t ON s.dir = t.dir""")
def a16(spark, sf):
    labelled = table(spark, sf, "labels").select("doc_id").distinct().withColumn("hit", F.lit(True))
    files = B.files(spark, sf).select("doc_id", "source", "is_test").join(labelled, "doc_id", "left")
    # One aggregate with filters is the full outer join of two: the key is the same.
    g = files.groupBy(F.col("source").alias("dir")).agg(F.count_if(~F.col("is_test")).alias("sources"), F.count_if(~F.col("is_test") & F.col("hit").isNotNull()).alias("covered"), F.count_if("is_test").alias("tests"))
    return g.select("dir", "sources", "covered", F.round(F.coalesce(F.try_divide("covered", "sources"), F.lit(0.0)), 6).alias("ratio"), "tests")


@query("a17_coverage_union", "SELECT l_partkey AS file, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS lines FROM lineitem GROUP BY 1")
def a17(spark, sf):
    per_test = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_partkey").alias("file")).agg(F.collect_set("l_linenumber").alias("ls"))
    merged = per_test.select("file", F.explode("ls").alias("l")).groupBy("file").agg(F.sort_array(F.collect_set(F.col("l").cast("string"))).alias("x"))
    return merged.select("file", F.array_join("x", ",").alias("lines"))


FLAKY_SQL = f"WITH {B.RUNS_SQL} SELECT test_id, count(*) AS runs, count(*) FILTER (WHERE NOT passed) AS failures, round(avg(CASE WHEN passed THEN 0.0 ELSE 1.0 END), 6) AS rate, coalesce(min(attempt) FILTER (WHERE NOT passed), -1) AS first_failure FROM runs GROUP BY test_id HAVING round(avg(CASE WHEN passed THEN 0.0 ELSE 1.0 END), 6) >= 0.2 AND bool_or(passed)"


@query("a18_flaky_rate", FLAKY_SQL)
def a18(spark, sf):
    return A.flaky(B.runs(spark, sf), 0.2)


@query("a19_failure_classes", "SELECT event_type AS class, count(*) AS n FROM events GROUP BY 1")
def a19(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("class")).agg(F.count("*").alias("n"))


@query("a20_diagnostics_dedupe", f"""WITH {LINES_SQL}, k AS (SELECT *, trim(lower(regexp_replace(regexp_replace(line, '[0-9]+', '#', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) AS key FROM lines WHERE length(line) > 0)
SELECT sha256(key) AS key, count(*) AS occurrences, min(doc_id * 100000 + n) AS first_at FROM k GROUP BY key HAVING count(*) > 1""")
def a20(spark, sf):
    rows = doc_lines(spark, sf).where(F.length("line") > 0).select(X.signal_key(F.col("line")).alias("key"), (F.col("doc_id") * 100000 + F.col("n")).alias("at"))
    return rows.groupBy("key").agg(F.count("*").alias("occurrences"), F.min("at").alias("first_at")).where("occurrences > 1").select(F.sha2("key", 256).alias("key"), "occurrences", "first_at")


@query("a21_grouped_signals", "SELECT event_type, count(*) AS n, (SELECT string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FROM (SELECT event_id FROM events x WHERE x.event_type = e.event_type ORDER BY event_id LIMIT 5)) AS sample FROM events e GROUP BY event_type")
def a21(spark, sf):
    rows = table(spark, sf, "events").select("event_type", "event_id")
    first = R.cap_per_key(rows, ["event_type"], [F.col("event_id")], 5).groupBy("event_type").agg(F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), ",").alias("sample"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n")).join(first, "event_type")


@query("a22_savings", "SELECT l_returnflag AS category, round(sum(l_extendedprice), 2) AS original, round(sum(l_extendedprice * (1 - l_discount)), 2) AS transmitted, round(sum(l_extendedprice * l_discount), 2) AS avoided, count(*) AS events FROM lineitem GROUP BY 1")
def a22(spark, sf):
    p, d = F.col("l_extendedprice"), F.col("l_discount")
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("category")).agg(F.round(F.sum(p), 2).alias("original"), F.round(F.sum(p * (1 - d)), 2).alias("transmitted"), F.round(F.sum(p * d), 2).alias("avoided"), F.count("*").alias("events"))


@query("a23_modernization_metrics", f"WITH {B.FILES_SQL} SELECT count(*) AS files, round(avg(line_count), 6) AS avg_lines, max(line_count) AS max_lines, count(*) FILTER (WHERE line_count > 20) AS large, count(*) FILTER (WHERE is_test) AS tests FROM files")
def a23(spark, sf):
    return B.files(spark, sf).agg(F.count("*").alias("files"), F.round(F.avg("line_count"), 6).alias("avg_lines"), F.max("line_count").alias("max_lines"), F.count_if(F.col("line_count") > 20).alias("large"), F.count_if("is_test").alias("tests"))


@query("a24_risk_heat", "SELECT l_suppkey AS area, least(100.0, round(sum(l_discount * l_tax * 25), 4))::DOUBLE AS heat, ceil(sum(l_quantity) / 8)::BIGINT AS days FROM lineitem GROUP BY 1")
def a24(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("area")).agg(F.least(F.lit(100.0), F.round(F.sum(F.col("l_discount") * F.col("l_tax") * 25), 4)).alias("heat"), F.ceil(F.sum("l_quantity") / 8).alias("days"))


@query("a25_plan_progress", """SELECT o_custkey AS plan, round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 4)::DOUBLE AS percent,
coalesce(min(o_orderkey) FILTER (WHERE o_orderstatus <> 'F'), -1) AS next_phase FROM orders GROUP BY 1""")
def a25(spark, sf):
    done = F.col("o_orderstatus") == "F"
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("plan")).agg(F.round(100.0 * F.count_if(done) / F.count("*"), 4).alias("percent"), F.coalesce(F.min(F.when(~done, F.col("o_orderkey"))), F.lit(-1)).alias("next_phase"))


@query("a26_event_metrics", "SELECT event_type, count(*) AS n, round(avg(value) FILTER (WHERE value > 1), 6) AS avg_duration FROM events GROUP BY 1")
def a26(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("value") > 1, F.col("value"))), 6).alias("avg_duration"))


@query("a27_snapshot_digest", f"""WITH {B.FILES_SQL}, l AS (SELECT source, sha256(path || ':' || content_hash) AS d FROM files), b AS (SELECT source, substr(d, 1, 4) AS b, count(*) AS n, sha256(string_agg(d, '' ORDER BY d)) AS d FROM l GROUP BY 1, 2)
SELECT source, sum(n)::BIGINT AS files, sha256(string_agg(d, '' ORDER BY b)) AS digest FROM b GROUP BY source""")
def a27(spark, sf):
    return A.digests(B.files(spark, sf), ["source"], F.sha2(F.concat_ws(":", "path", "content_hash"), 256))


@query("a28_retrieval_metrics", "SELECT round(avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(CASE WHEN n_chars > 2000 THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(quality), 6) AS mean_score FROM labels JOIN documents USING (doc_id)")
def a28(spark, sf):
    met = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return met.agg(F.round(F.avg(F.when(F.col("toxic") == 1, 1.0).otherwise(0.0)), 6).alias("hit_rate"), F.round(F.avg(F.when(F.col("n_chars") > 2000, 1.0).otherwise(0.0)), 6).alias("coverage"), F.round(F.avg("quality"), 6).alias("mean_score"))


@query("a29_top5_confidence", "SELECT o_custkey AS query, round(avg(o_totalprice), 4) AS confidence FROM (SELECT o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 5) GROUP BY 1")
def a29(spark, sf):
    top = R.cap_per_key(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 5)
    return top.groupBy(F.col("o_custkey").alias("query")).agg(F.round(F.avg("o_totalprice"), 4).alias("confidence"))


A30_ROWS = [(1, "Tests: 3 failed, 12 passed, 15 total"), (2, "5 passing (20ms)\n  2 failing"), (3, "== 7 passed, 1 failed in 0.3s =="), (4, "BUILD OK"), (5, "FAILED 4 of 9")]


@query("a30_validation_counters", f"""WITH {B.values_sql("o", ["id", "output"], A30_ROWS)} SELECT id, coalesce(nullif(regexp_extract(output, '([0-9]+) (?:passed|passing)', 1), ''), '0')::BIGINT AS passed,
coalesce(nullif(regexp_extract(output, '([0-9]+) (?:failed|failing)', 1), ''), nullif(regexp_extract(output, 'FAILED ([0-9]+)', 1), ''), '0')::BIGINT AS failed, len(regexp_extract_all(output, '[0-9]+'))::INTEGER AS numbers FROM o""")
def a30(spark, sf):
    return A.validation_counters(B.literal(spark, "id int, output string", A30_ROWS))


@query("t4_hubs", f"WITH {B.EDGES_SQL}, b AS (SELECT src AS id, dst AS x FROM edges UNION SELECT dst, src FROM edges) SELECT id, count(*) AS degree FROM b GROUP BY id ORDER BY degree DESC, id LIMIT 20")
def t4(spark, sf):
    return A.degrees(B.edges(spark, sf)).select("id", "degree").orderBy(F.desc("degree"), "id").limit(20)


@query("t5_explorer_page", "SELECT p_partkey AS id, p_retailprice AS score FROM part ORDER BY p_retailprice DESC, p_size DESC, p_partkey LIMIT 25 OFFSET 50")
def t5(spark, sf):
    cursor = A.page_cursor("part", "", 50, "d")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"), "p_size")
    return A.page(rows, [F.desc("score"), F.desc("p_size"), F.col("id")], A.cursor_offset(cursor, "part", "", "d"), 25).drop("p_size")


@query("t8_findings_order", f"SELECT o_orderkey AS id, {SEVERITY_SQL} AS severity, row_number() OVER (ORDER BY {WEIGHT_SQL} DESC, o_orderkey) AS position FROM orders")
def t8(spark, sf):
    rows = severities(spark, sf).select(F.col("o_orderkey").alias("id"), "severity", A.severity_weight(F.col("severity")).alias("w"))
    return R.rank_all(rows, [F.desc("w"), F.col("id")], "position").drop("w")


@query("t10_context_order", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem ORDER BY round(l_extendedprice / l_quantity, 6) DESC, l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100")
def t10(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.orderBy(F.round(F.col("l_extendedprice") / F.col("l_quantity"), 6).desc(), F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(100).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("t13_priority_paths", f"WITH {B.FILES_SQL} SELECT path FROM files ORDER BY is_test DESC, path LIMIT 60")
def t13(spark, sf):
    return B.files(spark, sf).orderBy(F.desc("is_test"), "path").limit(60).select("path")
