"""Findings, risk and quality analytics over literal fixtures and the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import aggregates as A
from loomwork.operators import extract as E
from loomwork.operators import modernization as M
from loomwork.operators import quality as Q
from loomwork.operators import relational as R
from loomwork.plans import bindings as B
from loomwork.plans.aggregates import COUPLING_SQL
from loomwork.plans.extraction import ALL_LINES_SQL, LINES_SQL, SRC_SQL, _q, everything, sources
from loomwork.plans.registry import query
from loomwork.session import table

LINT = [
    ("a.ts", "typescript", "const password = 'hunter22x'\n// password = 'commented1'\neval(x)\nel.innerHTML = y\nfetch(url)\nsetInterval(f, 1)\nconst h = md5(z)"),
    ("b.py", "python", "open(request.path)\nlogger.info(token)\nresult = json.dumps(rows)\nq = \"select * from t where a=\" + b\nurl = 'http://example.com'\nok = 'http://localhost'"),
    ("c.js", "javascript", "for (const a of b) { await go(a) }\nreadFileSync(p)\norigin: '*'\nexec(`rm ${x}`)\nhelmet()\nuse cache with limit and timeout: 5 and sanitize"),
]
LINT_SQL = B.values_sql("src", ["path", "lang", "text"], LINT) + ", ln AS (SELECT path, unnest(string_split(text, chr(10))) AS code, unnest(range(1, len(string_split(text, chr(10))) + 1))::INTEGER AS line FROM src)"


def _hit(category: str, pattern: str) -> str:
    """A line rule in RE2; rules with a look-ahead are said as a match of one and not of another pattern."""
    if category == "transport":
        return """len(list_filter(regexp_extract_all(lower(code), '["'']http://.{0,9}'), lambda x: NOT starts_with(substr(x, 9), '127.0.0.1') AND NOT starts_with(substr(x, 9), 'localhost'))) > 0"""
    if category == "unbounded-query":
        return r"""len(list_filter(regexp_extract_all(code, '(?i)\bselect\b[^;\n]*'), lambda x: NOT regexp_matches(x, '(?i)\blimit\b') AND regexp_matches(x, '(?i)\bselect\b.*(?:from|join)\b'))) > 0"""
    if category == "loop-await":
        return r"""regexp_matches(regexp_replace(code, '\b(for|while)(\s+await\b)', '\2', 'g'), '\b(?:for|while)\s*[^\n{]*[{:]?[^\n]{0,160}\bawait\b')"""
    return f"regexp_matches(code, {_q(pattern)})"


_LINES = " UNION ALL ".join(f"SELECT path, line, {_q(k)} AS kind, {_q(c)} AS category, {_q(s)} AS severity, {_q(t)} AS title, {n}::DOUBLE AS confidence, {_q('[REDACTED sensitive expression]') if red else 'substr(trim(code), 1, 240)'} AS evidence FROM ln WHERE NOT regexp_matches(code, {_q(Q.COMMENT)}) AND {_hit(c, p)}" for k, c, s, t, p, n, red in Q.LINE_RULES)


def lint(spark):
    return B.literal(spark, "path string, lang string, text string", LINT)


@query("f3_line_rules", f"WITH {LINT_SQL} {_LINES}")
def f3(spark, sf):
    return Q.scan_lines(E.lines(lint(spark)))


@query("f3_line_rules_documents", f"WITH {ALL_LINES_SQL}, h AS ({_LINES}) SELECT path, title, count(*) AS hits, min(line) AS first FROM h GROUP BY path, title")
def f3_docs(spark, sf):
    found = Q.scan_lines(E.lines(everything(spark, sf)))
    return found.groupBy("path", "title").agg(F.count("*").alias("hits"), F.min("line").alias("first"))


@query("f4_safeguards", f"WITH {LINT_SQL} " + " UNION ALL ".join(f"SELECT path, {_q(k)} AS kind, {_q(c)} AS control FROM src WHERE regexp_matches(text, {_q(p)})" for k, c, p in Q.SAFEGUARDS))
def f4(spark, sf):
    return Q.safeguards(lint(spark))


def _id(category, title, file, description):
    return f"substr(sha256('{category}' || '|' || '{title}' || '|' || {file} || '|' || {description}), 1, 24)"


_ORPH = f"SELECT 'p' || p_partkey AS file FROM part WHERE p_partkey NOT IN (SELECT src FROM edges) AND p_partkey NOT IN (SELECT dst FROM edges)"


@query("f1_findings", f"""WITH {B.EDGES_SQL}, o AS ({_ORPH}), d AS (SELECT 'p' || src AS file, 'p' || dst AS target FROM edges WHERE dst % 3 = 0),
{COUPLING_SQL.removeprefix("WITH ")}, cc AS (SELECT 'p' || file_a AS file, 'p' || file_b AS other, commits, strength FROM c WHERE commits >= 3 AND strength >= 0.5 ORDER BY strength DESC, commits DESC, file, other LIMIT 100)
SELECT {_id('quality', 'Disconnected source file', 'file', "file || ' has no resolved local dependency edges.'")} AS id, 'quality' AS category, 'low' AS severity, 0.6::DOUBLE AS confidence, file FROM o
UNION SELECT {_id('dependency', 'Unresolved local import', 'file', "file || ' imports ' || target || ', which is not an indexed file.'")}, 'dependency', 'low', 0.8, file FROM d
UNION SELECT {_id('architecture', 'Historical co-change coupling', 'file', "file || ' and ' || other || ' changed together in ' || commits || ' commits.'")}, 'architecture', 'info', round(least(0.95, 0.5 + strength / 2), 6), file FROM cc
UNION SELECT {_id('architecture', 'Dependency cycle', "'x'", "'x → y'")}, 'architecture', 'medium', 0.95, 'x' UNION SELECT {_id('quality', 'Possible dead code', "'y'", "'lost has no incoming semantic evidence.'")}, 'quality', 'low', 0.8, 'y'""")
def f1(spark, sf):
    name = lambda c: F.concat(F.lit("p"), c)
    edges = B.edges(spark, sf)
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("path"))
    orphans = R.orphans(parts, edges, parts.where("false")).select(name("path").alias("file"))
    dangling = edges.where("dst % 3 = 0").select(name("src").alias("file"), name("dst").alias("target"))
    coupled = A.coupling(B.commits(spark, sf)).select(name("file_a").alias("file"), name("file_b").alias("other"), "commits", "strength")
    cycles, dead = B.literal(spark, "file string, members string", [("x", "x → y")]), B.literal(spark, "file string, name string", [("y", "lost")])
    return Q.findings(cycles, orphans, dangling, coupled, dead).select("id", "category", "severity", "confidence", "file")


SIGNALS = [("a", "security", "token"), ("a", "security", "explicit authorization boundary"), ("b", "security", "auth"), ("b", "performance", "database operation inside loop"), ("c", "performance", "cache"), ("d", "performance", "queue")]


@query("f2_signal_findings", f"""WITH {B.values_sql("s", ["file", "category", "marker"], SIGNALS)}, st AS (SELECT 'a' AS file UNION ALL SELECT 'd'),
g AS (SELECT file, category, count(*) AS n, bool_or(marker = 'explicit authorization boundary' AND category = 'security') AS auth, bool_or(marker = 'database operation inside loop' AND category = 'performance') AS loop FROM s GROUP BY ALL),
c AS (SELECT *, CASE WHEN auth OR loop THEN 0.7 WHEN category = 'security' THEN 0.55 ELSE 0.5 END AS sure FROM g)
SELECT file, category, n, CASE WHEN auth THEN 'Explicit authorization boundary' WHEN loop THEN 'Database operation inside loop' WHEN category = 'security' THEN 'Security-sensitive code' ELSE 'Performance-sensitive code' END AS title,
CASE WHEN loop OR category = 'security' THEN 'medium' ELSE 'low' END AS severity, round(CASE WHEN file IN (SELECT file FROM st) THEN least(0.85, sure + 0.15) ELSE sure END, 6)::DOUBLE AS confidence FROM c""")
def f2(spark, sf):
    return Q.signal_findings(B.literal(spark, "file string, category string, marker string", SIGNALS), B.literal(spark, "file string", [("a",), ("d",)]))


@query("f6_dead_code", """SELECT p_partkey AS path, p_size AS line, p_name AS name, 0.8::DOUBLE AS confidence FROM part WHERE p_partkey % 4 = 1 AND p_partkey % 3 <> 0 AND p_size % 2 = 0
AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity = p_size)""")
def f6(spark, sf):
    p = table(spark, sf, "part")
    key = F.col("p_partkey")
    symbols = p.select(key.alias("path"), F.col("p_size").alias("line"), F.col("p_name").alias("name"), F.lit("function").alias("kind"), (F.col("p_size") % 2 == 1).alias("exported"))
    files = p.select(key.alias("path"), F.when(key % 4 == 1, "typescript").otherwise("python").alias("lang"), F.lit(False).alias("is_test"), (key % 3 == 0).alias("entry"), F.lit(False).alias("api"), F.lit(True).alias("orphan"))
    refs = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("path"), F.col("l_quantity").cast("int").alias("line"))
    return Q.dead_code(symbols, files, refs)


GATES = [(1, "granted", 2, 1, 3, 20), (2, None, 0, 0, 0, 20), (3, "granted", 1, 1, 30, 20), (4, "denied", 1, 0, 5, 4)]


@query("f7_remediation_gate", f"""WITH {B.values_sql("g", ["id", "approval", "evidence", "commands", "affected", "most"], GATES)}, r AS (SELECT id, [x FOR x IN [CASE WHEN coalesce(approval, '') <> 'granted' THEN 'Explicit approval is required.' END, CASE WHEN evidence = 0 THEN 'Runtime evidence is required.' END,
CASE WHEN commands = 0 THEN 'At least one validation command is required.' END, CASE WHEN affected = 0 THEN 'The affected file scope is empty.' END, CASE WHEN affected > most THEN 'Affected scope exceeds ' || most || ' files.' END] IF x IS NOT NULL] AS r FROM g) SELECT id, len(r) = 0 AS allowed, array_to_string(r, ' ') AS reasons FROM r""")
def f7(spark, sf):
    return Q.gate(B.literal(spark, "id int, approval string, evidence int, commands int, affected int, most int", GATES))


@query("f8_file_risk", """WITH l AS (SELECT l_partkey AS k, count(*) AS n, date_diff('day', max(l_shipdate), TIMESTAMP '2001-01-01') AS age, avg(l_discount) * 10 AS cover, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS shaky FROM lineitem GROUP BY 1),
s AS (SELECT l_partkey AS k, max(c) AS top FROM (SELECT l_partkey, l_suppkey, count(*) AS c FROM lineitem GROUP BY 1, 2) GROUP BY 1),
x AS (SELECT k, n / 60.0::DOUBLE AS churn, (n % 3) / 3.0::DOUBLE AS coupling, cover, top / n::DOUBLE AS share, shaky, age FROM l JOIN s USING (k)),
t AS (SELECT k, CASE WHEN churn = 0 THEN 0 ELSE 1 - exp(-churn / 30) END AS a, CASE WHEN coupling = 0 THEN 0 ELSE 1 / (1 + exp(-coupling * 2)) END AS b, CASE WHEN cover >= 0.5 THEN 0 ELSE 1 - cover / 0.5 END AS c, CASE WHEN cover >= 0.9 THEN 0 ELSE pow(1 - cover, 2) END AS d,
CASE WHEN share < 0.8 THEN 0 ELSE (share - 0.8) / 0.2 END AS e, CASE WHEN shaky < 0.2 THEN 0 ELSE (shaky - 0.2) / 0.8 END AS f, CASE WHEN age > 30 THEN 0 ELSE 1 - age / 30.0 END AS g FROM x),
z AS (SELECT k, round((0.35 * a + 0.25 * b + 0.15 * c + 0.1 * d + 0.1 * e + 0.05 * f + 0.05 * g)::DOUBLE, 6) AS score, array_to_string([v FOR v IN [CASE WHEN round(a::DOUBLE, 6) > 0.7 THEN 'high_churn' END, CASE WHEN round(b::DOUBLE, 6) > 0.7 THEN 'high_coupling' END, CASE WHEN round(c::DOUBLE, 6) > 0.7 THEN 'low_coverage' END, CASE WHEN round(e::DOUBLE, 6) > 0.7 THEN 'single_author' END, CASE WHEN round(f::DOUBLE, 6) > 0.7 THEN 'flaky_tests' END, CASE WHEN round(g::DOUBLE, 6) > 0.7 THEN 'new_file' END] IF v IS NOT NULL], ',') AS factors FROM t)
SELECT k AS part, score, CASE WHEN score >= 0.8 THEN 'critical' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.4 THEN 'medium' WHEN score >= 0.2 THEN 'low' ELSE 'none' END AS tier, factors FROM z""")
def f8(spark, sf):
    li = table(spark, sf, "lineitem")
    per = li.groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("n"), F.datediff(F.lit("2001-01-01").cast("date"), F.max("l_shipdate")).alias("age_days"), (F.avg("l_discount") * 10).alias("coverage"), F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("instability"))
    top = li.groupBy(F.col("l_partkey").alias("part"), "l_suppkey").agg(F.count("*").alias("c")).groupBy("part").agg(F.max("c").alias("top"))
    met = per.join(top, "part").select("part", (F.col("n") / 60.0).alias("churn"), ((F.col("n") % 3) / 3.0).alias("coupling"), "coverage", (F.col("top") / F.col("n")).alias("author_share"), "instability", "age_days")
    return Q.risk(met, "part")


FAILS = [(1, "locator not found: #x"), (2, "Expected 1 received 2"), (3, "connect ECONNREFUSED"), (4, "odd"), (5, "flaky retry worked"), (6, "element was not found"), (7, "disk full"), (8, "timeout 30s exceeded"), (9, "AssertionError: toEqual")]


def _case(column, rules, default, pick=0):
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, {_q(r[1])}) THEN {_q(r[pick]) if isinstance(r[pick], str) else r[pick]}" for r in rules) + f" ELSE {default} END"


@query("f9_failure_class", f"WITH {B.texts_sql('f', ['id', 'message'], FAILS)} SELECT id, {_case('message', Q.FLAKY_CLASSES, _q('FLAKY'))} AS class FROM f")
def f9(spark, sf):
    return B.texts(spark, sf, "id int, message string", FAILS).select("id", Q.classify_failure(F.col("message")).alias("class"))


@query("f10_remediation", f"WITH {B.texts_sql('f', ['id', 'message'], FAILS)} SELECT id, {_case('message', Q.REMEDIATION, _q('REAL_BUG'))} AS type, {_case('message', Q.REMEDIATION, '0.68', 2)}::DOUBLE AS confidence, {_case('message', Q.REMEDIATION, _q('product-defect'), 3)} AS kind FROM f")
def f10(spark, sf):
    return B.texts(spark, sf, "id int, message string", FAILS).select("id", Q.remediation(F.col("message")).alias("r")).select("id", "r.*")


@query("f11_quarantine", """SELECT user_id AS test_id, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM events GROUP BY 1 HAVING round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) >= 0.25 AND max(ts) + INTERVAL 7 DAY > TIMESTAMP '2024-01-03'""")
def f11(spark, sf):
    rates = table(spark, sf, "events").groupBy(F.col("user_id").alias("test_id")).agg(F.round(F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)), 6).alias("rate"), F.max("ts").alias("at"))
    return Q.quarantine(rates, F.lit("2024-01-03").cast("timestamp"), threshold=0.25).select("test_id", "rate")


@query("f12_gap_recommendations", f"""WITH {B.FILES_SQL}, m AS (SELECT source AS dir, count(*) FILTER (WHERE NOT is_test) AS sources, count(*) FILTER (WHERE NOT is_test AND doc_id IN (SELECT doc_id FROM labels)) AS covered, count(*) FILTER (WHERE is_test) AS tests FROM files GROUP BY 1),
r AS (SELECT dir, round(coalesce(covered::DOUBLE / nullif(sources, 0), 0), 6) AS ratio, tests FROM m) SELECT dir, ratio, tests, CASE WHEN tests = 0 THEN 'Add a first test' WHEN ratio = 0 THEN 'Cover at least one file' ELSE 'Raise coverage' END AS recommendation FROM r WHERE ratio < 0.5 OR tests = 0""")
def f12(spark, sf):
    from loomwork.plans.aggregates import a16

    return Q.gaps(a16(spark, sf))


@query("f13_test_discovery", f"WITH {B.FILES_SQL} SELECT path, CASE WHEN regexp_matches(path, '[.]test[.]') THEN 'unit' WHEN regexp_matches(path, '[.]spec[.]') THEN 'spec' ELSE 'none' END AS framework, 0.7::DOUBLE AS coverage_estimate FROM files WHERE regexp_matches(path, '[.](?:test|spec)[.][^.]+$')")
def f13(spark, sf):
    p = F.col("path")
    return B.files(spark, sf).where(p.rlike("[.](?:test|spec)[.][^.]+$")).select("path", F.when(p.rlike("[.]test[.]"), "unit").when(p.rlike("[.]spec[.]"), "spec").otherwise("none").alias("framework"), F.lit(0.7).alias("coverage_estimate"))


@query("f14_qa_confidence", "SELECT count(*) AS tests, round(CASE WHEN count(*) > 0 THEN least(0.95, 0.6 + 0.35 * avg(p_size / 50.0)) ELSE 0.35 END, 6)::DOUBLE AS confidence FROM part WHERE p_partkey % 5 = 0")
def f14(spark, sf):
    return Q.qa_impact(table(spark, sf, "part").where("p_partkey % 5 = 0").select((F.col("p_size") / 50.0).alias("confidence")))


HIGH = [("credentials", r"(?i)password|secret"), ("execution", r"(?i)\beval\b")]
MEDIUM = [("session", r"(?i)cookie|token"), ("network", r"(?i)http")]
EXCERPTS = [(1, "reset the Password"), (2, "cookie and http"), (3, "plain"), (4, "eval token")]


@query("f15_excerpt_risk", f"WITH {B.texts_sql('e', ['id', 'text'], EXCERPTS)} SELECT id, CASE WHEN " + " OR ".join(f"regexp_matches(text, {_q(p)})" for _, p in HIGH) + " THEN 'high' WHEN " + " OR ".join(f"regexp_matches(text, {_q(p)})" for _, p in MEDIUM) + " THEN 'medium' ELSE 'low' END AS level, array_to_string([x FOR x IN [" + ", ".join(f"CASE WHEN regexp_matches(text, {_q(p)}) THEN {_q(c)} END" for c, p in [*HIGH, *MEDIUM]) + "] IF x IS NOT NULL], ',') AS areas FROM e")
def f15(spark, sf):
    return B.texts(spark, sf, "id int, text string", EXCERPTS).select("id", Q.excerpt_risk(F.col("text"), HIGH, MEDIUM).alias("r")).select("id", "r.*")


@query("f16_modernization", f"""WITH {B.FILES_SQL}, g AS (SELECT source AS dir, count(*) AS files, sum(line_count)::BIGINT AS lines, count(*) FILTER (WHERE line_count > 20) AS large, count(*) FILTER (WHERE is_test) AS tests FROM files GROUP BY 1)
SELECT dir, files, lines, round(large / files::DOUBLE, 6) AS legacy_share, round((tests / files::DOUBLE + (1 - large / files::DOUBLE)) / 2 * 100)::INTEGER AS readiness, CASE WHEN large / files::DOUBLE > 0.5 THEN 'high' WHEN large / files::DOUBLE > 0.2 THEN 'medium' ELSE 'low' END AS risk, ceil(lines / 400.0)::BIGINT AS days, (ceil(lines / 400.0) * 800)::BIGINT AS cost FROM g""")
def f16(spark, sf):
    return Q.modernization(B.files(spark, sf).withColumnRenamed("source", "dir"))


METRICS_SQL = f"""{B.FILES_SQL}, m AS (SELECT source AS repository, count(*) AS files, (sum(line_count) // 7)::BIGINT AS symbols, (count(*) // 3)::BIGINT AS dependencies, count(*) FILTER (WHERE is_test AND doc_id % 3 = 0) AS tests, count(*) FILTER (WHERE doc_id % 97 = 0) AS documentation,
count(*) FILTER (WHERE doc_id % 11 = 0) AS builds, round(avg(line_count), 2) AS average_lines, max(line_count) AS max_lines, bool_or(doc_id % 50 = 0) AS database FROM files GROUP BY 1)"""


def _metrics(spark, sf):
    """A source stands for a repository, its documents for files."""
    f, i = B.files(spark, sf), F.col("doc_id")
    return f.groupBy(F.col("source").alias("repository")).agg(
        F.count("*").alias("files"), F.floor(F.sum("line_count") / 7).cast("long").alias("symbols"), F.floor(F.count("*") / 3).cast("long").alias("dependencies"), F.count_if(F.col("is_test") & (i % 3 == 0)).alias("tests"),
        F.count_if(i % 97 == 0).alias("documentation"), F.count_if(i % 11 == 0).alias("builds"), F.round(F.avg("line_count"), 2).alias("average_lines"), F.max("line_count").alias("max_lines"), F.max(i % 50 == 0).alias("database"),
    )


_RISKS = "SELECT repository, 'missing-tests' AS risk, 'critical' AS severity FROM m WHERE tests = 0 UNION ALL SELECT repository, 'missing-docs', 'medium' FROM m WHERE documentation = 0 UNION ALL SELECT repository, 'large-files', CASE WHEN max_lines > 1000 THEN 'high' ELSE 'medium' END FROM m WHERE max_lines > 500 UNION ALL SELECT repository, 'dependency-volume', 'high' FROM m WHERE dependencies > 60 UNION ALL SELECT repository, 'architecture-unknowns', 'medium' FROM m UNION ALL SELECT repository, 'database-coupling', 'medium' FROM m WHERE database"


@query("f16_risks", f"WITH {METRICS_SQL} {_RISKS}")
def f16_risks(spark, sf):
    return M.risks(_metrics(spark, sf)).select("repository", "risk", "severity")


@query("f16_assess", f"""WITH {METRICS_SQL}, r AS ({_RISKS}), w AS (SELECT repository, sum(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS w, count(*) AS risks FROM r GROUP BY 1),
s AS (SELECT repository, risks, least(100, greatest(0, w * 8 + greatest(0, average_lines - 200) / 8.0 + greatest(0, dependencies - 80) / 5.0)) AS debt, least(100, symbols::DOUBLE / files * 8 + max_lines / 20.0 + dependencies / 3.0) AS complexity, CASE WHEN tests > 0 THEN 8 ELSE 0 END + CASE WHEN documentation > 0 THEN 5 ELSE 0 END + CASE WHEN builds > 0 THEN 5 ELSE 0 END AS credit FROM m JOIN w USING (repository))
SELECT repository, round(debt::DOUBLE, 2) AS debt, round(complexity::DOUBLE, 2) AS complexity, round(least(100, greatest(0, 100 - (debt * 0.55 + complexity * 0.25) + credit))::DOUBLE, 2) AS readiness, risks::INTEGER AS risks FROM s""")
def f16_assess(spark, sf):
    return M.assess(_metrics(spark, sf))


@query("f16_gaps", f"WITH {METRICS_SQL} SELECT repository, 'testing-safety-net' AS gap, 'critical' AS priority FROM m WHERE tests = 0 UNION ALL SELECT repository, 'documentation-baseline', 'medium' FROM m WHERE documentation = 0 UNION ALL SELECT repository, 'dependency-surface', 'high' FROM m WHERE dependencies > 40 UNION ALL SELECT repository, 'architecture-target', 'high' FROM m")
def f16_gaps(spark, sf):
    return M.gaps(_metrics(spark, sf)).select("repository", "gap", "priority")


PHASES_SQL = "ph AS (SELECT 'o' || l_orderkey AS plan, 'l' || l_linenumber AS phase, l_linenumber AS position, sum(l_quantity)::BIGINT AS effort, CASE WHEN l_linenumber > 1 THEN ['l' || (l_linenumber - 1)] ELSE [] END AS needs, max(l_suppkey % 3)::BIGINT AS checks, max(l_suppkey % 2)::BIGINT AS rollbacks, bool_or(l_linestatus = 'F') AS approval, bool_and(l_discount < 0.09) AS reversible, bool_and(l_returnflag = 'R') AS done FROM lineitem GROUP BY 1, 2, 3)"


def _phases(spark, sf):
    """An order stands for a plan, its lines for phases that follow one another."""
    k = F.col("l_linenumber")
    needs = F.when(k > 1, F.array(F.concat(F.lit("l"), (k - 1).cast("string")))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("plan"), F.concat(F.lit("l"), k.cast("string")).alias("phase"), k.alias("position"))
    return rows.agg(F.sum("l_quantity").cast("long").alias("effort"), F.max(F.col("l_suppkey") % 3).cast("long").alias("checks"), F.max(F.col("l_suppkey") % 2).cast("long").alias("rollbacks"), F.max(F.col("l_linestatus") == "F").alias("approval"), F.min(F.col("l_discount") < 0.09).alias("reversible"), F.min(F.col("l_returnflag") == "R").alias("done")).withColumn("needs", F.when(F.col("position") > 1, F.array(F.concat(F.lit("l"), (F.col("position") - 1).cast("string")))).otherwise(F.array().cast("array<string>")))


@query("f16_validate", f"""WITH {PHASES_SQL}, n AS (SELECT plan, phase, unnest(needs) AS need FROM ph) SELECT n.plan, n.phase, 'blocker' AS level, 'missing prerequisite ' || need AS message FROM n WHERE NOT EXISTS (SELECT 1 FROM ph WHERE ph.plan = n.plan AND ph.phase = n.need)
UNION ALL SELECT plan, phase, 'blocker', 'no functional-equivalence validation' FROM ph WHERE checks = 0 UNION ALL SELECT plan, phase, 'warning', 'no rollback notes' FROM ph WHERE rollbacks = 0 UNION ALL SELECT plan, phase, 'warning', 'non-reversible transformation' FROM ph WHERE NOT reversible""")
def f16_validate(spark, sf):
    return M.validate(_phases(spark, sf))


@query("f16_cost", f"""WITH {PHASES_SQL}, g AS (SELECT plan, sum(effort) AS effort, count(*) AS n, sum(checks) AS checks, count(*) FILTER (WHERE approval) AS review, count(*) FILTER (WHERE effort > 30) AS high FROM ph GROUP BY 1), t AS (SELECT *, round((1 + high * 0.15 + greatest(0, n - 3) * 0.05)::DOUBLE, 2) AS multiplier FROM g)
SELECT plan, ceil(round(effort * multiplier, 6))::BIGINT AS engineering, ceil(checks * 0.5)::BIGINT AS validation, review, ceil(round(effort * multiplier, 6))::BIGINT + ceil(checks * 0.5)::BIGINT + review AS total, multiplier FROM t""")
def f16_cost(spark, sf):
    phases = _phases(spark, sf)
    return M.cost(phases, phases.groupBy("plan").agg(F.count_if(F.col("effort") > 30).alias("high")))


@query("f16_track", f"""WITH {PHASES_SQL}, d AS (SELECT plan, list(phase) FILTER (WHERE done) AS done FROM ph GROUP BY 1), f AS (SELECT ph.*, coalesce(d.done, []) AS dl, NOT ph.done AND len(list_filter(needs, lambda x: NOT list_contains(coalesce(d.done, []), x))) = 0 AS free FROM ph JOIN d USING (plan))
SELECT plan, arg_min(phase, position) FILTER (WHERE free) AS active, round(sum(CASE WHEN done THEN effort ELSE 0 END) / greatest(1, sum(effort))::DOUBLE * 100, 2) AS percent, greatest(0, greatest(1, sum(effort)) - sum(CASE WHEN done THEN effort ELSE 0 END))::BIGINT AS remaining,
bool_or(phase = 'l7') OR (count(*) FILTER (WHERE free) = 0 AND max(len(dl)) < count(*)) AS blocked FROM f GROUP BY plan""")
def f16_track(spark, sf):
    phases = _phases(spark, sf)
    return M.track(phases, phases.where("done").select("plan", "phase"), phases.where("phase = 'l7'").select("plan", F.lit("late").alias("issue")))


@query("f16_govern", f"WITH {PHASES_SQL} SELECT plan, phase FROM ph WHERE approval AND position % 2 = 0")
def f16_govern(spark, sf):
    phases = _phases(spark, sf)
    return M.govern(phases, phases.where("position % 2 = 1").select("plan", "phase"))


REDACT = [(1, "api_key=abcdefgh12345 and more"), (2, "Authorization: Bearer abc.def"), (3, "-----BEGIN RSA PRIVATE KEY-----\nxx\n-----END RSA PRIVATE KEY-----"), (4, "eyJabcdefghijk.abcdefghijkl.mnopqrstuvwx tail"), (5, "ghp_abcdefghijklmnopqrstuvwxyz0123456789"), (6, "home/.ssh/id"), (7, "nothing here")]
_val = "text"
for _n, _p in Q.REDACTIONS:
    _val = f"regexp_replace({_val}, {_q(_p)}, '[REDACTED:{_n.upper()}]', 'g')"
_steps, _cur = [], "text"
for _n, _p in Q.REDACTIONS:
    _steps.append(f"CASE WHEN regexp_matches({_cur}, {_q(_p)}) THEN '{_n}' END")
    _cur = f"regexp_replace({_cur}, {_q(_p)}, '[REDACTED:{_n.upper()}]', 'g')"


@query("f19_redaction", f"WITH {B.values_sql('r', ['id', 'text'], REDACT)}, u AS (SELECT * FROM r UNION ALL SELECT 1000 + doc_id, text FROM documents WHERE contains(text, 'token = ')) SELECT id, sha256({_val}) AS value, array_to_string([x FOR x IN [{', '.join(_steps)}] IF x IS NOT NULL], ',') AS categories, regexp_matches(text, {_q(Q.EXCLUDED_PATH)}) AS excluded_path FROM u")
def f19(spark, sf):
    docs = table(spark, sf, "documents").where(F.col("text").contains("token = ")).select((1000 + F.col("doc_id")).alias("id"), "text")
    rows = B.literal(spark, "id long, text string", REDACT).union(docs)
    return Q.redact(rows, "id", "text").withColumn("value", F.sha2("value", 256))


RESPONSES = [(1, '{"a": 1}'), (2, 'text ```json\n{"b": 2}\n``` end'), (3, 'so {"c": 3} it is'), (4, "no object"), (5, "{broken"), (6, None)]


@query("f20_response_recovery", "SELECT * FROM (VALUES (1, '{\"a\": 1}', 'complete'), (2, '{\"b\": 2}', 'partial'), (3, '{\"c\": 3}', 'partial'), (4, '-', 'absent'), (5, '-', 'absent'), (6, '-', 'absent')) t(id, json, status) UNION ALL SELECT 10 + event_id, CASE WHEN event_id % 3 = 2 THEN '-' ELSE props END, CASE event_id % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' ELSE 'absent' END FROM events")
def f20(spark, sf):
    e = F.col("event_id")
    made = table(spark, sf, "events").select(10 + e, F.when(e % 3 == 0, F.col("props")).when(e % 3 == 1, F.concat(F.lit("so "), "props", F.lit(" it is"))).otherwise("none"))
    rows = B.literal(spark, "id long, r string", RESPONSES).union(made).withColumn("json", Q.recover_json(F.col("r")))
    return rows.select("id", F.coalesce("json", F.lit("-")).alias("json"), F.when(F.col("json").isNull(), "absent").when(F.col("json") == F.col("r"), "complete").otherwise("partial").alias("status"))


@query("f21_scope_drift", "SELECT DISTINCT source || '/' || lang AS area FROM documents WHERE NOT starts_with(source || '/' || lang, 'src1/') AND source || '/' || lang <> 'src2/en' AND NOT starts_with(source || '/' || lang, 'src2/en/')")
def f21(spark, sf):
    return Q.scope_drift(table(spark, sf, "documents").select(F.concat_ws("/", "source", "lang").alias("area")), ["src1"], ["src2/en"])


ASKS = [(1, "fix the login page quickly please"), (2, "make it better"), (3, "refactor src/app.ts now and then"), (4, "update everything around here soon")]


@query("f22_ambiguity", f"WITH {B.texts_sql('a', ['id', 'text'], ASKS)}, t AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9_./-]+') AS k FROM a), f AS (SELECT id, len(k) AS n, len(list_filter(k, lambda x: regexp_matches(x, {_q(Q.ACTIONS)}))) = 0 AS missing_action, len(list_filter(k, lambda x: contains(x, '/') OR regexp_matches(x, {_q(Q.TARGETS)}))) = 0 AS missing_target FROM t) SELECT id, n < 5 OR missing_action OR missing_target AS vague, missing_action, missing_target FROM f")
def f22(spark, sf):
    return B.texts(spark, sf, "id int, text string", ASKS).select("id", Q.ambiguity(F.col("text")).alias("r")).select("id", "r.*")


@query("f23_plan_metrics", "SELECT o_custkey AS plan, round(sum(o_totalprice), 2) AS effort, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS high_risk, count(*) FILTER (WHERE o_orderstatus = 'F') AS reversible FROM orders GROUP BY 1")
def f23(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("plan")).agg(F.round(F.sum("o_totalprice"), 2).alias("effort"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("high_risk"), F.count_if(F.col("o_orderstatus") == "F").alias("reversible"))


@query("c12_story_unlock", """WITH p AS (SELECT o_custkey AS plan, o_orderkey AS phase, o_orderstatus = 'F' AS done, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS need FROM orders)
SELECT plan, phase FROM p a WHERE NOT done AND (need IS NULL OR EXISTS (SELECT 1 FROM p b WHERE b.plan = a.plan AND b.phase = a.need AND b.done))""")
def c12(spark, sf):
    from pyspark.sql import Window

    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    phases = table(spark, sf, "orders").select(F.col("o_custkey").alias("plan"), F.col("o_orderkey").alias("phase"), (F.col("o_orderstatus") == "F").alias("done"), F.array_compact(F.array(before)).alias("needs"))
    return Q.next_phases(phases)
