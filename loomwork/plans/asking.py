"""Questions, paths, explanations and retrieval over the fixture tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork.functions import text as X
from loomwork.operators import asking as Q
from loomwork.plans import bindings as B
from loomwork.plans.registry import query
from loomwork.session import cut, spread, table

KINDS = ["symbol", "file", "api", "test", "service", "risk-area"]
RELATIONS = ["calls", "tests", "imports", "reads", "may-impact", "implements"]

_CASE = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS))
_RCASE = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(RELATIONS))
UNITS_SQL = f"""units AS (SELECT p_partkey AS id, CASE p_size % 6 {_CASE} END AS kind, p_name AS name, p_type AS description, 'part/' || p_partkey AS canonical_key,
CASE WHEN p_size % 6 <> 5 THEN p_brand || '/' || replace(p_name, ' ', '_') || '.ts' END AS path,
CASE WHEN p_size % 6 = 5 THEN '{{"category":"' || CASE WHEN p_partkey % 2 = 0 THEN 'security' ELSE 'performance' END || '"}}' ELSE '{{"size":"' || p_size || '"}}' END AS properties,
(p_size % 10) / 10.0::DOUBLE AS confidence FROM part WHERE p_partkey % 13 <> 0),
rels AS (SELECT * FROM (SELECT DISTINCT src * 10000000 + dst AS id, CASE (src + dst) % 6 {_RCASE} END AS kind, src AS source_id, dst AS target_id, (src % 10) / 10.0::DOUBLE AS confidence FROM (
SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)
WHERE source_id IN (SELECT id FROM units) AND target_id IN (SELECT id FROM units)),
sides AS (SELECT source_id AS seed, target_id AS next, kind, id AS rel_id, 'out' AS way FROM rels UNION ALL SELECT target_id, source_id, kind, id, 'in' FROM rels)"""


def facts(spark, sf):
    """(units, relationships): a unit a part, a relation a step from part to part; some units are deleted."""
    n = F.col("p_size") % 6
    kind, rel = F.element_at(F.array(*map(F.lit, KINDS)), n + 1), F.element_at(F.array(*map(F.lit, RELATIONS)), ((F.col("src") + F.col("dst")) % 6 + 1).cast("int"))
    props = F.when(n == 5, F.to_json(F.struct(F.when(F.col("p_partkey") % 2 == 0, "security").otherwise("performance").alias("category")))).otherwise(F.to_json(F.struct(F.col("p_size").cast("string").alias("size"))))
    path = F.when(n != 5, F.concat("p_brand", F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".ts")))
    units = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), kind.alias("kind"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.concat(F.lit("part/"), "p_partkey").alias("canonical_key"), path.alias("path"),
        props.alias("properties"), ((F.col("p_size") % 10) / 10.0).alias("confidence"), F.when(F.col("p_partkey") % 13 == 0, "deleted").otherwise("active").alias("lifecycle"),
    )
    inside = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    lines = table(spark, sf, "lineitem")
    rows = lines.count()
    by_order = spread(lines.select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", rows=rows)
    each = by_order.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(inside).alias("dst")).where("dst is not null and src <> dst")
    steps = spread(each, "src", "dst", rows=rows).distinct()
    rels = steps.select((F.col("src") * 10000000 + F.col("dst")).alias("id"), rel.alias("kind"), F.col("src").alias("source_id"), F.col("dst").alias("target_id"), ((F.col("src") % 10) / 10.0).alias("confidence"), F.lit("active").alias("lifecycle"))
    return units, rels


def score_sql(question: str, intent: str) -> str:
    """The unit score of a question, spelt out for DuckDB."""
    hay = "lower(concat_ws(' ', kind, name, coalesce(description, ''), canonical_key, coalesce(path, ''), properties))"
    q = question.lower().replace("'", "''")
    out = [f"CASE WHEN contains({hay}, '{q}') THEN 8 ELSE 0 END", f"CASE WHEN lower(name) = '{q}' OR lower(canonical_key) = '{q}' OR lower(coalesce(path, '')) = '{q}' THEN 12 ELSE 0 END"]
    for t in Q.terms(question):
        out += [f"CASE WHEN contains({x}, '{t}') THEN {w} ELSE 0 END" for x, w in (("lower(name)", 3), ("lower(coalesce(path, ''))", 2.5), ("lower(canonical_key)", 2), (hay, 0.6))]
    if intent in ("security", "performance"):
        out.append(f"CASE WHEN kind = 'risk-area' AND json_extract_string(properties, '$.category') = '{intent}' THEN 4 ELSE 0 END")
    extra = {"api": ("api", 2), "tests": ("test", 2)}
    if intent in extra:
        out.append(f"CASE WHEN kind = '{extra[intent][0]}' THEN {extra[intent][1]} ELSE 0 END")
    return "round((" + " + ".join(out) + ")::DOUBLE, 6)"


QUESTIONS = [(1, "what calls the small ring"), (2, "which tests cover billing"), (3, "security impact of auth"), (4, "where is parsing defined"), (5, "slow query in the database schema"), (6, "hello there"), (7, "what does main call and its configuration"), (8, "écall flow path through module")]


@query("q1_classify", f"WITH {B.texts_sql('q', ['id', 'question'], QUESTIONS)}, x AS (SELECT id, [i FOR i IN [" + ", ".join(f"CASE WHEN regexp_matches(lower(question), '{p}') THEN '{n}' END" for n, p in Q.INTENTS) + f"] IF i IS NOT NULL] AS found, question FROM q) SELECT id, array_to_string(CASE WHEN len(found) > 0 THEN found WHEN regexp_matches(lower(question), '{Q.DEFINITION}') THEN ['definition'] ELSE ['generic'] END, ',') AS intents FROM x")
def q1(spark, sf):
    return B.texts(spark, sf, "id int, question string", QUESTIONS).select("id", F.array_join(Q.classify_column(F.col("question")), ",").alias("intents"))


ASKED = "what calls small ring"


@query("q2_unit_score", f"WITH {UNITS_SQL} SELECT id, {score_sql(ASKED, 'callers')} AS score FROM units WHERE {score_sql(ASKED, 'callers')} > 0")
def q2(spark, sf):
    units, _ = Q.active(*facts(spark, sf))
    return units.select("id", Q.unit_score(ASKED, "callers").alias("score")).where("score > 0")


def _ask_sql(question: str) -> str:
    intents = Q.classify(question)
    one = "compound" if len(intents) > 1 else intents[0]
    adds = [f"SELECT id, score, '{Q.DIRECT}' AS reason FROM seeds"]
    for i in intents:
        for kinds, way, bonus, reason in Q.FOLLOW.get(i, []):
            ks, ws = ", ".join(f"'{k}'" for k in kinds), "'in', 'out'" if way == "both" else f"'{way}'"
            text = f"'{reason}'" if i in ("callers", "callees") else f"'{reason} via ' || s.kind"
            adds.append(f"SELECT s.next, t.score + {bonus}, {text} FROM sides s JOIN seeds t ON s.seed = t.id AND t.rn <= 10 WHERE s.kind IN ({ks}) AND s.way IN ({ws})")
        if i in ("security", "performance"):
            area = f"(SELECT id FROM units WHERE kind = 'risk-area' AND json_extract_string(properties, '$.category') = '{i}')"
            adds += [f"SELECT id, 8, '{i} risk-area evidence' FROM {area}", f"SELECT target_id, 7, '{i} impact evidence' FROM rels WHERE kind = 'may-impact' AND source_id IN {area}"]
        if i == "api":
            adds.append(f"SELECT id, 6, 'api evidence' FROM units WHERE kind = 'api' AND ({score_sql(question, one)} > 0 OR {str(len(Q.terms(question)) <= 2).lower()})")
    allowed = ", ".join(f"'{k}'" for k in sorted({k for i in intents for k in Q.ALLOWED.get(i, [])}))
    where = [f"kind IN ({allowed})"] if all(i in Q.ALLOWED for i in intents) else []
    if set(intents) <= Q.ACTION_ONLY:
        where.append(f"reasons <> '{Q.DIRECT}'")
    return f"""WITH {UNITS_SQL}, seeds AS (SELECT id, {score_sql(question, one)} AS score, row_number() OVER (ORDER BY {score_sql(question, one)} DESC, id) AS rn FROM units WHERE {score_sql(question, one)} > 0 QUALIFY rn <= 24),
adds AS ({" UNION ALL ".join(adds)}), found AS (SELECT id, max(score) AS score, string_agg(DISTINCT reason, '; ' ORDER BY reason) AS reasons FROM adds GROUP BY id)
SELECT row_number() OVER (ORDER BY score DESC, confidence DESC, canonical_key)::INTEGER AS rank, id, kind, name, round(score, 6)::DOUBLE AS score, reasons FROM found JOIN units USING (id){" WHERE " + " AND ".join(where) if where else ""} QUALIFY rank <= 50"""


for _name, _question in (("callers", ASKED), ("tests", "which tests and callers of big gear"), ("generic", "steel ring"), ("security", "security risk of small parts api")):

    @query(f"q3_ask_{_name}", _ask_sql(_question))
    def q3(spark, sf, question=_question):
        return Q.ask(*facts(spark, sf), question)


IMPACT_Q = "impact of red bolt"


@query("q4_ask_impact", None)
def q4(spark, sf):
    return Q.ask(*facts(spark, sf), IMPACT_Q)


RESOLVED = f"SELECT id, row_number() OVER (ORDER BY {score_sql('small ring', 'generic')} DESC, canonical_key) AS rn FROM units WHERE {score_sql('small ring', 'generic')} > 0"


@query("t3_resolve", f"WITH {UNITS_SQL} SELECT id, {score_sql('small ring', 'generic')} AS score FROM units WHERE {score_sql('small ring', 'generic')} > 0 ORDER BY score DESC, canonical_key LIMIT 8")
def t3(spark, sf):
    return Q.resolve(Q.active(*facts(spark, sf))[0], "small ring").select("id", "score")


_roles = " UNION ALL ".join(f"SELECT '{role}' AS role, next AS id, kind FROM (SELECT * FROM sides WHERE seed = (SELECT id FROM res WHERE rn = 1) AND kind IN ({', '.join(repr(k) for k in kinds)}) AND way IN ({chr(39)}in{chr(39)}, {chr(39)}out{chr(39)}) ORDER BY rel_id, next LIMIT 8)" if way == "both" else f"SELECT '{role}' AS role, next AS id, kind FROM (SELECT * FROM sides WHERE seed = (SELECT id FROM res WHERE rn = 1) AND kind IN ({', '.join(repr(k) for k in kinds)}) AND way = '{way}' ORDER BY rel_id, next LIMIT 8)" for role, (kinds, way) in Q.EXPLAIN.items())


@query("q7_explain", f"WITH {UNITS_SQL}, res AS ({RESOLVED}) {_roles}")
def q7(spark, sf):
    return Q.execute("explain", *facts(spark, sf), "small ring")


@query("q8_flow", f"WITH {UNITS_SQL}, res AS ({RESOLVED} QUALIFY rn <= 3) SELECT source_id, target_id, kind FROM rels WHERE kind IN ({', '.join(repr(k) for k in Q.FLOW_KINDS)}) AND (source_id IN (SELECT id FROM res) OR target_id IN (SELECT id FROM res)) ORDER BY id LIMIT 48")
def q8(spark, sf):
    return Q.execute("flow", *facts(spark, sf), "small ring")


@query("q9_impact", f"""WITH {UNITS_SQL}, res AS ({RESOLVED} QUALIFY rn <= 6), f AS (SELECT * FROM rels WHERE target_id IN (SELECT id FROM res) AND kind IN ({', '.join(repr(k) for k in Q.IMPACT_KINDS)}) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY id) = 1)
SELECT CASE WHEN kind IN ('calls', 'imports') THEN 'direct' WHEN kind IN ('tests', 'covers') THEN 'probable' ELSE 'possible' END AS impact, source_id AS id, kind FROM f QUALIFY row_number() OVER (PARTITION BY impact ORDER BY id) <= 24""".replace("ORDER BY id) <= 24", "ORDER BY f.id) <= 24"))
def q9(spark, sf):
    return Q.execute("impact", *facts(spark, sf), "small ring")


@query("q11_path", None)
def q11(spark, sf):
    return Q.execute("path", *facts(spark, sf), "small ring", to="red bolt")


REUSE_Q = "outbound request client ring"
_near = "(SELECT string_agg(lower(concat_ws(' ', n.name, n.kind, n.properties)), ' ') FROM sides s JOIN units n ON n.id = s.next WHERE s.seed = u.id)"
_terms = Q.terms(REUSE_Q)


@query("q10_reuse", f"""WITH {UNITS_SQL}, n AS (SELECT seed AS id, {", ".join(f"bool_or(contains(lower(concat_ws(' ', u.name, u.kind, u.properties)), '{t}')) AS n{k}" for k, t in enumerate(_terms))} FROM sides JOIN units u ON u.id = next GROUP BY seed),
x AS (SELECT u.id, u.name, u.confidence, {" + ".join(f"CASE WHEN coalesce(n{k}, false) THEN 2.5 WHEN contains(lower(concat_ws(' ', name, coalesce(description, ''), canonical_key, properties)), '{t}') THEN 3 ELSE 0 END" for k, t in enumerate(_terms))} AS s,
regexp_matches(name, '(?i)request|fetch|client|transport|http') AND regexp_matches(coalesce(path, ''), '(?i)integration|client|http|transport|network') AS signal
FROM units u LEFT JOIN n ON n.id = u.id WHERE kind IN ({", ".join(repr(k) for k in Q.REUSE_KINDS)}))
SELECT id, round(s + CASE WHEN signal THEN 5 ELSE 0 END + confidence * 0.5, 6)::DOUBLE AS score FROM x WHERE s > 0 OR signal ORDER BY score DESC, name, id LIMIT 8""")
def q10(spark, sf):
    return Q.execute("reuse", *facts(spark, sf), REUSE_Q)


@query("q12_item_confidence", "SELECT p_partkey AS id, round(least(1, greatest(0, 0.8 * (p_size / 50.0) + 0.2 * coalesce(f, 0.7)))::DOUBLE, 6) AS confidence FROM part LEFT JOIN (SELECT l_partkey, avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END) AS f FROM lineitem WHERE l_discount > 0.08 GROUP BY 1) ON l_partkey = p_partkey")
def q12(spark, sf):
    fresh = table(spark, sf, "lineitem").where("l_discount > 0.08").groupBy("l_partkey").agg(F.avg(F.when(F.col("l_linestatus") == "F", 1.0).otherwise(0.0)).alias("f"))
    met = table(spark, sf, "part").join(fresh, F.col("p_partkey") == F.col("l_partkey"), "left")
    return met.select(F.col("p_partkey").alias("id"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.8 * (F.col("p_size") / 50.0) + 0.2 * F.coalesce("f", F.lit(0.7)))), 6).alias("confidence"))


@query("p8_allowed_kinds", f"WITH {UNITS_SQL}, {B.values_sql('a', ['intent', 'kind'], [(i, k) for i, ks in Q.ALLOWED.items() for k in ks])} SELECT DISTINCT u.id, a.intent FROM units u JOIN a ON u.kind = a.kind WHERE a.intent IN ('api', 'tests', 'security')")
def p8(spark, sf):
    allow = B.literal(spark, "intent string, kind string", [(i, k) for i, ks in Q.ALLOWED.items() for k in ks]).where("intent in ('api', 'tests', 'security')")
    return Q.active(*facts(spark, sf))[0].select("id", "kind").join(F.broadcast(allow), "kind").select("id", "intent").distinct()


@query("p9_action_only", f"WITH {B.values_sql('v', ['id', 'intents'], [(1, 'callers'), (2, 'callers,tests'), (3, 'api,tests'), (4, 'generic')])}, q AS (SELECT * FROM v UNION ALL SELECT 10 + event_id, CASE event_id % 3 WHEN 0 THEN 'callers' WHEN 1 THEN 'tests,' || event_type ELSE event_type END FROM events) SELECT id, len([i FOR i IN string_split(intents, ',') IF i NOT IN ('callers', 'callees', 'tests', 'dependencies', 'dependents')]) = 0 AS suppress FROM q")
def p9(spark, sf):
    e = F.col("event_id")
    made = table(spark, sf, "events").select(10 + e, F.when(e % 3 == 0, "callers").when(e % 3 == 1, F.concat(F.lit("tests,"), "event_type")).otherwise(F.col("event_type")))
    rows = B.literal(spark, "id long, intents string", [(1, "callers"), (2, "callers,tests"), (3, "api,tests"), (4, "generic")]).union(made)
    return rows.select("id", F.forall(F.split("intents", ","), lambda i: i.isin(sorted(Q.ACTION_ONLY))).alias("suppress"))


LEX_Q = "the and of the token"
_words = LEX_Q.split()
LEX_SQL = f"""tok AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM documents), lex AS (SELECT id, round(({" + ".join(f"ln(1 + len(list_filter(t, lambda x: x = '{w}'))::DOUBLE)" for w in _words)}) / sqrt(len(t)), 6) AS score FROM tok WHERE len(t) > 0)"""


@query("r1_lexical_score", f"WITH {LEX_SQL} SELECT id AS doc_id, score FROM lex WHERE score > 0 ORDER BY score DESC, id LIMIT 20")
def r1(spark, sf):
    found = Q.lexical(table(spark, sf, "documents").select("doc_id", "text"), LEX_Q, "doc_id", "text")
    return found.orderBy(F.desc("score"), "id").limit(20).select(F.col("id").alias("doc_id"), "score")


@query("r2_document_assembly", "SELECT p_partkey AS id, concat_ws(' ', p_name, p_type, s.names, f.flags) AS document FROM part LEFT JOIN (SELECT l_partkey, string_agg(DISTINCT l_suppkey::VARCHAR, ' ' ORDER BY l_suppkey::VARCHAR) AS names FROM lineitem WHERE l_quantity > 45 GROUP BY 1) s ON s.l_partkey = p_partkey LEFT JOIN (SELECT l_partkey, string_agg(DISTINCT l_returnflag, ' ' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1) f ON f.l_partkey = p_partkey")
def r2(spark, sf):
    joined = lambda c: F.nullif(F.array_join(F.array_sort(F.collect_set(c)), " "), F.lit(""))
    sides = table(spark, sf, "lineitem").groupBy("l_partkey").agg(joined(F.when(F.col("l_quantity") > 45, F.col("l_suppkey").cast("string"))).alias("names"), joined("l_returnflag").alias("flags"))
    return table(spark, sf, "part").join(sides, F.col("p_partkey") == F.col("l_partkey"), "left").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "names", "flags").alias("document"))


@query("r3_expand", f"WITH RECURSIVE {B.EDGES_SQL}, ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), r(id, depth) AS (SELECT DISTINCT src, 0 FROM edges WHERE src % 9 = 0 UNION SELECT dst, depth + 1 FROM r JOIN ways ON id = src WHERE depth < 2) SELECT id, round(1.0 / (min(depth) + 1), 6)::DOUBLE AS score FROM r GROUP BY id")
def r3(spark, sf):
    edges = cut(B.edges(spark, sf))
    return Q.expand(edges, edges.where("src % 9 = 0").selectExpr("src as id").distinct(), 2).select("id", F.round("score", 6).alias("score"))


VEC_SQL = """tgt AS (SELECT CAST(embedding AS DOUBLE[]) AS t FROM embeddings WHERE vec_id = 7), sem AS (SELECT vec_id AS id, round(list_inner_product(CAST(embedding AS DOUBLE[]), t) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_inner_product(t, t)), 6) AS score FROM embeddings, tgt)"""


@query("r4_rank_fusion", f"""WITH {LEX_SQL}, {VEC_SQL}, a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rn FROM lex WHERE score > 0), b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rn FROM sem WHERE score > 0)
SELECT id, round(sum(1.0 / (60 + rn)::DOUBLE), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY id ORDER BY score DESC, id LIMIT 20""")
def r4(spark, sf):
    lex = Q.lexical(table(spark, sf, "documents").select("doc_id", "text"), LEX_Q, "doc_id", "text")
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    target = vectors.where("vec_id = 7").select(F.transform("embedding", lambda x: x.cast("double")).alias("t")).limit(1)
    sem = Q.cosine(vectors.join(F.broadcast(target), how="cross"), "vec_id", "embedding", F.col("t"))  # one target row
    return Q.fuse([lex, sem])


@query("r5_evidence_dedupe", "SELECT source, path, line, count(*) AS n FROM (SELECT 'a' AS source, l_orderkey AS path, l_linenumber AS line FROM lineitem UNION ALL SELECT CASE WHEN l_tax > 0.04 THEN 'b' ELSE 'a' END, l_orderkey, l_linenumber FROM lineitem) GROUP BY ALL")
def r5(spark, sf):
    li = table(spark, sf, "lineitem")
    u = li.selectExpr("'a' as source", "l_orderkey as path", "l_linenumber as line").union(li.selectExpr("case when l_tax > 0.04 then 'b' else 'a' end", "l_orderkey", "l_linenumber"))
    return u.groupBy("source", "path", "line").agg(F.count("*").alias("n"))


@query("r6_canonical_selection", f"WITH {UNITS_SQL}, res AS ({RESOLVED} QUALIFY rn <= 5), pick AS (SELECT id, rn AS pos FROM res UNION ALL SELECT next, 100 + row_number() OVER (ORDER BY next) FROM (SELECT DISTINCT next FROM sides WHERE seed IN (SELECT id FROM res)) x) SELECT id, min(pos) AS pos FROM pick GROUP BY id")
def r6(spark, sf):
    units, rels = Q.active(*facts(spark, sf))
    found = cut(Q.resolve(units, "small ring", 5))
    first = found.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "canonical_key")).cast("long").alias("pos"))
    near = Q._sides(rels, "both").join(F.broadcast(found.select(F.col("id").alias("seed"))), "seed").select(F.col("next").alias("id")).distinct()
    return first.union(near.select("id", 100 + F.row_number().over(Window.orderBy("id")))).groupBy("id").agg(F.min("pos").alias("pos"))


@query("tokenizers", f"WITH {B.texts_sql('q', ['id', 'q'], QUESTIONS)} SELECT id, array_to_string(regexp_extract_all(lower(q), '[a-z0-9_]+'), ' ') AS bag, len(list_distinct(list_filter(regexp_extract_all(lower(q), '[a-z0-9_./:-]+'), lambda t: length(t) > 1)))::INTEGER AS explorer FROM q")
def tokenizers(spark, sf):
    rows = B.texts(spark, sf, "id int, q string", QUESTIONS)
    return rows.select("id", F.array_join(X.lexical_tokens(F.col("q")), " ").alias("bag"), F.size(X.explorer_terms(F.col("q"))).alias("explorer"))
