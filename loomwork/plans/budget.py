"""Budgets and compression over conversations, documents and literal outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.functions import text as X
from loomwork.operators import budget as C
from loomwork.operators import extract as E
from loomwork.plans import bindings as B
from loomwork.plans.extraction import ALL_LINES_SQL, _q, everything
from loomwork.plans.registry import query
from loomwork.session import table


def _candidates(spark, sf):
    d = table(spark, sf, "documents")
    cat = F.element_at(F.array(*map(F.lit, ["source", "intent", "decisions", "changes", "history", "documentation"])), (F.col("doc_id") % 6 + 1).cast("int"))
    src = F.when(F.col("doc_id") % 4 == 0, "repository-file").when(F.col("doc_id") % 4 == 1, "intelligence-flow").otherwise("note")
    label = F.when(F.col("doc_id") % 9 == 0, "Open question").when(F.col("doc_id") % 9 == 1, "Blocker").when(F.col("doc_id") % 9 == 2, "risk").otherwise("fact")
    return d.select((F.col("doc_id") % 20).alias("request"), F.col("doc_id").alias("id"), cat.alias("category"), src.alias("source_type"), label.alias("label"), ((F.col("n_chars") % 100) / 100.0).alias("relevance"), (F.col("doc_id") % 10).alias("priority"), (F.col("n_chars") % 300 + 5).alias("cost"), cat.alias("family"))


CAND_SQL = """cand AS (SELECT doc_id % 20 AS request, doc_id AS id, ['source', 'intent', 'decisions', 'changes', 'history', 'documentation'][doc_id % 6 + 1] AS category, CASE doc_id % 4 WHEN 0 THEN 'repository-file' WHEN 1 THEN 'intelligence-flow' ELSE 'note' END AS source_type,
CASE doc_id % 9 WHEN 0 THEN 'Open question' WHEN 1 THEN 'Blocker' WHEN 2 THEN 'risk' ELSE 'fact' END AS label, (n_chars % 100) / 100.0 AS relevance, doc_id % 10 AS priority, n_chars % 300 + 5 AS cost FROM documents)"""
BAND_SQL = """CASE WHEN category = 'history' THEN 'P4' WHEN category = 'intent' THEN CASE WHEN contains(lower(label), 'open question') THEN 'P2' WHEN contains(lower(label), 'blocker') THEN 'P1' ELSE 'P0' END WHEN category = 'decisions' THEN CASE WHEN contains(lower(label), 'risk') THEN 'P1' ELSE 'P0' END
WHEN category IN ('changes', 'diagnostics') THEN 'P1' WHEN source_type IN ('bounded-intelligence', 'repository-file') THEN CASE WHEN relevance >= 0.45 THEN 'P1' ELSE 'P2' END WHEN source_type IN ('intelligence-relationship', 'intelligence-flow') THEN CASE WHEN relevance >= 0.55 THEN 'P1' ELSE 'P2' END WHEN relevance < 0.3 THEN 'P3' ELSE 'P2' END"""


@query("c1_collect", "WITH u AS (SELECT doc_id AS id, n_chars / 1000.0 AS relevance, text AS content, 'a' AS source_type FROM documents UNION ALL SELECT doc_id, 5.0, NULL, 'b' FROM labels UNION ALL SELECT doc_id, quality::DOUBLE, 'label', 'c' FROM labels) SELECT id, source_type, coalesce(length(content), 0) AS chars FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY content IS NOT NULL DESC, relevance DESC, source_type) = 1")
def c1(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    a = d.select(F.col("doc_id").alias("id"), (F.col("n_chars") / 1000.0).alias("relevance"), F.col("text").alias("content"), F.lit("a").alias("source_type"))
    b = lab.select(F.col("doc_id").alias("id"), F.lit(5.0).alias("relevance"), F.lit(None).cast("string").alias("content"), F.lit("b").alias("source_type"))
    c = lab.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("relevance"), F.lit("label").alias("content"), F.lit("c").alias("source_type"))
    return C.collect([a, b, c]).select("id", "source_type", F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("chars"))


@query("c2_dedupe", """WITH c AS (SELECT doc_id AS id, text AS content, CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END AS evidence, source AS source_type, doc_id % 10 AS priority, n_chars / 10.0 AS relevance, n_chars AS cost, doc_id % 2 = 0 AS expandable FROM documents),
k AS (SELECT *, coalesce(nullif(evidence, ''), CASE WHEN length(trim(regexp_replace(lower(content), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) >= 12 THEN 'semantic|' || trim(regexp_replace(lower(content), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) END, source_type || '|' || id) AS key FROM c)
SELECT min(id) AS id, max(priority) AS priority, max(relevance)::DOUBLE AS relevance, min(cost) AS cost, bool_or(expandable) AS expandable, count(DISTINCT source_type) AS n_sources FROM k GROUP BY key""")
def c2(spark, sf):
    d = table(spark, sf, "documents")
    rows = d.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise("").alias("evidence"), F.col("source").alias("source_type"), (F.col("doc_id") % 10).alias("priority"), (F.col("n_chars") / 10.0).alias("relevance"), F.col("n_chars").alias("cost"), (F.col("doc_id") % 2 == 0).alias("expandable"))
    return C.dedupe(rows).select("id", "priority", "relevance", "cost", "expandable", F.size(F.split("sources", ",")).cast("long").alias("n_sources"))


@query("c3_priority_band", f"WITH {CAND_SQL} SELECT id, {BAND_SQL} AS band FROM cand")
def c3(spark, sf):
    return _candidates(spark, sf).select("id", C.band().alias("band"))


@query("c4_greedy_selection")
def c4(spark, sf):
    return C.select_greedy(_candidates(spark, sf).withColumn("band", C.band()), 2000)


@query("c5_expand", "SELECT doc_id AS id, focus FROM (SELECT doc_id, n_chars, CASE WHEN contains(lower(text), 'token') THEN 10 ELSE 0 END + CASE WHEN contains(lower(text), 'example') THEN 10 ELSE 0 END AS focus FROM documents) WHERE focus > 0 ORDER BY focus DESC, n_chars DESC, doc_id LIMIT 6")
def c5(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("n_chars").alias("relevance"))
    return C.expand(rows, ["token", "example"], 3).select("id", "focus")


_SCORE = " + ".join([f"CASE WHEN regexp_matches(code, {_q(p)}) THEN {w} ELSE 0 END" for p, _, w in C.SIGNALS] + [f"CASE WHEN contains(lower(code), 'user') THEN {C.TERM_WEIGHT} ELSE 0 END"])
_MUST = " OR ".join(f"regexp_matches(code, {_q(p)})" for p, label, _ in C.SIGNALS if label not in ("call", "literal"))


@query("c7_line_scores", f"WITH {ALL_LINES_SQL} SELECT path, line, {_SCORE} + CASE WHEN line BETWEEN 3 AND 4 THEN {C.RANGE_WEIGHT} ELSE 0 END AS score, {_MUST} AS mandatory FROM ln")
def c7(spark, sf):
    return C.line_scores(E.lines(everything(spark, sf)), ["user", "ok"], [(3, 4)]).select("path", "line", "score", "mandatory")


@query("c7_compress_source")
def c7b(spark, sf):
    return C.compress_source(E.lines(everything(spark, sf)), ["user"], 40)


OUTPUTS = [("o1", "x", "compiling 12 files\nerror TS1: bad at 5\nerror TS1: bad at 9\nwarning: old\nexited 1"), ("o2", "x", "all passed\n\nfine"), ("o3", "x", "diff --git a b\n@@ 1\n+new\n-old\n--- a\n+++ b\n+more")]
OUT_SQL = B.values_sql("src", ["path", "lang", "text"], OUTPUTS) + ", ln AS (SELECT path, unnest(string_split(text, chr(10))) AS code, unnest(range(1, len(string_split(text, chr(10))) + 1))::INTEGER AS line FROM src)"
KEY_SQL = "trim(lower(regexp_replace(regexp_replace(code, '[0-9]+', '#', 'g'), '[ \\t\\r\\n]+', ' ', 'g')))"


def _outputs(spark):
    return E.lines(B.literal(spark, "path string, lang string, text string", OUTPUTS))


@query("c8_diff_summary", f"WITH {OUT_SQL} SELECT path, count(DISTINCT CASE WHEN starts_with(code, 'diff --git') THEN code END) AS files, count(*) FILTER (WHERE starts_with(code, '@@')) AS hunks, count(*) FILTER (WHERE regexp_matches(code, '^\\+[^+]')) AS additions, count(*) FILTER (WHERE regexp_matches(code, '^-[^-]')) AS removals FROM ln GROUP BY path")
def c8(spark, sf):
    return C.diff_summary(_outputs(spark), "path")


@query("c9_build_summary", f"WITH {OUT_SQL} SELECT path, count(DISTINCT CASE WHEN regexp_matches(code, '(?i)(?:error|fatal|failed|failure|exception)\\b') THEN {KEY_SQL} END) AS errors, count(DISTINCT CASE WHEN regexp_matches(code, '(?i)warning\\b') THEN {KEY_SQL} END) AS warnings, count(*) AS raw_lines, coalesce(arg_max(code, CASE WHEN regexp_matches(code, '(?i)(?:exit(?:ed)?|success|passed|completed|failed)\\b') THEN line END), 'completed') AS outcome FROM ln WHERE length(code) > 0 GROUP BY path")
def c9(spark, sf):
    return C.build_summary(_outputs(spark), "path")


@query("c9_unique_lines", "WITH ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS code, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents), k AS (SELECT *, " + KEY_SQL + " AS key FROM ln WHERE trim(code) <> '') SELECT doc_id, min(n)::INTEGER AS n, count(*) AS occurrences FROM k GROUP BY doc_id, key")
def c9b(spark, sf):
    from loomwork.plans.relational import doc_lines

    return C.unique_lines(doc_lines(spark, sf), "doc_id", "n", "line").select("doc_id", "n", "occurrences")


SHAPES = [(1, '{"a": 1, "b": [2]}'), (2, "[1, 2, 3]"), (3, "plain"), (4, "12")]


@query("p15_data_shape", "SELECT * FROM (VALUES (1, 'object:a,b'), (2, 'array:3'), (3, 'text'), (4, 'scalar')) t(id, shape) UNION ALL SELECT 10 + event_id, 'object:k' FROM events")
def p15(spark, sf):
    rows = B.literal(spark, "id long, j string", SHAPES).union(table(spark, sf, "events").select(10 + F.col("event_id"), "props"))
    return rows.select("id", C.shape(F.col("j")).alias("shape"))


@query("c9_keep_smaller", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents), f AS (SELECT doc_id, x, min(n) AS n FROM l GROUP BY 1, 2),
r AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY n) AS r FROM f GROUP BY 1) SELECT doc_id, length(CASE WHEN strlen(r) < strlen(text) THEN r ELSE text END) AS kept FROM documents JOIN r USING (doc_id)""")
def c9c(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.length(C.smaller(F.col("text"), F.array_join(F.array_distinct(F.split("text", "\n", -1)), "\n"))).cast("long").alias("kept"))


@query("c10_context_pack", f"WITH {CAND_SQL}, t AS (SELECT request, id, relevance, cost, sum(cost) OVER (PARTITION BY request ORDER BY relevance DESC, id ROWS UNBOUNDED PRECEDING)::BIGINT AS used, row_number() OVER (PARTITION BY request ORDER BY relevance DESC, id) AS rn FROM cand) SELECT request, id FROM t WHERE used <= 900 OR rn = 1")
def c10(spark, sf):
    rows = _candidates(spark, sf).withColumn("neg", -F.col("relevance"))
    return C.prefix_fit(rows, ["request"], ["neg", "id"], F.col("cost"), 900).select("request", "id")


@query("w5_skip_fit")
def w5(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("cost"))
    return C.skip_fit(rows, "conv_id", ["turn"], "cost", 800)


@query("w7_packets", """WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
p(conv_id, n, used, packet) AS (SELECT conv_id, 1::BIGINT, c::BIGINT, 0 FROM t WHERE n = 1 UNION ALL SELECT t.conv_id, t.n, CASE WHEN p.used > 0 AND p.used + t.c > 700 THEN t.c ELSE p.used + t.c END, p.packet + CASE WHEN p.used > 0 AND p.used + t.c > 700 THEN 1 ELSE 0 END FROM p JOIN t ON t.conv_id = p.conv_id AND t.n = p.n + 1)
SELECT t.conv_id, t.turn, packet FROM p JOIN t ON t.conv_id = p.conv_id AND t.n = p.n""")
def w7(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("cost"))
    return C.packets(rows, "conv_id", "turn", "cost", 700)


@query("c11_ledger", "WITH n AS (SELECT user_id AS intent_id, event_id % 50 AS package_id, max(event_id) AS seq FROM events GROUP BY 1, 2) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY intent_id ORDER BY seq DESC, package_id) <= 10")
def c11(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("intent_id"), (F.col("event_id") % 50).alias("package_id"), F.col("event_id").alias("seq"))
    return C.ledger(rows, keep=10)


#: Routes by kind of intent.
ROUTES = [("explain", "graph-only"), ("change", "hybrid"), ("generate", "delegate"), ("modernize", "human-review")]
INTENT_WORDS = [("explain", "explain,what,how"), ("change", "fix,update,change"), ("generate", "create,generate,build"), ("modernize", "migrate,modernize,upgrade")]
PROMPTS = [(1, "explain how it works"), (2, "please fix and update it"), (3, "generate a build"), (4, "migrate it now"), (5, "nothing matches")]


@query("f17_routing", f"WITH {B.texts_sql('p', ['id', 'text'], PROMPTS)}, {B.values_sql('w', ['intent', 'words'], INTENT_WORDS)}, {B.values_sql('r', ['intent', 'route'], ROUTES)}, s AS (SELECT id, intent, len(list_filter(string_split(words, ','), lambda x: regexp_matches(text, '(^|[^a-z])' || x || '([^a-z]|$)'))) AS score FROM p CROSS JOIN w), b AS (SELECT id, arg_max(intent, score * 100 - length(intent)) AS intent, max(score) AS score FROM s GROUP BY id) SELECT id, CASE WHEN score > 0 THEN b.intent ELSE 'unknown' END AS intent, CASE WHEN score > 0 THEN route ELSE 'human-review' END AS route FROM b JOIN r ON r.intent = b.intent")
def f17(spark, sf):
    p = B.texts(spark, sf, "id int, text string", PROMPTS)
    made = [F.struct((sum((F.when(F.col("text").rlike(f"(^|[^a-z]){w}([^a-z]|$)"), 1).otherwise(0) for w in words.split(",")), F.lit(0)) * 100 - len(intent)).alias("s"), F.lit(intent).alias("intent"), F.lit(dict(ROUTES)[intent]).alias("route")) for intent, words in INTENT_WORDS]
    best = p.select("id", F.greatest(*made).alias("b"))
    hit = F.col("b.s") > 0
    return best.select("id", F.when(hit, F.col("b.intent")).otherwise("unknown").alias("intent"), F.when(hit, F.col("b.route")).otherwise("human-review").alias("route"))


@query("token_estimates", "SELECT conv_id, turn, greatest(1, ceil((length(text) - length(regexp_replace(text, '[\\x00-\\x7f]', '', 'g'))) * 0.25 + length(regexp_replace(text, '[\\x00-\\x7f]', '', 'g')) * 0.5))::BIGINT AS tokens FROM conversations")
def token_estimates(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.token_estimate(F.col("text")).alias("tokens"))


@query("fnv1a_hashes")
def fnv(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.fnv1a(F.col("p_name")).alias("hash"))


TASKS = [(1, "where is the parser"), (2, "analyze it and understand"), (3, "lookup things"), (4, "hello"), (5, "  "), (6, "rename class Foo and class Bar and class Baz and function Qux"), (7, "please review the docs"), (8, "x" * 250)]
_PHR = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(low, {_q(p)})' for p in ps)} THEN {_q(n)}" for n, ps in C.INTENT_PHRASES.items()) + " END"
_CNT = {n: "(" + " + ".join(f"CASE WHEN contains(low, {_q(w)}) THEN 1 ELSE 0 END" for w in ws) + ")" for n, ws in C.INTENT_WORDS.items()}


@query("f18_layered_intent", f"""WITH {B.texts_sql("t", ["id", "text"], TASKS)}, l AS (SELECT *, lower(text) AS low FROM t), c AS (SELECT *, {_PHR} AS phrase, greatest({", ".join(_CNT.values())}) AS most, len(regexp_extract_all(text, {_q(C.ENTITY)})) AS found FROM l)
SELECT id, CASE WHEN trim(text) = '' THEN 'unknown' ELSE coalesce(phrase, CASE WHEN most > 0 THEN CASE {" ".join(f"WHEN {c} = most THEN {_q(n)}" for n, c in _CNT.items())} END END, 'unknown') END AS intent,
CASE WHEN trim(text) = '' THEN 0 WHEN phrase IS NOT NULL THEN 1 WHEN most > 0 THEN least(most / greatest(most, 2), 1) ELSE 0 END::DOUBLE AS confidence,
CASE WHEN trim(text) = '' THEN 'low' WHEN length(text) > 1000 THEN 'high' WHEN length(text) > 200 THEN 'medium' WHEN found > 3 THEN 'high' WHEN found > 0 THEN 'medium' ELSE 'low' END AS complexity FROM c""")
def f18(spark, sf):
    return B.texts(spark, sf, "id int, text string", TASKS).select("id", C.task_intent(F.col("text")).alias("r")).select("id", "r.*")
