"""Queries of the compressors: lines of documents as lines of tool output, conversations as histories, clicks' properties as structured values."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.operators import compress as Z
from loomwork.plans.registry import query
from loomwork.session import table

#: How a document's line becomes a line of output, in SQL that both engines read: ``line``, its number ``n`` from 0 and length ``k``.
SHAPES = {
    "status": "CASE k % 4 WHEN 0 THEN 'M ' WHEN 1 THEN 'A ' WHEN 2 THEN '??' ELSE ' R' END || ' ' || line",
    "log": "CASE WHEN n % 3 = 0 THEN 'merge of a branch' ELSE line END",
    "search": "'src/f' || CAST(k % 5 AS STRING) || '.py:' || CAST(n AS STRING) || ': ' || line",
    "folder": "'d' || CAST(n % 4 AS STRING) || '/e' || CAST(k % 3 AS STRING) || '/' || replace(line, '/', '_')",
    "build": "CASE WHEN k % 7 = 0 THEN 'error TS' || CAST(k AS STRING) || ': ' WHEN k % 7 = 1 THEN 'Warning ' WHEN k % 11 = 0 THEN 'exited ' ELSE '' END || line",
    "diff": "CASE WHEN n % 20 = 0 THEN 'diff --git a/f b/f' WHEN n % 20 = 1 THEN '--- a/src/f' || CAST(k % 3 AS STRING) WHEN n % 20 = 2 THEN '+++ b/src/f' || CAST(k % 3 AS STRING) WHEN n % 20 = 3 THEN '@@ -1 +1 @@' WHEN k % 3 = 0 THEN '+' || line WHEN k % 3 = 1 THEN '-if ' || line ELSE ' ' || line END",
    "generic": "CASE WHEN n % 2 = 0 THEN CAST(n AS STRING) || ' Steps done' ELSE line END",
}


def outputs(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """(id, text): every document with its lines in the shape of a kind of output."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("ls"))
    shape = SHAPES[kind]
    return rows.selectExpr("id", f"array_join(transform(transform(ls, (line, n) -> struct(line, n, length(line) as k)), x -> {_of(shape)}), '\\n') as text")


def _of(shape: str) -> str:
    """The shape over a struct x."""
    return re.sub(r"(?<![\w'%])(line|n|k)(?![\w'])", r"x.\1", shape)


def _sql(kind: str) -> str:
    return f"""raw AS (SELECT doc_id AS id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS n FROM documents),
ln AS (SELECT id, n, {SHAPES[kind].replace("AS STRING", "AS VARCHAR")} AS code FROM (SELECT *, length(line) AS k FROM raw)), own AS (SELECT id, string_agg(code, chr(10) ORDER BY n) AS text FROM ln GROUP BY id), ne AS (SELECT * FROM ln WHERE code <> '')"""


def _fit(tokens: int) -> str:
    return f"""fit AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY id ORDER BY section, pos, text ROWS UNBOUNDED PRECEDING) - 1 AS used, row_number() OVER (PARTITION BY id ORDER BY section, pos, text) AS rn FROM parts),
red AS (SELECT id, string_agg(text, chr(10) ORDER BY section, pos, text) AS content FROM fit WHERE used <= {4 * tokens} OR rn = 1 GROUP BY id)
SELECT id, sha256(CASE WHEN coalesce(strlen(content) < strlen(text), false) THEN content ELSE text END) AS content_sha256, coalesce(strlen(content) < strlen(text), false) AS derived FROM own LEFT JOIN red USING (id)"""


def _digest(found: DataFrame) -> DataFrame:
    return found.select("id", F.sha2("content", 256).alias("content_sha256"), "derived")


def _grouped_sql(group: str, title: str, header: str, each: int, unique: str) -> str:
    return f"""gr AS (SELECT *, {group} AS g, {unique} AS u FROM ne), ct AS (SELECT id, g, count(*) AS n, min(n) AS first FROM gr GROUP BY 1, 2),
un AS (SELECT id, g, min(n) AS n, arg_min(code, n) AS code FROM gr GROUP BY id, g, u QUALIFY row_number() OVER (PARTITION BY id, g ORDER BY min(gr.n)) <= {each}),
parts AS (SELECT ct.id, 1 AS section, first AS pos, {title} || chr(10) || t AS text FROM ct JOIN (SELECT id, g, string_agg(code, chr(10) ORDER BY n) AS t FROM un GROUP BY 1, 2) x ON x.id = ct.id AND x.g = ct.g
UNION ALL SELECT id, 0, 0, {header} FROM (SELECT id, sum(n)::BIGINT AS n, count(*) AS groups FROM ct GROUP BY 1))"""


_STATUS = _grouped_sql("substr(code, 1, 2)", "ct.g || ': ' || ct.n || ' path(s)'", "'Git status: ' || n || ' changed path(s)'", 40, "n")


@query("c9_git_status", f"WITH {_sql('status')}, {_STATUS}, {_fit(1200)}")
def c9_git_status(spark, sf):
    return _digest(Z.git_status(outputs(spark, sf, "status"), "id", "text"))


_SEARCH = _grouped_sql(
    r"CASE WHEN regexp_extract(code, '(?:^|\s)([^:\s]+\.[A-Za-z0-9]+)(?::\d+)?(?::\d+)?', 1) = '' THEN 'unresolved' ELSE regexp_extract(code, '(?:^|\s)([^:\s]+\.[A-Za-z0-9]+)(?::\d+)?(?::\d+)?', 1) END",
    "ct.g || ': ' || ct.n || ' match(es)'",
    "'Search results: ' || n || ' match(es) across ' || groups || ' file group(s)'",
    12,
    r"trim(lower(regexp_replace(regexp_replace(code, ':\d+(?::\d+)?(\s|$)', ':#\1', 'g'), '\s+', ' ', 'g')))",
)


@query("c9_search", f"WITH {_sql('search')}, {_SEARCH}, {_fit(1400)}")
def c9_search(spark, sf):
    return _digest(Z.search_output(outputs(spark, sf, "search"), "id", "text"))


_FOLDER = _grouped_sql("regexp_replace(code, '/[^/]*$', '')", "ct.g || '/ (' || ct.n || ')'", "'Directory listing: ' || n || ' item(s) across ' || groups || ' director(ies)'", 20, "code")


@query("c9_directory", f"WITH {_sql('folder')}, {_FOLDER}, {_fit(1000)}")
def c9_directory(spark, sf):
    return _digest(Z.directory_output(outputs(spark, sf, "folder"), "id", "text"))


@query("c9_git_log", f"""WITH {_sql('log')}, parts AS (SELECT id, 0 AS section, 0 AS pos, 'Git log: ' || count(*) || ' raw line(s)' AS text FROM ne GROUP BY 1
UNION ALL (SELECT id, 1, min(n), code FROM ne GROUP BY id, code QUALIFY row_number() OVER (PARTITION BY id ORDER BY min(n)) <= 80)), {_fit(1200)}""")
def c9_git_log(spark, sf):
    return _digest(Z.git_log(outputs(spark, sf, "log"), "id", "text"))


_NAMED, _EXACT = r"regexp_matches(code, '^(?:diff --git|\+\+\+ b/|--- a/)')", r"regexp_matches(code, '^(?:diff --git|@@|\+[^+]|-[^-])')"


@query("c9_git_diff", f"""WITH {_sql('diff')}, parts AS (SELECT id, 0 AS section, 0 AS pos, 'Git diff: ' || count(DISTINCT CASE WHEN {_NAMED} THEN code END) || ' file(s); ' || count(*) FILTER (WHERE {_EXACT} AND code[1] = '+') || ' additions; ' || count(*) FILTER (WHERE {_EXACT} AND code[1] = '-') || ' removals' AS text FROM ne GROUP BY 1
UNION ALL SELECT id, 1, min(n), code FROM ne WHERE {_NAMED} GROUP BY id, code UNION ALL SELECT id, 2, n, code FROM ne WHERE {_EXACT}), {_fit(1200)}""")
def c9_git_diff(spark, sf):
    return _digest(Z.git_diff(outputs(spark, sf, "diff"), "id", "text"))


_KEY = r"trim(lower(regexp_replace(regexp_replace(code, '[0-9]+', '#', 'g'), '[ \t\r\n]+', ' ', 'g')))"
_BAD, _WARN, _END = (f"regexp_matches(code, '{p}')" for p in (Z.FAILURE, Z.WARNING, Z.OUTCOME))


@query("c9_build", f"""WITH {_sql('build')}, g AS (SELECT id, arg_max(code, n) FILTER (WHERE {_END}) AS last, count(*) FILTER (WHERE {_BAD}) AS bad, count(DISTINCT CASE WHEN {_BAD} THEN {_KEY} END) AS e, count(DISTINCT CASE WHEN {_WARN} THEN {_KEY} END) AS w, count(*) FILTER (WHERE {_END}) AS o, count(*) AS c FROM ne GROUP BY 1),
parts AS (SELECT id, 0 AS section, 0 AS pos, 'Build outcome: ' || coalesce(last, CASE WHEN bad > 0 THEN 'failed' ELSE 'completed' END) AS text FROM g UNION ALL SELECT id, 0, 1, 'Root errors: ' || e || '; important warnings: ' || w || '; raw lines: ' || c FROM g UNION ALL SELECT id, 0, 2, 'Errors:' FROM g
UNION ALL SELECT id, 2, -1, 'Warnings:' FROM g WHERE w > 0 UNION ALL SELECT id, 4, -1, 'Outcome signals:' FROM g WHERE o > 0
UNION ALL SELECT id, 1, min(n), arg_min(code, n) FROM ne WHERE {_BAD} GROUP BY id, {_KEY} UNION ALL SELECT id, 3, min(n), arg_min(code, n) FROM ne WHERE {_WARN} GROUP BY id, {_KEY}
UNION ALL (SELECT id, 5, min(n), code FROM ne WHERE {_END} GROUP BY id, code QUALIFY row_number() OVER (PARTITION BY id ORDER BY min(n) DESC) <= 4)), {_fit(1600)}""")
def c9_build(spark, sf):
    return _digest(Z.build_output(outputs(spark, sf, "build"), "id", "text"))


@query("c9_generic", rf"WITH {_sql('generic')}, parts AS (SELECT id, 0 AS section, min(n) AS pos, arg_min(code, n) AS text FROM ne WHERE regexp_matches(code, '\S') GROUP BY id, {_KEY}), {_fit(1200)}")
def c9_generic(spark, sf):
    return _digest(Z.generic_output(outputs(spark, sf, "generic"), "id", "text"))


@query("c8_diff", rf"""WITH {_sql('diff')}, chg AS (SELECT id, n, code, row_number() OVER (PARTITION BY id ORDER BY n) AS i FROM ln WHERE regexp_matches(code, '^[+-]') AND NOT starts_with(code, '---') AND NOT starts_with(code, '+++')),
sig AS (SELECT id, k, name, min(i) AS i FROM chg, (VALUES {", ".join(f"({k}, '{name}', '{p}')" for k, (name, p) in enumerate(Z.DIFF_SIGNALS))}) v(k, name, p) WHERE regexp_matches(code, p) GROUP BY 1, 2, 3),
fl AS (SELECT id, trim(substr(code, 7)) AS f, min(n) AS n FROM ln WHERE starts_with(code, '+++ b/') OR starts_with(code, '--- a/') GROUP BY 1, 2),
head AS (SELECT id, 'Changed files: ' || coalesce((SELECT string_agg(f, ', ' ORDER BY n) FROM fl WHERE fl.id = own.id AND f NOT IN ('', '/dev/null')), 'none recorded') || chr(10) || 'Behavioral signals: ' || coalesce((SELECT string_agg(name, ', ' ORDER BY i, k) FROM sig WHERE sig.id = own.id), 'textual change; inspect exact hunk')
 || chr(10) || 'Added lines: ' || (SELECT count(*) FROM chg WHERE chg.id = own.id AND code[1] = '+') || '; removed lines: ' || (SELECT count(*) FROM chg WHERE chg.id = own.id AND code[1] = '-') || chr(10) || 'Exact changed lines below are authoritative evidence; unchanged hunk context may be omitted.' || chr(10) AS h FROM own)
SELECT id, sha256(h || coalesce(chr(10) || (SELECT string_agg(code, chr(10) ORDER BY n) FROM ln WHERE ln.id = head.id AND regexp_matches(code, '^(?:@@|[+-])')), '')) AS content_sha256 FROM head""")
def c8_diff(spark, sf):
    return outputs(spark, sf, "diff").select("id", F.sha2(Z.diff_projection(F.col("text")), 256).alias("content_sha256"))


@query("c8_documentation")
def c8_documentation(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return Z.keep_smaller_own(docs, "id", "text", lambda text: Z.document_projection(text, 300))


_HIST = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN {Z.HISTORY_SECTIONS.index(s)}" for s, p in Z.HISTORY_TEXTS) + " END"
_KEYED = "CASE role WHEN 'system' THEN 1 WHEN 'user' THEN " + _HIST + " ELSE CASE turn % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 6 END END"
_NAMES = ", ".join(f"({k}, '{s}')" for k, s in enumerate(Z.HISTORY_SECTIONS))


@query("c8_conversation", f"""WITH e AS (SELECT conv_id AS id, turn AS seq, trim(text) AS t, {_KEYED.replace('(t,', '(trim(text),')} AS k FROM conversations), b AS (SELECT id, k, t, min(seq) AS seq FROM e WHERE k IS NOT NULL AND t <> '' GROUP BY 1, 2, 3), ids AS (SELECT DISTINCT conv_id AS id FROM conversations),
parts AS (SELECT id, 0 AS section, 0 AS pos, 'Durable task work state (derived from retrievable history):' AS text FROM ids UNION ALL SELECT id, 2 * k + 1, 0, s || ':' FROM ids, (VALUES {_NAMES}) v(k, s) UNION ALL SELECT id, 2 * k + 2, seq, '- ' || t FROM b
UNION ALL SELECT id, 2 * v.k + 2, 0, '- none recorded in the available history' FROM ids, (VALUES {_NAMES}) v(k, s) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.id = ids.id AND b.k = v.k)),
w AS (SELECT *, 2 * length(text) - length(regexp_replace(text, '[^\\x00-\\x7f]', '', 'g')) + 1 AS w FROM parts),
u AS (SELECT *, sum(w) OVER (PARTITION BY id ORDER BY section, pos, text ROWS UNBOUNDED PRECEDING) AS used, sum(w) OVER (PARTITION BY id) - 1 AS every FROM w)
SELECT id, sha256(string_agg(text, chr(10) ORDER BY section, pos, text) FILTER (WHERE every <= 1200 OR used + {len(Z.BOUNDED) + 2} <= 1200) || CASE WHEN max(every) > 1200 THEN chr(10) || '{Z.BOUNDED}' ELSE '' END) AS content_sha256 FROM u GROUP BY id""")
def c8_conversation(spark, sf):
    turn = F.col("turn")
    key = F.when(F.col("role") == "system", "constraint").when(F.col("role") == "user", "message").otherwise(F.when(turn % 3 == 0, "decision").when(turn % 3 == 1, "summary").otherwise("blocker"))
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), turn.alias("seq"), key.alias("key"), "text")
    return Z.conversation_state(rows, "id", tokens=300).select("id", F.sha2("content", 256).alias("content_sha256"))


@query("c8_diagnostics", f"""WITH e AS (SELECT user_id AS id, event_id AS seq, event_type AS severity, 'E' || (event_id % 3) AS code, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'f' || (event_id % 5) END AS path, CASE WHEN event_id % 2 = 0 THEN event_id % 7 END AS line, event_type || ' happened' AS message FROM events),
g AS (SELECT id, code, coalesce(path, '') AS path, message, count(*) AS n, min(seq) AS seq, arg_min(severity, seq) AS severity, arg_min(CASE WHEN line IS NULL THEN -1 ELSE line END, seq) AS line FROM e GROUP BY 1, 2, 3, 4),
parts AS (SELECT id, 0 AS section, 0 AS pos, 'Unique failure groups: ' || count(*) || '; raw records: ' || sum(n)::BIGINT AS text FROM g GROUP BY 1
UNION ALL SELECT id, 5 - CASE WHEN severity = 'error' THEN 4 ELSE 2 END, seq, '- root ' || upper(severity) || ' [' || code || '] ' || message || ' @ ' || CASE WHEN path = '' THEN 'location unavailable' ELSE path || CASE WHEN line < 0 THEN '' ELSE ':' || (line + 1) END END || '; occurrences=' || n FROM g),
u AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY id ORDER BY section, pos, text ROWS UNBOUNDED PRECEDING) AS used, sum(length(text) + 1) OVER (PARTITION BY id) - 1 AS every FROM parts)
SELECT id, string_agg(text, chr(10) ORDER BY section, pos, text) FILTER (WHERE every <= 2000 OR used + {len(Z.BOUNDED) + 2} <= 2000) || CASE WHEN max(every) > 2000 THEN chr(10) || '{Z.BOUNDED}' ELSE '' END AS content FROM u GROUP BY id""")
def c8_diagnostics(spark, sf):
    e = F.col("event_id")
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("id"), e.alias("seq"), F.col("event_type").alias("severity"), F.concat(F.lit("E"), (e % 3).cast("string")).alias("code"), F.when(e % 4 != 0, F.concat(F.lit("f"), (e % 5).cast("string"))).alias("path"),
        F.when(e % 2 == 0, e % 7).alias("line"), F.concat("event_type", F.lit(" happened")).alias("message"),
    )
    return Z.diagnostics(rows, "id", tokens=500)


def _props(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "clicks").groupBy(F.col("click_id").alias("id")).agg(F.min("props").alias("text"))


@query("c8_structured")
def c8_structured(spark, sf):
    return Z.compact_structures(_props(spark, sf), "id", "text")


@query("c9_structured")
def c9_structured(spark, sf):
    rows = _props(spark, sf)
    return Z.keep_smaller(rows, Z.project_shapes(rows, "id", "text"), "id", "text")
