"""Extraction over a small literal repository (its rules' words don't occur in the fixture tables) and the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import extract as E
from loomwork.plans import bindings as B
from loomwork.plans.registry import query
from loomwork.session import table

#: A repository in miniature: path, language, text.
SOURCES = [
    ("src/api/userController.ts", "typescript", "import { Router } from 'express'\nimport x from './db/../util'\nexport class UserController extends Base {\n  getUser(id) {\n    const row = db.query(\"select * from users\")\n    return render(row)\n  }\n}\nrouter.get('/users/:id', getUser)\n// TODO legacy token check"),
    ("src/service/payment_service.py", "python", "from app.core import db\nimport os\n\ndef charge(amount):\n    for item in items:\n        total = compute(item)\n    return total\n\nclass PaymentEvent:\n    pass\n@app.post('/pay')\ndef pay(req):\n    emit('payment.done')\n    return charge(req.amount)"),
    ("tests/pay.test.ts", "typescript", "import { charge } from '../src/service/pay'\ndescribe('pay', () => {\n  it('charges once', () => { expect(charge(1)).toBe(1) })\n})"),
    ("db/migrations/001_users.sql", "sql", "CREATE TABLE IF NOT EXISTS users (id int);\ninsert into users values (1);\nselect id from users limit 1;"),
    ("src/orders/OrderService.java", "java", "import org.springframework.stereotype.Service;\n@Service\npublic class OrderService extends Base implements Api, Audit {\n  public void place(Order o) {\n    kafka.send(\"orders\")\n  }\n}\n@PostMapping(\"/orders\")"),
    ("pkg/main.go", "go", "package main\nimport (\n  \"fmt\"\n)\nfunc main() {\n  http.HandleFunc(\"/health\", ok)\n}\nfunc TestMain(t) {}"),
    ("web/components/Card.tsx", "typescript", "import React from 'react'\nexport const Card = (p) => {\n  useState(1)\n  FEATURE_NEW_CARD && track()\n}"),
    ("package.json", "json", '{"name": "demo", "dependencies": {"express": "^4.0.0", "react": "18"}, "devDependencies": {"vitest": "1.0"}}'),
    ("lib/broken/package.json", "json", '{"name": '),
    ("k8s/deploy.yaml", "yaml", "kind: Deployment\nname: web\npassword: 'hunter22x'"),
    (".github/workflows/ci.yml", "yaml", "name: ci\non: push"),
    ("src/models/user.ts", "typescript", "@Entity('users')\nexport class User extends Base {\n}"),
    ("docs/README.md", "markdown", "# Title\n## Auth and cookie policy\ntext"),
]
SRC_SQL = B.values_sql("src", ["path", "lang", "text"], SOURCES)
LINES_SQL = SRC_SQL + ", ln AS (SELECT path, lang, unnest(string_split(text, chr(10))) AS code, unnest(range(1, len(string_split(text, chr(10))) + 1))::INTEGER AS line FROM src)"


#: The same with the documents as further files.
ALL_SQL = B.values_sql("lit", ["path", "lang", "text"], SOURCES) + ", src AS (SELECT * FROM lit UNION ALL SELECT 'doc/' || doc_id, lang, coalesce(text, '') FROM documents)"
ALL_LINES_SQL = ALL_SQL + r", cut AS (SELECT path, lang, regexp_split_to_array(text, '\r?\n') AS parts FROM src), ln AS (SELECT path, lang, unnest(parts) AS code, unnest(range(1, len(parts) + 1))::INTEGER AS line FROM cut)"


def sources(spark):
    return B.literal(spark, "path string, lang string, text string", SOURCES)


def everything(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "lang", F.coalesce("text", F.lit("")).alias("text"))
    return sources(spark).union(docs)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_KW = ", ".join(_q(k) for k in E.KEYWORDS)
_known = ", ".join(_q(k) for k in sorted({a for a, _, _ in E.SYMBOL_RULES if a not in ("*", "")}))
_read = ", ".join(_q(k) for k in sorted({*E.LANGUAGE_EXTENSIONS.values(), *E.LANGUAGE_NAMES.values(), "kubernetes", "scala"}))


def _scope(scope: str) -> str:
    return "true" if scope == "*" else f"lang NOT IN ({_known})" if scope == "" else f"lang = {_q(scope)}"


def _name(pattern: str) -> str:
    """The name that a symbol rule finds; RE2 has no look-ahead, so the one of make is said otherwise."""
    if pattern.endswith(":(?!=)"):
        bare = pattern.removesuffix("(?!=)")
        return f"CASE WHEN regexp_matches(code, {_q(bare + '([^=]|$)')}) THEN regexp_extract(code, {_q(bare)}, 1) ELSE '' END"
    return f"regexp_extract(code, {_q(pattern)}, 1)"


_SYM = " UNION ALL ".join(f"SELECT path, lang, code, line, {i} AS rule, {_q(kind)} AS kind, {_name(p)} AS name FROM ln WHERE {_scope(scope)}" for i, (scope, kind, p) in enumerate(E.SYMBOL_RULES))
_SYMBOLS = f"SELECT * FROM ({_SYM}) WHERE name <> '' AND lower(name) NOT IN ({_KW})"
X2_SQL = f"SELECT DISTINCT path, line, kind, name, CASE WHEN regexp_matches(code, {_q(E.EXPORTED)}) THEN 'exported' WHEN lang = 'python' AND NOT regexp_matches(code, '^\\s*_') THEN 'unknown' ELSE 'local' END AS status FROM ({_SYMBOLS})"


@query("x2_symbols", f"WITH {ALL_LINES_SQL} {X2_SQL}")
def x2(spark, sf):
    return E.symbols(everything(spark, sf))


@query("x1_lines", f"WITH {ALL_LINES_SQL} SELECT path, line, code FROM ln")
def x1(spark, sf):
    return E.lines(everything(spark, sf)).select("path", "line", "code")


_TYPES = " UNION ALL ".join(f"SELECT path, line, {_q(kind)} AS kind, regexp_extract(code, {_q(p)}, {a}) AS source, unnest(string_split(regexp_extract(code, {_q(p)}, {b}), ',')) AS raw FROM ln WHERE {'true' if lang == '*' else f'lang = {_q(lang)}'}" for lang, kind, p, a, b in E.TYPE_RULES)
X3_SQL = f"""SELECT path, line, kind, source, regexp_extract(regexp_extract(regexp_replace(trim(raw), '^(?:public|private|protected|virtual)\\s+', ''), '[A-Za-z_$][\\w$.:]*', 0), '[^:.]*$', 0) AS target FROM (
{_TYPES} UNION ALL SELECT path, line, 'implements', regexp_extract(code, {_q(E.SCALA_WITH)}, 1), unnest(regexp_extract_all(regexp_extract(code, {_q(E.SCALA_WITH)}, 2), '\\bwith\\s+([A-Za-z_]\\w*)', 1)) FROM ln WHERE lang = 'scala')"""


@query("x3_type_relations", f"WITH {ALL_LINES_SQL}, u AS ({X3_SQL}) SELECT * FROM u WHERE source <> '' AND target <> ''")
def x3(spark, sf):
    return E.type_relations(everything(spark, sf))


_IMP = " UNION ALL ".join([*(f"SELECT path, line, unnest(regexp_extract_all(code, {_q(p)}, 1)) AS raw FROM ln" for p in E.IMPORT_RULES), f"SELECT path, line, regexp_extract(code, {_q(E.GO_IMPORT)}, 1) FROM ln WHERE lang = 'go'"])
#: Steps "a/../" and "./" are taken out one after another, an independent way to normalise.
_JOINED = "regexp_replace(path, '[^/]*$', '') || raw"
X4_SQL = rf"""WITH RECURSIVE i AS (SELECT DISTINCT * FROM ({_IMP}) WHERE raw <> '' AND raw NOT IN ('if', 'for', 'type')),
n(path, line, raw, t) AS (SELECT path, line, raw, regexp_replace(regexp_replace({_JOINED}, '(^|/)(\./)+', '\1', 'g'), '//+', '/', 'g') FROM i WHERE starts_with(raw, '.')
  UNION ALL SELECT path, line, raw, regexp_replace(t, '(^|/)([^/.][^/]*|\.[^/.][^/]*|\.\.[^/]+)/\.\.(/|$)', '\1') FROM n WHERE regexp_matches(t, '(^|/)([^/.][^/]*|\.[^/.][^/]*|\.\.[^/]+)/\.\.(/|$)')),
d AS (SELECT path, line, raw, regexp_replace(t, '/$', '') AS t FROM n WHERE NOT regexp_matches(t, '(^|/)([^/.][^/]*|\.[^/.][^/]*|\.\.[^/]+)/\.\.(/|$)'))
SELECT i.path, i.line, coalesce(d.t, i.raw) AS target, CASE WHEN starts_with(i.raw, '.') OR starts_with(i.raw, '/') OR contains(i.raw, '::') THEN 'local' ELSE 'package' END AS kind FROM i LEFT JOIN d ON d.path = i.path AND d.line = i.line AND d.raw = i.raw"""


@query("x4_imports", f"WITH {ALL_LINES_SQL} SELECT * FROM ({X4_SQL})")
def x4(spark, sf):
    return E.imports(everything(spark, sf))


X9_PATHS = [("a/b/../c",), ("./x/./y",), ("../up/one",), ("a/../../b",), ("plain",), ("a//b/",)]


@query("x9_normal_path", "SELECT * FROM (VALUES ('a/b/../c', 'a/c'), ('./x/./y', 'x/y'), ('../up/one', '../up/one'), ('a/../../b', '../b'), ('plain', 'plain'), ('a//b/', 'a/b')) t(path, normal) UNION ALL SELECT 'x/' || source || '/../' || lang || '/./' || doc_id, 'x/' || lang || '/' || doc_id FROM documents")
def x9(spark, sf):
    made = table(spark, sf, "documents").select(F.concat(F.lit("x/"), "source", F.lit("/../"), "lang", F.lit("/./"), F.col("doc_id").cast("string")))
    return B.literal(spark, "path string", X9_PATHS).union(made).select("path", E.normal_path(F.col("path")).alias("normal"))


X5_SQL = f"""WITH d AS (SELECT path, line, arg_max(name, rule) FILTER (kind IN ('function', 'method')) AS own, list(DISTINCT name) AS names FROM ({_SYMBOLS}) GROUP BY 1, 2),
m AS (SELECT ln.path, ln.line, regexp_replace(code, {_q(E.STRINGS.replace(chr(92) + '"', '"'))}, '', 'g') AS bare, names, last_value(own IGNORE NULLS) OVER (PARTITION BY ln.path ORDER BY ln.line ROWS UNBOUNDED PRECEDING) AS caller FROM ln LEFT JOIN d ON d.path = ln.path AND d.line = ln.line WHERE lang IN ({_read})),
c AS (SELECT path, line, coalesce(caller, '<module>') AS caller, names, unnest(regexp_extract_all(bare, {_q(E.CALL)}, 1)) AS callee FROM m)
SELECT path, line, callee, caller FROM c WHERE NOT coalesce(list_contains(names, string_split(callee, '.')[-1]), false) AND lower(callee) NOT IN ({_KW})"""


@query("x5_calls", f"WITH {ALL_LINES_SQL} SELECT * FROM ({X5_SQL})")
def x5(spark, sf):
    return E.calls(everything(spark, sf))


_BARE = f"regexp_replace(code, {_q(E.STRINGS.replace(chr(92) + '"', '"'))}, '', 'g')"
_FOLLOW = ", ".join(map(_q, E.FLOW_LANGUAGES))
X6_SQL = f"""SELECT path, line, coalesce(nullif(regexp_extract({_BARE}, {_q(E.CONTROL)}, 1), ''), '-') AS control, CASE WHEN lang IN ({_FOLLOW}) THEN coalesce(nullif(regexp_extract({_BARE}, {_q(E.ASSIGN)}, 1), ''), '-') ELSE '-' END AS target,
CASE WHEN lang IN ({_FOLLOW}) THEN coalesce(nullif(regexp_extract({_BARE}, {_q(E.ASSIGN)}, 2), ''), '-') ELSE '-' END AS source FROM ln WHERE lang IN ({_read})"""


@query("x6_flow_facts", f"WITH {ALL_LINES_SQL}, f AS ({X6_SQL}) SELECT * FROM f WHERE control <> '-' OR target <> '-'")
def x6(spark, sf):
    return E.flow_facts(everything(spark, sf))


_ROUTE = "CASE " + " ".join(f"WHEN regexp_matches(code, {_q(p)}) THEN [" + (f"CASE upper(regexp_extract(code, {_q(p)}, {m})) WHEN 'REQUESTMAPPING' THEN 'ANY' ELSE upper(regexp_extract(code, {_q(p)}, {m})) END" if m else "'ANY'") + f", regexp_extract(code, {_q(p)}, {r})]" for p, m, r in E.ROUTE_RULES) + f" WHEN lang = 'rust' AND regexp_matches(code, {_q(E.RUST_ROUTE)}) THEN ['ANY', regexp_extract(code, {_q(E.RUST_ROUTE)}, 1)] END"
X7_SQL = f"SELECT path, line, r[1] AS method, r[2] AS route FROM (SELECT path, line, {_ROUTE} AS r FROM ln) WHERE r IS NOT NULL"


@query("x7_routes", f"WITH {ALL_LINES_SQL} {X7_SQL}")
def x7(spark, sf):
    return E.routes(everything(spark, sf))


X8_SQL = f"SELECT path, line, coalesce(nullif(trim(regexp_extract(code, {_q(E.TEST_NAME)}, 1)), ''), 'test@' || line) AS name FROM ln WHERE regexp_matches(code, {_q(E.TEST_LINE)}) OR (lang = 'go' AND regexp_matches(code, {_q(E.GO_TEST)}))"


@query("x8_test_lines", f"WITH {ALL_LINES_SQL} {X8_SQL}")
def x8(spark, sf):
    return E.test_lines(everything(spark, sf))


@query("x1_facts", f"""WITH {ALL_LINES_SQL}, f AS ({X6_SQL}) SELECT path, line, 'symbol' AS fact, name, kind || ' ' || status AS detail FROM ({X2_SQL})
UNION ALL SELECT path, min(line), 'dependency', target, kind FROM ({X4_SQL}) GROUP BY path, target, kind UNION ALL SELECT path, line, 'call', callee, caller FROM ({X5_SQL})
UNION ALL SELECT path, line, 'control', control, '' FROM f WHERE control <> '-' UNION ALL SELECT path, line, 'data', target, source FROM f WHERE target <> '-'
UNION ALL SELECT path, line, 'type', source, kind || ' ' || target FROM ({X3_SQL}) WHERE source <> '' AND target <> '' UNION ALL SELECT path, line, 'test', name, '' FROM ({X8_SQL}) UNION ALL SELECT path, line, 'api', route, method FROM ({X7_SQL})""")
def x1_facts(spark, sf):
    return E.facts(everything(spark, sf))


@query("x10_syntax_tree")
def x10(spark, sf):
    return E.syntax_tree(everything(spark, sf))


@query("x21_property_graph")
def x21(spark, sf):
    return E.property_graph(everything(spark, sf))


_BASE = "split_part(path, '/', -1)"
_OWN = f"regexp_replace({_BASE}, '\\.[^.]+$', '')"
_DB = f"(regexp_matches(lower(path), {_q(E.DATABASE_PATH)}) OR regexp_matches(text, {_q(E.DATABASE_WORDS)}))"
_DBNAME = f"'database:' || CASE WHEN regexp_extract(path, '(?i)(?:^|/)(?:migrations?|schemas?)[/]([^/]+)', 1) <> '' THEN regexp_extract(path, '(?i)(?:^|/)(?:migrations?|schemas?)[/]([^/]+)', 1) WHEN regexp_replace({_BASE}, '(?i)\\.(?:sql|prisma)$', '') <> '' THEN regexp_replace({_BASE}, '(?i)\\.(?:sql|prisma)$', '') ELSE 'workspace' END"


def _case(rules, text: str, other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {_q(p)}) THEN {_q(n)}" for p, n in rules) + f" ELSE {other} END"


def _path_rows(kind: str, pattern: str, name: str, detail: str = "''", where: str = "true") -> str:
    return f"SELECT path, {_q(kind)} AS kind, {name} AS name, 1 AS line, {detail} AS detail FROM src WHERE regexp_matches(lower(path), {_q(pattern)}) AND {where}"


def _line_rows(kind: str, pattern: str, name: str = "g1", detail: str = "''", where: str = "true") -> str:
    """Matches lie within lines here; those of models that span lines don't occur in these files."""
    return f"SELECT path, {_q(kind)}, {name}, line, {detail} FROM (SELECT path, line, unnest(regexp_extract_all(code, {_q(pattern)}, 0)) AS g0, unnest(regexp_extract_all(code, {_q(pattern)}, 1)) AS g1 FROM ln JOIN src USING (path) WHERE {where})"


_STATEMENT = r"substr(regexp_replace(trim(g0), '\s+', ' ', 'g'), 1, 180)"
_AT = "g1 || ' @ ' || path || ':' || line"
_COMPONENT = f"regexp_matches(lower(path), {_q(E.SOURCE_PATH)})"
_ENT = [
    *[f"SELECT path, 'package-manager' AS kind, {_q(n)} AS name, 1 AS line, '' AS detail FROM src WHERE regexp_matches(lower({_BASE}), {_q(p)})" for n, p in E.PACKAGE_MANAGERS],
    f"SELECT path, 'build-system', 'npm scripts', 1, 'npm' FROM src WHERE {_BASE} = 'package.json'",
    _path_rows("build-system", E.BUILD_PATH, _case(E.BUILD_SYSTEMS, f"lower({_BASE})", _BASE)),
    _path_rows("ci-cd", E.CI_PATH, _BASE, _case(E.CI_PROVIDERS, "lower(path)", "'CI/CD'")),
    _path_rows("infrastructure", E.INFRA_PATH, _OWN, _case(E.INFRA_PROVIDERS, "lower(path)", "'Infrastructure as code'")),
    f"SELECT path, 'database', {_DBNAME}, 1, lang FROM src WHERE {_DB}",
    _path_rows("migration", E.MIGRATION_PATH, _OWN, _DBNAME),
    _line_rows("table", E.TABLE), _line_rows("orm-entity", E.MODEL, detail="'prisma ' || g1"), _line_rows("table", E.MODEL), _line_rows("orm-entity", E.DECORATED, detail="'decorator ' || g1"), _line_rows("table", E.DECORATED),
    _line_rows("orm-entity", E.CLASS_MODEL, detail="'class-model ' || g1", where=f"{_DB} AND NOT regexp_matches(text, {_q(E.ALCHEMY)}) AND NOT regexp_matches(text, {_q(E.DJANGO)}) AND regexp_matches(lower(path), {_q(E.CLASS_MODEL_PATH)})"),
    _line_rows("query", E.STATEMENT, "upper(g1) || ' @ ' || path || ':' || line", f"concat_ws('|', lower(g1), regexp_extract({_STATEMENT}, {_q(E.STATEMENT_TABLE)}, 1), {_STATEMENT})"),
    _line_rows("query", E.ORM_CALL, _AT, "g1 || '|orm'"), _line_rows("feature-flag", E.FLAG_WORD), _line_rows("feature-flag", E.FLAG_CALL), _line_rows("event", E.EVENT_CALL, detail="'emit'"), _line_rows("event", E.EVENT_CLASS, detail="'class'"),
    _path_rows("fixture", E.FIXTURE_PATH, _OWN), _path_rows("component", E.COMPONENT_PATH, _OWN, where=_COMPONENT), _path_rows("component", E.VIEW_PATH, _OWN, where=f"{_COMPONENT} AND regexp_matches(text, {_q(E.VIEW_TEXT)})"),
]
X11_SQL = "SELECT path, kind, arg_min(name, turn) AS name, line, arg_min(detail, turn) AS detail FROM (" + " UNION ALL ".join(f"SELECT path, kind, trim(name) AS name, line, detail, {k} AS turn FROM ({q}) t(path, kind, name, line, detail)" for k, q in enumerate(_ENT)) + ") WHERE name <> '' GROUP BY path, kind, lower(name), line"


@query("x11_entities", f"WITH {ALL_LINES_SQL} {X11_SQL}")
def x11(spark, sf):
    return E.entities(everything(spark, sf))


@query("x15_mapped_tables", f"""WITH {ALL_LINES_SQL}, e AS ({X11_SQL}), k AS (SELECT *, lower(regexp_replace(regexp_replace(name, '(?i)(?:entity|model|table)$', ''), '[_\\-\\s]', '', 'g')) AS k FROM e)
SELECT DISTINCT a.name AS entity, a.path AS entity_path, b.name AS "table", b.path AS table_path FROM k a JOIN k b ON a.k = b.k AND a.path <> b.path WHERE a.kind = 'orm-entity' AND b.kind = 'table'""")
def x15_mapped(spark, sf):
    return E.mapped_tables(E.entities(everything(spark, sf)))


MANIFESTS = [
    ("package.json", "json", '{"name": "demo", "dependencies": {"express": "^4.0.0", "react": "18"}, "devDependencies": {"vitest": "1.0", "react": "19"}}'),
    ("lib/broken/package.json", "json", '{"name": '), ("svc/go.mod", "go", "module example.com/svc\nrequire github.com/x/y v1.2.3\nrequire z v2\n"),
    ("a/Cargo.toml", "toml", '[package]\nname = "crate-a"\n[dependencies]\nserde = "1.0"\ntokio = "1"\n[dev-dependencies]\nx = "1"\n'), ("p/pyproject.toml", "toml", 'name = "py"\n[dependencies]\nnumpy = "2"\n'),
    ("m/pom.xml", "xml", "<project><artifactId>core</artifactId></project>"), ("n/App.csproj", "xml", '<PackageReference Include="Newtonsoft" Version="13.0" />'), ("x/readme.md", "markdown", "name = \"no\""),
]
#: What each manifest says, read off by hand.
PACKAGES = [
    ("package.json", "npm", "project", "demo", ""), ("package.json", "npm", "external-package", "express", "^4.0.0"), ("package.json", "npm", "external-package", "react", "19"), ("package.json", "npm", "external-package", "vitest", "1.0"),
    ("svc/go.mod", "go-modules", "project", "example.com/svc", ""), ("svc/go.mod", "go-modules", "external-package", "github.com/x/y", "v1.2.3"), ("svc/go.mod", "go-modules", "external-package", "z", "v2"),
    ("a/Cargo.toml", "cargo", "project", "crate-a", ""), ("a/Cargo.toml", "cargo", "external-package", "serde", "1.0"), ("a/Cargo.toml", "cargo", "external-package", "tokio", "1"),
    ("p/pyproject.toml", "python", "project", "py", ""), ("p/pyproject.toml", "python", "external-package", "numpy", "2"), ("m/pom.xml", "maven", "external-package", "core", ""), ("n/App.csproj", "nuget", "external-package", "Newtonsoft", "13.0"),
]


@query("x12_packages", f"WITH {B.values_sql('p', ['path', 'ecosystem', 'kind', 'name', 'version'], PACKAGES)} SELECT * FROM p")
def x12(spark, sf):
    return E.packages(B.literal(spark, "path string, lang string, text string", MANIFESTS))


def _detected(name, langs, category, signals) -> str:
    seen = ", ".join(f"CASE WHEN regexp_matches(text, {_q(s)}) OR regexp_matches(path, {_q(s)}) THEN {_q(s)} END" for s in signals)
    where = "true" if langs == "*" else f"(lang IN ({', '.join(_q(x) for x in langs.split(','))}) OR regexp_matches(path, {_q(E.MANIFEST)}))"
    return f"SELECT path, {_q(name)} AS detector, {_q(category)} AS category, [x FOR x IN [{seen}] IF x IS NOT NULL] AS seen FROM src WHERE {where}"


@query("x13_detectors", f"WITH {ALL_SQL}, d AS ({' UNION ALL '.join(_detected(*d) for d in E.DETECTORS)}) SELECT path, detector, category, len(seen)::INTEGER AS signals, array_to_string(seen, ' ') AS evidence, round(least(0.97, 0.58 + len(seen) * 0.14)::DOUBLE, 6) AS confidence FROM d WHERE len(seen) > 0")
def x13(spark, sf):
    return E.detect(everything(spark, sf))


@query("x15_cross_language", """WITH f AS (SELECT doc_id AS path, lang, n_chars AS topic, CASE WHEN doc_id % 2 = 0 THEN 'producer' ELSE 'consumer' END AS role FROM documents)
SELECT p.topic, p.path AS producer, c.path AS consumer FROM f p JOIN f c ON p.topic = c.topic AND p.lang <> c.lang WHERE p.role = 'producer' AND c.role = 'consumer'""")
def x15(spark, sf):
    docs = table(spark, sf, "documents")
    return E.cross_language(docs.select(F.col("doc_id").alias("path"), "lang", F.col("n_chars").alias("topic"), F.when(F.col("doc_id") % 2 == 0, "producer").otherwise("consumer").alias("role")))


ROOTS = [("src",), ("src/service",), ("web",)]


@query("x16_fingerprints", f"WITH {ALL_SQL}, {B.values_sql('roots', ['root'], ROOTS)}, n AS (SELECT path, lang, coalesce(arg_max(root, length(root)), '.') AS root FROM src LEFT JOIN roots ON starts_with(path, root || '/') GROUP BY path, lang) SELECT root, count(*) AS files, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages FROM n GROUP BY root")
def x16(spark, sf):
    src = everything(spark, sf)
    met = E.nearest_root(src, B.literal(spark, "root string", ROOTS)).join(src.select("path", "lang"), "path")
    return met.groupBy("root").agg(F.count("*").alias("files"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"))


def _words(words: list[str], extra: str) -> str:
    text = "replace(regexp_replace(path || chr(10) || text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_', ' ')"
    each = [f"CASE WHEN regexp_matches({text}, {_q('(?i)(^|[^A-Za-z0-9_])' + w.replace('+', chr(92) + '+') + '([^A-Za-z0-9_]|$)')}) THEN {_q(w)} END" for w in words]
    return f"array_to_string([x FOR x IN [{', '.join([*each, extra])}] IF x IS NOT NULL], ',')"


@query("x17_sensitive_files", f"""WITH {ALL_SQL}, s AS (SELECT path, {_words(E.SECURITY_WORDS, f"CASE WHEN regexp_matches(text, {_q(E.AUTHORIZATION)}) THEN 'explicit authorization boundary' END")} AS security,
{_words(E.PERFORMANCE_WORDS, f"CASE WHEN regexp_matches(text, {_q(E.QUERY_IN_LOOP)}) THEN 'database operation inside loop' END")} AS performance,
array_to_string([x FOR x IN [CASE WHEN len(string_split(text, chr(10))) > 500 THEN 'very large file' END, {", ".join(f"CASE WHEN contains(lower(path || chr(10) || text), '{w}') THEN '{w}' END" for w in E.MODERNIZATION_WORDS)},
CASE WHEN contains(lower(path), 'controller') AND regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(db|database|query|repository)([^A-Za-z0-9_]|$)') THEN 'direct db call' END] IF x IS NOT NULL], ',') AS modernization FROM src)
SELECT * FROM s WHERE security <> '' OR performance <> '' OR modernization <> ''""".replace("(?is)\\b(?:for|while)\\s*\\([^)]*\\)\\s*\\{.{0,800}?", "(?is)\\b(?:for|while)\\s*\\([^)]*\\)\\s*\\{.{0,800}?"))
def x17(spark, sf):
    return E.sensitive(everything(spark, sf))


@query("x20_services", f"""WITH {ALL_SQL} SELECT path, regexp_replace(split_part(path, '/', -1), '\\.[^.]+$', '') AS name, array_to_string([p FOR p IN regexp_split_to_array(lower(path), '[/._-]') IF p IN ({", ".join(_q(w) for w in E.SERVICE_WORDS)})], ',') AS hints
FROM src WHERE regexp_matches(lower(path), 'service|controller|handler|repository|client|adapter') AND NOT regexp_matches(lower(path), '(?:^|/)(?:__tests__|tests?|spec)(?:/|$)|\\.(?:test|spec)\\.[^.]+$')""")
def x20(spark, sf):
    return E.services(everything(spark, sf))


_DIR = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') END"


@query("x24_model_summary", f"""WITH {ALL_SQL}, r AS (SELECT DISTINCT coalesce({_DIR}, '.') AS root FROM src WHERE regexp_matches(path, {_q(E.MANIFEST)})),
o AS (SELECT path, text, coalesce((SELECT arg_max(root, length(root)) FROM r WHERE starts_with(src.path, root || '/')), '.') AS root FROM src),
n AS (SELECT 'language' AS level, lang AS name, text FROM src UNION ALL SELECT 'module', split_part(path, '/', 1), text FROM src UNION ALL SELECT 'directory', {_DIR}, text FROM src WHERE contains(path, '/') UNION ALL SELECT 'package', root, text FROM o)
SELECT level, name, count(*) AS files, sum(len(string_split(text, chr(10))))::BIGINT AS lines, sum(length(text))::BIGINT AS chars FROM n GROUP BY level, name""")
def x24(spark, sf):
    return E.model_summary(everything(spark, sf))


_ranked = sorted(E.LANGUAGE_EXTENSIONS.items(), key=lambda kv: (-len(kv[0]), kv[0]))


@query("s5_languages", f"WITH {SRC_SQL}, p AS (SELECT path FROM src UNION ALL SELECT 'gen/f' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.d.ts' WHEN 1 THEN '.gradle.kts' WHEN 2 THEN '.unknown' ELSE '.RS' END FROM documents) SELECT path, CASE lower(split_part(path, '/', -1)) {' '.join(f'WHEN {_q(k)} THEN {_q(v)}' for k, v in E.LANGUAGE_NAMES.items())} ELSE CASE {' '.join(f'WHEN ends_with(lower(path), {_q(k)}) THEN {_q(v)}' for k, v in _ranked)} ELSE 'text' END END AS language FROM p")
def s5(spark, sf):
    d = F.col("doc_id")
    gen = table(spark, sf, "documents").select(F.concat(F.lit("gen/f"), d, F.when(d % 4 == 0, ".d.ts").when(d % 4 == 1, ".gradle.kts").when(d % 4 == 2, ".unknown").otherwise(".RS")).alias("path"))
    paths = sources(spark).select("path").union(gen)
    return paths.select("path", E.identify_language(F.col("path")).alias("language"))
