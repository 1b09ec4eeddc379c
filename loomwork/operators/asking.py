"""Questions over units and relationships, and retrieval over documents.

Units have (id, kind, name, description, canonical_key, path, properties,
confidence, lifecycle), relationships (id, kind, source_id, target_id,
confidence, lifecycle). A question is a string on the driver; its terms and
intents are literals, so scoring is one pass of column expressions.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.text import STOP_WORDS, ascii_edges
from loomwork.operators import graph as G
from loomwork.operators.relational import rank_all
from loomwork.session import cut

#: A question's intents by pattern, in order; the later two apply if none of them does.
INTENTS = [
    ("callers", r"\b(who|what|which)\s+calls?\b|\bcallers?\b|\bcalled by\b"),
    ("callees", r"\b(what|which)\s+(does|do)\b.*\bcall\b|\bcallees?\b|\bcalls from\b"),
    ("tests", r"\btests?\b|\bcoverage\b|\bcovered by\b"),
    ("impact", r"\bimpact|impacted|affected|break|change.*affect|dependents?\b"),
    ("dependencies", r"\bdependencies|depends on|imports?\b"),
    ("dependents", r"\bused by|referenced by|dependent on|depend on this\b"),
    ("api", r"\bapi|endpoint|route\b"),
    ("flow", r"\bflow|data flow|call flow|path through\b"),
    ("security", r"\bsecurity|secret|auth|authorization|vulnerab|injection|xss\b"),
    ("performance", r"\bperformance|slow|latency|hot path|n\+1|blocking|benchmark\b"),
    ("data", r"\b(?:database|table|schema|orm|query|sql|persistence|data model)\b"),
    ("configuration", r"\bconfig|configuration|setting|environment\b"),
    ("documentation", r"\bdoc|documentation|readme|design\b"),
    ("technology", r"\b(?:language|framework|orm|database|messaging|contract|project|module|architecture|services?|components?|entry points?|package ecosystem|support level)\b"),
]
DEFINITION = r"\bwhere|defined|definition|implemented|implements?\b"

#: Relations that each intent follows from a seed: kinds, direction, bonus, reason.
DATA_KINDS = ["database", "table", "orm-entity", "entity", "repository", "migration", "query", "data-entity"]
_DEPEND = ["imports", "depends-on", "configured-by", "maps-to"]
_RELATED = ["defines", "contains", "imports", "depends-on", "calls", "tests", "covers", "exposes", "configured-by", "flows-to", "may-impact", "maps-to"]
FOLLOW = {
    "callers": [(["calls"], "in", 4.0, "caller via repository call relationship")],
    "callees": [(["calls"], "out", 4.0, "callee via repository call relationship")],
    "dependencies": [(_DEPEND, "out", 3.0, "dependency")],
    "dependents": [(_DEPEND, "in", 3.0, "dependent")],
    "tests": [(["tests", "covers"], "in", 5.0, "test evidence")],
    "flow": [(["flows-to", "calls", "reads", "writes"], "both", 2.5, "flow evidence")],
    "data": [(["reads", "writes", "maps-to", "flows-to", "depends-on"], "both", 3.0, "data evidence")],
    "generic": [(_RELATED, "both", 1.2, "related")],
    "definition": [(_RELATED, "both", 1.2, "related")],
}
IMPACT_IN = ["imports", "depends-on", "calls", "tests", "covers", "may-impact", "maps-to"]
IMPACT_OUT = ["defines", "exposes"]
DIRECT = "direct repository match"
ACTION_ONLY = {"callers", "callees", "tests", "dependencies", "dependents"}

#: The kinds of result that each intent allows; others allow all.
ALLOWED = {
    "tests": ["test"],
    "callers": ["symbol", "service", "api", "file", "test"],
    "callees": ["symbol", "service", "api", "file", "test"],
    "api": ["api", "route", "controller", "handler", "service", "file"],
    "flow": ["call-flow", "data-flow", "symbol", "api", "service", "file", "test"],
    "data": [*DATA_KINDS, "file", "service"],
    "security": ["risk-area", "file", "module", "symbol", "service", "api"],
    "performance": ["risk-area", "file", "module", "symbol", "service", "api"],
    "configuration": ["configuration", "feature-flag", "ci-cd", "infrastructure", "build-system", "package-manager", "file", "symbol", "service"],
    "documentation": ["documentation", "file", "module", "service"],
    "technology": ["module", "package", "package-manager", "build-system", "architecture-boundary", "database", "contract", "repository", "file", "service", "api", "route", "component", "configuration", "event"],
}
#: Relations a path may take, and those of the other operations.
MEANINGFUL = ["calls", "imports", "depends-on", "reads", "writes", "flows-to", "implements", "extends", "exposes", "maps-to", "publishes", "subscribes", "handles", "uses", "provides", "persists"]
FLOW_KINDS = ["flows-to", "calls", "reads", "writes", "publishes", "subscribes", "returns", "uses", "persists"]
IMPACT_KINDS = ["calls", "imports", "depends-on", "tests", "covers", "may-impact", "exposes", "implements"]
REUSE_KINDS = ["symbol", "service", "component", "repository", "module", "handler", "middleware", "api"]
EXPLAIN = {
    "callers": (["calls"], "in"),
    "callees": (["calls"], "out"),
    "dependencies": (["imports", "depends-on", "configured-by", "maps-to"], "out"),
    "contracts": (["implements", "extends", "exposes", "provides", "handles"], "both"),
    "flows": (["flows-to", "reads", "writes", "publishes", "subscribes"], "both"),
}


def classify(question: str) -> list[str]:
    """All intents of a question, in rule order."""
    q = question.lower()
    found = [name for name, pattern in INTENTS if re.search(pattern, q, re.ASCII)]
    return found or (["definition"] if re.search(DEFINITION, q, re.ASCII) else ["generic"])


def classify_column(question: Column) -> Column:
    """The same as a column of intent arrays."""
    q = F.lower(question)
    found = F.array_compact(F.array(*[F.when(q.rlike(ascii_edges(p)), F.lit(n)) for n, p in INTENTS]))
    return F.when(F.size(found) > 0, found).when(q.rlike(ascii_edges(DEFINITION)), F.array(F.lit("definition"))).otherwise(F.array(F.lit("generic")))


def terms(question: str) -> list[str]:
    raw = re.findall(r"[a-z0-9_./:-]+", question.lower())
    both = [x for t in raw for x in ([t, t[:-1]] if t.endswith("s") and len(t) > 3 else [t])]
    return [t for t in dict.fromkeys(both) if len(t) > 1 and t not in STOP_WORDS]


def active(units: DataFrame, rels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active units, and active relationships between them."""
    u = units.where("lifecycle = 'active'")
    ids = u.select("id")
    r = rels.where("lifecycle = 'active'")
    return u, r.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def unit_score(question: str, intent: str) -> Column:
    """How well a unit's own text answers the question."""
    q = question.lower()
    path = F.coalesce("path", F.lit(""))
    hay = F.lower(F.concat_ws(" ", "kind", "name", F.coalesce("description", F.lit("")), "canonical_key", path, F.coalesce("properties", F.lit("{}"))))
    name, key, low = F.lower("name"), F.lower("canonical_key"), F.lower(path)

    def worth(condition: Column, points: float) -> Column:
        return F.when(condition, F.lit(points)).otherwise(0.0)

    score = worth(hay.contains(q), 8.0) + worth((name == q) | (key == q) | (low == q), 12.0)
    for t in terms(question):
        score = score + worth(name.contains(t), 3.0) + worth(low.contains(t), 2.5) + worth(key.contains(t), 2.0) + worth(hay.contains(t), 0.6)
    bonus = {"api": (["api"], 2.0), "tests": (["test"], 2.0), "definition": (["symbol", "file", "service", "api"], 1.5), "technology": (["module", "architecture-boundary", "package"], 3.0), "data": (DATA_KINDS, 4.0)}
    if intent in bonus:
        score = score + worth(F.col("kind").isin(bonus[intent][0]), bonus[intent][1])
    if intent in ("security", "performance"):
        score = score + worth((F.col("kind") == "risk-area") & (F.get_json_object("properties", "$.category") == intent), 4.0)
    return F.round(score, 6)


def resolve(units: DataFrame, question: str, limit: int = 8) -> DataFrame:
    """The best ``limit`` units for a text."""
    return units.withColumn("score", unit_score(question, "generic")).where("score > 0").orderBy(F.desc("score"), "canonical_key").limit(limit)


def _sides(rels: DataFrame, direction: str) -> DataFrame:
    """(seed, next, kind, confidence, rel_id) of relations seen from their target, source or both."""
    one = rels.select(F.col("source_id").alias("seed"), F.col("target_id").alias("next"), "kind", "confidence", F.col("id").alias("rel_id"))
    other = rels.select(F.col("target_id").alias("seed"), F.col("source_id").alias("next"), "kind", "confidence", F.col("id").alias("rel_id"))
    return {"out": one, "in": other, "both": one.union(other)}[direction]


def ask(units: DataFrame, rels: DataFrame, question: str, *, limit: int = 50) -> DataFrame:
    """(id, kind, name, score, reasons, rank): evidence for a question, best first.

    Twenty-four seeds by their own text; ten of them, a fixed bound, are
    broadcast to the relations that the question's intents follow.
    """
    intents = classify(question)
    intent = "compound" if len(intents) > 1 else intents[0]
    units, rels = active(units, rels)
    scored = units.withColumn("score", unit_score(question, intent))
    seeds = cut(scored.where("score > 0").orderBy(F.desc("score"), "id").limit(24).select("id", "score").withColumn("seed_rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))))
    ten = F.broadcast(seeds.where("seed_rank <= 10").select(F.col("id").alias("seed"), F.col("score").alias("base")))
    adds = [seeds.select("id", "score", F.lit(DIRECT).alias("reason"))]
    for name in intents:
        for kinds, direction, bonus, reason in FOLLOW.get(name, []):
            met = _sides(rels.where(F.col("kind").isin(kinds)), direction).join(ten, "seed")
            text = F.lit(reason) if name in ("callers", "callees") else F.concat(F.lit(f"{reason} via "), "kind")
            adds.append(met.select(F.col("next").alias("id"), (F.col("base") + bonus).alias("score"), text.alias("reason")))
    if "impact" in intents:
        back = _sides(rels.where(F.col("kind").isin(IMPACT_IN)), "in").select(F.col("seed").alias("src"), F.col("next").alias("dst"))
        down = _sides(rels.where(F.col("kind").isin(IMPACT_OUT)), "out").select(F.col("seed").alias("src"), F.col("next").alias("dst"))
        found = G.reach(cut(back.union(down)), seeds.where("seed_rank <= 10").select("id"), 3).where("depth > 0")
        based = found.join(F.broadcast(seeds.select(F.col("id").alias("origin"), F.col("score").alias("base"))), "origin")
        adds.append(based.select("id", (F.col("base") + F.greatest(F.lit(0.5), 5 - F.col("depth"))).alias("score"), F.lit("reverse impact").alias("reason")))
    for name in ("security", "performance"):
        if name in intents:
            area = units.where((F.col("kind") == "risk-area") & (F.lower(F.get_json_object("properties", "$.category")) == name))
            adds.append(area.select("id", F.lit(8.0).alias("score"), F.lit(f"{name} risk-area evidence").alias("reason")))
            hit = rels.where("kind = 'may-impact'").join(area.select(F.col("id").alias("source_id")), "source_id", "left_semi")
            adds.append(hit.select(F.col("target_id").alias("id"), F.lit(7.0).alias("score"), F.lit(f"{name} impact evidence").alias("reason")))
    for name, kinds in (("api", ["api"]), ("configuration", ["configuration"]), ("documentation", ["documentation"]), ("data", ["database", "table", "orm-entity", "query", "data-entity"])):
        if name in intents:
            some = scored.where(F.col("kind").isin(kinds) & ((F.col("score") > 0) | F.lit(len(terms(question)) <= 2)))
            adds.append(some.select("id", F.lit(6.0).alias("score"), F.lit(f"{name} evidence").alias("reason")))
    found = reduce(DataFrame.unionByName, adds).groupBy("id").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    ranked = found.join(units.select("id", "kind", "name", "canonical_key", "confidence"), "id")
    if all(i in ALLOWED for i in intents):
        ranked = ranked.where(F.col("kind").isin(sorted({k for i in intents for k in ALLOWED[i]})))
    if set(intents) <= ACTION_ONLY:
        ranked = ranked.where(~((F.size("reasons") == 1) & (F.col("reasons")[0] == DIRECT)))
    order = [F.desc("score"), F.desc("confidence"), F.col("canonical_key")]
    top = ranked.orderBy(*order).limit(max(1, min(limit, 100)))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", "id", "kind", "name", F.round("score", 6).alias("score"), F.array_join("reasons", "; ").alias("reasons"))


def explain(units: DataFrame, rels: DataFrame, question: str, *, limit: int = 8) -> DataFrame:
    """(role, id, kind): what the best match is tied to, the other end of each relation.

    Relations are read once: those of the one subject are found first, then told
    apart by role, and only their other ends are looked up among active units.
    """
    live = units.where("lifecycle = 'active'")
    subject = F.broadcast(resolve(live, question, 1).select(F.col("id").alias("seed")))
    kinds = sorted({k for some, _ in EXPLAIN.values() for k in some})
    end = lambda seed, other, way: F.struct(F.col(seed).alias("seed"), F.col(other).alias("next"), F.lit(way).alias("way"))
    ends = rels.where((F.col("lifecycle") == "active") & F.col("kind").isin(kinds)).select(F.col("id").alias("rel_id"), "kind", F.inline(F.array(end("source_id", "target_id", "out"), end("target_id", "source_id", "in"))))
    roles = [F.when(F.col("kind").isin(some) & F.col("way").isin(["in", "out"] if way == "both" else [way]), F.lit(role)) for role, (some, way) in EXPLAIN.items()]
    met = ends.join(subject, "seed").join(live.select(F.col("id").alias("next")), "next", "left_semi").withColumn("role", F.explode(F.array_compact(F.array(*roles))))
    best = Window.partitionBy("role").orderBy("rel_id", "next")
    return met.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= limit).select("role", F.col("next").alias("id"), "kind")


def flow(units: DataFrame, rels: DataFrame, question: str, *, limit: int = 24) -> DataFrame:
    """(source_id, target_id, kind) of flow relations at up to three matches."""
    units, rels = active(units, rels)
    seeds = F.broadcast(resolve(units, question, 3).select(F.col("id").alias("seed")))
    kept = rels.where(F.col("kind").isin(FLOW_KINDS))
    touching = kept.join(seeds, (F.col("source_id") == F.col("seed")), "left_semi").union(kept.join(seeds, F.col("target_id") == F.col("seed"), "left_semi")).distinct()
    return touching.orderBy("id").limit(2 * limit).select("source_id", "target_id", "kind")


def impact(units: DataFrame, rels: DataFrame, question: str, *, limit: int = 24) -> DataFrame:
    """(impact, id, kind): who depends on up to six matches; each source once, by its first relation."""
    units, rels = active(units, rels)
    seeds = F.broadcast(resolve(units, question, 6).select(F.col("id").alias("target_id")))
    met = rels.where(F.col("kind").isin(IMPACT_KINDS)).join(seeds, "target_id")
    first = met.withColumn("rn", F.row_number().over(Window.partitionBy("source_id").orderBy("id"))).where("rn = 1")
    level = F.when(F.col("kind").isin("calls", "imports"), "direct").when(F.col("kind").isin("tests", "covers"), "probable").otherwise("possible")
    return cap(first.select(level.alias("impact"), F.col("source_id").alias("id"), "kind", F.col("id").alias("rel")), "impact", "rel", limit).drop("rel")


def cap(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("rn") <= n).drop("rn")


def reuse(units: DataFrame, rels: DataFrame, question: str, *, limit: int = 8) -> DataFrame:
    """(id, score): existing implementations for a concept, by their own and their neighbours' text."""
    units, rels = active(units, rels)
    neighbour = units.select(F.col("id").alias("next"), F.lower(F.concat_ws(" ", "name", "kind", "properties")).alias("t"))
    around = _sides(rels, "both").join(neighbour, "next").groupBy(F.col("seed").alias("id"))
    found = terms(question)
    near = around.agg(*[F.max(F.col("t").contains(t)).alias(f"n{k}") for k, t in enumerate(found)])
    base = units.where(F.col("kind").isin(REUSE_KINDS) & ~F.coalesce("path", F.lit("")).rlike("(?i)^(?:docs?|documentation|scripts?|fixtures?)/")).join(near, "id", "left")
    hay = F.lower(F.concat_ws(" ", "name", F.coalesce("description", F.lit("")), "canonical_key", "properties"))
    score, hits = F.lit(0.0), F.lit(0)
    for k, t in enumerate(found):
        by_near = F.coalesce(f"n{k}", F.lit(False))
        score = score + F.when(by_near, 2.5).when(hay.contains(t), 3.0).otherwise(0.0)
        hits = hits + (by_near | hay.contains(t)).cast("int")
    signal = F.lit(any(t in ("http", "outbound", "request", "fetch") for t in found)) & F.col("name").rlike("(?i)request|fetch|client|transport|http") & F.coalesce("path", F.lit("")).rlike("(?i)integration|client|http|transport|network")
    scored = base.withColumn("hits", hits + signal.cast("int")).where("hits > 0").withColumn("score", F.round(score + F.when(signal, 5.0).otherwise(0.0) + F.col("confidence") * 0.5, 6))
    return scored.orderBy(F.desc("score"), "name", "id").limit(limit).select("id", "score")


def path(units: DataFrame, rels: DataFrame, question: str, *, to: str, limit: int = 8) -> DataFrame:
    """(position, id, kind): the cheapest way over meaningful relations from the best match of ``question`` to that of ``to``.

    Relations are taken in both directions; sure ones are cheaper. No row if there is no way.
    """
    units, rels = active(units, rels)
    units = cut(units)
    ends = [cut(resolve(units, q, 1).select("id")) for q in (question, to)]
    price = F.round(1.1 - F.least(F.lit(0.45), F.col("confidence") * 0.45) + F.when(F.col("kind") == "maps-to", 0.25).otherwise(0.0), 9)
    kept = rels.where(F.col("kind").isin(MEANINGFUL))
    one = kept.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), price.alias("cost"))
    ways = one.union(one.select("dst", "src", "cost")).groupBy("src", "dst").agg(F.min("cost").alias("cost"))
    best = G.cheapest_paths(cut(ways), ends[0])
    found = G.walk_back(best, ends[1]).where(F.col("position") < max(2, limit))
    return found.join(units.select("id", "kind"), "id").select("position", "id", "kind")


def execute(operation: str, units: DataFrame, rels: DataFrame, question: str, **options) -> DataFrame:
    """One of the operations query, path, explain, flow, impact and reuse by name; a path takes ``to`` as well."""
    known = {"query": ask, "path": path, "explain": explain, "flow": flow, "impact": impact, "reuse": reuse}
    if operation not in known:
        raise ValueError(f"unknown operation {operation}")
    return known[operation](units, rels, question, **options)


# Retrieval -------------------------------------------------------------------


def lexical(docs: DataFrame, question: str, id_col: str, text_col: str) -> DataFrame:
    """(id, score > 0): sum of log1p of the question's token counts over the root of the length; repeated terms count.

    A text is cut into tokens once, if it holds a term at all. The counts come
    out of a generator, which keeps the filter on them from counting again.
    """
    wanted = re.findall(r"[a-z0-9_]+", question.lower())
    if not wanted:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).where("false")
    terms_ = list(dict.fromkeys(wanted))
    low = F.lower(F.col(text_col))
    some = reduce(lambda a, b: a | b, [low.contains(w) for w in terms_])
    tokens = F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), 0)
    counted = F.transform(F.array(tokens), lambda t: F.struct(F.size(t).alias("n"), F.filter(t, lambda x: x.isin(terms_)).alias("hits")))
    rows = docs.where(some).select(F.col(id_col).alias("id"), F.inline(counted)).where(F.size("hits") > 0)

    def times(w: str) -> Column:
        return F.size(F.filter("hits", lambda x: x == w)).cast("double")

    score = sum((F.log1p(times(w)) for w in wanted), F.lit(0.0)) / F.sqrt(F.col("n").cast("double"))
    return rows.select("id", F.round(score, 6).alias("score")).where("score > 0")


def expand(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(id, score): 1 / (distance + 1) from the nearest seed, undirected."""
    found = G.reach(G.both_ways(edges), seeds, depth).groupBy("id").agg(F.min("depth").alias("depth"))
    return found.select("id", (F.lit(1.0) / (F.col("depth") + 1)).alias("score"))


def cosine(vectors: DataFrame, id_col: str, vector_col: str, target: Column) -> DataFrame:
    """(id, score > 0): cosine with a target vector."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return vectors.select(F.col(id_col).alias("id"), F.round(dot(v, target) / F.sqrt(dot(v, v) * dot(target, target)), 6).alias("score")).where("score > 0")


def fuse(rankings: list[DataFrame], *, k: int = 60, limit: int = 20) -> DataFrame:
    """(id, score): reciprocal-rank fusion of (id, score) tables, ties by id."""
    ranked = [rank_all(cut(r.select("id", "score")), [F.desc("score"), F.col("id")], "rn").select("id", "rn") for r in rankings]
    fused = reduce(DataFrame.union, ranked).groupBy("id").agg(F.round(F.sum(1.0 / (k + F.col("rn"))), 9).alias("score"))
    return fused.orderBy(F.desc("score"), "id").limit(max(1, min(limit, 100)))
