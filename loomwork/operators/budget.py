"""Context under a token budget: candidates, greedy selection, packets and text compression.

Prefix rules are running sums. Rules that skip what doesn't fit depend on every
choice before, so they are folded in pandas, one request a group.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import text as X

#: Source line signals: pattern, label, weight; and what a query term and a wanted range add.
SIGNALS = [
    (r"^\s*(?:import|export)\b", "dependency", 8),
    (r"^\s*(?:(?:export|default|abstract|async|public|private|protected|static|readonly)\s+)*(?:function|class|interface|type|enum|namespace|const|let|var)\b", "symbol/signature", 10),
    (r"\b(?:if|else|switch|case|default|for|while|do|try|catch|finally)\b", "control-flow", 7),
    (r"(?i)\b(?:throw|reject|Error|exception|finally)\b", "exception/error", 10),
    (r"\b(?:await|return|yield|break|continue)\b", "control-effect", 7),
    (r"(?i)\b(?:save|insert|update|delete|remove|write|emit|publish|send|set|push)\s*\(", "side-effect", 9),
    (r"=>|\b(?:app|router|route)\s*\.|@(?:Get|Post|Put|Patch|Delete)\b", "contract", 9),
    (r"(?i)!==|===|!=|==|\b(?:not|never|without|false|null|undefined)\b", "negation/guard", 9),
    (r"\b\d+(?:\.\d+)?\b", "literal", 4),
    (r"\([^)]*\)|\.[A-Za-z_$][\w$]*\s*\(", "call", 4),
]
TERM_WEIGHT, RANGE_WEIGHT = 8, 14
NOISY = ["source", "documentation", "diagnostics"]


#: Words and phrases of a task's intents, in order.
INTENT_WORDS = {
    "search": ["find", "search", "lookup", "retrieve", "where is", "locate", "find file", "find function", "find class"],
    "refactor": ["refactor", "clean", "restructure", "reorganize", "modernize code", "simplify", "extract", "rename"],
    "migrate": ["migrate", "upgrade", "modernize", "convert", "port", "migrate to", "upgrade to"],
    "analyze": ["analyze", "inspect", "explain", "understand", "how does", "what does", "review code", "assess"],
    "debug": ["debug", "fix", "error", "bug", "crash", "throw", "fail", "issue", "problem", "trace"],
    "document": ["document", "doc", "comment", "readme", "docs", "write docs", "generate docs"],
    "review": ["review", "code review", "pr", "pull request", "check", "audit", "security scan"],
    "test": ["test", "unit test", "integration test", "e2e", "spec", "jest", "vitest", "write test"],
    "explain": ["explain", "what is", "how to", "why does", "describe", "summarize", "clarify"],
    "implement": ["implement", "add feature", "create", "build", "implement", "write code", "develop"],
}
INTENT_PHRASES = {
    "search": ["where is", "find file", "find function", "find class", "locate", "which file", "what file"],
    "refactor": ["refactor", "restructure", "reorganize", "clean up", "simplify", "extract method", "rename"],
    "migrate": ["migrate to", "upgrade to", "convert to", "port to", "upgrade from"],
    "analyze": ["how does", "what does", "review code", "assess", "inspect", "understand"],
    "debug": ["fix", "error", "bug", "crash", "throw", "fail", "issue", "trace", "investigate", "root cause"],
    "document": ["document", "write docs", "generate docs", "add comments", "readme"],
    "review": ["code review", "pr", "pull request", "audit", "security scan"],
    "test": ["unit test", "integration test", "write test", "e2e", "spec"],
    "explain": ["what is", "how to", "why does", "describe", "summarize"],
    "implement": ["add feature", "create", "build", "write code", "develop"],
}
ENTITY = r"""(?:class|interface|type|function|const|let|var)\s+([A-Z]\w+)|import\s+(?:.*from\s+)?['"]([^'"]+)['"]|(?:class|module|function|file|path)\s+['"]([^'"]+)['"]"""


def task_intent(text: Column) -> Column:
    """Struct (intent, confidence, complexity): a phrase decides, else the most keywords; complexity by length and entities.

    The order of the intents breaks ties; a model's own opinion isn't asked.
    """
    low = F.lower(text)
    phrase = F.coalesce(*[F.when(reduce(lambda a, b: a | b, [low.contains(p) for p in ps]), F.lit(n)) for n, ps in INTENT_PHRASES.items()])
    hits = lambda words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)))
    counts = F.array(*[hits(words) for words in INTENT_WORDS.values()])
    most = F.array_max(counts)
    word = F.when(most > 0, F.element_at(F.array(*map(F.lit, INTENT_WORDS)), F.array_position(counts, most).cast("int")))
    found = F.regexp_count(text, F.lit(ENTITY))
    size = F.length(text)
    complexity = F.when(size > 1000, "high").when(size > 200, "medium").when(found > 3, "high").when(found > 0, "medium").otherwise("low")
    blank = F.trim(text) == ""
    return F.struct(
        F.when(blank, "unknown").otherwise(F.coalesce(phrase, word, F.lit("unknown"))).alias("intent"),
        F.when(blank, 0.0).when(phrase.isNotNull(), 1.0).when(most > 0, F.least(most / F.greatest(most, F.lit(2)), F.lit(1.0))).otherwise(0.0).alias("confidence"),
        F.when(blank, "low").otherwise(complexity).alias("complexity"),
    )


def collect(families: list[DataFrame]) -> DataFrame:
    """Candidates (id, relevance, content, ...) of all families, the most relevant with content of each id."""
    every = reduce(DataFrame.unionByName, families)
    best = Window.partitionBy("id").orderBy((F.col("content").isNotNull()).desc(), F.desc("relevance"), "source_type")
    return every.withColumn("__rn", F.row_number().over(best)).where("__rn = 1").drop("__rn")


def dedupe(candidates: DataFrame) -> DataFrame:
    """One candidate a key: its evidence, else its value of 12 letters or more, else its id; maxima merge, cost takes the minimum."""
    value = F.trim(F.regexp_replace(F.lower("content"), r"\s+", " "))
    key = F.coalesce(F.nullif("evidence", F.lit("")), F.when(F.length(value) >= 12, F.concat(F.lit("semantic|"), value)), F.concat_ws("|", "source_type", "id"))
    rows = candidates.withColumn("key", key)
    return rows.groupBy("key").agg(F.min("id").alias("id"), F.max("priority").alias("priority"), F.max("relevance").alias("relevance"), F.min("cost").alias("cost"), F.bool_or("expandable").alias("expandable"), F.array_join(F.array_sort(F.collect_set("source_type")), ",").alias("sources"))


def band(category: str = "category", label: str = "label", source: str = "source_type", relevance: str = "relevance") -> Column:
    """Priority band P0 to P4."""
    c, low, s, r = F.col(category), F.lower(F.coalesce(label, F.lit(""))), F.col(source), F.col(relevance)
    return (
        F.when(c == "history", "P4")
        .when(c == "intent", F.when(low.contains("open question"), "P2").when(low.contains("blocker"), "P1").otherwise("P0"))
        .when(c == "decisions", F.when(low.contains("risk"), "P1").otherwise("P0"))
        .when(c.isin("changes", "diagnostics"), "P1")
        .when(s.isin("bounded-intelligence", "repository-file"), F.when(r >= 0.45, "P1").otherwise("P2"))
        .when(s.isin("intelligence-relationship", "intelligence-flow"), F.when(r >= 0.55, "P1").otherwise("P2"))
        .when(r < 0.3, "P3")
        .otherwise("P2")
    )


def select_greedy(candidates: DataFrame, budget: int) -> DataFrame:
    """(request, id, action, used): mandatory P0 at a share of the budget, then P1 and P2 by density; noisy families are capped.

    ``candidates`` (request, id, band, family, relevance, priority, cost).
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(density=pdf["relevance"] / pdf["cost"].clip(lower=1))
        pdf = pdf.sort_values(["density", "relevance", "priority", "id"], ascending=[False, False, False, True])
        must = pdf[pdf["band"] == "P0"]
        share = max(6, budget // max(1, len(must) * 3))
        used, family, out = 0, {}, []
        for r in must.itertuples():
            cost = int(min(r.cost, share))
            used += cost
            family[r.family] = family.get(r.family, 0) + cost
            out.append((r.request, r.id, "transmitted", cost))
        cap = max(120, int(budget * 0.45))
        for r in pdf[pdf["band"].isin(["P1", "P2"])].itertuples():
            room = min(budget - used, cap - family.get(r.family, 0) if r.family in NOISY else budget)
            cost = int(min(r.cost, max(0, room)))
            if room < 12:
                out.append((r.request, r.id, "omitted", 0))
                continue
            used += cost
            family[r.family] = family.get(r.family, 0) + cost
            out.append((r.request, r.id, "transmitted", cost))
        out += [(r.request, r.id, "reference-only" if r.band == "P3" and k < 48 else "omitted", 0) for k, r in enumerate(pdf[pdf["band"].isin(["P3", "P4"])].itertuples())]
        return pd.DataFrame(out, columns=["request", "id", "action", "used"])

    return candidates.groupBy("request").applyInPandas(fold, "request long, id long, action string, used int")


def skip_fit(rows: DataFrame, by: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """Rows kept in order, each if it still fits; later smaller rows may fit after a skipped one."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        left, keep = budget, []
        pdf = pdf.sort_values(order)
        for c in pdf[cost]:
            keep.append(c <= left)
            left -= c if keep[-1] else 0
        return pdf[keep]

    return rows.groupBy(by).applyInPandas(fold, rows.schema)


def prefix_fit(rows: DataFrame, by: list[str], order: list[str], cost: Column, budget: int) -> DataFrame:
    """Rows in order up to the first overflow; the first always stays."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("__used", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__rn", F.row_number().over(w)).where((F.col("__used") <= budget) | (F.col("__rn") == 1)).drop("__used", "__rn")


def packets(rows: DataFrame, by: str, order: str, cost: str, size: int) -> DataFrame:
    """(by, order, packet): a new packet begins where the next row would overflow, folded inside the plan.

    The fold keeps where packets begin, and a packet's rows are cut out at once, so a request costs its rows and its packets.
    """
    listed = rows.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).cast("long").alias("o"), F.col(cost).cast("long").alias("c")))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["at"] == 0) | ((acc["used"] > 0) & (acc["used"] + x["c"] > size))
        begins = F.when(new, F.concat(acc["begins"], F.array(acc["at"] + 1))).otherwise(acc["begins"])
        return F.struct(F.when(new, x["c"]).otherwise(acc["used"] + x["c"]).alias("used"), (acc["at"] + 1).alias("at"), begins.alias("begins"))

    cut_at = listed.select(by, "rows", F.aggregate("rows", start, step)["begins"].alias("begins"))
    packets_ = cut_at.select(by, "rows", F.posexplode("begins").alias("packet", "begin"), F.concat(F.slice("begins", 2, F.size("begins")), F.array(F.size("rows") + 1)).alias("ends"))
    each = packets_.select(by, "packet", F.explode(F.slice("rows", F.col("begin"), F.element_at("ends", F.col("packet") + 1) - F.col("begin"))).alias("x"))
    return each.select(by, F.col("x.o").alias(order), "packet")


def line_scores(lines: DataFrame, terms: list[str], ranges: list[tuple[int, int]] = ()) -> DataFrame:
    """(path, line, code, score, mandatory): a line's weight for a query; mandatory lines carry more than calls and literals.

    A signal is tried once a line, on lines that hold the words it needs. The scores come out of a generator, which keeps
    filters on them from trying again.
    """
    code, low = F.col("code"), F.col("low")
    made = lines.select("path", "line", "code", F.lower("code").alias("low"))
    made = made.withColumn("hits", F.array(*[X.may_match(low, p) & code.rlike(X.ascii_edges(p)) for p, _, _ in SIGNALS]))
    hit = [F.col("hits")[k] for k in range(len(SIGNALS))]
    weights = [F.when(h, w).otherwise(0) for h, (_, _, w) in zip(hit, SIGNALS, strict=True)]
    near = [F.when(low.contains(t.lower()), TERM_WEIGHT).otherwise(0) for t in terms if len(t) > 2]
    inside = reduce(lambda a, b: a | b, [F.col("line").between(a, b) for a, b in ranges], F.lit(False))
    strong = reduce(lambda a, b: a | b, [h for h, (_, label, _) in zip(hit, SIGNALS, strict=True) if label not in ("call", "literal")])
    score = sum([*weights, *near], F.lit(0)) + F.when(inside, RANGE_WEIGHT).otherwise(0)
    return made.select("path", "line", "code", F.inline(F.array(F.struct(score.alias("score"), strong.alias("mandatory")))))


def compress_source(lines: DataFrame, terms: list[str], budget: int) -> DataFrame:
    """(path, line) kept: mandatory lines, then scored lines and their neighbours by score while they fit.

    Only numbers of lines are brought together, each path's once; what a path keeps beyond its mandatory lines is folded
    inside the plan, and the budget bounds it, as a line costs one at least.
    """
    scored = line_scores(lines, terms).select("path", "line", "score", "mandatory", X.token_estimate(F.col("code")).alias("cost"))
    w = Window.partitionBy("path").orderBy("line")
    near = (F.col("score") > 0) | (F.coalesce(F.lag("score").over(w), F.lit(0)) > 0) | (F.coalesce(F.lead("score").over(w), F.lit(0)) > 0)
    kept = scored.withColumn("near", near).where("near")
    rest = F.when(~F.col("mandatory"), F.struct((-F.col("score")).alias("neg"), "line", "cost"))
    of = kept.groupBy("path").agg(F.collect_list(F.when(F.col("mandatory"), F.col("line"))).alias("must"), (F.lit(budget) - F.coalesce(F.sum(F.when(F.col("mandatory"), F.col("cost"))), F.lit(0))).alias("room"), F.collect_list(rest).alias("rest"))
    start = F.struct(F.col("room").alias("left"), F.array().cast("array<int>").alias("keep"))

    def step(acc: Column, x: Column) -> Column:
        more = F.struct((acc["left"] - x["cost"]).alias("left"), F.concat(acc["keep"], F.array(x["line"].cast("int"))).alias("keep"))
        return F.when(x["cost"] <= acc["left"], more).otherwise(acc)

    fits = F.array_sort(F.filter("rest", lambda x: x["cost"] <= F.col("room")))
    return of.select("path", F.explode(F.concat("must", F.aggregate(fits, start, step)["keep"])).alias("line"))


def unique_lines(lines: DataFrame, by: str, at: str, code: str) -> DataFrame:
    """First occurrences of lines that differ in more than numbers, case and blanks, with their counts."""
    rows = lines.where(F.trim(code) != "").withColumn("__key", X.signal_key(F.col(code)))
    return rows.groupBy(by, "__key").agg(F.min(at).alias(at), F.min_by(code, at).alias(code), F.count("*").alias("occurrences")).drop("__key")


def build_summary(lines: DataFrame, by: str) -> DataFrame:
    """Per output: distinct errors and warnings, raw lines and the last outcome line."""
    code = F.col("code")
    error, warning = code.rlike(r"(?i)(?:error|fatal|failed|failure|exception)\b"), code.rlike(r"(?i)warning\b")
    outcome = code.rlike(r"(?i)(?:exit(?:ed)?|success|passed|completed|failed)\b")
    key = X.signal_key(code)
    return lines.where(F.length("code") > 0).groupBy(by).agg(F.countDistinct(F.when(error, key)).alias("errors"), F.countDistinct(F.when(warning, key)).alias("warnings"), F.count("*").alias("raw_lines"), F.coalesce(F.max_by("code", F.when(outcome, F.col("line"))), F.lit("completed")).alias("outcome"))


def diff_summary(lines: DataFrame, by: str) -> DataFrame:
    """Per diff: files, hunks, additions and removals."""
    c = F.col("code")
    return lines.groupBy(by).agg(F.countDistinct(F.when(c.startswith("diff --git"), c)).alias("files"), F.count_if(c.startswith("@@")).alias("hunks"), F.count_if(c.rlike(r"^\+[^+]")).alias("additions"), F.count_if(c.rlike("^-[^-]")).alias("removals"))


def shape(text: Column) -> Column:
    """Kind and size of a JSON value: keys of an object, length of an array, else a scalar."""
    return F.when(F.try_parse_json(text).isNull(), "text").when(F.json_array_length(text).isNotNull(), F.concat(F.lit("array:"), F.json_array_length(text))).when(F.size(F.json_object_keys(text)) >= 0, F.concat(F.lit("object:"), F.array_join(F.slice(F.json_object_keys(text), 1, 40), ","))).otherwise("scalar")


def smaller(original: Column, reduced: Column) -> Column:
    """The reduced text, unless it isn't shorter in bytes."""
    return F.when(F.octet_length(reduced) < F.octet_length(original), reduced).otherwise(original)


def expand(retained: DataFrame, words: list[str], level: int) -> DataFrame:
    """Retained rows (id, content, relevance) that match most focus words, as many as the level gives."""
    n = [1, 2, 4, 6, 8][max(0, min(4, level))]
    score = sum((F.when(F.lower("content").contains(w.lower()), 10).otherwise(0) for w in words), F.lit(0))
    return retained.withColumn("focus", score).where("focus > 0").orderBy(F.desc("focus"), F.desc("relevance"), "id").limit(n)


def ledger(observations: DataFrame, *, keep: int = 100) -> DataFrame:
    """The newest observation of each package (package_id, seq), ``keep`` an intent."""
    newest = observations.groupBy("intent_id", "package_id").agg(F.max("seq").alias("seq"))
    w = Window.partitionBy("intent_id").orderBy(F.desc("seq"), "package_id")
    return newest.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= keep).drop("__rn")
