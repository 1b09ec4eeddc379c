"""Findings, risk and quality analytics as column expressions and unions of selects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.text import ascii_edges, may_match

#: Line rules: kind, category, severity, title, pattern, confidence, redact.
LINE_RULES = [
    ("security", "secrets", "critical", "Possible hard-coded credential", r"""(?i)\b(?:password|passwd|api[_-]?key|secret|access[_-]?token)\s*[:=]\s*["'][^"']{6,}["']""", 0.94, True),
    ("security", "injection", "critical", "Dynamic code execution", r"(?:^|[;{=(]\s*)(?:eval|exec)\s*\(|new\s+Function\s*\(", 0.92, False),
    ("security", "command-injection", "high", "Shell command construction", r"\b(?:exec|execSync|system|popen|spawn)\s*\([^\n]*(?:\+|`|\$\{)", 0.88, False),
    ("security", "sql-injection", "high", "Dynamic SQL construction", r"(?i)\b(?:select|insert|update|delete)\b[^\n]*(?:\+|\$\{|%s|\.format\()", 0.86, False),
    ("security", "transport", "high", "Insecure HTTP endpoint", r"""(?i)["']http://(?!127\.0\.0\.1|localhost)""", 0.9, False),
    ("security", "xss", "high", "Unsafe HTML injection", r"\b(?:innerHTML|outerHTML|dangerouslySetInnerHTML)\b", 0.9, False),
    ("security", "crypto", "medium", "Weak cryptographic primitive", r"(?i)\b(?:md5|sha1|des|rc4)\b", 0.88, False),
    ("security", "cors", "medium", "Permissive CORS policy", r"""(?i)(?:Access-Control-Allow-Origin|origin)\s*[:=]\s*["']\*["']""", 0.82, False),
    ("security", "filesystem", "medium", "User-influenced filesystem path", r"(?i)(?:readFile|writeFile|open|unlink)\s*\([^\n]*(?:req\.|request\.|params|query|input)", 0.78, False),
    ("security", "logging", "medium", "Sensitive value may be logged", r"(?i)(?:console\.|logger\.|logging\.)[^\n]*(?:token|secret|password|prompt|email|media[_ ]?path)", 0.84, True),
    ("performance", "blocking-io", "high", "Synchronous I/O on an execution path", r"(?i)\b(?:readFileSync|writeFileSync|execSync|spawnSync|sleep\s*\()", 0.9, False),
    ("performance", "unbounded-query", "high", "Potentially unbounded data query", r"(?i)\bselect\b(?![^;\n]*\blimit\b)[^;\n]*(?:from|join)\b", 0.78, False),
    ("performance", "loop-await", "high", "Sequential await inside loop", r"\b(?:for|while)(?!\s+await\b)\s*[^\n{]*[{:]?[^\n]{0,160}\bawait\b", 0.76, False),
    ("performance", "nested-iteration", "medium", "Nested collection traversal", r"\b(?:for|forEach|map|filter)\b[^\n]*[\s\S]{0,120}\b(?:for|forEach|find|filter)\b", 0.72, False),
    ("performance", "serialization", "medium", "Potentially large response serialization", r"(?i)\b(?:JSON\.stringify|json\.dumps)\s*\([^\n]*(?:response|result|records|rows|payload|body)", 0.72, False),
    ("performance", "timer", "low", "Recurring timer requires lifecycle cleanup", r"\bsetInterval\s*\(", 0.82, False),
    ("performance", "network", "medium", "External call without visible timeout", r"\b(?:fetch|axios\.|requests\.|http\.request)\s*\(", 0.7, False),
]
#: Forms of rules for lines, which hold no line feed: what follows the first opening word follows any, so no other one is tried.
_JVM = {
    r"(?i)\b(?:select|insert|update|delete)\b[^\n]*(?:\+|\$\{|%s|\.format\()": r"(?i)^(?>[^\n]*?\b(?:select|insert|update|delete)\b)[^\n]*(?:\+|\$\{|%s|\.format\()",
    r"\b(?:for|forEach|map|filter)\b[^\n]*[\s\S]{0,120}\b(?:for|forEach|find|filter)\b": r"^(?>[^\n]*?\b(?:for|forEach|map|filter)\b)[^\n]*\b(?:for|forEach|find|filter)\b",
}
COMMENT = r"^\s*(?://|/\*|\*|#)|\brule\s*\("

#: Safeguards by report kind.
SAFEGUARDS = [
    ("security", "security headers / CSRF control", r"(?i)helmet\s*\(|Content-Security-Policy|csrf"),
    ("security", "parameterized query", r"(?i)parameterized|preparedStatement|\?\s*[,)]"),
    ("security", "redaction / sanitization", r"(?i)redact|mask|sanitize"),
    ("performance", "timeout / cancellation", r"(?i)AbortController|timeoutMs|timeout\s*[:=]"),
    ("performance", "caching", r"(?i)cache|memo"),
    ("performance", "bounded retrieval", r"(?i)limit|pagination|cursor"),
]

#: Failure classes of flaky tests, in order.
FLAKY_CLASSES = [
    ("BROKEN_LOCATOR", r"(?i)locator|waiting|timed out|not found|could not find|element.*not|stale|no matching|detached|shadow"),
    ("REAL_BUG", r"(?i)assertion|expected|received|toBe|toEqual|toThrow|toMatch|snapshot|expect.*failed"),
    ("ENV_ISSUE", r"(?i)timeout|ECONNREFUSED|network|connection.*reset|ENOSPC|EACCES|permission|out of memory|OOM"),
]
#: Failure classes of remediation, in order: class, pattern, confidence, kind.
REMEDIATION = [
    ("BROKEN_LOCATOR", r"(?i)locator.*not found|element.*not found|unable to find|timeout.*locator", 0.9, "test-defect"),
    ("FLAKY", r"(?i)flaky|intermittent|race condition|timing|sometimes passes|retry", 0.82, "flaky-test"),
    ("ENV_ISSUE", r"(?i)ECONNREFUSED|ENOTFOUND|network|service unavailable|browser.*closed|out of memory|disk full", 0.86, "environment"),
]

#: Weights of the risk score; they sum to 1.05 and the score isn't clamped.
RISK_WEIGHTS = {"churn": 0.35, "coupling": 0.25, "coverage_gap": 0.15, "coverage_depth": 0.1, "author_concentration": 0.1, "test_instability": 0.05, "new_file_boost": 0.05}

#: Redaction categories.
REDACTIONS = [
    ("private-key", r"(?s)-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----.*?-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("github-token", r"\b(?:gh[pousr]_[A-Za-z0-9_]{30,}|github_pat_[A-Za-z0-9_]{30,})\b"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b"),
    ("credential-assignment", r"""(?i)\b(?:api[_-]?key|access[_-]?token|refresh[_-]?token|client[_-]?secret|password)\s*[:=]\s*["']?[^\s"']{8,}"""),
    ("authorization-header", r"(?i)\bAuthorization\s*:\s*(?:Bearer|Basic)\s+[^\s]+"),
]
EXCLUDED_PATH = r"(?i)(^|/)(?:\.env(?:\..*)?|\.ssh|credentials(?:\.json)?|id_(?:rsa|ed25519))(?:$|/)"
DEAD_NAMES = r"(?i)^(main|constructor|render|setup|teardown|beforeEach|afterEach|if|for|while|switch|catch|return|throw|new)$"


def finding_id(category: Column, title: Column, file: Column, description: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", category, title, F.coalesce(file, F.lit("")), description), 256), 1, 24)


def finding(rows: DataFrame, category: str, severity: str, confidence: Column, title: str, file: Column, description: Column) -> DataFrame:
    c, t = F.lit(category), F.lit(title)
    return rows.select(finding_id(c, t, file, description).alias("id"), c.alias("category"), F.lit(severity).alias("severity"), confidence.cast("double").alias("confidence"), t.alias("title"), file.alias("file"), description.alias("description"))


def findings(cycles: DataFrame, orphans: DataFrame, dangling: DataFrame, coupling: DataFrame, dead: DataFrame) -> DataFrame:
    """One table of all structural findings, each once by its id."""
    w = F.round(F.least(F.lit(0.95), 0.5 + F.col("strength") / 2), 6)
    parts = [
        finding(cycles, "architecture", "medium", F.lit(0.95), "Dependency cycle", F.col("file"), F.col("members")),
        finding(orphans, "quality", "low", F.lit(0.6), "Disconnected source file", F.col("file"), F.concat("file", F.lit(" has no resolved local dependency edges."))),
        finding(dangling, "dependency", "low", F.lit(0.8), "Unresolved local import", F.col("file"), F.concat("file", F.lit(" imports "), "target", F.lit(", which is not an indexed file."))),
        finding(coupling.where("commits >= 3 and strength >= 0.5").orderBy(F.desc("strength"), F.desc("commits"), "file", "other").limit(100), "architecture", "info", w, "Historical co-change coupling", F.col("file"), F.concat("file", F.lit(" and "), "other", F.lit(" changed together in "), "commits", F.lit(" commits."))),
        finding(dead, "quality", "low", F.lit(0.8), "Possible dead code", F.col("file"), F.concat("name", F.lit(" has no incoming semantic evidence."))),
    ]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["id"])


def signal_findings(signals: DataFrame, structural: DataFrame) -> DataFrame:
    """Signals (file, category, marker) as findings; explicit markers raise confidence, structural context adds 0.15 up to 0.85."""
    grouped = signals.groupBy("file", "category").agg(F.count("*").alias("n"), F.max(F.col("marker") == "explicit authorization boundary").alias("auth"), F.max(F.col("marker") == "database operation inside loop").alias("loop"))
    auth, loop = F.col("auth") & (F.col("category") == "security"), F.col("loop") & (F.col("category") == "performance")
    base = F.when(F.col("category") == "security", 0.55).otherwise(0.5)
    sure = F.when(auth | loop, F.greatest(base, F.lit(0.7))).otherwise(base)
    met = grouped.join(structural.select("file").distinct().withColumn("near", F.lit(True)), "file", "left")
    title = F.when(auth, "Explicit authorization boundary").when(loop, "Database operation inside loop").when(F.col("category") == "security", "Security-sensitive code").otherwise("Performance-sensitive code")
    severity = F.when(loop | (F.col("category") == "security"), "medium").otherwise("low")
    return met.select("file", "category", "n", title.alias("title"), severity.alias("severity"), F.round(F.when(F.coalesce("near", F.lit(False)), F.least(F.lit(0.85), sure + 0.15)).otherwise(sure), 6).alias("confidence"))


def scan_lines(lines: DataFrame) -> DataFrame:
    """(path, line, category, severity, title, confidence, evidence) of every rule that matches a line that is no comment."""
    code, low = F.col("code"), F.col("low")

    def hit(rule: tuple) -> Column:
        kind, category, severity, title, pattern, confidence, redact = rule
        shown = F.lit("[REDACTED sensitive expression]") if redact else F.substring(F.trim(code), 1, 240)
        return F.when(may_match(low, pattern) & code.rlike(ascii_edges(_JVM.get(pattern, pattern))), F.struct(F.lit(kind).alias("kind"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(title).alias("title"), F.lit(confidence).alias("confidence"), shown.alias("evidence")))

    comment = may_match(low, COMMENT) & code.rlike(COMMENT)
    found = F.when(may_match(low, *[r[4] for r in LINE_RULES]) & ~comment, F.array_compact(F.array(*[hit(r) for r in LINE_RULES])))
    return lines.withColumn("low", F.lower("code")).select("path", "line", F.explode(found).alias("f")).select("path", "line", "f.*")


def safeguards(sources: DataFrame) -> DataFrame:
    """(path, kind, control) of safeguards seen in a file."""
    found = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.struct(F.lit(k).alias("kind"), F.lit(c).alias("control"))) for k, c, p in SAFEGUARDS]))
    return sources.select("path", F.explode(found).alias("s")).select("path", "s.*")


def dead_code(symbols: DataFrame, files: DataFrame, references: DataFrame) -> DataFrame:
    """Local functions and classes of disconnected script files to which nothing refers.

    ``symbols`` (path, line, name, kind, exported), ``files`` (path, lang, is_test,
    entry, api, orphan), ``references`` (path, line).
    """
    lonely = files.where("lang in ('typescript', 'javascript') and not is_test and not entry and not api and orphan").select("path")
    rows = symbols.where(F.col("kind").isin("function", "class") & ~F.col("exported") & ~F.col("name").rlike(DEAD_NAMES))
    return rows.join(lonely, "path", "left_semi").join(references, ["path", "line"], "left_anti").select("path", "line", "name", F.lit(0.8).alias("confidence"))


def gate(requests: DataFrame) -> DataFrame:
    """(id, allowed, reasons): may a remediation go ahead."""
    reasons = F.array_compact(F.array(
        F.when(F.coalesce("approval", F.lit("")) != "granted", "Explicit approval is required."), F.when(F.col("evidence") == 0, "Runtime evidence is required."), F.when(F.col("commands") == 0, "At least one validation command is required."),
        F.when(F.col("affected") == 0, "The affected file scope is empty."), F.when(F.col("affected") > F.col("most"), F.concat(F.lit("Affected scope exceeds "), "most", F.lit(" files."))),
    ))
    return requests.select("id", (F.size(reasons) == 0).alias("allowed"), F.array_join(reasons, " ").alias("reasons"))


def risk_terms() -> dict[str, Column]:
    """The seven terms over columns churn, coupling, coverage, author_share, instability and age_days."""
    churn, coupling, cover = F.col("churn"), F.col("coupling"), F.col("coverage")
    share, shaky, age = F.col("author_share"), F.col("instability"), F.col("age_days")
    return {
        "churn": F.when(churn == 0, 0.0).otherwise(1 - F.exp(-churn / 30)),
        "coupling": F.when(coupling == 0, 0.0).otherwise(1 / (1 + F.exp(-coupling * 2))),
        "coverage_gap": F.when(cover >= 0.5, 0.0).otherwise(1 - cover / 0.5),
        "coverage_depth": F.when(cover >= 0.9, 0.0).otherwise(F.pow(1 - cover, F.lit(2.0))),
        "author_concentration": F.when(share < 0.8, 0.0).otherwise((share - 0.8) / 0.2),
        "test_instability": F.when(shaky < 0.2, 0.0).otherwise((shaky - 0.2) / 0.8),
        "new_file_boost": F.when(age > 30, 0.0).otherwise(1 - age / 30),
    }


def risk(files: DataFrame, key: str) -> DataFrame:
    """(key, score, tier, factors)."""
    terms = risk_terms()
    score = F.round(sum((terms[k] * w for k, w in RISK_WEIGHTS.items()), F.lit(0.0)), 6)
    named = [("high_churn", "churn"), ("high_coupling", "coupling"), ("low_coverage", "coverage_gap"), ("single_author", "author_concentration"), ("flaky_tests", "test_instability"), ("new_file", "new_file_boost")]
    factors = F.array_compact(F.array(*[F.when(F.round(terms[t], 6) > 0.7, n) for n, t in named]))
    tier = F.when(F.col("score") >= 0.8, "critical").when(F.col("score") >= 0.6, "high").when(F.col("score") >= 0.4, "medium").when(F.col("score") >= 0.2, "low").otherwise("none")
    return files.select(key, score.alias("score"), F.array_join(factors, ",").alias("factors")).select(key, "score", tier.alias("tier"), "factors")


def classify_failure(message: Column) -> Column:
    out = F.lit("FLAKY")
    for name, pattern in reversed(FLAKY_CLASSES):
        out = F.when(message.rlike(pattern), name).otherwise(out)
    return out


def remediation(message: Column) -> Column:
    """Struct (type, confidence, kind)."""
    pack = lambda n, c, k: F.struct(F.lit(n).alias("type"), F.lit(c).alias("confidence"), F.lit(k).alias("kind"))
    out = pack("REAL_BUG", 0.68, "product-defect")
    for name, pattern, confidence, kind in reversed(REMEDIATION):
        out = F.when(message.rlike(pattern), pack(name, confidence, kind)).otherwise(out)
    return out


def quarantine(rates: DataFrame, now: Column, *, threshold: float = 0.5, days: int = 7) -> DataFrame:
    """Tests (test_id, rate, at) whose failure rate reaches the threshold and whose time hasn't run out."""
    return rates.where((F.col("rate") >= threshold) & (F.col("at") + F.make_dt_interval(F.lit(days)) > now))


def redact(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, value, categories, safe): secrets replaced by their category's mark."""
    value, kinds = F.col(text_col), []
    for name, pattern in REDACTIONS:
        kinds.append(F.when(value.rlike(pattern), F.lit(name)))
        value = F.regexp_replace(value, pattern, f"[REDACTED:{name.upper()}]")
    return texts.select(F.col(id_col), value.alias("value"), F.array_join(F.array_compact(F.array(*kinds)), ",").alias("categories"), F.col(text_col).rlike(EXCLUDED_PATH).alias("excluded_path"))


def recover_json(response: Column) -> Column:
    """The JSON object of a response: the whole text, a fenced block, or from the first to the last brace; null if none parses."""
    fenced = F.regexp_extract(response, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braced = F.regexp_extract(response, r"(?s)(\{.*\})", 1)
    ok = lambda x: F.when(F.try_parse_json(x).isNotNull() & F.trim(x).startswith("{"), x)
    return F.coalesce(ok(response), ok(fenced), ok(braced))


def scope_drift(observed: DataFrame, excluded: list[str], accepted: list[str]) -> DataFrame:
    """Observed areas (area) within no excluded and no accepted boundary; the boundaries are a request's own few."""
    a = F.lower(F.regexp_replace("area", "^/+|/+$", ""))
    within = lambda b: (a == b) | a.startswith(b + "/") | F.lit(b).contains(a)
    inside = reduce(lambda x, y: x | y, [within(b.lower()) for b in [*excluded, *accepted]], F.lit(False))
    return observed.where(~inside).select("area").distinct()


#: Action words and target words of a request.
ACTIONS = r"^(add|build|create|fix|change|update|remove|refactor|test|explain|review|migrate|improve|implement)$"
TARGETS = r"api|ui|page|service|class|function|test|auth|database|component|extension|prompt|context"


def ambiguity(text: Column) -> Column:
    """Struct (vague, missing_action, missing_target) of a request."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_./-]+"), 0)
    no_action = ~F.exists(tokens, lambda t: t.rlike(ACTIONS))
    no_target = ~F.exists(tokens, lambda t: t.contains("/") | t.rlike(TARGETS))
    return F.struct(((F.size(tokens) < 5) | no_action | no_target).alias("vague"), no_action.alias("missing_action"), no_target.alias("missing_target"))


def qa_impact(tests: DataFrame) -> DataFrame:
    """(tests, confidence): 0.6 + 0.35 of the mean confidence up to 0.95, else 0.35."""
    return tests.agg(F.count("*").alias("tests"), F.avg("confidence").alias("m")).select("tests", F.round(F.when(F.col("tests") > 0, F.least(F.lit(0.95), 0.6 + 0.35 * F.col("m"))).otherwise(0.35), 6).alias("confidence"))


def excerpt_risk(text: Column, high: list[tuple[str, str]], medium: list[tuple[str, str]]) -> Column:
    """Struct (level, areas) by lists of (category, pattern)."""
    hit = lambda rules: reduce(lambda x, y: x | y, [text.rlike(p) for _, p in rules])
    areas = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(c)) for c, p in [*high, *medium]]))
    return F.struct(F.when(hit(high), "high").when(hit(medium), "medium").otherwise("low").alias("level"), F.array_join(areas, ",").alias("areas"))


def gaps(modules: DataFrame) -> DataFrame:
    """Modules (dir, sources, covered, ratio, tests) below half coverage or without tests, with a recommendation."""
    advice = F.when(F.col("tests") == 0, "Add a first test").when(F.col("ratio") == 0, "Cover at least one file").otherwise("Raise coverage")
    return modules.where("ratio < 0.5 or tests = 0").select("dir", "ratio", "tests", advice.alias("recommendation"))


def modernization(files: DataFrame) -> DataFrame:
    """Per directory: size, legacy share, readiness, risk level, effort in days and cost."""
    g = files.groupBy("dir").agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"), F.count_if(F.col("line_count") > 20).alias("large"), F.count_if("is_test").alias("tests"))
    share = F.col("large") / F.col("files")
    readiness = F.round((F.col("tests") / F.col("files") + (1 - share)) / 2 * 100).cast("int")
    return g.select("dir", "files", "lines", F.round(share, 6).alias("legacy_share"), readiness.alias("readiness"), F.when(share > 0.5, "high").when(share > 0.2, "medium").otherwise("low").alias("risk"), F.ceil(F.col("lines") / 400).cast("long").alias("days"), (F.ceil(F.col("lines") / 400) * 800).cast("long").alias("cost"))


def next_phases(phases: DataFrame) -> DataFrame:
    """Phases (plan, phase, done, needs array) that aren't done and whose needs all are."""
    finished = phases.groupBy("plan").agg(F.collect_set(F.when(F.col("done"), F.col("phase"))).alias("ready"))
    return phases.where("not done").join(finished, "plan").where(F.forall("needs", lambda n: F.array_contains(F.col("ready"), n))).select("plan", "phase")
