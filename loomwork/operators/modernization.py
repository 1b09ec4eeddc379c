"""Modernisation: assessment of repositories, gaps, and the cost, state and validity of migration plans.

``metrics`` has a row a repository: repository, files, symbols, dependencies,
tests, documentation, builds, average_lines, max_lines, database (boolean).
``phases`` has a row a phase: plan, phase, position, effort, needs (array of
phases), checks, rollbacks, approval and reversible (booleans).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators.relational import cap_per_key

#: Weights of severities.
SEVERITY = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def _risk(name: str, area: str, severity: Column, likelihood: float, impact: str, applies: Column) -> Column:
    fields = [F.lit(name).alias("risk"), F.lit(area).alias("area"), severity.alias("severity"), F.lit(likelihood).alias("likelihood"), F.lit(impact).alias("impact")]
    return F.when(applies, F.struct(*fields))


def _risks() -> Column:
    """Risks, their areas, severities, likelihoods and impacts, with the limits that raise them."""
    large = F.when(F.col("max_lines") > 1000, "high").otherwise("medium")
    return F.array_compact(F.array(
        _risk("missing-tests", "testing", F.lit("critical"), 0.85, "critical", F.col("tests") == 0),
        _risk("missing-docs", "documentation", F.lit("medium"), 0.7, "medium", F.col("documentation") == 0),
        _risk("large-files", "code", large, 0.65, "high", F.col("max_lines") > 500),
        _risk("dependency-volume", "dependency", F.lit("high"), 0.72, "high", F.col("dependencies") > 60),
        _risk("architecture-unknowns", "architecture", F.lit("medium"), 0.6, "high", F.lit(True)),
        _risk("database-coupling", "database", F.lit("medium"), 0.55, "high", F.col("database")),
    ))


def risks(metrics: DataFrame) -> DataFrame:
    """(repository, risk, area, severity, likelihood, impact)."""
    return metrics.select("repository", F.inline(_risks()))


def _clamp(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def assess(metrics: DataFrame) -> DataFrame:
    """(repository, debt, complexity, readiness, risks): scores from 0 to 100 and the number of risks.

    Fixed values: the factors and limits of the scores.
    """
    weight = F.aggregate(_risks(), F.lit(0), lambda acc, r: acc + F.coalesce(*[F.when(r["severity"] == k, v) for k, v in SEVERITY.items()]))
    n = F.greatest(F.lit(1), F.col("files"))
    debt = _clamp(weight * 8 + F.greatest(F.lit(0.0), F.col("average_lines") - 200) / 8 + F.greatest(F.lit(0.0), F.col("dependencies") - 80.0) / 5)
    hard = _clamp(F.col("symbols") / n * 8 + F.col("max_lines") / 20 + F.col("dependencies") / 3)
    credit = F.when(F.col("tests") > 0, 8).otherwise(0) + F.when(F.col("documentation") > 0, 5).otherwise(0) + F.when(F.col("builds") > 0, 5).otherwise(0)
    scored = metrics.select("repository", debt.alias("debt"), hard.alias("complexity"), credit.alias("credit"), F.size(_risks()).alias("risks"))
    ready = _clamp(100 - (F.col("debt") * 0.55 + F.col("complexity") * 0.25) + F.col("credit"))
    return scored.select("repository", F.round("debt", 2).alias("debt"), F.round("complexity", 2).alias("complexity"), F.round(ready, 2).alias("readiness"), "risks")


def gaps(metrics: DataFrame, *, target_known: bool = True, risks: DataFrame | None = None) -> DataFrame:
    """(repository, gap, area, priority, effort) between what a repository has and a target architecture.

    ``risks`` (repository, risk, area, severity) of the technology stack and of security are gaps as well.
    Fixed values: names, areas, priorities and efforts of gaps, and the limits that raise them.
    """

    def one(name: str, area: str, priority: str, effort: str, applies: Column) -> Column:
        return F.when(applies, F.struct(F.lit(name).alias("gap"), F.lit(area).alias("area"), F.lit(priority).alias("priority"), F.lit(effort).alias("effort")))

    found = F.array_compact(F.array(
        one("testing-safety-net", "testing", "critical", "medium", F.col("tests") == 0),
        one("documentation-baseline", "documentation", "medium", "low", F.col("documentation") == 0),
        one("dependency-surface", "dependency", "high", "high", F.col("dependencies") > 40),
        one("architecture-target", "architecture", "high", "high", F.lit(target_known)),
    ))
    own = metrics.select("repository", F.inline(found))
    if risks is None:
        return own
    stack = risks.where(F.col("area").isin("technology-stack", "security"))
    effort = F.when(F.col("severity") == "critical", "high").otherwise("medium")
    return own.union(stack.select("repository", F.concat(F.lit("risk-"), "risk"), "area", "severity", effort))


#: Most components of a repository, gaps of a plan and effort in days by the effort of a gap.
MOST_COMPONENTS, MOST_GAPS = 12, 8
EFFORT = {"high": 8, "medium": 5, "low": 2}
#: Strategies of phases by the area of their gap.
PHASE_STRATEGY = {"architecture": "strangler-fig", "dependency": "incremental-upgrade", "technology-stack": "incremental-upgrade", "api": "refactor", "code": "refactor", "database": "replatform"}
#: Order of gaps of the same priority in a plan.
GAP_ORDER = ["testing-safety-net", "documentation-baseline", "dependency-surface", "architecture-target"]


def _weight(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == k, v) for k, v in SEVERITY.items()])


def components(files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(repository, component, assets, dependencies, boundary_risk): the first top folders of each repository by name, or else its root.

    ``files`` (repository, path), ``dependencies`` (repository, path, target). A root counts each target once.
    Fixed values: the limits of a boundary's risk.
    """
    top = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1))
    assets = files.groupBy("repository", top.alias("component")).agg(F.count("*").alias("assets"))
    uses = dependencies.groupBy("repository", top.alias("component")).agg(F.count("*").alias("uses"))
    folders = first_folders(assets.where("component is not null"))
    made = folders.join(uses, ["repository", "component"], "left").select("repository", "component", "assets", F.coalesce("uses", F.lit(0)).alias("dependencies"))
    bare = assets.groupBy("repository").agg(F.sum("assets").alias("assets"), F.max("component").alias("any")).where("any is null")
    targets = dependencies.groupBy("repository").agg(F.countDistinct("target").alias("targets"))
    roots = bare.join(targets, "repository", "left").select("repository", F.col("repository").alias("component"), "assets", F.coalesce("targets", F.lit(0)))
    risk = F.when(F.col("dependencies") > 15, "high").when(F.col("assets") > 20, "medium").otherwise("low")
    return made.union(roots).select("*", risk.alias("boundary_risk"))


def first_folders(folders: DataFrame) -> DataFrame:
    """The first folders (repository, component, ...) of each repository by name."""
    return cap_per_key(folders, ["repository"], [F.col("component")], MOST_COMPONENTS)


def architecture(parts: DataFrame, frameworks: DataFrame) -> DataFrame:
    """(repository, style, components, confidence) from ``components`` and ``frameworks`` (repository, name, category)."""
    seen = F.lower("name").contains("express") | F.lower("name").contains("spring")
    signals = frameworks.groupBy("repository").agg(F.count("*").alias("signals"), F.max(seen).alias("layered"))
    g = parts.groupBy("repository").agg(F.count("*").alias("components")).join(signals, "repository", "left")
    style = F.when(F.coalesce("layered", F.lit(False)), "layered").when(F.col("components") > 1, "modular-monolith").otherwise("unknown")
    sure = F.least(F.lit(0.9), 0.45 + F.col("components") * 0.04 + F.coalesce("signals", F.lit(0)) * 0.03)
    return g.select("repository", style.alias("style"), "components", F.round(sure, 2).alias("confidence"))


def capabilities(files: DataFrame, modules: DataFrame) -> DataFrame:
    """(repository, capability, assets, criticality, confidence) of ``modules`` (repository, module).

    An asset is a file (repository, path, symbols array) whose path or one of whose symbols holds the module's
    name in any letter case; a module without any is its own asset, and a repository without modules has a core. A
    repository's modules, its top folders, ride along with its files as an array of at most ``MOST_COMPONENTS``.
    """
    known = modules.groupBy("repository").agg(F.collect_set("module").alias("modules"))
    low, names = F.lower("path"), F.transform(F.coalesce("symbols", F.array().cast("array<string>")), F.lower)
    held = F.filter("modules", lambda m: low.contains(F.lower(m)) | F.exists(names, lambda n: n.contains(F.lower(m))))
    hits = files.join(known, "repository").select("repository", F.explode(held).alias("module")).groupBy("repository", "module").agg(F.count("*").alias("assets"))
    words = F.split(F.regexp_replace("module", "[-_]", " "), r"(?<=\W)(?=\w)")
    named = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")
    made = modules.distinct().join(hits, ["repository", "module"], "left").select("repository", named.alias("capability"), F.coalesce("assets", F.lit(1)).alias("assets"), F.lit(0.6).alias("confidence"))
    bare = files.groupBy("repository").agg(F.least(F.count("*"), F.lit(12)).alias("assets")).join(modules.select("repository"), "repository", "left_anti")
    made = made.union(bare.select("repository", F.lit("Core application capability"), "assets", F.lit(0.55)))
    core = F.col("confidence") < 0.6
    return made.select("repository", "capability", "assets", F.when((F.col("assets") > 4) & ~core, "high").otherwise("medium").alias("criticality"), "confidence")


def targets(assessed: DataFrame, found: DataFrame) -> DataFrame:
    """(repository, place, target, style, score, cost, reversibility): scored target architectures, best first.

    ``assessed`` as of ``assess``, ``found`` as of ``architecture``. Fixed values: the targets and their scores.
    """
    grown = lambda style: F.when(F.coalesce(F.col("style") == style, F.lit(False)), 70.0).otherwise(82 - F.col("complexity") * 0.25)

    def one(k: int, target: str, style: str, score: Column, cost: str, reversibility: str) -> Column:
        return F.struct(F.round(_clamp(score), 2).alias("score"), F.lit(-k).alias("k"), F.lit(target).alias("target"), F.lit(style).alias("style"), F.lit(cost).alias("cost"), F.lit(reversibility).alias("reversibility"))

    made = F.array(
        one(0, "target-incremental-modular", "modular-monolith", 100 - F.col("debt") * 0.35, "medium", "low"),
        one(1, "target-service-oriented", "service-oriented", grown("service-oriented"), "medium", "medium"),
        one(2, "target-strangler", "microservices", grown("microservices"), "high", "medium"),
    )
    ranked = assessed.join(found.select("repository", "style"), "repository", "left").select("repository", F.posexplode(F.sort_array(made, asc=False)).alias("place", "t"))
    return ranked.select("repository", "place", "t.target", "t.style", "t.score", "t.cost", "t.reversibility")


def strategy(assessed: DataFrame, found: DataFrame, gap_rows: DataFrame) -> DataFrame:
    """(repository, strategy)."""
    g = gap_rows.groupBy("repository").agg(F.max(F.col("priority") == "critical").alias("critical"), F.max(F.col("area") == "architecture").alias("boundaries"))
    met = assessed.join(found.select("repository", "style"), "repository", "left").join(g, "repository", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    way = F.when((F.col("readiness") < 35) | yes("critical"), "strangler-fig").when(F.coalesce("style", F.lit("unknown")) == "unknown", "incremental-upgrade").when(yes("boundaries"), "refactor").otherwise("replatform")
    return met.select("repository", way.alias("strategy"))


def plan_phases(metrics: DataFrame, gap_rows: DataFrame) -> DataFrame:
    """(plan, phase, position, strategy, effort, needs, checks, rollbacks, approval, reversible) for each repository as a plan.

    A safety net comes first, then a phase for each of the gravest gaps, which needs it, and a closing phase that needs these.
    Fixed values: names and efforts of the first and the last phase.
    """
    order = F.coalesce(F.array_position(F.array(*[F.lit(g) for g in GAP_ORDER]), F.col("gap")), F.lit(0))
    order = F.when(order == 0, len(GAP_ORDER) + 1).otherwise(order)
    graded = gap_rows.select("repository", F.struct((-_weight(F.col("priority"))).alias("w"), order.alias("o"), "gap", "area", "priority", "effort").alias("g"))
    chosen = cap_per_key(graded, ["repository"], [F.col("g")], MOST_GAPS).groupBy("repository").agg(F.array_sort(F.collect_list("g")).alias("gs"))
    none = F.array().cast("array<string>")
    strategy_of = lambda area: F.coalesce(*[F.when(area == k, v) for k, v in PHASE_STRATEGY.items()], F.lit("retain"))
    days = lambda g: F.coalesce(*[F.when(g["effort"] == k, v) for k, v in EFFORT.items()]) + F.greatest(F.lit(0), -g["w"] - 2)
    named = lambda g, k: F.concat(F.lit("phase-"), (k + 2).cast("string"), F.lit("-"), g["gap"])

    def phase(name: Column, position: Column, way: Column, effort: Column, needs: Column, rollbacks: int, approval: Column) -> Column:
        fields = {"phase": name, "position": position.cast("int"), "strategy": way, "effort": effort.cast("int"), "needs": needs, "checks": F.lit(1), "rollbacks": F.lit(rollbacks), "approval": approval, "reversible": F.lit(True)}
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    safety = F.lit("phase-1-safety-net")
    met = metrics.select("repository").join(chosen, "repository", "left")
    middle = F.transform("gs", lambda g, k: phase(named(g, k), k + 2, strategy_of(g["area"]), days(g), F.array(safety), 2, g["priority"].isin("high", "critical")))
    n = F.when(F.col("gs").isNull(), 0).otherwise(F.size("gs"))
    last = phase(F.concat(F.lit("phase-"), (n + 2).cast("string"), F.lit("-operational-readiness")), n + 2, F.lit("retain"), F.lit(2), F.coalesce(F.transform("gs", named), none), 1, F.lit(True))
    first = phase(safety, F.lit(1), F.lit("incremental-upgrade"), F.lit(3), none, 1, F.lit(False))
    every = F.concat(F.array(first), F.coalesce(middle, F.filter(F.array(first), lambda x: F.lit(False))), F.array(last))
    return met.select(F.col("repository").alias("plan"), F.inline(every))


def impact(phases: DataFrame, risk_rows: DataFrame) -> DataFrame:
    """(plan, phases, architecture, repository, business, technology, migration, operational): heat of each kind from 0 to 100.

    ``risk_rows`` (repository, area, severity, likelihood) are those of the plan's repository.
    """
    areas = {"architecture": "architecture", "repository": "code", "business": "business-capability", "technology": "technology-stack", "operational": "operations"}
    heat = _weight(F.col("severity")) * F.col("likelihood") * 25
    hot = risk_rows.groupBy(F.col("repository").alias("plan")).agg(*[F.sum(F.when(F.col("area") == a, heat)).alias(k) for k, a in areas.items()])
    plan = phases.groupBy("plan").agg(F.count("*").alias("phases"), F.sum("effort").alias("effort")).join(hot, "plan", "left")
    shown = [F.round(F.least(F.lit(100.0), F.coalesce(k, F.lit(0.0))), 6).alias(k) for k in areas]
    return plan.select("plan", "phases", *shown, F.least(F.lit(100), F.col("effort") * 2).cast("int").alias("migration"))


def validate(phases: DataFrame) -> DataFrame:
    """(plan, phase, level, message): blockers and warnings of plans."""
    known = phases.groupBy("plan").agg(F.collect_set("phase").alias("known"))
    met = phases.join(known, "plan")
    missing = met.select("plan", "phase", F.explode(F.array_except("needs", "known")).alias("need")).select("plan", "phase", F.lit("blocker").alias("level"), F.concat(F.lit("missing prerequisite "), "need").alias("message"))

    def rule(where: Column, level: str, message: str) -> DataFrame:
        return phases.where(where).select("plan", "phase", F.lit(level).alias("level"), F.lit(message).alias("message"))

    return missing.union(rule(F.col("checks") == 0, "blocker", "no functional-equivalence validation")).union(rule(F.col("rollbacks") == 0, "warning", "no rollback notes")).union(rule(~F.col("reversible"), "warning", "non-reversible transformation"))


def cost(phases: DataFrame, high_risks: DataFrame) -> DataFrame:
    """(plan, engineering, validation, review, total, multiplier) in days; ``high_risks`` (plan, high) counts a plan's high risks.

    Fixed values: the factors of the multiplier and of the days.
    """
    plan = phases.groupBy("plan").agg(F.sum("effort").alias("effort"), F.count("*").alias("n"), F.sum("checks").alias("checks"), F.count_if("approval").alias("review")).join(high_risks, "plan", "left")
    times = F.round(1 + F.coalesce("high", F.lit(0)) * 0.15 + F.greatest(F.lit(0), F.col("n") - 3) * 0.05, 2)
    plan = plan.withColumn("multiplier", times).withColumn("engineering", F.ceil(F.round(F.col("effort") * times, 6)).cast("long")).withColumn("validation", F.ceil(F.col("checks") * 0.5).cast("long"))
    return plan.select("plan", "engineering", "validation", "review", (F.col("engineering") + F.col("validation") + F.col("review")).alias("total"), "multiplier")


def track(phases: DataFrame, completed: DataFrame, issues: DataFrame) -> DataFrame:
    """(plan, active, percent, remaining, blocked) from ``completed`` (plan, phase) and ``issues`` (plan, issue)."""
    over = completed.groupBy("plan").agg(F.collect_set("phase").alias("__over"))
    met = phases.join(over, "plan", "left").withColumn("__over", F.coalesce("__over", F.array().cast("array<string>")))
    own = F.array_contains("__over", F.col("phase"))
    free = ~own & F.forall("needs", lambda n: F.array_contains(F.col("__over"), n))
    state = met.groupBy("plan").agg(F.min_by("phase", F.when(free, F.col("position"))).alias("first"), F.count_if(free).alias("free"), F.sum("effort").alias("effort"), F.sum(F.when(own, F.col("effort")).otherwise(0)).alias("spent"), F.count("*").alias("n"), F.max(F.size("__over")).alias("k"))
    total = F.greatest(F.lit(1), F.col("effort"))
    open_ = issues.groupBy("plan").agg(F.count("*").alias("issues"))
    met = state.join(open_, "plan", "left")
    active = F.when(F.col("free") > 0, F.col("first"))
    blocked = (F.coalesce("issues", F.lit(0)) > 0) | (active.isNull() & (F.col("k") < F.col("n")))
    return met.select("plan", active.alias("active"), F.round(F.col("spent") / total * 100, 2).alias("percent"), F.greatest(F.lit(0), total - F.col("spent")).alias("remaining"), blocked.alias("blocked"))


def govern(phases: DataFrame, approved: DataFrame) -> DataFrame:
    """(plan, phase): phases that ask for an approval which ``approved`` (plan, phase) doesn't have."""
    return phases.where("approval").select("plan", "phase").join(approved, ["plan", "phase"], "left_anti")
