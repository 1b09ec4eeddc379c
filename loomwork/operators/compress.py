"""Texts reduced to what a reader of them needs: tool output, diffs, documents, histories and structured values.

What concerns lines on their own is done within the row by array functions;
what groups lines is done with a row a line and bounded groups: no more lines of
a text are brought together than its limit can hold. ``texts`` have an id and a
text column; results have the id, ``content`` and ``derived``, which is false
where the original is no longer than its reduction, and stays.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import text as X
from loomwork.operators.relational import cap_per_key
from loomwork.session import ship

#: Signals of a diff's changed lines, in order.
DIFF_SIGNALS = [
    ("API/symbol", r"\b(?:function|class|interface|type|export|import)\b"),
    ("contract", r"(?i)\b(?:route|router|endpoint|schema|contract|public|export)\b"),
    ("error behavior", r"(?i)\b(?:throw|catch|Error|exception|reject)\b"),
    ("control flow", r"\b(?:if|else|switch|case|for|while|try|finally|return|await)\b"),
    ("side effect", r"(?i)\b(?:save|insert|update|delete|write|emit|publish|send)\s*\("),
]
#: Lines of a document that must stay, and that are chosen besides.
REQUIREMENT = r"(?i)\b(?:must|shall|required|requirement|constraint|do not|don't|never|only|unless|without|not|should|decision|architecture|contract|api|risk|trade[- ]?off)\b"
LITERAL = r"`[^`]+`|\b\d+(?:\.\d+)?\b"
OUTLINE = r"^\s*#{1,6}\s|^\s*(?:[-*]|\d+[.)])\s"
#: Sections of a history in order, the keys whose texts belong to them, and the texts of plain messages that do.
HISTORY_SECTIONS = ["goal", "constraints", "decisions", "rejected", "completed", "currentObjective", "blockers", "openQuestions"]
HISTORY_KEYS = [
    ("goal", r"^(goal|objective|intent|task|summary|request)$"),
    ("constraints", r"(constraint|requirement|avoid|must|security|scope|acceptance|standard)"),
    ("decisions", r"(decision|accepted|approved|chosen|resolution)"),
    ("rejected", r"(reject|rejected|declined|discarded|wont|wontdo)"),
    ("completed", r"(completed|complete|done|finished|implemented|validated|result)"),
    ("completed", r"(qa|check|test|validation)"),
    ("currentObjective", r"(currentobjective|nextstep|currenttask)"),
    ("blockers", r"(blocker|blocked|failure|error|impediment)"),
    ("openQuestions", r"(question|open|unknown|todo|followup)"),
]
MESSAGE_KEYS = r"^(message|description|detail|reason|status|result|outcome)$"
HISTORY_TEXTS = [
    ("blockers", r"(?i)\b(?:blocked|blocker|failed|failure|error|cannot|unable)\b"),
    ("completed", r"(?i)\b(?:completed|complete|implemented|finished|done|passed|validated)\b"),
    ("decisions", r"(?i)\b(?:approved|accepted|decided|chosen|resolved)\b"),
    ("openQuestions", r"(?i)\?|\b(?:open|unknown|todo|follow[- ]?up)\b"),
]
#: Keys of structured values that always stay.
IMPORTANT_KEY = re.compile(
    r"(?:^|_)(?:id|path|name|label|kind|type|method|code|message|status|severity|line|column|count|version|hash|from|to|source|target|unit|value|summary|description|reason|command|outcome|timestamp)(?:$|_)",
    re.I,
)
#: Signs of build output.
FAILURE, WARNING = r"(?i)(?:error|fatal|failed|failure|exception)\b", r"(?i)warning\b"
OUTCOME = r"(?i)(?:exit(?:ed)?|success|passed|completed|failed)\b"
#: Where a search result's file stands in its line.
SEARCH_FILE = r"(?:^|\s)([^:\s]+\.[A-Za-z0-9]+)(?::\d+)?(?::\d+)?"
BOUNDED = "… projection bounded; expand the authoritative evidence for remaining records …"
PRESERVED = "… projection bounded while preserving all requirement and contract lines …"


def _plain(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(X.ascii_edges(pattern))


def _any(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [_has(text, p) for p in patterns])


def quarters(text: Column) -> Column:
    """Quarters of a token: one for an ASCII code point, two for any other."""
    return F.length(text) + X.wide_count(text)


def split_lines(texts: DataFrame, by: str, text: str) -> DataFrame:
    """(by, line, code) of the lines that aren't empty, from 0."""
    return texts.select(by, F.posexplode(F.split(_plain(F.col(text)), "\n", -1)).alias("line", "code")).where("code <> ''")


def assemble(parts: DataFrame, by: str, limit: int) -> DataFrame:
    """(by, content): texts in the order of (section, pos) up to the first that would pass ``limit`` code points; the first stays."""
    order = ["section", "pos", "text"]
    w = Window.partitionBy(by).orderBy(*order)
    few = cap_per_key(parts, [by], [F.col(c) for c in order], limit + 1)  # each takes one at least
    fit = few.withColumn("__used", F.sum(F.length("text") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).withColumn("__n", F.row_number().over(w))
    kept = fit.where((F.col("__used") <= limit) | (F.col("__n") == 1))
    listed = F.array_sort(F.collect_list(F.struct(*order)))
    return kept.groupBy(by).agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n").alias("content"))


def assemble_marked(parts: DataFrame, by: str, tokens: int) -> DataFrame:
    """(by, content): all texts if they fit into ``tokens``, else those that fit together with a mark that more was there."""
    limit, order = 4 * tokens, ["section", "pos", "text"]
    w = Window.partitionBy(by).orderBy(*order)
    few = cap_per_key(parts, [by], [F.col(c) for c in order], limit + 2).withColumn("__w", quarters(F.col("text")) + 1)
    used = few.withColumn("__used", F.sum("__w").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum("__w").over(Window.partitionBy(by)) - 1)
    mark = len(BOUNDED) + 2  # its two dots aren't ASCII
    whole = F.col("__all") <= limit
    kept = used.withColumn("__in", whole | (F.col("__used") + mark <= limit))
    listed = F.array_sort(F.collect_list(F.when(F.col("__in"), F.struct(*order))))
    g = kept.groupBy(by).agg(listed.alias("l"), F.max(whole).alias("whole"), F.min_by("text", F.struct(*order)).alias("first"))
    text = F.array_join(F.transform("l", lambda x: x["text"]), "\n")
    alone = _head(F.col("first") if mark < limit else F.lit(BOUNDED), limit)
    return g.select(by, F.when(F.col("whole"), text).when((F.size("l") == 0) | F.lit(mark >= limit), alone).otherwise(F.concat(text, F.lit("\n" + BOUNDED))).alias("content"))


def _head(text: Column, limit: int) -> Column:
    """The longest beginning of up to ``limit`` quarters."""
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"))

    def step(acc: Column, c: Column) -> Column:
        used = acc["used"] + F.when(F.ascii(c) < 128, 1).otherwise(2)
        return F.struct(used.cast("int").alias("used"), (acc["n"] + F.when(used <= limit, 1).otherwise(0)).cast("int").alias("n"))

    letters = F.filter(F.split(F.substring(text, 1, limit), ""), lambda c: c != "")
    return F.rtrim(F.substring(text, F.lit(1), F.aggregate(letters, start, step)["n"]))


def keep_smaller(texts: DataFrame, reduced: DataFrame, by: str, text: str) -> DataFrame:
    """(by, content, derived): the reduction of each text, or the text where that is no shorter in bytes."""
    own = _plain(F.col(text))
    met = texts.select(by, own.alias("__own")).join(reduced, by, "left")
    shorter = F.coalesce(F.octet_length("content") < F.octet_length("__own"), F.lit(False))
    return met.select(by, F.when(shorter, F.col("content")).otherwise(F.col("__own")).alias("content"), shorter.alias("derived"))


def keep_smaller_own(texts: DataFrame, by: str, text: str, reduction) -> DataFrame:
    """The same for a reduction that is an expression of the text: nothing is joined, and the reduction made once a row."""
    both = texts.select(by, F.inline(F.array(F.struct(_plain(F.col(text)).alias("own"), reduction(F.col(text)).alias("content")))))
    shorter = F.coalesce(F.octet_length("content") < F.octet_length("own"), F.lit(False))
    return both.select(by, F.when(shorter, F.col("content")).otherwise(F.col("own")).alias("content"), shorter.alias("derived"))


def _part(section: int, pos: Column | int, text: Column) -> list[Column]:
    return [F.lit(section).alias("section"), (F.lit(pos) if isinstance(pos, int) else pos).cast("long").alias("pos"), text.alias("text")]


def grouped(lines: DataFrame, by: str, group: Column, title: Column, header: Column, each: int, unique: Column | None = None) -> DataFrame:
    """Parts of lines (by, line, code) by group, in the order of the groups' first lines: a title and up to ``each`` lines.

    ``title`` is made of ``g`` and ``n``, ``header`` of ``lines`` and ``groups``; of lines with the same ``unique`` the first stays.
    """
    rows = lines.withColumn("g", group)
    counts = rows.groupBy(by, "g").agg(F.count("*").alias("n"), F.min("line").alias("first"))
    if unique is not None:
        rows = rows.groupBy(by, "g", unique.alias("__u")).agg(F.min_by("code", "line").alias("code"), F.min("line").alias("line"))
    top = cap_per_key(rows.select(by, "g", "line", "code"), [by, "g"], [F.col("line")], each).groupBy(by, "g").agg(F.array_sort(F.collect_list(F.struct("line", "code"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["code"]), "\n")
    parts = counts.join(top, [by, "g"]).select(by, *_part(1, F.col("first"), F.concat(title, F.lit("\n"), body)))
    heads = counts.groupBy(by).agg(F.sum("n").alias("lines"), F.count("*").alias("groups"))
    return heads.select(by, *_part(0, 0, header)).union(parts)


def git_status(texts: DataFrame, by: str, text: str, *, tokens: int = 1200) -> DataFrame:
    """Changed paths by their two letters of state, up to 40 each."""
    state = F.substring("code", 1, 2)
    title, header = F.concat("g", F.lit(": "), "n", F.lit(" path(s)")), F.concat(F.lit("Git status: "), "lines", F.lit(" changed path(s)"))
    return keep_smaller(texts, assemble(grouped(split_lines(texts, by, text), by, state, title, header, 40), by, 4 * tokens), by, text)


def search_output(texts: DataFrame, by: str, text: str, *, tokens: int = 1400) -> DataFrame:
    """Matches by file, up to 12 that differ in more than positions, blanks and case."""
    file = F.regexp_extract("code", SEARCH_FILE, 1)
    same = F.trim(F.lower(F.regexp_replace(F.regexp_replace("code", r":\d+(?::\d+)?(?=\s|$)", ":#"), r"\s+", " ")))
    title = F.concat("g", F.lit(": "), "n", F.lit(" match(es)"))
    header = F.concat(F.lit("Search results: "), "lines", F.lit(" match(es) across "), "groups", F.lit(" file group(s)"))
    return keep_smaller(texts, assemble(grouped(split_lines(texts, by, text), by, F.when(file != "", file).otherwise("unresolved"), title, header, 12, same), by, 4 * tokens), by, text)


def directory_output(texts: DataFrame, by: str, text: str, *, tokens: int = 1000) -> DataFrame:
    """Paths by folder, up to 20 each."""
    folder = F.when(F.col("code").rlike(r"[\\/]"), F.regexp_replace(F.regexp_replace("code", r"[\\/][^\\/]*$", ""), r"\\", "/")).otherwise("")
    title = F.concat("g", F.lit("/ ("), "n", F.lit(")"))
    header = F.concat(F.lit("Directory listing: "), "lines", F.lit(" item(s) across "), "groups", F.lit(" director(ies)"))
    return keep_smaller(texts, assemble(grouped(split_lines(texts, by, text), by, F.when(folder == "", ".").otherwise(folder), title, header, 20, F.col("code")), by, 4 * tokens), by, text)


def _firsts(lines: DataFrame, by: str, key: Column, section: int) -> DataFrame:
    """Parts of the first lines of each key."""
    return lines.groupBy(by, key.alias("__k")).agg(F.min("line").alias("line"), F.min_by("code", "line").alias("code")).select(by, *_part(section, F.col("line"), F.col("code")))


def git_log(texts: DataFrame, by: str, text: str, *, tokens: int = 1200) -> DataFrame:
    """The first 80 different lines."""
    lines = split_lines(texts, by, text)
    header = lines.groupBy(by).agg(F.count("*").alias("n")).select(by, *_part(0, 0, F.concat(F.lit("Git log: "), "n", F.lit(" raw line(s)"))))
    firsts = cap_per_key(_firsts(lines, by, F.col("code"), 1), [by], [F.col("pos")], 80)
    return keep_smaller(texts, assemble(header.union(firsts), by, 4 * tokens), by, text)


def git_diff(texts: DataFrame, by: str, text: str, *, tokens: int = 1200) -> DataFrame:
    """Files, then hunks and changed lines as they are."""
    lines, code = split_lines(texts, by, text), F.col("code")
    named, exact = code.rlike(r"^(?:diff --git|\+\+\+ b/|--- a/)"), code.rlike(r"^(?:diff --git|@@|\+[^+]|-[^-])")
    files = _firsts(lines.where(named), by, code, 1)
    g = lines.groupBy(by).agg(F.countDistinct(F.when(named, code)).alias("f"), F.count_if(exact & code.startswith("+")).alias("a"), F.count_if(exact & code.startswith("-")).alias("r"))
    header = g.select(by, *_part(0, 0, F.concat(F.lit("Git diff: "), "f", F.lit(" file(s); "), "a", F.lit(" additions; "), "r", F.lit(" removals"))))
    return keep_smaller(texts, assemble(header.union(files).union(lines.where(exact).select(by, *_part(2, F.col("line"), code))), by, 4 * tokens), by, text)


def build_output(texts: DataFrame, by: str, text: str, *, tokens: int = 1600) -> DataFrame:
    """Outcome, different errors and warnings, and the last four different signs of the outcome."""
    lines, code = split_lines(texts, by, text), F.col("code")
    bad, warned, ended = code.rlike(FAILURE), code.rlike(WARNING), code.rlike(OUTCOME)
    key = X.signal_key(code)
    g = lines.groupBy(by).agg(
        F.max_by("code", F.when(ended, F.col("line"))).alias("last"), F.count_if(bad).alias("bad"), F.countDistinct(F.when(bad, key)).alias("e"), F.countDistinct(F.when(warned, key)).alias("w"), F.count_if(ended).alias("o"), F.count("*").alias("n"),
    )
    outcome = F.concat(F.lit("Build outcome: "), F.coalesce("last", F.when(F.col("bad") > 0, "failed").otherwise("completed")))
    totals = F.concat(F.lit("Root errors: "), "e", F.lit("; important warnings: "), "w", F.lit("; raw lines: "), "n")
    heads = g.select(by, F.explode(F.array_compact(F.array(
        F.struct(*_part(0, 0, outcome)), F.struct(*_part(0, 1, totals)), F.struct(*_part(0, 2, F.lit("Errors:"))),
        F.when(F.col("w") > 0, F.struct(*_part(2, -1, F.lit("Warnings:")))), F.when(F.col("o") > 0, F.struct(*_part(4, -1, F.lit("Outcome signals:")))),
    ))).alias("p")).select(by, "p.*")
    ends = cap_per_key(_firsts(lines.where(ended), by, code, 5), [by], [F.col("pos").desc()], 4)
    parts = [heads, _firsts(lines.where(bad), by, key, 1), _firsts(lines.where(warned), by, key, 3), ends]
    return keep_smaller(texts, assemble(reduce(DataFrame.union, parts), by, 4 * tokens), by, text)


def generic_output(texts: DataFrame, by: str, text: str, *, tokens: int = 1200) -> DataFrame:
    """The first lines of those that differ in more than numbers, case and blanks."""
    lines = split_lines(texts, by, text).where(F.col("code").rlike(r"\S"))
    return keep_smaller(texts, assemble(_firsts(lines, by, X.signal_key(F.col("code")), 0), by, 4 * tokens), by, text)


def diff_projection(text: Column) -> Column:
    """Files, signals and counts of a diff, then every hunk mark and changed line: nothing that changed is dropped."""
    own = _plain(text)
    return X.let(F.struct(F.split(own, "\n", -1).alias("lines"), F.lower(own).alias("low")), lambda t: X.let(_changed(t["lines"]), lambda c: _projected_diff(t["lines"], t["low"], c)))


def _changed(lines: Column) -> Column:
    return F.filter(lines, lambda x: x.rlike("^[+-]") & ~x.startswith("---") & ~x.startswith("+++"))


def _projected_diff(lines: Column, low: Column, changed: Column) -> Column:
    named = F.transform(F.filter(lines, lambda x: x.startswith("+++ b/") | x.startswith("--- a/")), lambda x: F.trim(F.substring(x, F.lit(7), F.length(x))))
    files = F.array_distinct(F.filter(named, lambda x: (x != "") & (x != "/dev/null")))
    hit = lambda x, p: X.may_match(F.lower(x), p) & _has(x, p)
    at = lambda p: F.when(X.may_match(low, p), F.array_position(F.transform(changed, lambda x: hit(x, p)), True))
    found = F.array(*[F.struct(at(p).alias("at"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, p) in enumerate(DIFF_SIGNALS)])
    signals = F.transform(F.array_sort(F.filter(found, lambda x: x["at"] > 0)), lambda x: x["name"])
    listed = lambda made, none: X.let(made, lambda xs: F.when(F.size(xs) > 0, F.array_join(xs, ", ")).otherwise(none))
    count = lambda c: F.size(F.filter(changed, lambda x: x.startswith(c))).cast("string")
    header = F.array(
        F.concat(F.lit("Changed files: "), listed(files, "none recorded")),
        F.concat(F.lit("Behavioral signals: "), listed(signals, "textual change; inspect exact hunk")),
        F.concat(F.lit("Added lines: "), count("+"), F.lit("; removed lines: "), count("-")),
        F.lit("Exact changed lines below are authoritative evidence; unchanged hunk context may be omitted."),
        F.lit(""),
    )
    return F.array_join(F.concat(header, F.filter(lines, lambda x: x.rlike("^(?:@@|[+-])"))), "\n")


def document_projection(text: Column, tokens: int) -> Column:
    """A document's requirements and literals, all of them, and of its outline what still fits, in order; a document without any stays.

    A line is looked at once, and a pattern tried where the words or signs that it needs occur.
    """
    limit = 4 * tokens
    literal = lambda x: x.rlike("[0-9`]") & _has(x, LITERAL)
    must = lambda x: literal(x) | (X.may_match(F.lower(x), REQUIREMENT) & _has(x, REQUIREMENT))
    line = lambda x: F.struct(x.alias("line"), must(x).alias("must"), x.rlike(OUTLINE).alias("outline"))
    of = lambda marked, keep: F.transform(F.filter(marked, keep), lambda x: x["line"])

    def sorted_out(marked: Column) -> Column:
        outline, chosen = of(marked, lambda x: x["outline"]), F.size(F.filter(marked, lambda x: x["must"] | x["outline"]))
        return F.struct(F.array_distinct(of(marked, lambda x: x["must"])).alias("required"), outline.alias("outline"), chosen.alias("chosen"))

    def step(acc: Column, x: Column) -> Column:
        used = (acc["used"] + quarters(x) + 1).cast("int")
        more = F.concat(acc["text"], F.when(acc["n"] > 0, "\n").otherwise(""), x)
        return F.when(used <= limit, F.struct(used.alias("used"), more.alias("text"), (acc["n"] + 1).alias("n"))).otherwise(acc)

    def reduced(own: Column, s: Column) -> Column:
        weight = F.aggregate(s["required"], F.lit(-1), lambda acc, x: (acc + quarters(x) + 1).cast("int"))
        start = F.struct(weight.alias("used"), F.array_join(s["required"], "\n").alias("text"), F.size(s["required"]).alias("n"))
        mark = lambda acc: F.when(acc["n"] < s["chosen"], F.lit("\n" + PRESERVED)).otherwise("")
        made = F.aggregate(F.array_except(s["outline"], s["required"]), start, step, lambda acc: F.concat(F.trim(acc["text"]), mark(acc)))
        return F.when(s["chosen"] == 0, own).otherwise(made)

    marks = lambda own: F.transform(F.split(own, "\n", -1), line)
    return X.let(_plain(text), lambda own: X.let(X.let(marks(own), sorted_out), lambda s: reduced(own, s)))


def conversation_state(entries: DataFrame, by: str, *, tokens: int = 1200) -> DataFrame:
    """(by, content) of ``entries`` (by, seq, key, text): the texts of a history by section, each once.

    A key decides the section, or else the words of a plain message; sections without any say so.
    """
    key, text = F.regexp_replace(F.lower("key"), "[^a-z]", ""), F.trim("text")
    by_key = F.coalesce(*[F.when(key.rlike(p), HISTORY_SECTIONS.index(s)) for s, p in HISTORY_KEYS])
    by_text = F.when(key.rlike(MESSAGE_KEYS), F.coalesce(*[F.when(_has(text, p), HISTORY_SECTIONS.index(s)) for s, p in HISTORY_TEXTS]))
    rows = entries.select(by, "seq", text.alias("text"), F.coalesce(by_key, by_text).alias("k"))
    found = rows.where("k is not null and text <> ''").groupBy(by, "k", "text").agg(F.min("seq").alias("seq"))
    body = found.select(by, (F.col("k") * 2 + 2).alias("section"), F.col("seq").cast("long").alias("pos"), F.concat(F.lit("- "), "text").alias("text"))
    none = found.groupBy(by).agg(F.collect_set("k").alias("ks"))  # up to eight
    ids = entries.select(by).distinct().join(none, by, "left")
    heads = F.flatten(F.array(*[
        F.array(
            F.struct(F.lit(2 * k + 1).alias("section"), F.lit(0).cast("long").alias("pos"), F.lit(name + ":").alias("text")),
            F.when(~F.coalesce(F.array_contains("ks", k), F.lit(False)), F.struct(F.lit(2 * k + 2).alias("section"), F.lit(0).cast("long").alias("pos"), F.lit("- none recorded in the available history").alias("text"))),
        )
        for k, name in enumerate(HISTORY_SECTIONS)
    ]))
    titled = ids.select(by, F.explode(F.array_compact(heads)).alias("p")).select(by, "p.*")
    first = ids.select(by, *_part(0, 0, F.lit("Durable task work state (derived from retrievable history):")))
    return assemble_marked(first.union(titled).union(body), by, tokens)


def diagnostics(entries: DataFrame, by: str, *, tokens: int = 1200) -> DataFrame:
    """(by, content) of ``entries`` (by, seq, severity, code, path, line, message): one line a code, path and message, gravest first."""
    g = entries.groupBy(by, F.coalesce("code", F.lit("")).alias("code"), F.coalesce("path", F.lit("")).alias("path"), F.trim("message").alias("message"))
    g = g.agg(F.count("*").alias("n"), F.min("seq").alias("seq"), F.min_by("severity", "seq").alias("severity"), F.min_by("line", "seq").alias("line"), F.min_by("message", "seq").alias("shown"))
    s = F.coalesce("severity", F.lit(""))
    rank = F.when(s.rlike("(?i)error|critical|fatal"), 4).when(s.rlike("(?i)warning|warn"), 3).when(s.rlike("(?i)info"), 1).otherwise(2)
    place = F.when(F.col("path") == "", "location unavailable").otherwise(F.concat("path", F.coalesce(F.concat(F.lit(":"), F.col("line") + 1), F.lit(""))))
    text = F.concat(F.lit("- root"), F.when(s != "", F.concat(F.lit(" "), F.upper(s))).otherwise(""), F.when(F.col("code") != "", F.concat(F.lit(" ["), "code", F.lit("]"))).otherwise(""), F.lit(" "), "shown", F.lit(" @ "), place, F.lit("; occurrences="), "n")
    head = g.groupBy(by).agg(F.count("*").alias("u"), F.sum("n").alias("r")).select(by, *_part(0, 0, F.concat(F.lit("Unique failure groups: "), "u", F.lit("; raw records: "), "r")))
    body = g.select(by, (5 - rank).alias("section"), F.col("seq").cast("long").alias("pos"), text.alias("text"))
    return assemble_marked(head.union(body), by, tokens)


def _compacted(value: object) -> object:
    """Important keys, lists and short scalars of objects; long lists as counts, identities and their ends."""
    if isinstance(value, list):
        return [_compacted(x) for x in value]
    if not isinstance(value, dict):
        return value
    long = lambda v: isinstance(v, dict) or not isinstance(v, list) and len(_shown(v)) > 240
    kept = {k: v for k, v in value.items() if IMPORTANT_KEY.search(k) or not long(v)}
    out: dict[str, object] = {}
    for k, v in kept.items():
        if not isinstance(v, list):
            out[k] = _compacted(v)
        elif len(v) > 24:
            out[k] = {"count": len(v), "identifiers": [_identity(x) for x in v], "items": [_compacted(x) for x in [*v[:2], *v[-2:]]]}
        else:
            out[k] = {"count": len(v), "items": [_compacted(x) for x in v]}
    if len(kept) < len(value):
        out["__omittedFields"] = len(value) - len(kept)
        if not any(IMPORTANT_KEY.search(k) for k in value):
            out["__shape"] = list(value)
    return out


def _identity(value: object) -> object:
    if not isinstance(value, dict):
        return value
    return {k: v for k, v in value.items() if IMPORTANT_KEY.search(k) and not isinstance(v, (dict, list))} or "record"


def _projected(value: object, depth: int = 0) -> object:
    """The first 40 keys of objects and 3 items of lists, down to the fourth level."""
    if depth > 3:
        kind = "object" if isinstance(value, dict) or value is None else "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "number"
        return f"[{len(value)} item(s)]" if isinstance(value, list) else kind
    if isinstance(value, list):
        return {"count": len(value), "sample": [_projected(x, depth + 1) for x in value[:3]]}
    return {k: _projected(v, depth + 1) for k, v in list(value.items())[:40]} if isinstance(value, dict) else value


def _shown(value: object) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _value(text: str | None, reduced) -> str:
    """One JSON text reduced, or one with its blanks joined if it isn't JSON."""
    try:
        return _shown_json(reduced(json.loads(text or "")))
    except (ValueError, RecursionError):
        return " ".join((text or "").split())


def _shown_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _reduced(texts: DataFrame, by: str, text: str, how) -> DataFrame:
    ship(texts.sparkSession)
    made = F.pandas_udf(lambda column: column.map(lambda x: _value(x, how)), "string")
    return texts.select(by, made(F.col(text)).alias("content"))


def compact_structures(texts: DataFrame, by: str, text: str) -> DataFrame:
    """(by, content): JSON texts with long lists and unimportant objects cut down; keys and list lengths stay known."""
    return _reduced(texts, by, text, _compacted)


def project_shapes(texts: DataFrame, by: str, text: str) -> DataFrame:
    """(by, content): JSON texts as their shape with samples, four levels deep."""
    return _reduced(texts, by, text, _projected)
