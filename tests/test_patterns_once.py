"""Word edges against their general form, and that patterns are tried once a line without Python or joins."""

import random
import re

from loomwork.functions import text as X
from loomwork.operators import asking, budget, compress, extract, quality
from loomwork.plans import registry

SF = "/root/testdata/sf0.001"


def _strings(value):
    if isinstance(value, str):
        return {value}
    if isinstance(value, (list, tuple, set)):
        return {s for v in value for s in _strings(v)}
    return {s for k, v in value.items() for s in _strings(k) | _strings(v)} if isinstance(value, dict) else set()


def test_word_edges_are_those_of_the_general_form():
    given = sorted({s for m in (asking, budget, compress, extract, quality) for k, v in vars(m).items() if not k.startswith("__") for s in _strings(v) if r"\b" in s})
    given += [r"\b(?:a|-b)\b", r"\ba?\b", r"\b\w*x\b", r"(?:a\b|b-\b)c?", r"\bfoo|\bbar", r"x\b(?:\s|$)", r"(?:\bif)+\b", r"[^a]\b[b-d]", r"\b(?:é|a)\b", r"(?:a|b*)\b"]
    draw = random.Random(5)
    letters = ["if", "a", "b", "x", "1", "2", ".", "-", "(", ")", " ", "_", "é", "ß", "foo", "bar", "=", "@", '"', ":", "must", "save", "\n"]
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 14))) for _ in range(150)]
    words = [w for p in given for ws in X.needles(p) for w in ws]
    texts += [draw.choice(["", " ", "é", "_", "1"]) + draw.choice(words) + draw.choice(["", " ", "é", "_", "(", " {"]) + draw.choice(words) for _ in range(250)]
    for p in given:
        try:
            general, short = re.compile(p.replace(r"\b", X._EDGE), re.ASCII), re.compile(X.ascii_edges(p), re.ASCII)
        except re.error:  # only the JVM knows it
            continue
        for t in texts:
            assert [m.span() for m in general.finditer(t)] == [m.span() for m in short.finditer(t)], (p, t)
    assert not [p for p, _, _ in budget.SIGNALS if X._EDGE in X.ascii_edges(p)]


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_documentation_isnt_joined_to_itself(spark):
    assert "Join" not in _plan(registry.queries()["c8_documentation"](spark, SF))


def test_signals_are_tried_once_a_line(spark):
    plan = _plan(registry.queries()["c7_line_scores"](spark, SF))
    assert plan.count("RLIKE") + plan.count("rlike(") <= len(budget.SIGNALS)
    assert plan.lower().count("contains(") > len(budget.SIGNALS)  # words come first


def test_signals_of_a_diff_are_looked_for_once(spark):
    plan = _plan(registry.queries()["c8_diff"](spark, SF))
    assert sum(plan.count(name) for name, _ in compress.DIFF_SIGNALS) and plan.count("array_position") == len(compress.DIFF_SIGNALS)


def test_source_is_compressed_without_python_as_a_fold_in_order(spark):
    draw = random.Random(3)
    kinds = ["if (x) {", "return y", "call(3)", "plain words", "user name", "", "value 7", "é wide ß line (a)", "f(user) and some more words", "longer plain text that nobody needs"]
    texts = {f"p{k}": [draw.choice(kinds[draw.choice([0, 2]) :]) + " " * draw.randint(0, 9) for _ in range(draw.randint(1, 30))] for k in range(40)}
    src = spark.createDataFrame([(p, "typescript", "\n".join(ls)) for p, ls in texts.items()], "path string, lang string, text string")
    made = budget.compress_source(extract.lines(src), ["user"], 40)
    assert "InPandas" not in _plan(made)
    got = {(r.path, r.line) for r in made.collect()}
    want = set()
    for path, ls in texts.items():
        hit = [[bool(re.search(p.replace(r"\b", X._EDGE), c)) for p, _, _ in budget.SIGNALS] for c in ls]
        score = [sum(w for h, (_, _, w) in zip(hs, budget.SIGNALS, strict=True) if h) + 8 * ("user" in c.lower()) for hs, c in zip(hit, ls, strict=True)]
        must = [any(h for h, (_, label, _) in zip(hs, budget.SIGNALS, strict=True) if label not in ("call", "literal")) for hs in hit]
        cost = [max(1, -(-sum(1 if ord(x) < 128 else 2 for x in c) // 4)) for c in ls]
        near = [any(score[j] > 0 for j in (k - 1, k, k + 1) if 0 <= j < len(ls)) for k in range(len(ls))]
        left = 40 - sum(c for c, m in zip(cost, must, strict=True) if m)
        want |= {(path, k + 1) for k, m in enumerate(must) if m}
        for k in sorted((k for k in range(len(ls)) if near[k] and not must[k]), key=lambda k: (-score[k], k)):
            if cost[k] <= left:
                left -= cost[k]
                want.add((path, k + 1))
    assert got == want
