"""Compressors against plain Python, on odd texts."""

import json
import random
import re

import pytest

from loomwork.operators import compress as Z

WORDS = ["must", "x1", "alpha", "- item", "# Head", "`code`", "error", "É", "shall", "plain", "7.5", "  1) two", "don't"]


def texts(seed, n=40):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 7)))
    out = ["\n".join(line() for _ in range(rng.randint(1, 40))) for _ in range(n)]
    return [*out, None, "", "\n", "\r\n\r\n", "plain", "a\r\nb", "x" * 5_000, "must " * 900, "é" * 3_000]


def run(spark, f, seed=0):
    rows = list(enumerate(texts(seed)))
    df = spark.createDataFrame(rows, "id int, text string")
    return {r.id: r for r in f(df).collect()}, {k: (t or "").replace("\r\n", "\n") for k, t in rows}


def quarters(t):
    return sum(1 if ord(c) < 128 else 2 for c in t)


def document(text, tokens):
    lines = text.split("\n")
    ascii_ = re.ASCII
    must = lambda x: re.search(Z.REQUIREMENT, x, ascii_) or re.search(Z.LITERAL, x, ascii_)
    outline = lambda x: re.search(Z.OUTLINE, x, ascii_)
    chosen = [x for x in lines if must(x) or outline(x)]
    if not chosen:
        return text
    out = list(dict.fromkeys(x for x in lines if must(x)))
    for x in chosen:
        if x not in out and quarters("\n".join([*out, x])) <= 4 * tokens:
            out.append(x)
    return "\n".join(out).strip(" ") + ("\n" + Z.PRESERVED if len(out) < len(chosen) else "")


@pytest.mark.parametrize("tokens", [0, 12, 60, 10_000])
def test_documents_keep_their_requirements(spark, tokens):
    got, own = run(spark, lambda df: df.select("id", Z.document_projection(df.text, tokens).alias("content")))
    assert {k: r.content for k, r in got.items()} == {k: document(t, tokens) for k, t in own.items()}


def fit(lines, limit):
    out = []
    for x in lines:
        if out and len("\n".join([*out, x])) > limit:
            break
        out.append(x)
    return "\n".join(out)


def groups(lines, key):
    out = {}
    for x in lines:
        out.setdefault(key(x), []).append(x)
    return out


def firsts(lines, key):
    out = {}
    for x in lines:
        out.setdefault(key(x), x)
    return list(out.values())


norm = lambda x: re.sub(r"[ \t\r\n]+", " ", re.sub("[0-9]+", "#", x)).lower().strip(" ")


def status(lines):
    g = groups(lines, lambda x: x[:2])
    return [f"Git status: {len(lines)} changed path(s)", *[f"{k}: {len(v)} path(s)\n" + "\n".join(v[:40]) for k, v in g.items()]]


def folders(lines):
    g = groups(lines, lambda x: "/".join(re.split(r"[\\/]", x)[:-1]) or ".")
    return [f"Directory listing: {len(lines)} item(s) across {len(g)} director(ies)", *[f"{k}/ ({len(v)})\n" + "\n".join(list(dict.fromkeys(v))[:20]) for k, v in g.items()]]


def log(lines):
    return [f"Git log: {len(lines)} raw line(s)", *list(dict.fromkeys(lines))[:80]]


def build(lines):
    bad, warned, ended = ([x for x in lines if re.search(p, x, re.ASCII)] for p in (Z.FAILURE, Z.WARNING, Z.OUTCOME))
    e, w = firsts(bad, norm), firsts(warned, norm)
    last = ended[-1] if ended else "failed" if bad else "completed"
    out = [f"Build outcome: {last}", f"Root errors: {len(e)}; important warnings: {len(w)}; raw lines: {len(lines)}", "Errors:", *e]
    return out + (["Warnings:", *w] if w else []) + (["Outcome signals:", *list(dict.fromkeys(ended))[-4:]] if ended else [])


@pytest.mark.parametrize(("made", "want"), [(Z.git_status, status), (Z.directory_output, folders), (Z.git_log, log), (Z.build_output, build), (Z.generic_output, lambda ls: firsts([x for x in ls if x.strip()], norm))])
@pytest.mark.parametrize("tokens", [5, 40, 1200])
def test_tool_output_is_grouped_and_fits_and_is_never_longer(spark, made, want, tokens):
    got, own = run(spark, lambda df: made(df, "id", "text", tokens=tokens), seed=3)
    assert set(got) == set(own)
    for k, text in own.items():
        lines = [x for x in text.split("\n") if x]
        reduced = fit(want(lines), 4 * tokens) if lines else text
        shorter = len(reduced.encode()) < len(text.encode())
        assert (got[k].content, got[k].derived) == ((reduced, True) if shorter else (text, False)), (k, text)


def test_diffs_lose_no_changed_line(spark):
    diff = "diff --git a/x b/x\n--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-import a\n+if save(1):\n ctx\n+++ b//dev/null\n+\n"
    df = spark.createDataFrame([(1, diff), (2, ""), (3, None)], "id int, text string")
    got = {r.id: r.c.split("\n") for r in df.select("id", Z.diff_projection(df.text).alias("c")).collect()}
    assert got[1][:3] == ["Changed files: x.py", "Behavioral signals: API/symbol, control flow, side effect", "Added lines: 2; removed lines: 1"]
    assert [x for x in diff.split("\n") if x[:1] in "+-@" and x] == got[1][5:]
    assert got[2] == got[3] and got[2][0] == "Changed files: none recorded"


def test_histories_go_by_key_then_by_words_and_are_bounded(spark):
    rows = [(1, 0, "currentGoals", "?"), (1, 1, "goal", " ship it "), (1, 2, "message", "it failed"), (1, 3, "message", "no idea"), (1, 4, "Accepted_Decision", "use spark"), (1, 5, "goal", "ship it"), (2, 0, "other", "x"), (3, 0, "goal", None)]
    df = spark.createDataFrame(rows, "id int, seq int, key string, text string")
    got = {r.id: r.content.split("\n") for r in Z.conversation_state(df, "id").collect()}
    assert got[1][:3] == ["Durable task work state (derived from retrievable history):", "goal:", "- ship it"] and got[1][got[1].index("blockers:") + 1] == "- it failed" and got[1][got[1].index("decisions:") + 1] == "- use spark"
    assert got[2].count("- none recorded in the available history") == len(Z.HISTORY_SECTIONS) and got[2] == got[3]
    for tokens in (1, 25, 60):
        for r in Z.conversation_state(df, "id", tokens=tokens).collect():
            assert quarters(r.content) <= 4 * tokens and (r.content.endswith(Z.BOUNDED) or got[2][0].startswith(r.content) or Z.BOUNDED.startswith(r.content))


def test_structures(spark):
    value = {"id": 1, "blob": {"a": 1}, "long": "x" * 300, "name_of": {"id": 2, "z": {"deep": [1]}}, "rows": [{"id": k, "b": {"c": k}} for k in range(30)], "few": [1, {"q": {"w": 1}}], "n": None}
    rows = [(1, json.dumps(value)), (2, "no  json\n here"), (3, None), (4, "[1, [2]]"), (5, '{"a": {"b": {"c": {"d": {"e": 1}, "f": [1]}}}}'), (6, "[" * 9_000)]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: r.content for r in Z.compact_structures(df, "id", "text").collect()}
    first = json.loads(got[1])
    assert set(first) == {"id", "name_of", "rows", "few", "n", "__omittedFields"} and first["__omittedFields"] == 2 and first["name_of"] == {"id": 2, "__omittedFields": 1}
    assert first["rows"]["count"] == 30 and first["rows"]["identifiers"] == [{"id": k} for k in range(30)] and [x["id"] for x in first["rows"]["items"]] == [0, 1, 28, 29]
    assert first["few"] == {"count": 2, "items": [1, {"__omittedFields": 1, "__shape": ["q"]}]}
    assert got[2] == "no json here" and got[3] == "" and got[4] == "[1,[2]]" and got[6] == "[" * 9_000
    shapes = {r.id: r.content for r in Z.project_shapes(df, "id", "text").collect()}
    assert json.loads(shapes[5]) == {"a": {"b": {"c": {"d": "object", "f": "[1 item(s)]"}}}} and json.loads(shapes[1])["rows"]["count"] == 30 and len(json.loads(shapes[1])["rows"]["sample"]) == 3


def test_diagnostics_come_gravest_first(spark):
    rows = [(1, 1, "info", None, None, None, "note"), (1, 2, "Warning", "W1", "f.py", 3, "careful"), (1, 3, "error", "E1", "f.py", None, "bad"), (1, 4, "error", "E1", "f.py", 9, "bad "), (1, 5, None, None, None, None, "odd")]
    df = spark.createDataFrame(rows, "id int, seq int, severity string, code string, path string, line int, message string")
    assert Z.diagnostics(df, "id").first().content.split("\n") == [
        "Unique failure groups: 4; raw records: 5", "- root ERROR [E1] bad @ f.py; occurrences=2", "- root WARNING [W1] careful @ f.py:4; occurrences=1", "- root odd @ location unavailable; occurrences=1", "- root INFO note @ location unavailable; occurrences=1",
    ]
