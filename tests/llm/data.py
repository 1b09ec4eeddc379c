"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random

SCHEMA = "doc_id long, text string, source string, id long, fp long, score double, n_lines long, __x string"


def texts() -> list:
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ba", "ci", "Do", "é", "ß", "fu"]) for _ in range(rng.randint(1, 4)))
    line = lambda: " ".join(word() for _ in range(rng.randint(1, 14)))
    shared = [line() + " shared line" for _ in range(4)]
    out = ["\n".join(rng.choice(shared) if rng.random() < 0.4 else line() for _ in range(rng.randint(1, 9))) for _ in range(40)]
    out += [None, "", "", "   ", "\n", "\n\n", "\t one \x0b\x0c\r\n ONE TWO THREE four\none two three FOUR \n", "İK ſ K token: abcdefgh12", "a", "a b", "x" * 50_000, "long line " * 20_000]
    out += [out[0], out[0], out[3].upper(), "password = 'hunter22hunter' AKIAABCDEFGHIJKL " + "0a" * 20, '\\</s>[INST] \\\\ [/INST]', "日本語 \U0001f600 \U0001f600", "aaaa" * 30 + " !!!! " + "!" * 90]
    return out


def documents(spark, rows=None):
    """Rows of ``texts`` under ids with a repeat and a null, in few sources with a null."""
    if rows is None:
        rows = [(i, t, ["hot", "hot", "b", None][i % 4]) for i, t in enumerate(texts())]
        rows += [rows[1], (None, rows[2][1], "b"), (None, None, None), (5, "another text under the same id", "hot")]
    return spark.createDataFrame([(i, t, s, 1, 2, 0.5, 3, "x") for i, t, s in rows], SCHEMA)
