import random
from zlib import crc32

import numpy as np
import pytest

from loomwork.llm import quality
from loomwork.llm.queries import op12_quality
from tests.llm.data import SCHEMA, documents
from tests.llm.test_toxicity import brute

SF = "/root/testdata/sf0.01"


def corpus(n=300):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ba", "ci", "do", "fe", "gu"]) for _ in range(rng.randint(1, 4)))
    good = lambda: " ".join(word() for _ in range(rng.randint(4, 20))).capitalize() + "."
    bad = lambda: rng.choice([lambda: " ".join(word().upper() + "!!" for _ in range(9)), lambda: " ".join([word()] * 30), lambda: " | ".join(word() for _ in range(12)) + " |"])()
    texts, labels = [], []
    for i in range(n):
        lines = [good() for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            lines = lines[:2] + [bad() for _ in range(rng.randint(2, 6))] + lines[2:3]
        texts.append("\n".join(lines))
        labels.append(int(i % 3 != 0))
    return texts, labels


def test_line_numbers_match_a_plain_count():
    texts = ["Ab cd!! cd!!\n\n| x 12 \U0001f600\nAb cd!! cd!!", "", "éÉ ß_ -- a-b.\n\t\n", "日本 日本\x0b日本"]
    lines = [x.split("\n") for x in texts]
    got = quality.line_numbers([y for x in lines for y in x], np.array([len(x) for x in lines]))
    want = []
    for x in lines:
        for k, line in enumerate(x):
            words, row = line.split(), [len(line)]
            n, chars = max(1, len(words)), sum(map(len, words))
            row += [len(words), chars / n, sum(c.isupper() for c in line) / max(1, sum(c.isalpha() for c in line))]
            row += [sum(not (c.isalnum() or c.isspace() or c == "_") for c in line) / max(1, chars), sum(c.isdecimal() for c in line) / max(1, chars)]
            row += [sum(len(w) > 1 and not w[-2:].isalnum() for w in words) / n, sum(not any(c.isalnum() for c in w[:2]) for w in words) / n]
            near = {w.lower() for y in x[max(0, k - quality._NEAR) : k] for w in y.split()}
            own = {w.lower() for w in words}
            row += [sum(a == b for a, b in zip(words, words[1:])) / n, len(own & near) / max(1, len(own)), bool(words) and line in x[:k]]
            want.append(row)
    assert np.abs(got - np.array(want, dtype=float)).max() < 1e-12


def test_scores_are_the_weighted_marginals_of_each_chain():
    texts, labels = corpus()
    model = quality.fit(texts, labels)
    some = [*texts[:20], "", "\n\n", "one", "A B C " * 5_000, "line\n" * 3_000]
    score, share, n_bad = quality.judge(some, model)
    for k, text in enumerate(some):
        feats, _, lengths = quality.observed([text.split("\n")])
        p = brute(model.bias + model.weights[feats].sum(axis=1), model.trans, model.start)
        assert share[k] == pytest.approx((p * lengths).sum() / lengths.sum(), abs=1e-9) and n_bad[k] == (p >= 0.5).sum()
        assert score[k] == pytest.approx(1 / (1 + np.exp(-(model.logit[0] + model.logit[1] * share[k]))), abs=1e-9)


def test_learns_bad_lines_from_labels_of_documents():
    texts, labels = corpus()
    model = quality.fit(texts[:200], labels[:200])
    score, _, n_bad = quality.judge(texts[200:], model)
    assert sum(int(s >= 0.3) == y for s, y in zip(score, labels[200:])) >= 98
    good = "Bacido fegu do.\nGudo ba cifegu baba do."
    mixed = "Bacido fegu do.\nBA!! CIDO!! FEGU!! DO!! BA!! CIDO!!\nCI!! DODO!! FE!! GUGU!! DO!! BACI!!\nGudo ba cifegu baba do."
    _, share, n = quality.judge([good, mixed], model)
    assert n[0] == 0 and n[1] >= 2 and share[1] > 0.5 > share[0]


def test_neighbours_matter():
    texts, labels = corpus()
    model = quality.fit(texts, labels)
    line, bad = "Bacido fegu do ci.", " ".join(["DOCI!!"] * 9)
    alone = quality.judge([f"{line}\n{line}\n{line}"], model)[1][0]
    beside = quality.judge([f"{bad}\n{line}\n{bad}"], model)
    assert beside[1][0] > alone and beside[2][0] >= 2


def test_odd_rows_empty_tables_and_one_class(spark):
    texts, labels = corpus(60)
    model = quality.fit(texts, labels)
    docs = documents(spark)
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and np.isfinite(r.score) for r in rows)
    assert len({r.score for r in rows if not r.text}) == 1
    assert quality.score(docs, model).columns == [c for c in docs.columns if c != "score"] + ["score", "bad_share", "n_bad"]
    assert quality.score(spark.createDataFrame([], SCHEMA), model).count() == 0
    one = quality.fit(["a", "b"], [1, 1])
    assert one.prior == pytest.approx(2.5 / 3) and quality.judge(["x", ""], one)[0].tolist() == [one.prior] * 2
    assert quality.fit([], []).prior == 0.5
    labelled = spark.createDataFrame([(i, y) for i, y in enumerate([1, 0, None, 1, 0] * 8)] + [(None, 1), (3, 0)], "doc_id long, quality int")
    assert quality.train(docs, labelled).prior is None
    assert quality.train(docs, labelled.where("quality = 1")).prior > 0.9 and quality.train(docs.limit(0), labelled).prior == 0.5


def test_query_on_held_out_labels(spark):
    rows = op12_quality(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality is not None}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(labels[r.doc_id], r) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [r for y, r in held if y == 1], [r for y, r in held if y == 0]
    assert sum(r.predicted for r in good) >= 0.97 * len(good)
    above = sum((a.score > b.score) + (a.score == b.score) / 2 for a in good for b in bad) / (len(good) * len(bad))
    assert above >= 0.98
