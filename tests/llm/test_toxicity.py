import random

import numpy as np
import pytest

from loomwork.llm import toxicity
from loomwork.llm.queries import op1_toxicity
from tests.llm.data import SCHEMA, documents

SF = "/root/testdata/sf0.01"


def brute(unary, trans, start):
    t, n = np.exp(np.array(trans)).reshape(2, 2), len(unary)
    e = np.stack([np.ones(n), np.exp(unary)], 1)
    a, b = np.zeros((n, 2)), np.ones((n, 2))
    a[0] = np.array([1, np.exp(start)]) * e[0]
    for i in range(1, n):
        a[i] = (a[i - 1] / a[i - 1].sum() @ t) * e[i]
    for i in range(n - 2, -1, -1):
        b[i] = t @ (e[i + 1] * b[i + 1])
        b[i] /= b[i].sum()
    p = a * b
    return (p / p.sum(1, keepdims=True))[:, 1]


def test_marginals_match_the_chain_by_chain_sum():
    rng = np.random.default_rng(0)
    lengths = [1, 1, 5, 700, 256, 257, 2]
    unary = rng.normal(size=sum(lengths)) * 3
    first = np.zeros(len(unary), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    trans, start = (0.1, -1.0, -0.5, 1.5), -0.3
    got, joint = toxicity.marginals(unary, first, trans, start)
    want = np.concatenate([brute(u, trans, start) for u in np.split(unary, np.cumsum(lengths)[:-1])])
    assert np.abs(got - want).max() < 1e-12
    assert joint.sum() == pytest.approx(sum(n - 1 for n in lengths))


def corpus(n=400):
    rng = random.Random(2)
    plain = ["".join(rng.choice(["ba", "ci", "do", "fe", "gu"]) for _ in range(rng.randint(2, 5))) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(5, 80))
        if i % 4 == 0:
            for _ in range(rng.randint(2, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["Vileloton", "vilelowort", "vilelostum", "vilelokra"]))
        texts.append(" ".join(words))
        labels.append(int(i % 4 == 0))
    return texts, labels


def test_learns_words_and_prefixes_and_finds_spans(spark):
    texts, labels = corpus()
    model = toxicity.fit(texts[:300], labels[:300])
    scores, _ = toxicity.Tagger(model).tag(texts[300:])
    assert sum(int(s >= 0.7) == y for s, y in zip(scores, labels[300:])) >= 95
    docs = documents(spark, [(1, "bacido vilelokra VILELOWOX, docido", "s"), (2, None, "s"), (3, "", "s"), (3, "", "s")])
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert [(s.start, s.end) for s in got[1].spans] == [(7, 16), (17, 26)]
    assert got[2].score == got[3].score < 0.5 and not got[2].spans
    assert toxicity.score(docs, model).columns == [*(c for c in docs.columns if c != "score"), "score", "spans"]
    assert toxicity.reject(docs, model).count() == 3 and toxicity.reject(docs, model).columns == docs.columns
    assert toxicity.score(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_one_class_and_no_labels(spark):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    docs = documents(spark)
    model = toxicity.train(docs, labels)
    assert model.prior is not None and model.prior < 0.7
    assert toxicity.reject(docs, model).count() == docs.count()
    none = toxicity.train(docs, labels.where("false"))
    assert toxicity.score(docs, none).where("score >= 0.7").count() == 0


def test_held_out_accuracy(spark):
    got = op1_toxicity(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in got)
    assert len(got) > 80 and right >= 0.97 * len(got)


def test_long_clean_texts_stay_clean():
    rng = random.Random(3)
    calm = ["calm", "day", "tree", "stone", "river", "quiet", "evening"]
    texts = [" ".join(["vileword" if i % 3 == 0 and k == 5 else rng.choice(calm) for k in range(12)]) + f" end{i}" for i in range(300)]
    model = toxicity.fit(texts, [int("vileword" in t) for t in texts], toxic_share=0.3)
    score = toxicity.Tagger(model).tag(["long line " * 20_000, "a " * 300_000, "calm day vileword tree", "calm vileword " + "day " * 50_000])[0]
    assert (score[:2] < 0.1).all() and (score[2:] >= 0.7).all()


def test_query_is_the_slow_chain_of_its_model(spark):
    """Every score by a step-by-step forward-backward over the document's tokens, one document at a time."""
    from pyspark.sql import functions as F

    from loomwork.llm.queries import held_out

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), use=~held_out(F.col("doc_id")))
    got = {r.doc_id: (r.score, r.predicted) for r in op1_toxicity(spark, sf).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        words = toxicity.TOKEN.findall(text)
        x = np.zeros(5)
        x[0] = 1
        if words and model.prior is None:
            p = brute(np.array([model.bias + sum(model.weights.get(f, 0.0) for f in toxicity.features(w)) for w in words]), model.trans, model.start)
            top = sorted(p)[-2:] if len(p) > 1 else [0.0, p[0]]
            x[1:] = [np.log1p(sum(v for v in p if v >= toxicity._LIKELY)), top[1], top[0], p.mean()]
        want = model.prior if model.prior is not None else 1 / (1 + np.exp(-(x @ np.array(model.logit))))
        assert got[i][0] == pytest.approx(want, abs=1e-4) and got[i][1] == int(got[i][0] >= 0.7)


def test_training_takes_chains_by_parts(monkeypatch):
    """The same marginals, with no more than some tokens' matrices held at once."""
    rng = np.random.default_rng(3)
    lengths = [0, 5, 1, 40, 0, 300, 7, 2]
    first = np.zeros(sum(lengths), dtype=bool)
    at = np.cumsum([0, *lengths[:-1]])
    first[[a for a, n in zip(at, lengths, strict=True) if n]] = True
    unary, ids = rng.normal(size=50), rng.integers(0, 50, size=len(first))
    trans, seen = (0.3, -0.2, 0.1, 0.5), []
    want, pairs = toxicity.marginals(unary[ids], first, trans, -0.4)
    whole = toxicity.marginals
    monkeypatch.setattr(toxicity, "_PART", 10)
    monkeypatch.setattr(toxicity, "marginals", lambda u, *rest: seen.append(len(u)) or whole(u, *rest))
    got, sums = toxicity._by_parts(unary, ids, first, trans, -0.4)
    assert np.allclose(got, want) and np.allclose(sums, pairs) and sum(seen) == len(ids) and len(seen) == 3
