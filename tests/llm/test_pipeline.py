import random

import corpus_pipeline
import public_tokenizers
import pytest

from loomwork.llm import bpe, line_dedup
from tests.llm.data import SCHEMA, documents, texts
from tests.llm.test_line_dedup import brute
from tests.llm.test_simhash import brute_classes

SF = "/root/testdata/sf0.001"


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_classes(rows):
    """Least id of each row's class: pairs of one id, of equal sets or of similarity 0.8 or more."""
    grams = [shingle_set(t) for _, t in rows]

    def near(i, j):
        a, b = grams[i], grams[j]
        return rows[i][0] == rows[j][0] or (5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 9 * len(a & b) >= 4 * (len(a) + len(b)))

    return brute_classes(rows, near)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_shape(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "mixing", "byte-level BPE"]
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_toxicity_keeps_clean_documents(spark, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    clean = [i for i, y in labels.items() if y == 0]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean)


def test_lines(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    got = {r.doc_id: (r.text, r.n_chars) for r in stages[2].collect()}
    assert got == {i: (t, len(t)) for i, t, *_ in brute(rows)}


def test_near_copies_and_mixing_keep_the_rest(stages):
    before, after, mixed = ([r.doc_id for r in df.collect()] for df in stages[2:5])
    assert set(after) <= set(before)
    assert sorted(mixed) == sorted(after) and mixed != after


def test_near_copies_are_the_exact_classes(stages):
    """All pairs by brute force: the smallest id of each class at similarity 0.8 stays, and nothing else."""
    rows = sorted((r.doc_id, r.text) for r in stages[2].collect())
    want = set(near_classes(rows))
    assert sorted(want) == sorted(r.doc_id for r in stages[3].collect())


def test_tokens_decode_to_the_texts(stages):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    codec = bpe.Codec(ranks, public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert codec.decode(r.ids).decode() == texts[r.doc_id] and r.n_tokens == len(r.ids)


def test_run_is_the_stages_in_turn(spark, stages):
    got = sorted((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == sorted((r.doc_id, r.ids) for r in stages[5].collect())


def test_line_stage_is_the_operator(spark, stages):
    assert line_dedup.dedup_lines(stages[1]).where("n_dropped > 0").count() > 0


def labelled(spark, folder, rows):
    """A folder whose labels say that texts with the word "vileword" are toxic."""
    marks = [(i, 0, int("vileword" in (t or ""))) for i, t, _ in rows if i is not None]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_on_nulls_repeats_ties_and_clashing_columns(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, t, ["hot", "hot", "b", None][i % 4]) for i, t in enumerate(texts())]
    rows += [(1000 + i, " ".join(["vileword" if i % 3 == 0 and k == 5 else rng.choice(["calm", "day", "tree", "stone", "river"]) for k in range(12)]) + f" end{i}", "b") for i in range(300)]
    rows += [rows[1], rows[2], (None, rows[2][1], "b"), (None, None, None), (5, "another text under the same id", "hot")]
    docs = documents(spark, rows)
    folder, now = labelled(spark, tmp_path, rows), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = now.collect()
        path = str(tmp_path / name)
        stage(spark, now, folder).write.parquet(path)
        now = spark.read.parquet(path)
        assert now.dtypes == docs.dtypes
        after = now.collect()
        assert {(r.id, r.fp, r.score, r.n_lines, r["__x"]) for r in after} == {(1, 2, 0.5, 3, "x")}  # the input's own columns
        if name == "toxicity":
            assert sorted((r.text for r in before if "vileword" in (r.text or "")), key=str) == sorted((r.text for r in before if r not in after), key=str)
        elif name == "line dedup":
            assert sorted(((r.doc_id, r.text) for r in after), key=str) == sorted(((i, t) for i, t, *_ in brute([(r.doc_id, r.text) for r in before])), key=str)
        elif name == "SimHash near-dedup":
            rows_ = [(r.doc_id, r.text) for r in before if r.doc_id is not None]
            kept = set(near_classes(rows_))
            ids = [r.doc_id for r in after]
            assert kept == {i for i in ids if i is not None} and ids.count(None) == sum(r.doc_id is None for r in before)
        else:
            assert sorted(before, key=str) == sorted(after, key=str)
    encoded = corpus_pipeline.STAGES[-1][1](spark, now, folder)
    assert encoded.columns == ["doc_id", "source", "n_tokens", "ids"] and encoded.count() == now.count()


def test_stages_on_an_empty_table(spark, tmp_path):
    folder = labelled(spark, tmp_path, [(1, "a", "b")])
    now = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, folder)
        assert now.count() == 0 and now.columns == spark.createDataFrame([], SCHEMA).columns
    assert corpus_pipeline.STAGES[-1][1](spark, now, folder).count() == 0
