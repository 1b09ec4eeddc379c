import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from loomwork.llm import fim
from loomwork.llm.queries import OP11_SQL, op11_fim
from tests.llm.data import SCHEMA, documents

SF = "/root/testdata/sf0.001"


def brute(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(text) + 1), h2 % (len(text) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return "plain", len(text), None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return ("spm", len(text), a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", len(text), a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_matches_python_on_odd_rows(spark):
    texts = [None, "", "a", "<P>", "a<S>b", "<", "<P<S", "S>", "ẹ́" * 50, "\U0001f468‍\U0001f469" * 70, "\r\n\x00x" * 40, "b" * 63, "b" * 64, "b" * 65, "b" * 128, "<M" * 200, "x" * 300_000 + "é" * 300_000]
    rows = [(i, texts[i % len(texts)], "s") for i in range(len(texts) * 12)]
    rows += [rows[5], (None, "null id", "s"), (None, None, None)]
    for docs in (documents(spark, rows), documents(spark)):
        made = fim.transform(docs)
        assert made.columns == [*docs.columns, "form", "n", "prefix_chars", "middle_chars", "output"]
        got = sorted(((r.doc_id, *r[-6:]) for r in made.select("*", fim.restored().alias("back")).collect()), key=repr)
        want = sorted(((r.doc_id, *brute(r.doc_id, r.text), r.text or "") for r in docs.collect()), key=repr)
        assert got == want
    assert {r[1] for r in want} == {"plain", "psm", "spm"}


def test_clashing_names_give_way_and_empty_tables_stay_empty(spark):
    docs = spark.createDataFrame([(1, "abcdef", 7, "x", "y")], "doc_id long, text string, N long, Output string, form string")
    made = fim.transform(docs)
    assert made.columns == ["doc_id", "text", "form", "n", "prefix_chars", "middle_chars", "output"] and made.first().n == 6
    assert fim.transform(documents(spark).limit(0)).count() == 0 and fim.transform(spark.createDataFrame([], SCHEMA)).select(fim.restored()).count() == 0


def test_rates_and_salt(spark):
    docs = documents(spark, [(i, "some text", "s") for i in range(2_000)])
    counts = lambda **k: {r.form: r["count"] for r in fim.transform(docs, **k).groupBy("form").count().collect()}
    usual = counts()
    assert usual["plain"] == pytest.approx(200, abs=60) and usual["spm"] == pytest.approx(360, abs=80)
    assert counts(rate=0) == {"plain": 2_000} and counts(rate=100, spm=100) == {"spm": 2_000} and counts(salt="2") != usual


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = con.execute(OP11_SQL)
    names = [d[0] for d in found.description]
    got = op11_fim(spark, SF)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(found.fetchall())
    assert got.where(F.col("restored_sha256") != F.col("output_sha256")).count() > 0
