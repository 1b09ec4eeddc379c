import re
from collections import defaultdict
from hashlib import sha256

from loomwork.llm import secrets
from loomwork.llm.queries import op4_secrets
from tests.llm.data import SCHEMA, documents


def brute_base(text):
    text = text or ""
    out = []
    for k, (_, pattern, group, least) in enumerate(secrets.BASE):
        flags = re.IGNORECASE | re.ASCII if k == 0 else 0
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return sorted(out)


ODD = [
    "token:token:abcdefghij", 'API_KEY="0123456789abcdef0123456789abcdef"', "apikey = short", "passwd=  'longenough1'", "AKIA" + "A" * 11, "AKIAAKIA" + "B" * 12, "AKIA" + "C9" * 8 + "x",
    "0" * 31, "0" * 32, "ab" * 40 + "G" + "cd" * 16, "ſecret=abcdefgh9", "toKen=abcdefgh9", "SECRET:=x", "secret : abcdefgh secret : ijklmnop", None, "", "é" * 50 + "password=hunter2hunter2",
]


def test_base_spans_match_the_plain_patterns(spark):
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(ODD)])
    for row in secrets.verdicts(docs).collect():
        got = [(s.start, s.kind, s.end) for s in row.spans if s.kind < 3]
        assert got == brute_base(ODD[row.doc_id])
    for text in ODD:
        assert [(c["start"], c["kind"], c["end"]) for c in sorted(secrets.candidates(text or ""), key=lambda c: (c["start"], c["kind"])) if c["kind"] < 3] == brute_base(text)


def test_ownership_separates_examples_from_live(spark):
    example, live = "EXAMPLEkey1234567890abcd", "q9Xz7Lm2Vt8Rk4Wp1Ys6Bn3"
    rows = [(i, f"token = {example} {i}", f"s{i % 5}") for i in range(300)] + [(1000, f"see {live} here", "s1"), (1001, f"see {live} again", "s1"), (1001, f"see {live} again", "s1")]
    rows += [(2000 + i, "the hot value 8f3k2j4h5g6f7d8s9a0q here", "hot") for i in range(400)]
    got = defaultdict(list)
    for r in secrets.verdicts(documents(spark, rows)).collect():
        got[r.doc_id].append(r)
    span = got[5][0].spans[0]
    assert (span.kind, span.owners, span.repos, span.live) == (0, 5, 300, False) and len(got[5][0].spans) == 1
    span = got[1000][0].spans[0]
    assert (span.kind, span.owners, span.repos, span.live) == (3, 1, 2, True)
    assert len(got[1001]) == 2 and got[2000][0].spans == []  # one owner, copied into 400 repositories


def test_a_repository_of_two_owners_counts_once_and_copies_are_no_live_secret(spark):
    value = "8f3k2j4h5g6f7d8s9a0qZZ"
    two = [(7, f"token = {value}", "a"), (7, f"token = {value}", "b"), (8, f"token = {value}", None), (None, f"token = {value}", None)]
    span = secrets.verdicts(documents(spark, two)).first().spans[0]
    assert (span.repos, span.owners, span.live) == (3, 3, False)
    for n, live in ((20, True), (21, False)):
        rows = [(i, f"token = {value}", "hot") for i in range(n)]
        assert {(r.spans[0].repos, r.spans[0].live) for r in secrets.verdicts(documents(spark, rows)).collect()} == {(n, live)}
    clash = spark.createDataFrame([(1, "x", "s", 1, 2)], "doc_id long, text string, source string, Spans int, FOUND int")
    assert secrets.verdicts(clash).columns == ["doc_id", "source", "spans"]


def test_null_owners_columns_and_empty_table(spark):
    docs = documents(spark)
    got = secrets.verdicts(docs)
    assert got.columns == [*(c for c in docs.columns if c != "text"), "spans"] and got.count() == docs.count()
    assert secrets.verdicts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_digest(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kinds = ["assign", "access", "hex"]
    for r in op4_secrets(spark, sf).collect():
        spans = brute_base(texts[r.doc_id])
        assert r.base_sha256 == sha256(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in spans) for x in range(3)]
