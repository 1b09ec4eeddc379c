from hashlib import sha256

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwork.llm import bpe
from tests.llm.data import SCHEMA, documents, texts

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
OTHER = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(RANKS, public_tokenizers.PATTERN)


def ids_of(raw):
    return memoryview(raw).cast("i").tolist()


def test_matches_the_library_on_odd_texts():
    some = [x or "" for x in texts()]
    assert [ids_of(x) for x in CODEC.encode_many(some)] == [REFERENCE.encode_ordinary(x) for x in some]
    own = bpe.Codec(OTHER, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=OTHER, special_tokens={})
    assert [ids_of(x) for x in own.encode_many(some)] == [other.encode_ordinary(x) for x in some]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=60), max_size=8))
def test_round_trip_and_reference(some):
    made = [ids_of(x) for x in CODEC.encode_many(some)]
    assert made == [REFERENCE.encode_ordinary(x) for x in some]
    assert [CODEC.decode(x).decode() for x in made] == some


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab", max_size=200))
def test_overlapping_pairs_merge_leftmost_first(text):
    assert ids_of(CODEC.encode_many([text])[0]) == REFERENCE.encode_ordinary(text)


def test_long_texts_are_cut_into_slices_of_words(monkeypatch):
    monkeypatch.setattr(bpe, "_PIECES", 7)
    text = "The quick brown fox, 123 jumps!  over\n\n the lazy dog's " * 20
    assert ids_of(CODEC.encode_long(text)) == REFERENCE.encode_ordinary(text)


def test_full_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(bpe, "_CACHE", 5)
    own = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    some = [x or "" for x in texts()]
    assert [ids_of(x) for x in own.encode_many(some)] == [REFERENCE.encode_ordinary(x) for x in some]


def test_encode_decode_tables(spark):
    docs = documents(spark)
    encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert encoded.columns == [*(c for c in docs.columns if c != "text"), "ids"]
    back = bpe.decode(encoded, RANKS).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted((r.text or "").encode() for r in docs.collect())
    rows = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(encoded, RANKS).collect()), key=str)
    want = []
    for r in docs.collect():
        ids = REFERENCE.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256((r.text or "").encode()).hexdigest()))
    assert rows == sorted(want, key=str)
    assert bpe.encode(spark.createDataFrame([], SCHEMA), RANKS, public_tokenizers.PATTERN).count() == 0


def test_a_codec_is_known_by_its_whole_vocabulary(spark):
    """Two tables of one size with equal starts, which a reused worker must tell apart."""
    swapped = dict(RANKS)
    a, b = list(RANKS)[-2:]
    swapped[a], swapped[b] = RANKS[b], RANKS[a]
    one, two = bpe.share(spark, RANKS, public_tokenizers.PATTERN), bpe.share(spark, swapped, public_tokenizers.PATTERN)
    assert bpe.codec(one) is bpe.codec(one) and bpe.codec(one).ranks[a] != bpe.codec(two).ranks[a]


def test_ranks_beyond_the_index_are_refused():
    with pytest.raises(ValueError):
        bpe.Codec({**{bytes([i]): i for i in range(256)}, b"ab": 1 << 24}, ".")


def test_clashing_columns_give_way(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, IDS string")
    assert bpe.encode(docs, RANKS, public_tokenizers.PATTERN).columns == ["doc_id", "ids"]


def test_query_is_the_library_on_every_document(spark):
    from loomwork.llm.queries import op9_bpe

    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = REFERENCE.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256((r.text or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op9_bpe(spark, sf).collect()} == want
