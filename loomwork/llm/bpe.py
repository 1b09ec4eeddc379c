"""Byte-level BPE by merge replay over a local corpus of distinct words.

Texts are cut into words by the tokenizer's pattern; a batch's unseen words
form a corpus of byte symbols. An inverted index maps each mergeable pair to
its positions in all words; merges are replayed in rank order over the whole
index, and only the neighbours of a merged pair are looked at again. The unit
of replay is the batch of a partition, so memory is bounded and no word table
is shuffled; words seen before come from a bounded cache.

Defined results
* null text counts as empty: no ids; its decoded form is empty.
* a word that is itself in the vocabulary takes that id, as the rank files ask.
* ties: the leftmost position of a rank merges first.
* repeated rows, extra columns and empty tables pass through; an input column
  of an output's name (in any letter case) gives way to it.
* a rank table with ranks of 2^24 or more is refused.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from hashlib import blake2b
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from loomwork.llm.names import others
from loomwork.session import ship

_SHIFT = 24  # bits of a rank
_PIECES = 400_000
_CACHE = 300_000
_CHARS = 1_500_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file; read on the driver and sent to tasks (about 1 MB)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Codec:
    """Encoder and decoder of one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if max(ranks.values()) >> _SHIFT:
            raise ValueError(f"ranks must be below 2^{_SHIFT}")
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.vocab = {i: w for w, i in ranks.items()}
        self.left: dict[int, dict[int, int]] = {}
        self.right: dict[int, dict[int, int]] = {}
        for w, i in ranks.items():
            for k in range(1, len(w)):
                if (a := ranks.get(w[:k])) is not None and (b := ranks.get(w[k:])) is not None:
                    self.right.setdefault(a, {})[b] = i
                    self.left.setdefault(b, {})[a] = i
        keys = sorted((a << _SHIFT | b, i) for a, bs in self.right.items() for b, i in bs.items())
        self.keys = np.array([k for k, _ in keys], dtype=np.int64)
        self.made = np.array([i for _, i in keys], dtype=np.int64)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.cache: dict[str, bytes] = {}

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Little-endian int32 ids of each word after every merge, in rank order over all words at once.

        ``pair`` holds the rank of the pair that begins at a position, ``index``
        the positions of each rank. A merge looks only at its two neighbours.
        """
        joined = b"\0".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        first = self.bytes[np.frombuffer(b"\0" + joined + b"\0", dtype=np.uint8)]
        first[0] = -1
        first[ends] = -1  # sentinels around each word
        keys = np.where((first[:-1] >= 0) & (first[1:] >= 0), first[:-1] << _SHIFT | first[1:], -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        ranks = np.where(self.keys[at] == keys, self.made[at], -1)
        index: list[list[int] | None] = [None] * (max(self.vocab) + 1)
        live = np.flatnonzero(ranks >= 0)
        live = live[np.argsort(ranks[live], kind="stable")]
        heap, starts = np.unique(ranks[live], return_index=True)
        heap = heap.tolist()
        for r, spots in zip(heap, np.split(live, starts[1:]), strict=False):
            index[r] = spots.tolist()
        size = len(first)
        sym, pair = first.tolist(), [*ranks.tolist(), -1]
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        none: dict[int, int] = {}
        while heap:
            rank = heappop(heap)
            spots, index[rank] = index[rank], None
            lefts, rights = self.left.get(rank, none).get, self.right.get(rank, none).get
            spots.sort()
            for k, p in enumerate(spots):
                if pair[p] != rank:
                    continue
                q, b = after[p], before[p]
                n = after[q]
                sym[p], sym[q] = rank, -2
                pair[q] = -1
                after[p] = n
                before[n] = p
                pair[b] = x = lefts(sym[b], -1)
                pair[p] = y = rights(sym[n], -1)
                if x >= 0:
                    if index[x] is None:
                        index[x] = [b]
                        heappush(heap, x)
                    else:
                        index[x].append(b)
                if y >= 0:
                    if index[y] is None:
                        index[y] = [p]
                        heappush(heap, y)
                    else:
                        index[y].append(p)
                if -1 < x < rank or -1 < y < rank:  # the new pair goes first
                    if rest := spots[k + 1 :]:
                        index[rank] = rest
                        heappush(heap, rank)
                    break
        done = np.array(sym, dtype="<i4")
        kept = np.cumsum(done >= 0)[ends].tolist()
        flat = done[done >= 0].tobytes()
        return [flat[4 * a : 4 * b] for a, b in zip([0, *kept[:-1]], kept, strict=True)]

    def learn(self, pieces: Iterable[str]) -> None:
        """Put every piece's ids into the cache; when it is full, only words of these pieces stay."""
        cache, here = self.cache, set(pieces)
        new = [w for w in here if w not in cache]
        if not new:
            return
        if len(cache) + len(new) > _CACHE:
            kept = {w: cache[w] for w in here if w in cache}
            cache.clear()
            cache.update(kept)
        hard: list[str] = []
        for w in new:
            r = self.ranks.get(w.encode())
            if r is None:
                hard.append(w)
            else:
                cache[w] = r.to_bytes(4, "little")
        for k in range(0, len(hard), _CACHE):
            some = hard[k : k + _CACHE]
            for w, ids in zip(some, self.replay([w.encode() for w in some]), strict=True):
                cache[w] = ids

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Little-endian int32 ids of each text; words of all texts are replayed together."""
        if sum(map(len, texts)) > 2 * _CHARS:
            return [self.encode_long(x) for x in texts]
        cut = [self.pattern.findall(x) for x in texts]
        self.learn([w for c in cut for w in c])
        get = self.cache.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def encode_long(self, text: str) -> bytes:
        """One text in slices of its words, so that only a slice's words are held at once."""
        found, out = (m.group() for m in self.pattern.finditer(text)), []
        while some := list(islice(found, _PIECES)):
            self.learn(some)
            out.append(b"".join(map(self.cache.__getitem__, some)))
        return b"".join(out)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids))


_CODECS: dict[str, Codec] = {}


def share(spark: SparkSession, ranks: dict[bytes, int], pattern: str) -> Broadcast:
    """(ranks, pattern, digest of both), for ``codec``; a rank table is about 1 MB."""
    digest = blake2b(repr(pattern).encode())
    for w, i in sorted(ranks.items()):
        digest.update(b"%d %d " % (i, len(w)) + w)
    return spark.sparkContext.broadcast((ranks, pattern, digest.hexdigest()))


def codec(shared: Broadcast) -> Codec:
    """The worker's codec for what ``share`` gave; built once a process and vocabulary."""
    ranks, pattern, key = shared.value
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def _groups(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of bounded total length, with their first row."""
    start, held, size = 0, [], 0
    for i, x in enumerate(texts):
        text = x.as_py() or ""
        if held and size + len(text) > _CHARS:
            yield start, held
            start, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield start, held


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", ids_col: str = "ids", *, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (all but the text by default) and ``ids_col`` array<int>."""
    keep = others(docs.columns if keep is None else keep, text_col, ids_col)
    ship(docs.sparkSession)
    shared = share(docs.sparkSession, ranks, pattern)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))])
    names = schema.names

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared)
        for batch in batches:
            for start, texts in _groups(batch.column(len(keep))):
                made = own.encode_many(texts)
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in made])]).astype(np.int32)
                values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(made))])
                ids = pa.ListArray.from_arrays(pa.array(offsets), values)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(start, len(texts)) for i in range(len(keep))], ids], names=names)

    return docs.select(*keep, text_col).mapInArrow(each, schema)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes its ids stand for; null ids decode to no bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast((ranks, "."))
    keep = others(encoded.columns, bytes_col)
    schema = T.StructType([*[encoded.schema[c] for c in keep], T.StructField(bytes_col, T.BinaryType())])
    at = keep.index(ids_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = {i: w for w, i in shared.value[0].items()}
        for batch in batches:
            made = [b"".join(map(vocab.__getitem__, x.values.to_numpy().tolist())) if x.is_valid else b"" for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=schema.names)

    return encoded.select(*keep).mapInArrow(each, schema)


def digests(encoded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row of ``encoded``: id, n_tokens and SHA-256 of the printed ids and of the decoded bytes."""
    from hashlib import sha256

    shared = encoded.sparkSession.sparkContext.broadcast((ranks, "."))
    schema = T.StructType([encoded.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = {i: w for w, i in shared.value[0].items()}
        printed = {i: str(i) for i in vocab}
        for batch in batches:
            n, a, b = [], [], []
            for x in batch.column(1):
                ids = x.values.to_numpy().tolist() if x.is_valid else []
                n.append(len(ids))
                a.append(sha256(",".join(map(printed.__getitem__, ids)).encode()).hexdigest())
                b.append(sha256(b"".join(map(vocab.__getitem__, ids))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=schema.names)

    return encoded.select(id_col, ids_col).mapInArrow(each, schema)
