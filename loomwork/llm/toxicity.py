"""Toxic spans by a linear-chain CRF, document scores from its marginals.

Tokens are maximal letter runs; the chain of a document has two states, clean
and toxic. A token's potential is a linear function of its word, prefixes and
suffix; transitions tie neighbours. Token labels for training come from the
document labels: words and prefixes that cover the toxic training documents
and hardly occur in clean ones (greedy multi-cover) tag the tokens of toxic
documents, all tokens of clean documents are clean. Forward-backward marginals
give a document's expected number of toxic tokens (among those of marginal
``_LIKELY`` or more, so that a very long clean text doesn't add up), its two
surest tokens and the share of toxic tokens; a logistic on these is the score. Tokens whose marginal
is at least ``span_at`` are the offending offsets.

Only training uses labels. It reads at most ``per_class`` labelled documents
of each class (smallest id hashes, texts up to ``max_chars``), and of those that
share a label and the eight smallest hashes of their longer words one; scoring
covers every whole text.

Defined results
* null or empty text: scored with no tokens; no spans.
* null labels are ignored; a document labelled twice is toxic if any label is.
* one class missing from training: every score is the smoothed share of toxic labels.
* repeated rows score alike; empty table: empty result; other columns pass
  through, but one named ``score`` or ``spans`` (in any letter case) gives way.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush, nsmallest
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.names import aside, others
from loomwork.session import cut, ship

TOKEN = re.compile(r"[^\W\d_]+")
PREFIXES = (5, 7)
_BLOCK = 256
_CHARS = 1_000_000
_PART = 200_000  # tokens whose marginals are held at once in training
_CACHE = 150_000
_LIKELY = 0.3
_MINIMA = 8  # word hashes that training documents of one label must share to count as copies


def features(word: str) -> list[str]:
    """Feature names of a token; a cased word has those of its lower form."""
    w = word.lower()
    return ["w=" + w, *["p=" + w[:k] for k in PREFIXES if len(w) > k], "s=" + w[-3:]]


def _padded(word: str) -> list[str]:
    """The same number of places for every word: its own name, prefixes ("" if too short) and suffix."""
    return ["w=" + word, *["p=" + word[:k] if len(word) > k else "" for k in PREFIXES], "s=" + word[-3:]]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    trans: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)  # log potentials 00, 01, 10, 11
    start: float = 0.0  # log potential of starting toxic
    logit: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0, 0.0)
    prior: float | None = None  # set if nothing could be trained


def _scan(w: np.ndarray) -> np.ndarray:
    """Toxic share of the normalised forward message at each step of one long chain.

    ``w`` is (n, 2, 2): w[t, i, j] is the weight of going from state i at t-1
    to j at t. Blocks of steps are taken in lockstep: first each block's 2 x 2
    product, then the messages between blocks, then the messages within.
    """
    n = len(w)
    blocks = -(-n // _BLOCK)
    steps = np.empty((_BLOCK, 4, blocks))  # step, entry, block
    column = np.full(blocks * _BLOCK, 0.5)
    for k in range(4):
        column[:n] = w[:, k // 2, k % 2]
        steps[:, k] = column.reshape(blocks, _BLOCK).T
    a, b, c, d = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for x in steps:  # rows of the product: from state 0 and from state 1
        a, b = a * x[0] + b * x[2], a * x[1] + b * x[3]
        c, d = c * x[0] + d * x[2], c * x[1] + d * x[3]
        scale = 1.0 / (a + b + c + d)
        a, b, c, d = a * scale, b * scale, c * scale, d * scale
    into = np.empty(blocks)
    p = 0.0
    for k, (ka, kb, kc, kd) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)):
        into[k] = p
        zero, one = (1 - p) * ka + p * kc, (1 - p) * kb + p * kd
        p = one / (zero + one)
    out = np.empty((_BLOCK, blocks))
    one, zero = into, 1 - into
    for t, x in enumerate(steps):
        zero, one = zero * x[0] + one * x[2], zero * x[1] + one * x[3]
        one = one / (zero + one)
        zero = 1 - one
        out[t] = one
    return out.T.reshape(-1)[:n]


def marginals(unary: np.ndarray, first: np.ndarray, trans: tuple[float, ...], start: float) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of each token, and P(pair of states) summed over all transitions.

    ``first`` marks tokens that begin a chain; chains lie one after another
    and don't touch: entering one has the same weights from either state.
    """
    n = len(unary)
    odds = np.exp(np.clip(unary, -30, 30))
    t = np.exp(np.array(trans)).reshape(2, 2)
    enter = np.array([1.0, math.exp(start)])
    w = np.empty((n, 2, 2))
    w[:] = np.where(first[:, None, None], enter[None, None, :], t[None])
    w[:, :, 1] *= odds[:, None]
    w /= w.sum(axis=(1, 2), keepdims=True)
    alpha = _scan(w)
    back = np.empty((n, 2, 2))
    back[0] = 0.5
    back[1:] = w[:0:-1].transpose(0, 2, 1)
    beta = _scan(back)[::-1]  # the first step maps anything to (1/2, 1/2): the last token's message
    del back
    one, zero = alpha * beta, (1 - alpha) * (1 - beta)
    p = one / (one + zero)
    joint = np.zeros((2, 2))
    for k in range(1, n, 100_000):
        part = slice(k, min(n, k + 100_000))
        before = slice(k - 1, part.stop - 1)
        pair = np.stack([1 - alpha[before], alpha[before]], 1)[:, :, None] * w[part] * np.stack([1 - beta[part], beta[part]], 1)[:, None, :]
        pair = pair[~first[part]]
        joint += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return p, joint


def _by_parts(unary: np.ndarray, ids: np.ndarray, first: np.ndarray, trans: tuple[float, ...], start: float) -> tuple[np.ndarray, np.ndarray]:
    """``marginals`` of the tokens ``ids``, whole chains of some ``_PART`` tokens at a time."""
    p, joint = np.empty(len(ids)), np.zeros((2, 2))
    begins = np.flatnonzero(first)
    a = 0
    while a < len(ids):
        at = np.searchsorted(begins, a + _PART)
        b = int(begins[at]) if at < len(begins) else len(ids)
        p[a:b], own = marginals(unary[ids[a:b]], first[a:b], trans, start)
        joint += own
        a = b
    return p, joint


def _doc_rows(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per document: log1p of expected toxic tokens among likely ones, two surest tokens, share of toxic tokens."""
    out = np.zeros((len(lengths), 4))
    full = np.flatnonzero(lengths)
    if len(full):
        n = lengths[full]
        at = np.cumsum(n) - n
        total, most = np.add.reduceat(np.where(p >= _LIKELY, p, 0.0), at), np.maximum.reduceat(p, at)
        rest, tops = p.copy(), np.flatnonzero(p == np.repeat(most, n))
        _, first = np.unique(np.searchsorted(at, tops, side="right"), return_index=True)
        rest[tops[first]] = 0.0
        out[full] = np.column_stack([np.log1p(total), most, np.maximum.reduceat(rest, at), total / n])
    return out


def _cover(docs: list[np.ndarray], toxic: np.ndarray, of_word: np.ndarray, times: int = 3) -> np.ndarray:
    """Features that cover toxic documents ``times`` times and hardly occur in clean ones.

    ``docs`` hold each document's distinct word ids, a row of ``of_word`` a
    word's features, -1 for none.
    """
    held: dict[int, set[int]] = defaultdict(set)
    clean: Counter[int] = Counter()
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    for i, words in enumerate(docs):
        found = np.unique(of_word[words])
        found = found[found >= 0].tolist()
        if toxic[i]:
            for f in found:
                held[f].add(i)
        else:
            clean.update(found)
    pool = {f: list(d) for f, d in held.items() if len(d) >= 3 and len(d) / n1 >= 8 * (clean[f] + 0.5) / n0}
    held.clear()
    left = np.where(toxic, times, 0)
    chosen: list[int] = []
    least = max(3, 0.003 * n1)
    heap = [(-len(d), f) for f, d in pool.items()]
    heapify(heap)
    while heap:
        # Lazy greedy: gains only fall, so a stale best is recounted before it is taken.
        gain, f = heappop(heap)
        at = pool[f]
        now = int((left[at] > 0).sum())
        if now < least:
            continue
        if now < -gain:
            heappush(heap, (-now, f))
            continue
        chosen.append(f)
        left[at] = np.maximum(0, left[at] - 1)
    return np.array(sorted(chosen), dtype=np.int64)


def fit(texts: list[str], labels: list[int], *, rounds: int = 30, toxic_share: float = 0.1, decay: float = 0.3) -> Model:
    """Train on labelled texts; ``toxic_share`` is the share in the population, for the bias of the score."""
    words: dict[str, int] = {}
    seen: set[tuple[int, ...]] = set()
    tokens: list[np.ndarray] = []
    marks: list[bool] = []
    for text, label in zip(texts, labels, strict=True):  # one of each group of near copies of a label
        own = [w.lower() for w in TOKEN.findall(text)]
        least = nsmallest(_MINIMA, (crc32(w.encode()) for w in set(own) if len(w) >= 7))
        key = (label, *(least if len(least) == _MINIMA else [crc32(text.encode())]))
        if key not in seen:
            seen.add(key)
            tokens.append(np.array([words.setdefault(w, len(words)) for w in own], dtype=np.int32))
            marks.append(label == 1)
    toxic = np.array(marks, dtype=bool)
    if toxic.all() or not toxic.any():
        return Model(prior=(sum(labels) + 0.5) / (len(labels) + 1) if labels else 0.0)
    distinct = [np.unique(t) for t in tokens]
    listed = list(words)
    hashed = np.array([[crc32(f.encode()) << 3 | k for k, f in enumerate(_padded(w))] for w in listed], dtype=np.int64)
    _, of_word = np.unique(hashed, return_inverse=True)
    of_word = of_word.reshape(hashed.shape)
    del hashed
    support = np.zeros(int(of_word.max()) + 1, dtype=np.int64)
    for t in distinct:
        support[np.unique(of_word[t])] += 1
    # Features of too few documents are none; the others are numbered anew.
    used = np.flatnonzero(support >= 3)
    place = np.full(len(support), -1)
    place[used] = np.arange(len(used))
    of_word = place[of_word]
    of_word[np.array([[not f for f in _padded(w)] for w in listed])] = -1
    lexicon = _cover(distinct, toxic, of_word[:, :-1])  # not the suffix
    del distinct

    ids = np.concatenate(tokens).astype(np.int64)
    lengths = np.array([len(t) for t in tokens])
    of_doc = np.repeat(np.arange(len(tokens)), lengths)
    marked = np.isin(of_word[:, :-1], lexicon).any(axis=1)
    y = marked[ids] & toxic[of_doc]
    first = np.zeros(len(ids), dtype=bool)
    first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True

    wi, slot = np.nonzero(of_word >= 0)
    fi = of_word[wi, slot]
    _, at = np.unique(fi, return_index=True)
    names = {_padded(listed[w])[k]: f for w, k, f in zip(wi[at].tolist(), slot[at].tolist(), fi[at].tolist(), strict=True)}
    del of_word, tokens, listed

    state = np.concatenate([[y[:-1] * 2 + y[1:]]]).reshape(-1)[~first[1:]]
    gold = np.bincount(state, minlength=4).reshape(2, 2)
    gold_word = np.bincount(ids, weights=y, minlength=len(words))
    k = len(used)
    theta = np.zeros(k + 6)  # weights, bias, transitions, start
    theta[k] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    square = np.full(k + 6, 1e-8)
    for _ in range(rounds):  # Adagrad on the conditional likelihood
        unary = theta[k] + np.bincount(wi, weights=theta[fi], minlength=len(words))
        p, joint = _by_parts(unary, ids, first, tuple(theta[k + 1 : k + 5]), theta[k + 5])
        over = gold_word - np.bincount(ids, weights=p, minlength=len(words))
        grad = np.concatenate([np.bincount(fi, weights=over[wi], minlength=k), [over.sum()], (gold - joint).reshape(-1), [(y[first] - p[first]).sum()]])
        grad[:k] -= decay * theta[:k]
        square += grad**2
        theta += 0.6 * grad / np.sqrt(square)
    unary = theta[k] + np.bincount(wi, weights=theta[fi], minlength=len(words))
    model = Model({f: float(theta[i]) for f, i in names.items() if abs(theta[i]) > 1e-3}, float(theta[k]), tuple(map(float, theta[k + 1 : k + 5])), float(theta[k + 5]))
    p, _ = _by_parts(unary, ids, first, model.trans, model.start)
    x = np.column_stack([np.ones(len(lengths)), _doc_rows(p, lengths)])
    weight = np.where(toxic, toxic_share / toxic.sum(), (1 - toxic_share) / (~toxic).sum()) * len(toxic)
    beta = np.zeros(5)
    for _ in range(40):  # damped Newton with a ridge
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (weight * (toxic - q)) - 0.05 * beta
        h = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(5)
        beta = beta + 0.7 * np.linalg.solve(h, g)
    model.logit = tuple(map(float, beta))
    return model


class Tagger:
    """A model with a bounded cache of words' potentials."""

    def __init__(self, model: Model):
        self.model, self.cache = model, {}

    def potentials(self, words: list[str]) -> np.ndarray:
        cache, weights = self.cache, self.model.weights
        here = set(words)
        new = here.difference(cache)
        if len(cache) + len(new) > _CACHE:
            kept = {w: cache[w] for w in here if w in cache}
            cache.clear()
            cache.update(kept)
        for w in new:
            cache[w] = self.model.bias + sum(weights.get(f, 0.0) for f in features(w))
        return np.fromiter(map(cache.__getitem__, words), dtype=float, count=len(words))

    def tag(self, texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Scores of the texts, and the marginals of each text's tokens."""
        m = self.model
        if m.prior is not None:
            return np.full(len(texts), m.prior), [np.zeros(0)] * len(texts)
        parts, lengths = [], []
        for x in texts:
            words = TOKEN.findall(x)
            lengths.append(len(words))
            parts.append(self.potentials(words))
        n = np.array(lengths)
        unary = np.concatenate(parts) if parts else np.zeros(0)
        p = np.zeros(0)
        if len(unary):
            first = np.zeros(len(unary), dtype=bool)
            first[(np.cumsum(n) - n)[n > 0]] = True
            p, _ = marginals(unary, first, m.trans, m.start)
        x = np.column_stack([np.ones(len(n)), _doc_rows(p, n)])
        score = 1 / (1 + np.exp(-np.clip(x @ np.array(m.logit), -30, 30)))
        return score, np.split(p, np.cumsum(n)[:-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, use: Column | None = None, per_class: int = 1500, max_chars: int = 20_000) -> Model:
    """Fit on a bounded sample of the labelled rows for which ``use`` (over ``id_col``) holds."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("__lw_y"))
    short = docs.where(F.char_length(F.coalesce(text_col, F.lit(""))) <= max_chars).select(id_col)
    known = known.where(use if use is not None else F.lit(True)).join(short, id_col, "left_semi").select(F.col(id_col).alias("__lw_i"), F.least(F.col("__lw_y"), F.lit(1)).cast("int").alias("__lw_y"))
    known = cut(known)  # ids and labels only; counted and ranked without another scan
    counts = {r["__lw_y"]: r["count"] for r in known.groupBy("__lw_y").count().collect()}
    order = [F.xxhash64("__lw_i"), F.col("__lw_i")]
    chosen = known.where("__lw_y = 1").orderBy(*order).limit(per_class).union(known.where("__lw_y = 0").orderBy(*order).limit(per_class))
    # At most 2 * per_class ids are broadcast.
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), F.col(id_col) == F.col("__lw_i"))
    rows = rows.where(F.char_length(F.coalesce(text_col, F.lit(""))) <= max_chars)
    got = sorted((r[0], r[1] or "", r[2]) for r in rows.select("__lw_i", text_col, "__lw_y").collect())
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit([t for _, t, _ in got], [y for _, _, y in got], toxic_share=min(0.95, max(0.02, share)))


def score(docs: DataFrame, model: Model, text_col: str = "text", *, span_at: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with ``score`` and ``spans``, the offsets [start, end) of toxic tokens."""
    keep = others(docs.columns if keep is None else keep, "score", "spans")
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())]))
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("score", T.DoubleType()), T.StructField("spans", span)])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tagger(shared.value)
        for batch in batches:
            column = batch.column(len(keep))
            at = 0
            while at < len(column):
                texts, size = [], 0
                while at + len(texts) < len(column) and (not texts or size < _CHARS):
                    texts.append(column[at + len(texts)].as_py() or "")
                    size += len(texts[-1])
                scores, found = own.tag(texts)
                spans = []
                for text, p in zip(texts, found, strict=True):
                    hot = set(np.flatnonzero(p >= span_at).tolist())
                    spans.append([{"start": m.start(), "end": m.end(), "p": float(p[k])} for k, m in enumerate(TOKEN.finditer(text)) if k in hot] if hot else [])
                kept = [batch.column(i).slice(at, len(texts)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64()), pa.array(spans, kind)], names=schema.names)
                at += len(texts)

    return docs.select(*keep, F.col(text_col).alias("__lw_text")).mapInArrow(each, schema)


def reject(docs: DataFrame, model: Model, text_col: str = "text", *, threshold: float = 0.7) -> DataFrame:
    """``docs`` less the documents whose score reaches ``threshold``; all columns stay as they are."""
    return aside(docs, lambda rows, named: score(rows, model, named[text_col]).where(F.col("score") < threshold))
