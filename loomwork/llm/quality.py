"""Document quality from a linear-chain CRF over lines.

A document is the chain of its lines, split at \\n; each line is good or bad.
A line's potential is a linear function of its own features and of those of the
lines before and after it; transitions tie neighbours. Features are of form
only: shares of capitals, marks, digits and blanks, lengths of words and lines,
marks that words begin or end with, the share of words that repeat the word
before them or one of the lines just before, whether the line has been in the
document already, and its place in the text. They hold for scripts and languages alike.

Training knows labels of documents only. All lines of good documents are good;
a bad document has some bad lines, often beside good ones, so its lines are
labelled in rounds: first all are bad, later those that the model of the round
before it finds bad, and always the one most so. Forward-backward marginals of a
document's lines, weighted by their lengths, add up to its share of bad text;
a logistic on that share is the score.

Only training uses labels. It reads at most ``per_class`` labelled documents of
each class (smallest id hashes, texts up to ``max_chars``); scoring covers every
line of every whole text.

Defined results
* null or empty text: one empty line, scored like any other.
* null labels are ignored; a document labelled twice is good if all its labels are.
* one class missing from training: every score is the smoothed share of good labels.
* repeated rows score alike; empty table: empty result; other columns pass
  through, but those named ``score``, ``bad_share`` or ``n_bad`` (in any letter case) give way.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.names import others
from loomwork.llm.toxicity import marginals
from loomwork.session import cut, ship

_CHARS = 1_000_000
_NEAR = 4  # lines before, whose words a line may repeat
_TABLE: np.ndarray | None = None  # made once a process

#: Bounds of the bins that a number is cut into, by feature.
_BINS: dict[str, tuple[float, ...]] = {
    "chars": (1, 8, 20, 40, 80, 160, 320, 640, 1280),
    "words": (1, 2, 4, 8, 16, 32, 64, 128),
    "word_chars": (1, 2, 3, 4, 5, 6, 7, 8, 10, 14, 20),
    "capitals": (0.001, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 0.9),
    "marks": (0.001, 0.01, 0.02, 0.04, 0.08, 0.12, 0.2, 0.3, 0.5),
    "digits": (0.001, 0.02, 0.05, 0.1, 0.2, 0.5),
    "marked": (0.001, 0.03, 0.08, 0.15, 0.25, 0.4, 0.6, 0.8, 0.95),
    "lone": (0.001, 0.03, 0.08, 0.15, 0.25, 0.4, 0.6),
    "twice": (0.001, 0.02, 0.05, 0.1, 0.3, 0.6, 0.9),
    "seen": (0.05, 0.15, 0.3, 0.45, 0.6, 0.75, 0.9, 0.99),
    "again": (0.5,),
}
_OFFSET = dict(zip(_BINS, np.cumsum([0, *[len(b) + 1 for b in _BINS.values()]])[:-1].tolist(), strict=True))
_SIZE = sum(len(b) + 1 for b in _BINS.values())
_EDGE = 3 * _SIZE  # then: first line, last line
_WIDTH = 3 * _SIZE + 2


def _kinds() -> np.ndarray:
    """Bits of every character of the first three planes: blank, letter or digit, capital, letter, digit, mark."""
    table = np.zeros(0x30001, dtype=np.uint8)
    for code in range(0x30000):
        c = chr(code)
        table[code] = c.isspace() | c.isalnum() << 1 | c.isupper() << 2 | c.isalpha() << 3 | c.isdecimal() << 4 | (not (c.isalnum() or c.isspace() or c == "_")) << 5
    return table


def _repeats(lines: list[str], counts: np.ndarray) -> np.ndarray:
    """Shares of words that are the word before them, and that a near line has, and whether the line was there before."""
    out = np.zeros((len(lines), 3))
    at = 0
    for n in counts.tolist():
        near: deque[set[str]] = deque(maxlen=_NEAR)
        before: set[str] = set()
        for k in range(at, at + n):
            line = lines[k]
            words = line.split()
            if words:
                lowered = set(line.lower().split())
                out[k] = sum(map(eq, words, words[1:])) / len(words), len(lowered.intersection(chain.from_iterable(near))) / len(lowered), line in before
                before.add(line)
                near.append(lowered)
        at += n
    return out


def line_numbers(lines: list[str], counts: np.ndarray) -> np.ndarray:
    """A row of numbers a line, in the order of ``_BINS``; ``counts`` are the lines of each document in turn."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _kinds()
    codes = np.frombuffer(("\n".join(lines) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _TABLE[np.minimum(codes, len(_TABLE) - 1)]
    sizes = np.array([len(line) + 1 for line in lines])
    at = np.cumsum(sizes) - sizes
    per_line = lambda flags: np.add.reduceat(flags, at, dtype=np.int64)
    has = lambda bit: (kind >> bit & 1).astype(bool)
    blank, alnum = has(0), has(1)
    after_blank, before_blank = np.roll(blank, 1), np.roll(blank, -1)
    after_blank[0] = True
    begins, ends = ~blank & after_blank, ~blank & before_blank
    words = per_line(begins)
    word, char = np.maximum(1, words), np.maximum(1, per_line(~blank))
    marked = ends & ~after_blank & ~(alnum & np.roll(alnum, 1))
    lone = begins & ~alnum & ~np.roll(alnum, -1)
    return np.column_stack([
        sizes - 1, words, per_line(~blank) / word, per_line(has(2)) / np.maximum(1, per_line(has(3))), per_line(has(5)) / char, per_line(has(4)) / char,
        per_line(marked) / word, per_line(lone) / word, _repeats(lines, counts),
    ])


def places(numbers: np.ndarray) -> np.ndarray:
    """The features that hold, as places in a vector of ``_SIZE``: one bin of every number."""
    return np.column_stack([_OFFSET[name] + np.searchsorted(bounds, numbers[:, k], side="right") for k, (name, bounds) in enumerate(_BINS.items())])


def observed(lines_of: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all lines' features with their neighbours', which lines are first, and their lengths."""
    counts = np.array([len(x) for x in lines_of])
    own = places(line_numbers([line for lines in lines_of for line in lines], counts))
    first = np.zeros(len(own), dtype=bool)
    first[np.cumsum(counts) - counts] = True
    last = np.roll(first, -1)
    none = _WIDTH  # the place of a neighbour that isn't there
    before = np.where(first[:, None], none, np.roll(own, 1, axis=0) + _SIZE)
    after = np.where(last[:, None], none, np.roll(own, -1, axis=0) + 2 * _SIZE)
    edges = np.column_stack([np.where(first, _EDGE, none), np.where(last, _EDGE + 1, none)])
    lengths = np.array([len(line) + 1.0 for lines in lines_of for line in lines])
    return np.column_stack([own, before, after, edges]), first, lengths


@dataclass
class Model:
    weights: np.ndarray | None = None  # of places, the last for none
    bias: float = 0.0
    trans: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)  # log potentials good-good, good-bad, bad-good, bad-bad
    start: float = 0.0
    logit: tuple[float, float] = (0.0, 0.0)
    prior: float | None = None  # set if nothing could be trained


def _bad_share(p: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The share of bad text of each document: its lines' marginals weighted by length."""
    at = np.flatnonzero(first)
    return np.add.reduceat(p * lengths, at) / np.add.reduceat(lengths, at)


def _learn(feats: np.ndarray, first: np.ndarray, bad: np.ndarray, weight: np.ndarray, rounds: int, decay: float) -> Model:
    """Adagrad on the conditional likelihood of the lines' labels; ``weight`` is that of each line."""
    k = _WIDTH + 1
    gold = np.bincount((bad[:-1] * 2 + bad[1:])[~first[1:]], minlength=4).reshape(2, 2)
    theta, square = np.zeros(k + 6), np.full(k + 6, 1e-8)
    for _ in range(rounds):
        unary = theta[k] + theta[:k][feats].sum(axis=1)
        p, joint = marginals(unary, first, tuple(theta[k + 1 : k + 5]), theta[k + 5])
        over = (bad - p) * weight
        grad = np.concatenate([
            np.bincount(feats.ravel(), weights=np.repeat(over, feats.shape[1]), minlength=k),
            [over.sum()], (gold - joint).reshape(-1), [(bad[first] - p[first]).sum()],
        ])
        grad[:k] -= decay * theta[:k]
        grad[_WIDTH] = 0.0
        square += grad**2
        theta += 0.4 * grad / np.sqrt(square)
    return Model(theta[:k].copy(), float(theta[k]), tuple(map(float, theta[k + 1 : k + 5])), float(theta[k + 5]))


def fit(texts: list[str], good: list[int], *, relabel: int = 3, rounds: int = 60, decay: float = 0.5) -> Model:
    """Train on texts and their labels, 1 for good."""
    is_bad = np.array([y != 1 for y in good], dtype=bool)
    if not len(is_bad) or is_bad.all() or not is_bad.any():
        return Model(prior=(float((~is_bad).sum()) + 0.5) / (len(is_bad) + 1))
    feats, first, lengths = observed([t.split("\n") for t in texts])
    doc = np.cumsum(first) - 1
    bad = is_bad[doc]
    # Both classes weigh the same; so do lines of texts with few and with many.
    weight = np.where(is_bad[doc], 1.0, bad.sum() / max(1, (~bad).sum()))
    model = Model()
    for turn in range(relabel):
        model = _learn(feats, first, bad, weight, rounds, decay)
        p, _ = marginals(model.bias + model.weights[feats].sum(axis=1), first, model.trans, model.start)
        if turn < relabel - 1:
            worst = np.maximum.reduceat(p, np.flatnonzero(first))
            bad = is_bad[doc] & ((p >= 0.5) | (p == worst[doc]))
    share = _bad_share(p, first, lengths)
    x = np.column_stack([np.ones(len(share)), share])
    w = np.where(is_bad, 0.5 / is_bad.sum(), 0.5 / (~is_bad).sum()) * len(is_bad)
    beta = np.zeros(2)
    for _ in range(40):  # damped Newton with a ridge
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        g = x.T @ (w * (~is_bad - q)) - 0.05 * beta
        h = (x * (w * q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(2)
        beta = beta + 0.7 * np.linalg.solve(h, g)
    model.logit = (float(beta[0]), float(beta[1]))
    return model


def judge(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, share of bad text and number of bad lines of each text."""
    if model.prior is not None:
        return np.full(len(texts), model.prior), np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
    feats, first, lengths = observed([t.split("\n") for t in texts])
    p, _ = marginals(model.bias + model.weights[feats].sum(axis=1), first, model.trans, model.start)
    share = _bad_share(p, first, lengths)
    z = model.logit[0] + model.logit[1] * share
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), share, np.add.reduceat(p >= 0.5, np.flatnonzero(first), dtype=np.int64)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, use: Column | None = None, per_class: int = 2000, max_chars: int = 20_000) -> Model:
    """Fit on a bounded sample of the labelled rows for which ``use`` (over ``id_col``) holds."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(F.when(F.col(label_col) == 1, 1).otherwise(0)).alias("__lw_y"))
    short = docs.where(F.char_length(F.coalesce(text_col, F.lit(""))) <= max_chars).select(id_col)
    known = known.where(use if use is not None else F.lit(True)).join(short, id_col, "left_semi").select(F.col(id_col).alias("__lw_i"), "__lw_y")
    known = cut(known)  # ids and labels only; both classes are ranked without another scan
    order = [F.xxhash64("__lw_i"), F.col("__lw_i")]
    chosen = known.where("__lw_y = 1").orderBy(*order).limit(per_class).union(known.where("__lw_y = 0").orderBy(*order).limit(per_class))
    # At most 2 * per_class ids are broadcast.
    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), F.col(id_col) == F.col("__lw_i"))
    rows = rows.where(F.char_length(F.coalesce(text_col, F.lit(""))) <= max_chars)
    got = sorted({(r[0], r[1] or "", r[2]) for r in rows.select("__lw_i", text_col, "__lw_y").collect()})
    return fit([t for _, t, _ in got], [y for _, _, y in got])


def score(docs: DataFrame, model: Model, text_col: str = "text", *, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with ``score``, ``bad_share`` (of the text's length) and ``n_bad`` lines."""
    keep = others(docs.columns if keep is None else keep, "score", "bad_share", "n_bad")
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    made = [T.StructField("score", T.DoubleType()), T.StructField("bad_share", T.DoubleType()), T.StructField("n_bad", T.LongType())]
    schema = T.StructType([*[docs.schema[c] for c in keep], *made])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, at = batch.column(len(keep)), 0
            while at < len(column):
                texts, size = [], 0
                while at + len(texts) < len(column) and (not texts or size < _CHARS):
                    texts.append(column[at + len(texts)].as_py() or "")
                    size += len(texts[-1])
                found = [pa.array(x, k) for x, k in zip(judge(texts, shared.value), (pa.float64(), pa.float64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(at, len(texts)) for i in range(len(keep))], *found], names=schema.names)
                at += len(texts)

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__lw_text")).mapInArrow(each, schema)
