"""Secret scans: candidates in texts, told apart by how widely the corpus owns them.

The base rules (see ``BASE``) find assignments, access keys and long hex runs.
Long mixed tokens are further candidates. Every candidate's hash is counted
over distinct repositories (documents) and owners (sources): values that many
owners hold, or many repositories of one owner, are examples that have been
copied; a random-looking value of few repositories of one owner is taken for a
live credential. Distinct (hash, repository) and (hash, owner) are counted, and
combined before the shuffle, so a value that a third of the rows holds is no
hot key.

Defined results
* null text counts as empty: no spans. Offsets are code points, end exclusive.
* null owners and null ids each count as one owner and one repository.
* base spans always stay; the method adds ``live`` spans for owner-specific tokens.
* repeated rows are repeated in the result and don't raise the counts; a
  repository under several owners counts once.
* empty table: empty result; other columns pass through, but one named like an
  output (``found`` or ``spans``, in any letter case) gives way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.names import others
from loomwork.session import cut, ship

#: Kind, pattern, group whose length counts, its least length; in order of kind.
BASE = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
]
KINDS = [*(k for k, _, _, _ in BASE), "live"]
_HINTS = ("pass", "secret", "token", "api")
_ASSIGN = re.compile(BASE[0][1], re.ASCII | re.IGNORECASE)
# A run of fewer than the least length fails, and so does each of its parts: the same matches, faster.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.int64()), ("bits", pa.float64())]))
_KIND = "array<struct<kind:int,start:int,end:int,hash:bigint,bits:double>>"


def entropy(value: str) -> float:
    """Bits a character of the value's own letter frequencies."""
    n = len(value)
    return -sum(c / n * log2(c / n) for c in map(value.count, set(value))) if n else 0.0


def candidates(text: str) -> list[dict]:
    """Base spans and random-looking tokens; the hash is of the secret's value."""
    found: list[tuple[int, int, int, str]] = []
    lower = text.lower()
    if any(h in lower for h in _HINTS):
        found += [(0, *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(1, *m.span(), m[0]) for m in _ACCESS.finditer(text)]
    found += [(2, *m.span(), m[0]) for m in _HEX.finditer(text)]
    for m in _TOKEN.finditer(text):
        word = m[0]
        if any(c.isdigit() for c in word) and any(c.isalpha() for c in word):
            found.append((3, *m.span(), word))
    return [{"kind": k, "start": a, "end": b, "hash": int.from_bytes(blake2b(v.encode(), digest_size=8).digest(), "little", signed=True), "bits": entropy(v)} for k, a, b, v in sorted(found)]


def scan(docs: DataFrame, text_col: str = "text", *, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``found``, the candidates of each row."""
    keep = others(docs.columns if keep is None else keep, text_col, "found")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([candidates(x.as_py() or "") for x in batch.column(len(keep))], _SPANS)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], made], names=[*keep, "found"])

    schema = T.StructType([*[docs.schema[c] for c in keep], *T._parse_datatype_string(f"found {_KIND}").fields])
    ship(docs.sparkSession)
    return docs.select(*keep, F.col(text_col).alias("__lw_text")).mapInArrow(each, schema)


def ownership(scanned: DataFrame, repo_col: str, owner_col: str) -> DataFrame:
    """(hash, repos, owners): in how many repositories and owners a candidate value occurs."""
    each = scanned.where(F.size("found") > 0).select(F.col(repo_col).alias("r"), F.col(owner_col).alias("o"), F.explode(F.array_distinct(F.transform("found", lambda x: x["hash"]))).alias("hash"))
    # In structs, as a null counts as one.
    return each.groupBy("hash").agg(F.count_distinct(F.struct("r")).alias("repos"), F.count_distinct(F.struct("o")).alias("owners"))


def verdicts(docs: DataFrame, repo_col: str = "doc_id", owner_col: str = "source", text_col: str = "text", *, max_owners: int = 1, max_repos: int = 20, min_bits: float = 3.0) -> DataFrame:
    """Columns of ``docs`` but the text, and ``spans``: kind, start, end, value's owners and repos, ``live``.

    A value is live-looking if at most ``max_owners`` owners and ``max_repos``
    repositories hold it and its letters carry ``min_bits`` bits each. Candidates beyond the base rules stay
    only if they are.
    """
    own = others(docs.columns, text_col, "found", "spans")
    # Fixed by the checkpoint, so the row numbers stay the same in every reading.
    scanned = cut(scan(docs, text_col, keep=own).withColumn("__lw_row", F.monotonically_increasing_id()))
    counts = ownership(scanned, repo_col, owner_col)
    rows = scanned.where(F.size("found") > 0).select("__lw_row", F.explode("found").alias("x")).select("__lw_row", "x.*")
    met = rows.join(counts, "hash").withColumn("live", (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos) & (F.col("bits") >= min_bits))
    met = met.where((F.col("kind") < 3) | F.col("live"))
    spans = met.groupBy("__lw_row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "owners", "repos", "live"))).alias("spans"))
    joined = scanned.drop("found").join(spans, "__lw_row", "left")
    return joined.select(*own, F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"))
