"""Chat formatting by token-level assembly.

Each turn's text is encoded on its own, so no token crosses a segment and no
content yields a reserved id; the template's marks are spliced in as reserved
ids beyond the vocabulary. The loss mask is the prefix sum of +1 at an
assistant text's first token and -1 after its last. Control strings inside
texts are broken up by a backslash (and backslashes doubled), which unescaping
reverses, so the printed form can be parsed too. Each conversation is opened by
a row of its own with the reserved id of ``<s>``.

Turns are encoded before the shuffle, where a long conversation is still
spread out; a conversation is then read in turn order as a stream of rows and
never held whole. Its digest runs over its turns in order, so one task reads a
conversation, the null one too, however long it is.

Defined results
* null text and null role count as empty; a role other than system, user and
  assistant is written out in its mark.
* null conversations form one conversation; null turns come first; equal turns
  are ordered by role and text, repeated rows all stay.
* empty table: empty result; extra columns aren't used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.bpe import Codec, codec, share
from loomwork.session import ship, shuffle_partitions

#: The template's control strings; their ids follow the vocabulary in this order.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[END]"]
BOS, EOS, INST, END_INST, SYS, END_SYS, ROLE, END_ROLE, END = range(len(CONTROLS))
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """Double backslashes, then break every control string after its first character."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def assemble(role: str, named: list[int], content: list[int], base: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of one turn from the ids of its escaped role and text."""
    if role == "user":
        parts = [(INST, None), (None, content), (END_INST, None)]
    elif role == "assistant":
        parts = [(None, content), (EOS, None)]
    elif role == "system":
        parts = [(SYS, None), (None, content), (END_SYS, None)]
    else:
        parts = [(ROLE, None), (None, named), (END_ROLE, None), (None, content), (END, None)]
    ids: list[int] = []
    edges = []
    for mark, body in parts:
        if body is None:
            ids.append(base + mark)
        else:
            if role == "assistant":
                edges.append((len(ids), len(ids) + len(body)))
            ids.extend(body)
    steps = np.zeros(len(ids) + 1, np.int64)
    for a, b in edges:
        steps[a] += 1
        steps[b] -= 1
    return np.array(ids, dtype="<i4"), np.cumsum(steps)[:-1].astype(np.uint8)


def format_turns(turns: DataFrame, ranks: dict[bytes, int], pattern: str, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, ids, mask) of every row: int32 ids and 0/1 loss mask as bytes, with ``tie`` to order equal turns.

    A further row a conversation, with ``opens`` true, holds its opening id.
    """
    ship(turns.sparkSession)
    shared = share(turns.sparkSession, ranks, pattern)
    base = max(ranks.values()) + 1
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"),
        F.sha2(F.coalesce(text_col, F.lit("")), 256).alias("tie"),
    )
    names = ["conv_id", "turn", "role", "tie", "ids", "mask"]
    opening = np.array([base + BOS], "<i4").tobytes()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                roles = part.column(2).to_pylist()
                # Segments are encoded one by one; their unseen words are replayed together.
                coded = [np.frombuffer(x, "<i4").tolist() for x in own.encode_many([escape(x) for x in [*roles, *part.column(3).to_pylist()]])]
                made = [assemble(r, a, b, base) for r, a, b in zip(roles, coded[: len(roles)], coded[len(roles) :], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), part.column(4), pa.array([a.tobytes() for a, _ in made], pa.binary()), pa.array([m.tobytes() for _, m in made], pa.binary())], names=names)

    said = rows.mapInArrow(each, "conv_id long, turn long, role string, tie string, ids binary, mask binary").withColumn("opens", F.lit(False))
    first = rows.groupBy("conv_id").agg(F.lit(None).cast("long").alias("turn"))
    marks = [F.lit("").alias("role"), F.lit("").alias("tie"), F.lit(bytearray(opening)).alias("ids"), F.lit(bytearray(1)).alias("mask"), F.lit(True).alias("opens")]
    return said.unionByName(first.select("conv_id", "turn", *marks))


def in_order(formatted: DataFrame) -> DataFrame:
    """Each conversation's opening and its turns, one after another in one partition, read as a stream."""
    n = shuffle_partitions(formatted.sparkSession)
    return formatted.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.desc("opens"), "turn", "role", "tie")


def parse(ids: list[int], own: Codec, base: int) -> tuple[str | None, str, str]:
    """(role, unescaped text, printed form) of one formatted turn, from its ids alone; the opening has no role."""
    printed: list[str] = []
    marks: list[int] = []
    bodies: list[str] = []
    run: list[int] = []

    def flush() -> None:
        bodies.append(own.decode(run).decode("utf-8", "surrogatepass"))
        printed.append(bodies[-1])
        run.clear()

    for i in ids:
        if i >= base:
            flush()
            marks.append(i - base)
            printed.append(CONTROLS[i - base])
        else:
            run.append(i)
    flush()
    if marks[0] == BOS:
        return None, "", "".join(printed)
    if marks[0] == ROLE:
        role, body = unescape(bodies[1]), bodies[2]
    elif marks[0] == EOS:
        role, body = "assistant", bodies[0]
    else:
        role, body = {INST: "user", SYS: "system"}[marks[0]], bodies[1]
    return role, unescape(body), "".join(printed)


def read_back(formatted: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Per conversation, from ids and mask alone: turns, digests of all texts and of the text under the mask, printed length.

    The printed form of a conversation is what its opening and its turns print.
    """
    ship(formatted.sparkSession)
    shared = share(formatted.sparkSession, ranks, pattern)
    base = max(ranks.values()) + 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared)
        now: list = []
        done: list[tuple] = []

        def close() -> None:
            conv, n, whole, chars, loss, printed = now
            done.append((conv, n, whole.hexdigest(), chars, loss.hexdigest(), printed))

        def batch_of() -> pa.RecordBatch:
            rows = list(zip(*done, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            done.clear()
            return out

        for batch in batches:
            for conv, raw, raw_mask in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                if not now or now[0] != conv.as_py():
                    if now:
                        close()
                    now[:] = [conv.as_py(), 0, sha256(), 0, sha256(), 0]
                ids, mask = np.frombuffer(raw.as_py(), "<i4"), np.frombuffer(raw_mask.as_py(), np.uint8)
                role, text, printed = parse(ids.tolist(), own, base)
                now[5] += len(printed)
                if role is None:
                    continue
                learnt = unescape(own.decode(ids[mask == 1].tolist()).decode("utf-8", "surrogatepass"))
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                now[3] += len(learnt)
                now[4].update(learnt.encode("utf-8", "surrogatepass"))
            if len(done) > 5000:
                yield batch_of()
        if now:
            close()
        yield batch_of()

    kept = in_order(formatted).select("conv_id", "ids", "mask")
    return kept.mapInArrow(each, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
